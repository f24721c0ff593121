"""SQL that checks the queries SQL can express."""

from __future__ import annotations

from eventide.llm import license_scan

_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SOLID = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {}

_TEMPLATES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t))
                       for t in license_scan.TEMPLATES)

ORACLE["op1_license_scan"] = rf"""
WITH t(license, text) AS (VALUES {_TEMPLATES}),
tn AS (SELECT row_number() OVER () AS t, license, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM t),
tb AS (SELECT DISTINCT t, license, w[i] || ' ' || w[i + 1] AS g
       FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM tn)),
ts AS (SELECT t, license, count(*) AS b FROM tb GROUP BY ALL),
d AS (SELECT doc_id, {_LOWER} AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM d
      UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n(?:[ \t\r\x0b\x0c]*\n)+')) FROM d
      UNION ALL SELECT doc_id, text FROM d),
pn AS (SELECT doc_id, row_number() OVER () AS p, regexp_extract_all(text, {_ALNUM}) AS w FROM p),
pb AS (SELECT DISTINCT doc_id, p, w[i] || ' ' || w[i + 1] AS g
       FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM pn)),
ps AS (SELECT p, count(*) AS a FROM pb GROUP BY p),
c AS (SELECT doc_id, p, t, count(*) AS n FROM pb JOIN tb USING (g) GROUP BY ALL),
f AS (SELECT doc_id, license, max(2 * n / (a + b)) AS dice
      FROM c JOIN ps USING (p) JOIN ts USING (t) WHERE 2 * n / (a + b) >= 0.8 GROUP BY ALL),
best AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice,
                count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses
         FROM f GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN best USING (doc_id)
"""

ORACLE["op3_topk_search"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
s AS (SELECT doc_id, len(w) AS dl FROM w),
m AS (SELECT count(*) AS n, greatest(1.0, sum(dl) / count(*)) AS mean FROM s),
tf AS (SELECT doc_id, g, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS g FROM w) GROUP BY ALL),
df AS (SELECT g, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, m GROUP BY g),
sc AS (SELECT q.doc_id AS query_id, tf.doc_id,
              round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
       FROM tf q JOIN df USING (g) JOIN tf USING (g) JOIN s ON s.doc_id = tf.doc_id, m
       WHERE q.doc_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER)
             AS rank FROM sc)
SELECT query_id, doc_id, rank, score FROM r WHERE rank <= 10
"""

ORACLE["op4_source_mix"] = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SOLID})) AS size FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS r
      FROM s GROUP BY source),
w AS (SELECT *, 1.0E0 + (r - 1) % 3 AS w, 3.0E0 * ss AS cap, CAST(sum(ss) OVER () AS DOUBLE) AS total FROM b),
o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW
             AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, cap < level * w AS capped FROM o),
t AS (SELECT *, CASE WHEN capped THEN cap ELSE least(cap, w * ((total
             - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
             / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())) END AS target FROM c),
e AS (SELECT s.*, t.ss, t.target, unnest(generate_series(0, greatest(1, least(3, CAST(ceil(target / ss)
             AS INT))) - 1)) AS e FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST('0x' || md5('mix|' || e || '|' || doc_id)[1:15] AS BIGINT) AS k FROM e),
p AS (SELECT *, e * ss + coalesce(sum(size) OVER (PARTITION BY source, e ORDER BY k, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
SELECT doc_id, size, ss AS source_size, target,
       CAST(sum(greatest(0, least(size, floor(target) - start))) AS BIGINT) AS taken
FROM p GROUP BY doc_id, size, ss, target
"""

ORACLE["op7_decontamination"] = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT *, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k
             FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
             FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, item, n, k FROM dw JOIN iw USING (n, g)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM h) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

ORACLE["op9_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SOLID}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
      FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n s ON s.doc_id = a JOIN n t ON t.doc_id = b
      WHERE 100 * c >= 80 * (s.n + t.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

ORACLE["op8_chat_preferences"] = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                          coalesce(text, '')) AS k FROM conversations),
a AS (SELECT conv_id, k, text, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS back
      FROM t WHERE role = 'assistant'),
c AS (SELECT l.conv_id, l.k AS pos, p.text AS older, l.text AS newest
      FROM a l LEFT JOIN a p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.back = 2
      WHERE l.back = 1),
-- Equal last replies are common too, and the turns after them when the older one ends there.
n AS (SELECT c.*, CASE WHEN older = newest THEN pos ELSE pos - 1 END AS common FROM c),
r AS (SELECT t.conv_id, t.k, t.role, '<|' || t.role || '|>' || chr(10) AS head, t.text,
             '<|' || t.role || '|>' || chr(10) || t.text || chr(10) AS body, n.common, n.pos, n.older
      FROM t JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id),
o AS (SELECT *, coalesce(sum(length(body)) FILTER (WHERE k > common) OVER (
             PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS before FROM r)
SELECT conv_id, CAST(any_value(common) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE k <= common), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE k > common), '') AS chosen_completion,
       CASE WHEN any_value(older) IS NULL OR any_value(common) = any_value(pos) THEN ''
            ELSE '<|assistant|>' || chr(10) || any_value(older) || chr(10) END AS rejected_completion,
       coalesce(string_agg(CAST(before + length(head) AS VARCHAR) || '-'
                || CAST(before + length(body) - 1 AS VARCHAR), ',' ORDER BY k)
                FILTER (WHERE k > common AND role = 'assistant'), '') AS chosen_loss,
       CASE WHEN any_value(older) IS NULL OR any_value(common) = any_value(pos) THEN ''
            ELSE '14-' || CAST(14 + length(any_value(older)) AS VARCHAR) END AS rejected_loss
FROM o GROUP BY conv_id
"""

ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             [CAST('0x' || substr(h, 8 * i - 7, 8) AS BIGINT) FOR i IN [1, 2, 3, 4]] AS h FROM d),
f AS (SELECT doc_id, text, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a,
             greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
             array_to_string(w[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


def _centroid_rounds(rounds: int) -> str:
    """Centroids c0 .. c<rounds> and assignments a0 .. a<rounds>, each made from the one before."""
    sql = ""
    for r in range(rounds + 1):
        if r:
            sql += f"""
m{r} AS (SELECT cluster, i, sum(v) AS s, count(*) AS n FROM a{r - 1} JOIN x USING (vec_id) GROUP BY ALL),
c{r} AS (SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.v ELSE (s - (s % n + n) % n) // n END AS v
         FROM c{r - 1} c LEFT JOIN m{r} USING (cluster, i)),"""
        sql += f"""
a{r} AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
           SELECT vec_id, cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (i) GROUP BY ALL)
         GROUP BY vec_id),"""
    return sql


ORACLE["op13_centroid_clusters"] = f"""
WITH k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64
           AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT vec_id, i, CAST(floor(64 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v
      FROM (SELECT vec_id, e, unnest(generate_series(1, 64)) AS i FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM k),
c0 AS (SELECT cluster, i, v FROM f JOIN x USING (vec_id) WHERE cluster < 16),{_centroid_rounds(3)}
h AS (SELECT cluster, sha256(string_agg(v, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN h USING (cluster)
"""
