"""One SQL check per registered query that SQL can express."""

from __future__ import annotations

import re

from eventide import fixed_values as fv
from eventide import proxies as px
from eventide.checks.oracle import (A, COUNT, COVER, BURST, DAY, DESIGN, DESIGN_NOTE, LOW, ORACLE,
                                    PIT_EV, PIT_RET, RET, RUNWAY, SIZE, STAGE_KEY, WORD, Z, area,
                                    check, clean, cut, design_mult, inter, move, net, ntrim,
                                    on_grid, prior, q, ready, squeeze, summary_sql)
from eventide.checks.queries import CORPUS_LEXICON
from eventide.functions.sentiment import Lexicon

BOARD = ("joined_rows", "windowed", "feat", "cascade", "amplified", "scored")
WHY = BOARD + ("reasoned",)

# --- sources and tables -----------------------------------------------------------------------------

check("filing_index_rows", """
    SELECT CAST(o_orderkey AS VARCHAR) AS ticker, o_orderpriority AS form,
           CAST(o_orderdate AS DATE) AS filed, CAST(o_custkey AS VARCHAR) AS accession, 0 AS pos
    FROM orders UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(o_orderdate AS DATE),
           CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderstatus <> 'P'""")
check("insider_quarter_rows", """
    SELECT concat('T', o_custkey) AS ticker, CAST(o_orderdate AS DATE) AS filed_date,
      CAST(l_orderkey AS VARCHAR) AS accession,
      CASE l_returnflag WHEN 'R' THEN 'P' ELSE 'S' END AS code, l_quantity AS shares,
      CASE WHEN l_linenumber > 2 THEN nullif(l_discount, 0) END AS price,
      round(CASE WHEN l_linenumber > 2 THEN l_quantity * l_discount ELSE 0 END, 8) AS usd
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND l_returnflag IN ('R', 'A')""")
check("short_interest_rows", """
    SELECT concat('T', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS settlement_date,
      CAST(l_shipdate AS DATE) + CASE isodow(l_shipdate) WHEN 6 THEN 13 WHEN 7 THEN 12 ELSE 14 END
        AS published_date, l_quantity AS shares_short,
      CASE WHEN l_discount <> 0 THEN l_quantity END AS shares_short_prior,
      l_extendedprice AS avg_daily_volume, l_discount AS days_to_cover, l_tax AS change_pct
    FROM lineitem WHERE l_linenumber <> 7 AND l_tax <> 0""")
check("price_panel", "SELECT ticker, day, pos, close FROM panel", "usable", "cal", "panel")
MISSING = """(SELECT DISTINCT ticker FROM {src} EXCEPT
    SELECT ticker FROM price_bar WHERE day >= DATE '2000-01-01' - 10
      AND day < DATE '2000-05-02' + 120 GROUP BY ticker HAVING count(*) >= 30)"""
check("tickers_without_history", "SELECT ticker FROM " + MISSING.format(src="filing_index"))
check("study_coverage", """, e AS (SELECT DISTINCT ticker, filed FROM filing_index
      WHERE form IN ('10-Q', '10-K') AND filed BETWEEN DATE '2000-01-01' AND DATE '2000-05-02')
    SELECT CAST(count(*) AS BIGINT) AS observations, count(DISTINCT ticker) AS tickers,
      (SELECT count(*) FROM """ + MISSING.format(src="e") + ") AS missing_tickers FROM e")
check("split_events", "SELECT upper(ticker) AS ticker, day, ratio FROM split_event WHERE ratio > 0")
check("filing_phrase_hits", f"""
    SELECT ticker, company_name, filed, cik, min(doc_id) AS doc_id FROM (
      SELECT upper(source) AS ticker, concat('Firm ', source) AS company_name, source AS cik, doc_id,
        DATE '1999-10-01' + CAST(doc_id % 400 AS INT) AS filed FROM documents
      WHERE lang = 'en' AND (contains(lower(text), 'the of') OR contains(lower(text), 'and the')))
    WHERE filed BETWEEN {DAY} - 180 AND {DAY} GROUP BY ALL""")
check("keyed_upsert", """
    SELECT * REPLACE (CASE WHEN snapshot_date > DATE '2024-01-10' THEN conviction + 1
      ELSE conviction END AS conviction) FROM verdict_log""")
check("calendar_slice_replace", f"""
    SELECT drug_id, catalyst_date_raw,
      CASE WHEN catalyst_date_hi >= DATE '2000-05-16' THEN 'NEW' ELSE ticker END AS ticker,
      CASE WHEN catalyst_date_hi >= DATE '2000-05-16' OR ticker <> 'T1' THEN catalyst_date_hi END
        AS catalyst_date_hi FROM catalysts""")
check("reconciled_log", """
    SELECT drug_id, snapshot_date, CAST(NULL AS VARCHAR) AS ticker, catalyst_date, verdict, setup,
      conviction, evidence FROM verdict_log""")

# --- text -----------------------------------------------------------------------------------------

check("normalised_values", f"""
    SELECT p_partkey, {clean('t')} AS clean,
      CASE WHEN p_size % 4 IN (0, 1) THEN -1 ELSE p_retailprice END AS num
    FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN '  NaN ' WHEN 1 THEN '<NA>' WHEN 2 THEN NULL
          ELSE concat('  ', p_name, ' ') END AS t FROM part)""")
SUFFIX = "|".join(fv.COMPANY_SUFFIXES)
KEY = (r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), "
       rf"'\b(?:{SUFFIX})\b', ' ', 'g'), '\s+', ' ', 'g'))")
check("company_keys", f"""
    SELECT c_custkey, {KEY.format(x="concat(c_name, ', Inc. & ', c_mktsegment, ' Therapeutics Holdings-CO (Group)')")}
      AS name_key FROM customer""")
check("simple_stages", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 0 THEN 'phase2/3' WHEN o_orderkey % 6 = 0
      THEN 'phase1/2' WHEN o_orderkey % 7 = 0 THEN 'phase4' WHEN o_orderkey % 5 = 0 THEN 'phase3'
      WHEN o_orderkey % 3 = 0 THEN 'phase2' WHEN o_orderkey % 2 = 0 THEN 'phase1'
      ELSE 'other' END AS stage FROM orders""")
check("owner_roles", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 IN (1, 2, 4) THEN 'senior'
      WHEN c_custkey % 2 = 0 THEN 'officer' WHEN c_custkey % 3 = 0 THEN 'director'
      WHEN c_custkey % 5 = 1 THEN 'ten_percent' ELSE 'other' END AS role FROM customer""")
check("therapeutic_areas", f"""
    SELECT concat('c', drug_id) AS id, {area('indication')} AS area FROM catalysts UNION ALL
    SELECT concat('d', doc_id), {area('text')} FROM documents""")
check("stable_ids", """
    SELECT drug_id, CAST(concat('0x', substr(sha1(concat(ticker, '|', CASE WHEN drug_id % 3 <> 0
      THEN nct_id ELSE 'None' END, '|', catalyst_date_raw)), 1, 15)) AS BIGINT) AS stable_id
    FROM catalysts""")
check("page_texts", r"""
    SELECT page_id, regexp_replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
        '<[^>]+>', ' ', 'g'),
      '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g') AS body
    FROM pages""")
check("tidy_indications", """
    SELECT drug_id, CASE WHEN k = 6 THEN concat('moderate to severe ', CASE len(w) WHEN 2 THEN
        concat(indication, ' one two three four five') WHEN 3 THEN concat(indication,
        ' one two three four') WHEN 4 THEN concat(indication, ' one two three')
        ELSE concat(indication, ' one two three four five six') END)
      WHEN k IN (4, 7) OR indication = 'Wet AMD' THEN NULL ELSE tidy END AS tidy
    FROM (SELECT drug_id, indication, drug_id % 8 AS k, indication AS tidy,
            string_split(indication, ' ') AS w FROM catalysts)""")

LEX = CORPUS_LEXICON


def _count(word: str) -> str:
    """Occurrences of a word start: text split at a mark put before each of them."""
    marked = f"regexp_replace(t, '(^|{WORD}){word}', '\\1⟦', 'g')"
    return f"(len({marked}) - len(replace({marked}, '⟦', '')))"


def _flips(mark: str, term: str, lex) -> str:
    """Hits whose 32 characters before hold a negator."""
    parts = f"string_split({mark}, '⟦')"
    before = f"right(array_to_string({parts}[1:i], {q(term)}), 32)"
    ends = lex.negators.replace(r"\b", "").strip()
    neg = f"(^|{WORD}){ends}($|{WORD})"
    return (f"len(list_filter(range(1, len({parts})), lambda i: "
            f"regexp_matches({before}, {q(neg)})))")


def _hits(text: str, source: str, lex=LEX) -> str:
    neg = ([f"((len(t) - len(replace(t, {q(p)}, ''))) // {len(p)})" for p in lex.negative_phrases]
           + [_count(w) for w in lex.negative_words])
    pos = ([f"((len(t) - len(replace(t, {q(p)}, ''))) // {len(p)})" for p in lex.positive_phrases]
           + [_count(w) for w in lex.positive_words])
    flips = ([_flips(f"replace(t, {q(p)}, '⟦')", p, lex) for p in lex.positive_phrases]
             + [_flips(f"regexp_replace(t, '(^|{WORD}){w}', '\\1⟦', 'g')", w, lex)
                for w in lex.positive_words])
    return (f"SELECT * EXCLUDE (t, a, f, p0), CAST(p0 - f AS INT) AS pos, CAST(a + f AS INT) AS neg "
            f"FROM (SELECT *, {' + '.join(neg)} AS a, {' + '.join(pos)} AS p0, "
            f"{' + '.join(flips)} AS f FROM (SELECT *, lower({clean(text)}) AS t FROM {source}))")


check("headline_hits", f"SELECT doc_id, pos, neg FROM ({_hits('text', 'documents')})")
check("headline_hits_default_lexicon", f"SELECT doc_id, pos, neg FROM "
      f"({_hits('title', 'worded_headline', Lexicon())})")
HEAD = "(SELECT * REPLACE (concat('src', pos % 20) AS ticker) FROM headline)"
UNIQUE = r"""(SELECT * FROM (SELECT *, regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g')
    AS key FROM """ + HEAD + """) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY
    ticker, key ORDER BY CASE source WHEN 'rss' THEN 0 ELSE 1 END, pos) = 1)"""
check("distinct_headlines", f"SELECT ticker, pos, source FROM {UNIQUE}")
TOPIC = f"""EXISTS (SELECT 1 FROM documents d WHERE d.source = h.ticker AND true)
    AND regexp_matches(lower(h.title), concat('(^|{WORD})(', h.ticker, '|', CASE WHEN (SELECT
      min(doc_id) % 2 FROM documents d WHERE d.source = h.ticker) = 0 THEN 'ouen' ELSE 'nterti' END,
      '|whst)($|{WORD})'))"""
check("on_topic_headlines", f"SELECT ticker, pos FROM {HEAD} h WHERE {TOPIC}")
check("recent_headlines", f"SELECT ticker, pos FROM {HEAD} WHERE published BETWEEN DATE '2024-01-20' AND DATE '2024-01-26'")


def _mood(source: str) -> str:
    return f"""SELECT ticker, CAST(count(*) AS INT) AS articles,
      CAST(sum(pos + neg) AS INT) AS scored_articles, CAST(sum(pos) AS INT) AS pos_hits,
      CAST(sum(neg) AS INT) AS neg_hits, CAST(CASE WHEN sum((pos + neg) * w) <> 0 THEN
        round_even(sum((pos - neg) * w) / sum((pos + neg) * w), 3) ELSE 0 END AS DOUBLE) AS sentiment,
      sum(pos + neg) < 4 AS thin,
      (list(title ORDER BY pos - neg DESC, s, ord) FILTER (pos > neg))[1] AS top_positive,
      (list(title ORDER BY pos - neg, s, ord) FILTER (pos < neg))[1] AS top_negative
    FROM (SELECT ticker, title, pos, neg, ord, CASE source WHEN 'rss' THEN 0 ELSE 1 END AS s,
            power(0.5E0, greatest(0, DATE '2024-01-25' - published) / 7.0E0) AS w
          FROM ({_hits('title', f'(SELECT * EXCLUDE (pos), pos AS ord FROM {source})')}))
    GROUP BY ticker"""


check("headline_sentiment", _mood(UNIQUE))
RECENT = UNIQUE.replace("FROM " + HEAD, f"FROM (SELECT * FROM {HEAD} WHERE published BETWEEN DATE '2024-01-04' AND DATE '2024-01-25')")
check("sentiment_table", f""", mood AS ({_mood(f'(SELECT h.* FROM {RECENT} h WHERE {TOPIC})')}),
    f AS (SELECT concat('src', substr(ticker, 2)) AS ticker, filed + 8500 AS filed FROM filing_index
          WHERE starts_with(form, '8-K'))
    SELECT a.ticker, DATE '2024-01-25' AS snapshot_date, coalesce(articles, 0) AS articles,
      coalesce(scored_articles, 0) AS scored_articles, coalesce(pos_hits, 0) AS pos_hits,
      coalesce(neg_hits, 0) AS neg_hits, coalesce(sentiment, 0) AS sentiment,
      coalesce(thin, true) AS thin, top_positive, top_negative,
      CAST(count(filed) FILTER (DATE '2024-01-25' - filed <= 30) AS INT) AS eightk_30d,
      CAST(count(filed) FILTER (DATE '2024-01-25' - filed <= 90) AS INT) AS eightk_90d,
      CAST(count(filed) FILTER (DATE '2024-01-25' - filed <= 365) AS INT) AS eightk_365d,
      CAST(DATE '2024-01-25' - max(filed) AS INT) AS days_since_8k
    FROM (SELECT DISTINCT source AS ticker FROM documents) a LEFT JOIN mood USING (ticker)
    LEFT JOIN f ON f.ticker = a.ticker AND filed <= DATE '2024-01-25' GROUP BY ALL""")

# --- dates ----------------------------------------------------------------------------------------

EOM = "CAST(last_day({0}) AS DATE)"
check("fuzzy_dates", """, x AS (SELECT o_orderkey AS id, o_orderkey % 14 AS k,
        CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders),
      z AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS m1, make_date(y, 1, 1) AS y1,
        make_date(y, 12, 31) AS y2 FROM x)
    SELECT id, CASE WHEN k IN (0, 1, 3, 10) THEN day WHEN k = 2 THEN m1
        WHEN k = 4 THEN CASE WHEN m = 9 THEN make_date(y, 5, 1) ELSE m1 + 10 END
        WHEN k = 5 THEN make_date(y, 3 * (1 + m % 4) - 2, 1)
        WHEN k = 6 THEN make_date(y, 6 * (1 + m % 2) - 5, 1)
        WHEN k IN (7, 8) THEN y1 WHEN k = 9 THEN NULL
        WHEN k = 11 THEN CASE WHEN m = 9 THEN make_date(y, 9, 1) ELSE m1 + 20 END
        WHEN k = 12 THEN CASE WHEN day(day) + 20 <= day(last_day(day)) THEN day + 20 END
        ELSE make_date(y, 7, 1) END AS lo,
      CASE WHEN k IN (0, 1, 3, 10) THEN day WHEN k = 2 THEN last_day(day)
        WHEN k = 4 THEN CASE WHEN m = 9 THEN make_date(y, 8, 31) ELSE m1 + 19 END
        WHEN k = 5 THEN last_day(make_date(y, 3 * (1 + m % 4), 1))
        WHEN k = 6 THEN last_day(make_date(y, 6 * (1 + m % 2), 1))
        WHEN k = 7 THEN make_date(y, 4, 30) WHEN k = 8 THEN y2 WHEN k = 9 THEN NULL
        WHEN k = 11 THEN CASE WHEN m = 9 THEN y2 ELSE last_day(day) END
        WHEN k = 12 THEN CASE WHEN day(day) + 20 <= day(last_day(day)) THEN day + 20 END
        ELSE y2 END AS hi,
      CASE WHEN k IN (0, 1, 3, 10) THEN 'day' WHEN k = 2 THEN 'month'
        WHEN k IN (4, 11) THEN CASE WHEN m = 9 THEN 'year_part' ELSE 'month_part' END
        WHEN k = 5 THEN 'quarter' WHEN k IN (6, 13) THEN 'half' WHEN k = 7 THEN 'year_part'
        WHEN k = 8 THEN 'year' WHEN k = 9 THEN 'unknown'
        ELSE CASE WHEN day(day) + 20 <= day(last_day(day)) THEN 'day' ELSE 'unknown' END
        END AS precision FROM z""")
check("narrowed_windows", """
    SELECT drug_id, CASE WHEN n THEN glo ELSE a END AS lo, CASE WHEN n THEN ghi ELSE b END AS hi,
      CASE WHEN n THEN 'guidance' ELSE 'trial' END AS source
    FROM (SELECT *, coalesce(period_lo IS NOT NULL AND glo <= ghi, false) AS n FROM (
      SELECT drug_id, catalyst_date_lo AS a, catalyst_date_hi AS b, period_lo,
        greatest(catalyst_date_lo, period_lo) AS glo,
        CASE WHEN period_hi IS NULL THEN catalyst_date_hi ELSE least(catalyst_date_hi, period_hi)
          END AS ghi FROM catalysts LEFT JOIN guidance USING (ticker)))""")
FUZZY = ORACLE["fuzzy_dates"]
ORACLE["readout_windows"] = (f"SELECT id, lo AS catalyst_date_lo, lo + 180 AS catalyst_date_hi, "
                             f"concat(raw, ' + window') AS catalyst_date_raw, "
                             f"'readout_window' AS date_precision FROM ({px.VIEWS['raw_date']}) r "
                             f"JOIN (WITH " + FUZZY.replace("WITH ", "", 1).lstrip(", \n")
                             + ") f USING (id)")
check("publication_dates", """
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS settled, CAST(l_shipdate AS DATE)
      + CASE isodow(l_shipdate) WHEN 6 THEN 13 WHEN 7 THEN 12 ELSE 14 END AS published
    FROM lineitem""")
check("study_quarters", """
    SELECT concat(year(x), 'q', quarter(x)) AS quarter FROM (SELECT unnest(generate_series(
      date_trunc('quarter', min(o_orderdate)) - INTERVAL 3 MONTH,
      date_trunc('quarter', max(o_orderdate)), INTERVAL 3 MONTH)) AS x FROM orders)""")

# --- priors and buckets ------------------------------------------------------------------------------

check("approval_priors", f"""
    SELECT drug_id, round({prior(STAGE_KEY, area('indication'), 'designations')}, 8) AS loa
    FROM catalysts""")
check("typical_moves", f"""
    SELECT drug_id, round({move(STAGE_KEY, 'market_cap')}, 8) AS expected_move
    FROM catalysts LEFT JOIN prices USING (ticker)""")
check("trial_design", f"""
    SELECT nct_id, design_bucket, {design_mult("'phase2'")} AS design_multiplier,
      {DESIGN_NOTE} AS design_note FROM (SELECT *, {DESIGN} AS design_bucket FROM trials)""")
PCT, BUILD, RISK, LABEL = squeeze("shares_short", "days_to_cover", "shares_outstanding",
                                  "shares_short_prior")
check("short_squeeze", f"""
    SELECT ticker, settlement_date, round({PCT}, 8) AS short_pct_outstanding,
      round({BUILD}, 8) AS short_build, {RISK} AS squeeze_risk, {LABEL} AS squeeze_label
    FROM short_interest LEFT JOIN financials USING (ticker)""")
check("study_buckets", f"""
    SELECT {RUNWAY('k')} AS runway, {SIZE('k * l_extendedprice / k * 40000')} AS size,
      {BURST('k / 12')} AS burst, {COUNT('(k - 1)')} AS n_filings, {COVER('k / 6')} AS cover,
      {net('(k - 25) * 15000')} AS net_flow, {cut('l_quantity / 50', fv.PRIOR_CUTS)} AS prior,
      {cut('(l_quantity * 10 - 20)', fv.ENROLLMENT_CUTS)} AS enrollment,
      {cut('((k - 25) / 100)', fv.RUNUP_CUTS)} AS runup,
      {inter('k < 20', 'l_discount > 0.05', 'both', 'first', 'second')} AS mixed, count(*) AS n
    FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS k FROM lineitem) GROUP BY ALL"""
      .replace("k * l_extendedprice / k * 40000",
               "(CASE WHEN k IS NOT NULL THEN l_extendedprice * 40000 END)"))

# --- board ------------------------------------------------------------------------------------------

check("feature_join", """
    SELECT drug_id, enrollment, allocation, round(cash_usd, 4) AS cash_usd,
      round(runway_months, 4) AS runway_months, cash_asof, round(last, 4) AS last,
      round(market_cap, 4) AS market_cap, round(implied_move, 4) AS implied_move, implied_expiry,
      round(sentiment, 4) AS sentiment, sentiment_thin, news_articles, eightk_90d, shares_short,
      round(days_to_cover, 4) AS days_to_cover, short_asof, dilution_label, offerings_24m, guide_lo,
      guide_hi, round(insider_tilt, 4) AS insider_tilt, n_buyers FROM joined_rows""", "joined_rows")
check("feature_frame", """
    SELECT drug_id, ticker, catalyst_date_lo, catalyst_date_hi, date_precision, date_source,
      days_to_catalyst, round(date_confidence, 8) AS date_confidence, ta, design_bucket,
      round(design_multiplier, 8) AS design_multiplier, design_note, round(loa, 8) AS loa,
      round(expected_move, 8) AS expected_move, round(move_ratio, 8) AS move_ratio,
      round(baseline_move, 8) AS baseline_move, round(materiality, 8) AS materiality,
      round(runway_at_catalyst, 8) AS runway_at_catalyst, runway_stale, is_binary, microcap,
      illiquid, round(short_pct_outstanding, 8) AS short_pct_outstanding,
      round(short_build, 8) AS short_build, squeeze_risk, squeeze_label FROM feat""", *BOARD[:3])
check("scored_board", """
    SELECT drug_id, ticker, days_to_catalyst, verdict, directional, setup, setup_desc, evidence,
      evidence_note, lean, conviction, CASE WHEN len(reason_list) > 0
        THEN array_to_string(reason_list, ' | ') ELSE 'insufficient data' END AS reasons,
      round(rs, 2) AS runway_score, round(us, 2) AS runup_score, round_even(ls, 2) AS loa_score
    FROM reasoned""", *WHY)
VIEW = "SELECT drug_id, setup, conviction, days_to_catalyst FROM scored"
check("board_top", VIEW + " ORDER BY conviction DESC, days_to_catalyst, drug_id LIMIT 30", *BOARD)
check("board_actionable_by_date", VIEW + """ WHERE setup <> 'NO_EDGE' AND conviction >= 20
    AND days_to_catalyst <= 120 ORDER BY days_to_catalyst, conviction DESC, drug_id LIMIT 250""",
      *BOARD)
check("board_search", """SELECT drug_id, setup, evidence, conviction FROM scored
    WHERE evidence = 'supported' AND (contains(lower(ticker), 'nephri')
      OR contains(lower(drug_name), 'nephri') OR contains(lower(indication), 'nephri'))""", *BOARD)
check("board_verdict_tally", "SELECT verdict, count(*) AS n FROM scored GROUP BY verdict", *BOARD)
RANKED = "coalesce(" + ", ".join(
    f"list_filter(reason_list, lambda r: contains(lower(r), {q(k)}))[1]" for k in fv.REASON_RANK) \
    + ", reason_list[1], 'insufficient data')"
check("published_board", f"""
    SELECT drug_id, CAST(to_json(struct_pack(ticker := ticker,
      robinhood := concat({q(fv.QUOTE_PAGE)}, ticker), company := company_name,
      date := catalyst_date_raw, days := days_to_catalyst,
      date_hi := CAST(catalyst_date_hi AS VARCHAR), verdict := verdict, directional := directional,
      conviction := conviction, sent_thin := coalesce(sentiment_thin, true),
      short_asof := CAST(short_asof AS VARCHAR), cash_asof := CAST(cash_asof AS VARCHAR),
      cluster_buy := coalesce(cluster_buy, false),
      headline := coalesce(nullif(top_negative, ''), top_positive), headline_reason := {RANKED},
      n_reasons := greatest(len(reason_list), 1), nct := nct_id)) AS VARCHAR) AS doc
    FROM reasoned""", *WHY)
check("verdict_snapshot", f"""
    SELECT drug_id, {DAY} AS snapshot_date, ticker, catalyst_date_lo AS catalyst_date, verdict,
      setup, conviction, evidence FROM scored""", *BOARD)
PAIRS = f"""(SELECT DISTINCT c.ticker, catalyst_date_lo AS catalyst_date FROM catalysts c
    JOIN (SELECT DISTINCT ticker FROM prices) p ON p.ticker = c.ticker
    WHERE catalyst_date_lo - {DAY} BETWEEN 0 AND 45)"""
check("implied_candidates", f"SELECT ticker, catalyst_date FROM {PAIRS}")
check("implied_moves", f""", m AS (SELECT *, CASE WHEN bid <> 0 AND ask <> 0 THEN (bid + ask) / 2
      ELSE coalesce(last, 0) END AS mid FROM option_quote WHERE asof <= {DAY}),
    newest AS (SELECT ticker, expiry, max(asof) AS asof FROM m GROUP BY ALL),
    near AS (SELECT m.* FROM m JOIN newest USING (ticker, expiry, asof) QUALIFY row_number() OVER (
      PARTITION BY ticker, expiry, side ORDER BY abs(strike - spot), pos) = 1),
    first AS (SELECT p.ticker, p.catalyst_date, min(expiry) AS expiry FROM {PAIRS} p
      JOIN m o ON o.ticker = p.ticker AND o.expiry >= p.catalyst_date GROUP BY ALL)
    SELECT f.ticker, f.catalyst_date, f.expiry,
      round(coalesce((c.iv + p.iv) / 2, c.iv, p.iv), 8) AS atm_iv,
      round((c.mid + p.mid) / c.spot, 8) AS implied_move,
      round((c.mid + p.mid) / c.spot, 8) AS straddle_pct
    FROM first f JOIN near c ON c.ticker = f.ticker AND c.expiry = f.expiry AND c.side = 'C'
    JOIN near p ON p.ticker = f.ticker AND p.expiry = f.expiry AND p.side = 'P'
    WHERE c.mid + p.mid > 0""")

# --- as-of ------------------------------------------------------------------------------------------

check("periodic_filings", "SELECT ticker, event_date AS asof FROM ev", "ev")
check("short_interest_asof", "SELECT * FROM sia_ask_ev", "ev", "ask_ev", "si_pub", "sia_ask_ev")
check("financials_asof", """
    SELECT ticker, asof, round(cash_usd, 8) AS cash_usd, cash_period_end, cash_filed,
      round(quarterly_burn_usd, 8) AS quarterly_burn_usd, round(runway_months, 8) AS runway_months,
      round(shares_outstanding, 8) AS shares_outstanding FROM fin_ask_ev""", "ev", *PIT_EV)
check("cadence_asof", """
    SELECT a.ticker, a.asof, coalesce(eightk_30d, 0) AS eightk_30d,
      coalesce(eightk_90d, 0) AS eightk_90d, coalesce(eightk_365d, 0) AS eightk_365d,
      days_since_8k, burst FROM ask_ev a LEFT JOIN cad_ask_ev USING (ticker, asof)""",
      "ev", "ask_ev", "cad_ask_ev")
check("financing_asof", "SELECT * FROM post_ask_ev", "ev", "ask_ev", "post_ask_ev")
check("insiders_asof", "SELECT * FROM inw_ask_ev", "ev", "ask_ev", "inw_ask_ev")
check("market_cap_asof", """
    SELECT f.ticker, f.asof, round(shares_outstanding, 3) AS shares_outstanding,
      round(shares_outstanding * coalesce((SELECT product(ratio) FROM split_event e
        WHERE e.ticker = f.ticker AND e.day > f.asof), 1) * 12.5E0, 3) AS market_cap
    FROM fin_ask_ev f""", "ev", *PIT_EV)
check("sponsor_tickers", f""", reg AS (SELECT name, upper(arg_min(ticker, pos)) AS ticker, min(pos) AS pos
      FROM (SELECT {KEY.format(x="concat(p_name, CASE WHEN p_size % 3 = 0 THEN concat(' ', p_type) ELSE '' END, ' Inc.')")} AS name,
        concat('p', p_partkey) AS ticker, p_partkey AS pos FROM part) WHERE name <> '' GROUP BY name),
    sp AS (SELECT p_partkey AS id, {KEY.format(x="CASE p_size % 4 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN concat(p_name, ' ', p_type, ' Labs X') WHEN 2 THEN concat('Unlisted ', p_name) ELSE upper(p_name) END")} AS key FROM part),
    keys AS (SELECT DISTINCT key FROM sp),
    hit AS (SELECT key, ticker FROM keys k JOIN reg r ON r.name = k.key
        OR starts_with(k.key, concat(r.name, ' ')) OR starts_with(r.name, concat(k.key, ' '))
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY (r.name = k.key) DESC, len(r.name) DESC,
        r.pos) = 1)
    SELECT id, ticker FROM sp LEFT JOIN hit USING (key)""")

# --- returns and outcomes -----------------------------------------------------------------------------

check("calendar_positions", """, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT day, (SELECT min(pos) FROM cal c WHERE c.day >= d.day) AS on_or_after,
      (SELECT max(pos) FROM cal c WHERE c.day <= d.day - 1) AS before FROM days d""",
      "usable", "cal")
_exit = ", ".join(
    f"round(CASE WHEN b{h}.close > 0 THEN (p{h}.close / p.close - 1) - (b{h}.close / b.close - 1) END, 8) AS abn_{h}d"
    for h in (1, 5, 21, 63))
_join = " ".join(
    f"LEFT JOIN panel p{h} ON p{h}.ticker = e.ticker AND p{h}.pos = e.pos + {h + 5} "
    f"LEFT JOIN panel b{h} ON b{h}.ticker = 'BENCH' AND b{h}.pos = e.pos + {h + 5}"
    for h in (1, 5, 21, 63))
check("event_returns", f"""
    SELECT e.ticker, e.event_date, p.day AS entry_date, round(p.close, 8) AS entry_price,
      round(CASE WHEN e.pos >= 21 THEN (SELECT stddev_samp(r) FROM lr WHERE lr.ticker = e.ticker
        AND lr.pos BETWEEN e.pos - 62 AND e.pos) * sqrt(252.0E0) END, 8) AS rvol_60d,
      round(CASE WHEN e.pos >= 21 THEN p.close / h.close - 1 END, 8) AS ret_20d, {_exit}
    FROM (SELECT ev.*, (SELECT min(pos) FROM cal WHERE cal.day >= ev.event_date) - 5 AS pos FROM ev) e
    JOIN panel p ON p.ticker = e.ticker AND p.pos = e.pos
    JOIN panel b ON b.ticker = 'BENCH' AND b.pos = e.pos
    LEFT JOIN panel h ON h.ticker = e.ticker AND h.pos = e.pos - 20 {_join}
    WHERE p.close > 0 AND b.close > 0""", "ev", "usable", "cal", "panel", "lr")
STATS = """(SELECT *, row_number() OVER w AS k, ln(close / lead(close) OVER w) AS r,
    close * volume AS usd FROM price_bar WINDOW w AS (PARTITION BY ticker ORDER BY day DESC))"""
check("price_statistics", f"""
    SELECT ticker, round(max(close) FILTER (k = 1), 6) AS last,
      round(max(close) FILTER (k = 1) / max(close) FILTER (k = 21) - 1, 6) AS ret_20d,
      round(max(close) FILTER (k = 1) / max(close) FILTER (k = 61) - 1, 6) AS ret_60d,
      round(stddev_samp(r) FILTER (k <= 20) * sqrt(252.0E0), 6) AS rvol_20d,
      round(stddev_samp(r) FILTER (k <= 60) * sqrt(252.0E0), 6) AS rvol_60d,
      round(avg(usd) FILTER (k <= 20), 6) AS adv_usd,
      round(max(close) FILTER (k = 1) / max(close) FILTER (k <= 252), 6) AS pct_of_52w_high
    FROM {STATS} GROUP BY ticker HAVING count(*) >= 25""")
USED = """(SELECT *, string_split(tag, '_')[1] AS kind FROM xbrl_fact
    WHERE unit = CASE WHEN starts_with(tag, 'shares') THEN 'shares' ELSE 'USD' END)"""
OF_TAG = f"""(SELECT u.* FROM {USED} u JOIN (SELECT ticker, kind, tag FROM {USED} GROUP BY ticker, kind, tag
      QUALIFY row_number() OVER (PARTITION BY ticker, kind ORDER BY max(end_date) DESC, tag) = 1)
    USING (ticker, kind, tag))"""
FRESH = f"""(SELECT * FROM {OF_TAG} QUALIFY row_number() OVER (PARTITION BY ticker, kind
    ORDER BY end_date DESC, pos, val DESC) = 1)"""
YEAR = STATS.replace("FROM price_bar", f"FROM (SELECT * FROM price_bar WHERE day <= {DAY} "
                     f"AND day > {DAY} - INTERVAL 12 MONTH)")
check("price_table", f"""
    SELECT p.ticker, round(p.last, 3) AS last, round(nullif(f.val, 0) * coalesce((SELECT product(ratio)
      FROM split_event e WHERE e.ticker = p.ticker AND e.day > {DAY}), 1) * p.last, 3) AS market_cap
    FROM (SELECT ticker, max(close) FILTER (k = 1) AS last FROM {YEAR} GROUP BY ticker
          HAVING count(*) >= 25) p
    LEFT JOIN {FRESH} f ON f.ticker = p.ticker AND f.kind = 'shares'""")
check("realised_outcomes", f""", past AS (SELECT drug_id, ticker, catalyst_date_lo AS catalyst_date
      FROM catalysts WHERE catalyst_date_hi < {DAY} AND catalyst_date_lo >= {DAY} - 400
      AND date_precision IN ('day', 'month_part')),
    u AS (SELECT * FROM price_bar WHERE day >= {DAY} - 440 AND day <= {DAY}
      AND (ticker = 'BENCH' OR ticker IN (SELECT ticker FROM past))
      QUALIFY count(*) OVER (PARTITION BY ticker) >= 30),
    c AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT day FROM u)),
    p AS (SELECT u.*, c.pos FROM u JOIN c USING (day)),
    l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1),
    e AS (SELECT past.*, (SELECT max(pos) FROM c WHERE c.day < catalyst_date) AS pos FROM past)
    SELECT e.drug_id, e.catalyst_date, e.ticker, a.day AS entry_date, round(a.close, 8) AS entry_price,
      round(CASE WHEN l.pos > e.pos THEN l.close END, 8) AS last_price,
      CASE WHEN l.pos > e.pos THEN l.day END AS last_date,
      round(p1.close / a.close - 1, 8) AS move_1d, round(p5.close / a.close - 1, 8) AS move_5d,
      round(CASE WHEN l.pos > e.pos THEN l.close / a.close - 1 END, 8) AS move_todate,
      round((p1.close / a.close - 1) - (b1.close / b.close - 1), 8) AS abn_1d,
      round((p5.close / a.close - 1) - (b5.close / b.close - 1), 8) AS abn_5d,
      round(CASE WHEN l.pos > e.pos THEN (l.close / a.close - 1) - (bl.close / b.close - 1) END, 8)
        AS abn_todate
    FROM e JOIN p a ON a.ticker = e.ticker AND a.pos = e.pos
    JOIN p b ON b.ticker = 'BENCH' AND b.pos = e.pos JOIN l ON l.ticker = e.ticker
    LEFT JOIN p p1 ON p1.ticker = e.ticker AND p1.pos = e.pos + 1
    LEFT JOIN p p5 ON p5.ticker = e.ticker AND p5.pos = e.pos + 5
    LEFT JOIN p b1 ON b1.ticker = 'BENCH' AND b1.pos = e.pos + 1
    LEFT JOIN p b5 ON b5.ticker = 'BENCH' AND b5.pos = e.pos + 5
    LEFT JOIN p bl ON bl.ticker = 'BENCH' AND bl.pos = l.pos
    WHERE a.close > 0 AND b.close > 0""")
JUDGED = """, o AS (SELECT drug_id, snapshot_date AS catalyst_date, (conviction - 8) / 100.0E0
      AS move_todate FROM verdict_log WHERE snapshot_date >= DATE '2024-01-31' - 25),
    v AS (SELECT * REPLACE (snapshot_date + CAST(drug_id % 3 AS INT) AS snapshot_date) FROM verdict_log),
    j AS (SELECT o.*, c.drug_name, c.stage, v.verdict AS prior_verdict, v.setup AS prior_setup,
      v.conviction AS prior_conviction, v.snapshot_date AS verdict_asof
      FROM o LEFT JOIN catalysts c ON c.drug_id = o.drug_id
      LEFT JOIN v ON v.drug_id = o.drug_id AND v.snapshot_date < o.catalyst_date
      QUALIFY row_number() OVER (PARTITION BY o.drug_id, o.catalyst_date
        ORDER BY v.snapshot_date DESC NULLS LAST) = 1)
    """
check("recent_outcomes", JUDGED + """SELECT drug_id, catalyst_date, prior_verdict, prior_setup,
    prior_conviction, verdict_asof, drug_name, stage, round(move_todate, 8) AS move_todate FROM j""")
check("recent_outcomes_largest", JUDGED + """SELECT round(move_todate, 8) AS move_todate FROM j
    ORDER BY abs(move_todate) DESC, drug_id, catalyst_date LIMIT 100""")
check("recent_up_down", JUDGED + """SELECT count(*) FILTER (move_todate > 0) AS up,
    count(*) FILTER (coalesce(move_todate, 0) <= 0) AS down FROM j""")
check("published_recent", JUDGED + """SELECT concat('T', drug_id) AS ticker, drug_name AS drug,
    CAST(catalyst_date AS VARCHAR) AS date, '' AS last_date, prior_verdict, prior_conviction FROM j""")

# --- logs -----------------------------------------------------------------------------------------

check("log_latest_signature", """
    SELECT drug_id, verdict, setup, CAST(conviction // 10 AS BIGINT) AS decile, evidence FROM verdict_log
    QUALIFY row_number() OVER (PARTITION BY drug_id ORDER BY snapshot_date DESC) = 1""")
DELTA = """(SELECT n.* FROM (SELECT * FROM verdict_log WHERE snapshot_date > DATE '2024-01-15') n
    LEFT JOIN (SELECT * FROM verdict_log WHERE snapshot_date <= DATE '2024-01-15'
      QUALIFY row_number() OVER (PARTITION BY drug_id ORDER BY snapshot_date DESC) = 1) o USING (drug_id)
    WHERE o.verdict IS NULL OR o.verdict <> n.verdict OR o.setup <> n.setup
      OR o.conviction // 10 <> n.conviction // 10 OR o.evidence <> n.evidence
      OR o.catalyst_date <> n.catalyst_date)"""
check("log_changed_rows", f"SELECT * FROM {DELTA}")
check("log_append", f"""SELECT * FROM verdict_log WHERE snapshot_date <= DATE '2024-01-15'
    UNION ALL SELECT * FROM {DELTA}""")
_TRIALS = """tr AS (SELECT c_custkey AS k, concat(CASE WHEN c_custkey % 41 = 0 THEN 'ISRCTN' ELSE 'NCT' END,
      lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS nct_id, concat('Drug ', c_custkey) AS drug_name,
      CASE WHEN c_custkey % 2 = 0 THEN 'RECRUITING' ELSE 'COMPLETED' END AS overall_status,
      ['2000-07-15', '2000-09', '1999-03', 'soon'][1 + c_custkey % 4] AS primary_completion,
      ['PHASE1', 'PHASE2', 'PHASE2,PHASE3'][1 + c_custkey % 3] AS phases,
      CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 500 AS INT) END AS enrollment,
      concat('condition ', c_custkey % 9, '; pain') AS indication,
      concat('Supplier#', lpad(CAST(c_custkey % 15 + 1 AS VARCHAR), 9, '0')) AS lead_sponsor FROM customer),
    mt AS (SELECT tr.*, concat('T', s_suppkey) AS matched, s_suppkey FROM tr
      LEFT JOIN supplier ON s_name = lead_sponsor WHERE k % 5 <> 0 AND k % 3 <> 0)"""
_READOUTS = """SELECT CASE WHEN s_suppkey IS NOT NULL THEN matched END AS ticker, *
      FROM mt WHERE k % 4 IN (0, 1) AND k % 2 = 0"""
check("trial_design_rows", f""", {_TRIALS} SELECT nct_id, overall_status, phases, enrollment,
    'RANDOMIZED' AS allocation, 'DOUBLE' AS masking, primary_completion, lead_sponsor FROM tr WHERE k % 41 <> 0""")
check("candidate_readout_rows", f""", {_TRIALS} SELECT nct_id, drug_name, phases AS stage, primary_completion,
    indication, enrollment, ticker FROM ({_READOUTS})""")
check("historical_readout_rows", f""", {_TRIALS} SELECT nct_id, matched AS ticker, DATE '1999-03-01' AS event_date,
    'month' AS date_precision,
    ['phase2', 'phase2/3'][k % 3] AS simplified_stage, 'ctgov' AS anchor FROM mt
    WHERE s_suppkey IS NOT NULL AND k % 4 = 2""")
check("company_fact_rows", """WITH f AS (SELECT s_suppkey AS k, concat('T', s_suppkey) AS ticker,
      make_date(2000, 5, CAST(1 + s_suppkey % 9 AS INT)) AS day, s_acctbal AS b FROM supplier)
    SELECT ticker, 'Cash' AS tag, 'USD' AS unit, day AS filed, b AS val, 0 AS pos FROM f WHERE k % 3 <> 0
    UNION ALL SELECT ticker, 'Cash', 'USD', DATE '2000-08-01', b + 2, 2 FROM f WHERE k % 3 <> 0
    UNION ALL SELECT ticker, 'Cash', 'EUR', day, 7.0, 0 FROM f WHERE k % 3 = 0
    UNION ALL SELECT ticker, 'Shares', 'shares', day, k * 1000, 0 FROM f""")
check("ownership_document_rows", """SELECT l_orderkey AS accession, CASE l_returnflag WHEN 'R' THEN 'P' WHEN 'A' THEN 'S' END AS code,
      l_quantity AS shares, CASE WHEN l_linenumber <> 5 THEN l_tax END AS price,
      concat('OWNER N', l_orderkey % 10) AS owner,
      CASE WHEN l_orderkey % 2 = 0 THEN 'Director' ELSE 'Vice President' END AS title, l_quantity * 3 AS held_after
    FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber <> 6""")
check("company_registry", """SELECT concat(c_name, CASE WHEN c_custkey % 50 = 0 THEN ' {x} }' ELSE '' END) AS title,
    concat('C', c_custkey) AS ticker, c_custkey AS cik, c_custkey AS pos FROM customer""")
check("news_feed_order", """SELECT concat('T', doc_id % 7) AS ticker, concat('News number ', doc_id % 31) AS title,
    DATE '2024-01-20' AS published, concat('l', doc_id) AS link FROM documents WHERE doc_id % 11 <> 0
    QUALIFY row_number() OVER (PARTITION BY doc_id % 7, doc_id % 31 ORDER BY doc_id DESC) = 1""")
check("log_by_month", """SELECT drug_id, snapshot_date, CASE WHEN drug_id % 2 = 0 AND snapshot_date =
      (SELECT max(snapshot_date) FROM verdict_log) THEN 'AGAIN' ELSE verdict END AS verdict, conviction
    FROM verdict_log""")
check("log_seed_counts", """SELECT 'verdict_log' AS log, count(*) AS read,
      count(*) FILTER (snapshot_date > DATE '2024-01-15') AS added, count(*) AS total FROM verdict_log""")
check("log_compacted", """
    SELECT * EXCLUDE (s) FROM (SELECT *, concat_ws('|', verdict, setup, conviction // 10, evidence,
      catalyst_date) AS s FROM verdict_log)
    QUALIFY s IS DISTINCT FROM lag(s) OVER (PARTITION BY drug_id ORDER BY snapshot_date)""")
check("sentiment_log_compacted", """
    SELECT * EXCLUDE (s) REPLACE (round(sentiment, 8) AS sentiment) FROM (SELECT *, concat_ws('|',
      printf('%.2f', round_even(sentiment, 2)), scored_articles, eightk_90d, thin) AS s FROM sentiment)
    QUALIFY s IS DISTINCT FROM lag(s) OVER (PARTITION BY ticker ORDER BY snapshot_date)""")
check("log_evidence_repaired", """
    SELECT drug_id, snapshot_date, setup, CASE WHEN coalesce(evidence, '') = '' THEN CASE setup
      WHEN 'DILUTION_SHORT' THEN 'supported' WHEN 'RUNUP_FADE' THEN 'not supported'
      WHEN 'NO_EDGE' THEN 'n/a' END ELSE evidence END AS evidence FROM verdict_log""")

# --- current tables -----------------------------------------------------------------------------------

check("freshest_tags", f"""SELECT ticker, kind, tag, count(*) AS n, max(end_date) AS newest FROM {OF_TAG}
    GROUP BY ALL""")
CURRENT_FACTS = f""", f AS {FRESH}, b AS (SELECT ticker, sum(val) / count(*) AS v FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY end_date DESC, pos, val DESC) AS k
      FROM {OF_TAG} WHERE kind = 'burn' AND end_date - start_date BETWEEN 60 AND 100)
      WHERE k <= 4 GROUP BY ticker),
    w AS (SELECT t.ticker, coalesce(c.val, 0) + coalesce(i.val, 0) AS total, c.end_date AS cash_asof,
      CASE WHEN b.v < 0 THEN -b.v WHEN b.v IS NOT NULL THEN 0.0E0 END AS burn, s.val AS shares
      FROM (SELECT DISTINCT ticker FROM f) t
      LEFT JOIN f c ON c.ticker = t.ticker AND c.kind = 'cash'
      LEFT JOIN f i ON i.ticker = t.ticker AND i.kind = 'investments'
      LEFT JOIN f s ON s.ticker = t.ticker AND s.kind = 'shares' LEFT JOIN b ON b.ticker = t.ticker)
    SELECT ticker, round(nullif(total, 0), 8) AS cash_usd, cash_asof,
      round(burn, 8) AS quarterly_burn_usd,
      CASE WHEN burn > 0 AND total <> 0 THEN round_even(total / (burn / 3.0E0), 1) END AS runway_months,
      nullif(shares, 0) AS shares_outstanding FROM w"""
check("current_financials", CURRENT_FACTS)
check("financials_on_a_date", CURRENT_FACTS.replace(
    "FROM xbrl_fact", f"FROM (SELECT * FROM xbrl_fact WHERE filed <= {Z})"))
FORM4 = f"""filed AS (SELECT ticker, filed, accession FROM filing_index
      WHERE filed BETWEEN {DAY} - 90 AND {DAY}),
    tx AS (SELECT l_orderkey AS accession, CASE l_returnflag WHEN 'R' THEN 'P' ELSE 'S' END AS code,
      l_quantity AS shares, CASE WHEN l_linenumber <> 5 THEN l_tax + 1.0E0 END AS price,
      CASE WHEN l_linenumber <> 6 THEN concat('Owner ', l_partkey % 5) ELSE '' END AS owner,
      l_linenumber <= 2 AS senior, l_quantity * l_linenumber * 0.75E0 AS held,
      CAST(l_partkey * 100 + l_quantity AS BIGINT) AS tx_pos FROM lineitem),
    t AS (SELECT *, CASE code WHEN 'P' THEN held - shares ELSE held + shares END AS before FROM tx),
    tt AS (SELECT *, CASE WHEN shares <> 0 AND before > 0 THEN CASE code WHEN 'P' THEN shares / before
      ELSE -(shares / before) END END AS delta FROM t)"""
check("newest_ownership_filings", f""", {FORM4} SELECT ticker, accession FROM filed
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, accession) <= 3""")
check("ownership_changes", f", {FORM4} SELECT accession, tx_pos, code, round(delta, 8) AS delta_own FROM tt")
check("insider_table", f""", {FORM4}, j AS (SELECT f.ticker, f.filed, tt.*, coalesce(shares * price, 0) AS usd,
      coalesce(nullif(owner, ''), CAST(f.accession AS VARCHAR)) AS who FROM filed f JOIN tt USING (accession)),
    big AS (SELECT * FROM j WHERE coalesce(delta, 0) <> 0 QUALIFY row_number() OVER (PARTITION BY ticker
      ORDER BY abs(delta) DESC, filed DESC, accession, tx_pos) = 1),
    g AS (SELECT ticker, sum(shares) FILTER (code = 'P') AS pb, sum(shares) FILTER (code = 'S') AS sb,
      coalesce(sum(usd) FILTER (code = 'P'), 0) AS b, coalesce(sum(usd) FILTER (code = 'S'), 0) AS s,
      coalesce(sum(usd) FILTER (code = 'P' AND senior), 0) - coalesce(sum(usd) FILTER (code = 'S' AND senior), 0) AS sen,
      CAST(count(DISTINCT who) FILTER (code = 'P') AS INT) AS nb,
      CAST(count(DISTINCT who) FILTER (code = 'S') AS INT) AS ns FROM j GROUP BY ticker)
    SELECT a.ticker, 90 AS window_days, coalesce(n.n, 0) AS form4_filings, coalesce(pb, 0) AS shares_bought,
      coalesce(sb, 0) AS shares_sold, round(coalesce(b, 0), 4) AS buy_usd,
      round(coalesce(s, 0), 4) AS sell_usd, round(coalesce(b - s, 0), 4) AS net_usd,
      CASE WHEN b + s <> 0 THEN round_even((b - s) / (b + s), 3) ELSE 0 END AS insider_tilt,
      round(coalesce(sen, 0), 4) AS senior_net_usd, coalesce(nb, 0) AS n_buyers,
      coalesce(ns, 0) AS n_sellers, coalesce(nb, 0) >= 3 AS cluster_buy,
      round_even(big.delta, 4) AS biggest_delta_own,
      CASE WHEN big.ticker IS NOT NULL THEN concat(CASE WHEN big.owner = '' THEN 'insider' ELSE big.owner END, ' (',
        CASE WHEN big.senior THEN 'CEO' ELSE 'director' END, ') ',
        CASE WHEN big.delta > 0 THEN '+' ELSE '' END, printf('%.0f%% of holding', big.delta * 100)) END
        AS biggest_move_desc
    FROM (SELECT concat(unnest(['T', 'Q']), s_suppkey) AS ticker FROM supplier) a
    LEFT JOIN (SELECT ticker, CAST(count(*) AS INT) AS n FROM filed GROUP BY ticker) n USING (ticker)
    LEFT JOIN g USING (ticker) LEFT JOIN big USING (ticker)""")
check("latest_short_interest", f"""SELECT * FROM si_pub WHERE published_date <= {DAY}
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY settlement_date DESC) = 1""", "si_pub")
check("financing_table", f""", ask_now AS (SELECT DISTINCT ticker, {DAY} AS asof FROM filing_index),
    post AS (SELECT a.ticker, a.asof, max(filed) FILTER (form = 'S-3') AS last_shelf_date,
      CAST(count(*) FILTER (form = 'S-3') AS INT) AS shelf_count,
      max(filed) FILTER (form = '424B5') AS last_offering_date,
      CAST(count(*) FILTER (form = '424B5' AND a.asof - filed <= 730) AS INT) AS offerings_24m,
      CAST(count(*) FILTER (form = '424B5') AS INT) AS offerings_total,
      coalesce(a.asof - max(filed) FILTER (form = 'S-3') <= 1095, false) AS shelf_live,
      CAST(a.asof - max(filed) FILTER (form = '424B5') AS INT) AS days_since_offering
      FROM ask_now a LEFT JOIN filing_index f ON f.ticker = a.ticker AND f.filed <= a.asof
      GROUP BY a.ticker, a.asof)
    SELECT p.* EXCLUDE (asof), {ready('runway_months')[0]} AS dilution_readiness,
      {ready('runway_months')[1]} AS dilution_label, {ready('runway_months')[2]} AS dilution_notes
    FROM post p LEFT JOIN financials USING (ticker)""")
check("newest_guidance", """
    SELECT concat('T', o_custkey) AS ticker, CAST(o_orderdate AS DATE) AS filed,
      CAST(o_orderdate AS DATE) AS period_lo, CAST(o_orderdate AS DATE) AS period_hi,
      o_orderpriority AS phrase FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
check("calendar_union_deduplicated", """, a AS (SELECT drug_id, ticker, drug_name, nct_id, indication,
      simplified_stage, CAST(CAST(date_trunc('month', catalyst_date_lo) AS DATE) AS VARCHAR)
        AS catalyst_date_raw FROM catalysts),
    u AS (SELECT * FROM a UNION ALL BY NAME SELECT drug_id + 100000000 AS drug_id, ticker,
      catalyst_date_raw, simplified_stage, '(see 8-K)' AS drug_name FROM a WHERE simplified_stage = 'pdufa'),
    r AS (SELECT *, CAST(indication IS NOT NULL AS INT) * 2 + CAST(drug_name <> '(see 8-K)' AS INT) AS k
      FROM u),
    one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker, catalyst_date_raw, nct_id
      ORDER BY k DESC, drug_id) = 1)
    SELECT drug_id, ticker, catalyst_date_raw, simplified_stage FROM one WHERE simplified_stage <> 'pdufa'
    UNION ALL SELECT drug_id, ticker, catalyst_date_raw, simplified_stage FROM (SELECT * FROM one
      WHERE simplified_stage = 'pdufa' QUALIFY row_number() OVER (PARTITION BY ticker, catalyst_date_raw
      ORDER BY k DESC, drug_id) = 1)""")

# --- studies ------------------------------------------------------------------------------------------

ABN = ", ".join(f"round(abn_{h}d, 8) AS abn_{h}d" for h in (21, 63, 126))
H = (21, 63, 126)
EVENTS = {
    "runway": (("sf", "runway_ev"), "entry_date, round(runway_months, 8) AS runway_months, "
               "runway_bucket, size_bucket, distressed_micro",
               {"by_runway": "runway_bucket", "by_size": "size_bucket",
                "by_setup": "distressed_micro"}),
    "cadence": (("cad_ask_ret", "cadence_ev"), "burst_bucket, count_bucket, interaction",
                {"by_burst": "burst_bucket", "by_count": "count_bucket",
                 "by_interaction": "interaction"}),
    "squeeze": (("si_pub", "sia_ask_ret", "squeeze_ev"), "dtc_bucket, interaction",
                {"by_dtc": "dtc_bucket", "by_interaction": "interaction"}),
    "financing": (("post_ask_ret", "financing_ev"),
                  "dilution_label, dilution_notes, recent_deal, interaction",
                  {"by_readiness": "dilution_label", "by_recent_deal": "recent_deal",
                   "by_interaction": "interaction"}),
    "insider": (("inw_ask_ret", "insider_ev"), "net_bucket, cluster, interaction",
                {"by_net": "net_bucket", "by_cluster": "cluster", "by_interaction": "interaction"}),
}
for study, (parts, columns, cuts) in EVENTS.items():
    check(f"{study}_study_events",
          f"SELECT ticker, event_date, {columns}, {ABN} FROM {study}_ev", *RET, *PIT_RET, *parts)
    check(f"{study}_study", summary_sql(f"{study}_ev", study, cuts, H), *RET, *PIT_RET, *parts)
READ = ("readouts", "usable", "cal", "panel", "readout_ev")
BINS = {"prior_bucket": cut("loa", fv.PRIOR_CUTS), "enroll_bucket": cut("enrollment", fv.ENROLLMENT_CUTS),
        "runup_bucket": cut("ret_20d", fv.RUNUP_CUTS)}
check("readout_study_events", "SELECT nct_id, ticker, entry_date, round(loa, 8) AS loa, design_bucket, "
      + ", ".join(f"{v} AS {k}" for k, v in BINS.items()) + ", "
      + ", ".join(f"round(abn_{h}d, 8) AS abn_{h}d" for h in (1, 5, 21, 63)) + " FROM readout_ev", *READ)
check("readout_study", summary_sql(
    "readout_ev", "readout",
    {"by_stage": "simplified_stage", "by_prior": BINS["prior_bucket"], "by_runup": BINS["runup_bucket"],
     "by_design": "design_bucket", "by_enrollment": BINS["enroll_bucket"], "overall": None},
    (1, 5, 21, 63), {"by_prior": [x[2] for x in fv.PRIOR_CUTS], "by_runup": [x[2] for x in fv.RUNUP_CUTS],
                     "by_enrollment": [x[2] for x in fv.ENROLLMENT_CUTS]}), *READ)
check("grouped_medians", """SELECT l_returnflag, round(median(l_extendedprice / 1e5), 8) AS price,
    round(median(l_discount), 8) AS rate FROM lineitem GROUP BY l_returnflag""")

# --- filings read for dates, stored versions, logs and extracts -----------------------------------------

_FILED = """, o AS (SELECT concat('T', o_custkey % (SELECT count(*) FROM supplier)) AS ticker, o_custkey AS c,
      o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS filed, year(o_orderdate) + 1 AS y FROM orders
    WHERE o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0)"""
check("guidance_table", f"""{_FILED}, k AS (SELECT *, CASE c % 4 WHEN 0 THEN 1 WHEN 1 THEN 7
      WHEN 2 THEN 7 ELSE 10 END AS m, CASE c % 4 WHEN 1 THEN 6 ELSE 3 END AS span,
      CASE c % 4 WHEN 0 THEN 'first quarter' WHEN 1 THEN 'second half' WHEN 2 THEN 'third quarter'
        ELSE 'fourth quarter' END AS words
    FROM o WHERE doc_id % 4 = 0 AND filed BETWEEN {DAY} - 270 AND {DAY}
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, doc_id DESC) = 1)
    SELECT ticker, filed, make_date(y, m, 1) AS period_lo,
      CAST(make_date(y, m, 1) + to_months(span) - INTERVAL 1 DAY AS DATE) AS period_hi,
      concat('data expected in the ', words, ' of ', y) AS phrase FROM k""")
check("decision_dates", f"""{_FILED}, k AS (SELECT *, make_date(y, 3, 1 + c % 28) AS day FROM o
    WHERE doc_id % 4 = 1 AND filed BETWEEN {DAY} - 360 AND {DAY})
    SELECT ticker, day AS catalyst_date_lo, CAST(day AS VARCHAR) AS catalyst_date_raw, filed, doc_id FROM k
    QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY filed, doc_id) = 1""")
_STATED = f"""o AS (SELECT concat('T', o_custkey % (SELECT count(*) FROM supplier)) AS ticker,
      o_custkey AS k, o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS filed, year(o_orderdate) AS y FROM orders),
    m AS (SELECT ticker, filed, doc_id, make_date(y + 1, 3, 1 + k % 28) AS catalyst_date_lo,
        concat('Zelo', k % 50) AS drug_name,
        ['plaque psoriasis', 'heart failure', 'celiac disease'][1 + k % 3] AS indication FROM o WHERE k % 4 <> 0
      UNION ALL SELECT ticker, filed, doc_id, make_date(y + 2, 6, 1 + k % 29), concat('Bervo', k % 40),
        CASE k % 2 WHEN 0 THEN 'severe asthma' ELSE 'sickle cell disease' END FROM o),
    dd AS (SELECT * FROM m WHERE filed BETWEEN {DAY} - 360 AND {DAY}
    QUALIFY row_number() OVER (PARTITION BY ticker, catalyst_date_lo ORDER BY filed, doc_id) = 1)"""
check("filed_decisions", f""", {_STATED}
    SELECT ticker, catalyst_date_lo, filed, doc_id, drug_name, indication FROM dd""")
check("whole_calendar", f""", {_TRIALS}, {_STATED}, rr AS ({_READOUTS})
    SELECT ticker, nct_id, concat(primary_completion, ' + window') AS catalyst_date_raw, lo AS catalyst_date_lo,
      CAST(lo + 180 AS DATE) AS catalyst_date_hi, 'readout_window' AS date_precision,
      ['phase2', 'phase2/3'][k % 3] AS simplified_stage,
      drug_name, indication
    FROM (SELECT *, CASE WHEN k % 4 = 0 THEN DATE '2000-07-15' ELSE DATE '2000-09-01' END AS lo FROM rr)
    WHERE ticker IS NOT NULL
    UNION ALL SELECT ticker, NULL, CAST(catalyst_date_lo AS VARCHAR), catalyst_date_lo, catalyst_date_lo, 'day', 'pdufa',
      drug_name, indication FROM dd WHERE catalyst_date_lo >= {DAY} - 45""")

check("stored_versions", """
    SELECT ticker, cash_usd, cash_asof FROM financials WHERE cash_asof > DATE '2000-04-05'""")
check("log_round_trip", """SELECT drug_id, snapshot_date, verdict, setup, conviction,
    nullif(evidence, '') AS evidence, catalyst_date FROM verdict_log""")
check("study_events_csv", """
    SELECT ticker, count(*) AS n, min(event_date) AS first_event FROM cadence_ev GROUP BY ticker""",
      *RET, *PIT_RET, *EVENTS["cadence"][0])

# A fragment that starts with a comma continues the view list; without one it opens the list.
for _name, _sql in ORACLE.items():
    if _sql.lstrip().startswith(","):
        ORACLE[_name] = "WITH " + _sql.lstrip()[1:]
# `asof` is a keyword of the checking engine.
for _name, _sql in ORACLE.items():
    ORACLE[_name] = on_grid(re.sub(r'(?<![\w"])asof(?![\w"])', '"asof"', _sql))
_ = (A, Z, LOW, ntrim)
