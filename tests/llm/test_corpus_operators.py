"""Search, mixing, Jaccard join, repeats, components, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import jaccard_join, mixture, repeats, search
from eventide.llm.components import components

SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def groups(nodes, links):
    up = {x: x for x in nodes}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert out == groups(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Search

def test_search_brute_force(frame):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[:rng.randint(1, 60)]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += texts[:12] + [None, ""]
    docs = frame(list(enumerate(texts)))
    got = defaultdict(list)
    for r in search.top(docs, F.col("doc_id") % 10 == 0, k=5, shard=40).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    tok = [ALNUM.findall((t or "").lower()) for t in texts]
    n, mean = len(tok), sum(map(len, tok)) / len(tok)
    df = Counter(w for t in tok for w in set(t))
    for q in range(0, n, 10):
        scores = []
        for d, t in enumerate(tok):
            tf, common = Counter(t), set(tok[q]) & set(t)
            if common:
                scores.append((-round(sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf[w] * 2.2
                                          / (tf[w] + 1.2 * (.25 + .75 * len(t) / mean)) for w in common), 6), d))
        want = [(k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:5], 1)]
        have = sorted(got[q])
        assert [x[:2] for x in have] == [x[:2] for x in want]
        assert [x[2] for x in have] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_search_finds_a_word_of_all_documents(frame):
    """Scores near 0 are results like others: with 3,000 documents that all have it, a word weighs little."""
    docs = frame([(i, "common" if i % 3 else "common other") for i in range(3000)])
    out = search.top(docs, F.col("doc_id") == 1, k=10, shard=700).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in out) == list(enumerate(
        [i for i in range(16) if i % 3][:10], 1))
    assert all(0 <= r["score"] < 1e-3 for r in out)


def test_search_great_scores(frame):
    """Whole texts of many rare words: sums of thousands in single precision."""
    rng = random.Random(7)
    words = [f"x{k}" for k in range(4000)]
    base = " ".join(words)
    texts = [base] + [" ".join(rng.sample(words, 3900)) for _ in range(40)] + ["y"] * 400
    texts += [texts[5]] * 3
    docs = frame(list(enumerate(texts)))
    got = sorted((r["rank"], r["doc_id"]) for r in
                 search.top(docs, F.col("doc_id") == 0, k=8, shard=200).collect())
    tok = [t.split() for t in texts]
    n, mean = len(tok), sum(map(len, tok)) / len(tok)
    df = Counter(w for t in tok for w in set(t))
    scores = [(-round(sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * 2.2
                          / (1 + 1.2 * (.25 + .75 * len(t) / mean)) for w in t if w != "y"), 6), d)
              for d, t in enumerate(tok)]
    assert [d for _, d in got] == [d for _, d in sorted(scores)[:8]]


def test_search_sends_queries_once_per_task(frame, spark, monkeypatch):
    """Twice as many shards take no more copies of the queries, and find the same."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(12)) for _ in range(200)]
    sent, found, send = [], [], search.map_batches

    def map_batches(df, fn, schema):
        if "places" in df.columns:
            sent.append(df.where("places is not null").count())
        return send(df, fn, schema)
    monkeypatch.setattr(search, "map_batches", map_batches)
    for shard in (10, 5):
        out = search.top(frame(list(enumerate(texts))), F.col("doc_id") % 10 == 0, k=4, shard=shard)
        found.append(sorted(tuple(r) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == 80
    assert sent[0] == sent[1] <= spark.sparkContext.defaultParallelism


def test_search_keeps_the_alike_together(frame, monkeypatch):
    """Blocks of queries and shards hold one language each, but for a block on the border and the first shard."""
    rng = random.Random(5)
    texts = [" ".join([x] * 5 + rng.choices([f"{x}{k}" for k in range(30)], k=20)) for _ in range(120) for x in "ab"]
    docs, is_query, dealt, send = frame(list(enumerate(texts))), F.col("doc_id") % 10 < 4, [], search.map_batches

    def map_batches(df, fn, schema):
        if "places" in df.columns:
            dealt.extend(df.collect())
        return send(df, fn, schema)
    monkeypatch.setattr(search, "map_batches", map_batches)
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    out = search.top(docs, is_query, k=3, shard=12).collect()
    assert sorted(r["query_id"] for r in out if r["rank"] == 1) == [i for i in range(240) if i % 10 < 4]
    assert all(r["query_id"] == r["doc_id"] for r in out if r["rank"] == 1)
    terms = [set(), set()]
    for r in search.vectors(docs, is_query, "doc_id", "text").collect():
        terms[r["id"] % 2].update(np.frombuffer(r["terms"], np.uint64).tolist())
    blocks, shards = defaultdict(set), defaultdict(set)
    for r in dealt:
        if r["places"] is not None:
            asked = set(np.frombuffer(r["terms"], np.uint64).tolist())
            blocks[r["block"]].update(x for x in (0, 1) if asked & terms[x])
        elif r["shard"] > 0:
            shards[r["shard"]].add(r["id"] % 2)
    assert len(blocks) >= 12 and sum(len(x) > 1 for x in blocks.values()) <= 1
    assert shards and all(len(x) == 1 for x in shards.values())


def test_search_first_word(frame):
    """The most frequent word, of equals always the same one, none for texts without words."""
    texts = ["b a b", "a b", "b a", "", None, "B c"]
    rows = search.vectors(frame(list(enumerate(texts))), F.lit(True), "doc_id", "text")
    a, b, c = (r["word"] for r in search.vectors(frame([(k, x) for k, x in enumerate("abc")]), F.lit(True), "doc_id",
                                                 "text").sort("id").collect())
    got = [r["word"] for r in rows.sort("id").collect()]
    assert got[0] == b and got[1] == got[2] in (a, b) and got[3:5] == [None, None] and got[5] in (b, c)


def test_search_skips_blocks_and_keeps_the_bound():
    """Shards of common terms alone, in blocks that cannot reach the bound, against plain sums."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(900):
        terms = np.unique(rng.integers(1, 40 if i // 64 % 2 else 400, 30)).astype(np.uint64)
        docs.append((terms, rng.integers(1, 5, len(terms)).astype(np.int32)))
    weights = rng.random(400) + 0.01
    asked = [np.sort(rng.permutation(400)[:n]).astype(np.int32) for n in (1, 5, 60, 300)]
    terms = np.arange(400, dtype=np.uint64)
    ids, scores = np.zeros((4, 7), np.int64), np.full((4, 7), -1.0)
    sizes = np.array([len(x) for x in asked], np.int32)
    want = [[] for _ in asked]
    for lo in (0, 300):
        part = docs[lo:lo + (300 if lo == 0 else 600)]
        n = np.array([c.sum() for _, c in part])
        place = search.Shard(np.arange(lo, lo + len(part)), n, [t for t, _ in part], [c for _, c in part], 60.0)
        place.search((sizes, np.concatenate(asked), terms, weights), ids, scores)
        for q, own in enumerate(asked):
            for d, (t, c) in enumerate(part):
                hit = np.isin(t, terms[own])
                if hit.any():
                    norm = search.K1 * (1 - search.B + search.B * n[d] / 60.0)
                    tf = c[hit].astype(float)
                    score = (tf * 2.2 / (tf + norm) * weights[t[hit].astype(int)]).sum()
                    want[q].append((-round(float(score), 6), lo + d))
    for q in range(4):
        best = sorted(want[q])[:7]
        assert ids[q].tolist() == [d for _, d in best]
        assert scores[q].tolist() == pytest.approx([-s for s, _ in best], abs=2e-6)


def test_search_odd(odd, nothing):
    out = search.top(odd, F.lit(True), k=3).collect()
    assert {r["query_id"] for r in out} == {4, 5, None, 7, 8, 9, 10}
    assert search.top(nothing, F.lit(True)).count() == 0
    assert search.top(odd, F.lit(None).cast("boolean")).count() == 0


# Mixing

def waterfill(sizes, weights, total):
    target, open_ = {}, set(sizes)
    while True:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over


@pytest.mark.parametrize("group_rows", [10_000, 7])
def test_mix_reaches_targets(frame, group_rows):
    rng = random.Random(3)
    names = ["b", "a", None, "B", "é", "c"]
    docs = [(i, " ".join(["w"] * rng.randint(0, 30)) + " \t", None, names[min(5, int(rng.expovariate(.7)))])
            for i in range(300)]
    df = frame(docs)
    out = mixture.schedule(df, group_rows=group_rows).collect()
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += len(SOLID.findall(t))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = waterfill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()))
    taken, of_doc = Counter(), Counter()
    for r in out:
        taken[r["__source"]] += r["taken"]
        of_doc[r["__id"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["__source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert all(of_doc[i] <= 3 * len(SOLID.findall(t)) for i, t, *_ in docs)
    at = 0
    for r in sorted(out, key=lambda r: (r["offset"], r["taken"])):
        assert r["offset"] == at
        at += r["taken"]
    finish = [r["finish"] for r in sorted(out, key=lambda r: (r["offset"], r["taken"])) if r["taken"]]
    assert finish == sorted(finish)
    again = mixture.schedule(df.repartition(5), group_rows=group_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    rows = mixture.mixed(df).collect()
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(SOLID.findall(r["text"]))
    assert words == Counter({k: v for k, v in of_doc.items() if v}) and set(rows[0].asDict()) == set(df.columns)


def test_mix_budget_cuts(frame):
    df = frame([(i, "a b c", None, "xy"[i % 2]) for i in range(20)])
    out = mixture.schedule(df, budget_share=.5).collect()
    assert sum(r["taken"] for r in out) == 30


def test_mix_odd(odd, nothing):
    out = {r["doc_id"]: r for r in mixture.taken_words(odd).collect()}
    assert len(out) == 10 and out[5]["size"] == 4 and out[1]["size"] == out[1]["taken"] == 0
    assert mixture.taken_words(nothing).count() == mixture.mixed(nothing).count() == 0
    assert set(mixture.mixed(odd).columns) == set(odd.columns)
    assert mixture.taken_words(odd.where("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0


# Jaccard join

def shingles(text):
    w = SOLID.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, groups(sets, links)


def near_copies():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    docs = []
    passage = [word() for _ in range(25)]
    for _ in range(14):
        base = [word() for _ in range(rng.choice([3, 5, 30, 80]))]
        if rng.random() < .5:
            base[1:1] = passage
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy).upper() if rng.random() < .2 else "  ".join(copy))
    docs += docs[:5] + ["", None, "one", "ONE", "one two"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("fragment,small", [(1_000_000, 48), (700, 3)])
def test_jaccard_brute_force(frame, monkeypatch, fragment, small):
    monkeypatch.setattr(jaccard_join, "FRAGMENT", fragment)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    if small < 48:
        monkeypatch.setattr(jaccard_join, "ASKING", 2)
        monkeypatch.setattr(jaccard_join, "ASKED", 3)
        monkeypatch.setattr(jaccard_join, "COLUMNS", 5)
    docs = near_copies()
    sets, want = brute_classes(docs)
    out = jaccard_join.classes(frame(docs)).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = jaccard_join.one_of_each(frame(docs))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values()) and kept.columns == frame(docs).columns


def test_jaccard_odd(odd, nothing):
    out = [(r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard_join.classes(odd).collect()]
    assert len(out) == 11
    assert {c for i, c, _ in out if i in (4, 5, None)} == {4} and {c for i, c, _ in out if i in (7, 8)} == {7}
    assert [(c, n) for i, c, n in sorted(out, key=str) if i in (1, 2, 3)] == [(1, 0), (2, 0), (3, 0)]
    assert jaccard_join.classes(nothing).count() == jaccard_join.one_of_each(nothing).count() == 0


def test_jaccard_bytes_do_not_grow_with_fragments(frame):
    rng = random.Random(5)
    df = frame([(i, " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(204)), None, None) for i in range(300)])
    number = jaccard_join.ClassNumbers(31, np.zeros(0, np.int64))
    for fragments in (1, 4000):
        parts = jaccard_join.postings(df.repartition(1), "text", 5, fragments, number)
        sent = sum(sum(len(v) for v in r[1:]) for r in parts.collect())
        assert sent < 12.5 * 300 * 200  # eight bytes of hash and eight of label, and size and count, once


def test_jaccard_class_numbers(frame, monkeypatch):
    label = np.array([1 << 60, (1 << 60) + 1, 5 << 60, -1, -2, -1 << 63], np.int64)
    number = jaccard_join.ClassNumbers(4, label[[4, 0, 3, 1]])
    assert number(label).tolist() == [18, 19, 5, 17, 16, 8] and number.width == 1
    assert jaccard_join.ClassNumbers(23, label[:0])(label).tolist() == [
        int(x) >> 41 for x in label.view(np.uint64)]
    assert [jaccard_join.number_bits(n) for n in (0, 10 ** 6, 2 ** 24 - 1, 2 ** 24, 10 ** 9)] == [23, 23, 31, 39, 47]
    # Few numbers: most classes share theirs and are listed.
    monkeypatch.setattr(jaccard_join, "number_bits", lambda count: 3)
    monkeypatch.setattr(jaccard_join, "FRAGMENT", 700)
    docs = near_copies()
    _, want = brute_classes(docs)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(frame(docs)).collect()} == want


@pytest.mark.parametrize("fragments", [1, 7, 70_000])
def test_jaccard_slots(fragments):
    rng = np.random.default_rng(6)
    h = np.sort(np.append(rng.integers(0, 1 << 64, 3000, np.uint64), np.full(300, (1 << 64) - 1, np.uint64)))
    bounds = jaccard_join.slot_bounds(fragments)
    assert bounds[0] == 0 and bounds[-1] == 1 << 16 and (np.diff(bounds) >= 0).all()
    counts = np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    edge = np.concatenate([[0], np.cumsum(counts)])[bounds]
    cut = [jaccard_join.cut_at(a, e).to_pylist() for a, e in (
        (jaccard_join.small_counts(counts), bounds), (jaccard_join.low_bytes(h, 6), edge))]
    back = [jaccard_join.from_slots(c, x, bounds[f], bounds[f + 1]) for f, (c, x) in enumerate(zip(*cut, strict=True))]
    assert np.concatenate(back).tolist() == h.tolist()


def test_jaccard_hash_in_very_many_classes(frame):
    """More classes with one shingle than a byte of its frequency or of a slot holds."""
    common = " ".join(f"c{k}" for k in range(6))
    docs = [(i, f"{common} x{i} y{i} z{i}") for i in range(600)] + [(600, f"{common} x7 y7 z7 q")]
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(frame(docs)).collect()}
    assert out == {i: i for i in range(600)} | {600: 7}


# Repeats

def brute_repeats(docs, size=200):
    seen = Counter(t.encode()[k:k + size] for _, t in docs for k in range(len(t.encode()) - size + 1))
    out = {}
    for i, t in docs:
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if seen[b[k:k + size]] > 1:
                gone[k:k + size] = [True] * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repetitive(seed):
    rng = random.Random(seed)
    def prose(n):
        return "".join(rng.choice("abcdefghij é,") for _ in range(n))
    shared = [prose(rng.randint(190, 420)) for _ in range(5)]
    docs = [prose(rng.randint(0, 150)) + rng.choice(shared) + prose(rng.randint(0, 150)) for _ in range(30)]
    docs += [docs[0], docs[1][40:] + "!", "ab" * 300, "xyz" * 66, "", prose(100), "q" * 199, "q" * 200,
             docs[3][:260] + "#" + docs[3][260:], shared[0] + shared[1], shared[1] + shared[0]]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,hot,bucket", [(1, 4000, 2 << 20), (2, 2, 2 << 20), (3, 4000, 3000)])
def test_repeats_brute_force(frame, monkeypatch, seed, hot, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    docs = repetitive(seed)
    want = brute_repeats(docs)
    for r in repeats.removed(frame(docs), hot=hot).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_run_index_matches():
    import numpy as np
    rng = random.Random(9)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        code = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64) + 1
        index = repeats.RunIndex(code, cuts)
        assert index.run_length.sum() == len(code)
        ends = [t[k:] for t in texts for k in range(len(t))]
        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n
        want = [max((common(a, b) for j, b in enumerate(ends) if j != i), default=0) for i, a in enumerate(ends)]
        assert index.matches().tolist() == want


def test_repeats_odd(odd, nothing):
    out = repeats.removed(odd, keep=False).collect()
    assert len(out) == 11
    assert {r["doc_id"] for r in out if r["n_removed"]} == {7, 8}
    assert all(r["n_removed"] == r["n_bytes"] for r in out if r["doc_id"] in (7, 8))
    assert repeats.removed(nothing).count() == 0


# Pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from eventide.llm import decontaminate
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    base = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept, names = docs, docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, d)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert kept.columns == names
            seen.append({r["doc_id"]: r["text"] for r in kept.collect()})
    letters = {i for i, t in base.items() if any(c.isalpha() for c in t or "")}
    assert set(seen[0]) == letters
    _, want = brute_classes([(i, base[i]) for i in letters])
    assert set(seen[1]) == set(want.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    from test_text_operators import brute_hits
    assert set(seen[2]) == {i for i in seen[1] if not brute_hits(base[i], items)[1]}
    assert set(seen[3]) <= set(seen[2]) and all(base[i].startswith(t) for i, t in seen[3].items())
    assert decontaminate.WINDOW == 10
    whole = corpus_pipeline.run(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted(
        map(tuple, kept.select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert kept.count() == spark.read.parquet(str(tmp_path / "3")).count()


def test_repeats_of_a_null_id(frame):
    rng = random.Random(11)
    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = noise(260)
    out = {r["doc_id"]: r["n_removed"] for r in repeats.removed(frame(
        [(None, noise(300) + shared + noise(300)), (5, noise(250) + shared + noise(350)), (6, noise(500))])).collect()}
    assert out[6] == 0 and out[None] >= 260 and out[5] >= 260
