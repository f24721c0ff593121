"""Fill-in-middle, nearest neighbours, centroid clustering."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import centroids, infill, neighbours

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut_by_definition(doc_id, text):
    text = text or ""
    w = TOKEN.findall(text)
    assert "".join(w) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(w), "plain", None, None, text
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_cuts(df):
    got = infill.transformed(df)
    back = infill.restored(got).collect()
    for r in back:
        want = cut_by_definition(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
    ids = lambda rows: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows)
    assert ids(back) == ids(df.collect())
    return back


def test_infill_brute_force(frame):
    rng = random.Random(3)
    marks = ["a", "b<", "<P", ">", "é ", "漢字", " ", "\n", "\t\r", "\x0b", "\0", "😀x", "S>", "<", "\u0085"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(700, "x <M> y"), (701, "<P>"), (702, " "), (703, "<M"), (-5, "a b c d"), (704, "x" * 3)]
    forms = {r["form"] for r in check_cuts(frame(rows))}
    assert forms == {"plain", "spm", "psm"}


def test_infill_odd_and_long(odd, nothing, frame, spark):
    back = check_cuts(odd)
    assert len(back) == odd.count() and "label" in back[0].asDict() and back[0]["n"] is not None
    assert infill.restored(infill.transformed(nothing)).count() == 0
    long = ("wörd " * 200_000 + "end\n") * 2
    check_cuts(frame([(i, long) for i in range(8)]))
    named = spark.createDataFrame([(4, "a b c", 1, 2)], "doc_id long, text string, output int, `x.y` int")
    row = infill.restored(infill.transformed(named)).first()
    assert row["text"] == "a b c" and row["x.y"] == 2 and isinstance(row["output"], str)


@pytest.mark.parametrize("size", [0, 1, 2, 7, 8, 9, 1000])
def test_rotation_in_place(size, monkeypatch):
    monkeypatch.setattr(infill, "STRIDE", 4)
    data = bytes(random.Random(size).randrange(256) for _ in range(size))
    for cut in {0, 1, size // 3, size // 2, max(0, size - 1), size} & set(range(size + 1)):
        buffer = bytearray(data)
        infill.rotate(buffer, 0, cut, size)
        assert bytes(buffer) == data[cut:] + data[:cut]
        infill.rotate(buffer, 0, size - cut, size)
        assert bytes(buffer) == data


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = 0.15 * x + rng.normal(size=(clusters, dim))[rng.integers(clusters, size=n)]
    return x.astype(np.float32).astype(float)


def vector_frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(
        [(i, None if v is None else [None if e is None else float(e) for e in v], 1, "x", 2)
         for i, v in rows], f"vec_id long, embedding {kind}, label int, id string, v int")


def neighbours_by_definition(rows, k, is_query):
    """Exact: the best other rows by product in double precision, then id."""
    live = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
            and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    live = list({(i, tuple(v)): (i, v) for i, v in live}.values())
    out = {}
    for i, q in live:
        if is_query(i):
            scores = sorted((-(v * q).sum(), j) for j, v in live if j != i and len(v) == len(q))
            out.setdefault(i, []).append([(j, -s) for s, j in scores[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("clusters, spread", [(0, False), (6, False), (6, True)])
def test_neighbours_recall(spark, clusters, spread):
    x = vectors(1500, 24, 5, clusters)
    if spread:
        x *= np.random.default_rng(1).lognormal(0, 1, size=(len(x), 1)).astype(np.float32)
        x = x.astype(np.float32).astype(float)
    rows = list(enumerate(x))
    got = found(neighbours.top(vector_frame(spark, rows), F.col("id") % 20 == 0, shard=400))
    want = neighbours_by_definition(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i][0]}) / 20 for i in want])
    assert hits >= 0.97
    exact = {(i, j): float((x[i] * x[j]).sum()) for i in got for j, _ in got[i]}
    assert all(s == pytest.approx(exact[i, j], abs=1e-12) for i in got for j, s in got[i])


def test_neighbours_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(2)
    same = [0.5, -1.0, 2.0]
    rows = [(i, rng.normal(size=3).round(1)) for i in range(0, 40)]
    rows += [(100 + i, same) for i in range(60)]  # more copies than results, ties by id
    rows += [(200, same), (200, same), (200, [1.0, 0.0, 0.0]), (None, same), (220, None), (240, []), (260, [0.0, 0.0, 0.0]),
             (280, [1.0, None, 2.0]), (300, [inf, 1.0, 1.0]), (320, [nan, 1.0, 1.0]), (340, [1.0, 2.0]), (341, [2.0, 1.0]),
             (360, [-0.0, 1.0, 0.0]), (361, [0.0, 1.0, 0.0]), (380, [7.0])]
    rows = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    for shard in (10_000, 25):
        got = found(neighbours.top(vector_frame(spark, rows), F.col("id") % 20 == 0, shard=shard)
                    .where("query_id != 200"))
        want = neighbours_by_definition(rows, 20, lambda i: i % 20 == 0)
        assert got == {i: v[0] for i, v in want.items() if i != 200 and v[0]}
    assert 380 not in got and got[340] == [(341, 4.0)]
    both = neighbours.top(vector_frame(spark, rows), F.col("id") == 200).where("vec_id = 200").count()
    assert both == 0
    none = vector_frame(spark, [])
    assert neighbours.top(none, F.col("id") % 20 == 0).count() == 0
    assert neighbours.top(vector_frame(spark, rows), F.col("id") == 7777).count() == 0
    huge = vector_frame(spark, [(i, [1e200 * (i + 1), 1.0]) for i in range(5)], "array<double>")
    assert neighbours.top(huge, F.col("id") == 0).count() == 4


def test_neighbours_agree_between_runs(spark):
    df = vector_frame(spark, list(enumerate(vectors(600, 8, 9))))
    a, b = (found(neighbours.top(d, F.col("id") % 20 == 0, shard=200)) for d in (df, df.repartition(3)))
    assert a == b


def clusters_by_definition(rows, k, rounds, dims):
    live = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v):
            live.append((i, [int(np.floor(float(e) * 64)) for e in v]))
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [x for _, x in sorted(live, key=name)[:k]]

    def assign():
        out = []
        for _, x in live:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        at = [c for c, _ in assign()]
        for j in range(len(cents)):
            own = [x for (_, x), c in zip(live, at, strict=True) if c == j]
            if own:
                cents[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    at = assign()
    per = {j: sum(d for c, d in at if c == j) for j in range(len(cents))}
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((-1 if i is None else i, c, d, per[c], sum(per.values()), mark[c])
                   for (i, _), (c, d) in zip(live, at, strict=True)))


def clusters_found(df, **options):
    rows = centroids.assigned(centroids.clustered(df, **options)).collect()
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"],
                   r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows)


@pytest.mark.parametrize("clusters", [0, 5])
def test_clusters_brute_force(spark, clusters):
    rows = list(enumerate(vectors(400, 12, 4, clusters)))
    rows += [(1000 + i, rows[3][1]) for i in range(150)]
    df = vector_frame(spark, rows)
    for options in ({"k": 16, "rounds": 3, "block": 16}, {"k": 3, "rounds": 1, "block": 7}):
        got = clusters_found(df, dims=12, **options)
        assert got == clusters_by_definition(rows, options["k"], options["rounds"], 12)


def test_clusters_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, -1.0]), (2, [1.0, 5.0]), (None, [3.0, 3.0]), (None, [3.0, 3.0]),
            (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [nan, 1.0]), (9, [-0.0, -1e-9]),
            (10, [1e5, -1e5]), (11, [1.0, 2.0, 3.0])]
    got = clusters_found(vector_frame(spark, rows, "array<double>"), dims=2, k=4)
    assert got == clusters_by_definition(rows, 4, 3, 2)
    few = rows[:2]
    assert clusters_found(vector_frame(spark, few), dims=2) == clusters_by_definition(few, 16, 3, 2)
    assert clusters_found(vector_frame(spark, []), dims=2) == []
    assert clusters_found(vector_frame(spark, [(1, [1e300, 0.0])], "array<double>"), dims=2) == []


def test_boxes_strike_out_only_farther_centroids():
    rng = np.random.default_rng(8)
    low = rng.integers(-90, 80, size=(300, 6))
    high = low + rng.integers(0, 12, size=low.shape)
    c = rng.integers(-100, 100, size=(16, 6))
    may = centroids.candidates(low, high, c)
    assert 1 <= may.sum(axis=1).mean() < 5
    for lo, hi, m in zip(low, high, may, strict=True):
        x = rng.integers(lo, hi + 1, size=(200, 6))
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        at, dist = centroids.nearest(x, c, m)
        assert (at == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 2), (1, 5), (5, 1)])
def test_curve_visits_neighbouring_cells(axes, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
    key = centroids.hilbert_keys(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_clustered_vectors_lie_in_few_boxes(spark):
    rows = list(enumerate(vectors(2000, 12, 6, clusters=8) / 4))
    made = centroids.clustered(vector_frame(spark, rows), dims=12, k=8, block=32)
    boxes = made.blocks.select("low", "high").collect()
    low, high = (np.array([np.frombuffer(r[n], np.int32) for r in boxes], np.int64) for n in ("low", "high"))
    may = centroids.candidates(low, high, np.array(made.centroids, np.int64))
    assert may.sum(axis=1).mean() < 5
