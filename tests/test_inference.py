"""Bootstrap by packed cluster vectors, against its definition draw by draw."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import inference

MASK = 0xFFFFFFFF


def mixed(x):
    for _ in range(2):
        x = ((x >> 16) ^ x) * 73244475 & MASK
    return (x >> 16) ^ x


def means_by_definition(rows, n_boot, seed):
    cells = {}
    for cut, bucket, horizon, ticker, total, n, _ in rows:
        if n:
            cells.setdefault((cut, bucket, horizon), []).append(
                (hashlib.md5(ticker.encode()).hexdigest()[:2], ticker, total, n))
    out = {}
    for cell, members in cells.items():
        members.sort()
        h = int(hashlib.md5("|".join((str(seed), *cell)).encode()).hexdigest()[:8], 16)
        for b in range(1, n_boot + 1):
            start = mixed(h ^ mixed(b))
            drawn = [members[mixed((start + k * 2654435761) & MASK) % len(members)]
                     for k in range(1, len(members) + 1)]
            out[(*cell, b)] = sum(m[2] for m in drawn) / sum(m[3] for m in drawn)
    return out


def clusters_of(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", "x" if i % 2 else "ALL", "21d", f"T{t}", float(rng.normal()), int(rng.integers(0, 4)), 0)
            for i, m in enumerate(sizes) for t in range(m)]
    schema = "cut string, bucket string, horizon string, ticker string, total double, n bigint, hits bigint"
    df = spark.createDataFrame(rows, schema)
    return rows, df


@pytest.mark.parametrize("pack, hold, work, piece", [(1 << 17, 1 << 22, 1 << 22, 1 << 16), (8, 20, 100, 16), (5, 5, 1, 7)])
def test_replicates_equal_single_draws(spark, monkeypatch, pack, hold, work, piece):
    for name, v in (("_PACK", pack), ("_HOLD", hold), ("_WORK", work), ("_PIECE", piece)):
        monkeypatch.setattr(inference, name, v)
    rows, df = clusters_of(spark, [1, 2, 40, 75])
    got = {(r["cut"], r["bucket"], r["horizon"], r["b"]): r["m"] for r in
           inference.replicate_means(df, 12, 3).collect()}
    want = means_by_definition(rows, 12, 3)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_no_draw_is_shuffled_or_broadcast(spark):
    n = 1_000_000
    df = (spark.range(n).select(F.lit("a").alias("cut"), F.lit("ALL").alias("bucket"), F.lit("5d").alias("horizon"),
                                F.concat(F.lit("T"), "id").alias("ticker"), F.rand(1).alias("total"),
                                F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("hits")))
    plan = inference.replicate_means(df, 2000, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastExchange" not in plan


def test_no_clusters(spark):
    _, df = clusters_of(spark, [])
    assert inference.replicate_means(df, 10, 0).count() == 0


def test_draws_spread_over_tasks_whatever_the_size_of_their_rows(spark):
    rows = spark.createDataFrame([("c", "b", "1d", f"t{i}", 1.0, 1) for i in range(5)],
                                 "cut string, bucket string, horizon string, ticker string, total double, n long")
    plan = inference.replicate_means(rows, 10, 0)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
