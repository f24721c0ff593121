"""Cluster bootstrap, exact medians and multiple-testing flags of event studies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide import fixed_values as fv
from eventide.storage import stash
from eventide.workers import find_package

CELL = ["cut", "bucket", "horizon"]
_MASK = 0xFFFFFFFF
_MULTIPLIER = 73244475
_STRIDE = 2654435761
_BIN = 10_000
#: Clusters of a packed row, and that a drawing task holds at most.
_PACK, _HOLD = 1 << 17, 1 << 22
#: Draws of a block of replicates, blocks of a cell, draws at a time.
_WORK, _PARTS, _PIECE = 1 << 22, 40, 1 << 16


def long_returns(events: DataFrame, cuts: dict[str, str | None], horizons) -> DataFrame:
    """One row per event, cut and horizon: (cut, bucket, horizon, ticker, value).

    A cut without a column is the overall row. Rows without a bucket are left out.
    """
    buckets = F.array(*[F.struct(F.lit(name).alias("cut"),
                                 (F.lit("ALL") if col is None else F.col(col)).alias("bucket"))
                        for name, col in cuts.items()])
    values = F.array(*[F.struct(F.lit(f"{h}d").alias("horizon"), F.col(f"abn_{h}d").alias("value"))
                       for h in horizons])
    return (events.select("ticker", F.inline(buckets), values.alias("v"))
            .where("bucket is not null").select("ticker", "cut", "bucket", F.inline("v")))


def cluster_totals(rows: DataFrame) -> DataFrame:
    """Sum, count and positives per cell and cluster: all the bootstrap needs of the events."""
    return rows.groupBy(*CELL, "ticker").agg(
        F.sum("value").alias("total"), F.count("value").alias("n"),
        F.count_if(F.col("value") > 0).alias("hits"))


def _numbered(clusters: DataFrame) -> DataFrame:
    """Dense cluster number per cell, in order of (hash prefix, ticker), and the cell's size `c`.

    Numbered inside 256 hash slices first and offset by the sizes of the slices before, so no
    task holds all clusters of a cell. The join is merged along the order the numbering has left.
    """
    live = (clusters.where("n > 0")
            .withColumn("slice", F.substring(F.md5(F.col("ticker").cast("binary")), 1, 2)))
    within = W.partitionBy(*CELL, "slice").orderBy("ticker")
    before = W.partitionBy(*CELL).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = live.groupBy(*CELL, "slice").agg(F.count("*").alias("m"))
    offsets = sizes.select(*CELL, "slice", F.sum("m").over(W.partitionBy(*CELL)).alias("c"),
                           F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    return (live.withColumn("i", F.row_number().over(within) - 1)
            .join(offsets.hint("merge"), [*CELL, "slice"])
            .select(*CELL, (F.col("offset") + F.col("i")).cast("bigint").alias("idx"),
                    "total", "n", "c"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Integer mixing on 32 bits, in unsigned 32-bit values that wrap around."""
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(_MULTIPLIER)
    return (x >> np.uint32(16)) ^ x


def drawn_sums(h: int, c: int, reps: np.ndarray, lo: int, values: np.ndarray) -> np.ndarray:
    """Per replicate the sums of the columns of `values` over its draws.

    A replicate draws c of c clusters; `values` has those numbered from `lo` on, and draws of others add
    nothing. Work goes in pieces of `_PIECE` draws.
    """
    out = np.zeros((len(reps), values.shape[1]))
    starts = _mixed(np.uint32(h & _MASK) ^ _mixed((reps & _MASK).astype(np.uint32)))
    whole = len(values) == c
    rows = max(1, _PIECE // c)
    for r in range(0, len(reps), rows):
        for k in range(0, c, _PIECE):
            steps = (np.arange(k + 1, min(c, k + _PIECE) + 1, dtype=np.uint64)
                     * np.uint64(_STRIDE)).astype(np.uint32)
            x = _mixed(starts[r:r + rows, None] + steps)
            at = (x % np.uint32(c) if c <= _MASK else x).astype(np.int64)
            if whole:
                out[r:r + rows] += values[at].sum(axis=1)
            else:
                mine = (at >= lo) & (at < lo + len(values))
                row, col = np.nonzero(mine)
                np.add.at(out, r + row, values[at[row, col] - lo])
    return out


def replicate_means(clusters: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """Mean of every bootstrap replicate per cell: clusters drawn with replacement.

    The (sum, count) of a cell's clusters are packed into arrays by number, once for each block of
    replicates. A task draws and adds up in these arrays, so no draw is ever a row. Draws are a pure
    function of (seed, cell, replicate, draw); a lost task redoes the same draws. Blocks of replicates
    follow the work of a cell, so the draws of a large cell spread over tasks, and a task holds at most
    `_HOLD` clusters at a time.
    """
    label = F.concat_ws("|", F.lit(str(seed)), *[F.col(x) for x in CELL])
    cell_hash = F.conv(F.substring(F.md5(label.cast("binary")), 1, 8), 16, 10).cast("bigint")
    numbered = _numbered(clusters).withColumns(
        {"block": F.floor(F.col("idx") / _PACK), "h": cell_hash})

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        total, n = (table.column(x).to_numpy()[order].astype(np.float64) for x in ("total", "n"))
        c = table.column("c")[0].as_py()
        parts = max(1, min(_PARTS, n_boot, -(-c * n_boot // _WORK)))
        cut = [n_boot * i // parts for i in range(parts + 1)]
        one = table.slice(0, 1).select([*CELL, "c", "h", "block"])
        rows = pa.concat_tables([one] * parts)
        packed = pa.array([np.column_stack([total, n]).tobytes()] * parts, pa.large_binary())
        return (rows.append_column("first", pa.array(cut[:-1], pa.int32()))
                .append_column("last", pa.array(cut[1:], pa.int32()))
                .append_column("packed", packed.cast(pa.binary())))

    def draw(batches):
        now, held, sums = None, [], None

        def add():
            values = np.concatenate([v for _, v in held])
            return sums + drawn_sums(now[4], now[3], reps, held[0][0] * _PACK, values)
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[x] for x in (*CELL, "c", "h", "first", "last"))
                if key != now:
                    if held:
                        yield _means(now, reps, add())
                    now, held, reps = key, [], np.arange(row["first"] + 1, row["last"] + 1)
                    sums = np.zeros((len(reps), 2))
                elif sum(len(v) for _, v in held) >= _HOLD:
                    sums, held = add(), []
                held.append((row["block"], np.frombuffer(row["packed"]).reshape(-1, 2)))
        if held:
            yield _means(now, reps, add())
    find_package(clusters.sparkSession)
    kinds = ", ".join(f"{x} string" for x in CELL)
    packs = numbered.groupBy(*CELL, "block").applyInArrow(
        pack, f"{kinds}, c bigint, h bigint, block bigint, first int, last int, packed binary")
    keys = [*CELL, "first"]
    # A few bytes stand for much work, so the number of tasks must not follow from the size of the rows.
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (packs.repartition(tasks, *keys).sortWithinPartitions(*keys, "block")
            .mapInArrow(draw, f"{kinds}, b bigint, m double"))


def _means(key: tuple, reps: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[pa.array([v] * len(reps), pa.string()) for v in key[:len(CELL)]],
         pa.array(reps.astype(np.int64)), pa.array(sums[:, 0] / sums[:, 1])], names=[*CELL, "b", "m"])


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per group without gathering a group in one task.

    A histogram of fine bins locates the bins that hold the middle ranks; only rows of those bins
    are ordered, after counting equal values together.
    """
    known = rows.where(F.col(value).isNotNull()).withColumn("_bin", F.floor(
        F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col(value))) * _BIN))
    hist = known.groupBy(*keys, "_bin").agg(F.count("*").alias("_m"))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = (hist.withColumn("_end", F.sum("_m").over(upto))
              .withColumn("_n", F.sum("_m").over(W.partitionBy(*keys)))
              .withColumn("_lo", F.floor((F.col("_n") - 1) / 2))
              .withColumn("_hi", F.floor(F.col("_n") / 2))
              .withColumn("_start", F.col("_end") - F.col("_m"))
              .where("(_lo >= _start and _lo < _end) or (_hi >= _start and _hi < _end)")
              .select(*keys, "_bin", "_start", "_lo", "_hi"))
    middle = stash(middle)  # two bins a group: its size, not a guess, decides the join
    inside = (known.join(middle, [*keys, "_bin"])
              .groupBy(*keys, "_bin", "_start", "_lo", "_hi", value)
              .agg(F.count("*").alias("_k")))
    order = (W.partitionBy(*keys, "_bin").orderBy(value)
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = (inside.withColumn("_last", F.col("_start") + F.sum("_k").over(order))
              .withColumn("_first", F.col("_last") - F.col("_k")))

    def at(rank):
        return F.max(F.when((F.col(rank) >= F.col("_first")) & (F.col(rank) < F.col("_last")),
                            F.col(value)))
    return placed.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias("median"))


def summarize(events: DataFrame, cuts: dict[str, str | None], horizons,
              n_boot: int = fv.N_BOOT, seed: int = 0,
              categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Per cut, bucket and horizon: counts, mean, median, hit rate, interval and p-value.

    `events` is read several times, so it is written to shared storage once. `categories` lists
    buckets that must appear even when no event falls into them.
    """
    events = stash(events)
    rows = long_returns(events, cuts, horizons)
    clusters = stash(cluster_totals(rows))
    cells = clusters.groupBy(*CELL).agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_clusters"),
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
        (F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("hit_rate"))
    means = replicate_means(clusters, n_boot, seed)
    centred = F.col("m") - F.avg("m").over(W.partitionBy(*CELL))
    ends = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    boot = (means.withColumn("dev", F.abs(centred)).join(cells.select(*CELL, "mean"), CELL)
            .groupBy(*CELL).agg(
                ends.alias("ci"),
                F.avg((F.col("dev") >= F.abs("mean")).cast("double")).alias("p_two_sided")))
    out = (cells.join(exact_median(rows, CELL, "value"), CELL, "left").join(boot, CELL, "left")
           .select(*CELL, "n", "n_clusters", "mean", "median", "hit_rate",
                   F.col("ci")[0].alias("ci_lo"), F.col("ci")[1].alias("ci_hi"), "p_two_sided"))
    if categories:
        grid = [(cut, b, f"{h}d") for cut, bs in categories.items() for b in bs for h in horizons]
        full = events.sparkSession.createDataFrame(grid, "cut string, bucket string, horizon string")
        zero = full.join(out, CELL, "left_anti").withColumns(
            {"n": F.lit(0).cast("bigint"), "n_clusters": F.lit(0).cast("bigint")})
        out = out.unionByName(zero, allowMissingColumns=True)
    return flag_tests(out)


def flag_tests(summary: DataFrame, alpha: float = 0.05, n_tests: int | None = None) -> DataFrame:
    """Reliable, nominally significant, and surviving the family-wise bar of all its rows."""
    reliable = F.col("n_clusters") >= fv.MIN_CLUSTERS
    p = F.col("p_two_sided")
    size = F.lit(n_tests) if n_tests else F.count("*").over(W.partitionBy(F.lit(1)))
    known = lambda e: F.coalesce(e, F.lit(False))
    return (summary.withColumn("_size", size).withColumns({
        "reliable": reliable,
        "significant": known(reliable & ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))
                             & (p < 0.05)),
        "survives_bonferroni": known(reliable & (p < F.lit(alpha) / F.col("_size")))})
        .drop("_size"))
