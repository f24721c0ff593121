"""Centroid clustering with zone maps along a space-filling curve.

Vectors become integers, so every distance and every mean is exact and all runs agree. They are
ordered along a Hilbert curve and packed into blocks of neighbours with the least and greatest value of
each component (the block's box). In every round the boxes are compared with the centroids first: of
the difference of two squared distances, which is linear in the vector, a box gives the exact least
value, so a centroid that is farther than another one all over the box is struck out. The vectors of a
block are then compared with the centroids left over. Only sums per centroid leave a task.

The curve runs through the inner products with the starting centroids, quantised between their least
and greatest values. Its place is a 64-bit key; equal keys are told apart by a hash of the row, so
many copies of a vector spread over the blocks of several tasks.

Defined cases: a vector takes part if it has exactly `dims` components, none null or non-finite (an
integer beyond +-2^27 does not take part either: its distances would not fit a long). Rows with equal
or null ids are rows of their own; a null id is hashed as the empty string, equal hashes are ordered by
components. With fewer vectors than centroids there are as many centroids as vectors; no vectors, no
rows. An inertia that does not fit a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import map_batches
from eventide.storage import stash

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
SEED = 1
BLOCK = 128
#: Vectors of a task, by which the number of range partitions follows the input.
TASK_VECTORS = 65_536
LIMIT = 1 << 27
#: Below it, double precision adds up `dims` products without rounding.
_EXACT = 1 << 22
_BLOCKS = "ids array<{id}>, vectors binary, low binary, high binary"


@dataclass
class Clustering:
    """Blocks of vectors, the final centroids, and per centroid (vectors, summed distance)."""

    blocks: DataFrame
    centroids: list[list[int]]
    totals: list[tuple[int, int]]


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id and x (array of integers) of the vectors that take part."""
    known = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    whole = F.transform(F.col("v"), lambda e: F.floor(e.cast("double") * scale))
    fits = lambda e: F.abs(e.cast("double") * scale) <= LIMIT
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where((F.size("v") == dims) & F.forall("v", lambda e: known(e) & fits(e)))
            .select("id", whole.cast("array<bigint>").alias("x")))


def first_centroids(whole: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors whose seed and id have the smallest hashes: k rows, in order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = (whole.withColumn("h", F.sha2(named.cast("binary"), 256)).orderBy("h", "x").limit(k)
            .select("x").collect())
    return [list(r["x"]) for r in rows]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with `bits` bits in each of at most 64 / bits axes.

    Each axis below the top bit is turned or mirrored as its curve section asks; the bits of all axes
    are then read across (Skilling's transform), and their Gray code is undone.
    """
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(axes):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in reversed(range(bits)):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[i] >> bit) & 1).astype(np.uint64)
    return key


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return x @ c.T


def along_curve(whole: DataFrame, axes: list[list[int]], dims: int = DIMS,
                block: int = BLOCK) -> DataFrame:
    """Blocks of vectors that lie together on the curve: ids, vectors, low and high as int32 bytes."""
    base = np.array(axes[:64], np.int64)  # a key has 64 bits
    bits = max(1, 64 // max(1, len(base)))

    def reached(batches):
        for b in batches:
            place = _matrix(b.column(0), dims).astype(np.float64) @ base.T.astype(np.float64)
            if len(place):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(place)], pa.int64()), pa.array(place.min(axis=0)[None].tolist()),
                     pa.array(place.max(axis=0)[None].tolist())], names=["n", "low", "high"])
    ends = map_batches(whole.select("x"), reached, "n long, low array<double>, high array<double>")
    spans = ends.select("n", F.posexplode(F.arrays_zip("low", "high"))).groupBy("pos").agg(
        F.sum("n"), F.min("col.low"), F.max("col.high")).orderBy("pos").collect()
    rows = spans[0][1] if spans else 0
    low, high = (np.array([r[i] for r in spans], float) for i in (2, 3))
    width = np.maximum(high - low, 1e-9)

    def keyed(batches):
        for b in batches:
            x = _matrix(b.column(1), dims)
            place = x.astype(np.float64) @ base.T.astype(np.float64)
            cells = np.clip((place - low) / width * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            key = (hilbert_keys(cells, bits) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], names=["id", "x", "key"])

    def packed(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b.select(["id", "x"])])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= block:
                yield _block(held.slice(0, block), dims)
                held = held.slice(block)
        if held is not None and len(held):
            yield _block(held, dims)
    id_type = whole.schema["id"].dataType
    keys = map_batches(whole, keyed, T.StructType([*whole.schema.fields, T.StructField("key", T.LongType())]))
    ranged = (keys.withColumn("tie", F.xxhash64("id", "x"))
              .repartitionByRange(max(1, -(-rows // TASK_VECTORS), _cores(whole)), "key", "tie")
              .sortWithinPartitions("key", "tie").select("id", "x"))
    return map_batches(ranged, packed, _BLOCKS.format(id=id_type.simpleString()))


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _block(rows: pa.Table, dims: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    x = _matrix(rows.column("x").chunk(0), dims)
    ids = rows.column("id").chunk(0)
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
         *[pa.array([v.astype(np.int32).tobytes()], pa.binary()) for v in (x, x.min(axis=0), x.max(axis=0))]],
        names=["ids", "vectors", "low", "high"])


def candidates(low: np.ndarray, high: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Per box (row of low and high), which centroids may be the nearest of some vector within it.

    Held against the centroid b nearest to the middle of the box: |x - a|^2 - |x - b|^2 is
    2 x (b - a) + |a|^2 - |b|^2, and each component takes its least value at one side of the box. If
    the sum is above 0, a is farther than b everywhere in the box.
    """
    norm = (c * c).sum(axis=1)
    middle = (low + high) // 2
    best = (norm - 2 * _products(middle, c)).argmin(axis=1)
    out = np.empty((len(low), len(c)), bool)
    for a in range(len(c)):
        step = 2 * (c[best] - c[a])
        least = np.where(step > 0, low * step, high * step).sum(axis=1)
        out[:, a] = least + norm[a] - norm[best] <= 0
    return out


def nearest(x: np.ndarray, c: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the centroids in question and its squared distance; ties: the smaller."""
    own = np.flatnonzero(may)
    some = c[own]
    dist = (x * x).sum(axis=1)[:, None] - 2 * _products(x, some) + (some * some).sum(axis=1)
    at = dist.argmin(axis=1)
    return own[at], dist[np.arange(len(x)), at]


def _assigned(batch: pa.RecordBatch, c: np.ndarray):
    """(position of the block, its vectors, clusters, distances) of each block of a batch."""
    dims = c.shape[1]
    box = lambda name: np.frombuffer(
        b"".join(batch.column(name).to_pylist()), np.int32).astype(np.int64).reshape(-1, dims)
    if not batch.num_rows:
        return
    may = candidates(box("low"), box("high"), c)
    for i, raw in enumerate(batch.column("vectors")):
        x = np.frombuffer(raw.as_py(), np.int32).astype(np.int64).reshape(-1, dims)
        yield i, x, *nearest(x, c, may[i])


def round_totals(blocks: DataFrame, centroids: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """Per centroid the number of its vectors, their summed distance and their summed components.

    A task returns one row per centroid; k rows of sums reach the driver. Sums are decimals of 38 digits.
    """
    c = np.array(centroids, np.int64)
    k, dims = c.shape

    def run(batches):
        n, far, sums = [0] * k, [0] * k, [np.zeros(dims, object) for _ in range(k)]
        for b in batches:
            for _, x, at, dist in _assigned(b, c):
                for j in np.unique(at).tolist():
                    own = at == j
                    n[j] += int(own.sum())
                    far[j] += int(dist[own].sum())
                    sums[j] += x[own].sum(axis=0)
        used = [j for j in range(k) if n[j]]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(
                [[Decimal(int(v)) for v in (n[j], far[j], *sums[j])] for j in used], pa.list_(kind))],
            names=["c", "sums"])
    parts = map_batches(blocks.select("vectors", "low", "high"), run, "c int, sums array<decimal(38,0)>")
    rows = parts.select("c", F.posexplode("sums")).groupBy("c", "pos").agg(F.sum("col").alias("s")).collect()
    found = {(r["c"], r["pos"]): int(r["s"]) for r in rows}
    got = {j: (found[j, 0], found[j, 1], [found[j, 2 + d] for d in range(dims)]) for j, pos in found if not pos}
    return [got.get(j, (0, 0, [0] * dims)) for j in range(k)]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
              k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
              seed: int = SEED, block: int = BLOCK) -> Clustering:
    """Move k centroids `rounds` times to the floored mean of their vectors; empty ones stay."""
    whole = integers(vectors, id_col, vector_col, dims, scale)
    centroids = first_centroids(whole, k, seed)
    blocks = stash(along_curve(whole, centroids, dims, block))
    if not centroids:
        return Clustering(blocks, [], [])
    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else c for c, (n, _, sums) in
                     zip(centroids, round_totals(blocks, centroids), strict=True)]
    return Clustering(blocks, centroids, [(n, far) for n, far, _ in round_totals(blocks, centroids)])


def assigned(made: Clustering, id_name: str = "vec_id") -> DataFrame:
    """Per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    c = np.array(made.centroids, np.int64)
    marks = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in made.centroids]
    inertia = [far if far < 1 << 63 else None for _, far in made.totals]
    over_all = sum(far for _, far in made.totals)
    over_all = over_all if over_all < 1 << 63 else None
    id_type = made.blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_name, id_type), T.StructField("cluster", T.IntegerType()),
                           *[T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")],
                           T.StructField("centroid_sha256", T.StringType())])
    if not made.centroids:
        return made.blocks.sparkSession.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            for i, _, at, dist in _assigned(b, c):
                own = at.tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, 1).flatten(), pa.array(at.astype(np.int32)), pa.array(dist),
                     pa.array([inertia[j] for j in own], pa.int64()),
                     pa.array([over_all] * len(own), pa.int64()),
                     pa.array([marks[j] for j in own], pa.string())], names=schema.names)
    return map_batches(made.blocks, run, schema)
