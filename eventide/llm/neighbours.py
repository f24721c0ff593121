"""Nearest neighbours by inner product: a navigable small-world graph per shard, results merged.

Rows are dealt to shards of about `SHARD` vectors by a hash of the row. A shard becomes a hierarchical
graph: each vector has a level drawn from a geometric distribution and links to some near, mutually
unlike vectors on each level up to its own. The graph is stored as flat arrays of neighbour numbers,
one row of a Parquet file per shard. A search goes down the levels and widens to a beam of `EF` on the
lowest; all queries of a block walk the graph together, so a step is a handful of numpy calls.

Largest inner product becomes smallest angle by one more component that gives all vectors of a shard
the same length (0 for queries). Copies of a vector in a shard are one node with a list of ids.

Every shard is searched for every query. Blocks of queries go to tasks that hold a few shards each,
after the shards, and pass through one at a time; a task returns one row per block. A second sort by
block brings these rows together, and they are merged as they stream. Scores are inner products of the
original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows with a null id; ids are integers. Rows equal in id and vector are one. Rows with equal ids and
other vectors are queries of their own and no candidates of each other. Only vectors of the same
number of components are compared. Ties go to the smaller id. Fewer candidates than asked: all of
them. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import map_batches
from eventide.storage import stash
from eventide.workers import find_package

TOP = 20
LINKS = 16
EF_BUILD = 96
EF = 128
SHARD = 8192
QUERY_BLOCK = 256
#: Shards that a search task holds at most.
TASK_SHARDS = 16
INSERT = 512
_SPREAD = 4
_SEED = 11
_INDEX = ("dim int, shard int, ids binary, sizes binary, vectors binary, links binary, "
          "level_nodes array<binary>, level_links array<binary>")


class Graph:
    """Vectors of equal length and, per level, who is on it and a flat table of neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], tables: list[np.ndarray]):
        self.x, self.nodes, self.tables = x, nodes, tables
        self.place = []
        for on in nodes:
            place = np.full(len(x), -1, np.int32)
            place[on] = np.arange(len(on), dtype=np.int32)
            self.place.append(place)

    def beam(self, q: np.ndarray, entry: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest found per query: numbers (-1 after the last) and negative inner products.

        Each step opens the `_SPREAD` nearest unopened vectors of every beam at once; a query is done
        when its beam holds none.
        """
        table, place, x = self.tables[level], self.place[level], self.x
        rows, n, width = len(q), len(x), self.tables[level].shape[1]
        ids = np.full((rows, ef), -1, np.int32)
        far = np.full((rows, ef), np.inf, np.float32)
        opened = np.ones((rows, ef), bool)
        seen, slot = np.zeros(rows * n, bool), np.empty(rows * n, np.int32)
        r, c = np.nonzero(entry >= 0)
        first = entry[r, c]
        ids[r, c], opened[r, c] = first, False
        far[r, c] = -np.einsum("kd,kd->k", x[first], q[r])
        seen[r.astype(np.int64) * n + first] = True
        order = np.argsort(far, axis=1, kind="stable")
        ids, far, opened = (np.take_along_axis(v, order, 1) for v in (ids, far, opened))
        live = np.flatnonzero((~opened).any(axis=1))
        while len(live):
            wait = ~opened[live]
            r, c = np.nonzero(wait & (np.cumsum(wait, axis=1) <= _SPREAD))
            r = live[r]
            opened[r, c] = True
            near = table[place[ids[r, c]]].ravel()
            r = np.repeat(r, width)
            good = near >= 0
            r, near = r[good], near[good]
            flat = r.astype(np.int64) * n + near
            good = ~seen[flat]
            r, near, flat = r[good], near[good], flat[good]
            seen[flat] = True
            count = np.arange(len(flat), dtype=np.int32)
            slot[flat] = count
            good = slot[flat] == count
            r, near = r[good], near[good]
            dist = -np.einsum("kd,kd->k", x[near], q[r])
            good = dist < far[r, -1]
            r, near, dist = r[good], near[good], dist[good]
            start = np.searchsorted(r, live)
            most = int(np.diff(start, append=len(r)).max(initial=0))
            if most:
                at = np.searchsorted(live, r)
                column = ef + np.arange(len(r)) - start[at]
                shape = (len(live), ef + most)
                d, i, o = np.full(shape, np.inf, np.float32), np.full(shape, -1, np.int32), np.ones(shape, bool)
                d[:, :ef], i[:, :ef], o[:, :ef] = far[live], ids[live], opened[live]
                d[at, column], i[at, column], o[at, column] = dist, near, False
                order = np.argsort(d, axis=1, kind="stable")[:, :ef]
                far[live], ids[live], opened[live] = (np.take_along_axis(v, order, 1) for v in (d, i, o))
            live = live[(~opened[live]).any(axis=1)]
        return ids, far

    def descend(self, q: np.ndarray, level: int = 0) -> np.ndarray:
        """Entry points for a level: the walk from the top to the level above it."""
        entry = np.full((len(q), 1), self.nodes[-1][0], np.int32)
        for above in range(len(self.tables) - 1, level, -1):
            entry = self.beam(q, entry, above, _SPREAD)[0]
        return entry


def diverse(x: np.ndarray, near: np.ndarray, far: np.ndarray, limit: int) -> np.ndarray:
    """Per row at most `limit` of the candidates (in order of distance, -1 after the last): first those
    nearer to the base than to any candidate chosen before, then the nearest of the others."""
    out = np.full((len(near), limit), -1, np.int32)
    for lo in range(0, len(near), 256):
        c, d = near[lo:lo + 256], far[lo:lo + 256]
        v = x[c]
        pair = -(v @ v.transpose(0, 2, 1))
        real = c >= 0
        chosen = np.zeros(c.shape, bool)
        closest = np.full(c.shape, np.inf, np.float32)
        for j in range(c.shape[1]):
            take = real[:, j] & (d[:, j] < closest[:, j]) & (chosen.sum(axis=1) < limit)
            chosen[take, j] = True
            closest[take] = np.minimum(closest[take], pair[take, j])
        order = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :limit]
        part = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(c, order, 1), -1)
        out[lo:lo + 256, :part.shape[1]] = part
    return out


def equal_lengths(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled into the unit ball, with the component that puts them on its surface."""
    v = vectors / np.abs(vectors).max(initial=1e-300)
    v = v / np.sqrt((v * v).sum(axis=1)).max(initial=1e-300)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def built(x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """Insert vectors in batches that double up to `INSERT`: candidates are what a search of the graph so
    far finds and the nearest of the same batch."""
    n = len(x)
    rng = np.random.default_rng(_SEED)
    level = (-np.log(1 - rng.random(n)) / math.log(links)).astype(np.int32)
    order = rng.permutation(n)
    top = order[level[order].argmax()]
    order = np.concatenate([[top], order[order != top]])
    nodes = [np.flatnonzero(level >= k).astype(np.int32) for k in range(level.max(initial=0) + 1)]
    if len(nodes) > 1:  # where a search starts; on the lowest level it may start anywhere
        nodes[-1] = np.concatenate([[top], nodes[-1][nodes[-1] != top]]).astype(np.int32)
    graph = Graph(x, nodes, [np.full((len(on), links * (1 if k else 2)), -1, np.int32)
                             for k, on in enumerate(nodes)])
    done = 1
    while done < n:
        batch = order[done:done + min(done, INSERT)]
        entry = np.full((len(batch), 1), top, np.int32)
        for k in range(len(nodes) - 1, -1, -1):
            here = level[batch] >= k
            nxt = np.full((len(batch), _SPREAD), -1, np.int32)
            if not here.all():
                nxt[~here] = graph.beam(x[batch[~here]], entry[~here], k, _SPREAD)[0]
            if here.any():
                own = batch[here]
                ids, far = graph.beam(x[own], entry[here], k, ef)
                nxt[here] = ids[:, :_SPREAD]
                _link(graph, k, own, ids, far, links)
            entry = nxt
        done += len(batch)
    return graph


def _link(graph: Graph, k: int, own: np.ndarray, ids: np.ndarray, far: np.ndarray, links: int) -> None:
    """Links from new vectors to some of their candidates and back."""
    x, table, place = graph.x, graph.tables[k], graph.place[k]
    peers = -(x[own] @ x[own].T)
    np.fill_diagonal(peers, np.inf)
    most = min(ids.shape[1], len(own) - 1)
    near = np.argsort(peers, axis=1, kind="stable")[:, :most]
    ids = np.concatenate([ids, own[near].astype(np.int32)], axis=1)
    far = np.concatenate([far, np.take_along_axis(peers, near, 1)], axis=1)
    order = np.argsort(far, axis=1, kind="stable")[:, :max(1, ids.shape[1] - most)]
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    table[place[own], :links] = diverse(x, ids, far, links)

    chosen = table[place[own], :links]
    b, c = np.nonzero(chosen >= 0)
    target, source = chosen[b, c], own[b].astype(np.int32)
    width = table.shape[1]
    dist = -np.einsum("kd,kd->k", x[target], x[source])
    order = np.lexsort((source, dist, target))
    target, source = target[order], source[order]
    start = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    column = np.arange(len(target)) - np.repeat(start, np.diff(start, append=len(target)))
    good = column < width
    to = target[start]
    wide = np.full((len(to), 2 * width), -1, np.int32)
    wide[:, :width] = table[place[to]]
    wide[(np.cumsum(column == 0) - 1)[good], width + column[good]] = source[good]
    dist = np.full(wide.shape, np.inf, np.float32)
    r, c = np.nonzero(wide >= 0)
    dist[r, c] = -np.einsum("kd,kd->k", x[to[r]], x[wide[r, c]])
    for _ in range(2):
        order = np.lexsort((wide, dist), axis=1)
        wide, dist = np.take_along_axis(wide, order, 1), np.take_along_axis(dist, order, 1)
        again = np.zeros(wide.shape, bool)
        again[:, 1:] = (wide[:, 1:] == wide[:, :-1]) & (wide[:, 1:] >= 0)
        wide[again], dist[again] = -1, np.inf
    full = wide[:, width] >= 0
    table[place[to[~full]]] = wide[~full, :width]
    if full.any():
        table[place[to[full]]] = diverse(x, wide[full], dist[full], width)


class Shard:
    """A stored graph with the original vectors and the ids of each."""

    def __init__(self, row: dict, dim: int, kind: str):
        ints = lambda v: np.frombuffer(v, np.int32)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), ints(row["sizes"])
        self.start = np.cumsum(self.sizes) - self.sizes
        nodes = [np.arange(len(self.vectors), dtype=np.int32), *map(ints, row["level_nodes"])]
        tables = [ints(v).reshape(len(on), -1) for on, v in
                  zip(nodes, [row["links"], *row["level_links"]], strict=True)]
        self.graph = Graph(equal_lengths(self.vectors.astype(np.float64)), nodes, tables)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest rows found per query, scores -inf after the last."""
        scaled = q / np.abs(q).max(axis=1, initial=1e-300)[:, None]
        flat = np.concatenate([scaled, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        found, _ = self.graph.beam(flat, self.graph.descend(flat), 0, max(ef, k + 1))
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        score = (self.vectors[node].astype(np.float64) * q[r]).sum(axis=1)
        copies = np.minimum(self.sizes[node], k + 1)
        at = np.repeat(self.start[node] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
        r, score, ids = np.repeat(r, copies), np.repeat(score, copies), self.ids[at]
        other = ids != own[r]
        return best(r[other], ids[other], score[other], len(q), k)


def best(r: np.ndarray, ids: np.ndarray, score: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k entries of greatest score, then least id, as two tables (score -inf: none)."""
    order = np.lexsort((ids, -score, r))
    r, ids, score = r[order], ids[order], score[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    out = np.zeros((rows, k), np.int64), np.full((rows, k), -np.inf)
    out[0][r[keep], rank[keep]], out[1][r[keep], rank[keep]] = ids[keep], score[keep]
    return out


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v, dim of the rows that can be compared, each once."""
    known = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    floats = "float" in vectors.schema[vector_col].dataType.simpleString()
    return (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(
                "array<float>" if floats else "array<double>").alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", known)
                   & F.exists("v", lambda e: e != 0))
            .dropDuplicates(["id", "v"]).withColumn("dim", F.size("v")))


def _kind(rows: DataFrame) -> str:
    return "<f4" if "float" in rows.schema["v"].dataType.simpleString() else "<f8"


def index(rows: DataFrame, shards: int, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """One row per shard: ids, copies of each node, original vectors, neighbour tables by level."""
    kind = _kind(rows)

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = v.astype(kind).reshape(-1, dim) + np.dtype(kind).type(0)
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[order], ids[order]
        new = np.append(True, (v[1:] != v[:-1]).any(axis=1))
        start = np.flatnonzero(new)
        graph = built(equal_lengths(v[start].astype(np.float64)), links, ef)
        raw = lambda parts: pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))
        one = lambda p: pa.array([p.tobytes()], pa.binary())
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": table.column("shard").slice(0, 1), "ids": one(ids),
            "sizes": one(np.diff(start, append=len(ids)).astype(np.int32)), "vectors": one(v[start]),
            "links": one(graph.tables[0]), "level_nodes": raw(graph.nodes[1:]),
            "level_links": raw(graph.tables[1:])})
    find_package(rows.sparkSession)
    return (rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
            .groupBy("dim", "shard").applyInArrow(build, _INDEX))


def blocks(rows: DataFrame, count: int) -> DataFrame:
    """Queries packed by block: dim, block, ids, vectors."""
    kind = _kind(rows)

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
        ids = table.column("id").to_numpy()
        order = np.lexsort((*v.T[::-1], ids))
        return pa.table({"dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "vectors": pa.array([v[order].tobytes()], pa.binary())})
    return (rows.withColumn("block", F.pmod(F.xxhash64("v", "id"), F.lit(count)).cast("int"))
            .groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, vectors binary"))


def top(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id",
        vector_col: str = "embedding", shard: int = SHARD, ef: int = EF, links: int = LINKS,
        ef_build: int = EF_BUILD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `is_query` holds.

    `is_query` is a condition on the column `id`.
    """
    rows = taking_part(vectors, id_col, vector_col)
    kind = _kind(rows)
    total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    shards = max(1, -(-total // shard))
    spread = 2 * rows.sparkSession.sparkContext.defaultParallelism
    each = max(1, min(TASK_SHARDS, shards // spread))
    graphs = stash(index(rows, shards, links, ef_build)).withColumn("task", F.floor(F.col("shard") / each).cast("int"))
    packed = stash(blocks(rows.where(is_query), max(1, -(-asked // QUERY_BLOCK))))
    asks = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // each))))
    both = graphs.withColumn("block", F.lit(-1)).unionByName(asks, allowMissingColumns=True)
    dealt = both.repartition(max(1, -(-shards // each)), "dim", "task").sortWithinPartitions("dim", "task", "block")
    columns = ["dim", "task", "block", "ids", "sizes", "vectors", "links", "level_nodes", "level_links"]

    def search(batches):
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in columns}
                if (row["dim"], row["task"]) != now:
                    now, held = (row["dim"], row["task"]), []
                if row["block"] < 0:
                    held.append(Shard(row, row["dim"], kind))
                elif held:
                    own = np.frombuffer(row["ids"], np.int64)
                    q = np.frombuffer(row["vectors"], kind).reshape(len(own), -1).astype(np.float64)
                    yield _row(row, own, *_merged([s.search(own, q, k, ef) for s in held], k))

    def merge(batches):
        now, own, held = None, None, None
        for b in batches:
            for row in b.to_pylist():
                ids, score = (np.frombuffer(row[c], t).reshape(-1, k) for c, t in
                              (("found", np.int64), ("score", np.float64)))
                if (row["dim"], row["block"]) != now:
                    if held is not None:
                        yield _ranked(own, *held)
                    now, own, held = (row["dim"], row["block"]), np.frombuffer(row["ids"], np.int64), (ids, score)
                else:
                    held = _merged([held, (ids, score)], k)
        if held is not None:
            yield _ranked(own, *held)

    found = map_batches(dealt.select(*columns), search, "dim int, block int, ids binary, found binary, score binary")
    return map_batches(found.repartition("dim", "block").sortWithinPartitions("dim", "block"), merge,
                       T._parse_datatype_string("query_id long, rank int, vec_id long, score double"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    ids, score = (np.concatenate([p[i] for p in parts], axis=1) for i in (0, 1))
    r, c = np.nonzero(score > -np.inf)
    return best(r, ids[r, c], score[r, c], len(ids), k)


def _row(row: dict, own: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    raw = lambda v: pa.array([v.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([row["dim"]], pa.int32()), pa.array([row["block"]], pa.int32()), raw(own), raw(ids), raw(score)],
        names=["dim", "block", "ids", "found", "score"])


def _ranked(own: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    r, c = np.nonzero(score > -np.inf)
    return pa.RecordBatch.from_arrays(
        [pa.array(own[r]), pa.array((c + 1).astype(np.int32)), pa.array(ids[r, c]), pa.array(score[r, c])],
        names=["query_id", "rank", "vec_id", "score"])
