"""Exact top-k search by BM25 with block-max pruning, by shard, merged with global statistics.

Terms are lower-case words of letters and digits; a query is the set of all terms of its text.

1. Document frequencies and the mean length are counted over all documents, and each query gets the
   weights of its terms from them.
2. Documents are dealt over groups, one per task, and a task takes those of a kind one after the other:
   about as long and with the same most frequent word, which tells languages apart. As many as make a
   shard of bounded size get an inverted index: lists of postings, and rows by document for common
   terms with the greatest impact of each block of documents. Queries of a kind share blocks too. So few
   terms are common to a block of queries and a shard of another kind, and those of their own kind
   are common enough for matrix products.
3. A task gets each block of queries once, keeps it in a local file and reads it for each shard, with the
   best results so far; their k-th score is a bound for the next shard. The first shard, a small one, holds
   documents of all kinds. What queries take in a shuffle grows with their number alone.
4. In a shard the postings of a query's rarer terms are added up; the k-th sum is a bound too. Blocks whose
   greatest sum plus greatest impacts stays below it for all queries of a block are skipped; over the
   others the other terms of all its queries are summed in one matrix product. Documents that reach the
   bound, eased by what single precision and rounding can be off, are scored in double precision, so no
   document of the true top k is dropped.
5. A task returns one packed row per block of queries; those of a block stream by in order and are
   merged. Scores come from global statistics, so they compare.

Scores are rounded to 6 digits; ties go to the lesser id.

Defined cases: a null or empty text has no terms: it is found by no query and finds nothing; rows
that share an id are separate results and queries; with fewer than k documents that share a term all
of them are returned.
"""

from __future__ import annotations

import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import ALNUM, LOWER, Spans, chunks, map_batches
from eventide.storage import stash

K1, B = 1.2, 0.75
TOP = 10
SHARD = 14_000
SHARD_TERMS = 4_000_000
BLOCK = 64
QUERY_BLOCK = 256
WORDS = 64
MIXED = 64
ROW_CELLS = 8_000_000
ADD = 500  # adding a posting takes as long as so many terms of a matrix product
PIECE = 1 << 15
FRAGMENT = 1_000_000
NO_ID = -(1 << 63)  # stands for a null id inside a shard


def term_sets(s: Spans):
    """Per row, ordered by hash: terms, counts, and the row of each."""
    order = np.lexsort((s.hash, s.row))
    row, h = s.row[order], s.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return h[start], np.diff(start, append=len(h)), row[start]


_VECTORS = "id long, n long, terms binary, counts binary, query boolean, word long"


def vectors(docs: DataFrame, is_query: Column, id_col: str, text_col: str) -> DataFrame:
    """id, n (words), terms and counts (packed), whether it is a query, the hash of its most frequent word."""
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                h, count, row = term_sets(s := Spans(data, offs, ALNUM, LOWER))
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(s.per_row, pa.int64()),
                     pa.array([h[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                     pa.array([count[a:z].astype(np.int32).tobytes() for a, z in
                               zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                     b.column(2).slice(lo, hi - lo), _first_word(h, count, cut)],
                    names=["id", "n", "terms", "counts", "query", "word"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"),
                       F.coalesce(is_query, F.lit(False)).alias("q"))
    return map_batches(rows, run, _VECTORS)


def _first_word(h: np.ndarray, count: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Per row the most frequent term, of equals the one of least hash (null: there is none)."""
    out, full = np.zeros(len(cut) - 1, np.int64), cut[1:] > cut[:-1]
    if len(h):
        most = np.repeat(np.maximum.reduceat(count, cut[:-1][full]), np.diff(cut)[full])
        at = np.flatnonzero(count == most)
        out[full] = h[at[np.searchsorted(at, cut[:-1][full])]].view(np.int64)
    return pa.array(out, mask=~full)


def _parted(part: np.ndarray, *cols: np.ndarray):
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [c[order] for c in cols]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), [c[a:z].tobytes() for c in cols]


def frequencies(vecs: DataFrame, fragments: int) -> DataFrame:
    """fragment, terms, counts: how many documents of a task have each term, by range of hashes."""
    def run(batches):
        held, n = [], 0

        def flush():
            h, count = np.unique(np.concatenate(held), return_counts=True)
            part = (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)
            cols = list(zip(*[(p, *c) for p, c in _parted(part, h, count.astype(np.int64))], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                                               pa.array(cols[2], pa.binary())],
                                              names=["fragment", "terms", "counts"])
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.append(np.frombuffer(t, np.uint64))
                    n += len(held[-1])
            if n >= FRAGMENT:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
    return map_batches(vecs.select("terms"), run, "fragment int, terms binary, counts binary")


def query_terms(vecs: DataFrame, fragments: int, spans: dict) -> DataFrame:
    """fragment, terms, owners and blocks (per term): terms of queries by range of hashes.

    Queries of one kind have the numbers from spans[kind][0] on, spans[kind][1] of them; they are dealt over these
    by their hash and cut into blocks, so that queries of a block are alike.
    """
    def run(batches):
        for b in batches:
            h, owner, block = [], [], []
            for k, t, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h.append(np.frombuffer(t or b"", np.uint64))
                owner.append(np.full(len(h[-1]), k, np.int64))
                first, n = spans[kind]
                block.append(np.full(len(h[-1]), (first + k % n) // QUERY_BLOCK, np.int32))
            if not h:
                continue
            h, owner, block = np.concatenate(h), np.concatenate(owner), np.concatenate(block)
            part = (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)
            rows = [(p, *c) for p, c in _parted(part, h, owner, block)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                    names=["fragment", "terms", "owners", "blocks"])
    return map_batches(vecs.select("k", "terms", "kind"), run,
                       "fragment int, terms binary, owners binary, blocks binary")


def weighted(counts: DataFrame, asked: DataFrame, total: int) -> DataFrame:
    """block, owners, terms, weights: query terms with their weight, by block of queries."""
    def run(batches):
        def close(rows):
            h = np.concatenate([np.frombuffer(t, np.uint64) for _, t, _, o, _ in rows if o is None] or
                               [np.zeros(0, np.uint64)])
            n = np.concatenate([np.frombuffer(c, np.int64) for _, _, c, o, _ in rows if o is None] or
                               [np.zeros(0, np.int64)])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
            h, n = h[start], np.add.reduceat(n, start) if len(start) else n
            for _, t, _, o, block in rows:
                if o is not None:
                    terms, owner = np.frombuffer(t, np.uint64), np.frombuffer(o, np.int64)
                    df = n[np.searchsorted(h, terms)].astype(np.float64)
                    weight = np.log(1 + (total - df + 0.5) / (df + 0.5))
                    for p, c in _parted(np.frombuffer(block, np.int32), owner, terms, weight):
                        yield (p, *c)
        now, held = None, []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[0] != now and held:
                    yield from _block_rows(close(held))
                    held = []
                now = r[0]
                held.append(r)
        if held:
            yield from _block_rows(close(held))
    none = F.lit(None).cast("binary")
    both = counts.select("fragment", "terms", "counts", none.alias("owners"), none.alias("blocks")).unionAll(
        asked.select("fragment", "terms", none.alias("counts"), "owners", "blocks"))
    dealt = both.repartition("fragment").sortWithinPartitions("fragment")
    return map_batches(dealt, run, "block int, owners binary, terms binary, weights binary")


def _block_rows(rows):
    cols = list(zip(*rows, strict=True))
    if cols:
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                         names=["block", "owners", "terms", "weights"])


class Shard:
    """Inverted index of some documents; those beside each other fall into one block."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: list, counts: list, mean: float):
        self.ids, n = ids, len(ids)
        sizes = np.array([len(t) for t in terms], np.int64)
        h = np.concatenate(terms)
        tf = np.concatenate(counts).astype(np.float64)
        # Places are dealt so that the first documents of all blocks come first, then the second ones:
        # greatest values of blocks are then taken over whole rows.
        self.blocks = -(-n // BLOCK)
        self.wide = self.blocks * BLOCK
        number = np.arange(n, dtype=np.int32)
        place = number % BLOCK * self.blocks + number // BLOCK
        self.doc = np.zeros(self.wide, np.int32)
        self.doc[place] = number
        doc = np.repeat(number, sizes)
        norm = K1 * (1 - B + B * lengths / mean)
        impact = tf * (K1 + 1) / (tf + norm[doc])
        self.doc_cut = np.concatenate([[0], np.cumsum(sizes)])
        self.doc_impact = impact
        order = np.argsort(h, kind="stable")
        h = h[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        self.terms = h[start]
        self.start, self.size = start, np.diff(start, append=len(h))
        self.doc_terms = np.empty(len(h), np.int32)
        self.doc_terms[order] = np.repeat(np.arange(len(start), dtype=np.int32), self.size)
        # Weights are those of the blocks of queries so far, and what postings add has them in it.
        self.weight, self.asked = np.ones(len(start)), np.zeros(len(start), bool)
        # A posting is its place and what it adds, 4 bytes each, so that both are fetched at once.
        self.postings = np.empty(len(h), np.int64)
        at, self.adds = self.postings.view(np.int32)[::2], self.postings.view(np.float32)[1::2]
        at[:], self.adds[:] = place[doc[order]], impact[order]
        self.most = np.maximum.reduceat(self.adds, start).astype(np.float64) if len(start) else np.zeros(0)
        common = np.flatnonzero(self.size > max(64, n // 40))
        common = common[np.argsort(-self.size[common], kind="stable")][:ROW_CELLS // max(1, self.wide)]
        self.row_of = np.full(len(self.terms), -1, np.int32)
        self.row_of[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.wide), np.float32)
        for r, t in enumerate(common.tolist()):
            a, z = start[t], start[t] + self.size[t]
            self.rows[r, at[a:z]] = self.adds[a:z]
        self.block_max = self.rows.reshape(len(common), BLOCK, self.blocks).max(axis=1)

    def search(self, asked: tuple, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put this shard's results among the best k so far of a block of queries (score -1: none)."""
        sizes, places, terms, weights = asked
        if not len(self.terms):
            return
        k, queries = ids.shape[1], len(sizes)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        have = self.terms[at] == terms
        self._weigh(at[have], weights[have])
        here = have[places]
        owner, places = np.repeat(np.arange(queries), sizes)[here], places[here]
        n = np.bincount(owner, minlength=queries)
        # All that is added is above 0, so sums in single precision are off by a part of themselves that
        # grows with their terms.
        err = 2.4e-7 * (n + 4)
        most = np.bincount(owner, self.most[at][places], minlength=queries)
        live = np.flatnonzero((n > 0) & (most >= _low(scores[:, -1], err)))
        if not len(live):
            return
        # A term is summed by the matrix product where that costs less than adding its postings.
        added = np.bincount(places, minlength=len(terms)) * self.size[at]
        dense = np.flatnonzero(have & (self.row_of[at] >= 0) & (added * ADD > len(live) * self.wide))
        column = np.full(len(terms), -1, np.int32)
        column[dense] = np.arange(len(dense))
        dense = self.row_of[at[dense]]
        line = np.full(queries, -1)
        line[live] = np.arange(len(live))
        of, line = column[places], line[owner]
        grid = np.zeros((len(live), len(dense)), np.float32)
        mine = np.flatnonzero((of >= 0) & (line >= 0))
        grid[line[mine], of[mine]] = weights[places[mine]]
        rare = np.flatnonzero((of < 0) & (line >= 0))
        sums = self._added(line[rare], at[places[rare]], len(live))
        cols, err, before = np.arange(self.wide), err[live], scores[live, -1]
        # The greatest sums of blocks belong to different documents, so their k-th is a bound.
        peak = sums.reshape(len(live), BLOCK, -1).max(axis=1)
        floor = _low(np.maximum(before, _kth(peak, k)), err)
        if len(dense):
            reach = grid @ self.block_max[dense] + peak
            near = np.flatnonzero((reach >= floor[:, None]).any(axis=0))
            if len(near) < 0.9 * self.blocks:
                cols = (np.arange(BLOCK)[:, None] * self.blocks + near).ravel()
                sums = sums[:, cols]
            sums += grid @ (self.rows[dense] if len(cols) == self.wide else self.rows[dense[:, None], cols])
            peak = sums.reshape(len(live), BLOCK, -1).max(axis=1)
            floor = np.maximum(floor, _low(_kth(peak, k), err))
        # Weights and impacts are above 0, so a sum is 0 only where no term is shared.
        found = (peak >= floor[:, None]) & (peak > 0)
        sums = sums.reshape(len(live), BLOCK, -1)
        edge = np.searchsorted(owner, np.arange(queries + 1)).tolist()
        for i in np.flatnonzero(found.any(axis=1)).tolist():
            near = np.flatnonzero(found[i])
            value = sums[i][:, near]
            r, c = np.nonzero((value >= floor[i]) & (value > 0))
            value, cand = value[r, c], cols[r * sums.shape[2] + near[c]]
            if len(cand) > k:
                cand = cand[value >= _low(_kth(value[None], k), err[i])]
            q = live[i]
            docs = self.doc[cand]
            new = np.concatenate([ids[q], self.ids[docs]])
            exact = np.concatenate([scores[q], self._exact(docs, at[places[edge[q]:edge[q + 1]]])])
            best = np.lexsort((new, -exact))[:k]
            ids[q], scores[q] = new[best], exact[best]

    def _weigh(self, t: np.ndarray, weights: np.ndarray) -> None:
        """Put the weights of terms into what their postings add."""
        new = self.weight[t] != weights
        t, weights = t[new], weights[new]
        for own in np.split(np.arange(len(t)), np.flatnonzero(np.diff(np.cumsum(self.size[t]) // PIECE)) + 1):
            size = self.size[t[own]]
            self.adds[_ranges(self.start[t[own]], size)] *= np.repeat(weights[own] / self.weight[t[own]], size)
        self.most[t] *= weights / self.weight[t]
        self.weight[t] = weights

    def _added(self, line: np.ndarray, t: np.ndarray, lines: int) -> np.ndarray:
        """Per line and place the sum of what the postings of the line's terms add; lines are in order."""
        sums = np.zeros((lines, self.wide), np.float32)
        start, size = self.start[t], self.size[t]
        cut = np.searchsorted(line, np.arange(lines + 1))
        ends = np.concatenate([[0], np.cumsum(size)])[cut].tolist()
        cut = cut.tolist()
        a = 0
        while a < lines:  # as many lines at a time as stay in the processor's cache
            z = a + 1
            while z < lines and ends[z + 1] - ends[a] <= PIECE:
                z += 1
            own = slice(cut[a], cut[z])
            found = self.postings[_ranges(start[own], size[own])].view(np.int32)
            at = np.repeat(np.arange(a, z) * self.wide, np.diff(ends[a:z + 1]))
            at += found[::2]
            np.add.at(sums.reshape(-1), at, found.view(np.float32)[1::2])
            a = z
        return sums

    def _exact(self, docs: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The scores in double precision, added up in order of hashes."""
        if not len(docs):
            return np.zeros(0)
        start = self.doc_cut[docs]
        size = self.doc_cut[docs + 1] - start
        of = _ranges(start, size)
        terms = self.doc_terms[of]
        self.asked[t] = True
        hit = np.flatnonzero(self.asked[terms])
        self.asked[t] = False
        # A candidate shares a term, so no range is empty.
        first = np.searchsorted(hit, np.cumsum(size) - size)
        return np.add.reduceat(self.doc_impact[of[hit]] * self.weight[terms[hit]], first).round(6)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] each, one after the other."""
    stop = np.cumsum(size)
    found = np.repeat(start - (stop - size), size)
    found += np.arange(len(found))
    return found


def _low(bound: np.ndarray, err: np.ndarray) -> np.ndarray:
    """What a sum reaches at least whose document is among the best k, if `bound` is a k-th exact score or sum:
    both sums may be off, and scores are rounded to 6 digits, equal ones told apart by id."""
    return bound * (1 - 2 * err) - 2e-6


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th greatest value (-1: there are fewer)."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -1.0)


class Kept:
    """Blocks of queries in a local file, and the best results so far in another: read once per shard."""

    def __init__(self, k: int):
        self.k, self.sizes = k, []
        self.blocks, self.best = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def add(self, r: dict) -> None:
        owners = np.frombuffer(r["owners"], np.int64)
        pickle.dump((r["block"], owners, *(np.frombuffer(r[c], t) for c, t in (
            ("sizes", np.int32), ("places", np.int32), ("terms", np.uint64), ("weights", np.float64)))), self.blocks)
        self.best.write(np.zeros((len(owners), self.k), np.int64).tobytes())
        self.best.write(np.full((len(owners), self.k), -1.0).tobytes())
        self.sizes.append(len(owners))

    def each(self):
        """block, owners, what is asked, ids and scores of the best; changes to these are kept."""
        self.blocks.seek(0)
        at = 0
        for n in self.sizes:
            block, owners, *asked = pickle.load(self.blocks)  # noqa: S301
            self.best.seek(at)
            ids, scores = (np.frombuffer(bytearray(self.best.read(n * self.k * 8)), t).reshape(n, self.k)
                           for t in (np.int64, np.float64))
            yield block, owners, asked, ids, scores
            self.best.seek(at)
            self.best.write(ids.tobytes())
            self.best.write(scores.tobytes())
            at += n * self.k * 16

    def search(self, docs: list, mean: float) -> None:
        """Search a shard of documents and forget them."""
        if self.sizes:
            ids, n, t, c = zip(*docs, strict=True)
            docs.clear()
            place = Shard(np.array(ids), np.array(n), t, c, mean)
            del ids, n, t, c
            for _, _, asked, ids, scores in self.each():
                place.search(asked, ids, scores)
        docs.clear()

    def found(self):
        for block, owners, _, ids, scores in self.each():
            yield _packed(block, owners, ids, scores)

    def close(self) -> None:
        self.blocks.close()
        self.best.close()


def top(docs: DataFrame, is_query: Column, k: int = TOP, id_col: str = "doc_id",
        text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """query_id, doc_id, rank, score: the k best documents of each query."""
    # The term vectors are larger than they are dear, so each use makes them anew.
    vecs = vectors(docs, is_query, id_col, text_col)
    size = F.floor(F.log2(F.octet_length("terms") / 8 + 1) * 2).cast("int")
    words = stash(vecs.groupBy("word", size.alias("size")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum(F.octet_length("terms") / 8).alias("terms"),
        F.sum(F.col("query").cast("long")).alias("queries")))
    total, n, terms = (x or 0 for x in words.agg(F.sum("docs"), F.sum("n"), F.sum("terms")).first())
    mean = max(1.0, n / max(1, total))
    fragments = max(1, -(-int(terms) // FRAGMENT))
    shards = max(1, -(-total // shard), -(-int(terms) // SHARD_TERMS))
    # Documents are of a kind if they are about as long and have the same most frequent word, which tells
    # languages apart; rarer words count as one.
    often = [r["word"] for r in words.where("word is not null").groupBy("word").agg(F.sum("docs").alias("docs"))
             .orderBy(F.desc("docs"), "word").limit(WORDS).collect()]
    place = F.coalesce(F.array_position(F.lit(often).cast("array<long>"), F.col("word")), F.lit(0)).cast("int")
    spans, asked = {}, 0
    for kind, count in (words.groupBy((place * 64 + F.col("size")).alias("kind")).agg(F.sum("queries"))
                        .orderBy("kind").collect()):
        spans[kind] = asked, count
        asked += count
    # A group is a task's shards; each group costs one copy of the queries, so they are as many as cores.
    groups = min(shards, docs.sparkSession.sparkContext.defaultParallelism)
    # Queries are numbered by a hash that tells rows with the same id and another text apart.
    queries = (vectors(docs.where(is_query), F.lit(True), id_col, text_col)
               .select(F.xxhash64("id", "terms").alias("k"), "id", "terms", (place * 64 + size).alias("kind")))
    block_of = stash(weighted(frequencies(vecs, fragments), query_terms(queries, fragments, spans), total))
    per_block = stash(block_of.groupBy("block").applyInArrow(_compact, _BLOCK))
    asks = per_block.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).alias("shard"),
                            "block", "owners", "sizes", "places", "terms", "weights")
    # The blocks of queries of a group come first, then some documents of all kinds, which give first bounds for
    # all queries, then the others by kind.
    mixed = F.pmod(F.xxhash64("terms", "id"), F.lit(MIXED)) == 0 if shards > groups else F.lit(False)
    index = vecs.select(F.pmod(F.xxhash64("id", "terms"), F.lit(groups)).cast("int").alias("group"),
                        F.when(mixed, 0).otherwise(place * 64 + size + 1).alias("shard"),
                        "id", "n", "terms", "counts")
    dealt = (index.unionByName(asks, allowMissingColumns=True).repartitionById(groups, "group")
             .sortWithinPartitions("group", "shard", "block"))

    def run(batches):
        kept, group, kind, held, terms = None, None, -1, [], 0
        try:
            for b in batches:
                for r in b.to_pylist():
                    if held and (r["group"] != group or len(held) >= shard or terms >= SHARD_TERMS
                                 or kind == 0 < r["shard"]):
                        kept.search(held, mean)
                        terms = 0
                    if r["group"] != group:
                        if kept:
                            yield from kept.found()
                            kept.close()
                        kept, group = Kept(k), r["group"]
                    kind = r["shard"]
                    if kind < 0:
                        kept.add(r)
                    else:
                        held.append((NO_ID if r["id"] is None else r["id"], r["n"],
                                     np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int32)))
                        terms += len(held[-1][2])
            if held:
                kept.search(held, mean)
            if kept:
                yield from kept.found()
        finally:
            if kept:
                kept.close()

    def merge(batches):
        now, held = None, None
        for b in batches:
            for r in b.to_pylist():
                owners, found, score = (np.frombuffer(r[c], t) for c, t in (
                    ("owners", np.int64), ("found", np.int64), ("score", np.float64)))
                part = owners, found.reshape(-1, k), score.reshape(-1, k)
                if r["block"] != now:
                    if held is not None:
                        yield _listed(*held)
                    now, held = r["block"], part
                else:
                    held = owners, *_best(np.concatenate([held[1], part[1]], axis=1),
                                          np.concatenate([held[2], part[2]], axis=1), k)
        if held is not None:
            yield _listed(*held)

    found = map_batches(dealt, run, "block int, owners binary, found binary, score binary")
    best = map_batches(found.repartition("block").sortWithinPartitions("block"), merge,
                       "k long, doc_id long, rank int, score double")
    names = queries.select("k", F.col("id").alias("query_id"))
    return best.join(names, "k").select("query_id", "doc_id", "rank", "score")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k entries of greatest score, then least id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _packed(block: int, owners: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (owners, ids, scores)]],
        names=["block", "owners", "found", "score"])


def _listed(owners: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    r, c = np.nonzero(scores >= 0)
    found = ids[r, c]
    return pa.RecordBatch.from_arrays(
        [pa.array(owners[r]), pa.array(found, mask=found == NO_ID), pa.array((c + 1).astype(np.int32)),
         pa.array(scores[r, c])], names=["k", "doc_id", "rank", "score"])


_BLOCK = "block int, owners binary, sizes binary, places binary, terms binary, weights binary"


def _compact(table: pa.Table) -> pa.Table:
    """A block of queries with each different term once: per query the places of its terms."""
    cols = [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in
            (("owners", np.int64), ("terms", np.uint64), ("weights", np.float64))]
    order = np.lexsort((cols[1], cols[0]))
    owner, term, weight = (c[order] for c in cols)
    new = np.append(True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1]))
    owner, term, weight = owner[new], term[new], weight[new]
    terms, first, places = np.unique(term, return_index=True, return_inverse=True)
    owners, sizes = np.unique(owner, return_counts=True)
    return pa.table({"block": table.column("block").slice(0, 1), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in (
        ("owners", owners), ("sizes", sizes.astype(np.int32)), ("places", places.astype(np.int32)),
        ("terms", terms), ("weights", weight[first]))}})
