"""Exact removal of repeated byte strings with a run-length index.

A byte goes if it is covered by a string of `L` bytes that also starts anywhere else, in the same
text or another.

1. Anchors. Of the `K`-byte strings in each run of `L` bytes the one of least hash (leftmost on ties)
   is their anchor, so equal runs have equal anchors at equal places. An anchor's context holds
   the runs of `L` bytes that have it. Map tasks send anchors, packed, by range of their hash; a text is sent
   once per task however often it is there.
2. Equal contexts of equal anchors cover each other as they stand. Anchors that occur once go no
   further. Only anchors with different contexts need their bytes compared.
3. Those contexts are dealt by anchor into buckets of bounded size. A bucket builds the run-compressed
   Burrows-Wheeler transform of its texts, with the suffixes at both ends of each run and their common
   prefix with the suffix beyond. From these samples the matching statistics stream along the text:
   away from a sample the longest match elsewhere is one less at each step. Positions with `L` or more
   are marked. Overlapping contexts of one text are one text there, so a match is always two places.
4. An anchor with more than `HOT` different contexts is first split by the place of the runs around
   it: halves share fewer bytes with fewer others, and after eight halvings runs are equal or not.

Texts that are there more than once are removed whole, if they have `L` bytes.

Defined cases: null is the empty text; texts under `L` bytes lose nothing; rows that share an id are
judged by their texts; bytes are cut without regard to characters, so what is kept is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import P, P_INV, map_batches, mix, powers, text_bytes
from eventide.storage import stash

L = 200
K = 32
CHUNK = 1 << 18
# Anchors that a task holds before it sends them, bytes of text whose anchors make one range, contexts
# of an anchor in one bucket, bytes of a bucket.
RANGE = 400_000
RANGE_BYTES = 20 << 20
HOT = 3_000
BUCKET = 1 << 20
PAIRS = 1 << 14
_POSITION_BITS = np.uint64(28)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(P, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((sums[hi] - sums[lo]) * powers(P_INV, len(sums))[lo] + (hi - lo).astype(np.uint64))


def anchors(data: np.ndarray, offs: np.ndarray, size: int = L, k: int = K):
    """row, position, hash, context hash, bytes before the anchor in the context, context length."""
    n, w = len(data), size - k + 1
    empty = np.zeros(0, np.int64)
    if n < size:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    sums = prefix_hashes(data)
    grams = np.arange(n - k + 1)
    h = range_hashes(sums, grams, grams + k)
    key = (h >> _POSITION_BITS << _POSITION_BITS) | grams.astype(np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:len(key) - span], key[span:])
        span *= 2
    if w > span:
        key = np.minimum(key[:len(key) - (w - span)], key[w - span:])
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(key)]
    starts = np.flatnonzero(np.arange(len(key)) + size <= offs[rows + 1])
    if not len(starts):
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    of = (key[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    at, lo = of[first], starts[first]
    hi = starts[np.append(first[1:], len(of)) - 1] + size
    row = rows[lo]
    around = range_hashes(sums, lo, hi) ^ mix((at - lo).astype(np.uint64))
    return row, at - offs[row], h[at], around, at - lo, hi - lo


def text_pieces(column: pa.Array, size: int = L):
    """(first row, rows, bytes, offsets, place of the piece in its text): runs of whole texts, and
    longer texts in pieces that share size - 1 bytes."""
    data, offs = text_bytes(column)
    lo, n, limit = 0, len(offs) - 1, 1 << 22
    while lo < n:
        hi = min(n, max(int(np.searchsorted(offs, offs[lo] + CHUNK, side="right")) - 1, lo + 1))
        if hi == lo + 1 and offs[hi] - offs[lo] > limit:
            for a in range(int(offs[lo]), int(offs[hi]) - size + 1, limit - size + 1):
                z = min(a + limit, int(offs[hi]))
                yield lo, 1, data[a:z], np.array([0, z - a]), a - int(offs[lo])
        else:
            yield lo, hi - lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], 0
        lo = hi


_POST = [("label", np.int64), ("h", np.uint64), ("around", np.uint64), ("at", np.int64),
         ("before", np.int16), ("size", np.int16)]


def _concat(rows: list, names: list) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, (_, t) in enumerate(names)]


def postings(texts: DataFrame, ranges: int) -> DataFrame:
    """part and the packed anchors of a map task in that range of hashes."""
    def run(batches):
        seen: set = set()
        held, n_held = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            part = (((cols[1] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, cols = part[order], [c[order] for c in cols]
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            cuts = list(zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[edge], pa.int32()),
                 *[pa.array([c[a:z].astype(t).tobytes() for a, z in cuts], pa.binary())
                   for c, (_, t) in zip(cols, _POST, strict=True)]],
                names=["part", *[n for n, _ in _POST]])

        for b in batches:
            label = b.column(0).to_numpy()
            fresh = np.zeros(len(label), bool)
            for i, x in enumerate(label.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            for lo, n, data, offs, shift in text_pieces(b.column(1)):
                row, at, h, around, before, size = anchors(data, offs)
                use = fresh[lo + row]
                held.append([x[use] for x in (label[lo + row], h, around, at + shift, before, size)])
                n_held += int(use.sum())
                if n_held >= RANGE:
                    yield flush()
                    held, n_held = [], 0
        if n_held:
            yield flush()
    return map_batches(texts.select("label", "t"), run,
                       "part int, " + ", ".join(f"{n} binary" for n, _ in _POST))


_FOUND = "label long, h long, around long, first long, before int, size int, same long, others long"


def repeated(parts: DataFrame) -> DataFrame:
    """Places whose anchor occurs elsewhere: context place and size, `same` (places with this
    context) and `others` (different contexts of the anchor). Of equal contexts that meet different
    ones, each is listed; the one with the least place is the one to compare."""
    def run(batches):
        def close(rows):
            label, h, around, at, before, size = _concat(rows, _POST)
            order = np.lexsort((at, label, around, h))
            label, h, around, at, before, size = (x[order] for x in
                                                  (label, h, around, at, before, size))
            new = np.ones(len(h), bool)  # a text comes from each map task that has a copy
            new[1:] = ((h[1:] != h[:-1]) | (around[1:] != around[:-1]) | (label[1:] != label[:-1])
                       | (at[1:] != at[:-1]))
            label, h, around, at, before, size = (x[new] for x in (label, h, around, at, before, size))
            head = np.append(True, h[1:] != h[:-1])
            sub = np.append(True, (h[1:] != h[:-1]) | (around[1:] != around[:-1]))
            def spread(x, starts):
                at_ = np.flatnonzero(starts)
                return np.repeat(x, np.diff(at_, append=len(starts)))
            count = np.diff(np.flatnonzero(head), append=len(h))
            kinds = np.add.reduceat(sub.astype(np.int64), np.flatnonzero(head)) if len(h) else count
            same = np.diff(np.flatnonzero(sub), append=len(h))
            keep = spread(count, head) > 1
            kinds, same = spread(kinds, head), spread(same, sub)
            cols = [label, h.view(np.int64), around.view(np.int64), at - before,
                    before.astype(np.int32), size.astype(np.int32), same, kinds]
            cols.append(np.where(sub, 1, 0))
            return pa.RecordBatch.from_arrays(
                [pa.array(c[keep]) for c in cols],
                names=["label", "h", "around", "first", "before", "size", "same", "others", "lead"])

        now, held = None, []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[0] != now and held:
                    yield close(held)
                    held = []
                now = r[0]
                held.append(r[1:])
        if held:
            yield close(held)
    dealt = parts.repartition("part").sortWithinPartitions("part")
    return map_batches(dealt, run, _FOUND + ", lead long")


def suffix_array(code: np.ndarray, ends: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Suffixes in order; a suffix ends with its region, and regions end in order of their number.
    `code` is byte + 1; `ends` and `region` give the end and number of each position's region."""
    n = len(code)
    left = ends - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        at = np.minimum(np.arange(n) + k, n - 1)
        key = (key << 9) | np.where(k < left, code[at], 0)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    rank = np.zeros(n, np.int64)
    head = np.append(True, ordered[1:] != ordered[:-1])
    slot = np.flatnonzero(head)
    rank[sa] = np.repeat(slot, np.diff(slot, append=n))
    h = 7
    while True:
        # Only suffixes that share their rank are ordered further, within their slots.
        tied = ~head
        tied[:-1] |= ~head[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            return sa
        act = sa[where]
        nxt = np.where(left[act] > h, rank[np.minimum(act + h, n - 1)], -1 - region[act])
        order = np.lexsort((nxt, rank[act]))
        act, nxt, old = act[order], nxt[order], rank[act][order]
        sa[where] = act
        fresh = np.append(True, (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1]))
        head[where] = fresh
        slot = np.flatnonzero(fresh)
        rank[act] = where[np.repeat(slot, np.diff(slot, append=len(act)))]
        h *= 2


def common_prefix(code: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, pair by pair."""
    if len(a) > PAIRS:
        return np.concatenate([common_prefix(code, left, a[lo:lo + PAIRS], b[lo:lo + PAIRS])
                               for lo in range(0, len(a), PAIRS)])
    out = np.zeros(len(a), np.int64)
    most = np.minimum(left[a], left[b])
    act = np.flatnonzero(most > 0)
    step = np.arange(16)
    while len(act):
        x, y, d = a[act], b[act], out[act]
        at = d[:, None] + step
        inside = at < most[act][:, None]
        top = len(code) - 1
        same = inside & (code[np.minimum(x[:, None] + at, top)] == code[np.minimum(y[:, None] + at, top)])
        good = np.where(same.all(axis=1), len(step), same.argmin(axis=1))
        out[act] += good
        act = act[good == len(step)]
    return out


class RunIndex:
    """Run-compressed transform of some texts with sampled run ends."""

    def __init__(self, code: np.ndarray, cuts: np.ndarray):
        """`code`: bytes + 1 of all texts one after the other; `cuts`: len + 1 offsets."""
        size = np.diff(cuts)
        region = np.repeat(np.arange(len(size)), size)
        ends = np.repeat(cuts[1:], size)
        left = ends - np.arange(len(code))
        sa = suffix_array(code, ends, region)
        before = np.where(sa > np.repeat(cuts[:-1], size)[sa], code[sa - 1], -1 - region[sa])
        head = np.append(True, before[1:] != before[:-1])
        tail = np.append(head[1:], True)
        self.n = len(code)
        self.run_symbol = before[head]
        self.run_length = np.diff(np.flatnonzero(head), append=self.n)
        up, down = np.flatnonzero(head), np.flatnonzero(tail)
        self.first = self._sample(sa[up], common_prefix(code, left, sa[up[1:]], sa[up[1:] - 1]), 0)
        self.last = self._sample(sa[down], common_prefix(code, left, sa[down[:-1]], sa[down[:-1] + 1]), 1)

    @staticmethod
    def _sample(at: np.ndarray, shared: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled suffixes in text order and their common prefix beyond the run."""
        shared = np.append(shared, 0) if end else np.append(0, shared)
        order = np.argsort(at)
        return at[order], shared[order]

    def matches(self) -> np.ndarray:
        """For each place the longest string there that also starts elsewhere."""
        best = np.zeros(self.n, np.int64)
        for at, shared in (self.first, self.last):
            run = np.diff(at, append=self.n)
            value = np.repeat(shared + at, run) - np.arange(at[0], self.n)
            np.maximum(best[at[0]:], value, out=best[at[0]:])
        return best


def marked(label, first, blobs, size: int = L):
    """label, from, to: ranges covered by long matches among the texts of a bucket. Contexts of one
    label that overlap or touch are joined first."""
    order = np.lexsort((first, label))
    texts, owner, start = [], [], []
    for i in order.tolist():
        x, f, t = label[i], first[i], blobs[i]
        if owner and owner[-1] == x and f <= start[-1] + len(texts[-1]):
            texts[-1] += t[max(0, start[-1] + len(texts[-1]) - f):]
        else:
            owner.append(x)
            start.append(f)
            texts.append(bytearray(t))
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    code = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    long = np.flatnonzero(RunIndex(code, cuts).matches() >= size)
    if not len(long):
        return [], [], []
    row = np.searchsorted(cuts, long, side="right") - 1
    new = np.append(True, (np.diff(long) > size) | (np.diff(row) != 0))
    begin, end = long[new], long[np.append(new[1:], True)] + size
    row = row[new]
    shift = np.array(start)[row] - cuts[row]
    return [owner[r] for r in row], (begin + shift).tolist(), (end + shift).tolist()


_TEXTS = "label long, h long, around long, first long, before int, same long, bytes binary"


def context_bytes(places: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of contexts, cut from one text of each label."""
    lists = places.groupBy("label").agg(F.collect_list(F.struct(
        "h", "around", "first", "before", "size", "same")).alias("c"))

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                out: dict = {c: [] for c in ("label", "h", "around", "first", "before", "same", "bytes")}
                for x, t, places_ in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    raw = t.encode()
                    for p in places_:
                        out["label"].append(x)
                        for c in ("h", "around", "first", "before", "same"):
                            out[c].append(p[c])
                        out["bytes"].append(raw[p["first"]:p["first"] + p["size"]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[c], k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(),
                     pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=list(out))
    return map_batches(texts.join(lists, "label").select("label", "t", "c"), cut, _TEXTS)


def indexed(contexts: DataFrame, size: int = L) -> DataFrame:
    """label, a, z: ranges that the run-length indexes of all buckets mark."""
    total = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def run(batches):
        def close(rows):
            out = marked(*zip(*rows, strict=True), size)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                              names=["label", "a", "z"])
        now, held = None, []
        for b in batches:
            for k, *r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != now and held:
                    yield close(held)
                    held = []
                now = k
                held.append(r)
        if held:
            yield close(held)
    dealt = (contexts.select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("k"), "label", "first", "bytes")
             .repartition("k").sortWithinPartitions("k"))
    return map_batches(dealt, run, "label long, a long, z long")


def halves(hot: DataFrame, size: int = L, k: int = K) -> DataFrame:
    """Contexts by half the places of the runs around the anchor: the anchor's hash becomes that of
    the bytes all runs of the half share, the context that of all their bytes. Column `span` holds
    the range of places (bytes of a run before the anchor)."""
    def run(batches):
        for b in batches:
            out: list = [[] for _ in range(9)]
            for x, h, first, before, blob, lo, hi in zip(*[c.to_pylist() for c in b.columns], strict=True):
                mid = (lo + hi) // 2
                for a, z in ((lo, mid), (mid + 1, hi)):
                    least, most = max(a, size - (len(blob) - before)), min(z, before)
                    if a > z or least > most:
                        continue
                    core = blob[before - a:before + size - z]
                    part = blob[before - most:before + size - least]
                    new = int.from_bytes(hashlib.blake2b(
                        b"%d %d %d " % (h, a, z) + core, digest_size=8).digest(), "little", signed=True)
                    ctx = int.from_bytes(hashlib.blake2b(
                        b"%d " % most + part, digest_size=8).digest(), "little", signed=True)
                    for c, v in zip(out, (x, new, ctx, first + before - most, most, part, a, z,
                                          len(part)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
                     pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                names=["label", "h", "around", "first", "before", "bytes", "lo", "hi", "size"])
    return map_batches(hot.select("label", "h", "first", "before", "bytes", "lo", "hi"), run,
                       "label long, h long, around long, first long, before int, bytes binary, "
                       "lo int, hi int, size int")


def compared(contexts: DataFrame, size: int = L, k: int = K, hot: int = HOT) -> DataFrame:
    """label, a, z of all matches among different contexts of an anchor."""
    rows = contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(size - k))
    out = []
    while True:
        kinds = rows.groupBy("h").agg(F.count_distinct("around").alias("n"))
        many = stash(kinds.where(F.col("n") > hot).select("h"))
        out.append(stash(indexed(stash(rows.join(many, "h", "left_anti")), size)))
        if many.isEmpty():
            break
        split = stash(halves(rows.join(many, "h", "left_semi"), size, k))
        equal = split.groupBy("h", "around").agg(F.count(F.lit(1)).alias("c"),
                                                 F.min(F.struct("label", "first")).alias("one"))
        out.append(split.join(equal.where("c > 1"), ["h", "around"]).select(
            "label", F.col("first").alias("a"), (F.col("first") + F.col("size")).alias("z")))
        open_ = equal.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        rows = stash(split.join(open_, "h", "left_semi").join(
            equal.select("h", "around", F.col("one.label").alias("label"),
                         F.col("one.first").alias("first")), ["h", "around", "label", "first"], "left_semi"))
    found = out[0]
    for x in out[1:]:
        found = found.unionAll(x)
    return found


def covered(texts: DataFrame, total: int, hot: int = HOT) -> DataFrame:
    """label, cut (ordered disjoint byte ranges to remove)."""
    ranges = max(1, -(-total // RANGE_BYTES))
    places = stash(repeated(postings(texts, ranges)))
    whole = places.where("same > 1").select("label", F.col("first").alias("a"),
                                            (F.col("first") + F.col("size")).alias("z"))
    open_ = places.where("others > 1 and lead = 1")
    one = texts.groupBy(F.col("label").alias("of")).agg(F.min("i").alias("least"))
    single = texts.join(one, (F.col("label") == F.col("of")) & F.col("i").eqNullSafe(F.col("least")), "left_semi")
    contexts = stash(context_bytes(open_, single).dropDuplicates(["h", "around"]))
    found = whole.unionAll(compared(contexts, hot=hot))
    return found.groupBy("label").agg(F.collect_list(F.struct("a", "z")).alias("cut"))


def union(ranges: list) -> list[tuple[int, int]]:
    out: list = []
    for r in sorted((r["a"], r["z"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True,
            hot: int = HOT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if `keep`, the kept bytes."""
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.withColumn("label", F.xxhash64("t"))
    size = texts.select("label", F.octet_length("t").cast("long").alias("n"))
    total = size.agg(F.sum("n")).first()[0] or 0
    copies = (size.where(F.col("n") >= L).groupBy("label", "n").agg(F.count(F.lit(1)).alias("c"))
              .where("c > 1").select("label", F.array(F.struct(F.lit(0).cast("long").alias("a"),
                                                               F.col("n").alias("z"))).alias("cut")))
    cuts = (covered(texts, total, hot).unionAll(copies).groupBy("label")
            .agg(F.flatten(F.collect_list("cut")).alias("cut")))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out: list = [[], [], [], [], []]
                for t, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, at, kept = t.encode(), 0, []
                    spans = union(cut or [])
                    for a, z in spans:
                        kept.append(raw[at:a])
                        at = z
                    rest = b"".join([*kept, raw[at:]])
                    for c, v in zip(out, (len(raw), len(raw) - len(rest), len(spans),
                                          hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        c.append(v)
                cols = [part.column(0), *[pa.array(c, pa.int64()) for c in out[:3]],
                        pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(cols[:5 + keep], names=names[:5 + keep])
    fields = [T.StructField(id_col, docs.schema[id_col].dataType),
              *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
              T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    joined = texts.join(cuts, "label", "left").select("i", "t", "cut")
    return map_batches(joined, run, T.StructType(fields[:5 + keep]))
