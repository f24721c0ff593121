"""Similarity join on word shingles by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct shingles of `n` words (of the whole
sequence, if it has fewer words). Documents with equal sets form one class and are joined as one.

1. The order of all hashes is cut into vertical fragments. Map tasks send each fragment the hashes
   of each class once, in order, packed as six bytes and the number of their class in three bytes
   (more from a million rows on); a fragment counts in how many classes each hash occurs. Hashes of
   a single class can be in no overlap and go no further. What a hash takes does not depend on the
   number of fragments.
2. A class with fewer shared hashes than a link needs drops out. Of the others, links must share one
   of the rarest `shared - needed + 1` hashes (prefix), which gives candidate pairs.
3. Candidates are counted by fragment: each class is cut into segments along the order of hashes,
   pairs meet segment by segment, and the partial overlaps are summed per pair.
4. In each group of classes with a common prefix hash the most central member is compared with the
   others first. Only members still in different components are compared further: pair by pair in
   small groups; in large ones, block by block within tasks that count overlaps by ranges of hashes
   and tell only which components meet. So a family of near copies costs about one comparison a
   member, and no group's pairs are written out.

Words are runs of other than white space, A-Z in lower case. Two documents link when
100 * common >= percent * union.

Defined cases: no text or no words gives an empty set, linked with nothing; texts that differ only in
case or white space are equal; null ids never become a component id if the component has another;
rows that share an id are compared by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.batches import LOWER, NOT_SPACE, Spans, chunks, map_batches, mix
from eventide.llm.components import components
from eventide.storage import stash

SHINGLE = 5
PERCENT = 80
# Hashes of one vertical fragment, and those a map task holds before it sends them.
FRAGMENT = 1_000_000
SEGMENTS = 4
# The first 16 bits of a hash are its slot. Fragments are runs of slots.
SLOTS = 1 << 16
# Up to how many members a group is compared pair by pair; sizes of blocks in larger ones.
SMALL = 48
ASKING, ASKED, COLUMNS = 128, 512, 4096
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all rows one after the other, ordered within a row; their row."""
    first, h = spans.windows(n)
    row = spans.row[first]
    short = np.flatnonzero((spans.per_row > 0) & (spans.per_row < n))
    for size in np.unique(spans.per_row[short]).tolist():
        at, whole = spans.windows(size)
        one = spans.per_row[spans.row[at]] == size
        row = np.concatenate([row, spans.row[at[one]]])
        h = np.concatenate([h, whole[one]])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def labels(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the label of its set (equal sets, equal labels), and the number of hashes."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ _SALT), out=sums[1:])
    edge = np.searchsorted(row, np.arange(rows + 1))
    size = np.diff(edge)
    return mix(sums[edge[1:]] - sums[edge[:-1]] + size.astype(np.uint64)).view(np.int64), size


def document_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_shingles, label (null for an empty set)."""
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                h, row = shingle_sets(Spans(data, offs, NOT_SPACE, LOWER), n)
                label, size = labels(h, row, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()),
                     pa.array(label, pa.int64(), mask=size == 0)], names=["i", "n", "label"])
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return map_batches(rows, run, "i long, n long, label long")


def changes(a: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal values begins."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return np.flatnonzero(new)


def runs(a: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last position of each run of equal values."""
    start = changes(a).tolist()
    return list(zip(start, [*start[1:], len(a)], strict=True)) if start else []


class ClassNumbers:
    """Numbers that stand for the labels of classes in fewer bytes, one for each label.

    A number is the first `bits` bits of its label; the few labels that share these with another are
    listed, and have the numbers after.
    """

    def __init__(self, bits: int, listed: np.ndarray):
        self.bits, self.listed = bits, np.sort(listed)
        self.width = -(-((1 << bits) + len(listed)).bit_length() // 8)

    def __call__(self, label: np.ndarray) -> np.ndarray:
        number = label.view(np.uint64) >> np.uint64(64 - self.bits)
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, label), len(self.listed) - 1)
            number = np.where(self.listed[at] == label, np.uint64(1 << self.bits) + at.astype(np.uint64), number)
        return number


def number_bits(count: int) -> int:
    """Bits of the whole bytes, but one, in which `count` labels have some 65,536 equal pairs or fewer."""
    return 8 * max(3, -(-(2 * max(1, count).bit_length() - 16) // 8)) - 1


def class_numbers(members: DataFrame, count: int) -> ClassNumbers:
    bits = number_bits(count)
    known = members.where("label is not null").select(
        "label", F.shiftrightunsigned("label", 64 - bits).alias("number"))
    shared = (known.groupBy("number").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
              .where("lo < hi").select("number"))
    listed = known.join(shared, "number", "left_semi").select("label").distinct().collect()
    return ClassNumbers(bits, np.array([r["label"] for r in listed], np.int64))


def slot_bounds(fragments: int) -> np.ndarray:
    """First slot of each fragment, and the end of the last."""
    return -(-np.arange(fragments + 1) * SLOTS // fragments)


def low_bytes(a: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of each number."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def from_bytes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def small_counts(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32)


def from_slots(counts: bytes, low: bytes, first: int, last: int) -> np.ndarray:
    """The hashes, in order, from how many there are in each slot and their other six bytes."""
    n = np.frombuffer(counts, np.uint8 if len(counts) == last - first else np.int32)
    return from_bytes(low, 6) | np.repeat(np.arange(first, last).astype(np.uint64) << np.uint64(48), n)


def cut_at(a: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the rows of `a` from each edge to the next."""
    width = a.itemsize * (a.shape[1] if a.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [
        None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a).reshape(-1))])


def postings(docs: DataFrame, text_col: str, n: int, fragments: int, number: ClassNumbers) -> DataFrame:
    """fragment, counts by slot, hashes, owners; labels, sizes: classes of a map task by vertical
    fragment. The label and size of a class go to one fragment only, told by its number.

    Each class is sent once per map task, whatever the number of its copies there.
    """
    def run(batches):
        seen: set = set()
        held: list = []
        n_held = 0
        bounds = slot_bounds(fragments)

        def flush():
            h = np.concatenate([x[0] for x in held])
            label, size = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            owner = np.repeat(number(label), size)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            counts = np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
            edge = np.concatenate([[0], np.cumsum(counts)])[bounds]
            part = (number(label) % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            label, size, part = label[order], size[order], part[order]
            of_part = np.searchsorted(part, np.arange(fragments + 1))
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(fragments), pa.int32()), cut_at(small_counts(counts), bounds),
                 cut_at(low_bytes(h, 6), edge), cut_at(low_bytes(owner, number.width), edge),
                 cut_at(label, of_part), cut_at(size.astype(np.int32), of_part)],
                names=["fragment", "counts", "hashes", "owners", "labels", "sizes"])
            return rows.filter(pa.array((np.diff(edge) > 0) | (np.diff(of_part) > 0)))

        for b in batches:
            for lo, hi, data, offs in chunks(b.column(0)):
                h, row = shingle_sets(Spans(data, offs, NOT_SPACE, LOWER), n)
                label, size = labels(h, row, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for k, (x, s) in enumerate(zip(label.tolist(), size.tolist(), strict=True)):
                    if s and x not in seen:
                        seen.add(x)
                        fresh[k] = True
                held.append((h[fresh[row]], label[fresh], size[fresh]))
                n_held += len(held[-1][0])
                if n_held >= FRAGMENT:
                    yield flush()
                    held, n_held = [], 0
        if n_held:
            yield flush()

    return map_batches(docs.select(F.col(text_col).alias("t")), run, "fragment int, counts binary, "
                       "hashes binary, owners binary, labels binary, sizes binary")


def shared_hashes(parts: DataFrame, fragments: int, number: ClassNumbers) -> DataFrame:
    """bucket, fragment, counts by slot, hashes, owners, freqs, large (those of 255 and more); labels,
    sizes: hashes of two classes or more, by bucket of the class number."""
    def run(batches):
        bounds = slot_bounds(fragments)

        def close(f, rows):
            h, own, label, size = (np.concatenate(x) for x in zip(*rows, strict=True))
            label, at = np.unique(label, return_index=True)
            size = size[at]
            order = np.lexsort((own, h))
            own, h = own[order], h[order]
            new = np.ones(len(h), bool)  # a class comes from each map task that has a copy
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            own, h = own[new], h[new]
            start = changes(h)
            freq = np.diff(start, append=len(h))
            freq = np.repeat(freq, freq)
            keep = freq > 1
            own, h, freq = own[keep], h[keep], freq[keep]
            to = (own % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            own, h, freq, to = own[order], h[order], freq[order], to[order]
            every = np.arange(fragments + 1)
            slots = int(bounds[f + 1] - bounds[f])
            counts = np.bincount(to * slots + (h >> np.uint64(48)).astype(np.int64) - bounds[f],
                                 minlength=fragments * slots)
            edge = np.searchsorted(to, every)
            large = freq >= 255
            mine = np.where(every > f, len(label), 0)
            out = pa.RecordBatch.from_arrays(
                [pa.array(every[:-1], pa.int32()), pa.array(np.full(fragments, f), pa.int32()),
                 cut_at(small_counts(counts), every * slots), cut_at(low_bytes(h, 6), edge),
                 cut_at(low_bytes(own, number.width), edge),
                 cut_at(np.minimum(freq, 255).astype(np.uint8), edge),
                 cut_at(freq[large].astype(np.int32), np.searchsorted(to[large], every)),
                 cut_at(label, mine), cut_at(size, mine)],
                names=["bucket", "fragment", "counts", "hashes", "owners", "freqs", "large", "labels", "sizes"])
            return out.filter(pa.array((np.diff(edge) > 0) | (np.diff(mine) > 0)))

        now, held = None, []
        for b in batches:
            for f, c, h, o, x, s in zip(*[col.to_pylist() for col in b.columns], strict=True):
                if f != now and held:
                    yield close(now, held)
                    held = []
                now = f
                held.append((from_slots(c, h, bounds[f], bounds[f + 1]), from_bytes(o, number.width),
                             np.frombuffer(x, np.int64), np.frombuffer(s, np.int32)))
        if held:
            yield close(now, held)

    dealt = parts.repartition("fragment").sortWithinPartitions("fragment")
    return map_batches(dealt, run, "bucket int, fragment int, counts binary, hashes binary, "
                       "owners binary, freqs binary, large binary, labels binary, sizes binary")


def candidates(shared: DataFrame, percent: int, fragments: int, number: ClassNumbers) -> DataFrame:
    """label, n, central, shared (hashes in order), prefix (rarest hashes): classes that can have a
    link. `central` is the mean number of classes that have a hash of the set: in a family of near
    copies it is greatest for the text the others were made from."""
    def run(batches):
        bounds = slot_bounds(fragments)

        def close(rows):
            h, own, freq, known, known_size = (np.concatenate(x) for x in zip(*rows, strict=True))
            numbers = number(known)
            order = np.argsort(numbers)
            at = order[np.searchsorted(numbers[order], own)]
            own, size = known[at], known_size[at]
            order = np.lexsort((h, freq, own))
            own, size, h, freq = own[order], size[order], h[order], freq[order]
            out: list = [[], [], [], [], []]
            for a, z in runs(own):
                needed = -(-percent * int(size[a]) // 100)
                if z - a >= needed:
                    for c, v in zip(out, (int(own[a]), int(size[a]), float(freq[a:z].sum() / size[a]),
                                          np.sort(h[a:z]).tobytes(), h[a:z - needed + 1].view(np.int64)), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.float64()), pa.array(out[3], pa.binary()),
                 pa.array(out[4], pa.list_(pa.int64()))],
                names=["label", "n", "central", "shared", "prefix"])

        now, held = None, []
        for b in batches:
            for k, f, c, h, o, q, m, x, s in zip(*[col.to_pylist() for col in b.columns], strict=True):
                if k != now and held:
                    yield close(held)
                    held = []
                now = k
                freq = np.frombuffer(q, np.uint8).astype(np.int64)
                freq[freq == 255] = np.frombuffer(m, np.int32)
                held.append((from_slots(c, h, bounds[f], bounds[f + 1]), from_bytes(o, number.width), freq,
                             np.frombuffer(x, np.int64), np.frombuffer(s, np.int32)))
        if held:
            yield close(held)

    dealt = shared.repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, run, "label long, n long, central double, shared binary, prefix array<long>")


def segments(sets: DataFrame, parts: int) -> DataFrame:
    """label, segment, hashes: the sets cut along the order of hashes."""
    bounds = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)

    def run(batches):
        for b in batches:
            label, seg, blob = [], [], []
            for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(s, np.uint64)
                for k, piece in enumerate(np.split(h, np.searchsorted(h, bounds))):
                    if len(piece):
                        label.append(x)
                        seg.append(k)
                        blob.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int64()), pa.array(seg, pa.int32()),
                 pa.array(blob, pa.binary())], names=["label", "segment", "hashes"])
    return map_batches(sets.select("label", "shared"), run, "label long, segment int, hashes binary")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """a, b, common: partial overlaps by segment, summed per pair."""
    def run(batches):
        for b in batches:
            _, _, x, y = b.columns
            n = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), True))
                 for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["a", "b", "n"])
    left = pairs.join(cut.select(F.col("label").alias("a"), "segment", F.col("hashes").alias("x")), "a")
    both = left.join(cut.select(F.col("label").alias("b"), "segment", F.col("hashes").alias("y")),
                     ["b", "segment"])
    counted = map_batches(both.select("a", "b", "x", "y"), run, "a long, b long, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("common"))


def verified(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb and more) that are links."""
    return overlaps(pairs.select("a", "b"), cut).join(pairs, ["a", "b"]).where(
        F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)


def _sizes_fit(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def block_overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Common hashes of each set of one list with each of the other, counted by ranges of hashes."""
    total = np.zeros((len(one), len(two)), np.int64)
    h, at = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in [*one, *two]])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, len(h), COLUMNS):
        a, z = np.searchsorted(at, (lo, lo + COLUMNS))
        grid = np.zeros((len(one) + len(two), min(COLUMNS, len(h) - lo)), np.float32)
        grid[row[a:z], at[a:z] - lo] = 1
        total += (grid[:len(one)] @ grid[len(one):].T).astype(np.int64)
    return total


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: roots that links join in large groups, compared in blocks of bounded size.

    Members of a group's largest component need no comparison with each other. The others are cut
    into blocks of `ASKING`, all members into blocks of `ASKED`, and each pair of blocks is a task's
    matter: it counts overlaps in memory and tells only which roots belong together.
    """
    main = (rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main")))
    out = rows.join(main, "h").withColumn("outside", F.col("root") != F.col("main"))
    by_h = Window.partitionBy("h").orderBy("outside", "rank")
    out = out.withColumn("k", F.row_number().over(by_h) - 1).withColumn(
        "first", F.min(F.when(F.col("outside"), F.col("k"))).over(Window.partitionBy("h")))
    out = out.join(sets.select("label", "shared"), "label").withColumns({
        "i": F.floor((F.col("k") - F.col("first")) / ASKING), "j": F.floor(F.col("k") / ASKED),
        "last_i": F.floor((F.col("members") - 1 - F.col("first")) / ASKING),
        "last_j": F.floor((F.col("members") - 1) / ASKED)})
    keep = ["h", "root", "n", "shared"]
    asking = out.where("outside").select(*keep, "i", F.explode(F.sequence(
        F.lit(0).cast("long"), "last_j")).alias("j"), F.lit(0).alias("side"))
    asked = out.select(*keep, F.explode(F.sequence(F.lit(0).cast("long"), "last_i")).alias("i"), "j",
                       F.lit(1).alias("side"))

    def run(batches):
        def close(rows):
            sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
            if not all(sides):
                return
            n, root = ([np.array([r[k] for r in side]) for side in sides] for k in (2, 1))
            common = block_overlaps(*[[np.frombuffer(r[3], np.uint64) for r in side] for side in sides])
            union = n[0][:, None] + n[1][None, :] - common
            x, y = np.nonzero((common * 100 >= union * percent) & (root[0][:, None] != root[1][None, :]))
            told = set(zip(root[0][x].tolist(), root[1][y].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)],
                                             names=["a", "b"])
        now, held = None, []
        for b in batches:
            for h, i, j, *r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (h, i, j) != now and held:
                    yield from close(held)
                    held = []
                now = (h, i, j)
                held.append(r)
        if held:
            yield from close(held)
    columns = ["h", "i", "j", "side", "root", "n", "shared"]
    dealt = (asking.select(columns).unionAll(asked.select(columns)).repartition("h", "i", "j")
             .sortWithinPartitions("h", "i", "j"))
    return map_batches(dealt, run, "a long, b long")


def linked_classes(docs: DataFrame, text_col: str, total: int, number: ClassNumbers, n: int,
                   percent: int) -> DataFrame:
    """node, root: classes with a link, and the least class of their component."""
    fragments = max(1, -(-total // FRAGMENT))
    parts = postings(docs, text_col, n, fragments, number)
    sets = stash(candidates(shared_hashes(parts, fragments, number), percent, fragments, number))
    cut = stash(segments(sets, SEGMENTS))
    in_group = Window.partitionBy("h").orderBy(F.col("central").desc(), "label")
    groups = (sets.select(F.explode("prefix").alias("h"), "label", "n", "central")
              .withColumn("rank", F.row_number().over(in_group) - 1).drop("central"))
    sizes = groups.groupBy("h").agg(F.count(F.lit(1)).alias("members"))
    groups = stash(groups.join(sizes.where("members > 1"), "h"))

    def member(df, c):
        return df.select("h", F.col("label").alias(c), F.col("n").alias(f"n{c}"), *[
            F.col(x).alias(f"{x}_{c}") for x in ("root", "rank") if x in df.columns])
    hub = member(groups.where("rank = 0"), "a").join(member(groups.where("rank > 0"), "b"), "h")
    pairs = stash(hub.where(_sizes_fit(percent)).select("a", "b", "na", "nb").distinct())
    roots = stash(components(verified(pairs, cut, percent).select("a", "b")))

    rows = (groups.join(roots.withColumnRenamed("node", "label"), "label", "left")
            .withColumn("root", F.coalesce("root", "label")))
    apart = (rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo < hi").select("h"))
    rows = stash(rows.where("members > 2").join(apart, "h"))
    small = rows.where((F.col("members") <= SMALL) & (F.col("rank") > 0))
    pairs = stash(member(small, "a").join(member(small, "b"), "h").where(
        (F.col("rank_a") < F.col("rank_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_fit(percent))
        .select("a", "b", "na", "nb", "root_a", "root_b").distinct())
    found = verified(pairs, cut, percent).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    large = block_links(rows.where(F.col("members") > SMALL), sets, percent)
    joined = components(found.unionAll(large))
    known = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")),
                       "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stash(known.unionAll(joined.join(roots, "node", "left_anti")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE,
            percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach)."""
    members = stash(document_sets(docs, id_col, text_col, n))
    total, count = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("label")).first()
    least = members.where("label is not null").groupBy("label").agg(F.min("i").alias("least"))
    if total:
        roots = linked_classes(docs, text_col, total, class_numbers(members, count), n, percent)
        joined = least.join(roots.withColumnRenamed("node", "label"), "label", "left").withColumn(
            "root", F.coalesce("root", "label"))
        of_root = joined.groupBy("root").agg(F.min("least").alias("c"))
        least = joined.join(of_root, "root").select("label", F.col("c").alias("least"))
    return members.join(least, "label", "left").select(
        F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("i")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, columns unchanged, that bear the id of their component. Rows that share an id
    are kept or left out together; documents without words all stay."""
    keep = (classes(docs, id_col, text_col, **options)
            .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("__kept")).distinct())
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["__kept"]), "left_semi")
