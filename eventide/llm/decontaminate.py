"""Benchmark decontamination: a broadcast hash set of benchmark word windows against all documents.

Words are runs of `[0-9a-z]` and non-ASCII characters after lower-casing A-Z. A window is `n`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Every
document window whose hash is in the set is compared with the words themselves before it counts.

Defined cases: a null or empty text has no words and no hits; a null or empty item has no windows;
items with equal windows all count; repeated items or documents are each judged on their own; an
item without id is not reported but still hits. An empty benchmark leaves every document clean.
Columns other than the id and the text are carried by `clean` and otherwise not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import ALNUM, LOWER, Spans, chunks, map_batches
from eventide.storage import stash

WINDOW = 10
# Windows of one broadcast set; at about 150 bytes each, some 75 MB.
SET_LIMIT = 500_000
_WINDOWS = "n int, h long, words binary, item string"
_HITS = ("n_words long, n_hit long, items array<string>, "
         "spans array<struct<first:int,last:int>>, bytes array<struct<first:int,last:int>>")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 n: int = WINDOW) -> DataFrame:
    """One row per window of each item: its length in words, hash, words and item id."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, offs in chunks(b.column(1)):
                s = Spans(data, offs, ALNUM, LOWER)
                out = []
                for size in range(1, n + 1):
                    first, h = s.windows(size)
                    # A shorter window stands for the whole of an item of exactly that many words.
                    use = s.per_row[s.row[first]] == size if size < n else np.ones(len(first), bool)
                    out += [(size, int(x), s.words(i, size), ids[lo + s.row[i]])
                            for i, x in zip(first[use].tolist(), h[use].view(np.int64).tolist(),
                                            strict=True)]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())],
                    names=["n", "h", "words", "item"])
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return map_batches(rows, run, _WINDOWS)


class WindowSet:
    """Windows of one part of the benchmark, looked up by hash and checked by their words."""

    def __init__(self, rows):
        self.items: dict = {}
        by_size: dict = {}
        for n, h, words, item in rows:
            self.items.setdefault((h, bytes(words)), set()).add(item)
            by_size.setdefault(n, set()).add(h)
        self.hashes = {n: np.sort(np.array(list(v), np.int64).view(np.uint64))
                       for n, v in sorted(by_size.items())}

    def hits(self, s: Spans):
        """(row, first word, past the last word, items) of every verified window."""
        for n, known in self.hashes.items():
            first, h = s.windows(n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for k in np.flatnonzero(known[at] == h).tolist():
                i = int(first[k])
                found = self.items.get((int(h[k:k + 1].view(np.int64)[0]), s.words(i, n)))
                if found:
                    yield int(s.row[i]), i, i + n, found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _scan(rows: DataFrame, known, keep_text: bool) -> DataFrame:
    """Columns: row key, [text], then the hit columns. `known` broadcasts a WindowSet."""
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("__text")):
                s = Spans(data, offs, ALNUM, LOWER)
                found: dict = {}
                for row, i, j, items in known.value.hits(s):
                    ranges, names = found.setdefault(row, ([], set()))
                    ranges.append((i, j))
                    names.update(items)
                n_hit, items, spans, cuts = [], [], [], []
                for r in range(hi - lo):
                    ranges, names = found.get(r, ((), ()))
                    ranges = merged(list(ranges))
                    base, at = int(s.bounds[r]), int(offs[r])
                    n_hit.append(sum(j - i for i, j in ranges))
                    items.append(sorted(x for x in names if x is not None))
                    spans.append([{"first": i - base, "last": j - base} for i, j in ranges])
                    cuts.append([{"first": int(s.start[i]) - at, "last": int(s.end[j - 1]) - at}
                                 for i, j in ranges])
                part = b.slice(lo, hi - lo)
                pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                arrays = [c for c, f in zip(part.columns, part.schema, strict=True)
                          if keep_text or f.name != "__text"]
                names = [f.name for f in part.schema if keep_text or f.name != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(s.per_row, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, pair),
                     pa.array(cuts, pair)],
                    names=[*names, "__n_words", "__n_hit", "__items", "__spans", "__cuts"])
    fields = [f for f in rows.schema.fields if keep_text or f.name != "__text"]
    hits = T._parse_datatype_string(_HITS).fields
    named = [T.StructField(n, f.dataType) for n, f in
             zip(["__n_words", "__n_hit", "__items", "__spans", "__cuts"], hits, strict=True)]
    return map_batches(rows, run, T.StructType(fields + named))


def _parts(benchmark: DataFrame, id_col: str, text_col: str, n: int, set_limit: int):
    """The benchmark's windows as bounded sets, one after the other."""
    spark = benchmark.sparkSession
    windows = stash(item_windows(benchmark, id_col, text_col, n))
    parts = max(1, -(-windows.count() // set_limit))
    for p in range(parts):
        one = windows.where(F.pmod(F.col("h"), F.lit(parts)) == p)
        yield parts, spark.sparkContext.broadcast(WindowSet(one.toLocalIterator()))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", n: int = WINDOW,
         set_limit: int = SET_LIMIT) -> DataFrame:
    """Per document: id, n_words, n_hit, items (ids, sorted), spans (word ranges), in one scan.

    A benchmark of more than `set_limit` windows is cut by hash into sets of about that size; the
    documents are then scanned once per set and the ranges of a document united, by id and text; each
    row is reported, as with one set.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sets = list(_parts(benchmark, item_col, item_text, n, set_limit))
    if len(sets) == 1:
        out = _scan(rows, sets[0][1], False)
    else:
        # Equal rows have equal hits: one of them is scanned, and each gets a row of its own again.
        rows = rows.groupBy("__id", "__text").agg(F.count(F.lit(1)).alias("__copies"))
        rows = rows.withColumn("__key", F.sha2(F.coalesce(F.col("__text"), F.lit("")), 256))
        rows = rows.withColumn("__null", F.col("__text").isNull())
        united = None
        for _, known in sets:
            one = _scan(rows, known, False)
            united = one if united is None else united.unionAll(one)
        cover = F.array_distinct(F.flatten(F.transform(
            F.flatten(F.collect_list("__spans")),
            lambda s: F.sequence(s["first"], s["last"] - 1))))
        out = (united.groupBy("__id", "__key", "__null", "__copies").agg(
            F.max("__n_words").alias("__n_words"),
            F.size(cover).cast("long").alias("__n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
            F.array_sort(F.flatten(F.collect_list("__spans"))).alias("__spans"))
            .withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))))
    return out.select(F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"),
                      F.col("__n_hit").alias("n_hit"), F.col("__items").alias("items"),
                      F.col("__spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", n: int = WINDOW,
          remove: str = "documents", set_limit: int = SET_LIMIT) -> DataFrame:
    """The documents, all columns kept, without hit documents (`remove="documents"`) or without
    the bytes from the first to the last hit word of each span (`remove="spans"`).

    With several window sets the scans follow one another; the spans of all are found in the uncut
    text and cut at the end.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    names, out = docs.columns, docs
    cut = F.udf(cut_spans, T.StringType(), useArrow=True)
    if remove == "spans":
        empty = F.expr("cast(array() as array<struct<first:int,last:int>>)")
        out = out.withColumn("__all", empty).withColumn("__words", empty)
    for _, known in _parts(benchmark, item_col, item_text, n, set_limit):
        out = _scan(out.withColumn("__text", F.col(text_col)), known, True)
        if remove == "documents":
            out = out.where("__n_hit = 0").select(*names)
        else:
            out = out.select(*[F.col(f"`{c}`") for c in names], F.concat("__all", "__cuts").alias("__all"),
                             F.concat("__words", "__spans").alias("__words"))
    if remove == "spans":
        out = out.select(*[cut(text_col, "__all", "__words").alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
    return out


def cut_spans(text, cuts, words):
    """The text without the given byte ranges, and what lies between those whose word ranges touch;
    null stays null."""
    if text is None or not cuts:
        return text
    first = {w["first"]: c["first"] for w, c in zip(words, cuts, strict=True)}
    last = {w["last"]: c["last"] for w, c in zip(words, cuts, strict=True)}
    raw, at, kept = text.encode(), 0, []
    for i, j in merged([(w["first"], w["last"]) for w in words]):
        kept.append(raw[at:first[i]])
        at = last[j]
    return b"".join([*kept, raw[at:]]).decode()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of `hits`: counts, the hash of the item ids, and whether anything was hit."""
    return hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))

