"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Each text becomes `STATISTICS` numbers. They are standardised, and cosines of random projections
approximate a Gaussian kernel over them. Tasks add up their part of the normal equations, which have
a fixed size; the ridge solution gives a raw score. Labelled rows are then counted by bin of the raw
score and a non-decreasing curve through the bins (pool adjacent violators) turns it into a share of
label 1.

All statistics cover whole texts and all documents; all labelled rows take part in the fit.

Defined cases: a null text counts as empty; empty texts have statistics of 0 and a score like any
other; rows without label, or with one other than 0 and 1, are not learned from; a document labelled
twice counts twice; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import LOWER, NOT_SPACE, Spans, byte_class, chunks, map_batches
from eventide.storage import stash

FEATURES = 384
WIDTH = 1.0
RIDGE = 1e-3
BINS = 400
_LINE = ~byte_class([(0x0A, 0x0A), (0x0D, 0x0D)])
_CLASSES = {
    "upper": [(65, 90)], "lower": [(97, 122)], "digit": [(48, 57)], "space": [(9, 13), (32, 32)],
    "wide": [(128, 255)], "stop": [(46, 46), (63, 63)], "bang": [(33, 33)], "comma": [(44, 44)],
    "mark": [(35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126)],
    "line": [(10, 10)], "link": [(47, 47), (58, 58)], "odd": [(0, 8), (14, 31), (127, 127)]}
_GROUPS = np.array([byte_class(p) for p in _CLASSES.values()], np.float64)
STATISTICS = len(_CLASSES) + 16


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of different hashes, and how often the commonest is there."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, row[start], np.diff(start, append=len(h)))
    return np.bincount(row[start], minlength=rows), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One line of numbers per text."""
    rows, size = len(offs) - 1, np.diff(offs)
    where = np.repeat(np.arange(rows), size)
    bytes_ = np.bincount(where * 256 + data, minlength=rows * 256).reshape(rows, 256)
    shares = bytes_ / np.maximum(size, 1)[:, None]
    out = list(_GROUPS @ shares.T)
    out.append(-(shares * np.log2(np.maximum(shares, 1e-12))).sum(axis=1))
    words = Spans(data, offs, NOT_SPACE, LOWER)
    n = words.per_row
    length = np.bincount(words.row, weights=words.end - words.start, minlength=rows)
    squares = np.bincount(words.row, weights=(words.end - words.start) ** 2.0, minlength=rows)
    mean = _share(length, n)
    different, most = _distinct(words.row, words.hash, rows)
    out += [np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(_share(squares, n) - mean ** 2, 0)),
            _share(different, n), _share(most, n), np.log1p(n) * _share(different, n)]
    beside = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    out.append(_share(np.bincount(words.row[1:][beside], minlength=rows), n))
    for k in (2, 3):
        first, h = words.windows(k)
        different, most = _distinct(words.row[first], h, rows)
        count = np.bincount(words.row[first], minlength=rows)
        out += [1 - _share(different, count), _share(most, count)]
    lines = Spans(data, offs, _LINE)
    different, _ = _distinct(lines.row, lines.hash, rows)
    out += [1 - _share(different, lines.per_row), np.log1p(_share(size, lines.per_row)),
            np.log1p(lines.per_row)]
    return np.array(out).T


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, stats."""
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.array(list(statistics(data, offs).astype(np.float32)), pa.list_(pa.float32()))],
                    names=["id", "stats"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return map_batches(rows, run, T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                                                T.StructField("stats", T.ArrayType(T.FloatType()))]))


@dataclass
class Model:
    """What scores a text; its size depends on the numbers of statistics, features and bins alone."""
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.projection + self.phase)
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0.0, 1.0)


def _summed(parts: DataFrame) -> np.ndarray:
    """Vectors of tasks added up by row number, as one matrix. `parts`: i, v."""
    def add(table: pa.Table) -> pa.Table:
        v = np.stack(table.column("v").to_numpy()).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})
    total = parts.groupBy("i").applyInArrow(add, "i int, v array<double>")
    rows = sorted(total.collect(), key=lambda r: r["i"])  # as many rows as the matrix has
    return np.array([r["v"] for r in rows])


def _per_task(df: DataFrame, columns: list[str], matrix) -> np.ndarray:
    """Sum over all tasks of `matrix(stats, y)`."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                stats = np.stack(b.column("stats").to_numpy(zero_copy_only=False)).astype(np.float64)
                y = b.column("y").to_numpy() if "y" in columns else None
                m = matrix(stats, y)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["i", "v"])
    return _summed(map_batches(df.select(*columns), run, "i int, v array<double>"))


def non_decreasing(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centre and value of each block."""
    blocks: list = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return (np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))


def fit(stats: DataFrame, labelled: DataFrame, features: int = FEATURES, width: float = WIDTH,
        ridge: float = RIDGE, bins: int = BINS, seed: int = 7) -> Model | None:
    """`stats`: id, stats of all documents, which give mean and spread. `labelled`: stats, y (0 or 1).
    None without labelled rows."""
    sums = _per_task(stats, ["stats"], lambda s, _: np.array(
        [s.sum(axis=0), (s ** 2).sum(axis=0), np.full(s.shape[1], len(s))]))
    if not len(sums):
        return None
    mean = sums[0] / sums[2]
    scale = np.sqrt(np.maximum(sums[1] / sums[2] - mean ** 2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / (width * np.sqrt(len(mean))), (len(mean), features)),
                  rng.uniform(0, 2 * np.pi, features), np.zeros(0), (np.zeros(1), np.zeros(1)))

    def normal(s, y):
        z = model.features(s)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])
    system = _per_task(labelled, ["stats", "y"], normal)
    if not len(system):
        return None
    n = system[-1, -2]
    model.weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(len(system)) / 10, system[:, -1])

    def binned(s, y):
        raw = model.raw(s)
        at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.array([np.bincount(at, v, bins) for v in (np.ones(len(y)), y, raw)])
    count, ones, raws = _per_task(labelled, ["stats", "y"], binned)
    some = count > 0
    model.curve = non_decreasing(raws[some] / count[some], ones[some] / count[some], count[some])
    return model


def scores(stats: DataFrame, model: Model | None) -> DataFrame:
    """id, score."""
    def run(batches):
        for b in batches:
            s = b.column("stats").to_numpy(zero_copy_only=False)
            value = (np.full(len(s), 0.5) if known.value is None or not len(s)
                     else known.value.score(np.stack(s).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(value, pa.float64())],
                                             names=["id", "score"])
    known = stats.sparkSession.sparkContext.broadcast(model)
    return map_batches(stats, run, T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, score of every document, learned from labels of the documents `learn_from` holds for."""
    stats = stash(document_statistics(docs, id_col, text_col))
    wanted = labels.where(learn_from).select(F.col(id_col).alias("id"),
                                             F.col(label_col).cast("double").alias("y"))
    known = stash(stats.join(wanted.where("y in (0, 1)"), "id").select("stats", "y"))
    return scores(stats, fit(stats, known)).withColumnRenamed("id", id_col)
