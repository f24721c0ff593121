"""Language identification by cross-parsing: the fewest phrases win.

For each language a suffix automaton is built over normalised training text. A document is cut,
from left to right, into the longest phrases that occur in that text; with c phrases over n
characters and a training text of N characters its cross entropy is about c * log2(N) / n. The
language of the least value wins.

Text is lower-cased and every run of characters that are no letters becomes one blank. Documents are
parsed in pieces of `PIECE` characters, so that many pieces go through the automata in one numpy step.

The training text of a language is a bounded sample: `SAMPLE_CHARS` characters of its `SAMPLE_DOCS`
documents of least hash, shared over all of them: short ones are taken whole, of each longer one
`WINDOWS` windows spread over it. Each language has the same sample however many there are, so the
automata of a worker grow with the languages, by some megabytes each.

Defined cases: text that is null or has no letter is `und` with score 0, as is every text where no
language was learned; languages whose sample has no letter are not learned; ties go to the language
first by code point; repeated rows and ids are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import P, map_batches

SAMPLE_DOCS = 96
SAMPLE_CHARS = 80_000
WINDOWS = 4
PIECE = 256
CHARS = 1 << 17
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point; built once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts one after the other, 0 for a blank, and the text each character is of."""
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(raw == 0)
    letter = is_letter()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep &= raw != 0  # the separator is of no text
    return np.where(letter, raw, 0)[keep], row[keep]


@dataclass
class Model:
    """Training texts by language; the automata are built in the workers."""
    texts: dict[str, str]

    def automata(self) -> Automata:
        """Built by each task, and gone with it: a worker serves other operators afterwards."""
        return Automata(self.texts)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


class Automata:
    """The automata of all languages: their transitions in one table, at the place of the state plus the
    character, with the state they are of; two slots of 8 bytes for each.

    Column 0 is the blank, 1 any character no training text has. Where a state has no transition
    for a character a phrase ends before it, and `start` tells where the next one begins.
    """

    def __init__(self, texts: dict[str, str]):
        parsed = {k: code_points([v])[0] for k, v in sorted(texts.items())}
        parsed = {k: v for k, v in parsed.items() if v.any()}
        self.names = list(parsed)
        seen = np.unique(np.concatenate([*parsed.values(), np.zeros(1, np.uint32)]))[1:]
        self.column = np.ones(0x110000, np.int32)
        self.column[0] = 0
        self.column[seen] = np.arange(2, len(seen) + 2)
        self.width = len(seen) + 2
        states, cols, nexts, base = [], [], [], 0
        self.start = np.zeros((len(parsed), self.width), np.int32)
        for lang, v in enumerate(parsed.values()):
            step = suffix_automaton(self.column[v].tolist())
            n = np.fromiter(map(len, step), np.int64, len(step))
            size = int(n.sum())
            col = np.fromiter(chain.from_iterable(step), np.int64, size)
            to = np.fromiter(chain.from_iterable(d.values() for d in step), np.int64, size) + base
            # The state past the last follows a character that no match can start with.
            self.start[lang] = len(step) + base
            self.start[lang, col[:n[0]]] = to[:n[0]]
            states.append(np.repeat(np.arange(len(step)), n) + base)
            cols.append(col)
            nexts.append(to)
            base += len(step) + 1
            del step
        self._store(base, *[np.concatenate([*x, np.zeros(0, np.int64)]) for x in (states, cols, nexts)])
        self.bits = np.log2([max(2, len(v)) for v in parsed.values()])

    def _store(self, n_states: int, state: np.ndarray, col: np.ndarray, to: np.ndarray) -> None:
        """Give each state a place so that no two transitions share a slot, states of many first."""
        rng = np.random.default_rng(0)
        room = 2 * len(state) + 1
        self.place = np.zeros(n_states, np.int32)
        self.owner = np.full(room + self.width, -1, np.int32)
        self.next = np.zeros(room + self.width, np.int32)
        degree = np.bincount(state, minlength=n_states)[state]
        high = int(degree.max(initial=0)) + 1
        while high > 1:
            low = max(1, high // 2)
            pick = np.flatnonzero((degree >= low) & (degree < high))
            rounds = 0
            while len(pick):
                s, c = state[pick], col[pick]
                ids = np.unique(s)
                rounds += 1
                if rounds % 64 == 0:  # wide alphabets in a small table may find no place
                    room += self.width * len(ids)
                    more = room + self.width - len(self.owner)
                    self.owner = np.concatenate([self.owner, np.full(more, -1, np.int32)])
                    self.next = np.concatenate([self.next, np.zeros(more, np.int32)])
                self.place[ids] = rng.integers(0, room, len(ids))
                slot = self.place[s] + c
                bad = np.zeros(n_states, bool)
                bad[s[self.owner[slot] >= 0]] = True
                use = ~bad[s]
                self.owner[slot[use]] = s[use]
                bad[s[self.owner[slot] != s]] = True
                undo = use & bad[s] & (self.owner[slot] == s)
                self.owner[slot[undo]] = -1
                done = ~bad[s]
                self.next[slot[done]] = to[pick[done]]
                pick = pick[~done]
            high = low

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language and text, and characters by text."""
        raw, row = code_points(texts)
        size = np.bincount(row, minlength=len(texts)).astype(np.int64)
        n_pieces = -(-size // PIECE)
        piece_row = np.repeat(np.arange(len(texts)), n_pieces)
        first = np.cumsum(n_pieces) - n_pieces
        at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        # Long pieces first, so those that still run are the left columns.
        length = np.minimum(size[piece_row] - (np.arange(len(piece_row)) - first[piece_row]) * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        grid = np.zeros((PIECE, len(order)), np.int64)
        grid[at % PIECE, place[np.repeat(first, size) + at // PIECE]] = self.column[raw]
        running = len(order) - np.searchsorted(np.sort(length), np.arange(PIECE), side="right")
        ends = np.ones((len(self.names), len(order)), np.int64)
        state = self.start[:, grid[0]]
        for line, n in zip(grid[1:], running[1:].tolist(), strict=True):
            if not n:
                break
            state, line = state[:, :n], line[:n]
            slot = self.place[state] + line
            miss = self.owner[slot] != state
            ends[:, :n] += miss
            state = np.where(miss, self.start[:, line], self.next[slot])
        piece_row = piece_row[order]
        return np.array([np.bincount(piece_row, weights=e, minlength=len(texts))
                         for e in ends]).reshape(len(self.names), len(texts)), size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its share of confidence among all languages."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        ends, size = self.phrases(texts)
        cost = ends * self.bits[:, None] / np.maximum(size, 1)
        best = cost.argmin(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = 1 / ((cost.min(axis=0) / cost) ** 8).sum(axis=0)
        return ([self.names[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)],
                np.where(size > 0, score, 0.0))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          order: Column | None = None, sample_docs: int = SAMPLE_DOCS,
          sample_chars: int = SAMPLE_CHARS) -> Model:
    """Sample the labelled texts. `order` ranks documents; by default a hash of the text does."""
    order = F.xxhash64(text_col) if order is None else order
    w = Window.partitionBy("__lang").orderBy("__order", "__text")
    slim = labelled.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"),
                           order.alias("__order")).where("__lang is not null and __text is not null")
    # The limit is pushed below the shuffle, so a language sends at most this many rows per task.
    rows = (slim.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= sample_docs)
            .select("__lang", "__text", "__n", F.length("__text").cast("long").alias("__len")))
    # The level up to which all texts are taken, so that they come to the characters asked for.
    one = Window.partitionBy("__lang")
    rising = one.orderBy("__len", "__n")
    level = (sample_chars - F.sum("__len").over(rising.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__len")
             ) / (F.count(F.lit(1)).over(one) - F.row_number().over(rising) + 1)
    rows = (rows.withColumn("__level", level)
            .withColumn("__take", F.greatest(F.lit(1), F.max("__level").over(one).cast("int"))))
    part = F.greatest(F.lit(1), F.expr(f"__take div {WINDOWS}")).cast("int")
    parts = [F.substring(F.col("__text"), (F.lit(1) + F.floor((F.col("__len") - part) * k / (WINDOWS - 1))).cast("int"),
                         part) for k in range(WINDOWS)]
    rows = rows.select("__lang", "__n", F.when(F.col("__len") <= F.col("__take"), F.col("__text"))
                       .otherwise(F.concat_ws("\n", *parts)).alias("__text"))
    texts: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["__lang"], r["__n"])):
        texts.setdefault(r["__lang"], []).append(r["__text"])
    return Model({k: "\n".join(v) for k, v in texts.items()})


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred",
            score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The documents, or the columns `keep` of them, with two more columns, which replace columns of
    the same names."""
    kept = [c for c in keep or docs.columns if c not in (lang, score)]
    text = kept.index(text_col) if text_col in kept else len(kept)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        automata = known.value.automata()
        for b in batches:
            texts = b.column(text).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= CHARS):
                    n += len(texts[hi] or "")
                    hi += 1
                names, scores = automata.predict([t or "" for t in texts[lo:hi]])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*kept, lang, score])
                lo = hi

    rows = docs.select(*[F.col(f"`{c}`") for c in kept],
                       *[F.col(f"`{text_col}`").alias("__text")] * (text == len(kept)))
    fields = [docs.schema[c] for c in kept]
    return map_batches(rows, run, T.StructType(
        [*fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, columns unchanged, without those of no language."""
    out = predict(docs, model, text_col, "__lang", "__score")
    return out.where(F.col("__lang") != UNKNOWN).select(*[f"`{c}`" for c in docs.columns])
