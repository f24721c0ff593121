"""Fill-in-middle: texts cut into prefix, middle and suffix and put in another order.

A text is copied once into a bytearray with a sentinel before each of its three parts. Exchanging two
neighbouring stretches of that buffer is a rotation, done in place by three reversals:

    psm: <P>prefix [<M>middle] [<S>suffix]   ->  <P>prefix <S>suffix <M>middle
    spm: [<P>prefix <M>middle] [<S>suffix]   ->  <S>suffix <P>prefix <M>middle

`restored` finds the sentinels, rotates back and takes them out, which gives the exact text.

Cuts fall between tokens (blanks with the word after them; blanks at the end are one more). They and
the form follow from a hash of the seed and the document's id alone, so every run cuts alike.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays plain;
a null id is hashed as the empty string; rows with equal ids are cut by the same hash; parts may be
empty. Columns of the input that are named like a result of the operator are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import NOT_SPACE, map_batches

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
STRIDE = 1 << 16
SCAN = 1 << 20
_KEY, _TEXT = "__cut_key", "__whole_text"
MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]
_MADE = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()),
         ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()),
         ("output", T.StringType(), pa.string())]


def reverse(part: np.ndarray) -> None:
    """Turn a stretch around in place, with a bounded piece of either end aside at a time."""
    lo, hi = 0, len(part)
    while hi - lo > 1:
        step = min(STRIDE, (hi - lo) // 2)
        head = part[lo:lo + step].copy()
        part[lo:lo + step] = part[hi - step:hi][::-1]
        part[hi - step:hi] = head[::-1]
        lo, hi = lo + step, hi - step


def rotate(buffer: bytearray, lo: int, middle: int, hi: int) -> None:
    """Exchange buffer[lo:middle] and buffer[middle:hi] in place by three reversals."""
    if lo < middle < hi:
        part = np.frombuffer(buffer, np.uint8)[lo:hi]
        reverse(part[:middle - lo])
        reverse(part[middle - lo:])
        reverse(part)


def token_ends(raw: memoryview | bytes) -> np.ndarray:
    """Where the tokens of a text end, in bytes. A text ends a token itself, in a word or in blanks."""
    data, ends = np.frombuffer(raw, np.uint8), []
    for lo in range(0, len(data), SCAN):
        solid = NOT_SPACE[data[lo:lo + SCAN + 1]]
        ends.append(np.flatnonzero(solid[:-1] & ~solid[1:]) + lo + 1)
    return np.concatenate([*ends, [len(data)]]) if len(data) else np.zeros(0, np.int64)


def characters(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return sum(int(np.count_nonzero((np.frombuffer(raw[lo:lo + SCAN], np.uint8) & 0xC0) != 0x80))
               for lo in range(0, len(raw), SCAN))


def cut(raw: bytes, key: str, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT,
        sentinels: Sequence[bytes] = tuple(s.encode() for s in SENTINELS)) -> tuple:
    """n, form, code points of prefix and middle (None if plain), and the output's bytes."""
    ends = token_ends(raw)
    n = len(ends)
    h1, h2, h3, h4 = (int(key[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not raw or h3 % 100 >= fim or any(s in raw for s in sentinels):
        return n, "plain", None, None, raw
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    p, s, m = sentinels
    buffer = bytearray(p) + raw[:a] + m + raw[a:b] + s + raw[b:]
    middle, suffix = len(p) + a, len(p) + len(m) + b
    form = "spm" if h4 % 100 < spm else "psm"
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return n, form, characters(raw[:a]), characters(raw[a:b]), buffer


def joined(output: bytes, form: str,
           sentinels: Sequence[bytes] = tuple(s.encode() for s in SENTINELS)) -> bytes | bytearray:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = sentinels
    buffer = bytearray(output)
    if form == "spm":
        suffix = buffer.index(p)  # the suffix with its sentinel comes first
        rotate(buffer, 0, suffix, len(buffer))
    else:
        start = buffer.index(s)
        rotate(buffer, start, buffer.index(m, start), len(buffer))
    for mark in (s, m, p):
        at = buffer.index(mark)
        del buffer[at:at + len(mark)]
    return buffer


def _strings(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "").cast(pa.binary())


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """All columns but the text, with n (tokens), form, prefix_chars, middle_chars and output.

    One pass without a shuffle. `sentinels` mark prefix, suffix and middle; no two of them may overlap
    in a row, which angle brackets see to.
    """
    marks = tuple(s.encode() for s in sentinels)
    kept = [c for c in docs.columns if c not in (*MADE, text_col, _KEY, _TEXT)]
    number = F.coalesce(_name(id_col).cast("string"), F.lit(""))
    asked = docs.select(*[_name(c).alias(f"k{i}") for i, c in enumerate(kept)],
                        F.sha2(F.concat(F.lit(f"{seed}:"), number).cast("binary"), 256).alias(_KEY),
                        _name(text_col).alias(_TEXT))

    def run(batches):
        for b in batches:
            key, texts = b.column(b.num_columns - 2), _strings(b.column(b.num_columns - 1))
            rows = [cut(t.as_py(), k.as_py(), fim_percent, spm_percent, marks)
                    for k, t in zip(key, texts, strict=True)]
            made = [pa.array([r[i] for r in rows], pa.binary() if name == "output" else kind)
                    for i, (name, _, kind) in enumerate(_MADE)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], *[x.cast(kind) for x, (*_, kind) in zip(made, _MADE, strict=True)]],
                names=schema.names)
    schema = T.StructType([*asked.schema.fields[:-2], *[T.StructField(n, t) for n, t, _ in _MADE]])
    return map_batches(asked, run, schema).toDF(*kept, *MADE)


def restored(outputs: DataFrame, text_col: str = "text",
             sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """What `transformed` gave, with the exact text (`text_col`) added, from output and form alone."""
    marks = tuple(s.encode() for s in sentinels)
    kept = [c for c in outputs.columns if c != text_col]
    at = {c: kept.index(c) for c in ("output", "form")}
    asked = outputs.select(*[_name(c).alias(f"k{i}") for i, c in enumerate(kept)])

    def run(batches):
        for b in batches:
            texts = [joined(o.as_py(), f.as_py(), marks) for o, f in
                     zip(_strings(b.column(at["output"])), b.column(at["form"]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=schema.names)
    schema = T.StructType([*asked.schema.fields, T.StructField("text", T.StringType())])
    return map_batches(asked, run, schema).toDF(*kept, text_col)


def _name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")
