"""Token-id files: fixed-width bit packing with block offsets.

A file set is a Parquet folder with one row per block. A block holds the ids of whole documents, in
ascending document id, each id in the fewest bits the vocabulary needs. Its row carries the offset
of the block in its shard, and per document the offset and number of ids, so that one document is
unpacked from its own bit range, and a whole block in one numpy step.

Columns: shard, block, first (ids of the shard before the block), n_ids, bits, payload, doc_ids,
starts (in the block), counts (with the end id).

Shards follow each other in document id; a block is closed once it holds `BLOCK` ids or more.

Defined cases: a null or empty text has the end id alone; rows that share an id are stored one after
the other, longer text first; a null id comes first; an empty table gives an empty file set.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.llm.batches import P, P_INV, CHUNK, byte_class, map_batches, mix, powers, text_bytes

BLOCK = 1 << 16
_BLOCKS = ("shard int, block int, first long, n_ids long, bits int, payload binary, "
           "doc_ids array<long>, starts array<long>, counts array<long>")


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a little-endian stream of `bits` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """n ids from position `first` on, as 32-bit integers; reads their bit range only."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    lo, hi = first * bits, (first + n) * bits
    raw = np.frombuffer(payload, np.uint8, -(-hi // 8) - lo // 8, lo // 8)
    flat = np.unpackbits(raw, bitorder="little")[lo % 8:lo % 8 + n * bits]
    return (flat.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(
        axis=1, dtype=np.uint32).astype("<u4")


_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
# A byte that may end a character which is no white space. Last bytes of non-ASCII white space are
# left out, so a cut is never made inside a run of white space.
_SOLID = ~_SPACE
for _b in (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9,
           0xAF):
    _SOLID[_b] = False


_LETTER = byte_class([(0x41, 0x5A), (0x61, 0x7A)])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])


class Encoder:
    """Ids of many texts through a tokenizers file whose pre-tokenizer joins no character to white
    space behind it and no letter to a stop behind it: texts are cut there, each different piece is
    encoded once, and pieces seen lately are kept in a table of bounded size."""

    SLOTS = 1 << 20
    PIECES = 4096  # encoded at a time: the library's results are large next to their ids

    def __init__(self, path: str, pool_ids: int = 1 << 23):
        # A task has one core; more threads of the library would only hold more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # Bytes of a token: the characters of a byte-level one, the text of an added one.
        added = self.tokenizer.get_added_tokens_decoder()
        known = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for token, i in known.items():
            self.bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        self.pool_ids = pool_ids
        self.clear()

    def clear(self):
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.begin, self.count, self.pieces = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), 0

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encode pieces of a text into the pool; their numbers."""
        if len(start) > self.PIECES:
            return np.concatenate([self.add(data, start[lo:lo + self.PIECES], end[lo:lo + self.PIECES])
                                   for lo in range(0, len(start), self.PIECES)])
        flat, counts = self.joined(data, start, end)
        if len(flat) and flat.max() > 0xFFFF and self.pool.dtype == np.uint16:
            self.pool = self.pool.astype(np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.pieces + len(counts) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.pool[self.used:self.used + len(flat)] = flat
        lo, hi = self.pieces, self.pieces + len(counts)
        self.begin[lo:hi] = self.used + np.cumsum(counts) - counts
        self.count[lo:hi] = counts
        self.used, self.pieces = self.used + len(flat), hi
        return np.arange(lo, hi)

    def joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has. Pieces between which a text would be
        cut are encoded as one text, since the library takes long for each; the bytes of their tokens tell
        where one ends. If these do not add up, each piece is encoded by itself."""
        size = end - start
        stop = np.cumsum(size)
        text = data[np.repeat(end - stop, size) + np.arange(stop[-1])]
        apart = np.flatnonzero(~self.cuts(text[stop[:-1] - 1], text[stop[:-1]])) + 1
        edges = np.concatenate([[0], stop[apart - 1], stop[-1:]]).tolist()
        new = [e.ids for e in self.tokenizer.encode_batch_fast(
            [text[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)],
            add_special_tokens=False)]
        flat = np.array([i for x in new for i in x], np.uint32)
        bytes_at = np.cumsum(self.bytes[flat])
        last = np.searchsorted(bytes_at, stop)
        if len(flat) and bytes_at[-1] == stop[-1] and (bytes_at[last] == stop).all():
            return flat, np.diff(last + 1, prepend=0).astype(np.int32)
        new = [e.ids for e in self.tokenizer.encode_batch_fast(
            [data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)],
            add_special_tokens=False)]
        return np.array([i for x in new for i in x], np.uint32), np.array([len(x) for x in new], np.int32)

    @staticmethod
    def cuts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether texts are cut between two bytes."""
        return (_SPACE[after] & _SOLID[before]) | (_STOP[after] & _LETTER[before])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and len + 1 offsets into them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if self.used > self.pool_ids:
            self.clear()
        cut = np.zeros(n, bool)
        cut[1:] = self.cuts(data[:-1], data[1:])
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(P, n), out=sums[1:])
        h = mix((sums[end] - sums[start]) * powers(P_INV, n + 1)[start] + (end - start).astype(np.uint64))
        h |= np.uint64(1)
        slot = (h >> np.uint64(44)).astype(np.int64)
        piece = self.at[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            _, which, back = np.unique(h[miss], return_index=True, return_inverse=True)
            rare = miss[which]
            numbers = self.add(data, start[rare], end[rare])
            piece[miss] = numbers[back]
            self.keys[slot[rare]] = h[rare]
            self.at[slot[rare]] = numbers
        counts = self.count[piece].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.begin[piece] - (ends - counts), counts)
                        + np.arange(ends[-1])].astype(np.uint32)
        edges = np.concatenate([[0], ends])[np.searchsorted(start, offs)]
        return ids, edges


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def blocks(docs: DataFrame, tokenizer_path: str, vocabulary: int = 50_257, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of a file set. Documents are range-partitioned by id; a partition is a shard."""
    bits = id_bits(vocabulary)

    def run(batches):
        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        first, number, size, held = 0, 0, 0, []

        def close():
            ids = np.concatenate([x for x, _, _ in held])
            n = np.concatenate([x for _, _, x in held])
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], kind) for v, kind in ((shard, pa.int32()), (number, pa.int32()), (first, pa.int64()),
                                                       (len(ids), pa.int64()), (bits, pa.int32()),
                                                       (pack(ids, bits), pa.binary()))],
                 one(pa.concat_arrays([x for _, x, _ in held])), one(pa.array(np.cumsum(n) - n)), one(pa.array(n))],
                names=["shard", "block", "first", "n_ids", "bits", "payload", "doc_ids", "starts", "counts"])

        for b in batches:
            data, offs = text_bytes(b.column(1))
            lo = 0
            while lo < b.num_rows:
                hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK))))
                ids, edges = enc.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                n = np.diff(edges) + 1
                ends = np.cumsum(n)
                flat = np.full(ends[-1], end_id, np.uint32)
                body = np.ones(len(flat), bool)
                body[ends - 1] = False
                flat[body] = ids
                a = 0
                while a < len(n):
                    before = int(ends[a - 1]) if a else 0
                    z = min(len(n), a + int(np.searchsorted(ends[a:], before + block - size)) + 1)
                    held.append((flat[before:ends[z - 1]], b.column(0).slice(lo + a, z - a), n[a:z]))
                    size, a = size + int(ends[z - 1]) - before, z
                    if size >= block:
                        yield close()
                        first, number, size, held = first + size, number + 1, 0, []
                lo = hi
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    dealt = rows.repartitionByRange("i").sortWithinPartitions(
        F.col("i"), F.octet_length("t").desc_nulls_last())
    return map_batches(dealt, run, _BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Store the documents as a file set at `path`."""
    blocks(docs, tokenizer_path, **options).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(path)


def documents(files: DataFrame, ids: bool = True) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian 32-bit integers), and the ids unless `ids` is false."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("__n"))
    # One row of two numbers per shard, and as many shards as the write had partitions.
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = F.broadcast(shards.select("shard", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead")))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                all_ids = unpack(r["payload"], r["bits"], 0, r["n_ids"])
                parts = [all_ids[s:s + n] for s, n in zip(r["starts"], r["counts"], strict=True)]
                out = {"doc_id": pa.array(r["doc_ids"], pa.int64()),
                       "start": pa.array([r["__ahead"] + r["first"] + s for s in r["starts"]], pa.int64()),
                       "n_tokens": pa.array(r["counts"], pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
                if ids:
                    out["ids"] = pa.array(parts, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return map_batches(files.join(shards, "shard"), run, schema + (", ids array<long>" if ids else ""))


def lookup(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents; only blocks whose id range meets them are unpacked, and of
    these only the bit ranges asked for."""
    wanted = sorted(set(doc_ids))
    near = files.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted))))

    def run(batches):
        want = set(wanted)
        for b in batches:
            for r in b.to_pylist():
                hit = [k for k, d in enumerate(r["doc_ids"]) if d in want]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r["doc_ids"][k] for k in hit], pa.int64()),
                    "ids": pa.array([unpack(r["payload"], r["bits"], r["starts"][k], r["counts"][k])
                                     for k in hit], pa.list_(pa.int64()))})
    return map_batches(near, run, "doc_id long, ids array<long>")
