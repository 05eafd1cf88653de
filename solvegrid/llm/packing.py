"""Token-id output: best-fit-decreasing packing into rows of a fixed length.

Texts are encoded with a public byte-level vocabulary and packed where they are read, so nothing is shuffled. A task takes its
documents in order until they have ``shard_tokens`` tokens, and packs them as one shard, so
memory is bounded. A document longer than a row is cut into whole rows, and its rest is packed
as a segment like any other, so no token is lost. Segments go by decreasing length (then by
id, then by place in the shard) into the fullest open row that has room, found by a segment
tree over capacities that counts the open rows of each.

A packed row has its ids as little-endian 32-bit integers, padded to the length; the
cumulative segment lengths; positions that restart at 0 in each segment (and in the padding);
and of each segment the document and the offset in it.

What a shard has follows from how the reader splits its input: reruns over the same splits give
the same rows, another split size gives other shards of the same segments.

Cases: null or empty texts have no token and make no segment; a text of any length is encoded
whole; segments of equal length, id and place are packed in the order in which they are read;
repeated rows are packed each; ids may be null; an empty table gives no rows; other columns
and their names play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENCODERS: dict[str, tiktoken.Encoding] = {}

LENGTH = 2048
SHARD_TOKENS = 1 << 20
#: Free in the vocabulary that the query uses.
PAD = 50256


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """One for each worker process and file of ranks."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Capacities:
    """Open rows by free capacity 0..most; finds the smallest capacity that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of an open row with the least capacity that isn't below, removed."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, row


def pack(lengths: list[int], length: int = LENGTH) -> list[list[int]]:
    """Rows of indices into lengths (each 1 to length), by best fit in order of decreasing length."""
    free, rows = Capacities(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        if capacity > lengths[i]:
            free.add(capacity - lengths[i], row)
    return rows


_SCHEMA = "shard string, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_offsets array<long>"


def _rows(docs: list[tuple[int | None, np.ndarray]], shard: str, length: int) -> pa.RecordBatch:
    pieces: list[tuple[int | None, int, np.ndarray]] = []
    for doc, ids in docs:
        pieces += [(doc, at, ids[at : at + length]) for at in range(0, len(ids), length)]
    pieces.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    packed = pack([len(p[2]) for p in pieces], length)
    out: list[list] = [[] for _ in range(8)]
    for r, members in enumerate(packed):
        sizes = [len(pieces[i][2]) for i in members]
        ids, positions, at = np.full(length, PAD, dtype="<i4"), np.zeros(length, dtype="<i4"), 0
        for i, n in zip(members, sizes, strict=True):
            ids[at : at + n] = pieces[i][2]
            positions[at : at + n] = np.arange(n)
            at += n
        positions[at:] = np.arange(length - at)
        row = (shard, r, at, ids.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), positions.tobytes(), [pieces[i][0] for i in members], [pieces[i][1] for i in members])
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, length: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    own, context = encoder(path, pattern), TaskContext.get()
    part = context.partitionId() if context else 0
    held: list[tuple[int | None, np.ndarray]] = []
    tokens = shards = 0
    for batch in batches:
        for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
            ids = own.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype("<i4")
            if not len(ids):
                continue
            held.append((doc.as_py(), ids))
            tokens += len(ids)
            if tokens >= shard_tokens:
                yield _rows(held, f"{part:05d}-{shards:04d}", length)
                held, tokens, shards = [], 0, shards + 1
    if held:
        yield _rows(held, f"{part:05d}-{shards:04d}", length)


def packed(docs: DataFrame, path: str, pattern: str, *, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed rows, see the module; (shard, row) tells them apart."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _pack_batches(it, path, pattern, length, shard_tokens), _SCHEMA)


def write(rows: DataFrame, to: str) -> None:
    """Writes packed rows, a folder for each shard's task; any store that Spark writes to will do."""
    rows.write.mode("overwrite").parquet(to)


def unpack(rows: DataFrame) -> DataFrame:
    """doc_id, doc_offset, ids: the segments of packed rows, for readers and tests."""
    pos = F.posexplode(F.arrays_zip("doc_ids", "doc_offsets"))
    each = rows.select("ids", "cu_seqlens", pos.alias("i", "s"))
    lo, hi = F.element_at("cu_seqlens", F.col("i") + 1), F.element_at("cu_seqlens", F.col("i") + 2)
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_offsets").alias("doc_offset"), F.substring(F.col("ids"), lo * 4 + 1, (hi - lo) * 4).alias("ids"))
