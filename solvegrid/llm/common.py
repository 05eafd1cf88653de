"""Shared kernels of the training-data operators.

Texts reach Python as Arrow string arrays. The kernels work on the UTF-8 bytes of a
whole chunk at once with numpy, so that no Python object is made per word. A word is a
run of bytes other than 0x20 and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def byte_set(values) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


SPACES = byte_set([32, *range(9, 14)])
NEWLINE = byte_set([10])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=_U) * _BASE + _U(seed))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


class Chunk:
    """Texts lo..hi of an Arrow array as one byte buffer with document offsets."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    def tokens(self, separators: np.ndarray = SPACES) -> Tokens:
        return Tokens(self, separators)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Of a flag for each byte: how many are set in each document."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


class Tokens:
    """Maximal runs of bytes that aren't separators; none crosses a document's end."""

    def __init__(self, chunk: Chunk, separators: np.ndarray):
        self.chunk = chunk
        inside = ~separators[chunk.buf]
        n, off = len(inside), chunk.off
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = off[off < n]
        first[at] = inside[at]
        at = off[off > 0] - 1
        last[at] = inside[at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: the first token of each document, and their number at the end
        self.first = np.searchsorted(self.start, off)
        self.n = len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), np.diff(self.first))

    def hashes(self, seed: int = 1, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each token's bytes; fold maps bytes first."""
        if not self.n:
            return np.zeros(0, dtype=_U)
        length = self.end - self.start
        at = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(length, out=at[1:])
        rel = np.arange(at[-1]) - np.repeat(at[:-1], length)
        data = self.chunk.buf[np.repeat(self.start, length) + rel]
        table = byte_table(seed)
        if fold is not None:
            table = table[fold]
        values = table[data]
        values *= powers(0xD6E8FEB86659FD93, int(length.max()))[rel]
        return mix64(np.add.reduceat(values, at[:-1]) + length.astype(_U) * _BASE)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """(from, to, chunk) over an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi, Chunk(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over values[first[i]:first[i + 1]]; 0 for empty ones."""
    out = np.zeros(len(first) - 1, dtype=values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values[: first[-1]], first[:-1][full])
    return out


def gram_hashes(h: np.ndarray, k: int, seed: int = 0x632BE59BD9B4E019) -> np.ndarray:
    """A hash of h[i:i + k] for each i up to len(h) - k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for j in range(k):
        out *= _U(seed | 1)
        out += h[j : j + n]
    return mix64(out)


def inside_doc(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether tokens i..i + k - 1 are of one document, for each i up to n - k."""
    if n < k:
        return np.zeros(0, dtype=bool)
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(n - k + 1) + k <= end[: n - k + 1]


def settle(df: DataFrame) -> DataFrame:
    """Writes df under spark.checkpoint.dir, which all executors share, and reads it again.

    This cuts the lineage: a lost executor costs at most what follows. Parquet takes a
    fraction of the space of a checkpoint of rows and tells the planner its size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/solvegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    # results are read lazily, so the folder goes when the driver's JVM ends
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    release(spark)
    return out


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only in local mode without one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="solvegrid-"))
        found = context.getCheckpointDir()
    return found


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to any more.

    Memory that the driver's Python has freed goes back to the system, where the C library can.
    """
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, should their path lack it."""
    context = spark.sparkContext
    if getattr(context, "_solvegrid_shipped", False):
        return
    root = Path(__file__).parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / "solvegrid.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(to))
    context._solvegrid_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the queries. The session's Arrow batches get at most BATCH_ROWS rows from here on."""
    ship(spark)
    # texts are long: fewer rows a batch bound what a worker holds at once
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
