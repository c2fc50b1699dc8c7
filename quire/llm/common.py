"""Shared plumbing of the corpus operators: tables, scratch tables, word hashing.

Nothing here keeps state on one machine: scratch data is written as Parquet below the
folder named by ``spark.checkpoint.dir``, which every executor shares, so a lost executor
costs a task rerun and never a lost intermediate result.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text a Python worker handles at once, in bytes: bounds its memory whatever the partition size.
BLOCK_BYTES = 4 << 20
#: Arrow batches between the JVM and Python workers, in bytes; Spark's own default (64 MB) costs an executor hundreds of MB.
ARROW_BYTES = 16 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of ``ARROW_BYTES`` at most; a smaller bound of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session; one is made only where none is set and Spark runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quire_scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark._quire_scratch = found
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_HELD: list = [None]


def release() -> None:
    """Give freed memory of this process back: a worker process outlives its task, and executors count its pages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def take_over(cache) -> None:
    """Make ``cache`` what this worker process remembers; what another operator left there is cleared."""
    if _HELD[0] is not None and _HELD[0] is not cache:
        _HELD[0].clear()
        release()
    _HELD[0] = cache


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, cache=None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text (one row at least).

    cache: what this operator remembers while a task lasts. Its entries go at the task's end (``forget``, or else ``clear``):
    executors keep more workers than they have cores, and hand them out in turn.
    """
    take_over(cache)
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    if cache is not None:
        getattr(cache, "forget", cache.clear)()
    release()


def fold(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at bytes 0x20 and 0x09-0x0D and nowhere else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, with a bound on what is remembered."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their gaps, compressed."""
    import zstandard

    gaps = np.diff(values, prepend=U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(U).ravel(), dtype=U)


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)
