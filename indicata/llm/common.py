"""Helpers shared by the corpus operators: shared scratch tables, Arrow text access, hashed byte n-grams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the white space of every word and trim rule: \x20 and \x09-\x0D
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 continuation bytes: deleting them leaves one byte per code point
CONTINUATION = bytes(range(0x80, 0xC0))
#: bytes of text that the vectorised scorers take at a time
CHUNK_BYTES = 2 << 20

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local_scratch: dict[str, str] = {}
_folders: dict[int, tuple[DataFrame, str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would be a machine-local folder, so it is an error there."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="indicata-llm-")
    return _local_scratch[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: the
    lineage ends there, so a lost executor costs no recomputation of what made it.
    The table goes when the session ends."""
    spark = df.sparkSession
    folder = f"{scratch_root(spark)}/indicata-{uuid.uuid4().hex}"
    # long texts in Arrow batches of the default 10,000 rows would take much of an executor's memory
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(before), 1000) if int(before) > 0 else 1000))
    try:
        df.write.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(ARROW_ROWS, before)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _folders[id(back)] = (back, folder)
    return back


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for table in tables:
        _, folder = _folders.pop(id(table), (None, None))
        if folder:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``doc``: joins and helper columns beside it can't clash with
    any of its names.  ``select("doc.*")`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row; null as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def in_chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def gram_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket (0 to 2**bits - 1) of the byte n-gram that begins at each position."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= data[k:k + m]
        h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def gram_sums(texts: list[bytes], n: int, bits: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of ``weights[bucket]`` over its n-grams (one column per
    column of ``weights``) and the number of n-grams.  ``weights`` are integers, so
    the sums don't depend on how texts are batched."""
    sums = np.zeros((len(texts), weights.shape[1]), np.int64)
    counts = np.zeros(len(texts), np.int64)
    for a, b in in_chunks(texts):
        ends = np.cumsum([len(t) for t in texts[a:b]])
        starts = ends - [len(t) for t in texts[a:b]]
        buckets = gram_buckets(np.frombuffer(b"".join(texts[a:b]), np.uint8), n, bits)
        last = np.maximum(ends - n + 1, starts)  # n-grams that cross into the next text are left out
        counts[a:b] = last - starts
        top = np.minimum(last, len(buckets))
        low = np.minimum(starts, len(buckets))
        for c in range(weights.shape[1]):
            running = np.zeros(len(buckets) + 1, np.int64)
            np.cumsum(weights[:, c][buckets], out=running[1:])
            sums[a:b, c] = running[top] - running[low]
    return sums, counts
