"""Line dedup by range-partitioned line hashes.

Long lines become (hash, document, positions); these are range-partitioned and sorted
by hash, then document from the largest id down, then position, so the first row of a
run of one hash names the document that keeps the line.  A run of a hot line spans as
many partitions as its rows need; what only the neighbours know about the first and
last run of a partition is settled with a summary of two rows a partition.  The result
is a compressed keep bitmap for each document that loses lines, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import CONTINUATION, SPACE, text_bytes, written

#: code points that a line's key needs
MIN_LENGTH = 40
#: documents that a key needs to be dropped
MIN_DOCUMENTS = 5

_ROW = "h1 long, h2 long, doc_id long, tie long, n_lines int, positions array<int>"
_STREAM = f"kind string, part int, n_docs long, {_ROW}"


def line_key(line: bytes) -> bytes:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.translate(None, CONTINUATION)) >= least)


def line_rows(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """A row for each document and distinct long line in it: 128-bit hash and positions."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for doc_id, tie, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2))):
                    held: dict[bytes, list[int]] = {}
                    lines = text.split(b"\n")
                    for i, line in enumerate(lines):
                        if len(line) >= min_length and _long_enough(key := line_key(line), min_length):
                            held.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                    for digest, positions in held.items():
                        h1, h2 = np.frombuffer(digest, ">i8").tolist()
                        out.append((h1, h2, doc_id, tie, len(lines), positions))
                yield _batch(out, _ROW_TYPES)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text").mapInArrow(explode, _ROW)


_ROW_TYPES = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "tie": pa.int64(), "n_lines": pa.int32(), "positions": pa.list_(pa.int32())}
_STREAM_TYPES = {"kind": pa.string(), "part": pa.int32(), "n_docs": pa.int64(), **_ROW_TYPES}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _stream(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted partition.  Emits 'drop' rows where the partition alone
    decides, 'open' rows where a neighbour has a say, and a 'run' row (distinct
    documents, first document) for its first and its last run.  Holds no more than the
    rows of fewer than ``least`` documents of one run."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    key, runs, n_docs, keeper, last, held = None, 0, 0, None, None, []

    def emit(kind: str, row: tuple) -> None:
        out.append((kind, part, 0, *row))

    def end(final: bool) -> None:
        if key is None:
            return
        if runs == 1 or final:
            out.append(("run", part, n_docs, *key, keeper, 0, 0, []))
            if runs > 1:  # its start is here, and fewer than ``least`` documents so far: the next partition may have more
                for row in held:
                    emit("open", row)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                end(False)
                key, runs, n_docs, keeper, last, held = row[:2], runs + 1, 0, row[2], object(), []
            if row[2] != last:
                last, n_docs = row[2], n_docs + 1
            if runs == 1:  # the run may have begun in an earlier partition
                emit("open", row)
            elif n_docs < least:
                held.append(row)
            else:
                for kept in held:
                    if kept[2] != keeper:
                        emit("drop", kept)
                held = []
                emit("drop", row)
            if len(out) >= 5000:
                yield _batch(out, _STREAM_TYPES)
                out.clear()
    end(True)
    yield _batch(out, _STREAM_TYPES)


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, tie, n_lines, n_dropped, bitmap) for each document that loses lines; ``tie``
    is the hash of its text, ``bitmap`` the zlib-packed bits of the lines that stay.

    A key found in ``min_documents`` distinct ids or more stays in the largest of them,
    at all its positions, and goes everywhere else; null counts as one id, the smallest.
    Rows that repeat an id count once, and each is cut by its own text.  A null or empty
    text is one empty line, which is too short to go."""
    order = (F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("tie"))
    # written first, so that the range bounds are sampled from it and not from the texts again
    rows = written(line_rows(docs, min_length), "lines")
    # equal (hash, id) never part, as both are in the range key: counts of distinct ids add up
    runs = written(rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
                   .mapInArrow(lambda batches: _stream(batches, min_documents), _STREAM), "runs")
    # two rows a partition at most, whatever the data
    whole = runs.filter("kind = 'run'").groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("keeper"))
    whole = whole.filter(F.col("total") >= min_documents)
    settled = runs.filter("kind = 'open'").join(F.broadcast(whole), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    columns = ["doc_id", "tie", "n_lines", "positions"]
    dropped = runs.filter("kind = 'drop'").select(*columns).unionByName(settled.select(*columns))
    # a repeated row repeats its positions: the bitmap doesn't mind
    per_doc = dropped.groupBy("doc_id", "tie").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("positions")).alias("positions"))

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, tie, n_lines, positions in zip(*(c.to_pylist() for c in batch.columns)):
                keep = np.ones(n_lines, np.uint8)
                keep[positions] = 0
                out.append((doc_id, tie, n_lines, n_lines - int(keep.sum()), zlib.compress(np.packbits(keep).tobytes())))
            yield _batch(out, {"doc_id": pa.int64(), "tie": pa.int64(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "bitmap": pa.binary()})

    return per_doc.mapInArrow(bitmap, "doc_id long, tie long, n_lines long, n_dropped long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (before), n_dropped, text (what stays,
    joined by \\n; empty for null) and bitmap (null where every line stays)."""
    cut = bitmaps.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "bitmap").hint("shuffle_hash")
    read = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    joined = read.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").select("doc_id", "text", "bitmap")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n_lines, n_dropped, texts = [], [], []
                for text, packed in zip(text_bytes(part.column(1)), part.column(2).to_pylist()):
                    own = text.split(b"\n")
                    kept = own
                    if packed is not None:
                        keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(own))
                        kept = [own[i] for i in np.flatnonzero(keep)]
                    n_lines.append(len(own))
                    n_dropped.append(len(own) - len(kept))
                    texts.append(b"\n".join(kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), part.column(2)],
                    names=["doc_id", "n_lines", "n_dropped", "text", "bitmap"])

    return joined.mapInArrow(lines, "doc_id long, n_lines long, n_dropped long, text string, bitmap binary")
