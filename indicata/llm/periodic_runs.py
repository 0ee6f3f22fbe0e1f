"""Periodic runs of words, by tiles of every period octave.

A run is a maximal stretch of words that repeats with a period (words a period apart are
equal).  Each document is cut into overlapping tiles once per octave of periods: the tiles
of an octave m, which holds the periods from m to 2m - 1, begin at every m-th word, reach
m words back and 4m words on, and are solved by themselves.  The boundary of a tile is its
m-th word; Z-functions of the words after it, and of the words before it read backwards,
say for every period how far the words on both sides of the boundary agree with those one
period on.  That is a fragment of a run, cut at the edges of the tile.  Fragments are
shuffled by document and period and stitched where they touch; what is long enough is a run.

A run of at least three periods covers, from its first boundary on, whole strides of m
words, so its fragments overlap.  A tile is only cut out where the hashes of the m words
after its boundary and of those one period on agree, as they must within any run.  A period
that is a multiple of a smaller one is told by the same Z-function and isn't reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import text_bytes, written

#: a run has at least this many words and this many periods
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: tiles of the first octave, which holds all periods below twice this, begin this many words apart.
#: Strides and octaves rely on at least three periods and on 3 * FIRST words
FIRST = 8

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def z_function(s: list[int]) -> list[int]:
    """For each position how many items from there on equal the first ones; the whole length at 0."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(m, boundary, periods) of the tiles in which some period of the octave may hold for m words."""
    n, m = len(ids), 1
    if n < LEAST_WORDS:
        return
    hashed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX_A
    hashed ^= hashed >> np.uint64(29)
    while m < FIRST:
        hashed = _doubled(hashed, m)
        m *= 2
    found: dict[int, list[int]] = {}
    anchors = hashed[::m]
    for period in range(1, 2 * m):
        other = hashed[period::m]
        for k in np.flatnonzero(anchors[:len(other)] == other).tolist():
            found.setdefault(k * m, []).append(period)
    yield from ((m, at, found[at]) for at in sorted(found))
    while LEAST_PERIODS * 2 * m <= n:
        hashed = _doubled(hashed, m)
        m *= 2
        later = hashed[m:]
        hits = np.flatnonzero(np.repeat(hashed[::m], m)[:len(later)] == later)
        for at in np.unique(hits // m).tolist():
            yield m, at * m, (hits[np.searchsorted(hits, at * m):np.searchsorted(hits, at * m + m)] - at * m + m).tolist()


def _doubled(hashed: np.ndarray, m: int) -> np.ndarray:
    """Hashes of 2m words from those of m words."""
    both = hashed[:-m] * _MIX_A + hashed[m:] * _MIX_B
    both ^= both >> np.uint64(31)
    return both * _MIX_B


def fragments(tile: list[int], boundary: int, m: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """(period, low, high) of a tile, relative to its boundary: the words from low to high, exclusive,
    equal those one period on; at most m words back and 2m on.  Periods that aren't the smallest are left out."""
    z = z_function(tile[boundary:])
    # a period d of the first words reaches to d + z[d]; one that reaches a period and m words on divides that period
    reach, top = [0] * (m + 1), 0
    for d in range(1, min(m + 1, len(z))):
        top = max(top, d + z[d])
        reach[d] = top
    own = [q for q in periods if q < len(z) and z[q] >= m and reach[min(m, q - 1)] < q + m]
    if not own:
        return []
    before, end = tile[:boundary][::-1], min(len(tile), boundary + 2 * m)
    back = z_function([*before, -1, *tile[:end][::-1]])
    at = len(before) + 1 + end - boundary
    return [(q, -min(back[at - q], len(before)) if at - q < len(back) else 0, min(z[q], 2 * m)) for q in own]


def document_fragments(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, low, high) of all tiles of a document, in word numbers."""
    out = []
    for m, at, periods in tiles(ids):
        begin = max(0, at - m)
        tile = ids[begin:at + 4 * m].tolist()
        out += [(q, at + low, at + high) for q, low, high in fragments(tile, at - begin, m, periods)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run (start, length, period) contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


_FRAGMENT = pa.struct([("period", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def solve(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, tie (hash of the text), n_words, the fragments, and its
    words joined by one space where it has fragments, else the digest of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ties, counts, found, texts, digests = [], [], [], [], []
                for raw in text_bytes(part.column(1)):
                    words = raw.split()
                    own = document_fragments(word_ids(words))
                    joined = b" ".join(words)
                    ties.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    counts.append(len(words))
                    found.append([{"period": q, "low": low, "high": high} for q, low, high in own])
                    texts.append(joined if own else None)
                    digests.append(None if own else hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ties, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_FRAGMENT)),
                     pa.array(texts, pa.binary()), pa.array(digests, pa.string())],
                    names=["doc_id", "tie", "n_words", "fragments", "words", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, tie long, n_words long, fragments array<struct<period: long, low: long, high: long>>, words binary, digest string")


def stitch(solved: DataFrame) -> DataFrame:
    """(doc_id, tie, start, length, period) of the runs: fragments of a document and period that
    overlap or touch are one."""
    pieces = solved.select("doc_id", "tie", F.explode("fragments").alias("f")).select("doc_id", "tie", "f.*").distinct()
    in_order = Window.partitionBy("doc_id", "tie", "period").orderBy("low", "high")
    reached = F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached >= F.col("low"), 0).otherwise(1)
    numbered = pieces.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("doc_id", "tie", "period", "_run").agg(F.min("low").alias("start"), F.max("high").alias("_high"))
    whole = whole.select("doc_id", "tie", "start", (F.col("_high") - F.col("start") + F.col("period")).alias("length"), "period")
    return whole.filter((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period")))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are left aside): doc_id, n_words, runs
    (array of start, length, period in word numbers, by start, then period), n_runs, the run of
    greatest exact length/period as start, length, period, exponent_milli (ties: smallest start,
    then period; null without a run), runs_sha256, collapsed (the text without the words that a run
    contains after its first period; null without a run, where all words stay) and collapsed_sha256.

    A null or empty text has no words and no run; a null doc_id is a value like any other.  Rows
    that repeat an id are taken each by its own text, and equal rows share their runs.  An empty
    table gives an empty one.  A text of any length is solved tile by tile, in time n log n;
    one text's words are held by one task, as the table holds it in one cell."""
    solved = written(solve(docs), "solved")
    runs = stitch(solved).groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    own = runs.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "runs")
    joined = solved.filter("words is not null").select("doc_id", "tie", "n_words", "words").join(
        own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    joined = joined.select("doc_id", "n_words", "words", "runs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, digests = [], []
                for raw, runs in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    found = [(r["start"], r["length"], r["period"]) for r in runs or []]
                    text = collapsed(raw.split(b" "), found)
                    texts.append(text if found else None)
                    digests.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3).cast(pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string()),
                     pa.array(digests, pa.string())], names=["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"])

    run_type = "array<struct<start: long, period: long, length: long>>"
    ended = joined.mapInArrow(finish, f"doc_id long, n_words long, runs {run_type}, collapsed string, collapsed_sha256 string")
    plain = solved.filter("words is null").select(
        "doc_id", "n_words", F.expr(f"cast(null as {run_type})").alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("digest").alias("collapsed_sha256"))
    every = ended.unionByName(plain).withColumn("runs", F.coalesce("runs", F.expr(f"cast(array() as {run_type})")))
    # quotients of integers below 2**26 are distinct doubles where the exact ones are
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period as exponent, -r.start as start, -r.period as period, r.length as length)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    told = every.withColumn("_best", F.when(F.size("runs") > 0, best))
    return told.select(
        "doc_id", "n_words", F.expr("transform(runs, r -> struct(r.start, r.length, r.period))").alias("runs"),
        F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), "collapsed", "collapsed_sha256")


_RUN = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])
