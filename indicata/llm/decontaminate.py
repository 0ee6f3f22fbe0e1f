"""Benchmark decontamination in DataFrame functions only.

Every window of 13 consecutive words of a benchmark item (the whole item, if it is
shorter) is looked for in every document.  The windows of the benchmark are cut into
blocks of a checked size; each block is broadcast and every document's windows are
probed against it by hash, then compared word by word.  Documents are read in place:
only hits, and one row per document, are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import ascii_lower, whole_rows, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words before lower-casing
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: windows of one broadcast block: with 13 words each, some tens of MB at most
BLOCK_WINDOWS = 200_000
#: a document is contaminated where 1 of this many words is hit
SHARE = 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: n, key (hash), gram, items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    items = items.filter("size(words) > 0 and item is not null")
    n = F.least(F.size("words"), F.lit(window))
    grams = items.select("item", n.alias("n"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("gram"))
    held = grams.groupBy("n", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # xxhash64 of an array is that of its elements one after the other
    return held.select("n", F.array_join("gram", " ").alias("gram"), "items", F.xxhash64("gram").alias("key"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, tie (hash of the text), n_words, ``spans``
    (array of (start, end), 0-based words, end exclusive, of the windows that occur),
    ``items`` (sorted ids of the items they belong to).

    A null or empty text has no words and no hits; so has any text if the benchmark is
    empty.  Items without words or without an id find nothing.  Rows that repeat an id
    are judged each by its own text."""
    windows = written(benchmark_windows(benchmark, window), "windows")
    lengths = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most 13 rows
    read = docs.select("doc_id", F.xxhash64("text").alias("tie"), words_of(F.col("text")).alias("words"))
    # a row for each word, made and probed within generated code: no lambda, so that the words stay one array in place
    places = read.select("doc_id", "tie", "words", F.posexplode_outer("words").alias("at", "word"))
    blocks = [(n, block, -(-count // block_windows)) for n, count in sorted(lengths.items()) for block in range(-(-count // block_windows))]
    found = []
    for n, block, of in blocks or [(window, 0, 1)]:
        known = windows.filter((F.col("n") == n) & (F.pmod("key", F.lit(of)) == block)).select(F.col("key").alias("k"), "gram", "items")
        key = F.xxhash64(F.col("word"), *[F.get("words", F.col("at") + j) for j in range(1, n)])
        here = F.array_join(F.slice("words", F.col("at") + 1, n), " ")
        # equal texts, told so that only the hash is a join key; words hold no space
        same = F.startswith(here, F.col("gram")) & F.startswith(F.col("gram"), here)
        probes = places.withColumn("key", F.when(F.col("at") + n <= F.size("words"), key))
        # in the first pass the first word's row of each document stays, for the document itself
        first = not found
        hit = probes.join(F.broadcast(known), (F.col("key") == F.col("k")) & same, "left" if first else "inner")
        if first:
            hit = hit.filter(F.col("k").isNotNull() | (F.coalesce(F.col("at"), F.lit(0)) == 0))
        stands = F.col("at").isNull() | (F.col("at") == 0) if first else F.lit(False)
        found.append(hit.select(
            "doc_id", "tie", F.when(stands, F.size("words")).alias("n_words"),
            F.when(F.col("k").isNotNull(), F.struct(F.col("at").alias("start"), (F.col("at") + n).alias("end"))).alias("span"), "items"))
    every = reduce(DataFrame.unionByName, found)
    judged = every.groupBy("doc_id", "tie").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("_rows"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return judged.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_row", "_rows")


def n_covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    state = F.struct(F.lit(0).alias("until"), F.lit(0).alias("covered"))
    return F.aggregate(spans, state, lambda s, x: F.struct(
        F.greatest(s["until"], x["end"]).alias("until"),
        (s["covered"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["until"]))).alias("covered")))["covered"]


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """``find_hits`` with n_hit and contaminated (hit words are 1 of ``share`` or more)."""
    hits = find_hits(docs, benchmark, **options).withColumn("n_hit", n_covered(F.col("spans")))
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _with_hits(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    hits = hits.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"}).dropDuplicates(["_id", "_tie"])
    return whole_rows(docs).join(hits, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc.text") == F.col("_tie")), how)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contamination(docs, benchmark, **options).filter("contaminated").select("doc_id", "tie")
    return _with_hits(docs, bad, "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the words of every hit span taken out of the text, each with what follows
    it up to the next word.  Texts without a hit stay untouched."""
    hits = contamination(docs, benchmark, **options).filter("n_hit > 0").select("doc_id", "tie", "spans")
    joined = _with_hits(docs, hits, "left")
    text = F.col("doc.text")
    gaps = F.split(text, WORD_ANY_CASE)
    kept = F.transform(F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), lambda w, i: F.when(
        F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.concat_ws("", kept))
    return joined.select(*[F.when(F.col("spans").isNotNull(), cut).otherwise(text).alias("text") if c == "text" else F.col(f"doc.`{c}`")
                           for c in docs.columns])
