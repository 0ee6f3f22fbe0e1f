"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted: one over the whole raw corpus, one over
documents that labels call good (the trusted target).  N-grams are of character shapes,
and of two code points in scripts without capitals, whose shapes say little.  The
multinomials are of each script by itself, so that a script that the labels hold little
of isn't taken for noise.  A document's score is
the sum of log p_target - log p_raw over its n-grams, divided by their number; it is
kept where the score reaches a threshold, the same for every document and run.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import CONTINUATION, SPACE, gram_buckets, in_chunks, text_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: n of the n-grams, and bits of a bucket: a model is 2**BITS numbers
GRAM, BITS = 6, 16
#: occurrences, in the raw corpus's proportion, that are added to what a bucket has in the target and to what it should have
PRIOR = 4
#: scripts are numbered; n-grams of code points are counted beside those of shapes under the script's number + LEXICAL
LEXICAL = 128
#: scripts that are written together or have letters under several names
SAME = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "IDEOGRAPHIC": "CJK", "HALFWIDTH": "CJK", **dict.fromkeys(
    ("FULLWIDTH", "FEMININE", "MASCULINE", "MODIFIER", "COMBINING", "MICRO"), "LATIN")}
#: labelled good documents that the target is counted over, at most
TARGET_DOCUMENTS = 20_000
#: documents below this score (nats per n-gram) are rejected
THRESHOLD = -0.10
#: a log ratio is held as an integer of 1 / SCALE, so that sums don't depend on their order
SCALE = 1 << 16

def _tables() -> tuple[bytes, bytes]:
    """Shape and script of each code point, deflated.

    Letters, capitals and digits are alike, marks and spaces beyond ASCII are as the ASCII ones they
    stand for; caseless letters have the shape "o".  The script is 0 for Latin and what all scripts share."""
    numbers, shapes, scripts = {"LATIN": 0}, bytearray(0x110000), bytearray(0x110000)
    marks = {"Pd": "-", "Ps": "(", "Pe": ")", "Pi": '"', "Pf": '"', "Pc": "_", "Po": ".", "Zl": "\n", "Zp": "\n"}
    like = {0xA1: "!", 0xBF: "?", 0x3001: ",", 0x60C: ",", 0x61F: "?"}
    for point in range(0x110000):
        char = chr(point)
        kind = unicodedata.category(char)
        script = 0
        if point < 128:
            shape = "a" if char.islower() else "A" if char.isupper() else "0" if char.isdigit() else char
        elif kind[0] in "LM":
            shape = "A" if kind in ("Lu", "Lt") else "o" if kind in ("Lo", "Mc", "Mn") else "a"
            word = unicodedata.name(char, "LATIN").split()[0]
            script = numbers.setdefault(SAME.get(word, word), min(len(numbers), LEXICAL - 1))
            shape = "a" if not script and shape == "o" else shape
        elif kind[0] == "N":
            shape = "0"
        else:
            plain = like.get(point) or (unicodedata.normalize("NFKC", char) if kind[0] in "PSZ" else "")
            shape = plain if len(plain) == 1 and plain < "\x7f" else marks.get(kind, {"P": ".", "Z": " ", "S": "+"}.get(kind[0], "~"))
        shapes[point], scripts[point] = ord(shape), script
    return zlib.compress(bytes(shapes)), zlib.compress(bytes(scripts))


SHAPES, SCRIPTS = _tables()

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def n_repeated(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times, covered, until = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return (len(words), len(text.translate(None, SPACE + CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), n_repeated(words))


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCUMENTS) -> list[int]:
    """Up to ``most`` ids that labels call good, those of the smallest hash."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return [r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def reader() -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """What reads texts into n-grams: the text that each lies in, and script << BITS | bucket."""
    shape_of, script_of = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (SHAPES, SCRIPTS))

    def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), "<u4") for t in texts]
        data = np.concatenate(points) if points else np.empty(0, np.uint32)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in points])
        shapes = shape_of[data]
        buckets = gram_buckets(shapes, GRAM, BITS)
        m = len(buckets)
        whole = of[:m] == of[GRAM - 1:]  # n-grams that cross into the next text are left out
        if not (data > 127).any():
            return of[:m][whole], buckets[whole]
        scripts = script_of[data]
        if not scripts.any():
            return of[:m][whole], buckets[whole]
        script = scripts[:m].copy()
        for k in range(1, GRAM):
            np.maximum(script, scripts[k:k + m], out=script)
        grams = (script.astype(np.uint32) << np.uint32(BITS) | buckets)[whole]
        caseless = (shapes == ord("o")) & (scripts > 0)
        pair = np.flatnonzero(caseless[:-1] & caseless[1:] & (of[:-1] == of[1:]))
        h = (data[pair] * np.uint32(0x9E3779B1) ^ data[pair + 1]) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        lexical = (scripts[pair].astype(np.uint32) + np.uint32(LEXICAL)) << np.uint32(BITS) | h
        return np.concatenate([of[:m][whole], of[pair]]), np.concatenate([grams, lexical])

    return read


def rows_of(grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each n-gram stands in a model whose rows the scripts have as ``rows`` tells."""
    return rows[grams >> np.uint32(BITS)] << BITS | (grams & np.uint32((1 << BITS) - 1)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, most: int = TARGET_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """The row of each script in the model, and the log ratio of each bucket, in 1 / SCALE.
    Without a trusted document every ratio is 0, as is that of a script without any.  Raw
    counts cover every document; each task sends its buckets' sums, never texts."""
    trusted = docs.sparkSession.sparkContext.broadcast(frozenset(trusted_ids(labels, most)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, sums = reader(), {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for which, chosen in ((0, texts), (1, [t for k, t in zip(keys, texts) if k in trusted.value])):
                for a, b in in_chunks(chosen):
                    grams = read(chosen[a:b])[1]
                    held = np.flatnonzero(np.bincount(grams >> np.uint32(BITS), minlength=256))
                    rows = np.zeros(256, np.int64)
                    rows[held] = np.arange(len(held))
                    found = np.bincount(rows_of(grams, rows), minlength=len(held) << BITS).reshape(-1, 1 << BITS)
                    for script, row in zip(held.tolist(), found):
                        sums.setdefault(script, np.zeros((2, 1 << BITS), np.int64))[which] += row
        for script, (raw, target) in sums.items():
            seen = np.flatnonzero(raw + target)
            yield pa.RecordBatch.from_arrays([pa.array(seen + (script << BITS)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    model = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    at = model["bucket"].to_numpy(np.int64)
    scripts = sorted({0, *(at >> BITS).tolist()})
    rows = np.zeros(256, np.int64)
    rows[scripts] = np.arange(len(scripts))
    raw, target = np.zeros((len(scripts), 1 << BITS)), np.zeros((len(scripts), 1 << BITS))
    raw[rows[at >> BITS], at & ((1 << BITS) - 1)] = model["raw"].astype(float)
    target[rows[at >> BITS], at & ((1 << BITS) - 1)] = model["target"].astype(float)
    # what each bucket should have in the target; a bucket that the target is too small to tell of has a ratio near 0
    due = raw / np.maximum(raw.sum(1, keepdims=True), 1) * target.sum(1, keepdims=True)
    # the target is smoothed by as much of the raw corpus: an n-gram that a small sample missed costs no more than log 2
    ratio = np.log(((target + PRIOR) / (due + PRIOR) + 1) / 2)
    return rows, np.rint(np.clip(ratio, -8, 8) * SCALE).astype(np.int64).reshape(-1)


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, most: int) -> DataFrame:
    """``docs`` with its columns named by number (c0, c1, ...), the counts, llr, base_failed and kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    added = f"{COUNTS}, llr double"
    names = [*numbered.columns, *(x.split()[0] for x in added.split(", "))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, (rows, weights) = reader(), model.value
        for batch in batches:
            texts = text_bytes(batch.column(at))
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            sums, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, b in in_chunks(texts):
                of, grams = read(texts[a:b])
                n[a:b] = np.bincount(of, minlength=b - a)
                sums[a:b] = np.bincount(of, weights[rows_of(grams, rows)], b - a)  # of integers below 2**53: exact
            llr = sums / np.maximum(n, 1) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in counts.T), pa.array(llr)], names=names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema), added])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = numbered.mapInArrow(judge, schema).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TARGET_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, llr (nats per n-gram; 0 for a text
    too short to have one), base_failed, kept.

    A null or empty text has no words, so it fails the base rules.  Every row is judged by
    its own text: ties and repeated rows get equal results, a null doc_id only keeps a row
    out of the trusted target.  Without good labels every llr is 0."""
    judged = _judged(docs.select("doc_id", "text"), labels, threshold, most)
    return judged.drop("c1").withColumnRenamed("c0", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TARGET_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    kept = _judged(docs, labels, threshold, most).filter("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
