"""Language identification by hierarchical discrimination.

A text is first given to a language family, by one linear separator per family; then
one-versus-one linear support vector machines separate the languages of that family
and vote.  Features are frequencies of hashed byte n-grams of the whole lower-cased text,
so a document's margin is the mean weight of its n-grams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import gram_buckets, gram_sums, text_bytes

# --- fixed values: families of ISO 639-1 codes; any other code is a family of its own ---
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"

GRAMS, BITS = (1, 2, 3), 12
#: labelled documents of a language that the machines are fitted on, and of all languages together
PER_LANGUAGE, IN_ALL = 200, 2000
#: languages that are learned: those of the most labelled documents, ties by code.  The rarest labels beyond
#: aren't learned, so sample, separators (one a family, one a pair within) and fit are bounded whatever the labels hold
LANGUAGES = 64
#: weights are held as integers of 1 / SCALE
SCALE = 1 << 20


@dataclass(frozen=True)
class Model:
    """Columns of ``weights`` (a block of 2**BITS rows for each n) and ``bias`` are separators:
    first those of the families, then those of the pairs."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), self.weights.shape[1]))
        for k, n in enumerate(GRAMS):
            sums, counts = gram_sums(texts, n, BITS, self.weights[k << BITS:(k + 1) << BITS])
            total += sums / np.maximum(counts, 1)[:, None] / SCALE
        return total + self.bias

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        margins = self.margins(texts)
        out = []
        for row in margins:
            at = int(np.argmax(row[:len(self.families)]))
            family = self.families[at]
            chances = 1 / (1 + np.exp(-row[:len(self.families)]))
            score = float(chances[at] / chances.sum()) if len(self.families) > 1 else 1.0
            votes, least = {code: 0.0 for code in self.members[family]}, {code: 1.0 for code in self.members[family]}
            for (one, other), margin in zip(self.pairs, row[len(self.families):]):
                if one in votes:
                    chance = 1 / (1 + np.exp(-margin))
                    votes[one] += (margin > 0) + 1e-3 * chance
                    votes[other] += (margin <= 0) + 1e-3 * (1 - chance)
                    least[one], least[other] = min(least[one], chance), min(least[other], 1 - chance)
            best = max(sorted(votes), key=votes.get)
            out.append((best, float(min(1.0, max(0.0, score * least[best])))))
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: bytes) -> np.ndarray:
    """Frequencies of the buckets, a block for each n."""
    data, blocks = np.frombuffer(text, np.uint8), []
    for n in GRAMS:
        buckets = gram_buckets(data, n, BITS)
        blocks.append(np.bincount(buckets, minlength=1 << BITS) / max(1, len(buckets)))
    return np.concatenate(blocks).astype(np.float32)


def fit_separator(x: np.ndarray, y: np.ndarray, cost: float = 500.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) by dual coordinate descent, classes
    weighed alike; y is +1 or -1, and both occur.  The order is fixed, so reruns agree."""
    rng, x = np.random.default_rng(0), np.hstack([x, np.full((len(x), 1), 0.1, x.dtype)])
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    diagonal = 0.5 / (cost * balance)
    square = (x.astype(np.float64) ** 2).sum(1) + diagonal
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1] * 0.1)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, languages: int = LANGUAGES) -> DataFrame:
    """Labelled documents to learn from, ``in_all`` at most: of each of the most frequent ``languages``
    (at most half of ``in_all``) those of the smallest id hash."""
    named = docs.filter("lang is not null and doc_id is not null and text is not null and text != ''").select("lang", "doc_id")
    learn = named.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    frequent = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(min(languages, in_all // 2)).collect()
    most = min(per_language, in_all // max(1, len(frequent)))
    learn = learn.filter(F.col("lang").isin([r["lang"] for r in frequent]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = learn.distinct().withColumn("_rank", rank).filter(F.col("_rank") <= most).select("lang", "doc_id")
    # at most ``in_all`` rows of two columns
    return docs.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").select("lang", "doc_id", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, languages: int = LANGUAGES) -> Model:
    """The machines, fitted on the driver on a sample of at most ``in_all`` documents of ``languages``
    languages, which arrive as feature vectors of fixed size; rows that repeat an id count once."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, key, features(t.decode("utf-8", "replace").lower().encode())) for lang, key, t in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
                names=["lang", "doc_id", "vector"])

    # an id that many rows repeat counts once, by its least vector: no more rows than ids reach the driver
    got = sample(docs, per_language, in_all, languages).mapInArrow(vectors, "lang string, doc_id long, vector binary").groupBy("lang", "doc_id").agg(
        F.min("vector").alias("vector")).collect()
    rows = {(r["lang"], r["doc_id"], bytes(r["vector"])) for r in got}
    by_lang: dict[str, list[np.ndarray]] = defaultdict(list)
    for lang, _, vector in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_lang[lang].append(np.frombuffer(vector, np.float32))
    members: dict[str, list[str]] = defaultdict(list)
    for lang in sorted(by_lang):
        members[FAMILY_OF.get(lang, lang)].append(lang)
    families, columns, bias, pairs = sorted(members), [], [], []

    def add(one: list[np.ndarray], other: list[np.ndarray]) -> None:
        if one and other:
            w, b = fit_separator(np.vstack(one + other), np.array([1.0] * len(one) + [-1.0] * len(other)))
        else:
            w, b = np.zeros(len(GRAMS) << BITS), 1.0
        columns.append(w)
        bias.append(b)

    for family in families:
        add([v for lang in members[family] for v in by_lang[lang]], [v for lang in by_lang if lang not in members[family] for v in by_lang[lang]])
    for family in families:
        for pair in combinations(members[family], 2):
            pairs.append(pair)
            add(by_lang[pair[0]], by_lang[pair[1]])
    weights = np.column_stack(columns) if columns else np.zeros((len(GRAMS) << BITS, 0))
    return Model(families, dict(members), pairs, np.rint(weights * SCALE).astype(np.int64), np.array(bias))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where
    no labelled document was there to learn from.  The prediction looks at nothing but the
    text, whole, however long; rows that repeat an id are judged each by its own.  A null id is not held
    out and not learned from.  Where votes or margins tie, the first language or family by code wins.
    An empty table gives an empty one; columns of other names are left aside, whatever they are called."""
    found = model or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast((found.families, found.members, found.pairs, found.weights, found.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t.decode("utf-8", "replace") for t in text_bytes(part.column(1))]
                got = [(UNKNOWN, 0.0)] * len(texts)
                told = [i for i, t in enumerate(texts) if model.families and has_letter(t)]
                for i, pair in zip(told, model.predict([texts[i].lower().encode() for i in told])):
                    got[i] = pair
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", rest.alias("held_out"), "lang_pred", "score")
