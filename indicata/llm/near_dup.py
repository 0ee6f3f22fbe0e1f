"""Near-duplicate groups by min-max hashing.

Each document's distinct word shingles are hashed under PERMUTATIONS permutations and
both the minimum and the maximum of each are kept: two signature values for one hash
evaluation.  Bands of PER_BAND permutations (twice as many values) propose candidates;
links are confirmed on the full shingle sets, never on signatures.

Documents with equal sets are one class from the start, and only classes are compared.
In a bucket, a class is first compared with one representative, which resolves most
buckets.  Buckets that still hold several components are then swept pair by pair in
blocks of bounded size, skipping pairs already connected or whose sketches rule them
out, until no bucket can add a link.  Components come from alternating large and small
stars over written tables; nothing of the corpus goes to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import drop_written, text_bytes, whole_rows, written

SHINGLE = 4
#: links need 100 * intersection >= PERCENT * union
PERCENT = 80
#: 50 bands of 6 values: a pair at 0.8 is missed with probability (1 - 0.8**6)**50 = 2.5e-7
PERMUTATIONS, PER_BAND = 150, 3
#: the sketch has a byte of each signature value; pairs with a smaller share of equal bytes aren't
#: confirmed: 5.6 standard deviations under 0.8, so a link is missed with probability 1e-8
SKETCH_LEAST = 0.67
#: rows of a bucket that one block of a sweep holds
BLOCK_ROWS = 1024

_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


MULTIPLIERS, OFFSETS = _constants(PERMUTATIONS, 11) | np.uint64(1), _constants(PERMUTATIONS, 12)
BAND_MIX = _constants(2 * PER_BAND, 13) | np.uint64(1)
WORD_MIX = _constants(64, 14) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Distinct shingles; with fewer words the whole sequence is one."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k:len(h) - width + 1 + k] * WORD_MIX[k]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the shingles under each permutation."""
    low, high = np.full(PERMUTATIONS, _MASK, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 512):  # a block that stays in the cache, however long the text
        hashed = shingles[None, at:at + 512] ^ OFFSETS[:, None]
        hashed *= MULTIPLIERS[:, None]
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return low, high


def bands_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A key for each band, which holds the band's number too."""
    values = np.stack([low, high], 1).reshape(-1, 2 * PER_BAND)
    return mixed((values * BAND_MIX).sum(1, dtype=np.uint64) + np.arange(len(values), dtype=np.uint64))


def sketch_of(low: np.ndarray, high: np.ndarray) -> bytes:
    both = np.concatenate([low, high])
    return ((both ^ (both >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, tie (hash of the text), n_shingles, s1 and s2 (128-bit hash of the set),
    bands and sketch (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sizes, s1, s2, bands, sketches = [], [], [], [], []
                for text in text_bytes(part.column(2)):
                    shingles = shingle_hashes(words_of(text))
                    one, two = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), ">i8").tolist()
                    sizes.append(len(shingles))
                    s1.append(one)
                    s2.append(two)
                    if len(shingles):
                        low, high = signature(shingles)
                        bands.append(bands_of(low, high).view(np.int64))
                        sketches.append(sketch_of(low, high))
                    else:
                        bands.append(None)
                        sketches.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "tie", "n_shingles", "s1", "s2", "bands", "sketch"])

    schema = "doc_id long, tie long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text").mapInArrow(sign, schema)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                keep = []
                for i, (left, right) in enumerate(zip(text_bytes(part.column(2)), text_bytes(part.column(3)))):
                    if b[i] != last:
                        last, last_set = b[i], shingle_set(words_of(right))
                    own = shingle_set(words_of(left))
                    common = len(own & last_set)
                    if 100 * common >= percent * (len(own) + len(last_set) - common):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the linked nodes but the roots, which are the smallest of their
    components: large and small stars in turn, each pass written, until all that is left is stars."""
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        count, sources = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if count == sources and not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").head(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        drop_written(before)


def _propose(band, nodes, roots, sizes, sides, sketches, bands, percent: int, every: bool) -> tuple[list[tuple[int, list[int]]], bool]:
    """Pairs of one block that may be linked and aren't connected, and whether some wait.  A pair
    belongs to the first band that its members share.  Unless ``every`` is asked for, the pairs
    that a likelier chain of pairs would connect wait until that chain has been confirmed or not;
    with it, each member of a pair has a row, and the pair is listed in one of them."""
    found: list[tuple[float, int, int]] = []
    two_sided = sides.min() != sides.max()
    for i in range(len(nodes) - 1):
        rest = slice(i + 1, None)
        may = (roots[rest] != roots[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if two_sided:
            may &= sides[rest] != sides[i]
        others = np.flatnonzero(may) + i + 1
        others = others[(bands[others] == bands[i]).argmax(1) == band]
        if not len(others):
            continue
        alike = (sketches[others] == sketches[i]).mean(1)
        found += [(-share, i, j) for share, j in zip(alike.tolist(), others.tolist()) if share >= SKETCH_LEAST]
    if every:
        listed: dict[int, list[int]] = {}
        for _, i, j in found:
            listed.setdefault(int(nodes[i]), []).append(int(nodes[j]))
            listed.setdefault(int(nodes[j]), [])
        return list(listed.items()), False
    top = {r: r for r in set(roots.tolist())}

    def find(r: int) -> int:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    pairs = []
    for _, i, j in sorted(found):
        one, other = find(int(roots[i])), find(int(roots[j]))
        if one != other:
            top[max(one, other)] = min(one, other)
            pairs.append((int(nodes[i]), [int(nodes[j])]))
    return pairs, len(pairs) < len(found)


def sweep(buckets: DataFrame, roots: DataFrame, classes: DataFrame, percent: int = PERCENT, every: bool = False) -> DataFrame:
    """Rows (key, lo, hi, a, others, waits): ``a`` and each of ``others`` share a bucket, lie in
    different components and may be linked.

    A bucket of many rows is cut into blocks; each pair of blocks is a unit of work of at
    most about twice BLOCK_ROWS rows."""
    rooted = buckets.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed_up = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_rows"))
    mixed_up = mixed_up.filter("_low != _high").select("key", F.ceil(F.col("_rows") / BLOCK_ROWS).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = rooted.join(mixed_up, "key").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("key", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), F.col("_own").alias("side"), "band", "node", "root")
    rows = rows.join(classes.select("node", "n_shingles", "sketch", "bands"), "node")
    rows = rows.select("key", "lo", "hi", "side", "band", "node", "root", "n_shingles", "sketch", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def work() -> pa.RecordBatch:
            pairs, waits = [], False
            if len(held) > 1:
                cols = list(zip(*held))
                sketches = np.frombuffer(b"".join(cols[5]), np.uint8).reshape(len(held), -1)
                bands = np.frombuffer(b"".join(cols[6]), np.int64).reshape(len(held), -1)
                pairs, waits = _propose(cols[1][0], *(np.array(c, np.int64) for c in (cols[2], cols[3], cols[4], cols[0])), sketches, bands, percent, every)
            n, (key, lo, hi) = len(pairs), unit or (0, 0, 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([key] * n, pa.int64()), pa.array([lo] * n, pa.int32()), pa.array([hi] * n, pa.int32()), pa.array([p[0] for p in pairs], pa.int64()),
                 pa.array([p[1] for p in pairs], pa.list_(pa.int64())), pa.array([waits] * n, pa.bool_())],
                names=["key", "lo", "hi", "a", "others", "waits"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                bands = batch.column(9).flatten().to_numpy().reshape(batch.num_rows, -1)
                for row in zip(*(batch.column(c).to_pylist() for c in range(9)), (b.tobytes() for b in bands)):
                    if row[:3] != unit:
                        if len(held) > 1:
                            yield work()
                        unit, held = row[:3], []
                    held.append(row[3:])
        yield work()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(
        run, "key long, lo int, hi int, a long, others array<long>, waits boolean")


def settle(proposed: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The listed pairs (a, b) of ``sweep(every=True)`` that are similar enough by the hashes of their
    full shingle sets, compared within each block: what isn't is never a row."""
    rows = proposed.join(texts.withColumnRenamed("node", "a"), "a").select("key", "lo", "hi", "a", "others", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets, listed = None, {}, []

        def work() -> pa.RecordBatch:
            pairs = []
            for a, others in listed:
                for b in others:
                    one, two = sets[a], sets[b]
                    if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)):
                        common = len(np.intersect1d(one, two, assume_unique=True))
                        if 100 * common >= percent * (len(one) + len(two) - common):
                            pairs.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for key, lo, hi, a, others, text in zip(*(batch.column(c).to_pylist() for c in range(5)), text_bytes(batch.column(5))):
                    if (key, lo, hi) != unit:
                        yield work()
                        unit, sets, listed = (key, lo, hi), {}, []
                    sets[a] = shingle_hashes(words_of(text))
                    listed.append((a, others))
        yield work()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def regrouped(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links: these are lifted to the components they join, of
    which there are few, and the components' new roots passed on to their members."""
    old = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    lifted = links.join(old, F.col("a") == F.col("_node"), "left").select(F.coalesce("_root", "a").alias("a"), "b")
    lifted = lifted.join(old, F.col("b") == F.col("_node"), "left").select("a", F.coalesce("_root", "b").alias("b")).distinct()
    joined = components(lifted)
    passed = roots.join(joined.select(F.col("node").alias("_old"), F.col("root").alias("_new")), F.col("root") == F.col("_old"), "left")
    return written(passed.select("node", F.coalesce("_new", "root").alias("root")).union(joined.select("node", "root")), "roots")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, tie, n_shingles, component_id, kept.

    component_id is the smallest doc_id of the documents reachable by links, the document's
    own included; kept is whether it is the document's own.  A null or empty text has no
    shingles, is linked with nothing and kept.  A null doc_id never names a component with
    another id in it (then the row isn't kept); where no row has one it is null and they are
    kept.  Rows that repeat an id are compared each by its own text; equal rows share all
    results.  Ties don't arise: ids order the members."""
    signed = written(signatures(docs), "signed")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"))
    classes = written(signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min(rank).alias("_first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select(
        F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("_first.doc_id").alias("low"), F.col("_first.tie").alias("tie"),
        "n_shingles", "bands", "sketch"), "classes")
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("key", "rep")
    buckets = written(keys.join(shared, "key").select("key", "band", "node", "rep"), "buckets")
    # texts of the classes that share a bucket with another
    near = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "low", F.col("tie").alias("_tie"))
    texts = written(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(
        near, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("tie") == F.col("_tie"))).select("node", "text").dropDuplicates(["node"]), "texts")
    # the representative that a class shares most buckets with: likely the most similar
    met = buckets.filter("node != rep").groupBy("node", "rep").agg(F.count("*").alias("n"))
    star = met.groupBy(F.col("node").alias("a")).agg(F.max(F.struct(F.col("n"), (-F.col("rep")).alias("rep")))["rep"].alias("b")).select("a", (-F.col("b")).alias("b"))
    links = written(confirm(star, texts, percent), "links")
    made = [signed, classes, buckets, texts, links]
    roots = components(links)
    while True:
        # pairs that would connect components, a likely chain of them first; when no chain holds any more, each of the rest
        proposed = written(sweep(buckets, roots, classes, percent), "proposed")
        more = written(confirm(proposed.select("a", F.explode("others").alias("b")).distinct(), texts, percent), "links")
        waits, merged = bool(proposed.filter("waits").head(1)), bool(more.head(1))
        made += [roots, proposed, more]
        if merged:
            roots = regrouped(roots, more)
        elif waits:
            proposed = written(sweep(buckets, roots, classes, percent, every=True), "proposed")
            more = written(confirm(settle(proposed, texts, percent).distinct(), texts, percent), "links")
            made += [proposed, more]
            if more.head(1):
                roots = regrouped(roots, more)
            break
        if not waits:
            break
    grouped = classes.join(roots, "node", "left").select("s1", "s2", "low", F.coalesce("root", "node").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "root", "component_id")
    out = signed.select("doc_id", "tie", "n_shingles", "s1", "s2").join(
        named, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = written(out.select("doc_id", "tie", "n_shingles", component.alias("component_id"), F.col("root").alias("group")).withColumn(
        "kept", (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))), "components")
    drop_written(*made, roots)
    return result


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group.  Rows without a word are no group's and stay."""
    judged = near_duplicates(docs, percent)
    # several kept rows of a group repeat an id or have none; the smallest text hash decides
    alike = judged.filter("kept and n_shingles > 0").groupBy("group", "doc_id", "tie").agg(F.count("*").alias("rows"))
    chosen = alike.groupBy("group").agg(F.min(F.struct("tie", "doc_id", "rows")).alias("x")).select(
        F.col("x.doc_id").alias("_id"), F.col("x.tie").alias("_tie"), F.col("x.rows").alias("_rows"))
    id_, text = F.col("doc.doc_id"), F.col("doc.text")
    wordless = F.coalesce(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", F.lit(True))
    joined = whole_rows(docs).join(chosen, id_.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_tie")), "left").filter(
        F.col("_tie").isNotNull() | wordless)
    if not chosen.filter("_rows > 1").head(1):
        return joined.select("doc.*")
    once = joined.filter("_rows > 1").dropDuplicates(["_id", "_tie"])
    return joined.filter("_rows is null or _rows = 1").unionByName(once).select("doc.*")
