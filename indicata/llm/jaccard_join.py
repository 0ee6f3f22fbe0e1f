"""N-gram Jaccard join by T-occurrence search.

Each text is the set of its word shingles.  Two sets link where their Jaccard similarity is
at least a threshold, so a set must share T of its shingles with a partner, and the search
asks which sets occur T times in the inverted lists of its shingles.  DivideSkip answers it:
the longest lists are set aside, the short ones are heap-merged, what occurs often enough in
them is looked up in the long lists by binary search, and the count decides.

A list of the whole table is never in one place.  Shingles have one order everywhere, rare
ones first, by a sketch of how many sets hold them.  Of a set's first |s| - T + C shingles, its
short lists under L = T - C, a partner shares C: sets that share fewer with all others
together have none, and go, which shortens the lists, and so again.  Sets of a like size that are
left in one list are chained into groups.  A group is searched as a whole, or, where it is
large, in blocks of bounded size, each pair of blocks a task of its own.  Nothing is capped
and no pair becomes a row: a task returns, for each set, how many documents it links with and a
member of its component.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicata.llm.common import drop_written, text_bytes, written
from indicata.llm.near_dup import components, shingle_hashes, words_of

SHINGLE = 4
#: links need 100 * intersection >= PERCENT * union
PERCENT = 85
#: the sketch counts shingles in 2**SKETCH_BITS cells: 16 MB on the driver and on each executor, whatever the data
SKETCH_BITS, PIECES = 22, 256
#: one in so many shingles of a set is what a partner shares of its prefix, and rounds that drop sets without partners
SHARED, ROUNDS = 20, 2
#: sets and shingles of a block of a large group
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
#: so many sets (two numbers each) are broadcast to pick their texts; more are joined by shuffling
BROADCAST_SETS = 1 << 20
#: lists whose cell of the sketch holds this many sets, and so many times the mean, are dealt out
LONG_LIST, LONG_FACTOR, SALTS = 1024, 8, 16
#: DivideSkip's weight of a long list, and the entries from which lists are merged by counting instead of by a heap
MU, HEAP_MOST = 0.0085, 4096
#: from so many sets on, lists that this share of them is in are kept as rows of bits
DENSE_SETS, DENSE_SHARE = 64, 1 / 8


def least_common(n: int, percent: int = PERCENT) -> int:
    """The T of a set of n: what it shares with any partner at least (with one of percent% of its size)."""
    return -(-percent * n // 100)


def shared_least(n: int) -> int:
    """The C of a set of n."""
    return 1 + n // SHARED


def order_of(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The shingles from rare to frequent: by their cells' counts, then by hash."""
    return shingles[np.lexsort((shingles, sketch[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))]


def merge_short(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur in at least ``least`` of the sorted lists, in how many, by a heap."""
    merged = heapq.merge(*(x.tolist() for x in lists))
    found = [(k, n) for k, same in groupby(merged) if (n := sum(1 for _ in same)) >= least]
    return np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.int64)


class Index:
    """Inverted lists of some sets, which are numbered by size: for each shingle the numbers of its sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owners, tokens))
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.owners, self.bounds = owners[order], np.append(first, len(tokens))
        # (list, number) as one sorted key, for binary search in any list
        self.keys = np.repeat(np.arange(len(self.tokens)), np.diff(self.bounds)) * len(sets) + self.owners
        # sets of a group share most of their shingles: what two of them share of the long lists is one product of bits
        self.dense = np.zeros(len(self.tokens), bool)
        if len(sets) >= DENSE_SETS:
            self.dense = np.diff(self.bounds) >= DENSE_SHARE * len(sets)
        if self.dense.any():
            column = np.cumsum(self.dense) - 1
            within = np.repeat(self.dense, np.diff(self.bounds))
            bits = np.zeros((len(sets), int(self.dense.sum())), np.float32)
            bits[self.owners[within], np.repeat(column, np.diff(self.bounds))[within]] = 1
            self.together = bits @ bits.T

    def search(self, k: int, low: int, percent: int) -> np.ndarray:
        """The numbers from low to k, exclusive, whose sets are similar enough to that of k, the
        largest of them: DivideSkip."""
        n, size = len(self.sizes), int(self.sizes[k])
        t = least_common(size, percent)
        at = np.searchsorted(self.tokens, self.sets[k])
        if self.dense.any():  # the long lists are looked up by the product, the others counted
            at = at[~self.dense[at]]
            counts = self._counted(np.searchsorted(self.keys, at * n + low), np.searchsorted(self.keys, at * n + k))
            found = np.arange(low, k)
            common = counts[low:k] + self.together[k, low:k].astype(np.int64)
        else:
            starts = np.searchsorted(self.keys, at * n + low)
            ends = np.searchsorted(self.keys, at * n + k)
            held = ends > starts
            at, starts, ends = at[held], starts[held], ends[held]
            if len(at) < t:
                return np.empty(0, np.int64)
            order = np.argsort(ends - starts, kind="stable")
            at, starts, ends = at[order], starts[order], ends[order]
            longest = int(ends[-1] - starts[-1])
            n_long = min(t - 1, int(t / (MU * math.log2(longest) + 1)))
            cut = len(at) - n_long
            if int((ends[:cut] - starts[:cut]).sum()) <= HEAP_MOST:
                found, common = merge_short([self.owners[s:e] for s, e in zip(starts[:cut].tolist(), ends[:cut].tolist())], t - n_long)
                probes = (at[cut:, None] * n + found).ravel()  # binary search in the long lists
                where = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
                common = common + (self.keys[where] == probes).reshape(n_long, -1).sum(0)
            else:  # short lists so full that all of them counted in one go are less work than a heap
                counts = self._counted(starts, ends)
                found = np.flatnonzero(counts >= t)
                common = counts[found]
        return found[100 * common >= percent * (size + self.sizes[found] - common)]

    def _counted(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """In how many of the stretches of lists each number is."""
        sizes = ends - starts
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.owners[at], minlength=len(self.sizes))


def join_block(sets: list[np.ndarray], sides: list[int], copies: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets in ascending size: how many documents each links with, and the number of a member
    of its component.  Where there are two sides, only sets of different sides are compared."""
    n, index = len(sets), Index(sets)
    links, label = np.zeros(n, np.int64), np.arange(n)
    side, weight = np.array(sides), np.array(copies, np.int64)
    two_sided = side.min() != side.max()
    for k in range(1, n):
        low = int(np.searchsorted(index.sizes, least_common(len(sets[k]), percent)))
        found = index.search(k, low, percent) if low < k else ()
        if two_sided and len(found):
            found = found[side[found] != side[k]]
        if len(found):
            links[k] += weight[found].sum()
            links[found] += weight[k]
            joined = np.unique(np.append(label[found], label[k]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return links, label


def counted_sets(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, tie (hash of the text), n_shingles, s1 and s2 (hash of the
    set); and from each task rows with a piece of its sketch, which counts the sets that hold a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "tie", "n_shingles", "s1", "s2", "piece", "counts"]
        types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                shingles = shingle_hashes(words_of(text), SHINGLE)
                one, two = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), ">i8").tolist()
                rows.append((doc_id, tie, len(shingles), one, two, None, None))
                np.add.at(counts, (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if counts.any():
            pieces = [(None,) * 5 + (k, zlib.compress(x.astype("<i4").tobytes(), 1)) for k, x in enumerate(np.split(counts, PIECES))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], names=names)

    schema = "doc_id long, tie long, n_shingles long, s1 long, s2 long, piece int, counts binary"
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text").mapInArrow(run, schema)


def sketch_of(pieces: DataFrame) -> np.ndarray:
    """The tasks' sketches (piece, counts) summed up: 2**SKETCH_BITS numbers, all that the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total, out = None, None, []
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != piece:
                    if piece is not None:
                        out.append((piece, total.astype("<i4").tobytes()))
                    piece, total = k, np.zeros((1 << SKETCH_BITS) // PIECES, np.int64)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counts), "<i4"), (1 << 31) - 1)
        if piece is not None:
            out.append((piece, total.astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["piece", "counts"])

    summed = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "piece int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for row in summed.collect():  # PIECES rows
        part = np.frombuffer(bytes(row["counts"]), "<i4")
        sketch[row["piece"] * len(part):(row["piece"] + 1) * len(part)] = part
    return sketch


def prefixes(docs: DataFrame, sketch, percent: int) -> DataFrame:
    """(token, salt, band, s1) for each of the first |s| - T + C shingles of every set: the short lists.
    Sets whose sizes allow a link are in one band or in neighbouring ones.  A list that may be
    long, as its cell of the sketch is many times fuller than most, is dealt out by a salt of the
    set; of others it is -1."""
    step = math.log(100 / percent)
    long = max(LONG_LIST, LONG_FACTOR * int(sketch.value.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                tokens, keys, sizes = [np.empty(0, np.uint64)], [], []
                for text in text_bytes(batch.column(0).slice(at, 200)):
                    shingles = shingle_hashes(words_of(text), SHINGLE)
                    if len(shingles):
                        first = order_of(shingles, sketch.value)[:len(shingles) - least_common(len(shingles), percent) + shared_least(len(shingles))]
                        tokens.append(first)
                        keys.append(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), ">i8")[0])
                        sizes.append(len(shingles))
                lengths = [len(t) for t in tokens[1:]]
                bands = np.repeat(np.array([math.floor(math.log(n) / step + 1e-9) for n in sizes], np.int64), lengths)
                every, own = np.concatenate(tokens), np.repeat(np.array(keys, np.int64), lengths)
                salts = np.where(sketch.value[(every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] >= long, own % SALTS, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every.view(np.int64)), pa.array(salts.astype(np.int16)), pa.array(bands.astype(np.int16)), pa.array(own, pa.int64())],
                    names=["token", "salt", "band", "s1"])

    return docs.select("text").mapInArrow(run, "token long, salt short, band short, s1 long")


def in_lists(postings: DataFrame, parts: int) -> DataFrame:
    return postings.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "band", "s1")


def met(postings: DataFrame, parts: int) -> DataFrame:
    """The postings, each once, that share their list with another set of the same band or one beside it;
    all of a list that is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False  # the last row so far, and whether the one before it was near
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held, columns)]
            token, salt, band, s1 = columns
            listed = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            fresh = np.append(True, ~(listed & (band[1:] == band[:-1]) & (s1[1:] == s1[:-1])))
            if not fresh.all():
                token, salt, band, s1 = columns = [c[fresh] for c in columns]
                listed = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            near = listed & (band[1:].astype(np.int64) - band[:-1] <= 1)
            wanted = np.append(known, near) | np.append(near, False) | (salt >= 0)
            held, known = [c[-1:] for c in columns], bool(near[-1]) if len(near) else known
            keep = np.flatnonzero(wanted[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["token", "salt", "band", "s1"])
        if held is not None and (known or held[1][0] >= 0):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["token", "salt", "band", "s1"])

    return in_lists(postings, parts).mapInArrow(run, "token long, salt short, band short, s1 long")


def with_partners(postings: DataFrame, sizes: DataFrame, parts: int, percent: int) -> DataFrame:
    """The postings of sets that may have a partner: that meet others in as many lists as a partner of the
    least size that allows a link shares.  Each round drops sets, and with them what others met."""
    least = F.floor(F.ceil(F.col("n_shingles") * percent / 100) / SHARED) + 1
    kept = written(met(postings, parts), "met")
    for _ in range(ROUNDS):
        counts = kept.groupBy(F.col("s1").alias("_s1")).agg(F.count("*").alias("lists"))
        able = counts.join(sizes, F.col("_s1") == F.col("s1")).filter(F.col("lists") >= least).select("_s1")
        before, kept = kept, written(met(kept.join(able, F.col("s1") == F.col("_s1"), "left_semi"), parts), "met")
        drop_written(before)
    return kept


def chained(postings: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) along each list, in one pass over the lists sorted by band and set: every set with
    the first of its band, the first of a band with that of the band below.  Of a list that is dealt
    out, each part also tells the first set of each band: a null b, with token and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (token, salt, band, first of the band) where the batch before ended
        for batch in batches:
            if not batch.num_rows:
                continue
            token, salt, band, s1 = (c.to_numpy() for c in batch.columns)
            band = band.astype(np.int64)
            listed = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            banded = listed | np.append(True, band[1:] != band[:-1])
            goes_on = last is not None and (token[0], salt[0]) == last[:2]
            listed[0] = not goes_on
            banded[0] = not (goes_on and band[0] == last[2])
            starts = np.flatnonzero(banded)
            # the first set of each row's band: of the band that goes on from the batch before where none has begun here
            run_of = np.cumsum(banded) - 1
            firsts = np.append(s1[starts], last[3] if goes_on else 0)[run_of]
            # of the bands that begin here: the first of the one before, if of the same list and next to it
            below = np.append(last[3] if goes_on else 0, s1[starts[:-1]])[:len(starts)]
            band_below = np.append(last[2] if goes_on else -9, band[starts[:-1]])[:len(starts)]
            joined = ~listed[starts] & (band_below == band[starts] - 1)
            a, b = np.append(s1[~banded], s1[starts][joined]), np.append(firsts[~banded], below[joined])
            other = a != b
            pairs = np.unique(np.stack([a[other], b[other]], 1), axis=0)
            told = starts[salt[starts] >= 0]
            none = pa.nulls(len(told), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(pairs[:, 0], s1[told]), pa.int64()), pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), none]),
                 pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(token[told], pa.int64())]),
                 pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(band[told], pa.int64())])], names=["a", "b", "token", "band"])
            last = (token[-1], salt[-1], band[-1], firsts[-1])

    return in_lists(postings, parts).mapInArrow(run, "a long, b long, token long, band long")


def groups_of(postings: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(s1, group) of the sets that may have a partner: what chains of links along the lists connect.
    ``sizes``: s1 and n_shingles of every set."""
    # parts of a quarter of an input partition's postings at most, on average
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * postings.rdd.getNumPartitions())
    able = with_partners(postings, sizes, parts, percent)
    links = written(chained(able, parts), "chained")
    dealt = links.filter("b is null").groupBy("token", "band").agg(F.min("a").alias("least"), F.collect_set("a").alias("firsts"))  # SALTS sets at most
    dealt = written(dealt, "dealt")
    below = dealt.select("token", (F.col("band") + 1).alias("band"), F.col("least").alias("_below"))
    edges = links.filter("b is not null").select("a", "b").union(dealt.select(F.explode("firsts"), "least")).union(
        dealt.join(below, ["token", "band"]).select("least", "_below")).distinct()
    roots = written(components(edges), "groups")
    drop_written(links, dealt, able)
    return roots.select(F.col("node").alias("s1"), F.col("root").alias("group")).union(roots.select(F.col("root"), F.col("root")).distinct())


def blocks(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, member, links) of every task: members (node, group, copies, n_shingles) with their
    texts, searched group by group, large ones in pairs of blocks."""
    size = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = members.join(size.withColumnRenamed("group", "_group"), F.col("group") == F.col("_group")).withColumn("_own", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.join(texts, "node").select(
        "group", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "n_shingles", "node", F.col("_own").alias("side"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def work() -> pa.RecordBatch:
            out: tuple = ((), (), ())
            if len(held) > 1:
                nodes, sides, copies, sets = zip(*held)
                links, label = join_block(list(sets), list(sides), list(copies), percent)
                keep = np.flatnonzero(links).tolist()
                out = [nodes[k] for k in keep], [nodes[label[k]] for k in keep], [int(links[k]) for k in keep]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "member", "links"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for *key, n, node, side, copies, text in zip(*(batch.column(c).to_pylist() for c in range(7)), text_bytes(batch.column(7))):
                    if key != unit:
                        yield work()
                        unit, held = key, []
                    held.append((node, side, copies, shingle_hashes(words_of(text), SHINGLE)))
        yield work()

    in_units = rows.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "n_shingles", "node")
    return in_units.mapInArrow(run, "node long, member long, links long")


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are left aside): doc_id, n_shingles,
    component_id (the smallest doc_id of the documents reachable by links, its own included) and
    n_links (rows whose text it links with, copies of its own included, itself not).

    A null or empty text has no shingles and is linked with nothing.  A null doc_id never names a
    component that has another id; rows that repeat an id are compared each by its own text and
    equal rows share their component.  Ties don't arise: ids order the members.  An empty table
    gives an empty one.  Texts of any length are taken whole.  Shingles are compared by 64-bit
    hashes; sets are told apart by 128 bits."""
    spark = docs.sparkSession
    counted = written(counted_sets(docs), "counted")
    sketch = spark.sparkContext.broadcast(sketch_of(counted.filter("piece is not null").select("piece", "counts")))
    signed = counted.filter("piece is null").select("doc_id", "tie", "n_shingles", "s1", "s2")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie"))
    classes = written(signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min(rank).alias("_first"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")).select(
        F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("_first.doc_id").alias("low"), F.col("_first.tie").alias("tie"),
        "n_shingles", "copies"), "classes")
    # s1 alone tells sets apart well enough to look for candidates: equal ones only widen a group
    groups = groups_of(prefixes(docs, sketch, percent), classes.groupBy("s1").agg(F.min("n_shingles").alias("n_shingles")), percent)
    members = written(classes.join(groups, "s1").select("node", "group", "copies", "n_shingles", "low", F.col("tie").alias("_tie")), "members")
    wanted = members.select("node", "low", "_tie")
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_SETS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("tie") == F.col("_tie"))).select("node", "text")
    # a representative row that is repeated would be another set of its class
    texts = written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    found = written(blocks(members.select("node", "group", "copies", "n_shingles"), texts, percent), "found")
    roots = written(components(found.select(F.col("node").alias("a"), F.col("member").alias("b"))), "roots")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(roots, "node", "left").join(links, "node", "left").select(
        "s1", "s2", "low", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "component_id", "n_links")
    out = signed.join(named, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n_shingles") > 0), "left")
    result = written(out.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")), "joined")
    drop_written(counted, classes, members, texts, found, roots)
    sketch.unpersist()
    return result
