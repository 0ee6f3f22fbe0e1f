"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

Every turn gets the hash of all turns up to it, so equal hashes are equal prefixes: nodes.
A conversation is the chain of its hashes; distinct chains are sorted by range partitions, and
neighbours are joined by an edge as deep as their longest common prefix.  Within a stretch
of rows, edges are taken from deep to shallow: each unites two components, and their union is
a branching node; the unbranched nodes below it are told on the way.  Every node sums what
its rows of the stretch hold, so a stretch may end anywhere: nodes that reach beyond it are
prefixes of its first or last row, and the forests are merged across boundaries by summing up
the contracted rows of equal nodes.

Chains are cut into segments of SEGMENT turns, each under the node where it begins.  Segments
are done from the deepest level up; what a level's roots sum up goes to the ends of the
segments above.  No row holds more than a segment, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import written
from indicata.llm.mixing import word_count

#: turns of a segment, and rows of a stretch
SEGMENT, STRETCH = 1024, 20_000
#: bytes of a node's hash; the root is all zero
WIDTH = 16
ROOT = bytes(WIDTH)

_NODE = "key binary, parent binary, depth long, low long, n_convs long, n_children long, n_leaves long, saved_tokens long"


# ---- turns ----------------------------------------------------------------

def numbered_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as conv_id, pos (0, 1, ... by turn, null first; ties by
    role and text hashes), role, text: nulls empty.  Rows are numbered by a range sort of the whole
    table and the partitions' counts, so that a long conversation is spread like everything else."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    tie = F.md5(F.concat(F.md5(role), F.md5(text)))
    rows = written(turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), tie.alias("tie"),
                                                             role.alias("role"), text.alias("text")), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie")]
    keys = rows.select("conv_id", "turn", "tie", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    keys = written(keys.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = keys.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    whole = keys.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "_id", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1))
    first = whole.groupBy("conv_id").agg(F.min("_id").alias("_first")).withColumnRenamed("conv_id", "_conv")
    return whole.join(first, F.col("conv_id") == F.col("_conv")).select("conv_id", (F.col("_id") - F.col("_first")).alias("pos"), "role", "text")


def segments(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, pos, role, text; pos 0, 1, ...) as a row for each conversation and segment:
    conv_id, level, root (hash of the node it begins under), chain (hashes of its turns, laid end to
    end), words (of each turn) and last (whether the conversation ends with it).

    A turn's hash is the sum, modulo 2**64 in two lanes, of md5 over position, role and text up to it."""
    own = F.unhex(F.md5(F.concat_ws(",", F.col("pos").cast("string"), F.md5("role"), F.md5("text"))))
    level = F.floor(F.col("pos") / SEGMENT).cast("long")
    rows = turns.select("conv_id", level.alias("level"), F.struct("pos", own.alias("h"), word_count(F.col("text")).alias("words")).alias("t"))
    held = rows.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list("t")).alias("t"))  # SEGMENT turns at most

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, level, chains, words, sums = batch.column(0), batch.column(1), [], [], []
            for turns in batch.column(2).to_pylist():
                lanes = np.cumsum(np.frombuffer(b"".join(t["h"] for t in turns), "<u8").reshape(-1, 2), axis=0, dtype=np.uint64)
                chains.append(lanes.tobytes())
                words.append([t["words"] for t in turns])
                sums.append(lanes[-1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [conv, level, pa.array(chains, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(sums, pa.binary())],
                names=["conv_id", "level", "chain", "words", "total"])

    summed = written(held.mapInArrow(totals, "conv_id long, level long, chain binary, words array<long>, total binary"), "segments")
    # a row for each segment: only of conversations with more than one does a window hold several
    in_conv = Window.partitionBy("conv_id").orderBy("level")
    placed = summed.withColumn("before", F.collect_list("total").over(in_conv.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "last", F.lead("level").over(in_conv).isNull())

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, chains = [], []
            for chain, before in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                base = np.frombuffer(b"".join(before), "<u8").reshape(-1, 2).sum(0, dtype=np.uint64)
                roots.append(base.tobytes())
                chains.append((np.frombuffer(chain, "<u8").reshape(-1, 2) + base).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roots, pa.binary()), pa.array(chains, pa.binary()), batch.column(3), batch.column(5)],
                names=["conv_id", "level", "root", "chain", "words", "last"])

    return placed.select("conv_id", "level", "chain", "words", "before", "last").mapInArrow(
        shift, "conv_id long, level long, root binary, chain binary, words array<long>, last boolean")


# ---- one level ------------------------------------------------------------

def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two chains share."""
    n = min(len(a), len(b)) // WIDTH
    low, high = 0, n  # equal hashes at a depth are equal prefixes up to it
    while low < high:
        mid = (low + high + 1) // 2
        if a[(mid - 1) * WIDTH:mid * WIDTH] == b[(mid - 1) * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def forest(rows: list[tuple], base: int) -> list[tuple]:
    """What a stretch of sorted rows adds to each node: (key, parent, depth, low, n_convs, n_children,
    n_leaves, saved), depth counted from ``base``.  A row is (root, chain, words, convs, low, children,
    leaves, saved, before, after): of the conversations with this chain how many and the least, what
    lies below its end, and the turns that it shares with the rows before and after it.

    Children, leaves and words of distinct nodes count where the node's first row is, so sums
    over stretches are right: ``saved`` is the words of all rows less those of distinct nodes."""
    out: list[tuple] = []
    depth_of = [len(r[1]) // WIDTH for r in rows]
    parent = list(range(len(rows)))
    # of each component: depth, convs, low, children, leaves, saved below
    state = [[depth_of[k], r[3], r[4], r[5], r[6] if r[5] else int(r[9] < depth_of[k]), r[7]] for k, r in enumerate(rows)]

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def raise_to(k: int, depth: int) -> None:
        """The nodes of a component from its depth up to ``depth``, exclusive: unbranched but the deepest."""
        root, chain, words, before, s = rows[k][0], rows[k][1], rows[k][2], rows[k][8], state[k]
        while s[0] > depth:
            d = s[0]
            begins = int(d > before)
            s[5] += (s[1] - begins) * words[d - 1]
            out.append((chain[(d - 1) * WIDTH:d * WIDTH], chain[(d - 2) * WIDTH:(d - 1) * WIDTH] if d > 1 else root, base + d, s[2], s[1], s[3], s[4], s[5]))
            s[0], s[3] = d - 1, begins

    edges = [k for k in range(1, len(rows)) if rows[k][0] == rows[k - 1][0]]
    for k in sorted(edges, key=lambda k: -rows[k][8]):
        one, other, depth = find(k - 1), find(k), rows[k][8]
        raise_to(one, depth)
        raise_to(other, depth)
        a, b = state[one], state[other]
        parent[other] = one  # the left one: its first row is the component's
        state[one] = [depth, a[1] + b[1], min(a[2], b[2]), a[3] + b[3], a[4] + b[4], a[5] + b[5]]
    for k in range(len(rows)):
        if parent[k] == k:
            raise_to(k, 0)
            _, convs, low, children, leaves, saved = state[k]
            out.append((rows[k][0], None, base, low, convs, children, leaves, saved))
    return out


def level_nodes(chains: DataFrame, level: int) -> DataFrame:
    """Nodes (_NODE) of the segments of a level, those of its roots with a null parent.  ``chains``:
    root, chain, words, convs, low, children, leaves, saved; each chain once."""
    ordered = chains.repartitionByRange("root", "chain").sortWithinPartitions("root", "chain")
    row = "root binary, chain binary, words array<long>, convs long, low long, children long, leaves long, saved long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the turns shared with the row before and after (null at the partition's ends), and the row's number."""
        last, kept, number, schema = None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            shared = [None if last is None else _shared(last, keys[0]), *(_shared(a, b) for a, b in zip(keys, keys[1:]))]
            if kept is not None:  # what the batch before waited for
                yield _compared(*kept, shared[0], schema)
            schema, last = batch.schema, keys[-1]
            numbers = range(number, number + batch.num_rows)
            number += batch.num_rows
            kept = (batch, shared, numbers)
        if kept is not None:
            yield _compared(*kept, None, schema)

    numbered = ordered.select("root", "chain", "words", "convs", "low", "children", "leaves", "saved").mapInArrow(
        compare, f"{row}, before long, after long, number long").withColumn("part", F.spark_partition_id())
    lined = written(numbered, "lined")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the first and last rows of all partitions, in order: what neighbours of two partitions share."""
        out, last = [], None
        for batch in batches:
            for part, number, root, chain in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if last is not None and last[0] != part:
                    shared = _shared(last[2:], (root, chain))
                    out += [(last[0], last[1], None, shared), (part, number, shared, None)]
                last = (part, number, root, chain)
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["part", "number", "b", "a"])

    ends = lined.filter("before is null or after is null").select("part", "number", "root", "chain").repartition(1).sortWithinPartitions("part", "number")
    met = ends.mapInArrow(across, "part int, number long, b long, a long").groupBy("part", "number").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    # two rows of four numbers for each partition
    known = lined.join(F.broadcast(met.select(F.col("part").alias("_p"), F.col("number").alias("_n"), "b", "a")),
                       (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n")), "left").select(
        "root", "chain", "words", "convs", "low", "children", "leaves", "saved",
        F.coalesce("before", "b", F.lit(0)).alias("before"), F.coalesce("after", "a", F.lit(0)).alias("after"), "part", "number")
    base = level * SEGMENT

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for *entry, part, number in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= STRETCH or at != (part, number - 1)):
                    yield _node_batch(forest(held, base))
                    held = []
                held.append(tuple(entry))
                at = (part, number)
        yield _node_batch(forest(held, base))

    return known.mapInArrow(grow, _NODE).groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("low").alias("low"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])


def _shared(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> int:
    return common_turns(a[1], b[1]) if a[0] == b[0] else 0


def _compared(batch: pa.RecordBatch, before: list, numbers: range, following, schema: pa.Schema) -> pa.RecordBatch:
    after = [*before[1:], following]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(numbers, pa.int64())],
                                      names=[*schema.names, "before", "after", "number"])


def _node_batch(nodes: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*nodes)) if nodes else [()] * 8
    types = [pa.binary(), pa.binary()] + [pa.int64()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _NODE.split(", ")])


# ---- trie -----------------------------------------------------------------

def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): SHA-256 of the ids, ascending, comma-joined.  The ids
    of a node stream through one task, as a digest must, and are never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                              names=["key", "ends_sha256"])

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for k, same in groupby(keys):
                n = sum(1 for _ in same)
                joined = ",".join(map(str, ids[at:at + n])).encode()
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(joined)
                else:
                    digest.update(b"," + joined)
                at += n
            yield told()
            done = []
        if key is not None:
            done.append((key, digest.hexdigest()))
        yield told()

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The trie of ``turns`` (conv_id long, pos long, role string, text string; pos 0, 1, ... in each
    conversation, no nulls, as ``numbered_turns`` makes them), and of ``conversations`` (conv_id),
    which may have some without turns: a row for each distinct sequence of first turns, from the
    textless root.  Columns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and key, the node's hash.

    A turn equals another where role and text are equal; empty texts and roles are values like any
    other.  Members with equal turns meet in one node.  Without any conversation there is no
    node.  A conversation of any length is held a segment at a time."""
    rows = written(segments(turns), "chains")
    end = F.substring(F.col("chain"), -WIDTH, WIDTH)
    ends = rows.filter("last").select(end.alias("key"), "conv_id")
    turnless = None
    if conversations is not None:
        turnless = conversations.select(F.col("conv_id").cast("long")).distinct().join(
            turns.select(F.col("conv_id").alias("_conv")).distinct(), F.col("conv_id") == F.col("_conv"), "left_anti")
        turnless = written(turnless, "turnless")
        ends = ends.unionByName(turnless.select(F.lit(ROOT).alias("key"), "conv_id"))
    chains = rows.groupBy("level", "root", "chain").agg(F.first("words").alias("words"), F.count("*").alias("convs"), F.min("conv_id").alias("low"))
    chains = written(chains, "distinct")
    deepest = chains.agg(F.max("level")).first()[0]
    below, levels = None, []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = chains.filter(F.col("level") == level).drop("level")
        if below is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            here = here.join(below, end == F.col("_root"), "left").select(
                "root", "chain", "words", "convs", "low", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        nodes = written(level_nodes(here, level), "nodes")
        levels.append(nodes.filter("parent is not null") if level else nodes)
        below = nodes.filter("parent is null").select(
            F.col("key").alias("_root"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    nodes = None
    for part in levels:
        nodes = part if nodes is None else nodes.unionByName(part)
    if turnless is not None:  # members of the root only; where nothing has a turn, the root is the one leaf
        only = turnless.agg(F.min("conv_id").alias("low"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
            F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "low", "n_convs",
            *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        nodes = only if nodes is None else nodes.unionByName(only)
        root = nodes.filter("parent is null").groupBy("key").agg(
            F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("low").alias("low"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
        root = root.withColumn("n_leaves", F.greatest("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long"))
        nodes = nodes.filter("parent is not null").unionByName(root)
    if nodes is None:
        return chains.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary")
    nodes = written(nodes, "trie")
    above = nodes.select(F.col("key").alias("_key"), F.col("low").alias("_low"))
    digests = end_digests(ends).select(F.col("key").alias("_end"), F.col("ends_sha256").alias("_sha"))
    return nodes.join(above, F.col("parent") == F.col("_key"), "left").join(digests, F.col("key") == F.col("_end"), "left").select(
        F.col("low").alias("conv_id"), "depth", F.col("_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "key")


def rebuilt_turns(numbered: DataFrame, heads: Column, base: Column, reach: int) -> DataFrame:
    """``numbered`` turns with the start of every conversation replaced: the first ``heads`` turns
    (an expression of conv_id, below ``reach``) are those of conversation ``base``, all if it has
    fewer, none where it is absent; then come the conversation's own turns after its first ``heads``."""
    convs = numbered.select("conv_id").distinct().select("conv_id", heads.cast("long").alias("_heads"), base.alias("_base"))
    first = numbered.filter(F.col("pos") < reach).select(F.col("conv_id").alias("_from"), F.col("pos").alias("_pos"), "role", "text")
    put = convs.join(first, (F.col("_base") == F.col("_from")) & (F.col("_pos") < F.col("_heads"))).select("conv_id", F.col("_pos").alias("pos"), "role", "text")
    lengths = first.groupBy("_from").agg(F.count("*").alias("_n"))
    taken = convs.join(lengths, F.col("_base") == F.col("_from"), "left").select(
        F.col("conv_id").alias("_conv"), "_heads", F.least("_heads", F.coalesce("_n", F.lit(0))).alias("_taken"))
    rest = numbered.join(taken, F.col("conv_id") == F.col("_conv")).filter("pos >= _heads").select(
        "conv_id", (F.col("pos") - F.col("_heads") + F.col("_taken")).alias("pos"), "role", "text")
    return put.unionByName(rest)
