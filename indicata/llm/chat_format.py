"""Chat formatting of reply trees.

Messages form trees by their parent ids.  Self-joins that double their reach each time
give every message its root, its depth and the score of its branch; the leaves of a tree
are its root-to-leaf paths, ranked by that score, and the chosen ones are spelled out by
the same jumps backwards.  A path becomes one conversation: a row for each turn, in order,
whose segments laid end to end are the formatted text:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

A control string inside a text is escaped by one more backslash after its "<": "<|" is
written "<\\|", "<\\|" is written "<\\\\|" and so on, so "<|" only ever marks a turn and
the escape can be undone.  No step holds a conversation, or a tree, as a whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import written

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: characters of role and text that the range sort of turns samples to the driver
RANGE_CHARS = 32

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED, _ROLE_ESCAPED = re.compile(r"<(\\*)\\\|"), re.compile(r"\\(.)")


def escape(text: Column) -> Column:
    """Null is empty; no "<|" is left."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    """A role takes one line: backslashes are doubled, line ends written as a backslash and n."""
    plain = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``messages`` (tree, id, parent, score) to the state of every message whose root is
    reached (tree, id, root, total, depth), and the jump tables (tree, id, up) of 1, 2, 4, ...
    steps.  A parent that doesn't exist makes a root; messages in a cycle reach no root."""
    known = messages.select(F.col("tree").alias("_tree"), F.col("id").alias("up")).distinct()
    rooted = messages.join(known, (F.col("tree") == F.col("_tree")) & (F.col("parent") == F.col("up")), "left").select(
        "tree", "id", "up", F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).alias("depth"), F.col("id").alias("root"))
    state, jumps = written(rooted, "state"), []
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    while len(jumps) <= rounds and state.filter("up is not null").head(1):
        jumps.append(state)
        above = state.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("total").alias("_total"),
                             F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        moving = state.filter("up is not null").join(above, (F.col("tree") == F.col("_tree")) & (F.col("up") == F.col("_id"))).select(
            "tree", "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_root").alias("root"))
        state = written(state.filter("up is null").union(moving), "state")
    return state.filter("up is null").drop("up"), [j.filter("up is not null").select("tree", "id", "up") for j in jumps]


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, id, depth) of the ``branches`` best root-to-leaf paths under each root (None:
    all), by score of the branch, then by length, then by the smaller leaf id."""
    reached, jumps = climb(messages)
    parents = messages.filter("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = reached.join(parents, ["tree", "id"], "left_anti")
    if branches is not None:
        rank = F.row_number().over(Window.partitionBy("tree", "root").orderBy(F.col("total").desc(), F.col("depth").desc(), "id"))
        leaves = leaves.withColumn("_rank", rank).filter(F.col("_rank") <= branches)
    steps = leaves.select("tree", F.col("id").alias("leaf"), "id")
    for jump in reversed(jumps):
        # every distance is a sum of distinct powers of two, so each ancestor comes once
        up = steps.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"))
        steps = written(steps.union(up), "steps")
    return steps.join(reached.select("tree", "id", "depth"), ["tree", "id"]).select("tree", "leaf", "id", "depth")


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``messages`` (tree string, id long, parent long, role, text, score; others are left
    aside) to one row per turn of each chosen path: tree, leaf, depth, segment, loss_start
    and loss_end (code points of the segment that are trained on; null but for assistants).

    Null roles and texts are empty, null scores 0.  Rows that repeat an id within a tree are
    one message each of the same place; give them ids of their own to tell them apart.  Rows
    without a tree or an id are no message.  An empty table gives none."""
    told = messages.filter("tree is not null and id is not null")
    narrow = told.select("tree", "id", "parent", F.col("score").cast("double").alias("score"))
    chosen = paths(narrow, branches)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    trained = F.col("role").eqNullSafe(F.lit(TRAINED_ROLE))
    turns = chosen.join(told.select("tree", "id", head.alias("head"), body.alias("body"), trained.alias("trained")), ["tree", "id"])
    return turns.select(
        "tree", "leaf", "depth", F.concat("head", "body", F.lit(END)).alias("segment"),
        F.when(F.col("trained"), F.length("head")).alias("loss_start"),
        F.when(F.col("trained"), F.length("head") + F.length("body")).alias("loss_end"))


class Reader:
    """Reads a formatted conversation back, piece by piece, and keeps digests of it."""

    def __init__(self):
        self.rest, self.chars, self.turns, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss_start: int | None, loss_end: int | None) -> None:
        self.chars += len(piece)
        if loss_start is not None:
            under = unescape(piece[loss_start:loss_end])
            self.loss_chars += len(under)
            self.loss.update(under.encode())
        self.rest += piece
        at = 0
        for m in _TURN.finditer(self.rest):
            if m.start() != at:
                raise ValueError("text between two turns")
            at = m.end()
            self.turns += 1
            self.all.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("a turn without an end")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``format_trees``, from its segments in order: tree, leaf,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.  A conversation streams
    through one task a turn at a time, as a digest must; it is never held whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done, key, reader = [], None, Reader()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for tree, leaf, _, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, leaf) != key:
                    if key is not None:
                        done.append((*key, *reader.row()))
                    key, reader = (tree, leaf), Reader()
                reader.feed(*piece)
            yield batch_of(done)
            done = []
        if key is not None:
            yield batch_of([(*key, *reader.row())])

    schema = "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.select("tree", "leaf", "depth", "segment", "loss_start", "loss_end").repartition("tree", "leaf")
    return ordered.sortWithinPartitions("tree", "leaf", "depth").mapInArrow(read, schema)


def from_turns(conversations: DataFrame) -> DataFrame:
    """A table of linear conversations (conv_id, turn, role, text) as reply trees: each row
    replies to the one before it by turn (null first; ties by role, then text).

    Rows are numbered by a range sort over the whole table, so a long conversation is
    spread over tasks like everything else, and a text of any length is one row's.  A null conv_id is a
    conversation of its own, nulls in the other columns are values; equal rows are turns of their
    own.  An empty table gives none; columns of other names may be called anything."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", "turn", "role", "text")]
    # the beginnings of role and text are in the order of the whole: what is sampled for the ranges is short
    ranges = [*order[:2], *[F.substring(c, 1, RANGE_CHARS).asc_nulls_first() for c in ("role", "text")]]
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = conversations.select(tree.alias("tree"), "turn", "role", "text")
    rows = written(rows.repartitionByRange(*ranges).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "turns")
    part, here = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("id", F.col("_base") + here)
    first = numbered.groupBy("tree").agg(F.min("id").alias("_first"))
    return numbered.join(first, "tree").select(
        "tree", "id", F.when(F.col("id") > F.col("_first"), F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
