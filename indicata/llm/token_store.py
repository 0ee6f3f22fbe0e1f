"""Token ids in fixed-width bit packing.

Documents are range-partitioned and sorted by doc_id; each partition is a shard,
each shard a run of blocks, and each block holds whole documents: their ids, every id
in the fewest bits that the vocabulary needs, one after the other, lowest bit first.
A block is a row of a Parquet table (so writing is atomic and any store works):

    shard, block            position in the whole; ascending with doc_id
    first                   ids in the shard before this block
    n_ids, bits, payload    ids in the block, bits of each, the packed bytes
    doc_ids, starts         documents of the block and where each begins in it

Reading one document takes one block, found by (shard, block) or by doc_ids; id i of a
block lies at bit i * bits of its payload, so a slice unpacks without the rest.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicata.llm.common import in_chunks, text_bytes, written

#: a block ends with the first document that brings it to this many ids
BLOCK_IDS = 1 << 16
#: pieces whose ids a worker remembers
REMEMBERED = 900_000
#: characters that, at the end of a piece, are told apart from a letter before them
END_MARKS = ".,;:!?"
#: what the last token of a word ends with
WORD_END = "</w>"
#: the id that ends each document
END_ID = 1

BLOCKS = "shard long, block long, first long, n_ids long, bits int, payload binary, doc_ids array<long>, starts array<long>"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a packed block, without touching the others."""
    if count <= 0:
        return np.empty(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    flat = flat[start * bits - low * 8:][:count * bits].reshape(count, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Pieces(dict):
    """The number of each piece, given when it is first asked for; ``new`` are those without ids so far."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def clear(self) -> None:
        super().clear()
        self.new = []


class Pool:
    """Sequences of ids by number, in one array that grows."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.uint16), 0
        self.starts, self.sizes, self.uses, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32), 0

    def clear(self) -> None:
        self.used = self.count = 0

    def grow(self, count: int) -> None:
        """Room for ``count`` sequences, empty until they are put."""
        if count > len(self.starts):
            self.starts, self.sizes, self.uses = (np.resize(x, count * 3 // 2) for x in (self.starts, self.sizes, self.uses))
        self.starts[self.count:count] = self.sizes[self.count:count] = self.uses[self.count:count] = 0
        self.count = max(self.count, count)

    def put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``ids`` are the sequences of ``numbers``, one after the other, ``sizes`` ids each."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids.astype(np.result_type(self.ids, np.min_scalar_type(ids.max()))), (self.used + len(ids)) * 3 // 2)
        elif len(ids) and ids.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``numbers``, one after the other, and where each begins and the last ends."""
        sizes = self.sizes[numbers]
        edges = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(sizes, out=edges[1:])
        at = np.repeat(self.starts[numbers] - edges[:-1], sizes)
        at += np.arange(len(at))
        return self.ids[at], edges


class PieceEncoder:
    """Ids of a text by a ``tokenizers`` file that lower-cases and whose tokens never span white space.

    Pieces between ASCII white space are encoded once and remembered, up to a bound; then those
    that came once are forgotten.  The memory outlives the task in a Python worker that is used again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        memory = vars(tokenizers).setdefault("_piece_encoders", {})
        if path not in memory:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            ending = np.zeros(tokenizer.get_vocab_size(), bool)
            ending[[i for token, i in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
            lean = tokenizers.Tokenizer.from_file(path)  # for letters in lower case: without the steps that leave them as they are
            lean.normalizer = tokenizers.normalizers.Sequence([])
            lean.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([
                tokenizers.pre_tokenizers.WhitespaceSplit(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            memory[path] = (tokenizer, lean, ending, Pieces(), Pool())
        self.tokenizer, self.lean, self.ending, self.known, self.pool = memory[path]

    def _put_each(self, numbers: list[int], found: list[list[int]]) -> None:
        if numbers:
            sizes = np.array([len(ids) for ids in found])
            self.pool.put(np.array(numbers), np.array([i for ids in found for i in ids], np.uint32), sizes)

    def _learn(self) -> None:
        """Ids of the new pieces; end marks after a letter are tokens of their own, so they are told apart."""
        known, told, words, texts, ends = self.known, [], [], [], []
        pieces, known.new = known.new, []
        number = len(known) - len(pieces)
        for piece, text in zip(pieces, b" ".join(pieces).decode("utf-8", "replace").split(" ")):
            if text.isalpha():
                words.append(number)
                texts.append(text)
            else:
                bare = text.rstrip(END_MARKS)
                if bare != text and bare.isalpha() and bare[-1].lower().isalpha():
                    cut = len(bare) - len(text)
                    ends.append((number, known[piece[:cut]], known[piece[cut:]]))
                else:
                    told.append((number, text))
            number += 1
        # words and marks first met here are pieces too
        for piece, text in zip(known.new, b" ".join(known.new).decode("utf-8", "replace").split(" ")):
            if text.isalpha():
                words.append(number)
                texts.append(text)
            else:
                told.append((number, text))
            number += 1
        known.new = []
        self.pool.grow(number)
        # letters alone are one word each, and a word's last id says that it ends one: encoded together,
        # lower-cased here, unless a character makes that more than a matter of case
        for at in range(0, len(words), 1000):
            part, joined = words[at:at + 1000], " ".join(texts[at:at + 1000])
            simple = joined.isascii() or unicodedata.is_normalized("NFC", joined) and not ("\u0130" in joined or "\u03a3" in joined)
            ids = np.array(self.lean.encode_batch_fast([joined.lower()], add_special_tokens=False)[0].ids if simple else [], np.uint32)
            edges = np.flatnonzero(self.ending[ids]) + 1
            if len(edges) == len(part):
                self.pool.put(np.array(part), ids, np.diff(edges, prepend=0))
            else:
                told += zip(part, texts[at:at + 1000])
        for at in range(0, len(told), 1000):
            part = told[at:at + 1000]
            self._put_each([n for n, _ in part], [got.ids for got in self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)])
        if ends:
            both = np.array(ends)
            ids, edges = self.pool.take(both[:, 1:].ravel())
            self.pool.put(both[:, 0], ids, edges[2::2] - edges[:-2:2])

    def _forget(self) -> None:
        """Keep the pieces that more than one call of ``encode`` asked for, the most used half of the bound at most."""
        known, pool = self.known, self.pool
        uses = pool.uses[:pool.count]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[:REMEMBERED // 2]])
        keep = np.zeros(pool.count, bool)
        keep[kept] = True
        pieces, (ids, edges) = list(compress(known, keep.tolist())), pool.take(kept)
        known.clear()
        known.update(zip(pieces, range(len(pieces))))
        pool.clear()
        pool.grow(len(pieces))
        pool.put(np.arange(len(pieces)), ids, np.diff(edges))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, then END_ID."""
        if len(self.known) > REMEMBERED:
            self._forget()
        # A-Z lower-cased here, so that a piece is remembered once; special tokens are told by their case
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(own) for own in split], out=words[1:])
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, words[-1])
        if self.known.new:
            self._learn()
        self.pool.uses[numbers] += 1  # once for a call, however often a piece is in it
        ids, edges = self.pool.take(numbers)
        ids, cuts, end = ids.astype("<u4"), edges[words].tolist(), np.array([END_ID], "<u4").tobytes()
        return [ids[a:b].tobytes() + end for a, b in zip(cuts, cuts[1:])]


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            keys, texts = part.column(0).to_pylist(), text_bytes(part.column(1))
            for a, b in in_chunks(texts):
                yield keys[a:b], texts[a:b]


def write_store(docs: DataFrame, tokenizer_path: str, vocabulary: int, path: str | None = None) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text; other columns are left aside) and write the block
    table to ``path`` (by default into the shared scratch folder); returns it as read back.

    A null or empty text is a document of the end id alone; null doc_ids come first; rows
    that repeat an id stay, ordered by a hash of the text; an empty table gives no block.  A text of any
    length is one document of one block."""
    bits = bits_for(vocabulary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = PieceEncoder(tokenizer_path), TaskContext.get().partitionId()
        first, block, ids, doc_ids, starts, size = 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([bits], pa.int32()), pa.array([pack(stream, bits)], pa.binary()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64()))],
                names=["shard", "block", "first", "n_ids", "bits", "payload", "doc_ids", "starts"])

        for keys, texts in _groups(batches):
            for key, own in zip(keys, encoder.encode(texts)):
                doc_ids.append(key)
                starts.append(size)
                ids.append(own)
                size += len(own) // 4
                if size >= BLOCK_IDS:
                    yield row()
                    first, block, ids, doc_ids, starts, size = first + size, block + 1, [], [], [], 0
        if doc_ids:
            yield row()

    # the hash of the text breaks ties: range bounds are sampled on the driver, which should hold no texts
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    sorted_docs = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = sorted_docs.mapInArrow(shard, BLOCKS)
    if path is None:
        return written(blocks, "token_blocks")
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def read_store(blocks: DataFrame) -> DataFrame:
    """Per document of a block table: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, all from the packed ids."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    offsets = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    # a row for each shard, as many as the writing had tasks
    placed = blocks.join(F.broadcast(offsets), F.col("shard") == F.col("_shard")).select(
        (F.col("offset") + F.col("first")).alias("base"), "n_ids", "bits", "payload", "doc_ids", "starts")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, n_ids, bits, payload, keys, starts = (batch.column(c)[i].as_py() for c in range(6))
                ids = unpack(payload, bits, 0, n_ids).astype("<u4")
                raw, edges = memoryview(ids.tobytes()), [*starts, n_ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(np.array(starts, np.int64) + base), pa.array(np.diff(np.array(edges, np.int64))),
                     pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges, edges[1:])], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(blocks: DataFrame, doc_id: int) -> list[int]:
    """The ids of one document: random access to its block."""
    row = blocks.filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("shard", "block").first()
    if row is None:
        return []
    at = row["doc_ids"].index(doc_id)
    end = ([*row["starts"], row["n_ids"]])[at + 1]
    return unpack(bytes(row["payload"]), row["bits"], row["starts"][at], end - row["starts"][at]).tolist()
