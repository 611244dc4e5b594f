"""Packing of tokenised documents into fixed-length sequences, best fit decreasing."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Pieces of one packing group; bounds the memory of a task and leaves little padding.
GROUP = 20_000
SPECIAL = "<|endoftext|>"


class ByteTokenizer:
    """Ids of the public byte-level BPE.

    tiktoken encodes with the same vocabulary and pattern several times faster
    than the tokenizers library.  Only a text that holds the special token's
    string, which that library alone recognises, goes to it.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.path = public_tokenizers.path(f"{name}.json")
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian 32-bit numbers."""
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")


_TOKENIZER: dict[str, ByteTokenizer] = {}


def _pieces(window: int, end_id: int, name: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZER.get(name) or _TOKENIZER.setdefault(name, ByteTokenizer(name))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = memoryview(tokenizer.encode(text or "").tobytes() + end)
                n = len(data) // 4
                for at in range(0, n, window):
                    part = data[4 * at : 4 * (at + window)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], names=["id", "start", "length", "crc", "total"])

    return cut


class CapacityTree:
    """Segment tree over remaining capacities; finds the tightest open window in logarithmic time.

    A leaf counts the open windows with that capacity, an inner node those below it.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity >= need."""
        at, count = need + self.size, self.count
        while not count[at]:
            while at & 1:  # a right child: go up
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of the level
                return None
        while at < self.size:
            at *= 2
            if not count[at]:
                at += 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, all of them at most window."""
    tree, opened = CapacityTree(window), 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found = window, opened
            opened += 1
        capacity, own = found
        where[i], offset[i] = own, window - capacity
        if capacity > need:
            tree.add(capacity - need, own)
    return where, offset


def _pack(window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows).sort_by([("group", "ascending"), ("length", "descending"), ("id", "ascending"), ("start", "ascending")])
        group = rows["group"].to_numpy()
        cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows.slice(a, b - a)
            where, offset = best_fit_decreasing(part["length"].to_numpy(), window)
            sequence = (int(group[a]) << 33 | where) * 2 + 1
            out = part.drop(["group"]).append_column("sequence", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.combine_chunks().to_batches()

    return pack


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every token of docs, with end_id after each document, into sequences of at most window tokens.

    A document longer than a window is first cut into full windows, each a
    sequence of its own; what is left of each document is packed best fit
    decreasing.  Pieces are dealt by a hash to groups of about GROUP pieces that
    are packed apart, so memory is bounded at any size; padding comes from the
    few open windows of a group.  Returns one row per piece: id, start, length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id
    (unique, not gapless: odd for packed ones, even for full windows) and offset.
    A null text counts as empty and yields the end token alone; repeated rows
    are packed each; an empty table gives no rows; further columns are ignored.
    Tokenises once; the pieces, without tokens, are checkpointed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = durable(rows.mapInArrow(_pieces(window, end_id, tokenizer), f"id {kind}, start long, length long, crc long, total long"))
    part = pieces.where(F.col("length") < window)
    groups = max(1, -(-part.count() // GROUP))
    dealt = part.withColumn("group", F.pmod(F.xxhash64("id", "start", "crc"), F.lit(groups)))
    packed = dealt.repartition(groups, "group").mapInArrow(_pack(window), f"id {kind}, start long, length long, crc long, total long, sequence long, offset long")
    full = pieces.where(F.col("length") == window).withColumns({"sequence": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
