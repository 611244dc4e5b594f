"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; each chunk has a polynomial hash; the hash of two
neighbours is ``hash(a) * base**len(b) + hash(b)``, so the chunks of a huge text
may be hashed apart, in any grouping.  Rows with equal fingerprints are then
compared chunk by chunk, so a collision never merges two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, in_map, key_map, settle, table

#: Two primes below 2**31 and a base for each; products of a byte and a power stay below 2**39.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 69069069)
#: Bytes of a chunk; 2**16 products of 39 bits fit 64 bits.
CHUNK = 1 << 16
#: The characters that equality ignores: [\x20\x09-\x0D].
BLANKS = b" \t\n\v\f\r"
#: Bytes from which the chunks of a text are dealt to tasks.
HUGE = 8 << 20

_POWERS = []
for _m, _b in zip(MODULI, BASES, strict=True):
    _row, _x = np.empty(CHUNK, np.uint64), 1
    for _i in range(CHUNK - 1, -1, -1):
        _row[_i] = _x
        _x = _x * _b % _m
    _POWERS.append(_row)


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """Hash of at most CHUNK bytes."""
    data = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return tuple(int(np.dot(data, p[CHUNK - len(data) :])) % m for p, m in zip(_POWERS, MODULI, strict=True))


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Hash of a concatenation from the hashes of its parts and the length of the right one."""
    return tuple((a * pow(b, right_len, m) + c) % m for a, c, b, m in zip(left, right, BASES, MODULI, strict=True))


def fingerprint(data: bytes, chunk: int = CHUNK) -> int:
    """Both hashes of data in one signed 64-bit number, by combining its chunks."""
    total = (0, 0)
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        total = combine(total, chunk_hash(part), len(part)) if at else chunk_hash(part)
    return (total[0] << 31 | total[1]) - (1 << 61)


def normalise(text: bytes | None) -> bytes:
    return (text or b"").translate(None, BLANKS)


def _scan(hasher: Callable[[bytes], int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, lengths, hashes = [], [], []
            for text in batch.column(1).to_pylist():
                data = normalise(text)
                prints.append(hasher(data))
                lengths.append(len(data))
                hashes.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64()), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string())], names=["id", "points", "print", "length", "sha"])

    return scan


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of each chunk, shifted by the bytes that follow it in its text."""
    for batch in batches:
        shifted = [combine(chunk_hash(part), (0, 0), after) for part, after in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (zip(*shifted, strict=True) if shifted else ((), ()))]], names=["uid", "a", "b"])


def _scan_huge(rows: DataFrame) -> DataFrame:
    """The columns of _scan for rows(id, text, points) of huge texts, whose chunks are dealt to tasks and hashed apart.

    The shifted hashes of a text's chunks add up to its own, in any order.
    """
    clean = F.translate(F.col("text").cast("string"), BLANKS.decode(), "").cast("binary")
    whole = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "points", clean.alias("data")).select("uid", "id", "points", "data", F.octet_length("data").cast("long").alias("length"))
    notes = whole.select("uid", "id", "points", "length", F.sha2("data", 256).alias("sha"))
    chunks = whole.select("uid", "data", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(CHUNK).cast("long"))).alias("at"))
    parts = chunks.select("uid", F.substring("data", F.col("at").cast("int") + 1, F.lit(CHUNK)).alias("part"), F.greatest(F.col("length") - F.col("at") - CHUNK, F.lit(0)).alias("after"), "at")
    hashes = parts.repartition("uid", "at").select("uid", "part", "after").mapInArrow(_hash_chunks, "uid long, a long, b long")
    total = hashes.groupBy(F.col("uid").alias("of")).agg((F.sum("a") % MODULI[0]).alias("a"), (F.sum("b") % MODULI[1]).alias("b"))
    return notes.join(total, F.col("uid") == F.col("of")).select("id", "points", (F.shiftleft("a", 31).bitwiseOR(F.col("b")) - (1 << 61)).alias("print"), "length", "sha")


def _chunks_of(marked: bytes, hasher: Callable[[bytes], int]):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, lengths, numbers, parts, size = [], [], [], [], 0
            for text in batch.column(0).to_pylist():
                data = normalise(text)
                own = hasher(data)
                if not in_map(marked, np.array([own]))[0]:
                    continue
                for n, at in enumerate(range(0, len(data), CHUNK)):
                    prints.append(own)
                    lengths.append(len(data))
                    numbers.append(n)
                    parts.append(data[at : at + CHUNK])
                    size += len(parts[-1])
                    if size > 1 << 24:
                        yield _chunk_batch(prints, lengths, numbers, parts)
                        prints, lengths, numbers, parts, size = [], [], [], [], 0
            yield _chunk_batch(prints, lengths, numbers, parts)

    return chunks


def _chunk_batch(prints: list, lengths: list, numbers: list, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(lengths, pa.int64()), pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())], names=["print", "length", "number", "part"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"), F.xxhash64(text_col).alias("own"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, hasher: Callable[[bytes], int], huge: int) -> DataFrame:
    """(id, own, points, print, length, part, sha) of every row: equal texts, and only those, agree in print, length and part."""
    rows = _rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    small = F.coalesce(F.octet_length("text"), F.lit(0)) <= huge
    # a row of a huge text carries its own hash along with its id
    both = F.struct("id", "own").alias("id")
    shape = f"id struct<id: {kind}, own: bigint>, points long, print long, length long, sha string"
    found = rows.where(small).select(both, "text", "points").mapInArrow(_scan(hasher), shape)
    if hasher is fingerprint:
        found = found.unionByName(_scan_huge(rows.where(~small).select(both, "text", "points")))
    else:
        found = rows.select(both, "text", "points").mapInArrow(_scan(hasher), shape)
    scan = durable(found.select("id.id", "id.own", "points", "print", "length", "sha"))
    twins = scan.groupBy("print", "length").count().where("count > 1").select("print")
    marked = key_map(twins)
    chunks = rows.select("text").mapInArrow(_chunks_of(marked, hasher), "print long, length long, number long, part binary")
    clash = chunks.groupBy("print", "length", "number").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("print", "length").distinct().withColumn("clash", F.lit(True))
    return scan.join(clash, ["print", "length"], "left").withColumn("part", F.when(F.col("clash"), F.col("sha"))).drop("clash")


_KEY = ["print", "length", "part"]


def _best(*further: str) -> list[Column]:
    """Size of a group and the row that stays: most code points, then the smallest id, a null one last."""
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), *further)
    return [F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Callable[[bytes], int] = fingerprint, huge: int = HUGE) -> DataFrame:
    """One row per row of docs: its group of equal texts and the row that stays.

    Texts are equal when identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``; null counts as empty.  Of a group the row with the most
    code points in the original text, then the smallest id stays (a null id sorts
    last).  Returns the id, keep_id, group_size, kept (the id equals keep_id, so
    all rows that repeat that id are kept) and text_sha256 of the normalised text.
    An empty table gives no rows; further columns, whatever their names, are
    ignored.  Texts are read twice; only the chunks of rows whose fingerprint is
    marked as repeated leave their task, after map-side combining, so a group that
    holds a third of all rows sends one row per task and chunk.  The chunks of
    texts of more than huge bytes are dealt to tasks, hashed apart and combined.
    hasher may be weaker than the default (and then hashes whole texts);
    collisions are told apart.  Runs actions.
    """
    keyed = _keyed(docs, id_col, text_col, hasher, huge)
    groups = keyed.groupBy(*_KEY).agg(*_best()).withColumn("keep_id", F.col("best.id"))
    a, b = keyed.alias("a"), groups.alias("b")
    same = (F.col("a.print") == F.col("b.print")) & (F.col("a.length") == F.col("b.length")) & (F.coalesce(F.col("a.part"), F.lit("")) == F.coalesce(F.col("b.part"), F.lit("")))
    return a.join(b, same).select(F.col("a.id").alias(id_col), "b.keep_id", "b.group_size", F.col("a.id").eqNullSafe(F.col("b.keep_id")).alias("kept"), F.col("a.sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: that of exact_groups.

    Of rows that tie (one id, texts of one length that differ in white space) the
    one whose text has the least hash stays, of equal ones any single one.  Rows are told apart by
    id and text, so a repeated or null id keeps each of its different texts.  Only
    rows of groups of several are shuffled.
    """
    keyed = _keyed(docs, id_col, text_col, fingerprint, HUGE)
    groups = keyed.groupBy(*_KEY).agg(*_best("own")).where("group_size > 1")
    a, b = keyed.alias("a"), groups.alias("b")
    same = (F.col("a.print") == F.col("b.print")) & (F.col("a.length") == F.col("b.length")) & (F.coalesce(F.col("a.part"), F.lit("")) == F.coalesce(F.col("b.part"), F.lit("")))
    stays = F.col("a.id").eqNullSafe(F.col("b.best.id")) & (F.col("a.own") == F.col("b.best.own"))
    decided = durable(a.join(b, same).select("a.id", "a.own", stays.alias("stays")).distinct(), small=True)
    return settle(docs, id_col, text_col, decided)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document with its group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
w AS (SELECT doc_id, sha256(n) AS s, count(*) OVER (PARTITION BY n) AS group_size,
  first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM w
"""
