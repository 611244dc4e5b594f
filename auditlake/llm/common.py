"""Helpers shared by the operators: durable cuts, table reading, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table that is small beside the documents is checkpointed in one file for so many shuffle partitions.
FEWER = 8


def durable(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint (an action).

    The files go to the folder that ``spark.checkpoint.dir`` names, which every
    executor can read, so a lost executor loses nothing.  Only a local session may
    lack that setting; it gets a temporary folder.  A checkpoint's files go when
    the driver no longer refers to it, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; they may go with the folder once a job's result is written.
    Where Hadoop lacks its native library, each file makes the executor start two
    processes (chmod), which share all its memory until they run their program; so
    a small table is dealt to fewer files, still in proportion to the partitions.
    """
    if small:
        df = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FEWER))
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="auditlake-checkpoint-"))
    return df.checkpoint(eager=True)


def literal_lookup(values: list[int], index: Column) -> Column:
    """values[index] (0-based) from a list of bounded size, folded into the plan as a constant."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), index.cast("int") + 1).cast("long")


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """df with a gapless 0-based rank by keys over the whole table, and the row count.

    Range partitions are sorted independently and numbered by adding each
    partition's offset; only one count per partition reaches the driver.  Runs
    actions; the ranked rows are checkpointed so that numbers cannot change.
    Rows that tie on every key take adjacent ranks in no stated order.
    """
    mid, part = "__mid", F.shiftright(F.col("__mid"), 33)
    ordered = durable(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).withColumn(mid, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    ranked = ordered.withColumn(name, literal_lookup(offsets, part) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).drop(mid)
    return ranked, total


def tidy() -> None:
    """Give freed memory back to the system; a worker or the driver would keep it for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux
        ctypes.CDLL(None).malloc_trim(0)


#: Bits of the largest map of keys: 16 MB, whatever the size of the table.  A fuller map only marks more rows.
MAP_BITS = 1 << 27


def key_map(keys: DataFrame) -> bytes:
    """Bit map of the longs in the one column of keys, by their remainder; its size is bounded by MAP_BITS.  Runs actions."""
    (name,) = keys.columns
    bits = min(MAP_BITS, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    at = F.pmod(name, F.lit(bits))
    made = bytearray(bits // 8)
    for r in keys.groupBy(F.floor(at / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bits")).toLocalIterator():
        made[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["bits"]
    return bytes(made)


def in_map(made: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit keys are marked; every key of the map is, and a few others."""
    at = keys % np.int64(8 * len(made))
    return np.frombuffer(made, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def in_doubt(rows: DataFrame, key: str, made: bytes, wanted: bool) -> DataFrame:
    """The rows whose long key is marked in the map (or is not); nothing is shuffled."""
    at = rows.columns.index(key)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(made, batch.column(at).to_numpy()) == wanted))
        tidy()

    return rows.mapInArrow(pick, rows.schema)


def settle(docs: DataFrame, id_col: str, text_col: str, decided: DataFrame) -> DataFrame:
    """docs without the rows that decided(id, own, stays) drops; of equal rows that stay, one.

    own is ``xxhash64`` of the text; decided has every (id, own) that is dropped
    or that several rows share, and names each once.  A row is known by its id and
    text, so rows that only share an id, a null one too, are decided apart.  Rows
    that no map of the decided keys marks pass without any shuffle.
    """
    own, mark, stays, other_id, other_own = fresh(docs, "own", "mark", "stays", "other_id", "other_own")
    marked = key_map(decided.select(F.xxhash64("id", "own").alias("key")))
    rows = docs.withColumn(own, F.xxhash64(text_col)).withColumn(mark, F.xxhash64(id_col, own))
    doubt = in_doubt(rows, mark, marked, True)
    said = decided.select(F.col("id").alias(other_id), F.col("own").alias(other_own), F.col("stays").alias(stays))
    left = doubt.join(said, (F.col(own) == F.col(other_own)) & F.col(id_col).eqNullSafe(F.col(other_id)), "left").where(F.coalesce(F.col(stays), F.lit(True)))
    return in_doubt(rows, mark, marked, False).select(*docs.columns).unionByName(left.dropDuplicates([id_col, own]).select(*docs.columns))
