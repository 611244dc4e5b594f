"""Incremental audits: a stream of rows upserted into a Parquet index, the last of each key.

The index is dealt to buckets by a hash of the keys.  A micro-batch writes the
buckets that it touches, each whole, as a version of their own; the others stay
where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.discovery import latest, upsert

#: Buckets of an index; a folder for each in every version that touches it.
BUCKETS = 64


def upsert_stream(stream: DataFrame, index: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Write the buckets that each micro-batch of stream touches into a new version of the index.

    A replayed batch writes the same version again.  Buckets that no later read
    needs, those before the last version of a bucket and the one before it, are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = {r[0] for r in rows.select("bucket").distinct().toLocalIterator()}
            if not touched:
                return
            before = _read(spark, index, {b: p for b, p in _places(spark, index, number).items() if b in touched})
            merged = rows if before is None else upsert(before, rows, keys, order)
            merged.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{index}/v{number:012d}")
            _prune(spark, index, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, index: str, before: int | None = None) -> DataFrame | None:
    """The index as of the last version, or of the last before a number."""
    return _read(spark, index, _places(spark, index, before))


def _read(spark: SparkSession, index: str, places: dict[int, str]) -> DataFrame | None:
    return spark.read.parquet(*[places[b] for b in sorted(places)]) if places else None


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, index: str) -> dict[int, dict[int, str]]:
    """Per complete version, the newest first, the path of each of its buckets."""
    folder, fs = _folder(spark, index)
    if not fs.exists(folder):
        return {}
    out = {}
    for name in sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{name}/_SUCCESS")):
            inside = fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{name}"))
            out[int(name[1:])] = {int(s.getPath().getName().removeprefix("bucket=")): s.getPath().toString() for s in inside if s.getPath().getName().startswith("bucket=")}
    return out


def _places(spark: SparkSession, index: str, before: int | None = None) -> dict[int, str]:
    """Where the last version of each bucket is."""
    out: dict[int, str] = {}
    for number, buckets in _versions(spark, index).items():
        if before is None or number < before:
            out = buckets | out
    return out


def _prune(spark: SparkSession, index: str, number: int) -> None:
    """Remove the buckets that neither the index as it is nor a replay of version number reads."""
    needed = {*_places(spark, index).values(), *_places(spark, index, number).values()}
    for buckets in _versions(spark, index).values():
        for path in buckets.values():
            if path not in needed:
                folder, fs = _folder(spark, path)
                fs.delete(folder, True)
