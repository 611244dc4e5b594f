"""Files of repositories as a table (repo, path, filename, ext, size_bytes, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import PRUNED_DIRS

MAX_BYTES, MAX_FILES = 500 * 1024, 300


#: Stand for U+FFFD while malformed bytes are replaced by it; no character of any text.
_STAND_IN = "\U0010ffff"


def decode(content: Column) -> Column:
    """UTF-8 text of bytes; malformed sequences are left out, a replacement character that is in the file stays."""
    valid = F.make_valid_utf8(F.replace(content.cast("string"), F.lit("\ufffd"), F.lit(_STAND_IN)))
    return F.replace(F.replace(valid, F.lit("\ufffd"), F.lit("")), F.lit(_STAND_IN), F.lit("\ufffd"))


def kept_directory(path: Column) -> Column:
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.exists(parts, lambda d: d.isin(PRUNED_DIRS) | d.endswith(".egg-info"))


def describe(files: DataFrame) -> DataFrame:
    """Add filename and ext to (repo, path, content, ...)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("filename", name).withColumn("ext", T.extension(F.col("filename")))


def read_repositories(spark: SparkSession, root: str, ignore: tuple[str, ...] = ("_ground_truth.json",)) -> DataFrame:
    """Every file below root, whose first level names the repositories; pruned directories are left out.

    Files beyond MAX_BYTES are listed without their content, which is never read.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.substring(F.col("path"), len(top) + 2, F.lit(1 << 30))
    shape = lambda rows, content: rows.select(F.split(tail, "/")[0].alias("repo"), F.regexp_replace(tail, r"^[^/]+/", "").alias("path"), F.col("length").alias("size_bytes"), content.alias("content"))
    read = shape(raw.where(F.col("length") <= MAX_BYTES), decode(F.col("content")))
    large = shape(raw.select("path", "length").where(F.col("length") > MAX_BYTES), F.lit(None).cast("string"))
    files = read.unionByName(large)
    return describe(files.where(kept_directory(F.col("path")))).where(~F.col("filename").isin(*ignore))


def text_table(rows: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    """Files from any table of texts."""
    return describe(rows.select(F.col(repo).alias("repo"), F.col(path).cast("string").alias("path"), F.octet_length(F.col(content)).cast("long").alias("size_bytes"), F.col(content).alias("content")))
