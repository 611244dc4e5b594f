"""The older scanner: dangerous calls and patterns of Python and script files, obfuscation first, one JSON text a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching, pycalls

#: Fixed values. Extensions that it reads, and builtins whose calls count as obfuscation from the third on.
SCRIPTS = [".js", ".ts", ".jsx", ".tsx"]
OBSCURE = ["eval", "exec", "getattr"]


def legacy_report(files: DataFrame) -> DataFrame:
    """(repo, path, obfuscated, types, lines) of every Python and script file with something to tell.

    An obfuscated file tells nothing else: three patterns more than twice or
    three calls of OBSCURE in Python, more than three evals or ten escapes in a
    script.  types are distinct and sorted, lines in order; a Python file that
    does not parse has patterns only.
    """
    python, scripts = files.where("ext = '.py'"), files.where(F.col("ext").isin(SCRIPTS))
    calls = pycalls.python_calls(python).where("error is null")
    counted = calls.groupBy("repo", "path").agg((F.count_if((F.col("prefix") == "") & F.col("call").isin(OBSCURE)) >= 3).alias("many"))
    marked = python.select("repo", "path", matching.legacy_obfuscated(F.col("content")).alias("patterns")).join(counted, ["repo", "path"], "left").select("repo", "path", (F.col("patterns") | F.coalesce("many", F.lit(False))).alias("obfuscated"))
    content = F.col("content")
    wild = (T.count_matches(content, r"eval\(") > 3) | (T.count_matches(content, r"\\x[0-9a-fA-F]{2}") > 10)
    marked = marked.unionByName(scripts.select("repo", "path", F.coalesce(wild, F.lit(False)).alias("obfuscated")))
    hits = pycalls.legacy_calls(python).select("repo", "path", "line", F.col("call").alias("type")).unionByName(matching.line_hits(scripts, matching.LEGACY_JS).select("repo", "path", "line", F.col("name").alias("type")))
    told = hits.groupBy("repo", "path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_list("line")).alias("lines"))
    joined = marked.join(told, ["repo", "path"], "left").where("obfuscated or types is not null")
    plain = lambda c, kind: F.when(F.col("obfuscated") | F.col(c).isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.col(c)).alias(c)
    return joined.select("repo", "path", "obfuscated", plain("types", "string"), plain("lines", "int"))


def legacy_json(files: DataFrame) -> DataFrame:
    """(repo, report): the rows of legacy_report as JSON, by path; a repository without any is safe."""
    rows = legacy_report(files).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "obfuscated", "types", "lines"))).alias("rows"))
    every = files.select("repo").distinct().join(rows, "repo", "left")
    return every.select("repo", F.coalesce(F.to_json("rows"), F.lit('[{"status":"safe"}]')).alias("report"))
