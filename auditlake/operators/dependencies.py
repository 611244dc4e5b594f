"""Dependency manifests: known malicious packages, names one edit away, risky scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

ISSUE = ["repo", "path", "type", "package", "similar_to", "severity", "description"]


def _issues(rows: DataFrame, kind: str, severity: str, package, similar, description) -> DataFrame:
    return rows.select("repo", "path", F.lit(kind).alias("type"), package.alias("package"), similar.alias("similar_to"), F.lit(severity).alias("severity"), description.alias("description"))


def requirement_issues(files: DataFrame) -> DataFrame:
    """Issues of requirements files: exact names are critical, names at edit distance one high."""
    lines = files.select("repo", "path", F.explode(T.lines(F.col("content"))).alias("line")).withColumn("line", T.strip(F.col("line"))).where("line <> '' and not startswith(line, '#')")
    named = lines.select("repo", "path", T.package_name(F.col("line")).alias("package"))
    bad = F.explode(F.array(*[F.lit(x) for x in R.MALICIOUS_PYTHON]))
    pairs = named.select("*", bad.alias("bad")).withColumn("gap", F.levenshtein("package", F.lower("bad"), 2))
    none = F.lit(None).cast("string")
    exact = _issues(pairs.where("gap = 0"), "known_malicious", "CRITICAL", F.col("package"), none, F.concat("package", F.lit(" is on the list of malicious Python packages")))
    near = _issues(pairs.where("gap = 1"), "typo_squatting_suspect", "HIGH", F.col("package"), F.col("bad"), F.concat("package", F.lit(" is one edit away from the malicious "), "bad"))
    return exact.unionByName(near)


def package_json_issues(files: DataFrame) -> DataFrame:
    """Issues of package.json files; one that is no object, or whose parts are none, has no issues."""
    shape = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, scripts map<string,string>"
    parsed = files.select("repo", "path", F.from_json("content", shape).alias("p"))
    names = [F.coalesce(F.map_keys(F.col(f"p.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    deps = parsed.select("repo", "path", F.explode(F.array_distinct(F.concat(*names))).alias("package")).where(F.lower("package").isin([x.lower() for x in R.MALICIOUS_NPM]))
    none = F.lit(None).cast("string")
    known = _issues(deps, "known_malicious", "CRITICAL", F.col("package"), none, F.concat("package", F.lit(" is on the list of compromised npm packages")))
    scripts = parsed.select("repo", "path", F.explode("p.scripts").alias("script", "command"))
    risky = scripts.where(reduce(lambda a, b: a | b, [F.col("command").contains(w) for w in R.RISKY_SCRIPTS]))
    return known.unionByName(_issues(risky, "suspicious_script", "HIGH", F.col("script"), none, F.concat(F.lit("script "), "script", F.lit(" runs "), F.substring("command", 1, 100))))


def dependency_issues(files: DataFrame) -> DataFrame:
    return requirement_issues(files.where("filename = 'requirements.txt'")).unionByName(package_json_issues(files.where("filename = 'package.json'")))
