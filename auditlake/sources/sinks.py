"""Where audits go: reports and metadata by owner, repository and commit, the discovery list, the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.audit import Audit, Reviewed, report


def commit_parts(line: Column) -> tuple[Column, Column]:
    """Hash and date of a ``hash|date`` line; "unknown" where missing."""
    parts = F.split(F.coalesce(line, F.lit("")), r"\|")
    known = lambda i: F.coalesce(F.nullif(T.strip(F.try_element_at(parts, F.lit(i))), F.lit("")), F.lit("unknown"))
    return known(1), known(2)


def short_commit(commit: Column) -> Column:
    return F.when(commit.isNull() | commit.isin("", "unknown"), "latest").otherwise(F.substring(commit, 1, 12))


def save_audit(made: Audit, targets: DataFrame, output: str, second: Reviewed | None = None) -> None:
    """Write reports (text), metadata and findings (JSON) below output, partitioned by owner, repository and commit.

    targets(repo, owner, commit) name what was audited; a repository without a
    target is written under the owner ``local``.  With the second half of an audit
    its reviews, assumptions and downgrades are written as well.  What the outputs
    share is kept while they are written.
    """
    made.persist()
    if second:
        second.persist()
    repositories = (second or made).repositories
    keys = made.repositories.select("repo").join(targets, "repo", "left").select("repo", F.coalesce("owner", F.lit("local")).alias("owner"), short_commit(F.col("commit")).alias("commit12"))
    by = ["owner", "repo", "commit12"]
    report(made, second).join(keys, "repo").withColumnRenamed("report", "value").repartition("repo").write.mode("overwrite").partitionBy(*by).text(f"{output}/reports")
    tables = {"meta": repositories.drop("cap", "mean"), "findings": made.findings}
    if second:
        tables |= {"reviews": second.reviews, "assumptions": second.assumptions, "downgrades": second.log}
    for name, rows in tables.items():
        rows.join(keys, "repo").write.mode("overwrite").partitionBy(*by).json(f"{output}/{name}")
    if second:
        second.unpersist()
    made.unpersist()


def save_discovered(links: DataFrame, output: str) -> None:
    """The links as JSON lines below output/skills, and how many there are, by owner and in all, below output/totals."""
    links.write.mode("overwrite").json(f"{output}/skills")
    kept = links.sparkSession.read.schema("url string, owner string, name string").json(f"{output}/skills")
    kept.rollup("owner").agg(F.count(F.lit(1)).alias("repositories")).write.mode("overwrite").json(f"{output}/totals")
