"""Command line: ``python -m auditlake ROOT --output DIR`` audits every repository below ROOT."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.discovery import discover
from .operators.legacy import legacy_json
from .operators.review import batch_summary
from .plans.audit import audit, reviewed
from .sources.files import MAX_FILES, read_repositories
from .sources.sinks import save_audit, save_discovered

#: Tables that outside services fill, as folders of JSON lines below the folder of --said; a missing one is empty.
SAID = {
    "verdicts": "repo string, path string, role string, severity string, confidence double, malicious boolean, gray boolean, summary string",
    "given": "repo string, pos long, category string, claim string, subject string, risk_ids array<string>",
    "flows": "repo string, pos long, detail string",
    "chains": "repo string, verdict string",
    "results": "subject string, position long, title string, url string, description string",
}


def options_of(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="auditlake", description="Audit the source trees below a folder.")
    parser.add_argument("root", help="folder whose first level names the repositories")
    parser.add_argument("--output", required=True, help="folder for reports, metadata and findings")
    parser.add_argument("--name", help="audit only the repository of this name")
    parser.add_argument("--owner", help="owner of the repositories, for the report")
    parser.add_argument("--targets", help="JSON lines of repo, owner and commit")
    parser.add_argument("--said", help="folder of what reviewers, trust chains and searches said")
    parser.add_argument("--static-only", action="store_true", help="leave reviews and trust out")
    parser.add_argument("--max-files", type=int, default=MAX_FILES, help="files of a repository that are analysed, by path (0: all)")
    parser.add_argument("--max-reviews", type=int, default=10, help="files of a repository whose reviews count (0: all)")
    parser.add_argument("--discover-only", action="store_true", help="list the repositories that the files link to, and stop")
    parser.add_argument("--max-repos", type=int, default=20, help="links that a discovery keeps (0: all)")
    parser.add_argument("--legacy", action="store_true", help="write the older scanner's report, and stop")
    return parser.parse_args(arguments)


def _said(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    out = {}
    for name, shape in SAID.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        out[name] = spark.read.schema(shape).json(f"{folder}/{name}") if there else spark.createDataFrame([], shape)
    return out


def run(spark: SparkSession, options: argparse.Namespace) -> DataFrame | None:
    """What the options ask for; the summary of an audit."""
    files = read_repositories(spark, options.root)
    if options.discover_only:
        save_discovered(discover(files.where("ext = '.md'"), options.max_repos or None), options.output)
        return None
    if options.name:
        files = files.where(F.col("repo") == options.name)
    if options.legacy:
        legacy_json(files).write.mode("overwrite").json(f"{options.output}/legacy")
        return None
    shape = "repo string, owner string, commit string"
    targets = spark.read.schema(shape).json(options.targets) if options.targets else spark.createDataFrame([], shape)
    if options.owner and not options.targets:
        targets = files.select("repo").distinct().withColumns({"owner": F.lit(options.owner), "commit": F.lit(None).cast("string")})
    made = audit(files, max_files=options.max_files or None)
    second = reviewed(made, **_said(spark, options.said), limit=options.max_reviews or None) if options.said and not options.static_only else None
    save_audit(made, targets, options.output, second)
    runs = spark.read.json(f"{options.output}/meta").select("repo", F.lit("completed").alias("status"), "risk", F.col("total").alias("findings"))
    return batch_summary(runs)


def main() -> None:
    summary = run(SparkSession.builder.appName("auditlake").getOrCreate(), options_of())
    if summary is not None:
        summary.show(truncate=False)


if __name__ == "__main__":
    main()
