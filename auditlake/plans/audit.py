"""The audit of all repositories as one plan: files, findings, file results, repository risk, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import classify, configuration, dependencies, matching, pycalls, review, trust
from ..schema import FINDING_ORDER, rank
from ..sources.files import MAX_FILES


@dataclass
class Audit:
    """Lazy tables of an audit; each is a plan over the same classified files."""

    files: DataFrame
    findings: DataFrame
    dep_issues: DataFrame
    results: DataFrame
    repositories: DataFrame
    walked: DataFrame
    reviews: DataFrame | None = None

    def persist(self) -> Audit:
        """Keep what several outputs share; tables derived before or after read it instead of matching files again."""
        for table in (self.findings, self.dep_issues, self.results):
            table.persist()
        return self

    def unpersist(self) -> None:
        for table in (self.findings, self.dep_issues, self.results):
            table.unpersist()


def audit(files: DataFrame, reviews: DataFrame | None = None, max_files: int | None = MAX_FILES) -> Audit:
    """Audit files(repo, path, filename, ext, size_bytes, content) of any number of repositories.

    reviews(repo, final_severity, final_confidence) are optional and take part in
    the risk.  Of a repository the first max_files files by path are analysed, all
    of them where that is None.  Everything is keyed by repository and path; nothing is looped.
    """
    known = _apart(classify.classified(files, max_files))
    of = lambda name: known.where(F.col("language") == name)
    python = of("python")
    code = pycalls.annotate(pycalls.python_findings(python), pycalls.safeguards(python))
    parts = [code, matching.js_findings(of("javascript")), matching.shell_findings(of("shell")), matching.prompt_findings(of("skill_prompt")), configuration.config_findings(of("tool_config"))]
    findings = reduce(DataFrame.unionByName, parts)
    issues = dependencies.dependency_issues(of("dependency"))
    scores = pycalls.python_obfuscation(python).unionByName(of("javascript").select("repo", "path", matching.script_obfuscation(F.col("content")).alias("score"))).unionByName(of("shell").select("repo", "path", matching.shell_obfuscation(F.col("content")).alias("score")))
    per_file = findings.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("findings"), F.max(rank(F.col("severity"))).alias("severity_rank"))
    per_issue = issues.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("dep_issues"))
    results = known.where("language is not null").select("repo", "path", "language").join(per_file, ["repo", "path"], "left").join(per_issue, ["repo", "path"], "left").join(scores, ["repo", "path"], "left")
    results = results.select("repo", "path", "language", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("severity_rank", F.lit(0)).alias("severity_rank"), F.coalesce("dep_issues", F.lit(0)).alias("dep_issues"), F.coalesce("score", F.lit(0.0)).alias("obfuscation"))
    severities = findings.select("repo", "severity").unionByName(issues.select("repo", "severity"))
    if reviews is not None:
        severities = severities.unionByName(_known(reviews))
    walked = classify.walk_stats(known).join(classify.coverage(known), "repo", "left")
    return Audit(known, findings, issues, results, settled(walked, severities, reviews), walked, reviews)


def _apart(known: DataFrame) -> DataFrame:
    """The same files, whose language and content the optimizer does not write out again in each filter above.

    The test always holds, but is not deterministic to the optimizer; without it filters of some 300,000 characters
    fill the driver's memory.
    """
    return known.withColumn("language", F.when(F.monotonically_increasing_id() >= 0, F.col("language")))


def _known(reviews: DataFrame) -> DataFrame:
    return reviews.where("final_severity <> 'UNKNOWN'").select("repo", F.col("final_severity").alias("severity"))


def settled(walked: DataFrame, severities: DataFrame, reviews: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """walked(repo, files_walked, files_analyzed, dominant, dominant_supported, is_low_coverage, ratio) with counts, risk and confidence.

    severities(repo, severity) are those of findings, issues and known reviews;
    reviews(repo, final_severity, final_confidence) cap the risk and give the
    confidence; verdicts(repo, verdict) on trust chains override the risk last.
    """
    return _settled(walked, review.histogram(severities), reviews, verdicts)


def _settled(walked: DataFrame, counts: DataFrame, reviews: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """settled with the histogram of the severities; what else counts holds is kept."""
    joined = walked.join(counts, "repo", "left").fillna(0, subset=["critical", "high", "medium", "low", "info", "safe", "total"])
    if reviews is not None:
        known = F.when(F.col("final_severity") != "UNKNOWN", F.col("final_severity"))
        voted = reviews.groupBy("repo").agg(review.guardrail(known).alias("cap"), F.avg(F.when(known.isNotNull(), F.col("final_confidence"))).alias("mean"), F.count_if(known.isNull()).alias("review_failures"))
        joined = joined.join(voted, "repo", "left")
    else:
        joined = joined.withColumns({"cap": F.lit(None).cast("string"), "mean": F.lit(None).cast("double"), "review_failures": F.lit(0).cast("long")})
    joined = joined.withColumns({"files_total": F.col("files_walked"), "is_partial": ~F.col("dominant_supported") | F.col("is_low_coverage")})
    out = review.overall_risk(joined).withColumn("confidence", F.round(review.overall_confidence(F.col("mean"), F.col("files_analyzed"), F.col("is_partial"), F.col("ratio")), 6))
    if verdicts is None:
        return out.withColumn("verdict", F.lit(None).cast("string"))
    said = verdicts.groupBy("repo").agg(F.min("verdict").alias("verdict"))
    return out.join(said, "repo", "left").withColumn("risk", review.trust_override(F.col("risk"), F.coalesce("verdict", F.lit("UNKNOWN"))))


@dataclass
class Reviewed:
    """What reviews and trust add to an audit; lazy tables again."""

    selected: DataFrame
    reviews: DataFrame
    scenarios: DataFrame
    assumptions: DataFrame
    log: DataFrame
    repositories: DataFrame

    def persist(self) -> Reviewed:
        for table in (self.reviews, self.assumptions):
            table.persist()
        return self

    def unpersist(self) -> None:
        for table in (self.reviews, self.assumptions):
            table.unpersist()


def reviewed(audited: Audit, verdicts: DataFrame, given: DataFrame, flows: DataFrame, chains: DataFrame, results: DataFrame, limit: int | None = 10) -> Reviewed:
    """The second half of an audit: selection, consensus, assumptions, verification, downgrade, override.

    Inputs are what the outside services said: verdicts(repo, path, role,
    severity, confidence, malicious, gray, summary) of reviewers, the assumptions
    given(repo, pos, category, claim, subject, risk_ids) and flows(repo, pos,
    detail) of trust chains, chains(repo, verdict) on them, and search
    results(subject, position, title, url, description).  Of each repository the
    first limit selected files count, all where that is None; a selected file
    without a verdict has no review.
    """
    chosen = review.selected(audited.results, limit)
    votes = verdicts.join(chosen.select("repo", "path"), ["repo", "path"], "left_semi").withColumn("review", F.struct("repo", "path"))
    agreed = review.consensus(votes).select("review.repo", "review.path", "*").drop("review")
    marked = review.tagged(agreed.join(chosen.select("repo", "path", "language", "findings"), ["repo", "path"]))
    ids = given.select("repo", F.format_string("ta_%03d", F.col("pos") + 1).alias("id"), "risk_ids")
    made = trust.chain_assumptions(given.drop("risk_ids"), flows).join(ids, ["repo", "id"], "left").withColumn("risk_ids", F.coalesce("risk_ids", F.array().cast("array<string>")))
    verified = trust.verify(made, results).withColumn("pos", F.col("id"))
    texts = marked.select("repo", F.col("path").alias("id"), F.col("final_severity").alias("severity"), F.concat_ws(" ", "path", "consensus_summary").alias("text"))
    lowered = trust.downgrade(texts, verified).select("repo", F.col("id").alias("path"), "new_severity", "subject", "assumption")
    after = marked.join(lowered, ["repo", "path"]).withColumn("first_severity", F.col("final_severity")).withColumn("final_severity", F.col("new_severity")).drop("new_severity")
    log = after.where("assumption is not null").select("repo", "path", "first_severity", "final_severity", "subject", "assumption")
    used = log.select("repo", F.col("assumption").alias("id")).distinct().withColumn("applied", F.lit(True))
    assumptions = verified.drop("pos").join(used, ["repo", "id"], "left").withColumn("downgrade_applied", F.coalesce("applied", F.lit(False))).drop("applied")
    severe = audited.findings.select("repo", "path", "severity").unionByName(audited.dep_issues.select("repo", "path", "severity"))
    severities = severe.drop("path").unionByName(after.where("final_severity <> 'UNKNOWN'").select("repo", F.col("final_severity").alias("severity")))
    stats = audited.repositories.select("repo", "files_walked", "files_analyzed", "skipped_size", "skipped_type", "over_cap", "code_files", "code_files_analyzed", "prompts", "is_prompt_based", "ratio", "dominant", "dominant_supported", "is_low_coverage")
    scenarios = review.scenario_gate(audited.findings).join(after.select("repo", "path"), ["repo", "path"], "left_semi")
    tallied = trust.tally(assumptions)
    risk = settled(stats, severities, after.select("repo", "final_severity", "final_confidence"), chains).join(tallied, "repo", "left").fillna(0, subset=["confirmed", "failed", "inconclusive"])
    return Reviewed(chosen, after, scenarios, assumptions, log, risk)


def _listed(rows: DataFrame, order: list, text, limit: int | None) -> DataFrame:
    """(repo, body): the text of each row in order, the first limit of a repository, and how many more there are."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    numbered = rows.withColumn("text", text).withColumn("place", place).select("repo", "place", "text")
    kept = numbered.where(F.col("place") <= limit) if limit else numbered
    grouped = kept.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["text"])), "\n")
    more = numbered.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    rest = F.col("n") - F.size("all")
    return grouped.join(more, "repo").select("repo", F.concat(body, _rest(rest)).alias("body"))


#: Tasks that share the findings of a repository, and the orders of a report's two long lists.
DEALT = 16


def _told(findings: DataFrame, issues: DataFrame, limit: int | None) -> DataFrame:
    """(repo, histogram of severities, Findings, Dependencies): counts and lists in one pass, since each pass matches all files again.

    Lists are as those of _listed; the first limit rows of each share of a repository are found first, then those of all.
    """
    entry = lambda section, a, b, c, text: ["repo", "path", "severity", F.lit(section).alias("section"), F.struct((-rank(F.col("severity"))).alias("rank"), "path", a.alias("a"), b.alias("b"), c.alias("c"), text.alias("text")).alias("entry")]
    no, none = F.lit(0).cast("long"), F.lit("")
    rows = findings.select(*entry("Findings", F.col("seq"), none, none, F.format_string("**%s** %s (%s:%d)", "severity", "title", "path", "line")))
    rows = rows.unionByName(issues.select(*entry("Dependencies", no, F.col("package"), F.col("type"), F.format_string("**%s** %s (%s)", "severity", "description", "path"))))
    own = Window.partitionBy("repo", "section", F.pmod(F.xxhash64("path"), F.lit(DEALT))).orderBy("entry")
    numbered = rows.withColumn("place", F.row_number().over(own))
    first = F.col("place") <= limit if limit else F.lit(True)
    sections = ["Findings", "Dependencies"]
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in FINDING_ORDER] + [F.count_if(~F.col("severity").isin("SAFE", "INFO")).alias("total")]
    lists = [x for s in sections for x in (F.count_if(F.col("section") == s).alias(f"n{s}"), F.collect_list(F.when((F.col("section") == s) & first, F.col("entry"))).alias(s))]
    out = numbered.groupBy("repo").agg(*counts, *lists)
    for s in sections:
        kept = F.array_sort(s)
        kept = F.slice(kept, 1, limit) if limit else kept
        rest = F.col(f"n{s}") - F.size(kept)
        body = F.array_join(F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])), "\n")
        out = out.withColumn(s, F.when(F.col(f"n{s}") > 0, F.concat(body, _rest(rest)))).drop(f"n{s}")
    return out


def _rest(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("\n\n"), n.cast("string"), F.lit(" more are in the table of findings."))).otherwise("")


#: What each banner of a report says.
BANNERS = {
    "incomplete": "Nothing in this repository could be analysed.",
    "empty": "This repository has no files.",
    "unsupported_language": "Its main language is not supported: the core of the code was not analysed.",
    "low_coverage": "Less than half of its code was analysed.",
    "review_failures": "Some reviews gave no result.",
    "static_only": "No review took part in this result.",
}


def report(audited: Audit, second: Reviewed | None = None, limit: int | None = 1000) -> DataFrame:
    """(repo, report) in Markdown: heading, banner, risk, scan, severities, findings, dependency issues and, with reviews, those, assumptions and downgrades.

    Lists hold the first limit rows of a repository, highest severity first, and say how many more there are.
    """
    told = _told(audited.findings, audited.dep_issues, limit)
    if second:
        rows = second.repositories.join(told.select("repo", "Findings", "Dependencies"), "repo", "left")
    else:
        if audited.reviews is not None:
            lists = told.unionByName(review.histogram(_known(audited.reviews)), allowMissingColumns=True).groupBy("repo")
            told = lists.agg(*[F.sum(s).alias(s) for s in (*[s.lower() for s in FINDING_ORDER], "total")], F.max("Findings").alias("Findings"), F.max("Dependencies").alias("Dependencies"))
        rows = _settled(audited.walked, told, audited.reviews)
    sections = {}
    if second:
        down = F.when(F.col("assumption").isNotNull(), F.concat(F.lit(", lowered from "), "first_severity", F.lit(" because of "), "subject")).otherwise("")
        sections["Reviews"] = _listed(second.reviews, [rank(F.col("final_severity")).desc(), "path"], F.concat(F.lit("**"), "final_severity", F.lit("** "), "path", F.format_string(" (confidence %.2f)", "final_confidence"), F.when(F.col("semantic_attack"), ", no rule had found it").otherwise(""), down), limit)
        state = F.when(F.col("verified"), "confirmed").when(~F.col("verified"), "not confirmed").otherwise("open")
        sections["Assumptions"] = _listed(second.assumptions, ["id"], F.concat(F.coalesce("claim", "subject", F.lit("")), F.lit(": "), state), limit)
    for name, body in sections.items():
        rows = rows.join(body.withColumnRenamed("body", name), "repo", "left")
    table = F.concat(*[x for s in ("critical", "high", "medium", "low", "info", "safe") for x in (F.lit(f"| {s.upper()} | "), F.col(s).cast("string"), F.lit(" |\n"))])
    no = F.lit(False)
    name = review.banner(F.col("risk") == "INCOMPLETE", F.col("risk") == "EMPTY_REPO", ~F.coalesce("dominant_supported", ~no), F.coalesce("is_low_coverage", no), F.coalesce("review_failures", F.lit(0)), F.lit(second is None))
    banner = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BANNERS.items() for x in pair]), name), F.lit(""))
    scan = F.format_string("%d files, %d analysed, %d skipped by type, %d by size; main language %s, coverage %.0f %%", "files_walked", "files_analyzed", "skipped_type", "skipped_size", F.coalesce("dominant", F.lit("N/A")), F.coalesce("ratio", F.lit(1.0)) * 100)
    parts = [F.lit("# Security audit: "), F.col("repo"), F.when(banner != "", F.concat(F.lit("\n\n> "), banner)).otherwise(""), F.lit("\n\nRisk: "), F.col("risk"), F.lit(", confidence "), F.format_number("confidence", 2), F.coalesce(F.concat(F.lit("\n\nTrust: "), "verdict"), F.lit("")), F.lit("\n\nScan: "), scan, F.lit("\n\n| severity | count |\n|---|---|\n"), table]
    for name_ in ("Findings", "Dependencies", *sections):
        parts += [F.lit(f"\n## {name_}\n\n"), F.coalesce(name_, F.lit("none")), F.lit("\n")]
    return rows.select("repo", F.concat(*parts).alias("report"))
