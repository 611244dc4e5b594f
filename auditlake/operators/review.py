"""Reviews: which files are reviewed, how verdicts become a consensus, what a repository risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONSENSUS_ORDER, FINDING_ORDER, RISK_ORDER, name_of, rank


def selected(results: DataFrame, limit: int | None = 10, web: bool = False) -> DataFrame:
    """File results (repo, path, language, findings, obfuscation, dep_issues) that go to review, the first limit of each repository."""
    wanted = F.col("findings") > 0
    if web:
        wanted = wanted | (F.col("language") == "skill_prompt")
    else:
        wanted = wanted | (F.col("obfuscation") > 0.5) | (F.col("dep_issues") > 0) | F.col("language").isin("skill_prompt", "tool_config")
    kept = results.where(F.coalesce(wanted, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return kept.withColumn("place", place).where(F.col("place") <= limit) if limit else kept


def scenario_gate(findings: DataFrame, compat: bool = False) -> DataFrame:
    """Files whose findings call for scenarios: the highest is critical or high; in compat mode all are."""
    severe = F.col("severity").isin("CRITICAL", "HIGH")
    return findings.groupBy("repo", "path").agg((F.bool_and(severe) if compat else F.bool_or(severe)).alias("simulate")).where("simulate").select("repo", "path")


def consensus(verdicts: DataFrame, compat: bool = False) -> DataFrame:
    """One row for each review of verdicts(review, role, severity, confidence, malicious, gray, summary).

    The mean ordinal gives the severity; a strict majority decides malice; any
    gray vote or disagreement is gray; unanimity raises the mean confidence by
    0.1, disagreement lowers it by 0.2.  UNKNOWN verdicts do not vote on the
    severity, and if all are UNKNOWN so is the result; compat mode counts them 0.
    """
    c = F.col
    ordinal = rank(c("severity"), CONSENSUS_ORDER)
    known = ordinal > 0
    mean = F.avg(ordinal) if compat else F.avg(F.when(known, ordinal))
    grouped = verdicts.groupBy("review").agg(mean.alias("mean"), F.sum(c("malicious").cast("int")).alias("bad"), F.count(F.lit(1)).alias("votes"), F.max(c("gray").cast("int")).alias("gray"), F.count_distinct("severity").alias("kinds"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("role", "severity", "summary"))).alias("all"))
    band = F.when(c("mean").isNull(), "UNKNOWN").when(c("mean") >= 4.5, "CRITICAL").when(c("mean") >= 3.5, "HIGH").when(c("mean") >= 2.5, "MEDIUM").when(c("mean") >= 1.5, "LOW").otherwise("SAFE")
    one = c("kinds") == 1
    sure = F.when(one, F.least(c("confidence") + 0.1, F.lit(1.0))).otherwise(F.greatest(c("confidence") - 0.2, F.lit(0.1)))
    summary = F.array_join(F.transform("all", lambda v: F.concat(F.lit("["), v["role"], F.lit("] "), F.coalesce(v["summary"], F.lit("")))), " | ")
    return grouped.select("review", band.alias("final_severity"), F.round(sure, 6).alias("final_confidence"), (c("bad") * 2 > c("votes")).alias("is_malicious"), ((c("gray") > 0) | ~one).alias("is_gray_area"), summary.alias("consensus_summary"), F.when(one, 0).otherwise(F.size("all")).alias("disagreements"))


def tagged(reviews: DataFrame) -> DataFrame:
    """Reviews(language, findings, is_malicious, final_severity, ...) with the forced and semantic-attack marks."""
    forced = (F.col("language") == "skill_prompt") & (F.col("findings") == 0)
    return reviews.withColumn("forced", forced).withColumn("semantic_attack", forced & (F.col("is_malicious") | F.col("final_severity").isin("CRITICAL", "HIGH", "MEDIUM")))


def group_severity(reviews: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Severity of each review: its own, else the highest known of its verdicts, else UNKNOWN."""
    known = verdicts.where(F.col("severity").isin(RISK_ORDER)).groupBy("review").agg(F.max(rank(F.col("severity"), RISK_ORDER)).alias("r"))
    return reviews.join(known, "review", "left").select("review", F.coalesce(F.nullif("final_severity", F.lit("")), name_of(F.col("r"), RISK_ORDER), F.lit("UNKNOWN")).alias("severity"))


def histogram(rows: DataFrame, key: str = "repo", severity: str = "severity") -> DataFrame:
    """Count of each of the six severities, zeros included, and the total without SAFE and INFO."""
    counts = [F.count_if(F.col(severity) == s).alias(s.lower()) for s in FINDING_ORDER]
    return rows.groupBy(key).agg(*counts, F.count_if(~F.col(severity).isin("SAFE", "INFO")).alias("total"))


def base_risk(files_scanned: Column) -> Column:
    """The highest level with a count, of a histogram; without one SAFE or, if nothing was scanned, UNKNOWN."""
    out = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH").when(F.col("medium") > 0, "MEDIUM").when(F.col("low") > 0, "LOW")
    return out.when(files_scanned > 0, "SAFE").otherwise("UNKNOWN")


def capped(risk: Column, cap: Column) -> Column:
    """The lower of a risk and a cap; a null cap or an incomparable risk changes nothing."""
    comparable = risk.isin(RISK_ORDER) & cap.isin(RISK_ORDER)
    return F.when(comparable, name_of(F.least(rank(risk, RISK_ORDER), rank(cap, RISK_ORDER)), RISK_ORDER)).otherwise(risk)


def guardrail(severity: Column) -> Column:
    """Aggregate: MEDIUM if there are reviews and all of them are SAFE or LOW."""
    return F.when(F.coalesce(F.bool_and(severity.isin("SAFE", "LOW")), F.lit(False)), "MEDIUM")


def overall_risk(counts: DataFrame) -> DataFrame:
    """Add risk to (histogram, files_total, files_analyzed, dominant, is_partial, cap)."""
    c = F.col
    base = capped(base_risk(c("files_analyzed")), c("cap"))
    partial = F.when(c("total") > 0, F.concat(base, F.lit(" (PARTIAL AUDIT — "), "dominant", F.lit(" code not analyzed)"))).otherwise(F.concat(F.lit("PARTIAL — core language ("), "dominant", F.lit(") not analyzed")))
    risk = F.when((c("files_analyzed") == 0) & (c("files_total") > 0), "INCOMPLETE").when(c("files_total") == 0, "EMPTY_REPO").when(c("is_partial"), partial).otherwise(base)
    return counts.withColumn("risk", risk)


def overall_confidence(mean: Column, files_analyzed: Column, is_partial: Column, ratio: Column) -> Column:
    plain = F.coalesce(mean, F.when(files_analyzed > 0, 0.7).otherwise(0.0))
    return F.when(is_partial & (plain > 0), F.greatest(plain * ratio, F.lit(0.05))).otherwise(plain)


def trust_override(risk: Column, verdict: Column) -> Column:
    """Risk text after the verdict on the trust chain; special states stay, suffixes are kept."""
    base = F.regexp_extract(risk, r"^(SAFE|LOW|MEDIUM|HIGH|CRITICAL)(?: |$)", 1)
    suffix = F.substring(risk, F.length(base) + 1, F.lit(1 << 30))
    floor = F.when(rank(base, RISK_ORDER) < 2, "MEDIUM").otherwise(base)
    bare = F.when(verdict == "DO_NOT_USE", F.concat(F.lit("CRITICAL ("), risk, F.lit(")"))).when(verdict == "VERIFY_BEFORE_USE", F.concat(F.lit("MEDIUM ("), risk, F.lit(")"))).otherwise(risk)
    graded = F.when(verdict == "DO_NOT_USE", F.concat(F.lit("CRITICAL"), suffix)).when(verdict == "VERIFY_BEFORE_USE", F.concat(floor, suffix)).otherwise(risk)
    return F.when(risk.isin("INCOMPLETE", "EMPTY_REPO", "UNKNOWN"), risk).when(base == "", bare).otherwise(graded)


def banner(incomplete: Column, empty: Column, unsupported: Column, low: Column, failures: Column, static_only: Column) -> Column:
    """Name of the first banner that applies."""
    return F.when(incomplete, "incomplete").when(empty, "empty").when(unsupported, "unsupported_language").when(low, "low_coverage").when(failures > 0, "review_failures").when(static_only, "static_only").otherwise("none")


def evaluation(results: DataFrame) -> DataFrame:
    """By category of (fixture, category, severity, findings): totals, passes of the strict rules, rates; a missing audit passes nothing."""
    s = F.col("severity")
    ok = F.when(F.col("category") == "TRUE_NEGATIVE", s.isin("SAFE", "LOW", "INFO")).when(F.col("category") == "GRAY_AREA", s.isin("MEDIUM", "HIGH")).otherwise(s.isin("CRITICAL", "HIGH") & (F.col("findings") > 0))
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(ok, F.lit(False))).alias("correct"), F.count_if(s == "NOT_AUDITED").alias("not_audited")).withColumn("rate", F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 6))


def judged_fixtures(truths: DataFrame, results: DataFrame) -> DataFrame:
    """truths(fixture, category, severity) with the risk and findings of results(fixture, risk, findings) and a status.

    A fixture without a result is NOT_AUDITED; the others are OK or MISSED by the strict rules of evaluation.
    """
    risk = F.col("risk")
    ok = F.when(F.col("category") == "TRUE_NEGATIVE", risk.isin("SAFE", "LOW", "INFO")).when(F.col("category") == "GRAY_AREA", risk.isin("MEDIUM", "HIGH")).otherwise(risk.isin("CRITICAL", "HIGH") & (F.col("findings") > 0))
    joined = truths.join(results.withColumn("audited", F.lit(True)), "fixture", "left")
    return joined.withColumn("status", F.when(F.col("audited").isNull(), "NOT_AUDITED").when(F.coalesce(ok, F.lit(False)), "OK").otherwise("MISSED")).drop("audited")


def fixture_rates(judged: DataFrame) -> DataFrame:
    """One row: detection, false positive and gray area rates of the audited fixtures, 0 where there are none, and how many are not."""
    def share(category: str):
        own = (F.col("category") == category) & (F.col("status") != "NOT_AUDITED")
        return F.coalesce(F.try_divide(F.count_if(own & (F.col("status") == "OK")), F.count_if(own)), F.lit(None).cast("double"))

    rate = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return judged.agg(rate(share("TRUE_POSITIVE"), "detection_rate"), rate(1 - share("TRUE_NEGATIVE"), "false_positive_rate"), rate(share("GRAY_AREA"), "gray_area_rate"), F.count_if(F.col("status") == "NOT_AUDITED").alias("not_audited"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """(status, repositories, findings, highest) of runs(repo, status, risk, findings): completed, clone_failed or error."""
    base = F.regexp_extract("risk", r"^(SAFE|LOW|MEDIUM|HIGH|CRITICAL)(?: |$)", 1)
    done = F.col("status") == "completed"
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("repositories"), F.coalesce(F.sum(F.when(done, F.col("findings"))), F.lit(0)).cast("long").alias("findings"), name_of(F.max(F.when(done & (base != ""), rank(base, RISK_ORDER))), RISK_ORDER).alias("highest"))


def self_test(results: DataFrame) -> DataFrame:
    """Passes of the lenient rules on (category, severity, findings, obfuscated), with a total row."""
    s = F.col("severity")
    ok = F.when(F.col("category") == "TRUE_POSITIVE", s.isin("CRITICAL", "HIGH") | F.col("obfuscated")).when(F.col("category") == "TRUE_NEGATIVE", s.isin("SAFE", "LOW", "INFO", "MEDIUM")).when(F.col("category") == "GRAY_AREA", F.col("findings") > 0).otherwise(F.lit(True))
    rolled = results.withColumn("ok", ok).rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"))
    return rolled.select(F.coalesce("category", F.lit("ALL")).alias("category"), "total", "passed", F.round(F.col("passed") / F.col("total"), 6).alias("rate"))


def semantic_hits(reviews: DataFrame) -> DataFrame:
    """Count of tagged reviews of each repository that found an attack where no rule had a hit."""
    return tagged(reviews).groupBy("repo").agg(F.count_if("forced").alias("forced"), F.count_if("semantic_attack").alias("semantic_attacks"))


def ordered_facts(facts: DataFrame) -> DataFrame:
    """Facts(repo, pos, priority, fact) with their place: MUST, SHOULD, NICE, others as SHOULD; ties by position."""
    order = F.when(F.col("priority") == "MUST", 0).when(F.col("priority") == "NICE", 2).otherwise(1)
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(order, "pos")))


def top_types(counts: DataFrame, n: int = 8) -> DataFrame:
    """The n most frequent file types of each repository, ties by name."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("files").desc(), "ext"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def review_prompt(path: Column, context: Column, content: Column) -> Column:
    """Text of a review request, its parts cut to the lengths that a reviewer gets."""
    part = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return F.concat(F.lit("File: "), path, F.lit("\n\nContext:\n"), part(context, 3000), F.lit("\n\nContent:\n"), part(content, 6000))
