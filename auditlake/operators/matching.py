"""Rules against lines and documents: hits, findings, deduplication, obfuscation scores.

Rules are unrolled into literal patterns inside one projection over a file's
array of lines, each behind a test for strings that its matches must hold.  Matching needs
no shuffle, and the code context is cut from the same array for hits alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..schema import FINDING_COLUMNS, name_of, rank

Rules = list[tuple[str, str, str]]


def line_hits(files: DataFrame, rules: Rules, skip: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """(all columns of files, lines, rule, severity, name, line, text) of each rule on each line.

    skip(name, line) says which lines a rule leaves out.  Null contents have no
    lines; repeated files are matched each.
    """
    def found(line: Column, number: Column) -> Column:
        tests = []
        for i, (severity, name, pattern) in enumerate(rules):
            hit = T.likely(line, pattern) & T.matches(line, pattern)
            hit = hit & ~skip(name, line) if skip else hit
            tests.append(F.when(hit, F.struct(F.lit(i).alias("rule"), F.lit(severity.upper()).alias("severity"), F.lit(name).alias("name"), number.alias("line"), line.alias("text"))))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    numbered = F.transform("lines", lambda line, i: F.struct(line.alias("x"), (i + 1).alias("n")))
    likely = F.filter(numbered, lambda s: reduce(lambda a, b: a | b, [T.likely(s["x"], p) for _, _, p in rules]))
    hits = F.flatten(F.transform(likely, lambda s: found(s["x"], s["n"])))
    some = T.with_likely(files, [p for _, _, p in rules]).drop("__low")
    return some.withColumn("lines", T.lines(F.col("content"))).drop("content").withColumn("hit", F.explode(hits)).select("*", "hit.*").drop("hit")


def line_hits_by_join(files: DataFrame, rules: Rules) -> DataFrame:
    """The same hits by a join of lines with a table of rules; slower, the check of line_hits."""
    table = files.sparkSession.createDataFrame([(i, s.upper(), n, f"(?d){p}") for i, (s, n, p) in enumerate(rules)], "rule int, severity string, name string, pattern string")
    exploded = files.withColumn("lines", T.lines(F.col("content"))).drop("content").select("*", F.posexplode("lines").alias("line", "text")).withColumn("line", F.col("line") + 1)
    return exploded.join(F.broadcast(table), F.expr("text rlike pattern")).drop("pattern")


def _finding(hits: DataFrame, category: Column, identifier: Column, title: Column, description: Column, confidence: float, around: int = 5) -> DataFrame:
    made = hits.withColumns({"seq": F.col("rule").cast("long") * 10_000_000 + F.col("line"), "category": category, "rule_id": identifier, "title": title, "description": description, "code_context": T.context(F.col("lines"), F.col("line"), around), "tainted": F.lit(False), "confidence": F.lit(confidence)})
    return made.select(*FINDING_COLUMNS)


def shell_hits(files: DataFrame) -> DataFrame:
    """Shell rules on lines that are no comments; a shebang is no access to the environment."""
    comment = lambda line: T.matches(line, r"^\s*#([^!]|$)")

    def skip(name: str, line: Column) -> Column:
        return comment(line) | T.matches(line, r"^\s*#!") if name == "env_access" else comment(line)

    return line_hits(files, R.SHELL_RULES, skip)


def in_echo(line: Column) -> Column:
    """Whether a line only echoes one quoted string without substitution."""
    rest = T.strip(F.substring(T.strip(line), 5, 1 << 30))
    inner = F.substring(rest, 2, 1 << 30)
    quoted = (rest.startswith('"') & rest.endswith('"')) | (rest.startswith("'") & rest.endswith("'"))
    return T.matches(T.strip(line), r"^echo\s") & quoted & ~inner.contains("$(") & ~inner.contains("`")


ECHO_NOTE = " [inside an echoed quoted string: documentation or execution?]"


def shell_findings(files: DataFrame, merge: bool = True) -> DataFrame:
    """Findings of shell files, one for each rule and file unless merge is off."""
    note = F.when(F.col("name").isin("curl_pipe_shell", "wget_pipe_shell") & in_echo(F.col("text")), ECHO_NOTE).otherwise("")
    found = _finding(shell_hits(files), F.concat(F.lit("shell_"), "name"), T.rule_id("SH", F.col("severity"), F.col("line")), F.concat(F.lit("Shell: "), "name"), F.concat(F.lit("shell rule "), "name", note), 0.75)
    return deduplicate(found) if merge else found


def js_findings(files: DataFrame) -> DataFrame:
    category = F.concat(F.lit("js_"), F.replace(F.replace("name", F.lit(" "), F.lit("_")), F.lit("()"), F.lit("")))
    return _finding(line_hits(files, R.JS_RULES), category, T.rule_id("JS", F.col("severity"), F.col("line")), F.concat(F.lit("JS: "), "name"), F.concat(F.lit("script rule "), "name"), 0.6)


def prompt_findings(files: DataFrame) -> DataFrame:
    """First match of each prompt rule in each file, over line ends."""
    tests = []
    for i, (severity, name, pattern) in enumerate(R.PROMPT_RULES):
        regex = f"(?dms){pattern}"
        before = F.split(F.col("content"), regex, 2)[0]
        tests.append(F.when(T.likely(F.col("content"), pattern, F.col("__low")) & F.col("content").rlike(regex), F.struct(F.lit(i).alias("rule"), F.lit(severity.upper()).alias("severity"), F.lit(name).alias("name"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"))))
    some = T.with_likely(files, [p for _, _, p in R.PROMPT_RULES]).withColumn("hits", F.filter(F.array(*tests), lambda x: x.isNotNull()))  # no test of their size: with the one that explode brings, all patterns would run on every file
    hits = some.withColumn("lines", T.lines(F.col("content"))).withColumn("hit", F.explode("hits")).select("*", "hit.*").drop("hit", "hits", "content", "__low")
    return _finding(hits, F.concat(F.lit("skill_prompt_"), "name"), T.rule_id("SK", F.col("severity"), F.col("line")), F.concat(F.lit("Skill Prompt: "), "name"), F.concat(F.lit("prompt rule "), "name"), 0.65, 3)


def network_line_findings(files: DataFrame, known: DataFrame) -> DataFrame:
    """Network calls on lines of which known(repo, path, line) has no finding; the first pattern of a line counts."""
    hits = line_hits(files, R.NETWORK_LINES)
    first = hits.groupBy("repo", "path", "line").agg(F.min_by(F.struct("rule", "severity", "name", "text", "lines"), "rule").alias("h")).select("repo", "path", "line", "h.*")
    left = first.join(known.select("repo", "path", "line").distinct(), ["repo", "path", "line"], "left_anti")
    return _finding(left, F.lit("network"), T.rule_id("PY-NET", F.col("severity"), F.col("line")), F.concat(F.lit("Network call: "), "name"), F.concat(F.lit("network rule "), "name"), 0.6)


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding for each (repo, path, title): highest severity, first place, all lines and contexts.

    The order within a file is seq; a group of one stays as it is, a merged one
    loses its taint flag.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "line", "code_context")))
    first = F.min_by(F.struct("seq", "line", "category", "rule_id", "description", "tainted"), "seq")
    grouped = findings.groupBy("repo", "path", "title").agg(first.alias("f"), F.max(rank(F.col("severity"))).alias("r"), F.max("confidence").alias("confidence"), rows.alias("all"))
    places = F.array_join(F.transform("all", lambda x: x["line"].cast("string")), ", ")
    note = F.concat(F.lit(" [×"), F.size("all").cast("string"), F.lit(" occurrences at lines: "), places, F.lit("]"))
    contexts = F.array_join(F.transform("all", lambda x: F.concat(F.lit("--- Line "), x["line"].cast("string"), F.lit(" ---\n"), x["code_context"])), "\n\n")
    several = F.size("all") > 1
    return grouped.select("repo", "path", F.col("f.seq").alias("seq"), F.col("f.line").alias("line"), name_of(F.col("r")).alias("severity"), F.col("f.category").alias("category"), F.col("f.rule_id").alias("rule_id"), "title", F.when(several, F.concat(F.col("f.description"), note)).otherwise(F.col("f.description")).alias("description"), F.when(several, contexts).otherwise(F.col("all")[0]["code_context"]).alias("code_context"), F.when(several, F.lit(False)).otherwise(F.col("f.tainted")).alias("tainted"), "confidence")


def script_obfuscation(content: Column) -> Column:
    """Score of JavaScript: many evals, many hex escapes."""
    return F.when(T.count_matches(content, r"eval\s*\(") > 3, 0.5).otherwise(0.0) + F.when(T.count_matches(content, r"\\x[0-9a-fA-F]{2}") > 10, 0.4).otherwise(0.0)


def shell_obfuscation(content: Column) -> Column:
    many = (T.count_matches(content, r"base64\s+(-d|--decode)") >= 2) | (T.count_matches(content, r"\\x[0-9a-fA-F]{2}") >= 5) | (T.count_matches(content, r"\beval\b") >= 3)
    return F.when(many, 0.6).otherwise(0.0)


def pattern_obfuscation(content: Column) -> Column:
    """Part of the Python score that whole-document patterns give, 0.3 each."""
    met = [F.when(T.count_matches(content, p) >= least, 1).otherwise(0) for least, _, p in R.OBFUSCATION_RULES]
    return F.lit(0.3) * sum(met[1:], met[0])


def legacy_obfuscated(content: Column) -> Column:
    """The older scanner's test: one of three patterns more than twice."""
    #: Fixed values.
    patterns = [r"base64\.b64decode", r"getattr\(", r"\\x[0-9a-fA-F]{2}\\x"]
    found = F.lit(False)
    for p in patterns:
        found = found | (T.count_matches(content, p) > 2)
    return found


#: Fixed values. The older scanner's JavaScript rules.
LEGACY_JS = [("HIGH", "os.system(Node)", r"child_process\.exec(?:File|Sync)?\("), ("HIGH", "write_file(Node)", r"fs\.writeFile(?:Sync)?\("), ("HIGH", "eval", r"eval\("), ("HIGH", "network", r"axios\."), ("HIGH", "network", r"fetch\(")]


def legacy_js_types(files: DataFrame) -> DataFrame:
    """(repo, path, types) of the older scanner: distinct kinds of hits, sorted."""
    return line_hits(files, LEGACY_JS).groupBy("repo", "path").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("types"), F.count(F.lit(1)).alias("hits"))
