"""Which analyzer a file goes to, and what a repository is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources.files import MAX_BYTES


def is_prompt(path: Column, filename: Column, content: Column) -> Column:
    """Prompt files by name, by a directory of the relative path, or by two telling phrases in the head."""
    dirs = F.split(F.lower(path), "/")
    head = F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 500))
    words = sum((F.contains(head, F.lit(w)).cast("int") for w in R.PROMPT_WORDS[1:]), F.contains(head, F.lit(R.PROMPT_WORDS[0])).cast("int"))
    return F.upper(filename).isin(R.PROMPT_FILES) | F.arrays_overlap(F.slice(dirs, 1, F.size(dirs) - 1), F.array(*[F.lit(d) for d in R.PROMPT_DIRS])) | (words >= 2)


def has_shell_shebang(content: Column) -> Column:
    return F.substring(F.element_at(F.split(F.coalesce(content, F.lit("")), "\n", 2), 1), 1, 200).rlike(r"^#!\s*/(?:usr/)?(?:bin/)?(bash|sh|zsh|dash|ksh)")


def language(path: Column, filename: Column, ext: Column, content: Column) -> Column:
    """Analyzer of a file, the first that applies; null if none does."""
    by_ext = F.try_element_at(F.create_map(*[F.lit(x) for pair in R.LANGUAGES.items() for x in pair]), ext)
    return F.when(filename.isin(R.PACKAGE_FILES), "dependency").when((ext == ".md") & is_prompt(path, filename, content), "skill_prompt").when(by_ext.isNotNull(), by_ext).when((ext == "(no ext)") & has_shell_shebang(content), "shell")


def within_limits(files: DataFrame, max_files: int | None = None, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Mark each file as over_cap (beyond max_files of its repository, by path) or too_large (beyond max_bytes); none where a limit is None.

    Only paths are ranked: the last path within the cap of each repository that
    has more files is found first, and contents are compared with it where they
    are.  Files that share that path count alike.
    """
    marked = files.withColumn("too_large", F.lit(False) if max_bytes is None else F.col("size_bytes") > max_bytes)
    if max_files is None:
        return marked.withColumn("over_cap", F.lit(False))
    place = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    ends = files.select("repo", "path").withColumn("__n", place).where(F.col("__n") <= max_files)
    last = ends.groupBy(F.col("repo").alias("__repo")).agg(F.max("path").alias("__last"), F.count(F.lit(1)).alias("__size")).where(F.col("__size") == max_files)
    joined = marked.join(last, F.col("repo").eqNullSafe(F.col("__repo")), "left")
    return joined.withColumn("over_cap", F.coalesce(F.col("path") > F.col("__last"), F.lit(False))).drop("__repo", "__last", "__size")


def classified(files: DataFrame, max_files: int | None = None, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """files with their language; files beyond the limits have none."""
    known = language(F.col("path"), F.col("filename"), F.col("ext"), F.col("content"))
    return within_limits(files, max_files, max_bytes).withColumn("language", F.when(~F.col("over_cap") & ~F.col("too_large"), known))


def _tallied(files: DataFrame) -> DataFrame:
    """Number of files of each kind; what is told of a walk is summed from these, so files are read once for all of it."""
    return files.groupBy("repo", "ext", "language", "over_cap", "too_large").agg(F.count(F.lit(1)).alias("files"))


def _files_if(test: Column) -> Column:
    return F.sum(F.when(test, F.col("files")).otherwise(0))


def walk_stats(files: DataFrame) -> DataFrame:
    """Counters of a walk, by repository, of classified files."""
    n, over, large, known = _files_if, F.col("over_cap"), F.col("too_large"), F.col("language").isNotNull()
    return _tallied(files).groupBy("repo").agg(n(~over).alias("files_walked"), n(known).alias("files_analyzed"), n(~over & large).alias("skipped_size"), n(over | (~large & ~known)).alias("skipped_type"), n(over).alias("over_cap"))


def type_counts(files: DataFrame) -> DataFrame:
    return files.where(~F.col("over_cap")).groupBy("repo", "ext").agg(F.count(F.lit(1)).alias("files"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))


def coverage(files: DataFrame) -> DataFrame:
    """By repository: code files, their share that was analyzed, the main language, whether coverage is low.

    The main language has the most files; ties go to the name first in order.
    """
    names = {**R.CODE_NAMES, **R.TEXT_NAMES}
    walked, ext, lang = ~F.col("over_cap"), F.col("ext"), F.col("language")
    n = lambda exts: _files_if(walked & ext.isin(list(exts)))
    parts = {"supported": n(e for e in names if e in R.LANGUAGES), "unsupported": n(e for e in R.CODE_NAMES if e not in R.LANGUAGES), "md": n([".md"]), "prompts": _files_if(lang == "skill_prompt"), "analyzed": _files_if(lang.isNotNull() & (lang != "dependency"))}
    mains = [F.struct((-F.col("prompts")).alias("n"), F.lit("Skill Prompt (MD)").alias("name"), F.lit(True).alias("known"))]
    for i, name in enumerate(sorted(set(names.values()))):
        own = [e for e in names if names[e] == name]
        parts |= {f"n{i}": n(own), f"k{i}": n(e for e in own if e in R.LANGUAGES or e not in R.CODE_NAMES)}
        mains.append(F.struct((-F.col(f"n{i}")).alias("n"), F.lit(name).alias("name"), (F.col(f"k{i}") > 0).alias("known")))
    main = F.array_min(F.filter(F.array(*mains), lambda m: m["n"] < 0))
    sums = _tallied(files).groupBy("repo").agg(*[v.alias(k) for k, v in parts.items()]).withColumn("m", main)
    sums = sums.select("repo", "supported", "unsupported", "md", "prompts", "analyzed", F.col("m.name").alias("dominant"), F.col("m.known").alias("dominant_supported"))
    c = F.col
    based = (c("prompts") > 0) & ((c("prompts") >= c("analyzed") - c("prompts")) | (c("md") > c("supported")))
    total = c("supported") + c("unsupported")
    whole = F.when(based, c("prompts") + total).otherwise(total)
    out = sums.withColumn("is_prompt_based", based).withColumn("code_files", total).withColumn("ratio", F.when(whole > 0, c("analyzed") / whole).otherwise(1.0))
    return out.select("repo", "code_files", c("analyzed").alias("code_files_analyzed"), "prompts", "is_prompt_based", F.round("ratio", 6).alias("ratio"), F.coalesce("dominant", F.lit("N/A")).alias("dominant"), F.coalesce("dominant_supported", F.lit(True)).alias("dominant_supported"), ((c("code_files") > 5) & (c("ratio") < 0.5) & ~c("is_prompt_based")).alias("is_low_coverage"))


def unsupported(files: DataFrame) -> DataFrame:
    """(repo, name, files, place): code in languages without an analyzer, the most frequent first, ties by name."""
    names = {e: n for e, n in R.CODE_NAMES.items() if e not in R.LANGUAGES}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    counts = type_counts(files).withColumn("name", F.try_element_at(known, F.col("ext"))).where("name is not null").groupBy("repo", "name").agg(F.sum("files").alias("files"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("files").desc(), "name")))


def analyzed_listing(files: DataFrame) -> DataFrame:
    """(repo, listing): analyzers with their number of files, by name."""
    rows = language_counts(files).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("language", "files"))).alias("all"))
    return rows.select("repo", F.array_join(F.transform("all", lambda x: F.concat(x["language"], F.lit(": "), x["files"].cast("string"))), ", ").alias("listing"))
