"""Discovery of repositories from links, targets from addresses, and the cache of reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def discover(files: DataFrame, limit: int | None = 20) -> DataFrame:
    """(url, owner, name) of the distinct repository links in files, in order, without the ignored; the first limit."""
    links = files.select(F.explode(T.repository_links(F.col("content"))).alias("url")).distinct()
    for word in R.LINK_IGNORED:
        links = links.where(~F.col("url").contains(word))
    owner, name = T.owner_and_repo(F.col("url"))
    out = links.select("url", owner.alias("owner"), name.alias("name")).where("owner <> '' and name <> ''")
    return out.orderBy("url").limit(limit) if limit else out


#: Fixed values. Addresses of search pages that are no repositories.
SEARCH_PAGES = ["google.com", "bing.com", "baidu.com", "search?"]


def target(url: Column) -> Column:
    """struct(owner, name, subdir) of an address: with a tree path, with .git, or a plain root whose name has no dot; else, and for search pages, null."""
    u = F.regexp_replace(T.strip(url), r"[?#].*$", "")
    found = lambda p, n: F.nullif(F.regexp_extract(u, p, n), F.lit(""))
    tree, git, root = r"github\.com/([^/]+)/([^/]+?)(?:\.git)?/tree/[^/]+/(.+?)/?$", r"github\.com/([^/]+)/([^/]+?)\.git/?$", r"github\.com/([^/]+)/([^/.]+)/?$"
    owner = F.coalesce(found(tree, 1), found(git, 1), found(root, 1))
    name = F.coalesce(found(tree, 2), found(git, 2), found(root, 2))
    search = reduce(lambda a, b: a | b, [F.contains(F.lower(url), F.lit(x)) for x in SEARCH_PAGES])
    return F.when(owner.isNotNull() & name.isNotNull() & ~search, F.struct(owner.alias("owner"), name.alias("name"), F.coalesce(found(tree, 3), F.lit("")).alias("subdir")))


def slug(name: Column, subdir: Column) -> Column:
    return F.when(subdir == "", name).otherwise(F.concat(name, F.lit("__"), F.replace(subdir, F.lit("/"), F.lit("__"))))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def listing(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with its age within its key, the newest 1."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])))


def upsert(index: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """index with the rows of new in the place of those with the same keys."""
    return latest(index.unionByName(new, allowMissingColumns=True), keys, order)


def uncached(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """Targets(owner, slug) without a report."""
    return targets.join(reports.select("owner", "slug").distinct(), ["owner", "slug"], "left_anti")


def skill_context(files: DataFrame) -> DataFrame:
    """(repo, context): the README, prompt files, the package description and the setup file, cut and joined.

    Of each kind the one nearest to the root, by path; prompt files until there are two parts with the README.
    """
    c = F.col
    name = F.lower("filename")
    package = F.from_json("content", "name string, description string")
    kind = F.when(name.isin("readme.md", "readme.rst", "readme.txt", "readme"), 0).when(name == "skill.md", 1).when(c("filename") == "package.json", 2).when(c("filename").isin("setup.py", "pyproject.toml", "setup.cfg"), 3)
    text = F.when(kind == 2, F.concat(F.lit("Package: "), F.coalesce(package["name"], F.lit("")), F.lit(" - "), F.coalesce(package["description"], F.lit("")))).when(kind == 3, F.substring("content", 1, 1000)).otherwise(F.substring("content", 1, 2000))
    wish = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("readme.md", "readme.rst", "readme.txt", "readme")]), name), F.lit(0))
    parts = files.select("repo", kind.alias("kind"), F.struct(F.length("path").alias("depth"), wish.alias("wish"), "path").alias("place"), text.alias("part")).where("kind is not null")
    place = F.row_number().over(Window.partitionBy("repo", "kind").orderBy("place"))
    described = parts.where("kind = 0").select("repo").distinct().withColumn("described", F.lit(1))
    numbered = parts.withColumn("n", place).join(described, "repo", "left")
    chosen = numbered.where(F.col("n") <= F.when(F.col("kind") == 1, 2 - F.coalesce("described", F.lit(0))).otherwise(1))
    joined = chosen.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    every = files.select("repo").distinct()
    return every.join(joined, "repo", "left").withColumn("context", F.coalesce("context", F.lit("No skill documentation found. Unknown purpose.")))
