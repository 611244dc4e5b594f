"""Scalar functions on text, as Columns: lines, names, paths, domains, links, replies.

Patterns follow Python's dialect: ``(?d)`` lets only a line feed end a line for
``.``, ``(?U)`` makes classes Unicode-aware.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines(content: Column) -> Column:
    """Lines of a text, without a last empty one; null counts as empty."""
    parts = F.split(F.coalesce(content, F.lit("")), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?d){pattern}")


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def needed(pattern: str) -> list[str]:
    """Strings of which every match holds at least one; empty if none can be told.

    Of the parts that a match cannot do without, the one whose shortest string is
    the longest.  ``likely`` tests them before the pattern runs.
    """
    return _needed_of(parser.parse(re.sub(r"^\(\?[a-z]+\)", "", pattern)))


def _needed_of(part) -> list[str]:
    """needed for a part of a parsed pattern."""
    best, run = [], ""
    for kind, value in [*part, (None, None)]:
        if kind is parser.LITERAL:
            run += chr(value)
            continue
        candidates = [[run]] if run else []
        run = ""
        inner = [value[-1]] if kind is parser.SUBPATTERN else [value[2]] if kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0 else value[1] if kind is parser.BRANCH else []
        each = [_needed_of(x) for x in inner]
        if each and all(each):
            candidates.append([x for e in each for x in e])
        for c in candidates:
            if min(map(len, c)) > min(map(len, best), default=0):
                best = c
    return best


def likely(text: Column, pattern: str, low: Column | None = None) -> Column:
    """A cheap test that every text with a match of pattern passes; low is the text in lower case, where it is at hand."""
    found = needed(pattern)
    if not found:
        return F.lit(True)
    if pattern.startswith("(?i)"):
        text, found = F.lower(text) if low is None else low, [x.lower() for x in found]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in dict.fromkeys(found)])


def with_likely(files: DataFrame, patterns: list[str], low: str = "__low") -> DataFrame:
    """The files whose content may hold a match of a pattern, with the content in lower case as column low."""
    lowered = files.withColumn(low, F.lower("content"))
    return lowered.where(reduce(lambda a, b: a | b, [likely(F.col("content"), p, F.col(low)) for p in patterns]))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?d){pattern}"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def context(all_lines: Column, line: Column, around: int = 5) -> Column:
    """The lines around a hit (1-based), numbered, the hit marked."""
    first = F.greatest(line - around, F.lit(1))
    last = F.least(line + around, F.size(all_lines))
    part = F.slice(all_lines, first, last - first + 1)
    return F.array_join(F.transform(part, lambda x, i: F.concat(F.when(first + i == line, ">>> ").otherwise("    "), F.format_string("%4d | ", first + i), rstrip(x))), "\n")


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot; names that only begin with dots have none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(filename, r"^\.*[^.].*?(\.[^.]*)$", 1)), F.lit("")), F.lit("(no ext)"))


def rule_id(prefix: str, severity: Column, line: Column) -> Column:
    return F.format_string(f"{prefix}-%s-%04d", F.substring(F.upper(severity), 1, 4), line)


def package_name(line: Column) -> Column:
    """Name in a line of requirements; only > = < ! [ end it."""
    return F.lower(strip(F.split(strip(line), r"[>=<!\[]")[0]))


def domain(subject: Column) -> Column:
    bare = F.replace(F.replace(subject, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.trim(F.lower(F.split(bare, "/")[0]))


def service(host: Column) -> Column:
    """Second-level label of a host, or its only label."""
    parts = F.split(F.lower(host), r"\.")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(parts[0])


def is_placeholder(subject: Column, names: list[str], ends: list[str]) -> Column:
    d = domain(subject)
    found = (d == "") | d.isin(names)
    for end in ends:
        found = found | d.endswith(end)
    return found


def is_trusted(subject: Column, names: list[str]) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(subject, F.lit("")))), r"^www\.", "")
    return s.isin(names) | (s.contains(".") & service(s).isin(names))


def repository_links(text: Column) -> Column:
    """Distinct cleaned links to repositories in a text."""
    found = F.regexp_extract_all(text, F.lit(r"https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"), F.lit(0))
    clean = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[)/.,;:'\"]+$", ""), r"\.git$", ""))
    return F.array_distinct(clean)


def owner_and_repo(url: Column) -> tuple[Column, Column]:
    pattern = r"github\.com/([^/]+)/([^/?#]+)"
    return F.regexp_extract(url, pattern, 1), F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: without code fences, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(reply, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    cut = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(valid(bare), valid(cut))
