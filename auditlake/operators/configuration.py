"""Tool configuration: string leaves under telling keys that hold a dangerous word."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..schema import FINDING_COLUMNS
from ..session import ship

try:
    import yaml
except ImportError:  # YAML files then give an error row; reading them needs PyYAML on every executor
    yaml = None

LEAVES = "repo string, path string, leaf int, place string, key string, value string, error string"


def strings(document, in_lists: bool = False) -> Iterator[tuple[str, str, str]]:
    """(place, key, value) of every string that is a property, in document order; strings in lists only with in_lists.

    The key is that of the nearest mapping; a property of the document itself has a place that begins with a dot.
    """
    work = [("", "", document)]
    while work:
        place, key, value = work.pop()
        match value:
            case str():
                yield place, key, value
            case dict():
                work += reversed([(f"{place}.{k}" if place or isinstance(v, str) else str(k), str(k), v) for k, v in value.items()])
            case list():
                work += reversed([(f"{place}[{i}]", key, v) for i, v in enumerate(value) if in_lists or not isinstance(v, str)])


def parse(path: str, content: str):
    if path.lower().endswith(".json"):
        return json.loads(content)
    if yaml is None:
        raise ValueError("no YAML parser is installed")
    return yaml.safe_load(content)


def config_leaves(files: DataFrame, in_lists: bool = False) -> DataFrame:
    """String leaves of JSON and YAML files; one that does not parse gives a row with its error."""
    ship(files.sparkSession)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("leaf", pa.int32()), ("place", pa.string()), ("key", pa.string()), ("value", pa.string()), ("error", pa.string())])
        for batch in batches:
            out = []
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    document = parse(path, content or "")
                    found = [] if isinstance(document, str) else list(strings(document, in_lists))
                except Exception as e:  # noqa: BLE001  any parser error is a result here
                    out.append({"repo": repo, "path": path, "error": f"{type(e).__name__}"})
                    continue
                out += [{"repo": repo, "path": path, "leaf": i, "place": p, "key": k, "value": v} for i, (p, k, v) in enumerate(found)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in out], schema=schema)

    return files.select(F.col("repo").cast("string"), F.col("path").cast("string"), "content").mapInArrow(leaves, LEAVES)


def config_findings(files: DataFrame, in_lists: bool = False) -> DataFrame:
    """One finding for each dangerous word in the value of a telling key; the line is always 1."""
    telling = F.lower("key").isin(R.CONFIG_KEYS) | F.lower("key").contains("cmd")
    words = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(R.CONFIG_KEYWORDS)]), lambda x: F.contains(F.lower("value"), x["w"])))
    hits = config_leaves(files, in_lists).where(telling).select("*", words.alias("word"))
    text = F.concat(F.lit("capability '"), "word.w", F.lit("' is granted at "), "place", F.lit(" = "), "value")
    made = hits.withColumns({"seq": F.col("leaf").cast("long") * 10 + F.col("word.i"), "line": F.lit(1), "severity": F.lit("HIGH"), "category": F.lit("tool_permission"), "rule_id": F.lit("CFG-HIGH-0001"), "title": F.lit("Risky capability in a configuration"), "description": text, "code_context": F.concat("key", F.lit(": "), "value"), "tainted": F.lit(False), "confidence": F.lit(0.8)})
    return made.select(*FINDING_COLUMNS)
