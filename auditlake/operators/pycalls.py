"""Python calls: facts from the syntax tree, then rules, severities and notes as Columns.

Only the tree walk is Python (there is no parser in the engine); it emits one row
of facts for each named call, and everything after it is relational.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..schema import FINDING_COLUMNS, name_of, rank
from .matching import network_line_findings, pattern_obfuscation

#: Fixed values. Names that hold a user's input, and methods that read it.
SOURCES = {"input", "argv", "environ", "stdin", "request", "form", "args", "params", "query"}
READERS = {"get", "read", "readline", "recv"}
PROCESS = ["run", "call", "check_output", "check_call", "Popen"]
DELETERS = ["makedirs", "remove", "unlink", "rmdir"]

FACTS = "repo string, path string, seq long, line int, call string, base string, prefix string, module string, tainted boolean, constant boolean, shell boolean, listed boolean, first_constant boolean, command_tainted boolean, open_mode string, error string"


@dataclass
class Names:
    """What a walk knows at a node: names with a user's input, parameters in scope, and what imported names stand for."""

    tainted: set[str] = field(default_factory=set)
    parameters: frozenset[str] = frozenset()
    modules: dict[str, str] = field(default_factory=dict)

    def dirty(self, node) -> bool:
        """Whether an expression may hold a user's input; deliberately shallow."""
        match node:
            case ast.Name(id=name):
                return name in self.tainted or name in self.parameters or name in SOURCES
            case ast.Call(func=ast.Name(id=name)):
                return name in SOURCES
            case ast.Call(func=ast.Attribute(attr=name)):
                return name in READERS
            case ast.Subscript(value=ast.Name(id=name)):
                return name in self.tainted
            case ast.JoinedStr(values=parts):
                return any(self.dirty(p.value) for p in parts if isinstance(p, ast.FormattedValue))
        return False


def fixed(node) -> bool:
    """Whether an expression is made of constants alone."""
    match node:
        case ast.Constant():
            return True
        case ast.List(elts=parts) | ast.Tuple(elts=parts):
            return all(map(fixed, parts))
        case ast.Dict(keys=keys, values=values):
            return all(fixed(x) for x in [*keys, *values] if x is not None)
        case ast.JoinedStr(values=parts):
            return all(isinstance(p, ast.Constant) or (isinstance(p, ast.FormattedValue) and fixed(p.value)) for p in parts)
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant()):
            return True
    return False


def dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else None


def call_facts(node: ast.Call, call: str, names: Names) -> dict:
    base, head = call.rpartition(".")[2], call.split(".")[0] if "." in call else ""
    values = [*node.args, *[k.value for k in node.keywords]]
    first = node.args[0] if node.args else None
    modes = [*node.args[1:2], *[k.value for k in node.keywords if k.arg == "mode"]]
    mode = next((m for m in modes if isinstance(m, ast.Constant) and isinstance(m.value, str)), None)
    return {
        "line": node.lineno, "call": call, "base": base, "prefix": head, "module": names.modules.get(head, head),
        "tainted": any(map(names.dirty, values)), "constant": all(map(fixed, values)),
        "shell": any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords),
        "listed": isinstance(first, ast.List), "first_constant": isinstance(first, ast.List) and bool(first.elts) and isinstance(first.elts[0], ast.Constant),
        "command_tainted": first is not None and names.dirty(first), "open_mode": mode.value if mode else None,
    }


def walk(tree: ast.AST) -> Iterator[dict]:
    """Facts of each named call, in source order; one loop over a list of nodes to come, so depth does not matter.

    A set of names in that list ends a function: its outer parameters hold again.
    """
    names, work = Names(), [tree]
    while work:
        node = work.pop()
        if isinstance(node, frozenset):
            names.parameters = node
            continue
        if isinstance(node, ast.Call) and (call := dotted(node.func)):
            yield call_facts(node, call, names)
        elif isinstance(node, ast.Assign) and names.dirty(node.value):
            names.tainted |= {t.id for t in node.targets if isinstance(t, ast.Name)}
        elif isinstance(node, ast.Import):
            names.modules |= {a.asname or a.name: a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names.modules |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            work.append(names.parameters)
            names.parameters |= {a.arg for a in node.args.args}
        work += reversed(list(ast.iter_child_nodes(node)))


def calls_of(content: str) -> tuple[list[dict], str | None]:
    """Facts of each named call of a source, and the error of one that cannot be parsed."""
    rows: list[dict] = []
    try:
        for n, row in enumerate(walk(ast.parse(content))):
            rows.append({"seq": n, **row})
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return rows, f"{type(e).__name__}: {e}"
    return rows, None


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FACTS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FACTS.split(", ")])
    for batch in batches:
        out = []
        for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, error = calls_of(content or "")
            out += [{**r, "repo": repo, "path": path} for r in rows]
            if error:
                out.append({"repo": repo, "path": path, "error": error})
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=schema)


def python_calls(files: DataFrame) -> DataFrame:
    """Facts of every named call; a file that does not parse gives one row with its error."""
    from ..session import ship

    ship(files.sparkSession)
    return files.select(F.col("repo").cast("string"), F.col("path").cast("string"), "content").mapInArrow(_facts, FACTS)


def category(call: Column) -> Column:
    out = F.lit("other")
    for name, words in reversed(R.CALL_CATEGORIES.items()):
        found = F.lit(False)
        for w in words:
            found = found | call.contains(w)
        out = F.when(found, name).otherwise(out)
    return out


def severity_of_call(severity: Column) -> Column:
    """Severity of a matched call from its facts, the first branch that fits; then the bump for tainted arguments."""
    c = F.col
    process = c("base").isin(PROCESS)
    process_case = F.when(c("shell"), F.when(c("command_tainted"), "CRITICAL").otherwise("HIGH")).when(c("listed"), F.when(c("command_tainted"), "CRITICAL").when(c("first_constant"), "INFO").otherwise("LOW")).when(c("command_tainted"), "CRITICAL").otherwise(severity)
    mode = c("open_mode")
    open_case = F.when(mode.isNull() | mode.isin("r", "rb"), "INFO").when(mode.isin("w", "wb", "a", "ab"), F.when(c("tainted"), "HIGH").when(c("constant"), "LOW").otherwise("MEDIUM")).otherwise(severity)
    delete_case = F.when(c("constant") & ~c("tainted"), "INFO").when(~c("tainted"), "LOW").otherwise(severity)
    constant_case = F.when((severity == "CRITICAL") & ~c("base").isin("exec", "eval", "compile"), "MEDIUM").when(severity == "HIGH", "LOW").when(severity == "MEDIUM", "INFO").otherwise(severity)
    ladder = F.when(process, process_case).when(c("base") == "open", open_case).when(c("base").isin(DELETERS), delete_case).when(c("constant") & ~c("tainted"), constant_case).otherwise(severity)
    bump = c("tainted") & (~process | c("command_tainted")) & (rank(ladder) < 4)
    return F.when(bump, "HIGH").otherwise(ladder)


def python_findings(files: DataFrame) -> DataFrame:
    """Findings of Python files: calls by the rule tables, then network calls on lines without any."""
    facts = python_calls(files).where("error is null")
    own = files.select(F.col("repo").cast("string").alias("repo"), F.col("path").cast("string").alias("path"), T.lines(F.col("content")).alias("lines"))
    joined = facts.join(own, ["repo", "path"]).withColumn("text", F.try_element_at("lines", F.col("line")))
    tests = []
    for n, ((family, severity), (functions, modules)) in enumerate(R.CALL_NAMES.items()):
        patterns = [p for s, p in (R.CALL_PATTERNS if family == "danger" else R.NETWORK_PATTERNS) if s == severity]
        top = F.split("module", r"\.")[0]
        named = F.col("base").isin(functions) & ((F.col("prefix") == "") | (top.isin(modules) if modules else F.lit(False)))
        hit = named | F.coalesce(T.matches(F.col("text"), T.any_of(patterns)), F.lit(False))
        tests.append(F.when(hit, F.struct(F.lit(n).alias("n"), F.lit(family).alias("family"), F.lit(severity.upper()).alias("rule"))))
    hits = joined.withColumn("hit", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    hits = hits.withColumn("severity", severity_of_call(F.col("hit.rule")))
    note = F.concat(F.lit("call of "), "call", F.when(F.col("tainted"), " [input of a user]").when(F.col("constant"), " [constant arguments]").otherwise(""))
    identifier = T.rule_id("PY", F.col("hit.rule"), F.col("line"))
    confidence = F.when(F.col("tainted"), 0.9).when(F.col("constant"), 0.5).otherwise(0.7)
    found = hits.withColumns({"seq": F.col("seq") * 10 + F.col("hit.n"), "category": category(F.col("call")), "rule_id": identifier, "title": F.concat(F.lit("Dangerous call: "), "call", F.lit("()")), "description": note, "code_context": T.context(F.col("lines"), F.col("line")), "confidence": confidence}).select(*FINDING_COLUMNS)
    return found.unionByName(network_line_findings(files, found))


def python_obfuscation(files: DataFrame) -> DataFrame:
    """(repo, path, score): weights of calls by their literal name, and of whole-document patterns."""
    weights = F.create_map(*[F.lit(x) for pair in R.OBFUSCATION_CALLS.items() for x in pair])
    calls = python_calls(files).where("error is null").groupBy("repo", "path").agg(F.coalesce(F.sum(F.try_element_at(weights, F.col("call"))), F.lit(0.0)).alias("calls"))
    own = files.select(F.col("repo").cast("string").alias("repo"), F.col("path").cast("string").alias("path"), pattern_obfuscation(F.col("content")).alias("patterns"))
    return own.join(calls, ["repo", "path"], "left").select("repo", "path", F.round(F.col("patterns") + F.coalesce("calls", F.lit(0.0)), 6).alias("score"))


def legacy_calls(files: DataFrame) -> DataFrame:
    """Calls that the older scanner lists: a bare dangerous name or one of four modules' functions, aliases unresolved."""
    #: Fixed values.
    functions, modules = ["system", "run", "popen", "call", "exec", "eval", "open", "remove", "unlink"], ["os", "subprocess", "shutil", "sys"]
    bare = (F.col("prefix") == "") & F.col("base").isin(functions)
    dotted = F.col("prefix").isin(modules) & (F.col("call") == F.concat("prefix", F.lit("."), "base"))
    return python_calls(files).where("error is null").where(bare | dotted).select("repo", "path", "line", "call")


def safeguards(files: DataFrame) -> DataFrame:
    """(repo, path, kind, line): first line of each safeguard pattern in each file."""
    from .matching import line_hits

    hits = line_hits(files, [("INFO", kind, p) for kind, p in R.SAFEGUARDS])
    return hits.groupBy("repo", "path", "rule", F.col("name").alias("kind")).agg(F.min("line").alias("line")).drop("rule")


def annotate(findings: DataFrame, guards: DataFrame) -> DataFrame:
    """Findings with a note for each safeguard of their file that speaks about their category; severities stay."""
    about = F.create_map(*[x for kind, cats in R.SAFEGUARD_CATEGORIES.items() for x in (F.lit(kind), F.array(*[F.lit(c) for c in cats]))])
    notes = guards.withColumn("category", F.explode(about[F.col("kind")])).groupBy("repo", "path", "category").agg(F.array_sort(F.collect_set(F.struct("line", "kind"))).alias("notes"))
    text = F.array_join(F.transform("notes", lambda g: F.concat(F.lit(" [SAFEGUARD_DETECTED: "), g["kind"], F.lit(" at line "), g["line"].cast("string"), F.lit("]"))), "")
    return findings.join(notes, ["repo", "path", "category"], "left").withColumn("description", F.concat("description", F.coalesce(text, F.lit("")))).select(*FINDING_COLUMNS)


def strongest(findings: DataFrame) -> DataFrame:
    """(repo, findings, severity): the highest severity of each repository."""
    return findings.groupBy("repo").agg(F.count(F.lit(1)).alias("findings"), name_of(F.max(rank(F.col("severity")))).alias("severity"))
