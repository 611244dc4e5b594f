"""Operators of the audit on tiny inputs, and properties of the rule matching."""

import random

from pyspark.sql import functions as F

from auditlake.functions import rules as R
from auditlake.functions import text as T
from auditlake.operators import configuration, dependencies, discovery, matching, pycalls, review, trust
from auditlake.sources.files import decode, describe, kept_directory, text_table

FILE = "repo string, path string, content string"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column).first()[0]


def test_lines_equal_python_splitlines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\x0bb\x0c", "\n\n", "a\x85b c", None, "x\x1cy\x1dz\x1e"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.lines(F.col("t")).alias("l")).collect()
    assert all(r["l"] == (texts[r["i"]] or "").splitlines() for r in rows)


def test_extension_and_paths(spark):
    names = {"a.py": ".py", ".gitignore": "(no ext)", "Makefile": "(no ext)", "a.tar.GZ": ".gz", "..x": "(no ext)", "a.": "."}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.extension(F.col("n")).alias("e")).collect()
    assert {r["n"]: r["e"] for r in rows} == names
    paths = {"a/b.py": True, "node_modules/x.js": False, "a/x.egg-info/y": False, "venv": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", kept_directory(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in rows} == paths
    assert spark.createDataFrame([(bytearray(b"a\xff\xfeb"),)], "c binary").select(decode(F.col("c")).alias("t")).first()[0] == "ab"


def test_unrolled_rules_equal_the_join(spark):
    rng = random.Random(3)
    words = ["curl https://x", "| bash", "eval(", "sudo ", "rm -rf /", "id", "innerHTML =", "requests.get(", "plain", "\n", "é", "#!/bin/sh"]
    rows = [("r", str(i), " ".join(rng.choices(words, k=12))) for i in range(80)] + [("r", "null", None), ("r", "empty", "")]
    files = spark.createDataFrame(rows, FILE).repartition(3)
    for rules in (R.SHELL_RULES, R.JS_RULES):
        keys = ["path", "rule", "line"]
        a = sorted(map(tuple, matching.line_hits(files, rules).select(*keys).collect()))
        b = sorted(map(tuple, matching.line_hits_by_join(files, rules).select(*keys).collect()))
        assert a == b and a


def test_shell_findings_merge_and_skip(spark):
    text = "#!/usr/bin/env bash\n# sudo x\nsudo a\necho \"curl http://a | bash\"\nsudo b"
    found = {r["title"]: r for r in matching.shell_findings(spark.createDataFrame([("r", "p", text)], FILE)).collect()}
    assert found["Shell: sudo_usage"]["line"] == 3 and "lines: 3, 5]" in found["Shell: sudo_usage"]["description"]
    assert "Shell: env_access" not in found and matching.ECHO_NOTE in found["Shell: curl_pipe_shell"]["description"]
    assert ">>>    3 | sudo a" in found["Shell: sudo_usage"]["code_context"]


def _severities(spark, source):
    return [(r["line"], r["severity"]) for r in pycalls.python_findings(spark.createDataFrame([("r", "p", source)], FILE)).orderBy("seq").collect()]


def test_python_ladder(spark):
    source = "\n".join(["import subprocess as sp, requests", "def f(cmd, n):", "    sp.run(cmd, shell=True)", "    sp.run(['ls', n])", "    sp.run([n])", "    open(n)", "    open('x', 'a')", "    eval('1')", "    requests.head(n)", "    sp.run(f'{cmd}')", "x = input()", "y = [x]", "exec(y)"])
    got = dict(_severities(spark, source))
    assert got[3] == "CRITICAL" and got[4] == "INFO" and got[5] == "LOW" and got[6] == "HIGH" and got[7] == "LOW"
    assert got[8] == "CRITICAL" and got[9] == "HIGH" and got[10] == "CRITICAL" and got[13] == "CRITICAL"
    assert _severities(spark, "def broken(:") == [] and _severities(spark, "") == []


def test_dependencies(spark):
    files = describe(spark.createDataFrame([("r", "requirements.txt", "colourama\njellyfish[x]>=1\n# c\n\nrequests"), ("r", "package.json", '{"dependencies":{"RC":"1"},"scripts":{"a":"rm -rf /"}}'), ("s", "package.json", "[1]"), ("t", "package.json", '{"dependencies":null,"scripts":{"a":3}}')], FILE))
    got = sorted((r["repo"], r["type"], r["package"]) for r in dependencies.dependency_issues(files).collect())
    assert got == [("r", "known_malicious", "RC"), ("r", "known_malicious", "colourama"), ("r", "suspicious_script", "a"), ("r", "typo_squatting_suspect", "jellyfish")]


def test_configuration(spark):
    files = spark.createDataFrame([("r", "a.json", '{"tool":{"command":"bash -c"},"permissions":["shell"],"x":[{"name":"execute"}]}'), ("r", "b.json", "{"), ("r", "c.json", "3")], FILE)
    got = sorted(r["description"] for r in configuration.config_findings(files).collect())
    assert len(got) == 2 and any("tool.command" in x for x in got) and any("x[0].name" in x for x in got)
    assert configuration.config_findings(files, in_lists=True).count() == 3


def test_consensus_of_unknowns(spark):
    rows = [(1, "a", "UNKNOWN", 0.5, False, False, "x"), (1, "b", "UNKNOWN", 0.5, False, False, None), (2, "a", "HIGH", 0.9, True, False, "y"), (2, "b", "SAFE", 0.5, True, False, "z")]
    v = spark.createDataFrame(rows, "review int, role string, severity string, confidence double, malicious boolean, gray boolean, summary string")
    fixed = {r["review"]: r["final_severity"] for r in review.consensus(v).collect()}
    assert fixed == {1: "UNKNOWN", 2: "MEDIUM"}
    assert {r["review"]: r["final_severity"] for r in review.consensus(v, compat=True).collect()}[1] == "SAFE"


def test_risk_policy(spark):
    rows = [("PARTIAL — core language (Go) not analyzed", "DO_NOT_USE", "CRITICAL (PARTIAL — core language (Go) not analyzed)"), ("LOW (PARTIAL)", "VERIFY_BEFORE_USE", "MEDIUM (PARTIAL)"), ("EMPTY_REPO", "DO_NOT_USE", "EMPTY_REPO"), ("HIGH", "VERIFY_BEFORE_USE", "HIGH"), ("SAFE", None, "SAFE")]
    df = spark.createDataFrame(rows, "risk string, verdict string, want string")
    assert all(r[0] == r[1] for r in df.select(review.trust_override(F.col("risk"), F.col("verdict")), "want").collect())


def test_downgrade_order(spark):
    reviews = spark.createDataFrame([("r", 1, "CRITICAL", "uses github here"), ("r", 2, "HIGH", "x"), ("r", 3, "LOW", "github")], "repo string, id long, severity string, text string")
    a = spark.createDataFrame([("r", 0, "api.github.com", True, 0.9, []), ("r", 1, "a", True, 0.9, [2]), ("r", 2, "b", True, 0.9, [2]), ("r", 3, "c", None, 0.9, [1])], "repo string, pos int, subject string, verified boolean, confidence double, risk_ids array<long>")
    got = {r["id"]: (r["subject"], r["new_severity"]) for r in trust.downgrade(reviews, a).collect()}
    assert got == {1: ("api.github.com", "HIGH"), 2: ("b", "MEDIUM"), 3: (None, "LOW")}


def test_stream_equals_batch(spark, tmp_path):
    from auditlake.streaming.index import current, upsert_stream

    for i in range(3):
        spark.createDataFrame([(k, i * 10 + k) for k in range(i, i + 4)], "k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(tmp_path / "index"), str(tmp_path / "ck"), ["k"], ["v"]).awaitTermination()
    batch = discovery.latest(spark.read.parquet(str(tmp_path / "in")), ["k"], ["v"])
    assert sorted(map(tuple, current(spark, str(tmp_path / "index")).collect())) == sorted(map(tuple, batch.collect()))
    kept = list((tmp_path / "index").glob("v*/bucket=*"))
    assert len({p.name for p in kept}) >= 2 and all(sum(p.name == q.name for q in kept) <= 2 for p in kept)


def test_context_of_repository(spark):
    files = text_table(spark.createDataFrame([("r", "README.md", "readme"), ("r", "SKILL.md", "skill"), ("s", "x.py", "1")], FILE), "repo", "path", "content")
    got = {r["repo"]: r["context"] for r in discovery.skill_context(files).collect()}
    assert got["r"] == "readme\n\nskill" and got["s"].startswith("No skill documentation")
    files = text_table(spark.createDataFrame([("r", "a/SKILL.md", "one"), ("r", "bb/skill.md", "two"), ("r", "ccc/SKILL.md", "three"), ("s", "README.md", "readme"), ("s", "a/SKILL.md", "one"), ("s", "bb/SKILL.md", "two")], FILE), "repo", "path", "content")
    assert {r["repo"]: r["context"] for r in discovery.skill_context(files).collect()} == {"r": "one\n\ntwo", "s": "readme\n\none"}


def test_command_line_outputs(spark, tmp_path):
    from auditlake.plans.audit import audit
    from auditlake.sources.files import read_repositories
    from auditlake.sources.sinks import save_audit

    (tmp_path / "in" / "r").mkdir(parents=True)
    (tmp_path / "in" / "r" / "a.sh").write_text("#!/bin/bash\nsudo ls\n")
    made = audit(read_repositories(spark, str(tmp_path / "in")))
    save_audit(made, spark.createDataFrame([("r", "me", "0123456789abcdef")], "repo string, owner string, commit string"), str(tmp_path / "out"))
    written = list((tmp_path / "out" / "reports" / "owner=me" / "repo=r" / "commit12=0123456789ab").glob("*.txt"))
    assert written and "HIGH" in written[0].read_text()
    assert spark.read.json(str(tmp_path / "out" / "meta")).first()["risk"] == "HIGH"


def test_audit_queries_have_no_file_cap(spark, tmp_path):
    """Every file of a repository is analysed, not its first 300."""
    from auditlake.queries import QUERIES

    rows = [(i, "echo hello", "en", "a", 10) for i in range(320)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["audit_repositories"](spark, str(tmp_path)).collect()
    assert sum(r["files_walked"] for r in got) >= 320
    assert len(QUERIES["audit_report"](spark, str(tmp_path)).collect()) == len(got)


def _one_source(spark, folder, n=1480):
    """n documents of one source, 40 for each snippet."""
    spark.createDataFrame([(i, "echo hello", "en", "a", 10) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_analyzed_counts_have_no_cap(spark, tmp_path):
    """Every file counts by its analyzer, and none is too large."""
    from auditlake.operators import classify
    from auditlake.queries import QUERIES

    folder = _one_source(spark, tmp_path)
    got = {r["language"]: r["files"] for r in QUERIES["analyzed_counts"](spark, folder).collect()}
    assert got == {"dependency": 80, "javascript": 40, "python": 80, "shell": 120, "skill_prompt": 40, "tool_config": 40}
    row = QUERIES["coverage"](spark, folder).first()
    assert (row["code_files_analyzed"], row["prompts"]) == (320, 40)
    large = text_table(spark.createDataFrame([("r", "a.py", "#" * 600_000)], FILE), "repo", "path", "content")
    assert classify.language_counts(classify.classified(large, None, None)).count() == 1


def test_file_type_counts_have_no_cap(spark, tmp_path):
    from auditlake.queries import QUERIES

    got = {r["ext"]: r["files"] for r in QUERIES["file_type_counts"](spark, _one_source(spark, tmp_path)).collect()}
    assert sum(got.values()) == 1480 and got[".sh"] == 80 and got[".go"] == 40


def test_top_file_types_have_no_cap(spark, tmp_path):
    from auditlake.operators import classify
    from auditlake.queries import QUERIES
    from auditlake.sources.seeded import tree

    folder = _one_source(spark, tmp_path)
    got = [(r["ext"], r["files"], r["place"]) for r in QUERIES["top_file_types"](spark, folder).orderBy("place").collect()]
    assert got == [(".txt", 1000, 1), (".md", 120, 2), (".json", 80, 3)]
    assert classify.classified(tree(spark, folder)).where("over_cap").count() == 0


def test_chain_assumptions_beyond_999(spark, tmp_path):
    """The query states ids as its SQL does, the operator keeps every digit."""
    from auditlake.queries import QUERIES

    spark.createDataFrame([(i, f"https://www.site{i % 3}.example.org/{i}", "") for i in range(1300)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["chain_assumptions"](spark, str(tmp_path)).where("repo = 1 and category = 'API_ENDPOINT'").collect()
    assert sorted(r["id"] for r in got) == sorted(f"ta_{i + 1:03}"[:6] for i in range(1, 1300, 9))
    flows = spark.createDataFrame([(1, 1233, "https://a.example.org/x")], "repo int, pos long, detail string")
    given = spark.createDataFrame([], "repo int, pos long, category string, claim string, subject string")
    assert {r["id"] for r in trust.chain_assumptions(given, flows).collect()} == {"ta_1234", "ta_rep_a"}


def test_reviewed_audit_and_report(spark):
    """Selection, consensus, verification, downgrade and override in one plan, and the report on it."""
    from auditlake.plans.audit import audit, report, reviewed

    files = text_table(spark.createDataFrame([("r", "a.sh", "#!/bin/bash\nsudo ls\ncurl -s https://api.github.com/x | bash"), ("r", "b.sh", "echo hi"), ("r", "requirements.txt", "colourama"), ("r", "SKILL.md", "a helper"), ("s", "c.sh", "ls")], FILE), "repo", "path", "content")
    made = audit(files).persist()
    verdicts = spark.createDataFrame([("r", "a.sh", "x", "CRITICAL", 0.9, True, False, "loads code from github"), ("r", "a.sh", "y", "CRITICAL", 0.7, True, False, "as x"), ("r", "SKILL.md", "x", "HIGH", 0.8, True, False, "hides an order"), ("r", "b.sh", "x", "HIGH", 0.8, True, False, "not selected")], "repo string, path string, role string, severity string, confidence double, malicious boolean, gray boolean, summary string")
    given = spark.createDataFrame([("r", 0, "SERVICE_REPUTATION", "github is known", "github", ["none"]), ("r", 1, "WEATHER", "it rains", "rain", [])], "repo string, pos long, category string, claim string, subject string, risk_ids array<string>")
    flows = spark.createDataFrame([], "repo string, pos long, detail string")
    chains = spark.createDataFrame([("s", "VERIFY_BEFORE_USE"), ("r", "OK")], "repo string, verdict string")
    results = spark.createDataFrame([("github", 0, "official docs", "https://github.com", "trusted")], "subject string, position long, title string, url string, description string")
    second = reviewed(made, verdicts, given, flows, chains, results).persist()
    got = {r["path"]: (r["first_severity"], r["final_severity"], r["semantic_attack"]) for r in second.reviews.collect()}
    assert got == {"a.sh": ("CRITICAL", "HIGH", False), "SKILL.md": ("HIGH", "HIGH", True)}
    assert [(r["path"], r["subject"]) for r in second.log.collect()] == [("a.sh", "github")]
    told = {r["id"]: (r["verified"], r["downgrade_applied"], len(r["evidence"])) for r in second.assumptions.collect()}
    assert told == {"ta_001": (True, True, 1), "ta_002": (None, False, 0)}
    risks = {r["repo"]: (r["risk"], r["confirmed"], r["inconclusive"]) for r in second.repositories.collect()}
    assert risks == {"r": ("CRITICAL", 1, 1), "s": ("MEDIUM", 0, 0)}
    assert [r["path"] for r in second.scenarios.collect()] == ["a.sh"]
    texts = {r["repo"]: r["report"] for r in report(made, second).collect()}
    for part in ("## Findings", "## Dependencies", "colourama is on the list", "lowered from CRITICAL because of github", "github is known: confirmed", "it rains: open", "Trust: OK"):
        assert part in texts["r"], part
    plain = {r["repo"]: r["report"] for r in report(made, limit=1).collect()}
    assert "more are in the table of findings" in plain["r"] and "No review took part" in plain["s"]


def test_report_matches_files_once(spark, tmp_path):
    """Counts and lists of a report share one pass over the findings, whose lists are cut and ordered over all shares of a repository."""
    from auditlake.plans.audit import audit, report
    from auditlake.queries import QUERIES

    made = QUERIES["audit_report"](spark, _one_source(spark, tmp_path, 40))._jdf.queryExecution()
    assert len(made.executedPlan().toString()) < 400_000  # filters do not spell out language and content
    assert made.optimizedPlan().collectLeaves().size() <= 16  # files are read for each analyzer, not again for each part of the report
    pruned = matching.prompt_findings(text_table(spark.read.parquet(f"{tmp_path}/documents.parquet"), "source", "doc_id", "text")).select("repo", "severity")
    assert pruned._jdf.queryExecution().optimizedPlan().toString().count("filter(array(CASE") <= 2
    files = text_table(spark.createDataFrame([("r", f"{i:02}.sh", "sudo ls" if i % 2 else "chmod +x a") for i in range(40)] + [("r", "requirements.txt", "colourama"), ("s", "a.txt", "-")], FILE), "repo", "path", "content")
    reviews = spark.createDataFrame([("r", "LOW", 0.8), ("s", "LOW", 0.8), ("s", "UNKNOWN", 0.1)], "repo string, final_severity string, final_confidence double")
    made = audit(files, reviews)
    got = {r["repo"]: r["report"] for r in report(made, limit=5).collect()}
    assert [x for x in got["r"].split("\n") if "Shell:" in x] == [f"{n}. **HIGH** Shell: sudo_usage ({2 * n - 1:02}.sh:1)" for n in range(1, 6)]
    assert "35 more are in the table" in got["r"] and "colourama is on the list" in got["r"] and "## Findings\n\nnone" in got["s"]
    want = {r["repo"]: [r[s] for s in ("critical", "high", "medium", "low")] for r in made.repositories.collect()}
    assert want == {"r": [1, 20, 20, 1], "s": [0, 0, 0, 1]}
    assert all(f"| {s} | {n} |" in got[k] for k, v in want.items() for s, n in zip(("CRITICAL", "HIGH", "MEDIUM", "LOW"), v, strict=True))


def test_evidence_of_assumptions(spark):
    rows = spark.createDataFrame([("API_ENDPOINT", "api.1inch.dev", "c"), ("API_ENDPOINT", "evil.1inch.xyz", "c"), ("API_ENDPOINT", "example.org", "c"), ("CONTRACT_ADDRESS", "0xAB", "Router of Acme"), (None, "x", None)], "category string, subject string, claim string")
    results = spark.createDataFrame([("0xAB", 0, "t", "https://etherscan.io/0xab", "d"), ("0xAB", 1, "0xab", "https://z.io", None), ("api.1inch.dev", 0, "about api.1inch.dev", "https://1inch.dev/x", "d")], "subject string, position long, title string, url string, description string")
    got = {r["subject"]: (r["verified"], [e["weight"] for e in r["evidence"]]) for r in trust.verify(rows, results).collect()}
    assert got == {"api.1inch.dev": (True, ["strong", "strong"]), "evil.1inch.xyz": (False, ["negative"]), "example.org": (True, ["informational"]), "0xAB": (True, ["strong", "moderate"]), "x": (None, [])}


def test_yaml_configuration(spark):
    files = spark.createDataFrame([("r", "a.yaml", "tool:\n  command: bash -c x\nlist:\n  - cmd: shell\n"), ("r", "b.yml", "a: [")], FILE)
    if configuration.yaml is None:
        assert configuration.config_leaves(files).where("error is null").count() == 0
    else:
        places = {r["description"].split(" is granted at ")[1].split(" = ")[0] for r in configuration.config_findings(files).collect()}
        assert places == {"tool.command", "list[0].cmd"} and configuration.config_leaves(files).where("error is not null").count() == 1


def test_calls_of_deep_sources():
    """The walk does not depend on depth: scopes end, and a long chain of sums is no error."""
    rows, error = pycalls.calls_of("x = " + " + ".join(["f(a)"] * 400) + "\ndef g(a):\n    h(a)\nh(a)")
    assert error is None and [r["tainted"] for r in rows if r["call"] == "h"] == [True, False] and len(rows) == 402
    assert pycalls.calls_of("a = (")[1].startswith("SyntaxError")


def test_read_repositories(spark, tmp_path):
    """Roots with special characters and repeated names, large and pruned files, malformed and genuine replacement characters."""
    from auditlake.operators import classify
    from auditlake.sources.files import MAX_BYTES, read_repositories

    root = tmp_path / "repos" / "y+(1)" / "repos"
    for name, data in {"a/x.sh": b"ls\xff\n", "a/repos/y.md": "\ufffd".encode(), "a/node_modules/z.js": b"1", "b/big.py": b"#" * (MAX_BYTES + 1)}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {(r["repo"], r["path"]): r["content"] for r in read_repositories(spark, str(root)).collect()}
    assert got == {("a", "x.sh"): "ls\n", ("a", "repos/y.md"): "\ufffd", ("b", "big.py"): None}
    stats = {r["repo"]: r["skipped_size"] for r in classify.walk_stats(classify.classified(read_repositories(spark, str(root)))).collect()}
    assert stats == {"a": 0, "b": 1}


def test_legacy_report(spark):
    from auditlake.operators import legacy

    sources = {"a.py": "import os\nos.system(x)\nopen(y)\nos.path.open(z)", "b.py": "eval(a)\nexec(b)\ngetattr(c, d)", "c.py": "def (", "d.ts": "fetch('x')\naxios.get(y)", "e.js": "eval(1)" * 4, "f.go": "eval(1)"}
    files = text_table(spark.createDataFrame([("r", p, t) for p, t in sources.items()] + [("s", "g.py", "1")], FILE), "repo", "path", "content")
    got = {r["path"]: (r["obfuscated"], r["types"], r["lines"]) for r in legacy.legacy_report(files).collect()}
    assert got == {"a.py": (False, ["open", "os.system"], [2, 3]), "b.py": (True, [], []), "d.ts": (False, ["network"], [1, 2]), "e.js": (True, [], [])}
    texts = {r["repo"]: r["report"] for r in legacy.legacy_json(files).collect()}
    assert texts["s"] == '[{"status":"safe"}]' and texts["r"].startswith('[{"path":"a.py","obfuscated":false,"types":["open","os.system"]')


def test_fixtures_without_an_audit(spark):
    truths = spark.createDataFrame([("a", "TRUE_POSITIVE"), ("b", "TRUE_POSITIVE"), ("c", "TRUE_NEGATIVE"), ("d", "GRAY_AREA")], "fixture string, category string")
    results = spark.createDataFrame([("a", "HIGH", 2), ("c", "MEDIUM", 0)], "fixture string, risk string, findings int")
    assert tuple(review.fixture_rates(review.judged_fixtures(truths, results)).first()) == (1.0, 1.0, 0.0, 2)


def test_command_line_modes(spark, tmp_path):
    from auditlake.__main__ import options_of, run

    for name, text in {"r/a.sh": "#!/bin/bash\nsudo ls\n", "r/README.md": "https://github.com/acme/tool", "s/b.py": "import os\nos.system(x)\n"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "said" / "chains").mkdir(parents=True)
    (tmp_path / "said" / "chains" / "x.json").write_text('{"repo":"r","verdict":"DO_NOT_USE"}')
    base = [str(tmp_path / "in"), "--output", str(tmp_path / "out")]
    run(spark, options_of([*base, "--discover-only"]))
    assert spark.read.json(str(tmp_path / "out" / "skills")).first()["owner"] == "acme" and spark.read.json(str(tmp_path / "out" / "totals")).count() == 2
    run(spark, options_of([*base, "--legacy"]))
    assert spark.read.json(str(tmp_path / "out" / "legacy")).count() == 2
    summary = run(spark, options_of([*base, "--name", "r", "--owner", "me", "--said", str(tmp_path / "said"), "--max-files", "0"]))
    assert [(r["status"], r["repositories"], r["highest"]) for r in summary.collect()] == [("completed", 1, "CRITICAL")]
    assert list((tmp_path / "out" / "reports" / "owner=me" / "repo=r").glob("commit12=latest/*.txt"))
