"""Each stage of the pipeline against brute force on what the stage before it kept."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import decontam, toxicity

BLANKS = re.compile(r"[\x20\x09-\x0D]")


def corpus():
    rng = random.Random(11)
    plain = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(500)]
    bad = ["vile", "nasty", "awful", "rotten"]
    text = lambda n=90: " ".join(rng.choices(plain, k=n))
    items = [text(25) for _ in range(4)]
    rows = [text() for _ in range(160)]
    rows += [" ".join([text(40), *rng.choices(bad, k=3), text(40)]) for _ in range(60)]
    rows += [rows[i].replace(" ", "  ", 3) for i in range(8)] + rows[8:10]
    rows += [" ".join([*w[:40], "other", *w[41:]]) for w in (rows[i].split() for i in range(20, 28))]
    rows += [f"{text(20)} {items[i % 4].upper()} {text(20)}" for i in range(8)]
    rows += [None, "", " ", "word"]
    labels = [(i, int(160 <= i < 220)) for i in range(230)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], labels, list(enumerate(items))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept, at = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    scorer = toxicity.Scorer(model.ordinary, model.toxic)
    items = [decontam.canonical(t) for _, t in corpus()[2]]
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / f"{at}"))
        docs, at, before = spark.read.parquet(str(tmp_path / f"{at}")), at + 1, kept
        rows = docs.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
            continue
        kept = {r["doc_id"]: r["text"] for r in rows}
        assert docs.columns == names and len(rows) == len(kept) and all(before[i] == t for i, t in kept.items())
        if name == "toxicity":
            assert set(kept) == {i for i, t in before.items() if model.score(toxicity._excess(scorer.differences(toxicity.encode(t)), model.threshold)) < 0.7}
            assert sum(i in kept for i in range(160, 220)) <= 10 and all(i in kept for i in range(160))
        elif name == "exact dedup":
            best = {}
            for i, t in before.items():
                key = BLANKS.sub("", t or "")
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(t or ""), i))
            assert set(kept) == {i for _, i in best.values()}
        elif name == "SimHash near-dedup":
            sets = {i: shingles(t or "") for i, t in before.items()}
            alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(before), 2) if sets[a] & sets[b]}
            assert {b for (a, b), j in alike.items() if j > 0.84} == set(before) - set(kept)
            assert not any(0.76 < j <= 0.84 for j in alike.values())  # nothing near the threshold here
        else:
            held = {i for i, t in before.items() for item in items if decontam.Pattern(item).search(decontam.canonical(t))[0] <= decontam.budget(len(item))}
            assert held and set(kept) == set(before) - held
    assert corpus_pipeline.run(spark, tables).select("doc_id").distinct().count() == len(kept)


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_nulls_and_further_columns(spark, tables):
    base = spark.read.parquet(f"{tables}/documents.parquet").limit(40)
    odd = base.unionByName(base.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in base.dtypes])).withColumns({"id": F.lit(1), "print": F.lit("x"), "group": F.lit(None).cast("int")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, tables)
        assert out.count() >= 1
        if name != "packing":
            assert out.columns == odd.columns
