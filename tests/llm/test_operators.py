"""Each operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import chat, common, components, decontam, exact, html, language, packing, repeats, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string, `group` string"


def docs(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    full = [(i, t, lang, source, len(t or ""), 7, "x", None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "été", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "bb", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n\t") + " ", "en", "a") for i in range(10)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \n", "en", "a"), (None, "alpha", "en", "a"), (203, "y" * 70000 + " z", "fr", "b"), rows[0], rows[0]]
    return rows


def test_sharding(spark, sample):
    got = sharding.hilbert_shards(docs(spark, sample), 4).collect()
    assert len(got) == len(sample) and {r["law"] for r in got} == {"rows"}
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in sample)
    assert want == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got)
    assert sharding.hilbert_shards(docs(spark, []), 4).count() == 0


def test_hilbert_curve_is_continuous(spark):
    cells = spark.createDataFrame(list(itertools.product(range(4), repeat=3)), "a int, b int, c int")
    order = [tuple(r)[:3] for r in sharding.hilbert_index(cells, ["a", "b", "c"], 2, "h").orderBy("h").collect()]
    assert len(set(order)) == 64 and all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def test_toxicity():
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    bad = ["vile", "nasty", "awful"]
    make = lambda toxic: " ".join(rng.choices(plain, k=40) + (rng.choices(bad, k=4) if toxic else []))
    model = toxicity.fit([(make(k % 4 == 0), int(k % 4 == 0)) for k in range(400)])
    scorer = toxicity.Scorer(model.ordinary, model.toxic)
    score = lambda t: model.score(toxicity._excess(scorer.differences(toxicity.encode(t)), model.threshold))
    held = [(make(k % 2), k % 2) for k in range(200)]
    assert sum((score(t) >= 0.7) == bool(y) for t, y in held) >= 195
    assert score("") < 0.5 and score(None) == score("") and toxicity.fit([]) is None and toxicity.fit([("a", 0)]) is None


def test_toxicity_of_words_seen_in_ordinary_text():
    """A quotation or a wrong label does not take a telling word out of the dictionary."""
    rng = random.Random(6)
    plain = [f"w{''.join(rng.choices('abcdefgh', k=5))}" for _ in range(300)]
    bad = ["vile", "nasty", "awful"]
    make = lambda toxic: " ".join(rng.choices(plain, k=40) + (rng.choices(bad, k=4) if toxic else []))
    fitted = [(make(k % 4 == 0), int(k % 4 == 0)) for k in range(800)] + [(make(0) + " " + " ".join(bad), 0) for _ in range(3)]
    rng.shuffle(fitted)
    model = toxicity.fit(fitted)
    scorer = toxicity.Scorer(model.ordinary, model.toxic)
    held = [(make(k % 2), k % 2) for k in range(200)]
    assert sum((model.score(toxicity._excess(scorer.differences(toxicity.encode(t)), model.threshold)) >= 0.7) == bool(y) for t, y in held) >= 195


def test_toxicity_rows(spark, sample):
    rows = docs(spark, sample)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(rows, toxicity.fit_toxicity(rows, labels)).collect()
    assert len(got) == len(sample) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert toxicity.drop_toxic(rows, labels.limit(0)).count() == len(sample)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(60):
        item, text = ("".join(rng.choices("ab c", k=rng.randint(1, n))) for n in (9, 25))
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            above, row = row, [i]
            for j, b in enumerate(text, 1):
                row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a != b)))
        assert decontam.Pattern(item).search(text) == (min(row), row.index(min(row)))


def test_decontamination(spark):
    rng = random.Random(4)
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(30))
    edited = item[:20] + item[22:60] + "zz" + item[60:]
    broken = " ".join(w[::-1] for w in item.split())
    rows = [(1, "x " + item.upper().replace(" ", "\n") + " y", "en", "a"), (2, "pre " + edited, "en", "a"), (3, broken, "en", "a"), (4, None, None, None), (5, "", "en", "a"), (6, item[: len(item) // 2], "en", "a"), (None, item, "en", "a")]
    items = spark.createDataFrame([(10, item), (11, None), (12, " .,"), (13, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contamination(docs(spark, rows), items).collect()}
    assert got == {(1, 10): 0, (2, 10): 4, (None, 10): 0}
    assert {r["doc_id"] for r in decontam.decontaminate(docs(spark, rows), items).collect()} == {3, 4, 5, 6}
    assert decontam.contamination(docs(spark, rows), items.limit(0)).count() == 0


def test_packing(spark, sample):
    from tokenizers import Tokenizer
    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in sample if r[0] is not None] + [(300, "a<|endoftext|>b", "en", "a")]
    got = packing.pack_documents(docs(spark, rows), 16).collect()
    texts = {i: t or "" for i, t, *_ in rows}
    for i in texts:
        ids = np.array(model.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        copies = sum(r[0] == i for r in rows)
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        want = [(a, len(ids[a : a + 16]), zlib.crc32(ids[a : a + 16].tobytes())) for a in range(0, len(ids), 16)]
        assert pieces == sorted(want * copies)
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 16
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 33, 300)
    where, offset = packing.best_fit_decreasing(lengths, 32)
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in free if c >= lengths[i]]
        assert 32 - offset[i] == (min(fits) if fits else 32)
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 32) - lengths[i])
    assert where.max() + 1 == len(free)


def test_exact(spark, sample):
    rows = [r for r in sample if r[0] is not None]
    got = sorted(map(tuple, exact.exact_groups(docs(spark, rows)).collect()))
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = []
    for i, t, *_ in rows:
        group = [(-len(u or ""), j) for j, u, *_ in rows if strip(u) == strip(t)]
        keep = min(group)[1]
        want.append((i, keep, len(group), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    assert got == sorted(want)
    assert exact.exact_groups(docs(spark, [])).count() == 0
    kept = exact.exact_dedup(docs(spark, rows))
    assert kept.count() == len({strip(t) for _, t, *_ in rows}) and kept.columns == docs(spark, []).columns


def test_collisions_are_told_apart(spark):
    rows = [(1, "ab", "en", "a"), (2, "cd", "en", "a"), (3, "a b", "en", "a"), (4, "abc", "en", "a")]
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(docs(spark, rows), hasher=lambda data: 5).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 4}


def test_fingerprints_compose():
    rng = random.Random(0)
    data = bytes(rng.randrange(256) for _ in range(5000))
    for cut in (0, 1, 999, 5000):
        a, b = data[:cut], data[cut:]
        assert exact.combine(exact.chunk_hash(a), exact.chunk_hash(b), len(b)) == exact.chunk_hash(data)
    assert len({exact.fingerprint(data, c) for c in (7, 64, 4096, exact.CHUNK)}) == 1


def test_language(spark):
    rng = random.Random(3)
    en, de = ["the", "and", "with", "house", "thing"], ["der", "und", "mit", "häuser", "schön"]
    text = lambda w, n=30: " ".join(rng.choices(w, k=n))
    rows = [(i, text(en if i % 2 else de), "en" if i % 2 else "de", "a") for i in range(200)]
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "12 ?!", None, "a"), (503, text(en, 20) + " " + text(de, 60), None, "a"), (504, "привет мир", None, "a")]
    frame = docs(spark, rows)
    model = language.fit_language(frame)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(200))
    assert all(got[i] == ("und", 0.0) for i in (500, 501, 502)) and got[503][0] == "de" and 0.5 < got[503][1] < 1
    assert [x[2] for x in language.spans(model, rows[203][1])] == ["en", "de"]
    assert language.fit_language(docs(spark, [])) is None
    assert language.identify(frame, None).where("lang_pred <> 'und'").count() == 0


def test_viterbi():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 3, 5, 1, 4])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    labels, at = language.viterbi(scores, lengths, 2.0), 0
    value = lambda path, a: sum(scores[a + i, s] for i, s in enumerate(path)) - 2 * sum(x != y for x, y in zip(path, path[1:]))
    for n in lengths:
        assert value(labels[at : at + n].tolist(), at) == pytest.approx(max(value(p, at) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)
        at += n


def page(title, body, links=("a", "b")):
    return f"<html><head><title>{title}</title><script>x='<p>no</p>'</script></head><body><nav>{''.join(f'<a href=#>{x}</a>' for x in links)}</nav><div class='cookie-notice'>We use cookies</div><article><h1>{title}</h1>{body}<p>Share this story</p></article><section class='comments'><p>me too</p></section><footer>&copy; x</footer>"


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", page(f"T{i}", f"<p>one{i}  &amp; two{i}<p>three{i} four{i} <b>five{i}</b> six{i} seven{i}")) for i in range(9)]
    rows += [(20, "http://solo.example/", page("S", "<p>alone here</p>")), (21, None, None), (22, "x", ""), (23, "http://u.example", "<p>plain &lt;b&gt;<br>text</p>"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    got = {r["page_id"]: r for r in html.main_text(frame).collect()}
    assert html.main_text(frame).count() == len(rows)
    assert all(got[i]["text"] == f"T{i}\none{i} & two{i}\nthree{i} four{i} five{i} six{i} seven{i}" for i in range(9))
    assert got[20]["text"].startswith("S\nalone here") and got[21]["text"] == got[22]["text"] == ""
    assert got[23]["text"] == "plain <b>\ntext" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.main_text(frame.limit(0)).count() == 0


def reach(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts_of(make, n=9):
    return html._group_texts([make(i) for i in range(n)])


def test_small_slots_of_the_article_stay():
    """A headline that is a link, and a headline, a byline and a lead outside any article element."""
    body = lambda i: "".join(f"<p>{' '.join(f'w{i}x{k}y{j}' for j in range(20))}</p>" for k in range(3 + i % 3))
    words = lambda i: [f"w{i}x{k}y{j}" for k in range(3 + i % 3) for j in range(20)]
    menu = "<ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul>"
    top = "<html><body><div id=top><a href=/>Site</a></div>"
    linked = texts_of(lambda i: f"{top}<article><h1><a href=/{i}>Title{i} here{i}</a></h1>{body(i)}</article></body></html>")
    assert [t.split() for t in linked] == [[f"Title{i}", f"here{i}", *words(i)] for i in range(9)]
    for title in ("Title{0}", "<a href=/{0}>Title{0}</a>"):
        plain = texts_of(lambda i: f"{top}{menu}<div id=content><h1>{title.format(i)}</h1><p class=byline>By{i}</p>{body(i)}</div><div id=end>end{i}</div></body></html>")
        assert [t.split() for t in plain] == [[f"Title{i}", f"By{i}", *words(i)] for i in range(9)]


@pytest.mark.parametrize("frame", ["<div class='overflow-hidden'><article>{}</article></div>", "<main class='has-sidebar'>{}</main>", "<article class='post no-comments'>{}</article>", "<div id=page class='with-nav'><div class=text>{}</div></div>", "<div class='sidebar'><main>{}</main></div>", "<article><div class='entry-header'>{}</div></article>", "<div class='hidden'>{}</div>"])
def test_names_do_not_drop_the_article(frame):
    texts = texts_of(lambda i: f"<html><body><nav>menu</nav>{frame.format(f'<h1>T{i}</h1><p>one{i} two{i}</p><p>three{i}</p>')}<footer>end</footer></body></html>")
    assert [t.split() for t in texts] == [[f"T{i}", f"one{i}", f"two{i}", f"three{i}"] for i in range(9)]


def test_names_drop_what_is_around_the_article():
    for name in ("sidebar", "cookie-notice", "comments-area", "related_posts", "main-nav", "site-header", "post-navigation"):
        texts = texts_of(lambda i: f"<html><body><article><p>one{i} two{i}</p><p>three{i}</p></article><div class='{name}'><p>more{i} of{i} this{i}</p></div></body></html>")
        assert [t.split() for t in texts] == [[f"one{i}", f"two{i}", f"three{i}"] for i in range(9)]


@pytest.mark.parametrize(("words", "radius", "frontier"), [(1, 3, 1 << 12), (1, 3, 1 << 20), (3, 20, 1 << 12)])
def test_gray_index(monkeypatch, words, radius, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(words)
    prints = rng.integers(0, 2**63, (20, words)).astype(np.uint64)[rng.integers(0, 20, 600)]
    for row in prints:
        for bit in rng.integers(0, 64 * words, rng.integers(0, 7 * words)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    prints, groups = np.unique(prints, axis=0), None
    groups = rng.integers(0, 3, len(prints))
    got = simhash.GrayIndex(groups, prints).links(radius)
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if groups[i] == groups[j] and np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius]
    assert reach(len(prints), near) == reach(len(prints), list(enumerate(got)))


def test_simhash(spark, sample, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # every band value is cut into blocks
    import xxhash

    rows = [r for r in sample if r[0] is not None]

    def one(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted({r[0] for r in rows})
    prints = {i: one(t) for i, t, *_ in rows}
    root = reach(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3])
    want = {i: (f"{prints[i]:016x}", ids[root[n]]) for n, i in enumerate(ids)}
    got = simhash.simhash_components(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(want[r["doc_id"]] == (r["fingerprint"], r["component_id"]) for r in got)
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_near_dedup(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    other = ["".join(rng.choices("klmnop", k=5)) for _ in range(400)]
    half = base[:200] + other[200:]
    rows = [(i, " ".join(w), "en", "a") for i, w in enumerate((base, near, other, half))] + [(9, None, None, None), (10, "", "en", "a"), (None, "q", "en", "a")]
    kept = simhash.near_dedup(docs(spark, rows))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (False, 9), (True, None)]
    assert kept.columns == docs(spark, []).columns


@pytest.mark.parametrize("block", [4096, 4])
def test_near_groups_at_the_similarity(spark, monkeypatch, block):
    """Pairs at 0.75 to 0.85, short and long ones, and a chain: the links are those of the exact similarity."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "COMPARE", block)
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for size, edits in [(n, e) for n in (24, 60, 150, 400) for e in range(1, 11)] + [(400, e) for e in range(11, 19)]:
        base = [word() for _ in range(size)]
        near = list(base)
        for at in rng.sample(range(0, size, 5), min(edits, size // 5)):
            near[at] = word()
        texts += [base, near]
    chain = [word() for _ in range(200)]
    for at in range(0, 120, 10):
        chain = [*chain[:at], word(), *chain[at + 1 :]]
        texts.append(chain)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] & sets[b]}
    assert sum(0.75 <= j < 0.8 for j in alike.values()) >= 5 and sum(0.8 <= j <= 0.85 for j in alike.values()) >= 5
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == reach(len(texts), [p for p, j in alike.items() if j >= 0.8])


def test_similar_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(40, rng.integers(1, 12))).astype(np.uint64) for _ in range(80)]
    sets += [np.unique(np.r_[s, rng.integers(0, 40, 1).astype(np.uint64)]) for s in sets]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert reach(len(sets), simhash.similar_links(sets, 0.8)) == reach(len(sets), near) and near


def test_a_quoted_passage_does_not_make_candidates(spark, monkeypatch):
    rng, seen, verified = random.Random(8), [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda rows, nodes, members, *rest: seen.append(members.count()) or verified(rows, nodes, members, *rest))
    own = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    passage = own(20)
    texts = [[*own(20), *passage, *own(25)] for _ in range(300)]
    texts += [[*t[:-1], "other"] for t in texts[:5]] + [[*passage, *own(n)] for n in (0, 1, 1, 1, 5, 6)]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == reach(len(texts), near) and len(near) == 11
    assert seen[0] <= 30  # all 311 before: the passage was among the least shingles of each


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, **{200 + i: 200 for i in range(1, 30)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def tasks_of(spark, work):
    """Tasks that ran while work() did."""
    spark.sparkContext.setJobGroup(name := f"tasks of {work}", "")
    try:
        work()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    status = spark.sparkContext.statusTracker()
    stages = {i for j in status.getJobIdsForGroup(name) for i in status.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for i in stages if (info := status.getStageInfo(i)))


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(i, i + 1) for i in range(1000, 1060)], "u long, v long")
    got = []
    few = tasks_of(spark, lambda: got.append(components.components(edges).collect()))
    monkeypatch.setattr(components, "SMALL", -1, raising=False)  # rounds only, as before
    rounds = tasks_of(spark, lambda: got.append(components.components(edges).collect()))
    assert sorted(got[0]) == sorted(got[1]) and got[0]
    assert few < 60 < rounds


@pytest.mark.parametrize("hot, joins", [(1 << 16, 0), (0, 1)])
def test_entries_are_shuffled_once(spark, monkeypatch, hot, joins):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "HOT", hot, raising=False)
    nodes = spark.createDataFrame([(i, ((i % 5) << 48 | i).to_bytes(8, "big")) for i in range(60)], "node long, print binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = simhash.hamming_links(nodes, 3, 1)
        plan = links._jdf.queryExecution().sparkPlan().toString()
        near = [(a, b) for a, b in itertools.combinations(range(60), 2) if (((a % 5) << 48 | a) ^ ((b % 5) << 48 | b)).bit_count() <= 3]
        assert reach(60, [tuple(r) for r in links.collect()]) == reach(60, near)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == joins


@pytest.mark.parametrize("block, hot", [(1 << 12, 1 << 16), (6, 1 << 16), (6, 0)])
def test_packed_bands_miss_no_link(spark, monkeypatch, block, hot):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot, raising=False)
    rng = np.random.default_rng(6)
    whole = rng.integers(0, 256, (150, 16), np.uint8)
    whole[50:] = whole[:50].repeat(2, axis=0) ^ (rng.random((100, 16)) < 0.5) * rng.integers(0, 8, (100, 16), np.uint8)
    bands = [(i, i ^ m) for m in (1, 2, 4) for i in range(16) if i < i ^ m]
    gaps = np.bitwise_count(whole[:, None, :8] ^ whole[None, :, :8]).sum(axis=2)
    near = [(a, b) for a, b in itertools.combinations(range(150), 2) if gaps[a, b] <= 10 and any((whole[a, [i, j]] == whole[b, [i, j]]).all() for i, j in bands)]
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(whole)], "node long, print binary")
    got = [tuple(r) for r in simhash.hamming_links(nodes, 10, 1, bands).collect()]
    assert reach(150, got) == reach(150, near) and near


def repeats_by_force(rows):
    first: dict[bytes, int] = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            first[data[p : p + 50]] = min(first.get(data[p : p + 50], i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "limits"), [(0, repeats.Limits()), (1, repeats.Limits(batch_bytes=3000)), (2, repeats.Limits(batch_bytes=3000, array_rows=40)), (3, repeats.Limits(batch_bytes=2000, hot=4, many=2)), (4, repeats.Limits(batch_rows=7, hot=1, many=2))])
def test_repeats(spark, seed, limits):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("abcdé "), size=n)) for n in (20, 49, 50, 51, 75, 80, 130, 300)] * 2 + ["a" * 120, " " * 90, "abab" * 40]
    rows = [(int(rng.integers(0, 80)), "".join(parts[j] if rng.random() < 0.7 else "".join(rng.choice(list("abcdefghij"), size=rng.integers(1, 60))) for j in rng.integers(0, len(parts), rng.integers(0, 7))) if rng.random() > 0.05 else None) for _ in range(100)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(9)]
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows], 4)
    assert sorted(map(tuple, repeats.remove_repeats(frame, limits=limits).collect())) == repeats_by_force(rows)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [repeats.Limits(), repeats.Limits(batch_bytes=50_000, hot=20, many=4)])
def test_repeats_of_a_hot_string_and_a_long_text(spark, limits):
    """A string of 25 bytes that stands in many documents between different neighbours, and a text of 200 KB."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), size=n))
    hot, shared = "the very same common line", [word(35) for _ in range(6)]
    long = word(200_000)
    rows = [(i, word(40) + rng.choice(shared) + hot + rng.choice(shared) + word(30)) for i in range(150)]
    rows += [(500, long), (400, long[1000:1200] + word(20)), (600, word(60) + long[150_000:150_090])]
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows], 3)
    assert sorted(map(tuple, repeats.remove_repeats(frame, limits=limits).collect())) == repeats_by_force(rows)


def test_anchored_suffix_array():
    """The order from both sides of the anchor finds what the general suffix array finds."""
    rng = np.random.default_rng(4)
    gram = rng.integers(97, 99, (3, repeats.GRAM)).astype(np.uint8)
    rows = rng.integers(97, 99, (60, repeats.AROUND)).astype(np.uint8)[rng.integers(0, 60, 400)]
    rows[np.arange(400), rng.integers(0, repeats.AROUND, 400)] = 120
    rows[:, repeats.PLACE : repeats.PLACE + repeats.GRAM] = gram[rng.integers(0, 3, 400)]
    low, high = rng.integers(0, 15, 400), rng.integers(62, 81, 400)
    column = np.arange(repeats.AROUND)
    rows[(column < low[:, None]) | (column >= high[:, None])] = 255

    def found(array):
        out = set()
        for length, first, last in array.maximal_repeats():
            places = array.suffix[first : last + 1]
            start = set((places % array.step).tolist())
            if len(start) == 1 and min(start) <= repeats.PLACE and min(start) + length >= repeats.PLACE + repeats.GRAM:
                out.add((length, tuple(sorted(places.tolist()))))
        return out

    assert found(repeats.AnchoredSuffixArray(rows, low, high)) == found(repeats.SuffixArray(rows, low, high)) != set()


def test_maximal_repeats(monkeypatch):
    monkeypatch.setattr(repeats, "WIDTH", 3)
    text = b"abcabcxabcdabcd"
    rows = np.frombuffer(text, np.uint8)[None, :]
    array = repeats.SuffixArray(rows, np.array([0]), np.array([len(text)]))
    got = {(text[array.suffix[a] :][:n], b - a + 1) for n, a, b in array.maximal_repeats()}
    every = {text[i:j] for i in range(len(text)) for j in range(i + 3, len(text) + 1)}
    places = {s: [i for i in range(len(text)) if text.startswith(s, i)] for s in every}
    sides = lambda s: ({text[i - 1 : i] if i else i for i in places[s]}, {text[i + len(s) : i + len(s) + 1] or i for i in places[s]})
    assert got == {(s, len(p)) for s, p in places.items() if len(p) > 1 and all(len(x) > 1 for x in sides(s))}


def test_tool_calls(spark):
    schemas = spark.createDataFrame([("f", "a", "integer", True), ("f", "b", "string", False), ("g", "x", "object", False)], "name string, argument string, type string, required boolean")
    calls = spark.createDataFrame([(1, 1, "c1", "f", '{"b":"x","a":2}'), (1, 1, "c0", "f", '{"a":{"$call":"c1"}}'), (1, 2, "c4", "g", "[1]"), (1, 2, None, "h", None), (1, 2, "c5", "g", '{"x":{"z":1,"a":[true,null]}}'), (2, 1, "c1", "f", "{}")], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 0, "c1", "early"), (1, 3, "zz", None)], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([(1, 0, "system", 'a "q"\n'), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in chat.link_tool_calls(messages, calls, results, schemas).orderBy("conv_id", "seq").collect()]
    one = [(r[2], r[3], r[4], r[5]) for r in got if r[0] == 1]
    assert one == [("message", None, False, None), ("call", "c1", True, True), ("call", "c0", False, False), ("result", "c1", True, None), ("call", "c4", False, False), ("call", "c5", False, True), ("call", None, False, False), ("result", "zz", False, None)]
    assert [r[6] for r in got if r[0] == 1] == list(range(8)) and [r[4:6] for r in got if r[0] == 2] == [(False, False)]
    lines = {r[3]: r[7] for r in got if r[0] == 1 and r[2] == "call"}
    assert lines["c5"] == '{"arguments":{"x":{"a":[true,null],"z":1}},"id":"c5","name":"g","type":"call"}'
    empty = chat.link_tool_calls(messages.limit(0), calls.limit(0), results.limit(0), schemas)
    assert empty.count() == 0


def test_long_chain_of_calls(spark):
    calls = spark.createDataFrame([(1, f"c{i}", f'{{"a":{{"$call":"c{i - 1}"}}}}' if i else "{}") for i in range(67)] + [(1, "x", '{"$call":"y"}'), (1, "y", '{"$call":"x"}')], "conv_id long, call_id string, arguments string").coalesce(1)
    got = {r["key"].rpartition("\0")[2]: r["level"] for r in chat.call_levels(calls).collect()}
    assert got == {**{f"c{i}": i for i in range(67)}, "x": None, "y": None}


def texts_left(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_repeated_and_null_ids_keep_their_texts(spark):
    """Rows that share an id, a null one too, are decided one by one."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c = text(120), text(120), text(120)
    near = " ".join([*a.split()[:60], "other", *a.split()[61:]])
    rows = [(1, a), (5, near), (5, b), (5, b), (None, near), (None, c), (None, c)]
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows])
    assert texts_left(simhash.near_dedup(frame)) == sorted([(1, a), (5, b), (None, c)], key=str)
    rows = [(1, "aaa bbb"), (2, "aaabbb"), (2, "zzz"), (None, "zzz"), (None, "zz z"), (3, "q"), (3, "q"), (None, None), (4, ""), (None, "w")]
    assert texts_left(exact.exact_dedup(docs(spark, [(i, t, "en", "a") for i, t in rows]))) == sorted([(1, "aaa bbb"), (None, "zz z"), (3, "q"), (4, ""), (None, "w")], key=str)
    items = spark.createDataFrame([("x", b)], "item_id string, text string")
    rows = [(1, a), (1, b), (None, b), (None, a), (None, None)]
    assert texts_left(decontam.decontaminate(docs(spark, [(i, t, "en", "a") for i, t in rows]), items)) == sorted([(1, a), (None, a), (None, None)], key=str)


def test_clashing_columns(spark):
    names = "own string, mark int, stays int, print long, root int, other_id int, other_own int, item int, distance int, `end` int, points int"
    frame = spark.createDataFrame([(i, t, "z", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for i, t in [(1, "a b c"), (2, "a b  c"), (3, None)]], f"doc_id long, text string, {names}")
    items = spark.createDataFrame([(1, "nothing here", 3)], "item_id long, text string, distance int")
    for out in (exact.exact_dedup(frame), simhash.near_dedup(frame), decontam.decontaminate(frame, items)):
        assert out.columns == frame.columns and out.count() >= 2


def test_items_are_whole_words_with_any_id(spark):
    rows = docs(spark, [(1, "party time", "en", "a"), (2, "the Art of it", "en", "a"), (2, "the Art of it", "en", "a"), (3, "art", "en", "a")])
    items = spark.createDataFrame([("i-1", "art"), ("i-2", "party  TIME")], "item_id string, text string")
    got = sorted(map(tuple, decontam.contamination(rows, items).collect()))
    assert got == [(1, "i-2", 0, 10), (2, "i-1", 0, 7), (2, "i-1", 0, 7), (3, "i-1", 0, 3)]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = docs(spark, [(i, f"x {w} y", "en", "a") for i, w in enumerate(words)] + [(9, "nothing", "en", "a")])
    items = spark.createDataFrame(list(enumerate(words)), "item_id long, text string")
    assert sorted((r[0], r[1]) for r in decontam.contamination(rows, items).collect()) == [(i, i) for i in range(5)]
    assert [r["doc_id"] for r in decontam.decontaminate(rows, items).collect()] == [9]


def test_chunks_of_huge_texts_are_hashed_apart(spark, monkeypatch):
    """The same groups, whether a text is hashed in one task or its chunks in several."""
    rng = random.Random(17)
    long = "".join(rng.choices("abc éß\n", k=300_000))
    rows = [(1, long, "en", "a"), (2, long.replace("\n", " \t"), "en", "a"), (3, long[:-1] + "z", "en", "a"), (4, "x" * exact.CHUNK, "en", "a"), (5, "x y", "en", "a"), (None, None, "en", "a"), (1, long, "en", "a")]
    want = sorted(map(tuple, exact.exact_groups(docs(spark, rows)).collect()), key=str)
    assert sorted(map(tuple, exact.exact_groups(docs(spark, rows), huge=1000).collect()), key=str) == want
    monkeypatch.setattr(exact, "HUGE", 1000)
    assert sorted(r["doc_id"] for r in exact.exact_dedup(docs(spark, rows)).collect() if r["doc_id"]) == [2, 3, 4, 5]


def test_bit_maps(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    made = common.key_map(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert common.in_map(made, keys).all() and common.in_map(made, keys + 1).mean() < 0.2
    assert not common.in_map(common.key_map(spark.createDataFrame([], "k long")), keys).any()


def test_template_decides_the_article(monkeypatch):
    """On pages without any telling element or name the slots find the article; without classes they do not."""
    rng = random.Random(19)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    sources, want = [], []
    for i in range(12):
        title, paragraphs = words(5), [words(rng.randint(20, 40)) for _ in range(rng.randint(2, 5))]
        menu = "".join(f"<li><a href=/{j}>{words(1)}</a></li>" for j in range(5))
        sources.append(f"<html><body><div class=x1><ul>{menu}</ul></div><div class=x2>{words(9)}</div><div class=x3><h1>{title}</h1><div class=x4>Written by</div><div class=x5><a href=/who>{words(2)}</a></div>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class=x6>{menu}</div></div><div class=x7>&copy; {words(8)}</div></body></html>")
        want.append((title, paragraphs))
    texts = html._group_texts(sources)
    for text, (title, paragraphs) in zip(texts, want):
        lines = text.split("\n")
        assert lines[0] == title and lines[2:] == paragraphs and len(lines[1].split()) == 2
    monkeypatch.setattr(html, "CLASS_TOKENS", 1 << 30)
    assert all(len(a) > len(b) and a != b for a, b in zip(html._group_texts(sources), texts))


def test_texts_of_pages_do_not_depend_on_partitions(spark):
    rng = random.Random(23)
    rows = [(i, f"http://h{i % 7 if i % 2 else 0}.example/{i}", page(f"T{i}", "".join(f"<p>{' '.join(rng.choices('abcdef', k=30))}" for _ in range(rng.randint(1, 5))))) for i in range(700)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = []
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, html.main_text(frame.repartition(int(n))).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1] and len(found[0]) == 700


def test_hundreds_of_languages(spark):
    rng = random.Random(31)
    stems = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in range(300)]
    text = lambda n: " ".join(rng.choices(stems[n], k=25))
    frame = docs(spark, [(1000 * k + n, text(n), f"l{n:03}", "a") for n in range(300) for k in range(4)])
    model = language.fit_language(frame)
    held = docs(spark, [(n, text(n) if n < 300 else "\U00030000\U00030001 \U00030002", None, "a") for n in range(301)])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(held, model).collect()}
    assert len(model.languages) == 300 and sum(got[n] == f"l{n:03}" for n in range(300)) >= 290 and got[300] != "und"


def test_language_of_ties_repeats_and_long_texts(spark):
    rows = [(i, "ab cd" if i % 2 else "ef gh", "x" if i % 2 else "y", "a") for i in range(1, 60)]
    rows += [(100, "zz qq", None, "a"), (100, "zz qq", None, "a"), (101, "ab cd " * 200_000, None, "a")]
    frame = docs(spark, rows)
    got = language.identify(frame, language.fit_language(frame)).where("doc_id >= 100").collect()
    told = sorted((r["doc_id"], r["lang_pred"]) for r in got)
    assert told[0] == told[1] and told[0][0] == 100 and told[0][1] in ("x", "y") and told[2:] == [(101, "x")]


def test_wide_bands_miss_no_link(spark):
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for p in prints for _ in range(3)]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(i, p.to_bytes(8, "big")) for i, p in enumerate(prints)], "node long, print binary")
    near = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    found = [tuple(r) for r in simhash.hamming_links(nodes, 3, 1, wide=True).collect()]
    assert reach(len(prints), found) == reach(len(prints), near)


def test_tables_of_groups_are_checkpointed_in_few_files(spark, monkeypatch):
    parts, keep = [], common.durable
    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words[: 199 - i], "x", *words[200 - i :]]) for i in range(4)]
    frame = docs(spark, [(i, t, "en", "a") for i, t in enumerate([*near, near[0], "one two three", "one  two three"])])

    def counted(df, *args, **named):
        out = keep(df, *args, **named)
        parts.append(out.rdd.getNumPartitions())
        return out

    for module in (components, exact, simhash):
        monkeypatch.setattr(module, "durable", counted)
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert sorted(r["doc_id"] for r in exact.exact_dedup(frame).collect()) == [0, 1, 2, 3, 6]
        assert max(parts) < 32
        parts.clear()
        assert sorted(r["doc_id"] for r in simhash.near_dedup(frame).collect()) == [0, 5]
        assert sum(n >= 32 for n in parts) <= 2, parts  # one row a text, and the least shingles of short ones
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
