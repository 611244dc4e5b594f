"""Toxicity by compression distance between two zstandard dictionaries.

Every word of a text becomes a code of eight bytes, so that the compressor
matches whole words and not letters that any prose shares.  One dictionary is
trained on ordinary text, the other on what toxic text says far more often than
ordinary text; the second compressor has it in the place of random filler, beside
the first dictionary, so that both know ordinary words alike.  A window of words that
is shorter under the second than under the first holds words that
toxic texts have and ordinary ones lack.  Thresholds on the difference, and the
step from a document's differences to a probability, are calibrated on labelled
documents that neither dictionary has seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Labelled documents of a class that a model is fitted on (in expectation; larger tables are
#: sampled by a hash of the id), and the bytes that such a document may have.
FIT_TOXIC, FIT_ORDINARY, FIT_BYTES = 3000, 4000, 20_000
CODE = 8
#: A toxic document with so many new codes, half of them seen in earlier ones, is a copy and trains nothing.
COPY_CODES = 64
#: Share of toxic documents that a code must occur in.
TOXIC_SHARE = 0.01
#: How many times more frequent (smoothed odds) in toxic than in ordinary documents a code must be to tell; the calibrated one is chosen from these.
ODDS = (4.0, 8.0, 16.0, 32.0)
#: Filler after the content: the compressor does not index the last bytes of a dictionary.
TAIL = 32
#: Calls of the trainer, the least bytes it may fill, and the bits of its table of frequencies: with the
#: usual 20 the many strings that are no code crowd out frequent codes.
PASSES, LEAST_BYTES, TABLE_BITS = 8, 1 << 12, 22
#: Words of a window, and the level at which windows are compressed.
WINDOW, LEVEL = 8, 6
#: Bytes of content from ordinary text in both dictionaries, and of what toxic text adds.
BASE_BYTES, TOXIC_BYTES = 1 << 18, 1 << 13
#: Every so many-th fitted document calibrates instead of training a dictionary.
CALIBRATE = 4
#: Least difference in bytes of a window that may count; the calibrated one is chosen from these.
THRESHOLDS = (2, 3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def encode(text: str | None) -> bytes:
    """Codes of the lower-cased words of a text, end to end."""
    digest = xxhash.xxh64_digest
    return b"".join([digest(w) for w in _WORD.findall((text or "").lower())])


def _codes(data: bytes) -> list[bytes]:
    return [data[i : i + CODE] for i in range(0, len(data), CODE)]


def _windows(data: bytes) -> list[bytes]:
    return [data[i : i + CODE * WINDOW] for i in range(0, len(data), CODE * WINDOW)]


def _train(size: int, samples: list[bytes], least: float = 0.0) -> bytes:
    """Dictionary content that zstandard's trainer chooses from samples of one class, the codes of most samples at the end, where matches cost least.

    The trainer works on segments of one code.  It is called again on what its
    dictionaries leave out until it adds nothing or the size is reached.  Codes of
    one sample, or of less than the share least of them, are noise and stay out,
    unless all are.  Room that it leaves, all of it where the samples are too few
    for it, goes to the codes of most samples.
    """
    ranked = Counter(c for s in samples for c in set(_codes(s)))
    often = {c for c in ranked if ranked[c] >= max(2, least * len(samples))} or set(ranked)
    kept: dict[bytes, None] = {}
    for _ in range(PASSES):
        left = [x for s in samples if len(x := b"".join(c for c in _codes(s) if c not in kept)) >= 2 * CODE]
        try:
            made = zstandard.train_dictionary(max(size, LEAST_BYTES), left, k=CODE, d=CODE, f=TABLE_BITS, accel=1, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):
            break
        new = [c for c in dict.fromkeys(made[i : i + CODE] for i in range(len(made) - CODE + 1)) if c in often and c not in kept]
        kept.update(dict.fromkeys(new))
        if not new or CODE * len(kept) >= size:
            break
    order = lambda c: (-ranked[c], c)
    best = sorted([*kept, *sorted(often - kept.keys(), key=order)][: size // CODE], key=order)
    return b"".join(reversed(best))


@dataclass(frozen=True)
class Model:
    """Contents of both dictionaries, the window threshold and the calibrated steps."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    steps: tuple[tuple[float, float], ...]

    def score(self, excess: float) -> float:
        value = self.steps[0][1] if self.steps else 0.0
        for least, rate in self.steps:
            if excess >= least:
                value = rate
        return value


class Scorer:
    """Compressors of a model; made once in each worker."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        made = []
        for content in (ordinary, toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self.plain, self.marked = made

    def differences(self, data: bytes) -> np.ndarray:
        """Bytes that each window is shorter under the toxic dictionary."""
        plain, marked = self.plain, self.marked
        return np.array([len(plain(w)) - len(marked(w)) for w in _windows(data)], np.int64)


def _excess(differences: np.ndarray, threshold: int) -> float:
    over = differences[differences >= threshold]
    return float((over - threshold + 1).sum())


def _isotonic(values: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Rising steps (least value, rate of label 1) by pooling adjacent violators; rates are smoothed."""
    blocks: list[list[float]] = []
    for v in np.unique(values):
        own = labels[values == v]
        blocks.append([v, own.sum(), len(own)])
        while len(blocks) > 1 and blocks[-1][1] * blocks[-2][2] <= blocks[-2][1] * blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return tuple((float(v), float((s + 0.25) / (n + 0.5))) for v, s, n in blocks)


def _telling(toxic: Counter, toxic_size: int, ordinary: Counter, ordinary_size: int, odds: float) -> set[bytes]:
    """Codes whose smoothed odds of being in a toxic document are so many times those of being in an ordinary one."""
    rate = lambda n, size: (n + 0.5) / (size - n + 0.5)
    return {c for c, n in toxic.items() if rate(n, toxic_size) >= odds * rate(ordinary[c], ordinary_size)}


def fit(texts: Iterable[tuple[str | None, int]]) -> Model | None:
    """Model from (text, toxic) pairs in a fixed order; None where a class is missing."""
    coded: dict[int, list[bytes]] = {0: [], 1: []}
    for text, label in dict.fromkeys(texts):
        if label in coded and (data := encode(text)):
            coded[label].append(data)
    if not coded[0] or not coded[1]:
        return None
    parts = {k: ([x for i, x in enumerate(v) if i % CALIBRATE or len(v) < CALIBRATE], v[::CALIBRATE]) for k, v in coded.items()}
    ordinary = Counter(c for x in parts[0][0] for c in set(_codes(x)))
    rest, seen = [], set()
    for x in parts[1][0]:
        new = {c for c in _codes(x) if c not in ordinary}
        if len(new) < COPY_CODES or 2 * len(seen & new) < len(new):
            rest.append(x)
        seen |= new
    toxic = Counter(c for x in rest for c in set(_codes(x)))
    labels = np.array([k for k in (0, 1) for _ in parts[k][1]])
    best = None
    widest = _telling(toxic, len(rest), ordinary, len(parts[0][0]), ODDS[0])
    base = _train(BASE_BYTES, [b"".join(c for c in _codes(x) if c not in widest) for x in parts[0][0]])
    for odds in ODDS:
        telling = _telling(toxic, len(rest), ordinary, len(parts[0][0]), odds)
        added = _train(TOXIC_BYTES, [b"".join(c for c in _codes(x) if c in telling) for x in rest], TOXIC_SHARE)
        filler = np.random.default_rng(0).bytes(len(added) + TAIL)
        added += filler[-TAIL:]
        scorer = Scorer(base + filler, base + added)
        found = [scorer.differences(x) for k in (0, 1) for x in parts[k][1]]
        for threshold in THRESHOLDS:
            excess = [_excess(d, threshold) for d in found]
            model = Model(base + filler, base + added, threshold, _isotonic(np.array(excess), labels))
            loss = -sum(math.log(abs(1 - k - model.score(e))) for e, k in zip(excess, labels, strict=True))
            if best is None or loss < best[0]:
                best = loss, model
    return best[1]


def _scores(model: Model | None):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model and Scorer(model.ordinary, model.toxic)
        for batch in batches:
            out = [model.score(_excess(scorer.differences(encode(t)), model.threshold)) if model else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])
        tidy()

    return scores


def _fold(id_column: Column, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % folds


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on rows of labels whose crc32(id as text) mod 3 is not 1; runs actions.

    Classes larger than the bounds are sampled by a hash of the id; the sampled
    ids, of that proven size, are broadcast to the scan of docs.  Of an id
    labelled twice the higher label counts; null labels and texts are left out.
    """
    own = labels.where(_fold(F.col(id_col), 3) != 1).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__y")).where("__y in (0, 1)")
    size = {r[0]: r[1] for r in own.groupBy("__y").count().collect()}
    bound = {0: FIT_ORDINARY, 1: FIT_TOXIC}
    draw = F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(1_000_000))
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, bound[1] / max(1, size.get(1, 0))))).otherwise(F.lit(min(1.0, bound[0] / max(1, size.get(0, 0)))))
    sample = F.broadcast(own.where(draw < share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("__own"), F.col(text_col).cast("string").alias("__text")).where(f"__text is not null and octet_length(__text) <= {FIT_BYTES}").join(sample, F.col("__own") == F.col("__id"))
    texts = rows.select(F.xxhash64("__id").alias("h"), "__text", "__y").toArrow().sort_by([("h", "ascending"), ("__text", "ascending"), ("__y", "ascending")])
    model = fit(zip(texts["__text"].to_pylist(), texts["__y"].to_pylist(), strict=True))
    del texts
    tidy()
    return model


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs, from its whole text alone.

    score is the calibrated probability of label 1; predicted is 1 from 0.7.
    Null and empty texts get the score of a text without any marked window, all
    texts get 0 where no model could be fitted.  Repeated rows are scored each; an
    empty table gives no rows; further columns are ignored.  No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scores(model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), (_fold(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay, nothing is shuffled."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model and Scorer(model.ordinary, model.toxic)
        for batch in batches:
            clean = [model is None or model.score(_excess(scorer.differences(encode(t)), model.threshold)) < 0.7 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))
        tidy()

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document, labels learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
