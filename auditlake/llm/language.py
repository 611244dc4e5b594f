"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

The script of a word, from code point ranges, leaves the languages whose learned
texts use that script.  Its letter trigrams score the rest.  Viterbi's algorithm
finds the labelling of a text's words with the highest sum of scores less a
penalty for each switch, which gives spans of mixed-language text; the language
with the most letters in its spans is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Documents of a language that the trigram table is fitted on (in expectation; more are sampled
#: by a hash of the id), and the bytes that such a document may have.
FIT_DOCS, FIT_BYTES = 1500, 100_000
#: Slots of the trigram table.
SLOTS = 1 << 17
#: Log-likelihood that a change of language within a text costs.
SWITCH = 8.0
#: Share of a language's letters that a script needs to be one of the language's scripts.
SCRIPT_SHARE = 0.005
#: Scores of words that are held together; bounds a worker's memory unless one text is longer.
BATCH_SCORES = 1_600_000
UNKNOWN = "und"
#: First and last code point of the scripts told apart; other letters count as script 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)],
}
_LAST = 0x10FFFF


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its script."""
    import unicodedata

    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(_LAST + 1)])
    script = np.zeros(_LAST + 1, np.int8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = n
    return letter, script


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.append(_tables())
    return _TABLES[0]


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slot of each letter, first letter of each word, letters and script of each word.

    A word is a run of letters of the lower-cased text; a trigram is a
    letter and the two before it, blank before the word; the end of a word adds one.
    """
    letter, script = _letters()
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    inside = letter[points]
    flat = np.where(inside, points, 0).astype(np.uint64)
    padded = np.r_[np.zeros(2, np.uint64), flat, np.zeros(1, np.uint64)]
    slots = ((padded[2:] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[:-2] * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)) & np.uint64(SLOTS - 1)
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    take = np.r_[inside, False]
    take[end] = True  # the trigram that ends a word
    place = np.cumsum(take) - 1
    return slots[take].astype(np.int64), place[begin], end - begin, script[points[begin]] if len(begin) else np.empty(0, np.int8)


@dataclass(frozen=True)
class Model:
    """languages; scores[slot, language], less the mean of the languages; allowed[script, language]."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray


def word_scores(model: Model, slots: np.ndarray, begin: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Score of each word in each language; a language whose script differs is out, unless all are."""
    if not len(begin):
        return np.empty((0, len(model.languages)), np.float32)
    sums = np.add.reduceat(model.scores[slots], begin, axis=0)
    fits = model.allowed[script]
    return np.where(fits | ~fits.any(axis=1, keepdims=True), sums, np.float32(-1e4))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; scores holds the words of several texts end to end.

    All texts advance word by word together, longest first, so the cost of a step
    is shared; exact for each text.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    labels = np.empty(len(scores), np.int32)
    back = np.empty(scores.shape, np.int32 if scores.shape[1] > 1 << 15 else np.int16)
    n = np.arange(scores.shape[1], dtype=back.dtype)
    value = np.empty((len(sizes), scores.shape[1]), np.float32)
    for t in range(steps):
        k = alive[t]
        at = first[:k] + t
        if t:
            now = value[:k]
            best = now.argmax(axis=1).astype(back.dtype)
            jump = now[np.arange(k), best] - penalty
            stay = now >= jump[:, None]
            back[at] = np.where(stay, n, best[:, None])
            value[:k] = np.where(stay, now, jump[:, None]) + scores[at]
        else:
            value[:k] = scores[at]
    state = value.argmax(axis=1).astype(back.dtype)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return labels


def _label(model: Model, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the labels of its words and their letters."""
    held: list[tuple] = []
    count = 0
    for text in texts:
        held.append(words_of(text))
        count += len(held[-1][1])
        if count * len(model.languages) >= BATCH_SCORES:
            yield from _label_batch(model, held)
            held, count = [], 0
    if held:
        yield from _label_batch(model, held)


def _label_batch(model: Model, held: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(h[1]) for h in held], np.int64)
    scores = np.concatenate([word_scores(model, s, b, p) for s, b, _, p in held])
    labels = viterbi(scores, lengths, SWITCH)
    ends = np.cumsum(lengths)
    for h, a, b in zip(held, ends - lengths, ends, strict=True):
        yield labels[a:b], h[2]


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """(first word, words, language) of each span of one text."""
    slots, begin, _, script = words_of(text)
    labels = viterbi(word_scores(model, slots, begin, script), np.array([len(begin)]), SWITCH)
    cuts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else np.empty(0, int)
    return [(int(a), int(b - a), model.languages[labels[a]]) for a, b in zip(cuts, [*cuts[1:], len(labels)], strict=True)]


def _predict(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares = [], []
            texts = batch.column(1).to_pylist()
            for labels, letters in _label(model, texts) if model else (([], []) for _ in texts):
                votes = np.bincount(labels, letters, len(model.languages)) if len(labels) else np.zeros(1)
                if not votes.any():
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    continue
                best = int(votes.argmax())
                names.append(model.languages[best])
                shares.append(float(votes[best] / votes.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["id", "lang", "score"])

    return predict


def _fold(id_column: Column, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % folds


def _counts(languages: dict[str, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), SLOTS), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, _, letters, script = words_of(text)
                own = languages[lang]
                grams[own] += np.bincount(slots, minlength=SLOTS)
                scripts[own] += np.bincount(script, letters, len(SCRIPTS) + 1).astype(np.int64)
        for kind, table_ in ((0, grams), (1, scripts)):
            lang, slot = np.nonzero(table_)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lang), kind, np.int32)), pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(table_[lang, slot])], names=["kind", "lang", "slot", "n"])

    return count


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on texts with a language whose crc32(id as text) mod 5 is not 0; runs actions.

    Each language gives about FIT_DOCS documents, chosen by a hash of the id.
    Counting is distributed; the driver gets at most SLOTS sums a language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(_fold(F.col("id"), 5) != 0).where(f"text is not null and lang is not null and octet_length(text) between 1 and {FIT_BYTES}")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = {name: i for i, name in enumerate(sorted(sizes))}
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000))
    chosen = F.lit(False)
    for name, size in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & (draw < min(1.0, FIT_DOCS / size) * 1_000_000))
    sums = rows.where(chosen).select("text", "lang").mapInArrow(_counts(languages), "kind int, lang int, slot int, n long").groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, lang, slot, n = (sums[c].to_numpy() for c in ("kind", "lang", "slot", "n"))
    grams = np.zeros((SLOTS, len(languages)))
    grams[slot[kind == 0], lang[kind == 0]] = n[kind == 0]
    scripts = np.zeros((len(SCRIPTS) + 1, len(languages)))
    scripts[slot[kind == 1], lang[kind == 1]] = n[kind == 1]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * SLOTS))
    logs -= logs.mean(axis=1, keepdims=True)
    return Model(tuple(languages), logs.astype(np.float32), scripts > SCRIPT_SHARE * scripts.sum(axis=0))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of docs, from its whole text alone.

    score is the share of letters in spans of the predicted language.  A text
    that is null or has no letter, and any text where no model could be fitted,
    gets ``und`` and score 0.  Ties go to the language first in order.  Repeated
    rows are labelled each; an empty table gives no rows; further columns are
    ignored.  No shuffle; the model (fixed size) goes with the tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(model), f"id {kind}, lang string, score double")
    return found.select(F.col("id").alias(id_col), (_fold(F.col("id"), 5) == 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document, learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))
