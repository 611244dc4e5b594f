"""Benchmark decontamination by pigeonhole pieces and Myers bit-parallel edit distance.

An item with an error budget of k edits is split into k + 1 pieces; a passage
within the budget holds at least one piece unchanged.  Exact piece hits, found
by one automaton over whole texts, give the places that Myers' algorithm checks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, table

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Items and characters of items that one automaton holds; more are searched block by block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
_GAPS = re.compile(r"[\W_]+")


def canonical(text: str | None) -> str:
    """Lower case; every run of characters that are neither letters nor digits is one blank."""
    return _GAPS.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item; search() gives the best approximate occurrence in a text."""

    def __init__(self, item: str):
        self.size, self.mask, self.top = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(least edit distance to any substring of text, end of the first such substring)."""
        mask, top, get = self.mask, self.top, self.bits.get
        plus, minus, score = mask, 0, self.size
        best, end = score, 0
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (mask & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            if score < best:
                best, end = score, at
            up = up << 1 & mask
            plus = (down << 1 & mask) | (mask & ~(vertical | up))
            minus = up & vertical
        return best, end


class Matcher:
    """Items of one block, ready to search texts; whole words match, so both sides begin and end with a blank."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, f" {t} ", budget(len(t), rate)) for i, t in items]
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, k) in enumerate(self.items):
            for at, piece in pieces(item, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item number, least distance, end in the canonical text) of every item that a text holds."""
        own = canonical(text)
        return [(n, score, min(max(end - 2, 0), len(own))) for n, score, end in self.search(f" {own} ")] if own else []

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, least distance, end in text) of every item within its budget; text begins and ends with a blank.

        Piece hits of an item that point at the same stretch are checked once:
        the stretch covers all starts that the budget allows for any of them.
        """
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for n, at in found:
                starts.setdefault(n, []).append(end + 1 - size - at)
        out = []
        for n, guesses in starts.items():
            _, item, k = self.items[n]
            best = None
            guesses.sort()
            low = high = guesses[0]
            for g in [*guesses[1:], None]:
                if g is not None and g - high <= 2 * k:
                    high = g
                    continue
                a = max(0, low - k)
                stretch = text[a : high + len(item) + 2 * k]
                at = stretch.find(item)
                if at >= 0:
                    best = 0, a + at + len(item)
                    break
                pattern = self.patterns.get(n) or self.patterns.setdefault(n, Pattern(item))
                score, end = pattern.search(stretch)
                if score <= k and (best is None or score < best[0]):
                    best = score, a + end
                low = high = g
            if best:
                out.append((n, *best))
        return out


def _hits(items: list[tuple[object, str]], rate: float, kind: pa.DataType):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(items, rate)
            rows, numbers, scores, ends = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, score, end in matcher.matches(text):
                    rows.append(i)
                    numbers.append(matcher.items[n][0])
                    scores.append(score)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, kind), *[pa.array(x, pa.int64()) for x in (scores, ends)]], names=["id", "item", "distance", "end"])

    return hits


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Canonical items in blocks of at most BLOCK_ITEMS items or about BLOCK_CHARS characters, streamed one by one."""
    block, chars = [], 0
    for i, text in benchmark.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        if not (item := canonical(text)):
            continue
        if len(block) >= BLOCK_ITEMS or chars > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((i, item))
        chars += len(item)
    yield block


def _each(blocks: Iterator[list[tuple[object, str]]]) -> Iterator[tuple[list[tuple[object, str]], bool]]:
    """Each block, and whether it is the only one."""
    first = next(blocks)
    second = next(blocks, None)
    yield first, second is None
    if second is not None:
        yield second, False
        yield from ((b, False) for b in blocks)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (id, item_id, distance, match_end) per document and item it holds within the budget.

    Both sides are compared in canonical form (case, punctuation and white space
    do not count); an item of n characters may differ by int(n * rate) edits, and
    an item without a budget matches whole words only.  match_end is the end of
    the best match in the canonical text.  Items without
    a letter or digit never match; null texts match nothing; repeated rows are
    reported each (repeated equal items once per row of benchmark); empty tables
    give no rows; item ids have any simple type; further columns are ignored.
    The items, a stated query set, are streamed to the driver in blocks of a
    bounded size; each block is searched in one scan of docs, without any shuffle
    of texts.  Of several blocks one at a time is held, and its hits are checkpointed.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    out = None
    for block, only in _each(_blocks(benchmark, item_col, item_text_col)):
        found = rows.mapInArrow(_hits(block, rate, to_arrow_type(item_kind)), f"id {kind}, item {item_kind.simpleString()}, distance long, end long")
        found = found if only else durable(found)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "distance", F.col("end").alias("match_end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; each row is judged by its own text.

    Repeated and null ids make no difference; null texts stay; all columns stay,
    whatever their names.  Nothing is shuffled; of several blocks of items one at
    a time is held, and what it leaves is checkpointed.
    """
    at = docs.columns.index(text_col)

    def clean(items: list[tuple[object, str]]):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(items, rate)
                yield batch.filter(pa.array([not matcher.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return keep

    for block, only in _each(_blocks(benchmark, item_col, item_text_col)):
        docs = docs.mapInArrow(clean(block), docs.schema)
        docs = docs if only else durable(docs)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document and benchmark item within the error budget."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
