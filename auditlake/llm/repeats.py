"""Removal of repeated byte strings through enhanced suffix arrays.

All occurrences of a string of WIDTH bytes have to meet in one task.  A string
names its own meeting place: the least hash of the GRAM-byte strings inside it
(its anchor) is the same wherever the string occurs.  Phase one finds the anchors
that occur more than once; phase two deals the surroundings of those anchors to
buckets by their hash.  A bucket builds a suffix array with longest common
prefixes over its surroundings, scans it with a stack, and each interval of the
common-prefix tree that is not extensible to the left is a maximal repeat with
all its occurrences.  Phase three applies what the buckets found to whole texts.

Texts travel in packed batches; questions to a bucket and its answers carry the
batch's number, so a string that a third of all rows share costs one question
for each batch and never one for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Bytes of a string that counts as repeated, and of the strings whose hashes are its anchor.
WIDTH, GRAM = 50, 20
#: Bytes around an anchor that any string with this anchor lies in, and the anchor's place there.
AROUND, PLACE = 2 * WIDTH - GRAM, WIDTH - GRAM
#: Batches for each bucket of anchor hashes, and the least number of buckets; they bound what a bucket
#: gathers, whatever the size of the table.
BATCHES, BUCKETS = 2, 1 << 5
#: Places that the search for anchors works on at once; the arrays stay in the processor's cache.
BLOCK = 1 << 16
#: Letters of nine bits that one number holds, and ranks that one number holds.
PACK, RANKS = 7, 3
#: Marks a row that holds one string of a hot anchor, and stands for a whole row in a question's number.
WINDOW, WHOLE = 0x80, 31
_PAD = 0xFF  # never part of UTF-8
_LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x9E3779B1


@dataclass(frozen=True)
class Limits:
    """What bounds a task; none of it changes a result.

    batch_bytes of different texts and batch_rows make a batch; one suffix array
    holds about array_rows surroundings; an anchor with hot different surroundings
    has its strings dealt to buckets one by one; from many places of an anchor in a
    batch on, its different surroundings there are counted.
    """

    batch_bytes: int = 6 << 20
    batch_rows: int = 50_000
    array_rows: int = 1 << 15
    hot: int = 20_000
    many: int = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _gram_order(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of 32 bits, never zero, of every string of GRAM bytes, by doubling; decides which is least."""
    known = {1: data.astype(np.uint32) + np.uint32(1)}
    power, length = {1: _STEP}, 1
    while 2 * length <= GRAM:
        h = known[length]
        known[2 * length] = h[:-length] * np.uint32(power[length]) + h[length:]
        power[2 * length] = power[length] ** 2 & 0xFFFFFFFF
        length *= 2
    out, done = None, 0
    for step in sorted(known, reverse=True):
        if GRAM - done >= step:
            part = known[step][done:]
            out = part if out is None else out[: len(part)] * np.uint32(power[step]) + part[: len(out)]
            done += step
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    return out ^ (out >> np.uint32(16)) | np.uint32(1)


def _gram_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of 64 bits of the strings of GRAM bytes at places."""
    if not len(places):
        return np.empty(0, np.uint64)
    at = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    with np.errstate(over="ignore"):
        h = _mix(at[places])
        for i in (8, GRAM - 8):
            h = _mix(h * _BASE + at[places + i])
        return h


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of every string of WIDTH bytes within one text; texts lie end to end.

    All places of a string that have its least hash are anchors.  The places
    are found block by block, each with as much around it as decides them.
    """
    window, side = WIDTH - GRAM + 1, WIDTH - GRAM
    ends = np.cumsum(lengths)
    across = np.zeros(len(data) + 1, bool)  # strings that would run into the next text
    for k in range(1, WIDTH):
        across[np.maximum(ends - k, 0)] |= ends >= k
    edge, found = np.zeros(side, np.uint32), []
    for a in range(0, len(data) - WIDTH + 1 + side, BLOCK):
        low, high = max(0, a - side), min(len(data) - GRAM + 1, a + BLOCK + side)
        if high - low < window:
            continue
        gram = _gram_order(data[low : high + GRAM - 1])
        least = _sliding(np.minimum, gram, window)
        least[across[low : low + len(least)]] = 0
        # a gram is least in some string iff it equals the greatest of the least hashes of the strings it lies in
        most = _sliding(np.maximum, np.r_[edge, least, edge], window)
        found.append(np.flatnonzero((most == gram)[a - low : a - low + BLOCK]) + a)
    where = np.concatenate(found) if found else np.empty(0, np.int64)
    return where, _gram_hashes(data, where)


def _sliding(pick: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """pick over each window of values, by doubling."""
    size = 1
    while size < window:
        step = min(size, window - size)
        values = pick(values[:-step], values[step:])
        size += step
    return values


def surroundings(data: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes around each anchor (rows of AROUND), the valid part [low, high) of a row, and its text."""
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, places, side="right")
    begin = places - PLACE
    low = np.maximum(0, (ends - lengths)[doc] - begin)
    high = np.minimum(AROUND, ends[doc] - begin)
    rows = np.empty((len(places), AROUND), np.uint8)
    padded = np.r_[np.full(PLACE, _PAD, np.uint8), data, np.full(AROUND, _PAD, np.uint8)]
    column = np.arange(AROUND)
    for a in range(0, len(places), 1 << 16):
        part = slice(a, a + (1 << 16))
        rows[part] = padded[(begin[part] + PLACE)[:, None] + column]
        rows[part][(column < low[part, None]) | (column >= high[part, None])] = _PAD
    return rows, low.astype(np.uint8), high.astype(np.uint8), doc


def _row_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes as rows of numbers, and a hash of each."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(len(rows), np.uint64)
        for i in range(words.shape[1]):
            key = _mix(key * _BASE + words[:, i])
    return words, key


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row) of equal rows of bytes; sorted by a hash, compared in full."""
    n = len(rows)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words, key = _row_hashes(rows)
    order = np.argsort(key, kind="stable")
    tie = key[order][1:] == key[order][:-1]
    same = tie.copy()
    pairs = np.flatnonzero(tie)
    same[pairs] = (words[order[pairs + 1]] == words[order[pairs]]).all(axis=1)
    if (tie & ~same).any():  # two strings of one hash: order them in full
        order = np.lexsort(words.T)
        same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    begin = np.r_[True, ~same]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(begin) - 1
    return order[begin], group


class SuffixArray:
    """Enhanced suffix array of several texts end to end, none of which runs into the next."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        n, width = rows.shape
        self.step = width + 1
        column = np.arange(width + 1)
        outside = (column < low[:, None]) | (column >= high[:, None])
        flat = np.zeros((n, width + 1), np.int64)
        flat[:, :width] = rows
        flat = np.where(outside, 256, flat).ravel()
        size = len(flat)
        # ranks of strings of PACK letters, then of RANKS times as many until they outgrow a row; what
        # lies outside a row sorts last, and common prefixes are cut at the end of the row
        packed = np.zeros(size, np.int64)
        for i in range(PACK):
            packed = packed << 9 | np.r_[flat[i:], np.full(min(i, size), 256)][:size]
        rank = np.unique(packed, return_inverse=True)[1]
        self.ranks, length = [(1, flat), (PACK, rank)], PACK
        self.ranks_in_one = RANKS if (size + 2) ** RANKS < 1 << 63 else RANKS - 1
        while length < width:
            base, packed = np.int64(size + 1), rank.astype(np.int64)
            for i in range(1, self.ranks_in_one):
                packed = packed * base + np.r_[rank[i * length :] + 1, np.zeros(min(i * length, size), np.int64)][:size]
            rank = np.unique(packed, return_inverse=True)[1]
            length *= self.ranks_in_one
            self.ranks.append((length, rank))
        begin = (low[:, None].astype(np.int64) <= column) & (column + WIDTH <= high[:, None])
        usable = np.flatnonzero(begin.ravel())
        self.suffix = usable[np.argsort(rank[usable], kind="stable")]
        left = high.astype(np.int64)[self.suffix // self.step] - self.suffix % self.step
        self.common = np.minimum(self._common(), np.minimum(left, np.r_[0, left[:-1]]))
        before = np.r_[np.int64(-1), flat[:-1]][self.suffix]
        at_edge = (self.suffix % self.step) == low[self.suffix // self.step]
        self.before = np.where(at_edge, -1 - np.arange(len(before)), before)

    def _common(self) -> np.ndarray:
        """Longest common prefix of each suffix with the one before it."""
        a, b = self.suffix[:-1].copy(), self.suffix[1:].copy()
        out = np.zeros(len(a), np.int64)
        for length, rank in reversed(self.ranks):
            going = np.arange(len(a))
            for _ in range(self.ranks_in_one if length > 1 else PACK):
                inside = going[(a[going] < len(rank)) & (b[going] < len(rank))]
                x, y = rank[a[inside]], rank[b[inside]]
                going = inside[x == y]
                out[going] += length
                a[going] += length
                b[going] += length
        return np.r_[np.int64(0), out]

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of each of the intervals."""
        return zip(*(x.tolist() for x in self.intervals()), strict=True)

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last): suffixes first to last share length bytes, and no longer string at the same places.

        Stack scan of the common prefixes; an interval counts if its suffixes
        differ in the byte before them, else a longer repeat holds all its places.
        """
        common = self.common
        differs = np.r_[0, np.cumsum(self.before[1:] != self.before[:-1])]
        edge = np.diff(np.r_[False, common >= WIDTH, False].astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        diverse = differs[end - 1] > differs[begin - 1]  # else none of the intervals of the run counts
        begin, end = begin[diverse], end[diverse]
        single = end - begin == 1
        found = [(common[begin[single]], begin[single] - 1, begin[single])]
        rest: list[tuple[int, int, int]] = []
        for a, b in zip(begin[~single].tolist(), end[~single].tolist(), strict=True):
            stack: list[tuple[int, int]] = []
            values = common[a:b].tolist()
            values.append(0)
            changes = differs[a - 1 : b].tolist()
            for i, value in enumerate(values, a):
                first = i - 1
                while stack and stack[-1][0] > value:
                    length, first = stack.pop()
                    if changes[i - a] > changes[first - a + 1]:
                        rest.append((length, first, i - 1))
                if value and (not stack or stack[-1][0] < value):
                    stack.append((value, first))
        if rest:
            found.append(tuple(np.array(x, np.int64) for x in zip(*rest, strict=True)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class AnchoredSuffixArray(SuffixArray):
    """The same for rows that hold their anchor at PLACE: of the suffixes that begin at or before it.

    Suffixes that share WIDTH bytes share an anchor at one place, so they begin at
    one place of their rows and agree on the bytes before the anchor.  One order of
    the rows by what is left of the anchor, read away from it, and one by what is
    right of it give the order of all suffixes.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        n, width = rows.shape
        self.step = width + 1
        right = rows[:, PLACE + GRAM :]
        order, agree = _ordered(right)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, agree[1:] < right.shape[1]])
        back, alike = _ordered(np.concatenate([rows[:, PLACE : PLACE + GRAM], rows[:, PLACE - 1 :: -1]], axis=1))
        words = _words(right)
        suffix, common, before = [], [], []
        for start in range(PLACE + 1):
            group = np.empty(n, np.int64)
            group[back] = np.cumsum(alike < GRAM + PLACE - start)
            use = np.flatnonzero((low <= start) & (start + WIDTH <= high))
            use = use[np.bincount(group[use], minlength=n + 1)[group[use]] > 1]
            if not len(use):
                continue
            key = group[use] * n + rank[use]
            use = use[np.argsort(key, kind="stable")]
            own = group[use]
            share = np.r_[0, np.minimum(_agreement(words[use[:-1]], words[use[1:]]) + PLACE + GRAM, np.minimum(high[use[:-1]], high[use[1:]])) - start]
            share[np.r_[True, own[1:] != own[:-1]]] = 0
            suffix.append(use * self.step + start)
            common.append(share)
            before.append(np.where(low[use] == start, -1 - np.arange(len(use)), rows[use, start - 1].astype(np.int64)))
        none = np.empty(0, np.int64)
        self.suffix, self.common, self.before = (np.concatenate(x) if x else none for x in (suffix, common, before))


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian numbers, which have the order of the bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that rows of such numbers share, zeros behind the rows included."""
    out = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    for i in range(a.shape[1]):
        differ = a[going, i] ^ b[going, i]
        for k in range(8):
            out[going] += differ < np.uint64(1 << (56 - 8 * k))
        going = going[differ == 0]
    return out


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and the leading bytes that each shares with the one before (the first: none)."""
    words = _words(rows)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    return order, np.r_[0, np.minimum(_agreement(words[:-1], words[1:]), rows.shape[1])]


def _covered(rows: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of stretches of a row that a row with a smaller owner repeats."""
    array = AnchoredSuffixArray(rows, low, high)
    length, first, last = array.intervals()
    size = last - first + 1
    if not len(size):
        return (np.empty(0, np.int64),) * 3
    opens = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(first - opens, size)
    who = owner[array.suffix[at] // array.step]
    over = who > np.repeat(np.minimum.reduceat(who, opens), size)
    at, length = at[over], np.repeat(length, size)[over]
    start = array.suffix[at] % array.step
    return array.suffix[at] // array.step, start, start + length


# --- batches, questions and answers ---------------------------------------------------------------


def _pack(limits: Limits):
    """Batches of rows: the different texts end to end, and each row's text by number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=9)
        ids, of, texts, size, number = [], [], {}, 0, 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            notes = [pa.array(ids, pa.int64()).fill_null(_LAST).to_numpy(), np.array([i is None for i in ids], np.uint8), np.array(of, np.int32), lengths]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in notes], pa.array([squeeze.compress(b"".join(texts))], pa.binary())], names=["uid", "ids", "nulls", "of", "lengths", "text"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                if ids and text not in texts and size + len(text) > limits.batch_bytes or len(ids) >= limits.batch_rows:
                    yield row()
                    ids, of, texts, size, number = [], [], {}, 0, number + 1
                if text not in texts:
                    size += len(text)
                of.append(texts.setdefault(text, len(texts)))
                ids.append(i)
        if ids:
            yield row()

    return pack


def _owners(head: dict) -> np.ndarray:
    """Least id of each different text of a batch."""
    out = np.full(len(head["lengths"]) // 8, _LAST)
    np.minimum.at(out, np.frombuffer(head["of"], np.int32), np.frombuffer(head["ids"], np.int64))
    return out


def _open(text: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8) if text else np.empty(0, np.uint8), np.frombuffer(lengths, np.int64)


def _split(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0]) if len(order) else np.empty(0, int)
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(buckets[order[a]]), order[a:b]


def _buckets(batches: int) -> int:
    return max(BUCKETS, -(-batches // BATCHES))


def _bucket(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _message(uid: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([uid] * len(parts), pa.int64()), pa.array([d for _, d in parts], pa.binary())], names=["bucket", "uid", "data"])


def _short(hashes: np.ndarray) -> bytes:
    """The low six bytes of each hash; the top ones choose the bucket."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers or rows of bytes as one compressed message; numbers go byte plane by byte plane."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T if c.ndim == 1 and c.itemsize > 1 else c).tobytes() for c in columns]
    return np.int64(len(columns[0])).tobytes() + zstandard.ZstdCompressor(level=6).compress(b"".join(planes))


def _unsqueeze(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """kinds: number type and 0, or uint8 and the bytes of a row."""
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 0, []
    raw = zstandard.ZstdDecompressor().decompress(data[8:]) if n else b""
    for kind, width in kinds:
        if width:
            out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width))
            at += n * width
        else:
            size = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
            at += n * size
    return out


def _different(data: np.ndarray, places: np.ndarray, hashes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, how many different surroundings it has), ascending; a count below many is that of its places."""
    value, of, count = np.unique(hashes, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[of] >= many)
    if len(often):
        padded = np.r_[np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]
        at = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        with np.errstate(over="ignore"):
            beside = _mix(_mix(hashes[often] * _BASE + at[places[often]]) * _BASE + at[places[often] + 8 + GRAM])
        first = np.unique(beside, return_index=True)[1]
        count[count >= many] = 0
        np.add.at(count, of[often[first]], 1)
        count[of[often]] = np.maximum(count[of[often]], 2)
    return value, count


def _ask_hashes(buckets: int, limits: Limits):
    """Phase one: to each bucket the batch's anchor hashes, each as often as the number of its surroundings has binary digits."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, lengths = _open(row["text"], row["lengths"])
                value, count = _different(data, *anchors(data, lengths), limits.many)
                value = np.repeat(value, np.floor(np.log2(count)).astype(np.int64) + 1)
                parts = [(b, value[at]) for b, at in _split(_bucket(value, buckets))]
                yield _message(row["uid"], [(b, _short(v)) for b, v in parts])

    return ask


def _one_bucket(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[tuple[int, bytes]]]:
    """The bucket that a task has, and its messages."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append((row["uid"], row["data"]))
    if len(held) > 1:
        raise RuntimeError("a partition must hold one bucket")
    return next(iter(held.items()), (0, []))


def _answer_hashes(limits: Limits):
    """Which of a batch's hashes occur twice in all batches of the bucket, and which of those are hot."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, messages = _one_bucket(batches)
        asked = [(uid, *np.unique(_six(data), return_counts=True)) for uid, data in messages]
        if not asked:
            return
        value, of = np.unique(np.concatenate([h for _, h, _ in asked]), return_inverse=True)
        total = np.bincount(of, np.concatenate([1 << (n - 1) for _, _, n in asked]))
        at = 0
        for uid, hashes, _ in asked:
            times = total[of[at : at + len(hashes)]]
            at += len(hashes)
            own = times > 1
            if own.any():
                yield _message(uid, [(bucket, _short(hashes[own]) + (times[own] >= limits.hot).astype(np.uint8).tobytes())])

    return answer


def _joined(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Batches, each with the answers to it; rows come sorted by batch, the batch itself first."""
    head, answers = None, []
    for batch in rows:
        for row in batch.to_pylist():
            if row["text"] is not None:
                if head is not None:
                    yield head, answers
                head, answers = row, []
            else:
                answers.append({"bucket": row["bucket"], "data": row["data"]})
    if head is not None:
        yield head, answers


def _questions(data: np.ndarray, lengths: np.ndarray, places: np.ndarray, ordinal: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, place, text, group of equal rows) of what is asked about the anchors ordinal of places.

    A row is the surroundings of an anchor with its valid part; for a hot anchor,
    each string of WIDTH bytes in its surroundings, marked as such.
    """
    context, low, high, doc = surroundings(data, lengths, places[ordinal])
    key = np.c_[context, low, high]
    number, at = ordinal * 32 + WHOLE, places[ordinal] - PLACE
    if hot.any():
        which = np.flatnonzero(hot)
        start = np.tile(np.arange(PLACE + 1), len(which))
        which = np.repeat(which, PLACE + 1)
        inside = (low[which] <= start) & (start + WIDTH <= high[which])
        which, start = which[inside], start[inside]
        cut = key[which]
        column = np.arange(AROUND)
        cut[:, :AROUND][(column < start[:, None]) | (column >= start[:, None] + WIDTH)] = _PAD
        cut[:, AROUND], cut[:, AROUND + 1] = start | WINDOW, start + WIDTH
        cold = ~hot
        key, number, at, doc = np.concatenate([key[cold], cut]), np.r_[number[cold], ordinal[which] * 32 + start], np.r_[at[cold], at[which]], np.r_[doc[cold], doc[which]]
    return key, number, at, doc, _groups(key)[1]


def _ask_contexts(buckets: int):
    """Phase two: to each bucket the distinct surroundings of repeated anchors, with their least document."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, answers in _joined(rows):
            data, lengths = _open(head["text"], head["lengths"])
            places, hashes = anchors(data, lengths)
            short = _six(_short(hashes))
            order = {b: at for b, at in _split(_bucket(hashes, buckets))}
            keep, hot = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
            for a in answers:
                at, count = order[a["bucket"]], len(a["data"]) // 7
                known, flag = _six(a["data"][: 6 * count]), np.frombuffer(a["data"], np.uint8, count, 6 * count).astype(bool)
                place = np.minimum(np.searchsorted(known, short[at]), count - 1)
                found = known[place] == short[at]
                keep[at[found]] = True
                hot[at[found]] = flag[place[found]]
            ordinal = np.flatnonzero(keep)
            if not len(ordinal):
                continue
            key, number, _, doc, group = _questions(data, lengths, places, ordinal, hot[ordinal])
            order = np.argsort(group, kind="stable")
            first = order[np.r_[0, np.cumsum(np.bincount(group))[:-1]]]
            least = np.full(len(first), _LAST)
            np.minimum.at(least, group, _owners(head)[doc])
            mark = hashes[number[first] // 32]
            cut = number[first] % 32 != WHOLE
            if cut.any():
                mark[cut] = _row_hashes(key[first[cut]])[1]
            parts = []
            for b, at in _split(_bucket(mark, buckets)):
                at = at[np.argsort(first[at])]
                parts.append((b, _squeeze(number[first[at]].astype(np.uint32), least[at], key[first[at]])))
            yield _message(head["uid"], parts)

    return ask


def _answer_contexts(limits: Limits):
    """Per row asked about: the least document that has it, and what of that one others repeat."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, messages = _one_bucket(batches)
        if not messages:
            return
        asked = [(uid, *_unsqueeze(data, (np.uint32, 0), (np.int64, 0), (np.uint8, AROUND + 2))) for uid, data in messages]
        del messages
        keys = np.concatenate([a[3] for a in asked])
        first, group = _groups(keys)
        least = np.full(len(first), _LAST)
        np.minimum.at(least, group, np.concatenate([a[2] for a in asked]))
        distinct = keys[first]
        del keys
        whole = np.flatnonzero(distinct[:, AROUND] < WINDOW)
        gram = _groups(distinct[whole, PLACE : PLACE + GRAM])[1]
        several = np.flatnonzero(np.bincount(gram, minlength=1)[gram] > 1)
        several = several[np.argsort(gram[several], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, np.diff(gram[several]) != 0]) if len(several) else np.empty(0, int)
        several = whole[several]
        # one stretch per row: strings with this anchor overlap in it, so their union has no gap
        begin = np.full(len(first), AROUND)
        stop = np.zeros(len(first), np.int64)
        while len(several):
            ends = cuts[cuts >= limits.array_rows]
            part, several = np.split(several, ends[:1]) if len(ends) else (several, several[:0])
            cuts = cuts[cuts >= len(part)] - len(part)
            row, start, end = _covered(distinct[part, :AROUND], distinct[part, AROUND].astype(np.int64), distinct[part, AROUND + 1].astype(np.int64), least[part])
            np.minimum.at(begin, part[row], start)
            np.maximum.at(stop, part[row], end)
        at = 0
        for uid, number, _, own in asked:
            g = group[at : at + len(own)]
            at += len(own)
            yield _message(uid, [(bucket, _squeeze(number, least[g], begin[g].astype(np.uint8), stop[g].astype(np.uint8)))])

    return answer


def _gone(head: dict, answers: list[dict], data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a document with a smaller id than a text's least has each byte."""
    edge = np.zeros(len(data) + 1, np.int32)
    if answers:
        said = [_unsqueeze(a["data"], (np.uint32, 0), (np.int64, 0), (np.uint8, 0), (np.uint8, 0)) for a in answers]
        number, least, begin, stop = (np.concatenate(x) for x in zip(*said, strict=True))
        places, hashes = anchors(data, lengths)
        of, cut = number // 32, number % 32 != WHOLE
        asked = np.flatnonzero(np.isin(hashes, hashes[np.unique(of)]))
        key, own, at, doc, group = _questions(data, lengths, places, asked, np.isin(hashes[asked], hashes[np.unique(of[cut])]))
        order = np.argsort(own)
        place = order[np.searchsorted(own, number, sorter=order)]
        known = np.full(group.max() + 1, -1)
        known[group[place]] = np.arange(len(number))
        answer = known[group]
        low, high = key[:, AROUND] & (WINDOW - 1), key[:, AROUND + 1]
        later = _owners(head)[doc] > least[answer]
        a = np.where(later, low, begin[answer]).astype(np.int64)
        b = np.where(later, high, stop[answer]).astype(np.int64)
        real = (b - a >= WIDTH) & (answer >= 0)
        np.add.at(edge, (at + a)[real], 1)
        np.add.at(edge, (at + b)[real], -1)
    return np.cumsum(edge, dtype=np.int32)[: len(data)] > 0


def _apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase three: remove the covered bytes of every text of a batch.

    Of equal texts in a batch, those with a larger id are repeats from end to end.
    """
    empty = hashlib.sha256().hexdigest()
    for head, answers in _joined(rows):
        data, lengths = _open(head["text"], head["lengths"])
        gone = _gone(head, answers, data, lengths)
        ends = np.cumsum(lengths)
        done = []
        for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
            own = gone[a:b]
            count = int(own.sum())
            spans = int((own[1:] & ~own[:-1]).sum() + own[0]) if count else 0
            done.append((count, spans, hashlib.sha256((data[a:b][~own] if count else data[a:b]).tobytes()).hexdigest()))
        ids, of, null = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["of"], np.int32), np.frombuffer(head["nulls"], np.uint8).astype(bool)
        again = (ids > _owners(head)[of]) & (lengths[of] >= WIDTH)
        out = [(n, 1, empty) if twice else done[t] for n, twice, t in zip(lengths[of].tolist(), again.tolist(), of.tolist(), strict=True)]
        removed, spans, hashes = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(lengths[of]), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_answers(packed: DataFrame, answers: DataFrame) -> DataFrame:
    none = F.lit(None).cast("binary")
    parts = ["ids", "nulls", "of", "lengths", "text"]
    notes = packed.select("uid", F.lit(-1).cast("long").alias("bucket"), *parts, none.alias("data"))
    said = answers.select("uid", "bucket", *[none.alias(c) for c in parts], "data")
    return notes.union(said).repartition("uid").sortWithinPartitions("uid", "bucket")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per row of docs what remains without the bytes that an earlier document has.

    A byte goes if a string of WIDTH bytes of UTF-8 that covers it also starts in
    a document with a smaller id; strings lie within one document and are judged
    on the input.  Returns id, n_bytes, n_removed, n_spans (maximal removed runs)
    and kept_sha256 of the remaining bytes.  Null texts are empty, shorter texts
    lose nothing; rows with one id are one document, which never repeats itself;
    a null id counts as the largest; an empty table gives no rows; further
    columns are ignored.  Ids must be whole numbers.  Exact: hashes only choose
    where strings meet, what meets is compared byte by byte.  Runs an action; the
    packed texts are checkpointed once and read in each phase.  A batch holds
    equal texts once.  A task has one bucket, whose size does not grow with the
    table; an anchor with limits.hot different surroundings has its
    strings dealt apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    packed = durable(rows.mapInArrow(_pack(limits), "uid long, ids binary, nulls binary, of binary, lengths binary, text binary"))
    buckets = _buckets(packed.count())
    question = "bucket long, uid long, data binary"
    dealt = lambda asked: asked.repartitionById(buckets, F.col("bucket").cast("int"))
    hashes = dealt(packed.select("uid", "lengths", "text").mapInArrow(_ask_hashes(buckets, limits), question)).mapInArrow(_answer_hashes(limits), question)
    contexts = dealt(_with_answers(packed, hashes).mapInArrow(_ask_contexts(buckets), question)).mapInArrow(_answer_contexts(limits), question)
    done = _with_answers(packed, contexts).mapInArrow(_apply, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumnRenamed("id", id_col)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document, strings of 50 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
