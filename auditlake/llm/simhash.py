"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most r bits agree on one of r + 1 bands, so the
bands deal them to tasks (longer fingerprints, of wider radius, agree on some
band almost surely).  Inside a band, fingerprints are sorted by Gray rank,
neighbours in that order share long bit patterns, and each node of the index
holds the bits on which all fingerprints below it agree.  A search adds up the
differences of a fingerprint from the nodes on its way down and leaves a whole
group as soon as the sum exceeds r.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, in_map, key_map, settle, table, tidy
from .components import components, merge

SEED = 42
#: Children of an index node.
FANOUT = 8
#: Fingerprints of a band value that one task may hold; larger ones are dealt to pairs of blocks.
BLOCK = 4096
#: Band values or groups to be cut that are sent to every task; more of them are joined by a shuffle.
HOT = 1 << 16
#: Fingerprints from which the band values of sixteen bits would hold too many; then three of these six parts
#: (first byte, bytes) of a fingerprint make a band, as three bits leave three of them unchanged.
WIDE = 1 << 26
PARTS = ((0, 2), (2, 2), (4, 1), (5, 1), (6, 1), (7, 1))
#: (fingerprint, node) pairs that a search holds at once.
FRONTIER = 1 << 20


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a text of fewer words is one shingle, one of none has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes).tolist(), ends[width - 1 :].tolist(), strict=False)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def long_simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """words fingerprints of the distinct hashes, each under a mix of its own; their bits are independent."""
    hashes = np.unique(hashes)
    out = np.empty(words, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            h = hashes + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[i] = simhash(h ^ (h >> np.uint64(31)))
    return out


def _prints(width: int, words: int):
    def one(text: bytes | None) -> bytes:
        hashes = shingle_hashes(text, width)
        return (simhash(hashes).to_bytes(8, "big") if words == 1 else long_simhash(hashes, words).astype(">u8").tobytes()) if len(hashes) else bytes(8 * words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["id", "print"])

    return scan


def fingerprints(docs: DataFrame, width: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, print binary) of every row of docs; a print has words 64-bit numbers, big-endian."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_prints(width, words), f"id {kind}, print binary")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints of several groups, each with a tree of its own.

    Level 0 are the fingerprints (rows of 64-bit words) in Gray order; a node of
    the next level covers up to FANOUT neighbours of one group and holds the bits
    they share.  A child's own mask leaves out what its parent holds.
    """

    def __init__(self, groups: np.ndarray, prints: np.ndarray):
        self.order = np.lexsort((*[gray_rank(prints[:, i]) for i in range(prints.shape[1] - 1, -1, -1)], groups))
        self.groups, self.prints = groups[self.order], prints[self.order]
        self.levels, self.firsts, self.lasts = [], [], []
        group, pattern = self.groups, self.prints
        mask = np.full(prints.shape, ~np.uint64(0), np.uint64)
        low = high = np.arange(len(prints))
        while True:
            self.levels.append([pattern, mask])
            self.firsts.append(low)
            self.lasts.append(high)
            new = np.r_[True, group[1:] != group[:-1]]
            if new.all():
                break
            begin = np.flatnonzero(new)
            place = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
            starts = np.flatnonzero(place % FANOUT == 0)
            owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(group)]))
            differ = np.bitwise_or.reduceat(pattern ^ pattern[starts][owner], starts, axis=0)
            shared = np.bitwise_and.reduceat(mask, starts, axis=0) & ~differ
            self.levels[-1].append(starts)
            self.levels[-1][1] = mask & ~shared[owner]
            low, high = low[starts], np.maximum.reduceat(high, starts)
            group, pattern, mask = group[starts], pattern[starts], shared
        self.root_groups = group

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes of level + 1: the nodes of level below them, and how many each has."""
        starts = self.levels[level][2]
        ends = np.r_[starts[1:], len(self.levels[level][0])]
        count = ends[nodes] - starts[nodes]
        first = np.repeat(starts[nodes] - np.r_[0, np.cumsum(count)[:-1]], count)
        return first + np.arange(count.sum()), count

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level the label that all leaves below a node have, or -1."""
        out, low, high = [labels], labels, labels
        for level in range(len(self.levels) - 1):
            starts = self.levels[level][2]
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def links(self, radius: int) -> np.ndarray:
        """Per fingerprint (in the order given) a representative of its component within its group.

        Exact: two fingerprints within the radius always end in one component.
        Pairs that are joined already are not compared again.
        """
        n, words = self.prints.shape
        labels = np.arange(n)
        at = 0
        tops = np.searchsorted(self.root_groups, self.groups)
        frontier = FRONTIER // words
        while at < n:
            query = np.arange(at, min(n, at + frontier // (FANOUT * 8)))
            at = int(query[-1]) + 1
            alike = self.uniform(labels)
            stack = [(len(self.levels) - 1, query, tops[query], np.zeros(len(query), np.int64))]
            found, size = [], 0
            while stack:
                level, q, node, gap = stack.pop()
                pattern, mask = self.levels[level][:2]
                fresh = (self.lasts[level][node] > q) & (alike[level][node] != labels[q])
                q, node, gap = q[fresh], node[fresh], gap[fresh]
                for i in range(words):
                    gap = gap + np.bitwise_count((self.prints[q, i] ^ pattern[node, i]) & mask[node, i])
                    near = gap <= radius
                    q, node, gap = q[near], node[near], gap[near]
                if not level:
                    found.append((q, node))
                    size += len(q)
                    if size > frontier:
                        labels, found, size = _join(labels, found), [], 0
                        alike = self.uniform(labels)
                    continue
                for cut in range(0, len(q), frontier // FANOUT):
                    part = slice(cut, cut + frontier // FANOUT)
                    below, count = self.children(level - 1, node[part])
                    stack.append((level - 1, np.repeat(q[part], count), below, np.repeat(gap[part], count)))
            labels = _join(labels, found)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[labels]
        return out


def _join(labels: np.ndarray, found: list) -> np.ndarray:
    return merge(labels, *(np.concatenate(x) for x in zip(*found, strict=True))) if found else labels


def _near(group: np.ndarray, prints: np.ndarray, node: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links (u, v) between the nodes of each group."""
    _, where, size = np.unique(group, return_inverse=True, return_counts=True)
    many = size[where] > 1
    group, prints, node = group[many], prints[many], node[many]
    near = GrayIndex(group, prints).links(radius) if len(group) else np.empty(0, np.int64)
    moved = np.flatnonzero(near != np.arange(len(near)))
    return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[near[moved]])], names=["u", "v"])


def _read(batches: Iterator[pa.RecordBatch], words: int) -> list[np.ndarray]:
    """The columns of numbers and, last, the prints of all rows (a print is the last column)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return []
    last = parts[0].num_columns - 1
    numbers = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(last)]
    return [*numbers, np.frombuffer(b"".join(x for b in parts for x in b.column(last).to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)]


def _link(radius: int, words: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _read(batches, words):
            group, node, prints = found
            yield _near(group, prints, node, radius)
            del group, node, prints, found
            tidy()

    return link


def _leaders(bands: list[tuple[int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By leading byte the (number, other byte) of bands (a, b); a byte with an even number of bits leads.

    Bytes whose numbers differ in one bit, as those of TWISTS, have one leader in each band.
    """
    out = {}
    for i, (a, b) in enumerate(bands):
        lead, other = (b, a) if a.bit_count() % 2 else (a, b)
        out.setdefault(lead, []).append((i, other))
    return out


def _pack(bands: list[tuple[int, int]], words: int, hot: list[int]):
    """A row for each leading byte of a print, for all bands that it leads but hot ones: others has their other bytes, and from bit 48 which they are."""
    leaders, hot = _leaders(bands), np.array(hot, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, whole = batch.column(0), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            prints, whole = pa.array([x.tobytes() for x in whole[:, : 8 * words]], pa.binary()), whole.astype(np.int64)
            for lead, members in leaders.items():
                others = np.zeros(len(whole), np.int64)
                for k, (i, other) in enumerate(members):
                    a, b = bands[i]
                    others |= whole[:, other] << 8 * k | ~np.isin(i << 16 | whole[:, a] << 8 | whole[:, b], hot) * np.int64(1 << 48 + k)
                kept = pa.array(others >> 48 > 0)
                made = pa.RecordBatch.from_arrays([pa.array(lead << 8 | whole[:, lead]), pa.array(others), node, prints], names=["group", "others", "node", "print"])
                yield made.filter(kept)

    return pack


def _link_packed(radius: int, words: int, most: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _read(batches, words):
            group, others, node, prints = found
            for k in range(most):
                own = others >> 48 + k & 1 > 0
                yield _near((group << 8 | others >> 8 * k & 255)[own], prints[own], node[own], radius)
            del group, others, node, prints, found
            tidy()

    return link


def _cut(entries: DataFrame, key: str, hot: DataFrame, salt: str, how: str = "left") -> DataFrame:
    """entries with a group for each task: its key, or for keys of hot(key, blocks) each pair of blocks that it is in.

    hot is a checkpoint; up to HOT such keys go to every task, entries are
    shuffled by key for more only.  An inner join leaves the hot entries.  Runs actions.
    """
    if hot.count() <= HOT:
        hot = F.broadcast(hot)
    own = F.pmod(F.xxhash64(salt), F.col("blocks"))
    dealt = entries.join(hot, key, how).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("group", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))


def hamming_links(nodes: DataFrame, radius: int, words: int, bands: list[tuple[int, int]] | None = None, sample: int = 1, wide: bool = False) -> DataFrame:
    """Links (u, v) between nodes(node long, print binary; prints distinct) within radius bits.

    A band is two bytes of a print, 2 i and 2 i + 1 unless bands names others;
    prints that share a band meet in a task, so with radius + 1 bands no link is
    missed; wide bands, three of the six PARTS, miss none within three bits
    either.  The first words 64-bit words of a print are compared.  Not all pairs
    come out: per band value and task a spanning set of them.  A band value with
    more than BLOCK prints is cut into blocks by a hash, and each pair of blocks
    is searched apart, so no task holds more than two blocks of a value; the
    prints of a value are counted on one in sample of the nodes.  Named bands that
    share a byte travel in one row, up to HOT values that are cut aside.  Runs actions.
    """
    if bands:
        fields = [F.concat(F.lit(bytes([i])), F.substring("print", a + 1, 1), F.substring("print", b + 1, 1)) for i, (a, b) in enumerate(bands)]
    elif wide:
        fields = [F.xxhash64(F.lit(i), *[F.substring("print", a + 1, n) for a, n in three]) for i, three in enumerate(itertools.combinations(PARTS, 3))]
    else:
        fields = [F.xxhash64(F.lit(i), F.substring("print", 2 * i + 1, 2)) for i in range(4 * words)]
    compared = F.substring("print", 1, 8 * words).alias("print") if bands else F.col("print")
    entries = nodes.select(compared, "node", F.explode(F.array(*fields)).alias("band"))
    counted = nodes.where(F.pmod(F.xxhash64("node", F.lit("count")), F.lit(sample)) == 0) if sample > 1 else nodes
    size = F.col("count") * sample
    hot = counted.select(F.explode(F.array(*fields)).alias("band")).groupBy("band").count().where(size > BLOCK).select("band", F.ceil(size / BLOCK).alias("blocks"))
    hot = durable(hot, small=True)
    number = hot.count() if bands else 0

    def cut(how: str) -> DataFrame:
        return _cut(entries, "band", hot, "print", how).select("group", "node", "print").repartition("group").mapInArrow(_link(radius, words), "u long, v long")

    if not bands or number > HOT:
        return cut("left")
    most = max(map(len, _leaders(bands).values()))
    packed = nodes.select("node", "print").mapInArrow(_pack(bands, words, [int.from_bytes(r["band"], "big") for r in hot.collect()]), "group long, others long, node long, print binary")
    links = packed.repartition("group").mapInArrow(_link_packed(radius, words, most), "u long, v long")
    return links.union(cut("inner")) if number else links


def _components(prints: DataFrame, radius: int, words: int) -> DataFrame:
    """(print, component_id) of the distinct prints(id, print)."""
    nodes = durable(prints.groupBy("print").agg(F.min("id").cast("long").alias("node")))
    roots = components(hamming_links(nodes.where("node is not null"), radius, words, wide=nodes.count() > WIDE))
    return nodes.join(roots, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Texts are lower-cased (A-Z), cut into words at ``[\\x20\\x09-\\x0D]`` and into
    shingles of width words, hashed by XXH64 (seed 42).  Fingerprints within
    radius bits, three at most, link; component_id is the smallest id reachable
    (nulls aside).  Null and empty texts have fingerprint zero, which links like
    any other.  Equal fingerprints meet once before any search, so copies cost
    nothing; repeated ids keep their rows; an empty table gives no rows; further
    columns of docs are ignored.  Ids must be whole numbers.  Runs actions.
    """
    if radius > 3:
        raise ValueError("four bands find all links within three bits only")
    prints = durable(fingerprints(docs, width, 1, id_col, text_col))
    return prints.join(_components(prints, radius, 1), "print").select(F.col("id").alias(id_col), F.lower(F.hex("print")).alias("fingerprint"), "component_id")


#: 64-bit words of the long fingerprint of near_dedup, and those of them that its search compares; bands use all.
LONG, COMPARED = 8, 4
#: A band of the long fingerprint is a byte i with byte i ^ m, for each m of these: 96 bands.
TWISTS = (1, 2, 4)
#: Standard deviations by which the search goes beyond the bits that differ at the similarity in expectation.
SPREAD = 4
#: Nodes of which one is counted to find band values with many prints.
SAMPLE = 16
#: Texts of a candidate group that one task compares with as many others; larger groups are dealt to pairs of blocks.
COMPARE = 2048
#: Distinct shingles up to which a text's candidates come from its shingles themselves.
FEW = 64
#: The most frequent shingles of such texts, each in more than COMMON, that candidates come from last.
FREQUENT, COMMON = 1 << 14, 16
#: Texts whose shingles are held at once.
ROWS = 512
#: Slack for products of the similarity with whole numbers.
SLACK = 1e-9


def similarity_radius(similarity: float, words: int, spread: float = 0) -> int:
    """Bits in which fingerprints of two sets with that Jaccard similarity are expected to differ, and spread standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * words * share + spread * math.sqrt(64 * words * share * (1 - share)))


def _sets(width: int, similarity: float):
    """Per text: a number of its shingle set, the long fingerprint, and the shingles if they are few."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            nodes, prints, few = [], [], []
            for text in batch.column(2).to_pylist():
                own = np.unique(shingle_hashes(text, width))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                prints.append(long_simhash(own, LONG).astype(">u8").tobytes() if len(own) else bytes(8 * LONG))
                few.append(own.view(np.int64).tolist() if len(own) * similarity <= FEW else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary()), pa.array(few, pa.list_(pa.int64()))], names=["id", "own", "node", "print", "few"])
        tidy()

    return scan


def _least(similarity: float, frequent: list[int]):
    """(node, shingle) of the least shingles of each set, of which similar sets share one; frequent ones, the most frequent first, are the greatest."""
    known = np.array(frequent, np.int64)
    sort = np.argsort(known)
    known, rank = np.r_[known[sort], 0], np.r_[len(known) - sort, 0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(1)
            value, size = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
            at = np.searchsorted(known[:-1], value)
            order = np.lexsort((value, np.where(known[at] == value, rank[at], 0), row := np.repeat(np.arange(len(size)), size)))
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            least = place < (size - np.ceil(similarity * size - SLACK) + 1)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[least])), pa.array(value[order][least])], names=["node", "shingle"])

    return scan


def shared_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between nodes(node long, few array<long>), sets of distinct numbers: two of that Jaccard similarity are in one component.

    Sets meet if they share one of their least numbers, as any two that are
    similar enough do, whatever the order.  The order puts rare numbers first, so
    a passage that many texts quote brings only those together of which it is
    nearly all.  Runs actions.
    """
    sets = nodes.where(F.size("few") > 0).select("node", "few")
    often = sets.select(F.explode("few").alias("shingle")).groupBy("shingle").count().where(F.col("count") > COMMON)
    frequent = [r["shingle"] for r in often.orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").collect()]
    entries = durable(sets.mapInArrow(_least(similarity, frequent), "node long, shingle long"))
    first = entries.groupBy("shingle").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return entries.join(first, "shingle").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))


def _shingles_of(marked: bytes, width: int):
    """The distinct shingles of the texts that are marked."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            wanted = batch.filter(pa.array(in_map(marked, batch.column(1).to_numpy())))
            made = [np.unique(shingle_hashes(t, width)).tobytes() for t in wanted.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([wanted.column(0), wanted.column(1), pa.array(made, pa.binary())], names=["id", "own", "shingles"])
        tidy()

    return shingles


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links of the components of sets (distinct numbers each) whose Jaccard similarity is reached.

    Each set is compared once with all that no component has taken yet, so sets
    that are alike cost little.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    flat = flat[order]
    number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]], dtype=np.int32)
    flat = np.empty(len(number), np.int32)
    flat[order] = number
    mark = np.zeros(int(number.max(initial=0)) + 1, np.int32)
    del order, number
    begin = np.cumsum(sizes) - sizes
    parts = [flat[a : a + n] for a, n in zip(begin, sizes, strict=True)]
    left = np.flatnonzero(sizes)
    links, queue = [], []
    joined = starts = None
    while len(left):
        if not queue:
            queue, left, joined = [left[0]], left[1:], None
            continue
        at = queue.pop()
        if joined is None:
            joined = np.concatenate([parts[i] for i in left])
            starts = np.cumsum(sizes[left]) - sizes[left]
        mark[parts[at]] = 1
        shared = np.add.reduceat(mark[joined], starts)
        mark[parts[at]] = 0
        near = shared >= similarity * (sizes[left] + sizes[at] - shared) - SLACK
        if near.any():
            links += [(int(at), int(i)) for i in left[near]]
            queue += left[near].tolist()
            left, joined = left[~near], None
    return links


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        now, own = None, {}

        def answer() -> pa.RecordBatch:
            nodes = list(own)
            links = similar_links([np.frombuffer(x, np.uint64) for x in own.values()], similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["u", "v"])

        for batch in batches:
            for group, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    if len(own) > 1:
                        yield answer()
                    now, own = group, {}
                own[node] = shingles
        if len(own) > 1:
            yield answer()
        own = {}
        tidy()

    return verify


def _verified(rows: DataFrame, nodes: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) that span the nodes of each component of members(node, component) whose shingle sets are similar, by their exact Jaccard similarity.

    A component of more than COMPARE nodes is cut into blocks, whose pairs are dealt to tasks.
    """
    chosen = durable(nodes.join(members, "node").select("component", "node", "text.own", "text.id"), small=True)
    marked = key_map(chosen.select("own"))
    kind = rows.schema["id"].dataType.simpleString()
    a, b = rows.mapInArrow(_shingles_of(marked, width), f"id {kind}, own long, shingles binary").alias("a"), chosen.alias("b")
    known = a.join(b, (F.col("a.own") == F.col("b.own")) & F.col("a.id").eqNullSafe(F.col("b.id"))).select("component", "node", "shingles")
    hot = chosen.groupBy("component").count().where(F.col("count") > COMPARE).select("component", F.ceil(F.col("count") / COMPARE).alias("blocks"))
    hot = durable(hot, small=True)
    return _cut(known, "component", hot, "node").select("group", "node", "shingles").repartition("group").sortWithinPartitions("group").mapInArrow(_verify(similarity), "u long, v long")


def _near_rows(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, own, root) of every row of docs: own is a hash of its text, rows of one near-duplicate group share the root."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).cast("binary").alias("text"))
    sets = durable(rows.mapInArrow(_sets(width, similarity), f"id {kind}, own long, node long, print binary, few array<long>"))
    nodes = durable(sets.groupBy("node").agg(F.first("print").alias("print"), F.first("few").alias("few"), F.min(F.struct("own", "id")).alias("text")))
    bands = [(i, i ^ m) for m in TWISTS for i in range(8 * LONG) if i < i ^ m]
    links = hamming_links(nodes.select("node", "print"), similarity_radius(similarity, COMPARED, SPREAD), COMPARED, bands, SAMPLE)
    coarse = components(links.union(shared_links(nodes, similarity)))
    members = coarse.union(coarse.select("component", "component").distinct())
    roots = components(_verified(rows, nodes, members, width, similarity))
    return sets.select("id", "own", "node").join(roots, "node", "left").select("id", "own", F.coalesce("component", "node").alias("root"))


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): groups of texts linked by the exact Jaccard similarity of their shingle sets.

    Candidates come from 512-bit fingerprints of the distinct shingles, whose
    differing share of bits is the angle between the sets: a pair meets if one of
    96 bands agrees and is searched SPREAD standard deviations beyond the
    expected distance.  Texts of at most FEW shingles meet, without any loss, all
    texts that share one of their least shingles, rare ones first.  The shingles of candidates
    are then compared themselves, so no pair below the similarity links.
    component_id is the smallest id of a group (nulls aside; null where all are).
    Null and empty texts have no shingle and are one group; repeated rows are in
    one group each; an empty table gives no rows; further columns are ignored.
    Runs actions.
    """
    found = _near_rows(docs, width, similarity, id_col, text_col)
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id, a null one last.

    Of rows that tie, the one whose text has the least hash stays, of equal rows
    any single one.  Rows are told apart by id and text, so rows that only share an id are
    decided each; an empty table gives no rows; all columns stay, whatever their
    names.  Only rows of groups of several are shuffled.
    """
    found = _near_rows(docs, width, similarity, id_col, text_col)
    best = found.groupBy(F.col("root").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("best")).where("n > 1")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("own") == F.col("best.own"))
    decided = durable(found.join(best, F.col("root") == F.col("of")).select("id", "own", stays.alias("stays")).distinct(), small=True)
    return settle(docs, id_col, text_col, decided)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of three-word shingles, linked at three bits."""
    return simhash_components(table(spark, sf_dir, "documents"))
