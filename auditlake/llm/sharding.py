"""Hilbert-curve sharding, with DataFrame functions only.

Several metadata dimensions are quantised to a few equal-frequency levels, the
levels of a row are one cell of a grid, the cells are visited in Hilbert order
and the visit is cut into runs of equal length.  Rows of a run are close in all
dimensions at once, so the minima and maxima of a file prune on any of them.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import global_rank, literal_lookup, table

#: Bins of the exact histogram from which a dimension's levels are cut; bin 0 holds nulls.
HISTOGRAM_BINS = 4096
#: Bytes of a string that order it, after the prefix that all values share.
STRING_BYTES = 6


def _prefix_key(value: Column, shared: int) -> Column:
    """The next STRING_BYTES bytes of a string as a number; keeps byte order."""
    raw = F.substring(F.encode(value, "UTF-8"), shared + 1, STRING_BYTES)
    return F.conv(F.rpad(F.hex(raw), 2 * STRING_BYTES, "0"), 16, 10).cast("double")


def _shared_prefix(low: str | None, high: str | None) -> int:
    return len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))


def hilbert_index(df: DataFrame, axes: Sequence[str], bits: int, name: str) -> DataFrame:
    """Append the Hilbert index of the integer columns axes, each below 2**bits.

    Every step of the axes-to-transpose walk is a projection of its own, so the
    expressions stay small and inside generated code.
    """
    n, x = len(axes), [f"__h{i}" for i in range(len(axes))]
    df = df.withColumns({x[i]: F.col(a).cast("int") for i, a in enumerate(axes)})
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            bit = F.col(x[i]).bitwiseAND(F.lit(q)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(p))
            if i == 0:
                df = df.withColumn(x[0], F.when(bit, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0])))
            else:
                df = df.withColumns({x[0]: F.when(bit, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0]).bitwiseXOR(swap)), x[i]: F.when(bit, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))})
        q >>= 1
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0)
    q = 1 << (bits - 1)
    while q > 1:
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        q >>= 1
    df = df.withColumn("__turn", turn)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            digit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("__turn")), b).bitwiseAND(F.lit(1))
            index = F.shiftleft(index, 1).bitwiseOR(digit.cast("long"))
    return df.withColumn(name, index).drop(*x, "__turn")


def quantise(df: DataFrame, dims: dict[str, str], bits: int) -> DataFrame:
    """Replace each column of dims by its equal-frequency level, 0 to 2**bits - 1.

    dims maps a column to ``linear``, ``log`` (numbers) or ``text``.  An exact
    histogram over all rows, of at most HISTOGRAM_BINS + 1 bins a dimension,
    decides the levels; runs two aggregations.  Null counts as the least value.
    """
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bins = {}
    for c, kind in dims.items():
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        if kind == "text":
            shared = _shared_prefix(lo, hi)
            key = _prefix_key(F.col(c), shared)
            pad = lambda v: float(int.from_bytes((v or "").encode()[shared : shared + STRING_BYTES].ljust(STRING_BYTES, b"\0"), "big"))  # noqa: B023, E731
            lo, hi = pad(lo), pad(hi)
        elif kind == "log":
            key = F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
            lo, hi = [float(x) for x in df.sparkSession.range(1).select(F.log1p(F.lit(max(float(lo or 0), 0.0))), F.log1p(F.lit(max(float(hi or 0), 0.0)))).first()]
        else:
            key, lo, hi = F.col(c).cast("double"), float(lo or 0), float(hi or 0)
        width = (hi - lo) or 1.0
        place = F.floor((key - F.lit(lo)) / F.lit(width) * (HISTOGRAM_BINS - 1)).cast("int")
        bins[c] = F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(HISTOGRAM_BINS - 1)) + 1)
    binned = df.withColumns(bins)
    counts = binned.select(F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).alias("b")) for i, c in enumerate(dims)])).alias("x")).groupBy("x.d", "x.b").count().collect()
    levels = {}
    for i, c in enumerate(dims):
        own = {r["b"]: r["count"] for r in counts if r["d"] == i}
        total, seen, level = sum(own.values()) or 1, 0, []
        for b in range(HISTOGRAM_BINS + 1):
            level.append(min((2 * seen + own.get(b, 0)) * (1 << bits) // (2 * total), (1 << bits) - 1))
            seen += own.get(b, 0)
        levels[c] = literal_lookup(level, F.col(c)).cast("int")
    return binned.withColumns(levels)


def hilbert_shards(docs: DataFrame, n_shards: int = 16, dims: dict[str, str] | None = None, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row of docs to one of n_shards shards, contiguous runs of the Hilbert order.

    Law ``rows``: the counts of two shards differ by at most one.  Returns the
    id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (null text: 0), law,
    shard, slot (gapless in the shard, in curve order), grown_shard (null) and
    the Hilbert index.  Rows that share a cell are spread by a hash of their id,
    so a cell that holds a third of all rows spans as many partitions as it
    needs.  A null in a dimension counts as its least value; repeated rows each
    take a slot; an empty table gives no rows; further columns of docs, whatever
    their names, are ignored.  Runs aggregations and a checkpoint of the narrow
    columns; texts are never shuffled.
    """
    dims = {"source": "text", "lang": "text", "n_chars": "log", "doc_id": "linear"} if dims is None else dims
    names = {c: f"__d{i}" for i, c in enumerate(dims)}
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = docs.select(F.col(id_col).alias("__id"), F.octet_length(raw).cast("long").alias("__size"), F.crc32(raw).alias("__crc"), *[F.col(c).alias(n) for c, n in names.items()])
    base = base.select("__id", (F.col("__size") + 1).alias("__size"), "__crc", *names.values())
    cells = hilbert_index(quantise(base, {names[c]: k for c, k in dims.items()}, bits), list(names.values()), bits, "__index")
    rows = cells.select("__id", "__size", "__crc", "__index", F.xxhash64("__id").alias("__tie"))
    ranked, total = global_rank(rows, ["__index", "__tie", "__id", "__crc"], "__rank")
    shard = F.expr(f"__rank * {n_shards}L div {max(total, 1)}L")
    first = F.expr(f"(__shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("__shard", shard).select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), (F.col("__rank") - first).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), F.col("__index").alias("hilbert_index"))


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, 16 shards, law ``rows``."""
    return hilbert_shards(table(spark, sf_dir, "documents"))
