"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Links that the driver joins itself (8 MB); each round costs as many tasks on a few links as on many.
SMALL = 1 << 19


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels, each the least number of a component, after links between the numbers a and b."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels != (up := labels[labels])).any():
            labels = up
    return labels


def _of_few(edges: DataFrame) -> DataFrame:
    """components of at most SMALL links."""
    links = edges.select("u", "v").toArrow()
    nodes, at = np.unique(np.concatenate([links.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
    labels = merge(np.arange(len(nodes)), at[: len(links)], at[len(links) :])
    moved = labels != np.arange(len(nodes))
    found = pa.table({"node": nodes[moved], "component": nodes[labels[moved]]})
    return durable(edges.sparkSession.createDataFrame(found, "node long, component long"))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of edges(u long, v long) but the roots.

    component is the smallest node reachable.  Each round hangs the larger
    neighbours of a node on its least neighbour, then the smaller ones, with
    joins and partial minima only: no neighbour list is gathered anywhere.  The
    rounds needed grow with the logarithm of a component's size.  As soon as no
    more than SMALL links are left the driver joins them.  Runs actions;
    each round is checkpointed.  Self links and repeated links are harmless.
    """
    u, v = F.col("u"), F.col("v")
    now = durable(edges.where("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), small=True)
    seen = _signature(now)
    for _ in range(max_rounds):
        if seen[0] <= SMALL:
            return _of_few(now)
        both = now.union(now.select(v, u))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = durable(small.distinct(), small=True)
        last, seen = seen, _signature(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(u.alias("node"), v.alias("component"))
