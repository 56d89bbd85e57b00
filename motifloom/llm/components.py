"""Connected components of an edge table: by alternating star contractions in DataFrame joins, and in one task once few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.common import drop_written, written


#: Edges of a key from which it may count as hot; hot keys have more than a thousandth of all edges each, so they are 1000 at most.
HOT, HOT_KEYS = 64, 1000


#: Edges (16 bytes each) that one task finishes; more are contracted in joins first.
ONE_TASK = 1_000_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of a bounded number of edges: the larger root of an edge hangs on the smaller one, then paths are halved, until nothing moves."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(p) for p in zip(*parts))
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _with_least(edges: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """Edges with ``m``, the least ``value`` of their ``key``; edges of hot keys, such as the centre of a star, are not shuffled by it."""
    least = edges.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
    bound = max(HOT, total // HOT_KEYS)
    hot = F.broadcast(least.where(F.col("n") > bound).select(key, "m"))  # HOT_KEYS rows at most
    few = edges.join(hot.select(key), key, "left_anti").join(least.where(F.col("n") <= bound).select(key, "m"), key)
    return few.unionByName(edges.join(hot, key))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: root is the smallest node of its component.

    Every round points each node's larger neighbours, then its smaller ones, at
    the smallest node beside it, which keeps components and needs a number of
    rounds that grows with the logarithm of the longest path.  The edges of each round are written
    to the shared folder, so no lineage grows, and those of the round before are removed.  Once ``ONE_TASK`` edges or
    fewer are left, one task finishes them.  Nulls and loops are no edges.
    """
    now = written(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or (mark["n"], mark["s"]) == seen:
            break
        if mark["n"] <= ONE_TASK:
            return now.repartition(1).mapInArrow(_finish, "node long, root long")
        seen = (mark["n"], mark["s"])
        both = now.union(now.select("b", "a"))
        large = _with_least(both, "a", "b", 2 * mark["n"]).where("b > a").select(F.least("m", "a").alias("a"), "b").where("b <> a").distinct()
        # now a < b: each b's smaller neighbours and b itself point at the smallest of them
        small = _with_least(large, "b", "a", 2 * mark["n"])
        before, now = now, written(small.select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct(), "edges")
        drop_written(before)
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))
