"""Motiflets: for each support the set of subsequences with the smallest extent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.operators import kernel
from motifloom.operators import pairs as P
from motifloom.operators.lsh import verified
from motifloom.operators.windows import znormalized_subsequences


def rooted_sets(knn: DataFrame) -> DataFrame:
    """``series_id, root, indices`` for each root and support: the root and its nearest neighbours so far."""
    upto = Window.partitionBy("series_id", "src").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sets = knn.withColumn("near", F.collect_list("dst").over(upto)).withColumnRenamed("src", "root")
    return sets.select("series_id", "root", (F.col("rank") + 1).cast("int").alias("support"), F.concat(F.array("root"), F.col("near")).alias("indices"))


def extents(knn: DataFrame, pairs: DataFrame) -> DataFrame:
    """``series_id, root, support, indices, extent``: the largest distance within each rooted set.

    The distances of a set's new member to the members before it come from
    ``pairs``; extents are their running maximum over the supports.
    """
    upto = Window.partitionBy("series_id", "src").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    new = knn.withColumn("before", F.collect_list("dst").over(upto))
    new = new.select("series_id", F.col("src").alias("root"), "rank", "dst", "d", F.explode_outer("before").alias("old"))
    ask = new.withColumn("a", F.least("dst", "old")).withColumn("b", F.greatest("dst", "old"))
    known = pairs.select("series_id", "a", "b", F.col("d").alias("inner"))
    each = ask.join(known, ["series_id", "a", "b"], "left").groupBy("series_id", "root", "rank").agg(F.greatest(F.max("d"), F.max("inner")).alias("most"))
    running = Window.partitionBy("series_id", "root").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    grown = each.withColumn("extent", F.max("most").over(running)).select("series_id", "root", (F.col("rank") + 1).cast("int").alias("support"), "extent")
    return rooted_sets(knn).join(grown, ["series_id", "root", "support"])


def best_by_support(sets: DataFrame, top_k: int = 1, ez: int | None = None) -> DataFrame:
    """The set of least extent for each support, ties by positions; with ``top_k`` the next ones that do not overlap it."""
    whole = sets.withColumn("indices", F.array_sort("indices"))
    if top_k == 1:
        best = whole.groupBy("series_id", "support").agg(F.min(F.struct("extent", "indices")).alias("m"))
        return best.select("series_id", "support", "m.indices", "m.extent")
    rows, chosen = [], {}
    for r in whole.select("series_id", "support", "indices", "extent").distinct().orderBy("support", "extent", "indices").toLocalIterator():
        own = chosen.setdefault((r["series_id"], r["support"]), [])
        if len(own) < top_k and not any(abs(x - y) < ez for o in own for x in o for y in r["indices"]):
            own.append(r["indices"])
            rows.append((r["series_id"], r["support"], r["indices"], r["extent"]))
    return sets.sparkSession.createDataFrame(rows, "series_id string, support int, indices array<long>, extent double")


def motiflets_exact(series: DataFrame, w: int, support: int, ez: int, top_k: int = 1, tier: str = "kernel") -> DataFrame:
    """``series_id, support, indices, extent`` for every support from 2 on."""
    if tier == "kernel":
        held = kernel.collected(series)
        if held is not None:
            return best_by_support(kernel.sets(series.sparkSession, held, w, support, ez, top_k == 1), top_k, ez)
        knn = P.knn_kernel(series, w, support - 1, ez, P.KERNEL_TILE).persist()  # too long for a task to hold
        return best_by_support(extents(knn, _inner(series, w, knn)), top_k, ez)
    pairs = P.all_pairs(series, w, ez).withColumn("d", F.round("d", 6)).persist()
    return best_by_support(extents(P.knn_nonoverlapping(pairs, support - 1, ez), pairs), top_k, ez)


def _inner(series: DataFrame, w: int, knn: DataFrame) -> DataFrame:
    """``series_id, a, b, d`` of the pairs of neighbours that a root has: a few for each root."""
    near = knn.groupBy("series_id", "src").agg(F.collect_list("dst").alias("near")).select("series_id", "near", F.explode("near").alias("x"))
    both = near.select("series_id", "x", F.explode("near").alias("y")).where("x < y").select("series_id", F.col("x").alias("a"), F.col("y").alias("b"))
    return verified(both, znormalized_subsequences(series, w)).withColumn("d", F.round("d", 6))


def sets_of_pairs(pairs: dict[tuple[int, int], float], support: int, ez: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
    """Support, extent and members of the rooted sets that known pairs (the smaller position first) give; a set whose members were not all compared is left out."""
    near: dict[int, list[tuple[float, int]]] = {}
    for (a, b), d in pairs.items():
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    for root, others in near.items():
        members, extent = [root], 0.0
        for d, j in sorted(others):
            if any(abs(j - m) < ez for m in members):
                continue
            inner = [pairs.get((min(j, m), max(j, m))) for m in members[1:]]
            if None in inner:
                break
            members.append(j)
            extent = max(extent, d, *inner)
            yield len(members), extent, tuple(sorted(members))
            if len(members) == support:
                break


def rooted(series: DataFrame, w: int, support: int, ez: int, roots: int = 64) -> DataFrame:
    """Sets of least extent among those around ``roots`` evenly spaced subsequences: upper bounds of the best extents, in one pass."""
    last = series.groupBy("series_id").agg((F.max("i") + 1 - w).alias("n"))
    knn = P.knn_kernel(series, w, support - 1, ez)
    near = knn.join(F.broadcast(last), "series_id").where(F.expr(f"src % greatest(1, n div {roots}) = 0")).drop("n").persist()  # one row a series
    return best_by_support(extents(near, _inner(series, w, near)))
