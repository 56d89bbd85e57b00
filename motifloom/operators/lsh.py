"""Hash tables of floor-quantised random projections, as equi-joins on hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.functions.distance import euclidean
from motifloom.operators.windows import znormalized_subsequences

#: Projections of a hash.
K = 8


def projections(w: int, repetitions: int, seed: int = 1234, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Normal vectors (repetition, projection, w) and uniform shares of a bucket's width, rounded so that SQL can hold them."""
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(repetitions, K, w)), digits), np.round(rng.uniform(size=(repetitions, K)), digits)


def hashes(subsequences: DataFrame, vectors: np.ndarray, shares: np.ndarray, width: float, first: int = 0) -> DataFrame:
    """``series_id, rep, i, h``: the eight floors of each repetition for rows ``series_id, i, z``.

    Full integers are kept, so no subsequence falls out of range.  Projections are
    rounded to nine digits before the floor, which keeps a result from hanging on the order of a sum.
    """
    reps = len(vectors)
    flat = vectors.reshape(reps * K, -1).T
    shift = shares.reshape(-1) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            h = np.floor(np.round((z @ flat + shift) / width, 9)).astype(np.int64).reshape(batch.num_rows, reps, K)
            at = np.repeat(np.arange(batch.num_rows), reps)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(first, first + reps, dtype=np.int32), batch.num_rows)),
                    batch.column(1).take(pa.array(at)),
                    pa.FixedSizeListArray.from_arrays(pa.array(h.reshape(-1)), K).cast(pa.list_(pa.int64())),
                ],
                names=["series_id", "rep", "i", "h"],
            )

    return subsequences.select("series_id", "i", "z").mapInArrow(run, "series_id string, rep int, i long, h array<long>")


def prefix_key(h: Column, prefix: int) -> Column:
    return F.slice(h, 1, prefix)


def packed(h: Column) -> Column:
    """Eight small floors as the bytes of one long, first in front."""
    out = F.lit(0).cast("long")
    for k in range(K):
        out = F.shiftleft(out, 8).bitwiseOR(h[k].bitwiseAND(255))
    return out


def packed_prefix_equal(x: Column, y: Column, prefix: int) -> Column:
    return F.shiftrightunsigned(x, 8 * (K - prefix)) == F.shiftrightunsigned(y, 8 * (K - prefix))


def candidates(table: DataFrame, prefix: int, ez: int, previous: int | None = None) -> DataFrame:
    """``series_id, rep, a, b`` at least ``ez`` apart that agree on ``prefix`` floors, less those that agree on ``previous``.

    Rows carry positions and keys only.  The join is on (repetition, prefix), so
    adaptive execution splits the partitions of heavy buckets.
    """
    keyed = table.select("series_id", "rep", prefix_key(F.col("h"), prefix).alias("key"), "i", "h")
    left = keyed.withColumnRenamed("i", "a").withColumnRenamed("h", "ha")
    right = keyed.withColumnRenamed("i", "b").withColumnRenamed("h", "hb")
    out = left.join(right, ["series_id", "rep", "key"]).where(F.col("b") - F.col("a") >= ez)
    if previous is not None:
        out = out.where(prefix_key(F.col("ha"), previous) != prefix_key(F.col("hb"), previous))
    return out.select("series_id", "rep", "a", "b")


def verified(pairs: DataFrame, subsequences: DataFrame, bound: float | None = None) -> DataFrame:
    """Distinct candidate pairs with their distance, up to a bound."""
    z = subsequences.select("series_id", "i", "z")
    za, zb = z.select("series_id", F.col("i").alias("a"), F.col("z").alias("za")), z.select("series_id", F.col("i").alias("b"), F.col("z").alias("zb"))
    out = pairs.select("series_id", "a", "b").distinct().join(za, ["series_id", "a"]).join(zb, ["series_id", "b"])
    out = out.select("series_id", "a", "b", euclidean(F.col("za"), F.col("zb")).alias("d"))
    return out if bound is None else out.where(F.col("d") <= bound)


def bucket_sizes(table: DataFrame, prefix: int) -> DataFrame:
    return table.groupBy("series_id", "rep", prefix_key(F.col("h"), prefix).alias("key")).agg(F.count(F.lit(1)).alias("c"))


def collision_profile(table: DataFrame) -> DataFrame:
    """``series_id, rep, prefix, collisions`` for all prefixes, overlapping pairs included."""
    rows = table.withColumn("prefix", F.explode(F.sequence(F.lit(1), F.lit(K))))
    sizes = rows.groupBy("series_id", "rep", "prefix", F.slice("h", F.lit(1), F.col("prefix")).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("series_id", "rep", "prefix").agg(F.expr("sum(c * (c - 1) div 2)").alias("collisions"))


def collision_counts(table: DataFrame, prefix: int, ez: int) -> DataFrame:
    """``series_id, rep, collisions`` at least ``ez`` apart; repetitions without any count 0."""
    found = candidates(table, prefix, ez).groupBy("series_id", "rep").agg(F.count(F.lit(1)).alias("collisions"))
    reps = table.select("series_id", "rep").distinct()
    return reps.join(found, ["series_id", "rep"], "left").select("series_id", "rep", F.coalesce("collisions", F.lit(0)).alias("collisions"))


def collision_estimate(table: DataFrame, prefix: int, ez: int) -> DataFrame:
    """``series_id, rep, collisions``: exact in small buckets, all pairs in buckets of more than the root of the rows."""
    total = table.groupBy("series_id", "rep").agg(F.count(F.lit(1)).alias("rows"))
    sizes = bucket_sizes(table, prefix).join(total, ["series_id", "rep"]).withColumn("large", F.col("c") > F.sqrt(F.col("rows").cast("double")))
    heavy = sizes.where("large").groupBy("series_id", "rep").agg(F.expr("sum(c * (c - 1) div 2)").alias("n"))
    light = sizes.where("NOT large AND c > 1").select("series_id", "rep", "key")
    rows = table.withColumn("key", prefix_key(F.col("h"), prefix)).join(light, ["series_id", "rep", "key"], "left_semi")
    exact = candidates(rows, prefix, ez).groupBy("series_id", "rep").agg(F.count(F.lit(1)).alias("n"))
    both = heavy.unionByName(exact).groupBy("series_id", "rep").agg(F.sum("n").alias("collisions"))
    return total.join(both, ["series_id", "rep"], "left").select("series_id", "rep", F.coalesce("collisions", F.lit(0)).alias("collisions"))


def collision_stats(counts: DataFrame) -> DataFrame:
    """Least, upper median, most and mean of collisions over repetitions."""
    ranked = Window.partitionBy("series_id").orderBy("collisions", "rep")
    size = Window.partitionBy("series_id")
    rows = counts.withColumn("r", F.row_number().over(ranked)).withColumn("n", F.count(F.lit(1)).over(size))
    return rows.groupBy("series_id").agg(
        F.min("collisions").alias("least"),
        F.max(F.when(F.col("r") == F.expr("n div 2 + 1"), F.col("collisions"))).alias("median"),
        F.max("collisions").alias("most"),
        F.avg("collisions").alias("mean"),
    )


def empirical_collision(table: DataFrame, pairs: DataFrame, prefix: int) -> DataFrame:
    """Share of repetitions in which the given pairs ``a, b`` agree on a prefix."""
    h = table.select("series_id", "rep", "i", prefix_key(F.col("h"), prefix).alias("key"))
    ha = h.select("series_id", "rep", F.col("i").alias("a"), F.col("key").alias("ka"))
    hb = h.select("series_id", "rep", F.col("i").alias("b"), F.col("key").alias("kb"))
    both = pairs.join(ha, "a").join(hb, ["series_id", "rep", "b"])
    return both.groupBy("a", "b").agg(F.avg((F.col("ka") == F.col("kb")).cast("int")).alias("share"))


def projection_percentiles(table: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``series_id, rep, k, p_low, p_high`` of the floors of each projection (discrete percentiles).

    Floors are counted first, so what is put in order is as many rows as there are distinct floors.
    """
    rows = table.select("series_id", "rep", F.posexplode("h").alias("k", "f"))
    counts = rows.groupBy("series_id", "rep", "k", "f").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("series_id", "rep", "k").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("series_id", "rep", "k")
    ranked = counts.withColumn("r", F.sum("n").over(upto) / F.sum("n").over(whole))
    return ranked.groupBy("series_id", "rep", "k").agg(
        F.min(F.when(F.col("r") >= low, F.col("f"))).alias("p_low"), F.min(F.when(F.col("r") >= high, F.col("f"))).alias("p_high")
    )


def hash_series(series: DataFrame, w: int, repetitions: int, width: float, seed: int = 1234) -> DataFrame:
    return hashes(znormalized_subsequences(series, w), *projections(w, repetitions, seed), width)
