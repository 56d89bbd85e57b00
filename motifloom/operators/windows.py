"""Sliding subsequences and their statistics.

A series of ``n`` values has subsequences at ``0 <= i < n - w``.  Frames run in
tiles of each series that share ``w - 1`` values with the next tile, so that a long
series is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.functions.distance import FLAT, znormalized

TILE = 1 << 15


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg((F.max("i") + 1).alias("n"))


def _tiled(series: DataFrame, w: int, tile: int) -> DataFrame:
    tile = max(tile, 4 * w)
    own = F.expr(f"i div {tile}")
    tiles = F.when((F.col("i") % tile < w) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return series.select("series_id", "i", "v", F.explode(tiles).alias("tile")), own


def framed(series: DataFrame, w: int, columns: dict[str, callable], tile: int = TILE) -> DataFrame:
    """``series_id, i`` and aggregates over the ``w`` values from each valid start."""
    rows, own = _tiled(series, w, tile)
    frame = Window.partitionBy("series_id", "tile").orderBy("i").rowsBetween(0, w - 1)
    out = rows.select("series_id", "i", "tile", *[c(frame).alias(k) for k, c in columns.items()]).where(F.col("tile") == own)
    return out.join(lengths(series), "series_id").where(F.col("i") < F.col("n") - w).drop("tile", "n")


def subsequences(series: DataFrame, w: int, tile: int = TILE) -> DataFrame:
    """``series_id, i, x``: the values of each subsequence."""
    return framed(series, w, {"x": lambda f: F.collect_list("v").over(f)}, tile)


def rolling_stats(series: DataFrame, w: int, tile: int = TILE) -> DataFrame:
    """``series_id, i, m, sd, is_flat`` with the population standard deviation of each frame."""
    out = framed(series, w, {"m": lambda f: F.avg("v").over(f), "sd": lambda f: F.stddev_pop("v").over(f)}, tile)
    return out.withColumn("is_flat", F.col("sd") <= FLAT)


def rolling_stats_fast(series: DataFrame, w: int, tile: int = TILE) -> DataFrame:
    """The same from prefix sums, which start anew in every tile and are taken about the tile's first value."""
    rows, own = _tiled(series, w, tile)
    part = Window.partitionBy("series_id", "tile").orderBy("i")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("base", F.first("v").over(upto)).withColumn("c", F.col("v") - F.col("base"))
    rows = rows.withColumn("s", F.sum("c").over(upto)).withColumn("q", F.sum(F.col("c") * F.col("c")).over(upto))
    end = lambda c: F.lead(c, w - 1).over(part)
    rows = rows.select(
        "series_id",
        "i",
        "tile",
        (F.col("base") + (end("s") - F.col("s") + F.col("c")) / w).alias("m"),
        ((end("s") - F.col("s") + F.col("c")) / w).alias("mc"),
        ((end("q") - F.col("q") + F.col("c") * F.col("c")) / w).alias("qc"),
    ).where(F.col("tile") == own)
    out = rows.join(lengths(series), "series_id").where(F.col("i") < F.col("n") - w)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("qc") - F.col("mc") * F.col("mc")))
    return out.select("series_id", "i", "m", sd.alias("sd")).withColumn("is_flat", F.col("sd") <= FLAT)


def windowed(series: DataFrame, w: int, precise: bool = True, tile: int = TILE) -> DataFrame:
    return rolling_stats(series, w, tile) if precise else rolling_stats_fast(series, w, tile)


def znormalized_subsequences(series: DataFrame, w: int, tile: int = TILE) -> DataFrame:
    """``series_id, i, x, m, sd, z`` of the subsequences that are not flat."""
    frames = {"x": lambda f: F.collect_list("v").over(f), "m": lambda f: F.avg("v").over(f), "sd": lambda f: F.stddev_pop("v").over(f)}
    out = framed(series, w, frames, tile).where(F.col("sd") > FLAT)
    return out.withColumn("z", znormalized(F.col("x"), F.col("m"), F.col("sd")))


def series_stats(series: DataFrame, w: int) -> DataFrame:
    """Values, subsequences, pairs of them, flat ones, and the largest possible distance."""
    flat = rolling_stats(series, w).groupBy("series_id").agg(F.count_if("is_flat").alias("n_flat"))
    sub = F.greatest(F.col("n") - w, F.lit(0))
    return lengths(series).join(flat, "series_id", "left").select(
        "series_id",
        "n",
        sub.alias("n_subsequences"),
        F.expr(f"greatest(n - {w}, 0) * (greatest(n - {w}, 0) - 1) div 2").alias("n_pairs"),
        F.coalesce("n_flat", F.lit(0)).alias("n_flat"),
        (2 * F.sqrt(F.lit(float(w)))).alias("max_distance"),
    )


def random_root(series: DataFrame, w: int, seed: int = 0) -> DataFrame:
    """``series_id, i``: one subsequence of each series that is not flat, drawn by a hash of its position."""
    rows = rolling_stats(series, w).where("NOT is_flat")
    drawn = rows.groupBy("series_id").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "i").alias("h"), "i")).alias("m"))
    return drawn.select("series_id", "m.i")


def exploded(df: DataFrame, array: str, value: str, *keep: str | Column) -> DataFrame:
    return df.select(*keep, F.posexplode(array).alias("pos", value))
