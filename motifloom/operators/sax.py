"""Symbolic words of subsequences and random projection over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.operators.greedy import top_motifs
from motifloom.operators.lsh import verified
from motifloom.operators.windows import TILE, znormalized_subsequences

#: Breakpoints of equal-probability symbols by size of the alphabet.
BREAKPOINTS = {3: [-0.43, 0.43], 4: [-0.67, 0.0, 0.67], 5: [-0.84, -0.25, 0.25, 0.84], 6: [-0.97, -0.43, 0.0, 0.43, 0.97]}


def sax_words(series: DataFrame, w: int, segment: int, alphabet: int) -> DataFrame:
    """``series_id, i, word``: for each whole segment the number of breakpoints below its mean."""
    cuts = F.array(*[F.lit(b) for b in BREAKPOINTS[alphabet]])
    mean = lambda k: F.round(
        F.aggregate(F.slice("z", k * segment + 1, F.lit(segment)), F.lit(0.0), lambda s, e: s + e) / segment, 9
    )
    word = F.transform(F.sequence(F.lit(0), F.lit(w // segment - 1)), lambda k: F.size(F.filter(cuts, lambda b: b < mean(k))))
    return znormalized_subsequences(series, w).select("series_id", "i", word.alias("word"))


def drop_repeats(words: DataFrame) -> DataFrame:
    """Words that differ from the word of the subsequence before them.

    Flat subsequences leave gaps; the word before a gap is the last one of the tile it lies in, or of the tiles before.
    """
    tile = F.expr(f"i div {TILE}")
    rows = words.withColumn("tile", tile)
    inside = Window.partitionBy("series_id", "tile").orderBy("i")
    ends = rows.groupBy("series_id", "tile").agg(F.max(F.struct("i", "word")).alias("end"))
    across = Window.partitionBy("series_id").orderBy("tile")  # a row for each tile of a series
    before = ends.select("series_id", "tile", F.lag("end.word").over(across).alias("earlier"))
    lagged = rows.withColumn("last", F.lag("word").over(inside)).join(before, ["series_id", "tile"], "left").withColumn("last", F.coalesce("last", "earlier"))
    return lagged.where(F.col("last").isNull() | (F.col("word") != F.col("last"))).select("series_id", "i", "word")


def projection_collisions(words: DataFrame, samples: list[list[int]], ez: int) -> DataFrame:
    """``series_id, a, b, n``: in how many samples of symbol positions two words agree."""
    keys = F.array(*[F.struct(F.lit(r).alias("rep"), F.array(*[F.get("word", F.lit(p)) for p in own]).alias("key")) for r, own in enumerate(samples)])
    rows = words.select("series_id", "i", F.explode(keys).alias("k")).select("series_id", "i", "k.rep", "k.key")
    left, right = rows.withColumnRenamed("i", "a"), rows.withColumnRenamed("i", "b")
    met = left.join(right, ["series_id", "rep", "key"]).where(F.col("b") - F.col("a") >= ez)
    return met.groupBy("series_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def most_collisions(matrix: DataFrame, levels: int) -> DataFrame:
    """Pairs of the ``levels`` highest collision counts."""
    top = matrix.select("series_id", "n").distinct().withColumn("level", F.dense_rank().over(Window.partitionBy("series_id").orderBy(F.desc("n"))))
    return matrix.join(top.where(F.col("level") <= levels), ["series_id", "n"])


def projection_motifs(series: DataFrame, w: int, segment: int, alphabet: int, samples: list[list[int]], k: int, ez: int, levels: int = 4) -> DataFrame:
    """``series_id, rank, a, b, distance``: the pairs of words that collide most often, compared on their subsequences, greedily chosen."""
    words = drop_repeats(sax_words(series, w, segment, alphabet))
    likely = most_collisions(projection_collisions(words, samples, ez), levels)
    return top_motifs(verified(likely, znormalized_subsequences(series, w)), k, ez)
