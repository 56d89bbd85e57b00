"""Result sinks."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def motiflet_lines(motiflets: DataFrame) -> DataFrame:
    """Ragged lines ``extent, i1, i2, ...``."""
    return motiflets.select(F.concat_ws(", ", F.col("extent").cast("string"), F.transform("indices", lambda x: x.cast("string"))).alias("value"))


def write_motiflets(motiflets: DataFrame, path: str) -> None:
    motiflet_lines(motiflets).write.mode("overwrite").text(path)


def write_motif_pairs(motifs: DataFrame, path: str) -> None:
    """Confirmed pairs as ``a, b, dist``; without a column ``confirmed`` all count."""
    rows = motifs.where("confirmed") if "confirmed" in motifs.columns else motifs
    rows.select("a", "b", F.col("distance").alias("dist")).write.mode("overwrite").csv(path, header=True)


def write_profile(profile: DataFrame, path: str, threshold: float | None = None) -> None:
    """Distance profile as ``i, distance``, up to a threshold."""
    rows = profile if threshold is None else profile.where(F.col("distance") <= threshold)
    rows.select("i", "distance").write.mode("overwrite").csv(path, header=True)


def write_sampled_distances(distances: DataFrame, w: int, path: str) -> None:
    """Sampled distances as ``w, distance``."""
    distances.select(F.lit(w).alias("w"), F.col("d").alias("distance")).write.mode("overwrite").csv(path, header=True)


def write_deviations(stats: DataFrame, path: str) -> None:
    """Rolling standard deviations in order, one a line."""
    stats.orderBy("i").select(F.col("sd").cast("string").alias("value")).write.mode("overwrite").text(path)


def latex_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows of a result as a LaTeX tabular."""
    lines = [" & ".join(df.columns) + r" \\ \hline"]
    lines += [" & ".join("" if v is None else str(v) for v in r) + r" \\" for r in df.limit(rows).collect()]
    head = "l" * len(df.columns)
    return "\n".join([rf"\begin{{tabular}}{{{head}}}", *lines, r"\end{tabular}"])


def append_versioned(df: DataFrame, path: str, version: int) -> None:
    """Append rows with the version of their schema; later versions may have more columns."""
    df.withColumn("schema_version", F.lit(version)).write.mode("append").parquet(path)


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all versions; columns that a version lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def append_measures(measures: DataFrame, path: str) -> None:
    measures.write.mode("append").option("header", True).csv(path)


def write_series_text(series: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """Values in order, one a line."""
    out = series.orderBy("i").select(F.col("v").cast("string").alias("value")).write.mode("overwrite")
    (out.option("compression", compression) if compression else out).text(path)


def append_new(results: DataFrame, stored: DataFrame | None, keys: list[str], path: str) -> None:
    """Append the results whose keys are not stored yet, as Parquet."""
    fresh = results if stored is None else results.join(stored, keys, "left_anti")
    fresh.write.mode("append").parquet(path)


class Observations:
    """Log of ``elapsed_s, repetition, prefix, name, value`` kept on the driver and turned into a DataFrame."""

    def __init__(self) -> None:
        self.begin, self.rows = time.monotonic(), []

    def note(self, repetition: int, prefix: int, name: str, value: float) -> None:
        self.rows.append((time.monotonic() - self.begin, repetition, prefix, name, float(value)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "elapsed_s double, repetition int, prefix int, name string, value double")

    def to_json(self) -> str:
        return json.dumps([{"elapsed_s": r[0], "repetition": r[1], "prefix": r[2], "name": r[3], "value": r[4]} for r in self.rows])

    def write(self, spark: SparkSession, path: str) -> None:
        """The log as delimited text with a header."""
        self.frame(spark).coalesce(1).write.mode("append").option("header", True).csv(path)


class Costs:
    """Running averages of what steps cost, by name."""

    def __init__(self) -> None:
        self.sums: dict[str, tuple[int, float]] = {}

    def add(self, name: str, seconds: float) -> float:
        n, mean = self.sums.get(name, (0, 0.0))
        self.sums[name] = (n + 1, mean + (seconds - mean) / (n + 1))
        return self.sums[name][1]

    def average(self, name: str) -> float | None:
        return self.sums[name][1] if name in self.sums else None
