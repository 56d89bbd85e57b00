"""Relational analysis of experiment tables: joins, phases, pivots, JSON, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIRS = "array<struct<a:bigint,b:bigint,dist:double>>"


def unnest_pairs(runs: DataFrame, column: str = "motif_pairs") -> DataFrame:
    """One row for each motif of a JSON array column, numbered from 0."""
    keep = [c for c in runs.columns if c != column]
    return runs.select(*keep, F.posexplode(F.from_json(column, PAIRS)).alias("pos", "m")).select(*keep, "pos", "m.a", "m.b", "m.dist")


def json_path(column: str, path: str) -> Column:
    return F.get_json_object(column, path).cast("double")


def not_yet_run(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(stored, keys, "left_anti")


def latest_version(df: DataFrame, version: str = "version") -> DataFrame:
    """Rows of the highest version."""
    return df.join(F.broadcast(df.agg(F.max(version).alias(version))), version)  # one row


def phases(df: DataFrame, keys: list[str], elapsed: str) -> DataFrame:
    """Duration of each phase: from its start to the next one's of the same key."""
    at = Window.partitionBy(*keys).orderBy(elapsed)
    first = F.min(elapsed).over(Window.partitionBy(*keys))
    return df.withColumn("next", F.lead(elapsed).over(at)).withColumn("duration", F.col("next") - F.col(elapsed)).withColumn("since_first", F.col(elapsed) - first)


def best_of_group(df: DataFrame, keys: list[str], by: str, ties: bool = True) -> DataFrame:
    """Rows with the least value of each group; with ``ties`` all of them."""
    at = Window.partitionBy(*keys).orderBy(by)
    return df.withColumn("__r", (F.rank() if ties else F.row_number()).over(at)).where("__r = 1").drop("__r")


def mark_best(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    return df.withColumn("is_best", F.col(by) == F.min(by).over(Window.partitionBy(*keys)))


def pivoted(df: DataFrame, row: str, column: str, names: list[str], **values: Column) -> DataFrame:
    """Wide table with ``name_value`` columns; the names are given, so no job looks for them."""
    return df.groupBy(row).pivot(column, names).agg(*[v.alias(k) for k, v in values.items()])


def extent_ratio(df: DataFrame) -> DataFrame:
    """Largest ratio of found to exact extent by data set, from ``dataset, support, kind, extent``."""
    wide = df.groupBy("dataset", "support").pivot("kind", ["exact", "found"]).agg(F.min("extent"))
    return wide.groupBy("dataset").agg(F.max(F.try_divide("found", "exact")).alias("worst_ratio"))


def linear_fit(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def quadratic_fit(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``c0 + c1 x + c2 x^2`` by least squares from sums alone, with the constant taken out first."""
    s = {k: F.sum(F.pow(F.col(x), k)) for k in range(5)}
    t = {k: F.sum(F.pow(F.col(x), k) * F.col(y)) for k in range(3)}
    own = df.groupBy(key).agg(*[v.alias(f"s{k}") for k, v in s.items()], *[v.alias(f"t{k}") for k, v in t.items()])
    about = lambda p, q: F.col(f"s{p + q}") - F.col(f"s{p}") * F.col(f"s{q}") / F.col("s0")
    with_y = lambda p: F.col(f"t{p}") - F.col(f"s{p}") * F.col("t0") / F.col("s0")
    c2 = F.try_divide(with_y(2) - about(1, 2) * F.try_divide(with_y(1), about(1, 1)), about(2, 2) - F.try_divide(about(1, 2) * about(1, 2), about(1, 1)))
    own = own.withColumn("c2", c2).withColumn("c1", F.try_divide(with_y(1) - about(1, 2) * F.col("c2"), about(1, 1)))
    return own.select(key, ((F.col("t0") - F.col("s1") * F.col("c1") - F.col("s2") * F.col("c2")) / F.col("s0")).alias("c0"), "c1", "c2")


def predicted(fit: DataFrame, wanted: DataFrame, key: str, x: str) -> DataFrame:
    """Values of a quadratic (or, without ``c2``, linear) fit at the ``x`` of ``wanted``."""
    names = [c for c in ("c0", "c1", "c2") if c in fit.columns]
    value = sum((F.col(c) * F.pow(F.col(x), int(c[1])) for c in names[1:]), F.col(names[0]))
    return wanted.join(fit, key).select(*wanted.columns, value.alias("predicted"))


def fill_missing(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows with ``y`` where it is null taken from the quadratic fit of their key, and a flag for it."""
    fit = quadratic_fit(df.where(F.col(y).isNotNull()), key, x, y)
    value = F.col("c0") + F.col("c1") * F.col(x) + F.col("c2") * F.col(x) * F.col(x)
    out = df.join(fit, key, "left").withColumn("is_predicted", F.col(y).isNull()).withColumn(y, F.coalesce(F.col(y), value))
    return out.select(*df.columns, "is_predicted")


def models(df: DataFrame, key: str, x: str, y: str, degree: int = 2) -> DataFrame:
    """``key, coefficients, residual`` of a polynomial of any degree for each group, the constant first; one model a row.

    A group's design matrix is reduced to its normal equations batch by batch, so a large group is never held.
    """
    names = [f"p{k}" for k in range(2 * degree + 1)]
    powers = [F.sum(F.pow(F.col(x), k)).alias(n) for k, n in enumerate(names)]
    products = [F.sum(F.pow(F.col(x), k) * F.col(y)).alias(f"q{k}") for k in range(degree + 1)]
    sums = df.groupBy(key).agg(*powers, *products, F.sum(F.col(y) * F.col(y)).alias("yy"))

    def solve(frames):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                a = np.array([[r[names[i + j]] for j in range(degree + 1)] for i in range(degree + 1)], float)
                b = np.array([r[f"q{i}"] for i in range(degree + 1)], float)
                c = np.linalg.lstsq(a, b, rcond=None)[0]
                rows.append((r[key], c.tolist(), float(max(r["yy"] - 2 * c @ b + c @ a @ c, 0.0))))
            yield pd.DataFrame(rows, columns=[key, "coefficients", "residual"])

    return sums.mapInPandas(solve, f"`{key}` {df.schema[key].dataType.simpleString()}, coefficients array<double>, residual double")


def collapsed(column: str, groups: dict[str, str], other: str = "other") -> Column:
    """Levels of a factor by the group they belong to."""
    out = F.lit(other)
    for level, group in groups.items():
        out = F.when(F.col(column) == level, group).otherwise(out)
    return out


def slice_min(df: DataFrame, keys: list[str], by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of least value of each group, ties by further columns."""
    at = Window.partitionBy(*keys).orderBy(by, *ties)
    return df.withColumn("__r", F.row_number().over(at)).where(F.col("__r") <= n).drop("__r")


class Targets:
    """Named results that are made from others, each once, and kept as Parquet in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.rules, self.made = spark, folder, {}, []

    def rule(self, name: str, make, *needs: str) -> None:  # noqa: ANN001
        self.rules[name] = (make, needs)

    def get(self, name: str, _above: tuple = ()) -> DataFrame:
        if name in _above:
            raise ValueError(f"{name} needs itself")
        path = f"{self.folder}/{name}"
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            make, needs = self.rules[name]
            make(*[self.get(n, (*_above, name)) for n in needs]).write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def parts_of_name(column: str) -> list[Column]:
    """Name and size of a data set such as ``ecg-250000``: without a number the size is null."""
    name = F.regexp_replace(column, r"-[0-9]+$", "")
    size = F.when(F.col(column).rlike(r"-[0-9]+$"), F.regexp_extract(column, r"-([0-9]+)$", 1).try_cast("long"))
    return [name.alias("name"), size.alias("size")]


def sweep(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few literal parameter lists."""
    out = None
    for name, own in values.items():
        part = spark.createDataFrame([(v,) for v in own], [name])
        out = part if out is None else out.crossJoin(part)
    return out
