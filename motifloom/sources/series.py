"""Series in long form ``series_id, i, v``: readers, builders and slices.

``i`` counts from 0 without gaps in each series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.sources import binary

ALL = "all"


def from_values(spark: SparkSession, values: Sequence[float], series_id: str = ALL) -> DataFrame:
    """An in-memory sequence as a series."""
    return spark.createDataFrame([(series_id, i, float(v)) for i, v in enumerate(values)], "series_id string, i long, v double")


def numbered(df: DataFrame, order: Sequence[str | Column], value: str | Column, by: str | None = None, parts: int | None = None) -> DataFrame:
    """Number the rows of each series in ``order``; without ``by`` all rows are one series.

    Rows are range-partitioned by series and order, counted by partition and
    series, and offset, so no task sees a whole series.
    """
    value = F.col(value) if isinstance(value, str) else value
    spark = df.sparkSession
    keys = [f"__o{k}" for k in range(len(order))]
    name = F.lit(ALL) if by is None else F.col(by).cast("string")
    rows = df.select(name.alias("series_id"), *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys)], value.cast("double").alias("v"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = ["series_id", *keys] if by is not None else keys
    placed = rows.repartitionByRange(parts, *at).sortWithinPartitions(*at).withColumn("__at", F.monotonically_increasing_id()).persist()
    placed = placed.withColumn("__p", F.shiftright("__at", 33)).withColumn("__pos", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("__p", "series_id").agg(F.count(F.lit(1)).alias("n"), F.min("__pos").alias("first"))
    before = Window.partitionBy("series_id").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition a series is in
    starts = counts.select("__p", "series_id", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    own = placed.join(starts, ["__p", "series_id"])
    return own.select("series_id", (F.col("start") + F.col("__pos")).cast("long").alias("i"), "v")


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """One number a line of ``line_no, value``; blank lines are skipped and take no position.

    Strict parsing fails on a line that is not a number; otherwise such lines are left out (see :func:`rejected_lines`).
    """
    text = F.trim("value")
    number = text.cast("double") if strict else text.try_cast("double")
    out = lines.where(text != "").select("line_no", number.alias("v"))
    return out if strict else out.where(F.col("v").isNotNull())


def rejected_lines(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    return lines.where((text != "") & text.try_cast("double").isNull())


def read_text(spark: SparkSession, path: str, prefix: int | None = None, strict: bool = True) -> DataFrame:
    """A text file with one number a line, compressed or not by its extension, in file order."""
    rows = parse_lines(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()), strict)
    # of a prefix each task keeps that many lines, and only they are numbered
    return numbered(rows if prefix is None else rows.orderBy("line_no").limit(prefix), ["line_no"], "v")


def read_csv(spark: SparkSession, path: str, column: int | str = 0, sep: str = ",", header: bool = False, names: Sequence[str] | None = None, strict: bool = True) -> DataFrame:
    """One column of a delimited file as a series, in file order; ``names`` names the columns of a file without a header.

    Empty cells are skipped.  Strict reading fails on a cell that is not a number; otherwise such cells are skipped as well.
    """
    rows = spark.read.csv(path, sep=sep, header=header, schema=None if names is None else ", ".join(f"`{n}` string" for n in names))
    name = rows.columns[column] if isinstance(column, int) else column
    lines = rows.select(F.monotonically_increasing_id().alias("line_no"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value"))
    return numbered(parse_lines(lines, strict), ["line_no"], "v")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON documents, one a file or an array of them, over any number of lines."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A numeric array of each npz, mat (version 5) or wav file as a series named after the file, flattened; ``name`` picks the array."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = binary.array_of(file, content, name)
                ids = pa.array([file.rsplit("/", 1)[-1]] * len(values), pa.string())
                for k in range(0, len(values), 1 << 16):
                    own = values[k : k + (1 << 16)]
                    yield pa.record_batch([ids.slice(k, len(own)), pa.array(np.arange(k, k + len(own))), pa.array(own)], names=["series_id", "i", "v"])

    return files.mapInArrow(unpack, "series_id string, i long, v double")


#: Where named data sets are: a name and the path of a text file with one number a line.
DATASETS: dict[str, str] = {}


def register_dataset(name: str, path: str) -> None:
    DATASETS[name] = path


def load_dataset(spark: SparkSession, name: str, prefix: int | None = None) -> DataFrame:
    """A registered data set; nothing is downloaded."""
    if name not in DATASETS:
        raise KeyError(f"no data set {name!r} is registered; known are {sorted(DATASETS)}")
    return read_text(spark, DATASETS[name], prefix)


def prefix_of(series: DataFrame, n: int) -> DataFrame:
    return series.where(F.col("i") < n)


def centre_slice(series: DataFrame, centre: int, n: int) -> DataFrame:
    """Values ``centre - n`` to before ``centre + n``, numbered anew."""
    low = max(centre - n, 0)
    return series.where((F.col("i") >= low) & (F.col("i") < centre + n)).withColumn("i", F.col("i") - low)


def positions(spark: SparkSession, low: int, high: int, step: int) -> DataFrame:
    """``i`` from ``low`` to before ``high`` in steps."""
    return spark.range(low, high, step).select(F.col("id").alias("i"))


def share_of(series: DataFrame, share: float) -> DataFrame:
    """The first ``share`` of each series, whole values."""
    ends = series.groupBy("series_id").agg(F.floor((F.max("i") + 1) * share).alias("end"))
    return series.join(F.broadcast(ends), "series_id").where(F.col("i") < F.col("end")).drop("end")  # one row a series


def downsample(series: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th value, at positions divided by ``step``, for display."""
    return series.where(F.col("i") % step == 0).select("series_id", F.expr(f"i div {step}").alias("i"), "v")


def normal_steps(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``series_id, i, v`` of standard normal values that any engine with MD5 can make again: two uniforms of a digest, turned by Box and Muller."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    uniform = lambda at: F.conv(F.substr(digest, F.lit(at), F.lit(8)), 16, 10).cast("long")
    first, second = (uniform(1) + 1) / float(1 << 32), uniform(9) / float(1 << 32)
    return spark.range(n).select(F.lit(ALL).alias("series_id"), F.col("id").alias("i"), (F.sqrt(-2 * F.ln(first)) * F.cos(2 * F.pi() * second)).alias("v"))


def random_walk(spark: SparkSession, n: int, seed: int = 0, chunk: int = 1 << 16) -> DataFrame:
    """Cumulative sum of standard normal steps."""
    return running_sum(normal_steps(spark, n, seed), chunk)


def running_sum(series: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Cumulative sum, chunk by chunk with the sums of the chunks before, so a long series is not one task."""
    piece = F.expr(f"i div {chunk}")
    totals = series.groupBy("series_id", piece.alias("piece")).agg(F.sum("v").alias("t"))
    before = Window.partitionBy("series_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("series_id", "piece", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("start"))
    inside = Window.partitionBy("series_id", "piece").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    own = series.withColumn("piece", piece).withColumn("s", F.sum("v").over(inside))
    return own.join(starts, ["series_id", "piece"]).select("series_id", "i", (F.col("s") + F.col("start")).alias("v"))


def spined(sums: DataFrame, slot: str, step: str, seconds: int, digits: int = 2) -> DataFrame:
    """Sums by time slot on a spine without gaps, gaps 0, rounded to two digits and numbered.

    ``sums`` has ``series_id, slot, s``; the spine is shared by all series and starts and ends with the data.
    Slots are ``seconds`` apart, so positions are differences of times and no task orders a series.
    """
    ends = sums.agg(F.min(slot).alias("lo"), F.max(slot).alias("hi"))
    times = ends.select(F.col("lo"), F.explode(F.sequence("lo", "hi", F.expr(step))).alias(slot))
    grid = sums.select("series_id").distinct().crossJoin(F.broadcast(times))  # a row for each series and slot: the result itself
    apart = F.unix_seconds(F.col(slot).cast("timestamp")) - F.unix_seconds(F.col("lo").cast("timestamp"))
    at = (F.datediff(slot, "lo") if seconds == 86400 else apart / seconds).cast("long")
    return grid.join(sums, ["series_id", slot], "left").select("series_id", at.alias("i"), F.round(F.coalesce("s", F.lit(0.0)), digits).alias("v"))


def hourly(events: DataFrame, by: Column | None = None) -> DataFrame:
    """Hourly sums of event values."""
    key = F.lit(ALL) if by is None else by
    sums = events.groupBy(key.alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("h")).agg(F.sum("value").alias("s"))
    return spined(sums.withColumn("h", F.col("h").cast("timestamp")), "h", "interval 1 hour", 3600)


def raw(events: DataFrame) -> DataFrame:
    """Event values in the order of their times."""
    return numbered(events, ["ts", "event_id"], "value")


def quarter_hourly(events: DataFrame, start: str = "2024-01-01", slots: int = 2880) -> DataFrame:
    """Sums of event values in ``slots`` quarters of an hour from ``start``."""
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(start)))) / 900_000_000).cast("long")
    sums = events.groupBy(slot.alias("i")).agg(F.sum("value").alias("s"))
    grid = events.sparkSession.range(slots).select(F.col("id").alias("i"))
    return grid.join(sums, "i", "left").select(F.lit(ALL).alias("series_id"), "i", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("v"))


def planted(events: DataFrame) -> DataFrame:
    """The quarter-hour series with five noisy, rescaled copies of earlier stretches from position 2000 on."""
    base = quarter_hourly(events)
    own = base.withColumnRenamed("v", "own")
    early = base.select((F.col("i") + 1600).alias("i"), F.col("v").alias("early"))
    there = F.col("i").between(2000, 2431) & (F.col("i") % 100 < 32)
    noise = 0.5 * (F.floor((F.col("i") - 2000) / 100) + 1) * (F.col("i") % 7)
    v = F.when(there, F.col("early") * 1.5 + 3 + noise).otherwise(F.col("own"))
    return own.join(early, "i", "left").select("series_id", "i", v.alias("v"))


def daily_revenue(lineitem: DataFrame) -> DataFrame:
    """Revenue by day of shipment."""
    sums = lineitem.groupBy(F.lit(ALL).alias("series_id"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("d")).agg(
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("s")
    )
    return spined(sums, "d", "interval 1 day", 86400, 4)
