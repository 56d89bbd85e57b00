"""Sharding along a Hilbert curve over quantised metadata, in DataFrame functions only.

Several metadata dimensions are quantised to a grid, rows are ordered by the
Hilbert index of their cell, and the order is cut into runs.  Neighbouring cells
of the curve are neighbours in every dimension, so the runs have narrow minima
and maxima in all dimensions at once and a reader can prune files on any of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from motifloom.llm.common import partitions, table, written

#: A curve's index is a long: dimensions times bits may not exceed this.
MAX_INDEX_BITS = 62


def hilbert_index(cell: list[int], bits: int) -> int:
    """Position of a grid cell on the Hilbert curve through a cube of side ``2**bits``."""
    x, top = list(cell), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                flip = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= flip
                x[i] ^= flip
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = 0, top
    while q > 1:
        if x[-1] & q:
            flip ^= q - 1
        q >>= 1
    x = [v ^ flip for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> b & 1)
    return index


def curve_index(cells: list[Column], bits: int) -> list[tuple[str, Column]]:
    """The same as columns, one after another by name; ``curve`` is the last and ``cells`` the one they start from."""
    levels = "array(" + ", ".join(map(str, range(bits - 1, 0, -1))) + ")"
    set_, low = "(shiftright(y[i], b) & 1L) = 1L", "(shiftleft(1L, b) - 1L)"
    turned = f"""transform(y, (v, j) -> CASE WHEN j = 0 THEN v ^ (CASE WHEN {set_} THEN {low} ELSE (y[0] ^ y[i]) & {low} END)
      WHEN j = i AND NOT ({set_}) THEN v ^ ((y[0] ^ y[i]) & {low}) ELSE v END)"""
    grey = "aggregate(cells, cast(array() as array<bigint>), (s, v) -> concat(s, array(CASE WHEN size(s) = 0 THEN v ELSE v ^ element_at(s, -1) END)))"
    flip = f"aggregate({levels}, 0L, (f, b) -> CASE WHEN (shiftright(element_at(cells, -1), b) & 1L) = 1L THEN f ^ {low} ELSE f END)"
    index = f"aggregate(sequence({bits - 1}, 0, -1), 0L, (n, b) -> aggregate(cells, n, (m, v) -> m * 2L + (shiftright(v, b) & 1L)))"
    out = [("cells", F.array(*[c.cast("long") for c in cells]))]
    if bits > 1:
        out.append(("cells", F.expr(f"aggregate({levels}, cells, (x, b) -> aggregate(sequence(0, {len(cells) - 1}), x, (y, i) -> {turned}))")))
    out.append(("cells", F.expr(grey)))
    if bits > 1:
        out += [("flip", F.expr(flip)), ("cells", F.expr("transform(cells, v -> v ^ flip)"))]
    return [*out, ("curve", F.expr(index if bits > 1 else "aggregate(cells, 0L, (m, v) -> m * 2L + (v & 1L))"))]


def numeric_key(col: Column, kind: T.DataType) -> Column | None:
    """A double that sorts as a number or a time does; none for other kinds."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return None


def string_cuts(rows: DataFrame, key: str, side: int) -> list[str]:
    """The strings behind which ``side`` parts of about equally many rows end, whole and by their bytes, from counts of all distinct strings.

    Distinct strings are numbered over range partitions, so no task sees them all.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    runs = written(counts.repartitionByRange(partitions(rows.sparkSession), "v").withColumn("run", F.spark_partition_id()), "curve-strings")
    upto = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = runs.groupBy("run").agg(F.sum("n").alias("own")).select(
        "run", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("start"), F.sum("own").over(Window.partitionBy(F.lit(0))).alias("total")
    )
    inside = Window.partitionBy("run").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = runs.withColumn("end", F.sum("n").over(inside)).join(F.broadcast(starts), "run").withColumn("end", F.col("end") + F.col("start"))
    last = F.expr(f"(end * {side}) div total > ((end - n) * {side}) div total AND end < total")
    return sorted((r["v"] for r in placed.where(last).select("v").collect()), key=str.encode)  # side - 1 at most


def _cuts_below(bounds: list, kind: str, key: Column) -> Column:
    """How many bounds lie below the key: its cell; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.lit(bounds).cast(f"array<{kind}>"), lambda b: F.coalesce(b < key, F.lit(False))))


def shard_by_curve(
    df: DataFrame,
    dims: Mapping[str, Column],
    *,
    n_shards: int = 8,
    doc: str = "doc_id",
    text: str = "text",
    bits: int = 6,
) -> DataFrame:
    """Cut all rows into ``n_shards`` runs of the Hilbert order whose row counts differ by one at most.

    ``dims`` names the metadata dimensions.  Each is cut into at most ``2**bits`` cells at its
    quantiles, approximate ones for numbers and times, exact ones over whole strings for anything else.  Returns ``doc_id, size,
    text_crc32, curve, shard, slot`` with size the UTF-8 bytes of the text plus 1,
    shard from 0 and slot gapless from 0 in each shard.  Nulls lie in the first
    cell of their dimension and a null text has no bytes and a null crc.  Ties
    of the curve are ordered by text checksum, id and size, so copies of a text
    adjoin.  Repeated rows are kept; an empty input gives no rows.  Other columns
    are dropped and cannot clash.
    """
    if not 0 < len(dims) * bits <= MAX_INDEX_BITS:
        raise ValueError(f"dimensions times bits must lie between 1 and {MAX_INDEX_BITS}")
    keys = [f"k{i}" for i in range(len(dims))]
    typed = df.select(*[c.alias(k) for k, c in zip(keys, dims.values())]).schema
    numbers = [numeric_key(c, typed[k].dataType) for k, c in zip(keys, dims.values())]
    rows = written(
        df.select(
            F.col(doc).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            *[(c.cast("string") if n is None else n).alias(k) for k, c, n in zip(keys, dims.values(), numbers)],
        ),
        "curve-keys",
    )
    side = 1 << bits
    known = [k for k, n in zip(keys, numbers) if n is not None]
    cuts = rows.agg(F.lit(0).alias("none"), *[F.percentile_approx(k, [i / side for i in range(1, side)], 10000).alias(k) for k in known]).first()
    cells = [
        _cuts_below(sorted(set(cuts[k] or [])), "double", F.col(k)) if k in known else _cuts_below(string_cuts(rows, k, side), "string", F.col(k)) for k in keys
    ]
    curved = rows
    for name, column in curve_index(cells, bits):
        curved = curved.withColumn(name, column)
    order = ["curve", "text_crc32", "doc_id", "size"]
    placed = written(
        curved.select("doc_id", "size", "text_crc32", "curve")
        .repartitionByRange(partitions(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .select("doc_id", "size", "text_crc32", "curve", F.shiftright("at", 33).alias("run"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos")),
        "curve-order",
    )
    # one row per partition of the order: as many as there are shuffle partitions
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    starts = runs.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    index = F.col("start") + F.col("pos")
    # integer division keeps the cut exact: index * shards never exceeds 2**63 for 10**18 rows
    shard = F.expr(f"(start + pos) * {n_shards} div total")
    first = F.expr(f"(((start + pos) * {n_shards} div total) * total + {n_shards - 1}) div {n_shards}")
    return placed.join(F.broadcast(starts), "run").select(
        "doc_id", "size", "text_crc32", "curve", shard.cast("int").alias("shard"), (index - first).cast("long").alias("slot")
    )


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of all documents; nulls, ties, repeats, long and empty texts and empty tables as in :func:`shard_by_curve`."""
    docs = table(spark, sf_dir, "documents")
    dims = {"lang": F.col("lang"), "source": F.col("source"), "length": F.char_length("text")}
    return shard_by_curve(docs, dims).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
