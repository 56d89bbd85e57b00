"""Pairs of subsequences: distances, profiles, nearest neighbours, graphs.

Two tiers give the same results.  The expression tier joins tiles of z-normalised
arrays and computes distances in the JVM.  The kernel tier multiplies matrices: of
strips and the whole series where a task can hold it (``kernel``), else of pairs of
tiles of raw values, each of which goes to one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.functions.distance import FLAT, euclidean
from motifloom.operators import kernel
from motifloom.operators.windows import lengths, znormalized_subsequences

PAIR_TILE, KERNEL_TILE = 256, 2048


def tile_pairs(left: DataFrame, right: DataFrame, tile: int) -> DataFrame:
    """Join ``a``-rows to ``b``-rows of the same series with ``a < b``, tile by tile."""
    last = right.groupBy("series_id").agg(F.expr(f"max(b) div {tile}").alias("last"))
    ta, tb = F.expr(f"a div {tile}"), F.expr(f"b div {tile}")
    lo = left.join(F.broadcast(last), "series_id").withColumn("ta", ta).withColumn("tb", F.explode(F.sequence(F.col("ta"), F.greatest("ta", "last")))).drop("last")
    hi = right.withColumn("tb", tb).withColumn("ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tb"))))
    return lo.join(hi, ["series_id", "ta", "tb"]).where("a < b")


def all_pairs(series: DataFrame, w: int, ez: int, tile: int = PAIR_TILE) -> DataFrame:
    """``series_id, a, b, d`` of all pairs at least ``ez`` apart (expression tier)."""
    z = znormalized_subsequences(series, w).select("series_id", "i", "z")
    left = z.select("series_id", F.col("i").alias("a"), F.col("z").alias("za"))
    right = z.select("series_id", F.col("i").alias("b"), F.col("z").alias("zb"))
    return tile_pairs(left, right, tile).where(F.col("b") - F.col("a") >= ez).select("series_id", "a", "b", euclidean(F.col("za"), F.col("zb")).alias("d"))


def _sliced(start: int, values: np.ndarray, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and z-normalised rows of the subsequences of a tile that are not flat."""
    count = min(len(values) - w + 1, n - w - start)
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros((0, w))
    x = np.lib.stride_tricks.sliding_window_view(values, w)[:count]
    m = x.mean(axis=1)
    sd = x.std(axis=1)
    keep = np.flatnonzero(sd > FLAT)
    return start + keep, (x[keep] - m[keep, None]) / sd[keep, None]


def _tile_table(series: DataFrame, w: int, tile: int) -> DataFrame:
    """``series_id, n, ta, tb, side, start, values``: raw values of tiles, dealt to every pair of tiles they are in."""
    own = F.expr(f"i div {tile}")
    # a tile needs the w - 1 values behind it, which may reach over several tiles when w is long
    back = F.sequence(F.greatest(F.expr(f"(i - {w - 1}) div {tile}"), F.lit(0).cast("long")), own)
    rows = series.select("series_id", "i", "v", F.explode(back).alias("t"))
    tiles = rows.groupBy("series_id", "t").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p"))
    tiles = tiles.select("series_id", "t", (F.col("t") * tile).alias("start"), F.transform("p", lambda p: p["v"]).alias("values"))
    ns = lengths(series).withColumn("last", F.expr(f"(n - 1) div {tile}"))
    tiles = tiles.join(ns, "series_id").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    return tiles.select("series_id", "n", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), "t", "start", "values")


def _blocks(series: DataFrame, w: int, tile: int, fold, schema: str) -> DataFrame:  # noqa: ANN001
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(group: pa.Table) -> pa.Table:
        sid, n, ta, tb = (group[c][0].as_py() for c in ("series_id", "n", "ta", "tb"))
        by = {t: (s, np.asarray(v)) for t, s, v in zip(group["t"].to_pylist(), group["start"].to_pylist(), group["values"].to_pylist())}
        a, za = _sliced(*by[ta], w, n)
        b, zb = (a, za) if ta == tb else _sliced(*by[tb], w, n)
        a, za = a[a < (ta + 1) * tile], za[a < (ta + 1) * tile]
        b, zb = b[b < (tb + 1) * tile], zb[b < (tb + 1) * tile]
        columns = fold(a, za, b, zb)
        return pa.table({"series_id": pa.array([sid] * len(columns[0]), pa.string()), **{k: pa.array(c) for k, c in zip(names[1:], columns)}})

    return _tile_table(series, w, tile).groupBy("series_id", "ta", "tb").applyInArrow(run, schema)


def _exact(za: np.ndarray, zb: np.ndarray) -> np.ndarray:
    return np.sqrt(((za - zb) ** 2).sum(axis=-1))


def matrix_profile(series: DataFrame, w: int, ez: int, tier: str = "expression", tile: int | None = None) -> DataFrame:
    """``series_id, i, nn_dist, nn_idx``: each subsequence's nearest neighbour at least ``ez`` away, ties to the smaller position."""
    if tier == "expression":
        pairs = all_pairs(series, w, ez, tile or PAIR_TILE).withColumn("d", F.round("d", 6))
        both = pairs.select("series_id", F.col("a").alias("i"), F.struct("d", F.col("b").alias("j")).alias("p")).union(
            pairs.select("series_id", F.col("b").alias("i"), F.struct("d", F.col("a").alias("j")).alias("p"))
        )
        return both.groupBy("series_id", "i").agg(F.min("p").alias("p")).select("series_id", "i", F.col("p.d").alias("nn_dist"), F.col("p.j").alias("nn_idx"))

    held = None if tier == "tiles" else kernel.collected(series)
    if held is not None:
        return kernel.profile(series.sparkSession, held, w, ez)

    near = _blocks(series, w, tile or KERNEL_TILE, _near_of_blocks(w, ez, 1), "series_id string, i long, j long, d double")
    best = near.groupBy("series_id", "i").agg(F.min(F.struct("d", "j")).alias("p"))
    return best.select("series_id", "i", F.col("p.d").alias("nn_dist"), F.col("p.j").alias("nn_idx"))


def _near_of_blocks(w: int, ez: int, most: int):  # noqa: ANN202
    """For a pair of tiles each subsequence's ``most`` nearest of the other tile, both ways, ties to the smaller position."""

    def fold(a, za, b, zb):  # noqa: ANN001, ANN202
        out: tuple[list, list, list] = ([], [], [])
        if len(a) and len(b):
            g = za @ zb.T  # the larger the product, the nearer
            if b[0] - a[-1] < ez:
                g[np.abs(a[:, None] - b[None, :]) < ez] = -np.inf
            for i, zi, j, zj, own in ((a, za, b, zb, g), (b, zb, a, za, g.T)):
                kth = -np.partition(-own, most - 1, axis=1)[:, most - 1] if most < own.shape[1] else np.full(len(i), -np.inf)
                # what six digits of a distance hide may be as near as the last
                r, c = np.nonzero(own >= np.where(np.isfinite(kth), kth - 4e-6 * w**0.5, np.finfo(float).min)[:, None])
                d = np.round(_exact(zi[r], zj[c]), 6)
                order = np.lexsort((c, d, r))
                first = np.append(True, r[order][1:] != r[order][:-1]) if len(r) else np.zeros(0, bool)
                keep = order[np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) < most]
                out[0].append(i[r[keep]])
                out[1].append(j[c[keep]])
                out[2].append(d[keep])
        whole = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return [pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int64()), pa.array(whole[2], pa.float64())]

    return fold


def pairs_within(series: DataFrame, w: int, ez: int, bound: float, tile: int = KERNEL_TILE) -> DataFrame:
    """``series_id, a, b, d`` of all pairs at least ``ez`` apart and no farther than ``bound`` (kernel tier)."""

    def fold(a, za, b, zb):  # noqa: ANN001, ANN202
        if not len(a) or not len(b):
            return [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        i, j = np.nonzero(za @ zb.T >= w - (bound + 1e-5) ** 2 / 2)
        apart = b[j] - a[i] >= ez
        i, j = i[apart], j[apart]
        exact = _exact(za[i], zb[j])
        ok = exact <= bound
        return [pa.array(a[i[ok]], pa.int64()), pa.array(b[j[ok]], pa.int64()), pa.array(exact[ok], pa.float64())]

    return _blocks(series, w, tile, fold, "series_id string, a long, b long, d double")


def _with_query(series: DataFrame, w: int, start: int, size: int) -> DataFrame:
    """``series_id, n, t, x, q``: tiles of values with the ``w - 1`` behind them, and the subsequence at ``start``."""
    own = F.expr(f"i div {size}")
    back = F.sequence(F.greatest(F.expr(f"(i - {w - 1}) div {size}"), F.lit(0).cast("long")), own)
    tiles = series.select("series_id", "i", "v", F.explode(back).alias("t")).groupBy("series_id", "t").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p"))
    query = series.where((F.col("i") >= start) & (F.col("i") < start + w)).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("q"))
    values = lambda c: F.transform(c, lambda p: p["v"])
    joined = tiles.join(F.broadcast(query), "series_id").join(lengths(series), "series_id")  # one row of w values for each series
    return joined.select("series_id", "n", "t", values("p").alias("x"), values("q").alias("q"))


def sliding_dot_product(series: DataFrame, w: int, start: int, size: int = 1 << 14) -> DataFrame:
    """``series_id, i, dot``: dot product of the subsequence at ``start`` with every one, by FFT over tiles."""

    def convolve(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for r in batch.to_pylist():
                x, q = np.array(r["x"]), np.array(r["q"])
                count = min(size, len(x) - w + 1, r["n"] - w - r["t"] * size)
                if count > 0 and len(q) == w:
                    # about the means, for the transform's error grows with the size of the values
                    full, mx, mq = 1 << (len(x) + w - 1).bit_length(), x.mean(), q.mean()
                    x, q = x - mx, q - mq
                    dots = np.fft.irfft(np.fft.rfft(x, full) * np.fft.rfft(q[::-1], full), full)[w - 1 : w - 1 + count]
                    sums = np.concatenate([[0.0], np.cumsum(x)])
                    dots = dots + mq * (sums[w:] - sums[:-w])[:count] + w * mx * mq + mx * q.sum()
                    yield pa.record_batch([pa.array([r["series_id"]] * count), pa.array(r["t"] * size + np.arange(count)), pa.array(dots)], names=["series_id", "i", "dot"])

    return _with_query(series, w, start, size).mapInArrow(convolve, "series_id string, i long, dot double")


def each_dot(dots: DataFrame, call) -> DataFrame:  # noqa: ANN001
    """``series_id, i, out`` of any function of arrays of positions and dot products, called for each batch of them."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = np.asarray(call(batch.column(1).to_numpy(), batch.column(2).to_numpy()), float)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=["series_id", "i", "out"])

    return dots.select("series_id", "i", "dot").mapInArrow(run, "series_id string, i long, out double")


def znormalized_sliding_dot(series: DataFrame, w: int, start: int) -> DataFrame:
    """Dot product of the values of the subsequence at ``start`` with each z-normalised subsequence; flat ones are left out."""
    from motifloom.operators.windows import rolling_stats

    stats = rolling_stats(series, w).where("NOT is_flat")
    total = series.where((F.col("i") >= start) & (F.col("i") < start + w)).groupBy("series_id").agg(F.sum("v").alias("total"))
    both = sliding_dot_product(series, w, start).join(stats, ["series_id", "i"]).join(F.broadcast(total), "series_id")
    return both.select("series_id", "i", F.try_divide(F.col("dot") - F.col("total") * F.col("m"), F.col("sd")).alias("dot"))


def mass_profile(series: DataFrame, w: int, start: int, size: int = 1 << 14) -> DataFrame:
    """``series_id, i, distance`` of the subsequence at ``start`` to every one, z-normalised, by FFT over tiles; flat ones left out.

    Distances that are too small for the transform's precision are computed directly.
    """

    def measure(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for r in batch.to_pylist():
                x, q = np.array(r["x"]), np.array(r["q"])
                count = min(size, len(x) - w + 1, r["n"] - w - r["t"] * size)
                if count <= 0 or len(q) != w or q.std() <= FLAT:
                    continue
                full, mean = 1 << (len(x) + w - 1).bit_length(), x.mean()
                q = (q - q.mean()) / q.std()  # sums to nothing, so the tile may be taken about its mean
                dots = np.fft.irfft(np.fft.rfft(x - mean, full) * np.fft.rfft(q[::-1], full), full)[w - 1 : w - 1 + count]
                view = np.lib.stride_tricks.sliding_window_view(x, w)[:count]
                step = max(1, (4 << 20) // w)
                sd = np.concatenate([view[k : k + step].std(axis=1) for k in range(0, count, step)])
                keep = np.flatnonzero(sd > FLAT)
                squares = 2 * w - 2 * dots[keep] / sd[keep]
                out = np.sqrt(np.maximum(squares, 0))
                near = np.flatnonzero(squares < 1e-3 * w)
                own = view[keep[near]]
                out[near] = _exact((own - own.mean(axis=1, keepdims=True)) / sd[keep[near], None], q)
                yield pa.record_batch([pa.array([r["series_id"]] * len(keep)), pa.array(r["t"] * size + keep), pa.array(out)], names=["series_id", "i", "distance"])

    return _with_query(series, w, start, size).mapInArrow(measure, "series_id string, i long, distance double")


def distance_profile(series: DataFrame, w: int, start: int, distance=None, raw: bool = False) -> DataFrame:  # noqa: ANN001
    """``series_id, i, distance`` of the subsequence at ``start`` to every one; itself at 0, flat ones left out.

    Without a ``distance`` it is the z-normalised Euclidean one by FFT; else any function of two array
    columns, and ``raw`` compares the values as they are.
    """
    if distance is None and not raw:
        return mass_profile(series, w, start)
    distance = distance or euclidean
    z = znormalized_subsequences(series, w).select("series_id", "i", F.col("x" if raw else "z").alias("z"))
    one = z.where(F.col("i") == start).select("series_id", F.col("z").alias("q"))
    return z.join(F.broadcast(one), "series_id").select("series_id", "i", distance(F.col("z"), F.col("q")).alias("distance"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs: ``series_id, src, dst, d``."""
    return pairs.select("series_id", F.col("a").alias("src"), F.col("b").alias("dst"), "d").union(
        pairs.select("series_id", F.col("b").alias("src"), F.col("a").alias("dst"), "d")
    )


def knn_kernel(series: DataFrame, w: int, k: int, ez: int, tile: int | None = None) -> DataFrame:
    """The rows of :func:`knn_nonoverlapping` by matrix products; with ``tile``, or for a long series, tile by tile."""
    held = None if tile else kernel.collected(series)
    if held is not None:
        return kernel.knn(series.sparkSession, held, w, k, ez)
    enough = k * (2 * ez - 1)
    near = _blocks(series, w, tile or KERNEL_TILE, _near_of_blocks(w, ez, enough), "series_id string, src long, dst long, d double")
    return _chosen(near, k, ez)


def knn_nonoverlapping(pairs: DataFrame, k: int, ez: int) -> DataFrame:
    """``series_id, src, rank, dst, d``: for each subsequence the ``k`` nearest, each at least ``ez`` from those before it.

    Neighbours can overlap at most ``2 ez`` others each, so the nearest
    ``k * (2 ez - 1)`` of each subsequence always hold the answer.
    """
    return _chosen(neighbours(pairs), k, ez)


def _chosen(directed: DataFrame, k: int, ez: int) -> DataFrame:
    enough = k * (2 * ez - 1)
    ranked = Window.partitionBy("series_id", "src").orderBy("d", "dst")
    near = directed.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= enough)
    lists = near.groupBy("series_id", "src").agg(F.sort_array(F.collect_list(F.struct("d", "dst"))).alias("p"))
    empty = F.slice("p", 1, 0)
    chosen = F.aggregate(
        "p",
        empty,
        lambda acc, p: F.when(
            (F.size(acc) < k) & ~F.exists(acc, lambda q: F.abs(q["dst"] - p["dst"]) < ez), F.concat(acc, F.array(p))
        ).otherwise(acc),
    )
    return lists.select("series_id", "src", F.posexplode(chosen).alias("rank", "p")).select(
        "series_id", "src", (F.col("rank") + 1).alias("rank"), F.col("p.dst").alias("dst"), F.col("p.d").alias("d")
    )


def knn_graph(knn: DataFrame, bound: Column | float | None = None) -> DataFrame:
    """Undirected edges ``series_id, a, b, d`` of a k-nearest-neighbour table, each once, up to a bound."""
    edges = knn.select("series_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "d").dropDuplicates(["series_id", "a", "b"])
    return edges if bound is None else edges.where(F.col("d") <= bound)


def graph_stats(edges: DataFrame) -> DataFrame:
    degree = neighbours(edges).groupBy("series_id", "src").agg(F.count(F.lit(1)).alias("degree"))
    return degree.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.expr("sum(degree) div 2").alias("edges"), F.max("degree").alias("max_degree")
    )


def touched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges beside any of the nodes ``series_id, i``: what a new batch of edges makes worth another look."""
    return edges.join(nodes.select("series_id", F.col("i").alias("a")), ["series_id", "a"], "left_semi").union(
        edges.join(nodes.select("series_id", F.col("i").alias("b")), ["series_id", "b"], "left_semi").select(edges.columns)
    ).distinct()
