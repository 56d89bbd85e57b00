"""Registered queries of the motif engine and the SQL that checks them.

Doubles are rounded to six digits before anything is ordered by them, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom import experiments as X
from motifloom.functions import distance as D
from motifloom.functions import probability
from motifloom.operators import evaluate, greedy, lsh, measures, motiflets, pairs, prescrimp, sax
from motifloom.operators import windows as W
from motifloom.plans import planner
from motifloom.sources import series as S
from motifloom.sources import sinks
from motifloom.sources.storage import scratch
from motifloom.streaming import series_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Window and exclusion zone of the hourly series, of the planted one, and of the flat-window series.
WH, WP, WF = 24, 32, 6
#: Width of the hash buckets and tables of the registered hash queries.
WIDTH, TABLES = 5.0, 2


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def f1(spark: SparkSession, sf: str) -> DataFrame:
    return S.hourly(_t(spark, sf, "events"))


def f2(spark: SparkSession, sf: str) -> DataFrame:
    return S.raw(_t(spark, sf, "events"))


def f3(spark: SparkSession, sf: str) -> DataFrame:
    return S.hourly(_t(spark, sf, "events"), F.col("event_type"))


def f4(spark: SparkSession, sf: str) -> DataFrame:
    return S.quarter_hourly(_t(spark, sf, "events"))


def f5(spark: SparkSession, sf: str) -> DataFrame:
    return S.planted(_t(spark, sf, "events"))


def f7(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily_revenue(_t(spark, sf, "lineitem"))


# SQL of the series and of what many queries start from

F1 = """hours AS (SELECT date_trunc('hour', ts) AS h, sum(value) AS s FROM events GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hours),
f1 AS (SELECT row_number() OVER (ORDER BY spine.h) - 1 AS i, round(coalesce(s, 0.0), 2) AS v FROM spine LEFT JOIN hours USING (h))"""
F2 = "f2 AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"
F3 = """hours3 AS (SELECT event_type, date_trunc('hour', ts) AS h, sum(value) AS s FROM events GROUP BY 1, 2),
spine3 AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hours3),
f3 AS (SELECT t.event_type AS series_id, row_number() OVER (PARTITION BY t.event_type ORDER BY g.h) - 1 AS i, round(coalesce(s, 0.0), 2) AS v
  FROM (SELECT DISTINCT event_type FROM hours3) t CROSS JOIN spine3 g LEFT JOIN hours3 x ON x.event_type = t.event_type AND x.h = g.h)"""
F4 = """slots AS (SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 900000000.0) AS BIGINT) AS i, sum(value) AS s FROM events GROUP BY 1),
f4 AS (SELECT g.i, round(coalesce(s, 0.0), 2) AS v FROM (SELECT unnest(range(2880)) AS i) g LEFT JOIN slots USING (i))"""
F5 = F4 + """,
f5 AS (SELECT o.i, CASE WHEN o.i BETWEEN 2000 AND 2431 AND o.i % 100 < 32
    THEN e.v * 1.5 + 3 + 0.5 * (floor((o.i - 2000) / 100.0) + 1) * (o.i % 7) ELSE o.v END AS v
  FROM f4 o LEFT JOIN f4 e ON e.i = o.i - 1600)"""
F7 = """days AS (SELECT date_trunc('day', l_shipdate) AS d, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS s FROM lineitem GROUP BY 1),
spine7 AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM (SELECT CAST(d AS TIMESTAMP) AS d FROM days)),
f7 AS (SELECT row_number() OVER (ORDER BY g.d) - 1 AS i, CAST(coalesce(s, 0.0) AS DOUBLE) AS v FROM spine7 g LEFT JOIN days x ON CAST(x.d AS TIMESTAMP) = g.d)"""


def _subs(t: str, w: int) -> str:
    return f"""subs AS MATERIALIZED (SELECT i, list(v) OVER f AS x, avg(v) OVER f AS m, stddev_pop(v) OVER f AS sd FROM {t}
  WINDOW f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) QUALIFY i < (SELECT count(*) FROM {t}) - {w}),
zs AS MATERIALIZED (SELECT i, x, m, sd, list_transform(x, lambda e: (e - m) / sd) AS z FROM subs WHERE sd > 1e-4)"""


def _pairs(t: str, w: int, ez: int) -> str:
    return _subs(t, w) + f""",
pairs AS MATERIALIZED (SELECT p.i AS a, q.i AS b, round(list_distance(p.z, q.z), 6) AS d FROM zs p JOIN zs q ON q.i - p.i >= {ez}),
dirs AS MATERIALIZED (SELECT a AS src, b AS dst, d FROM pairs UNION ALL SELECT b, a, d FROM pairs)"""


def _greedy(src: str, k: int, ez: int) -> str:
    """Recursive pick of the k least (d, a, b) of ``src`` that overlap none picked before."""
    clear = f"len(list_filter(used, lambda u: abs(u - a) < {ez} OR abs(u - b) < {ez})) = 0"
    return f"""pick(rk, a, b, d, used) AS (
  (SELECT 1, a, b, d, [a, b] FROM {src} ORDER BY d, a, b LIMIT 1)
  UNION ALL
  (SELECT rk + 1, c.a, c.b, c.d, list_concat(used, [c.a, c.b]) FROM pick, {src} c
   WHERE rk < {k} AND {clear.replace('- a)', '- c.a)').replace('- b)', '- c.b)')} ORDER BY c.d, c.a, c.b LIMIT 1))"""


R = "WITH RECURSIVE "
PICKED = "SELECT CAST(rk AS INTEGER) AS rank, a, b, d AS distance FROM pick"
SUB1, PAIR1 = F1 + ",\n" + _subs("f1", WH), F1 + ",\n" + _pairs("f1", WH, WH)
PAIR5 = F5 + ",\n" + _pairs("f5", WP, WP)


def _knn(pairs_sql: str, ez: int, third: bool = True) -> str:
    """The two or three nearest of each root that do not overlap each other."""
    out = pairs_sql + f""",
n1 AS MATERIALIZED (SELECT src, d AS d1, dst AS j1 FROM dirs QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1),
n2 AS MATERIALIZED (SELECT n1.*, d AS d2, dst AS j2 FROM n1 JOIN dirs USING (src) WHERE abs(dst - j1) >= {ez}
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1)"""
    if third:
        out += f""",
n3 AS MATERIALIZED (SELECT n2.*, d AS d3, dst AS j3 FROM n2 JOIN dirs USING (src) WHERE abs(dst - j1) >= {ez} AND abs(dst - j2) >= {ez}
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1),
knn AS MATERIALIZED (SELECT src, 1 AS rank, j1 AS dst, d1 AS d FROM n1 UNION ALL SELECT src, 2, j2, d2 FROM n2 UNION ALL SELECT src, 3, j3, d3 FROM n3)"""
    return out


KNN1 = _knn(PAIR1, WH)


def _numbers(x: np.ndarray) -> str:
    return "[" + ", ".join(f"{v:.6f}" for v in x) + "]"


def _hash_sql(w: int, reps: int = TABLES, width: float = WIDTH, source: str = "zs") -> str:
    vectors, shares = lsh.projections(w, reps)
    rows = ",\n".join(f"({r}, {k}, {_numbers(vectors[r, k])}, {shares[r, k]:.6f})" for r in range(reps) for k in range(lsh.K))
    return f"""proj(rep, k, vec, share) AS (SELECT rep, k, CAST(vec AS DOUBLE[]), CAST(share AS DOUBLE) FROM (VALUES {rows}) t(rep, k, vec, share)),
flat AS (SELECT rep, i, k, CAST(floor(round((list_dot_product(z, vec) + share * {width}) / {width}, 9)) AS BIGINT) AS h FROM {source}, proj),
hashes AS (SELECT rep, i, list(h ORDER BY k) AS h FROM flat GROUP BY 1, 2)"""


HASH5 = F5 + ",\n" + _subs("f5", WP) + ",\n" + _hash_sql(WP)


def _table5(spark: SparkSession, sf: str, reps: int = TABLES) -> DataFrame:
    return lsh.hash_series(f5(spark, sf), WP, reps, WIDTH)


def _pairs1(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.all_pairs(f1(spark, sf), WH, WH).withColumn("d", F.round("d", 6))


# sources, slices, statistics


@query("series_hourly", f"WITH {F1} SELECT i, v FROM f1")
def _(spark, sf):
    return f1(spark, sf).select("i", "v")


@query("series_hourly_by_type", f"WITH {F3} SELECT series_id, i, v FROM f3")
def _(spark, sf):
    return f3(spark, sf)


@query("series_planted", f"WITH {F5} SELECT i, round(v, 6) AS v FROM f5")
def _(spark, sf):
    return f5(spark, sf).select("i", F.round("v", 6).alias("v"))


@query("series_daily_revenue", f"WITH {F7} SELECT i, v FROM f7")
def _(spark, sf):
    return f7(spark, sf).select("i", "v")


LINES = """lines AS (SELECT event_id AS line_no, CASE WHEN event_id % 10 = 3 THEN '  ' WHEN event_id % 50 = 7 THEN CAST(value AS VARCHAR) || 'x'
  ELSE ' ' || CAST(value AS VARCHAR) END AS value FROM events)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("value").cast("string")
    value = F.when(F.col("event_id") % 10 == 3, F.lit("  ")).when(F.col("event_id") % 50 == 7, F.concat(text, F.lit("x"))).otherwise(F.concat(F.lit(" "), text))
    return _t(spark, sf, "events").select(F.col("event_id").alias("line_no"), value.alias("value"))


@query(
    "src_text_series",
    f"WITH {LINES} SELECT row_number() OVER (ORDER BY line_no) - 1 AS i, TRY_CAST(trim(value) AS DOUBLE) AS v FROM lines WHERE TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL",
)
def _(spark, sf):
    return S.numbered(S.parse_lines(_lines(spark, sf), strict=False), ["line_no"], "v").select("i", "v")


@query("src_reject_bad", f"WITH {LINES} SELECT line_no FROM lines WHERE trim(value) <> '' AND TRY_CAST(trim(value) AS DOUBLE) IS NULL")
def _(spark, sf):
    return S.rejected_lines(_lines(spark, sf)).select("line_no")


@query("series_prefix", f"WITH {F2} SELECT i, v FROM f2 WHERE i < 500")
def _(spark, sf):
    return S.prefix_of(f2(spark, sf), 500).select("i", "v")


@query("series_slice_center", f"WITH {F1} SELECT i - 300 AS i, v FROM f1 WHERE i >= 300 AND i < 420")
def _(spark, sf):
    return S.centre_slice(f1(spark, sf), 360, 60).select("i", "v")


@query("downsample", f"WITH {F2} SELECT i // 7 AS i, v FROM f2 WHERE i % 7 = 0")
def _(spark, sf):
    return S.downsample(f2(spark, sf), 7).select("i", "v")


@query(
    "gen_random_walk",
    """WITH h AS (SELECT i, md5('7:' || i) AS h FROM (SELECT unnest(range(20000)) AS i)),
u AS (SELECT i, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 1) / 4294967296.0 AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 AS b FROM h)
SELECT i, round(sum(sqrt(-2 * ln(a)) * cos(2 * pi() * b)) OVER (ORDER BY i), 5) AS v FROM u""",
)
def _(spark, sf):
    return S.random_walk(spark, 20_000, 7, 1000).select("i", F.round("v", 5).alias("v"))


@query("running_sum", f"WITH {F2} SELECT i, round(sum(v - 50) OVER (ORDER BY i), 4) AS v FROM f2")
def _(spark, sf):
    steps = f2(spark, sf).withColumn("v", F.col("v") - 50)
    return S.running_sum(steps, 1000).select("i", F.round("v", 4).alias("v"))


@query("subsequences", f"WITH {SUB1} SELECT i, g AS pos, x[g + 1] AS val FROM subs, (SELECT unnest(range({WH})) AS g)")
def _(spark, sf):
    return W.exploded(W.subsequences(f1(spark, sf), WH), "x", "val", "i").select("i", F.col("pos").cast("long").alias("pos"), "val")


@query("rolling_stats", f"WITH {SUB1} SELECT i, round(m, 6) AS m, round(sd, 6) AS sd, sd <= 1e-4 AS is_flat FROM subs")
def _(spark, sf):
    return W.rolling_stats(f1(spark, sf), WH).select("i", F.round("m", 6).alias("m"), F.round("sd", 6).alias("sd"), "is_flat")


@query("rolling_stats_fast", f"WITH {SUB1} SELECT i, round(m, 5) AS m, round(sd, 5) AS sd, sd <= 1e-4 AS is_flat FROM subs")
def _(spark, sf):
    return W.rolling_stats_fast(f1(spark, sf), WH).select("i", F.round("m", 5).alias("m"), F.round("sd", 5).alias("sd"), "is_flat")


SUBS3 = f"""subs3 AS (SELECT series_id, i, stddev_pop(v) OVER f AS sd, count(*) OVER (PARTITION BY series_id) AS n FROM f3
  WINDOW f AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WF - 1} FOLLOWING) QUALIFY i < n - {WF})"""


@query("flat_count", f"WITH {F3},\n{SUBS3} SELECT series_id, count(*) FILTER (sd <= 1e-4) AS n_flat FROM subs3 GROUP BY 1")
def _(spark, sf):
    return W.rolling_stats(f3(spark, sf), WF).groupBy("series_id").agg(F.count_if("is_flat").alias("n_flat"))


@query(
    "series_stats",
    f"""WITH {SUB1}, c AS (SELECT count(*) AS n FROM f1)
SELECT n, n - {WH} AS n_subsequences, (n - {WH}) * (n - {WH} - 1) // 2 AS n_pairs, (SELECT count(*) FROM subs WHERE sd <= 1e-4) AS n_flat,
  round(2 * sqrt({WH}), 6) AS max_distance FROM c""",
)
def _(spark, sf):
    return W.series_stats(f1(spark, sf), WH).select("n", "n_subsequences", "n_pairs", "n_flat", F.round("max_distance", 6).alias("max_distance"))


@query("znorm_subsequences", f"WITH {SUB1} SELECT i, g AS pos, round(z[g + 1], 6) AS val FROM zs, (SELECT unnest(range({WH})) AS g)")
def _(spark, sf):
    z = W.exploded(W.znormalized_subsequences(f1(spark, sf), WH), "z", "val", "i")
    return z.select("i", F.col("pos").cast("long").alias("pos"), F.round("val", 6).alias("val"))


# distances and profiles

ONE = "one AS (SELECT z AS q, x AS qx FROM zs WHERE i = 100)"


@query("sliding_dot_product", f"WITH {SUB1},\n{ONE} SELECT i, round(list_dot_product(subs.x, qx), 4) AS dot FROM subs, one")
def _(spark, sf):
    return pairs.sliding_dot_product(f1(spark, sf), WH, 100, 256).select("i", F.round("dot", 4).alias("dot"))


@query("znorm_sliding_dot", f"WITH {SUB1},\n{ONE} SELECT i, round(list_dot_product(z, qx), 4) AS dot FROM zs, one")
def _(spark, sf):
    return pairs.znormalized_sliding_dot(f1(spark, sf), WH, 100).select("i", F.round("dot", 4).alias("dot"))


@query("distance_profile", f"WITH {SUB1},\n{ONE} SELECT i, round(list_distance(z, q), 6) AS distance FROM zs, one")
def _(spark, sf):
    return pairs.distance_profile(f1(spark, sf), WH, 100).select("i", F.round("distance", 6).alias("distance"))


@query("distance_profile_euclid", f"WITH {SUB1},\n{ONE} SELECT i, round(list_distance(x, qx), 6) AS distance FROM zs, one")
def _(spark, sf):
    return pairs.distance_profile(f1(spark, sf), WH, 100, D.euclidean, raw=True).select("i", F.round("distance", 6).alias("distance"))


@query(
    "distance_profile_topk",
    f"""WITH {SUB1},\n{ONE} SELECT i, round(list_distance(z, q), 6) AS distance FROM zs, one
WHERE abs(i - 100) >= {WH} AND round(list_distance(z, q), 6) <= 6 ORDER BY 2, 1 LIMIT 10""",
)
def _(spark, sf):
    near = pairs.distance_profile(f1(spark, sf), WH, 100).withColumn("distance", F.round("distance", 6))
    return near.where((F.abs(F.col("i") - 100) >= WH) & (F.col("distance") <= 6)).orderBy("distance", "i").limit(10).select("i", "distance")


@query(
    "dist_to_corr",
    f"""WITH {SUB1}, one AS (SELECT z AS q, m AS qm, sd AS qsd FROM zs WHERE i = 100), dp AS (SELECT i, list_distance(z, q) AS d, m, sd, qm, qsd FROM zs, one)
SELECT i, round(1 - d * d / {2 * WH}.0, 6) AS corr, round(((1 - d * d / {2 * WH}.0) * {WH} * sd * qsd + {WH} * m * qm) / 1e6, 4) AS dot FROM dp""",
)
def _(spark, sf):
    s = f1(spark, sf)
    stats = W.rolling_stats(s, WH).select("i", "m", "sd")
    one = stats.where("i = 100").select(F.col("m").alias("qm"), F.col("sd").alias("qsd"))
    both = pairs.distance_profile(s, WH, 100).join(stats, "i").crossJoin(F.broadcast(one))  # one row
    dot = D.raw_dot(F.col("distance"), WH, F.col("m"), F.col("sd"), F.col("qm"), F.col("qsd"))
    return both.select("i", F.round(D.correlation(F.col("distance"), WH), 6).alias("corr"), F.round(dot / 1e6, 4).alias("dot"))


NEAREST = "near AS (SELECT src AS i, d AS nn_dist, dst AS nn_idx FROM dirs QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1)"


@query("matrix_profile_exact", f"WITH {PAIR1},\n{NEAREST} SELECT i, nn_dist, nn_idx FROM near")
def _(spark, sf):
    return pairs.matrix_profile(f1(spark, sf), WH, WH, "kernel").select("i", "nn_dist", "nn_idx")


@query("matrix_profile_tiles", f"WITH {PAIR1},\n{NEAREST} SELECT i, nn_dist, nn_idx FROM near")
def _(spark, sf):
    return pairs.matrix_profile(f1(spark, sf), WH, WH, "tiles", 256).select("i", "nn_dist", "nn_idx")


@query("matrix_profile_expression", f"WITH {PAIR1},\n{NEAREST} SELECT i, nn_dist, nn_idx FROM near")
def _(spark, sf):
    return pairs.matrix_profile(f1(spark, sf), WH, WH).select("i", "nn_dist", "nn_idx")


CLOSEST = "cand AS (SELECT DISTINCT least(i, nn_idx) AS a, greatest(i, nn_idx) AS b, nn_dist AS d FROM near)"


@query("motifs_from_profile", f"{R}{PAIR1},\n{NEAREST},\n{CLOSEST},\n{_greedy('cand', 5, WH)} {PICKED}")
def _(spark, sf):
    profile = pairs.matrix_profile(f1(spark, sf), WH, WH, "kernel")
    return greedy.motifs_from_profile(profile, 5, WH).select("rank", "a", "b", "distance")


@query("motifs_exact", f"{R}{PAIR1},\n{_greedy('pairs', 10, WH)} {PICKED}")
def _(spark, sf):
    return planner.motifs(f1(spark, sf), WH, 10, WH).select("rank", "a", "b", "distance")


@query("motifs_expression", f"{R}{PAIR1},\n{_greedy('pairs', 10, WH)} {PICKED}")
def _(spark, sf):
    return planner.motifs(f1(spark, sf), WH, 10, WH, "expression").select("rank", "a", "b", "distance")


@query("motifs_tiles", f"{R}{PAIR1},\n{_greedy('pairs', 10, WH)} {PICKED}")
def _(spark, sf):
    return greedy.motifs_exact(f1(spark, sf), WH, 10, WH, "tiles").select("rank", "a", "b", "distance")


@query("motifs_kernel", f"{R}{PAIR5},\n{_greedy('pairs', 10, WP)} {PICKED}")
def _(spark, sf):
    return planner.motifs(f5(spark, sf), WP, 10, WP, "kernel").select("rank", "a", "b", "distance")


@query(
    "motif_values",
    f"""{R}{PAIR1},\n{_greedy('pairs', 3, WH)}, sides AS (SELECT rk, unnest([a, b]) AS i FROM pick)
SELECT CAST(rk AS INTEGER) AS rank, i, g AS pos, x[g + 1] AS val, round(z[g + 1], 6) AS zval FROM sides JOIN zs USING (i), (SELECT unnest(range({WH})) AS g)""",
)
def _(spark, sf):
    s = f1(spark, sf)
    out = planner.motif_values(planner.motifs(s, WH, 3, WH), s, WH)
    return out.select("rank", "i", F.col("pos").cast("long").alias("pos"), "val", F.round("zval", 6).alias("zval"))


# neighbours, graphs, motiflets


@query("knn_nonoverlap", f"WITH {KNN1} SELECT src, rank, dst, d FROM knn")
def _(spark, sf):
    return pairs.knn_nonoverlapping(_pairs1(spark, sf), 3, WH).select("src", "rank", "dst", "d")


GRAPH = "edges AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, d FROM knn WHERE d <= 5)"


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.knn_graph(pairs.knn_nonoverlapping(_pairs1(spark, sf), 3, WH), 5.0)


@query("knn_graph", f"WITH {KNN1},\n{GRAPH} SELECT a, b, d FROM edges")
def _(spark, sf):
    return _graph(spark, sf).select("a", "b", "d")


@query(
    "graph_stats",
    f"""WITH {KNN1},\n{GRAPH}, deg AS (SELECT n, count(*) AS c FROM (SELECT a AS n FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1)
SELECT count(*) AS nodes, CAST(sum(c) // 2 AS BIGINT) AS edges, max(c) AS max_degree FROM deg""",
)
def _(spark, sf):
    return pairs.graph_stats(_graph(spark, sf)).select("nodes", "edges", "max_degree")


@query("semi_join_edges", f"WITH {KNN1},\n{GRAPH} SELECT a, b, d FROM edges WHERE a % 5 = 0 OR b % 5 = 0")
def _(spark, sf):
    nodes = spark.range(1000).where("id % 5 = 0").select(F.lit(S.ALL).alias("series_id"), F.col("id").alias("i"))
    return pairs.touched(_graph(spark, sf), nodes).select("a", "b", "d")


SETS_OF = """,
sets AS MATERIALIZED (SELECT src AS root, 2 AS support, list_sort([src, j1]) AS idx, d1 AS extent FROM n1
 UNION ALL SELECT src, 3, list_sort([src, j1, j2]), greatest(d1, d2, d) FROM n2 JOIN pairs ON a = least(j1, j2) AND b = greatest(j1, j2))"""
SETS = _knn(PAIR1, WH, False) + SETS_OF


@query("motiflet_extents", f"WITH {SETS} SELECT root, support, extent FROM sets")
def _(spark, sf):
    p = _pairs1(spark, sf)
    return motiflets.extents(pairs.knn_nonoverlapping(p, 2, WH), p).select("root", "support", "extent")


@query("motiflet_sets_kernel", f"WITH {SETS} SELECT root, support, extent FROM sets")
def _(spark, sf):
    from motifloom.operators import kernel

    return kernel.sets(spark, kernel.collected(f1(spark, sf)), WH, 3, WH).select("root", "support", "extent")


@query("knn_kernel", f"WITH {KNN1} SELECT src, rank, dst, d FROM knn")
def _(spark, sf):
    return pairs.knn_kernel(f1(spark, sf), WH, 3, WH).select("src", "rank", "dst", "d")


BEST = "best AS (SELECT support, idx, extent FROM sets QUALIFY row_number() OVER (PARTITION BY support ORDER BY extent, idx) = 1)"


@query("motiflets_exact", f"WITH {SETS},\n{BEST} SELECT support, g AS pos, idx[g + 1] AS idx, extent FROM best, (SELECT unnest(range(3)) AS g) WHERE g < support")
def _(spark, sf):
    out = motiflets.motiflets_exact(f1(spark, sf), WH, 3, WH)
    return out.select("support", F.posexplode("indices").alias("pos", "idx"), "extent").withColumn("pos", F.col("pos").cast("long"))


# measures


@query("avg_pairwise_distance", f"WITH {PAIR1} SELECT round(avg(d), 6) AS average, count(*) AS pairs FROM pairs")
def _(spark, sf):
    return measures.average_distance(_pairs1(spark, sf)).select(F.round("average", 6).alias("average"), "pairs")


@query(
    "distance_histogram",
    f"WITH {PAIR1} SELECT CAST(floor(d / (2 * sqrt({WH}.0) / 20)) AS BIGINT) + 1 AS bucket, count(*) AS n FROM pairs GROUP BY 1",
)
def _(spark, sf):
    return measures.distance_histogram(_pairs1(spark, sf), WH).select("bucket", "n")


@query(
    "difficulty_measures",
    f"""WITH {SUB1},\n{ONE}, far AS (SELECT i, round(list_distance(z, q), 6) AS d FROM zs, one WHERE abs(i - 100) > {WH}),
r AS (SELECT d, row_number() OVER (ORDER BY d, i) AS r FROM far), a AS (SELECT avg(d) AS mean, count(*) AS n, max(d) AS most FROM far),
l AS (SELECT sum(ln(d / most)) FILTER (d > 0) AS logs FROM far, a)
SELECT CAST(100 AS BIGINT) AS i, (SELECT d FROM r WHERE r = 1) AS nn, round(-n / logs, 6) AS lid, round(mean / (SELECT d FROM r WHERE r = 1), 6) AS rc1,
  round(mean / (SELECT d FROM r WHERE r = 10), 6) AS rc10, round(mean / (SELECT d FROM r WHERE r = 100), 6) AS rc100 FROM a, l""",
)
def _(spark, sf):
    out = measures.difficulty(f1(spark, sf), WH, 100)
    return out.select("i", "nn", *[F.round(c, 6).alias(c) for c in ("lid", "rc1", "rc10", "rc100")])


@query(
    "zdot_functions",
    f"""WITH {SUB1},\n{ONE}, o AS (SELECT q, qx, list_avg(qx) AS qm FROM one), w AS (SELECT *, sqrt(list_sum(list_transform(qx, lambda e: (e - qm) * (e - qm))) / {WH}) AS qs FROM o)
SELECT i, round(list_dot_product(z, q), 5) AS zdot, round(sqrt(greatest(0, 2 * {WH} - 2 * list_dot_product(z, q))), 4) AS via_dot,
  CASE WHEN list_distance(z, q) <= 5 THEN round(list_distance(z, q), 6) END AS within FROM zs, w WHERE i <> 100""",
)
def _(spark, sf):
    z = W.znormalized_subsequences(f1(spark, sf), WH)
    one = z.where("i = 100").select(F.col("x").alias("qx"), F.col("m").alias("qm"), F.col("sd").alias("qs"), F.col("z").alias("q"))
    both = z.where("i <> 100").crossJoin(F.broadcast(one))  # one row
    zdot = D.zdot(F.col("x"), F.col("m"), F.col("sd"), F.col("qx"), F.col("qm"), F.col("qs"), WH)
    within = D.euclidean_within(F.col("z"), F.col("q"), 5.0)
    return both.select("i", F.round(zdot, 5).alias("zdot"), F.round(D.distance_of_zdot(zdot, WH), 4).alias("via_dot"), F.round(within, 6).alias("within"))


@query("each_dot", f"WITH {SUB1},\n{ONE} SELECT i, round(sqrt(abs(list_dot_product(subs.x, qx))) + i, 4) AS out FROM subs, one")
def _(spark, sf):
    dots = pairs.sliding_dot_product(f1(spark, sf), WH, 100)
    return pairs.each_dot(dots, lambda i, dot: np.sqrt(np.abs(dot)) + i).select("i", F.round("out", 4).alias("out"))


@query("distance_profile_expression", f"WITH {SUB1},\n{ONE} SELECT i, round(list_distance(z, q), 6) AS distance FROM zs, one")
def _(spark, sf):
    return pairs.distance_profile(f1(spark, sf), WH, 100, D.euclidean).select("i", F.round("distance", 6).alias("distance"))


@query("simhash", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings), o AS (SELECT x AS y FROM v WHERE vec_id = 0)
SELECT vec_id, round(1 - acos(least(1, greatest(-1, list_cosine_similarity(x, y)))) / pi(), 6) AS p FROM v, o WHERE vec_id <> 0""")
def _(spark, sf):
    v = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    one = v.where("vec_id = 0").select(F.col("x").alias("y"))
    cosine = F.try_divide(D.dot(F.col("x"), F.col("y")), D.norm(F.col("x")) * D.norm(F.col("y")))
    p = probability.simhash_probability(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    return v.where("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", F.round(p, 6).alias("p"))  # one row


@query(
    "rooted_motiflets",
    f"""WITH {SETS}, own AS (SELECT * FROM sets WHERE root % greatest(1, ((SELECT count(*) FROM f1) - {WH}) // 64) = 0)
SELECT support, min(extent) AS extent FROM own GROUP BY 1""",
)
def _(spark, sf):
    return motiflets.rooted(f1(spark, sf), WH, 3, WH).select("support", "extent")


@query("windowed", f"WITH {SUB1} SELECT i, round(m, 6) AS m, round(sd, 6) AS sd FROM subs")
def _(spark, sf):
    return W.windowed(f1(spark, sf), WH).select("i", F.round("m", 6).alias("m"), F.round("sd", 6).alias("sd"))


# hash tables


@query("lsh_hash", f"WITH {SUB1},\n{_hash_sql(WH)} SELECT rep, i, CAST(k AS BIGINT) AS k, h FROM flat")
def _(spark, sf):
    table = lsh.hash_series(f1(spark, sf), WH, TABLES, WIDTH)
    return table.select("rep", "i", F.posexplode("h").alias("k", "h")).withColumn("k", F.col("k").cast("long"))


_V6, _S6 = lsh.projections(64, 1)


@query(
    "lsh_hash_vectors",
    f"""WITH vs AS (SELECT vec_id AS i, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS z FROM embeddings),
{_hash_sql(64, 1, 0.5, 'vs')} SELECT rep, i, CAST(k AS BIGINT) AS k, h FROM flat""",
)
def _(spark, sf):
    vs = _t(spark, sf, "embeddings").select(F.lit(S.ALL).alias("series_id"), F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("z"))
    return lsh.hashes(vs, _V6, _S6, 0.5).select("rep", "i", F.posexplode("h").alias("k", "h")).withColumn("k", F.col("k").cast("long"))


@query(
    "lsh_prefix_eq",
    f"""WITH {HASH5}, p AS (SELECT unnest(range(1, 9)) AS prefix)
SELECT prefix, count(*) AS pairs FROM hashes x JOIN hashes y ON x.rep = y.rep AND x.i = 400 AND y.i <> 400, p
WHERE list_transform(x.h[1:prefix], lambda e: e & 255) = list_transform(y.h[1:prefix], lambda e: e & 255) GROUP BY 1""",
)
def _(spark, sf):
    table = _table5(spark, sf).select("rep", "i", lsh.packed(F.col("h")).alias("p"))
    one = table.where("i = 400").select("rep", F.col("p").alias("q"))
    same = table.where("i <> 400").join(one, "rep")
    counts = [F.count_if(lsh.packed_prefix_equal(F.col("p"), F.col("q"), k)).alias(str(k)) for k in range(1, 9)]
    wide = same.agg(*counts).unpivot([], [str(k) for k in range(1, 9)], "prefix", "pairs")
    return wide.where("pairs > 0").select(F.col("prefix").cast("long").alias("prefix"), "pairs")


@query(
    "projection_percentiles",
    f"""WITH {HASH5} SELECT rep, CAST(k AS BIGINT) AS k, quantile_disc(h, 0.01) AS p_low, quantile_disc(h, 0.99) AS p_high FROM flat GROUP BY 1, 2""",
)
def _(spark, sf):
    return lsh.projection_percentiles(_table5(spark, sf)).select("rep", F.col("k").cast("long").alias("k"), "p_low", "p_high")


MET = f"JOIN hashes y ON x.rep = y.rep AND x.h[1:{{p}}] = y.h[1:{{p}}] AND y.i - x.i >= {WP}"


@query("lsh_candidates", f"WITH {HASH5} SELECT x.rep, x.i AS a, y.i AS b FROM hashes x {MET.format(p=7)} WHERE x.h <> y.h")
def _(spark, sf):
    return lsh.candidates(_table5(spark, sf), 7, WP, 8).select("rep", "a", "b")


@query(
    "lsh_verified_pairs",
    f"""WITH {HASH5}, met AS (SELECT DISTINCT x.i AS a, y.i AS b FROM hashes x {MET.format(p=7)})
SELECT a, b, round(list_distance(p.z, q.z), 6) AS d FROM met JOIN zs p ON p.i = a JOIN zs q ON q.i = b WHERE round(list_distance(p.z, q.z), 6) <= 4""",
)
def _(spark, sf):
    z = W.znormalized_subsequences(f5(spark, sf), WP)
    out = lsh.verified(lsh.candidates(_table5(spark, sf), 7, WP), z).withColumn("d", F.round("d", 6))
    return out.where("d <= 4").select("a", "b", "d")


@query(
    "lsh_collision_profile",
    f"""WITH {HASH5}, p AS (SELECT unnest(range(1, 9)) AS prefix), c AS (SELECT rep, prefix, h[1:prefix] AS key, count(*) AS c FROM hashes, p GROUP BY 1, 2, 3)
SELECT rep, CAST(prefix AS INTEGER) AS prefix, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS collisions FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return lsh.collision_profile(_table5(spark, sf)).select("rep", "prefix", "collisions")


COUNTS = f"counts AS (SELECT rep, coalesce(n, 0) AS collisions FROM (SELECT DISTINCT rep FROM hashes) LEFT JOIN (SELECT x.rep, count(*) AS n FROM hashes x {MET.format(p=8)} GROUP BY 1) USING (rep))"


@query("lsh_collision_count", f"WITH {HASH5},\n{COUNTS} SELECT rep, collisions FROM counts")
def _(spark, sf):
    return lsh.collision_counts(_table5(spark, sf), 8, WP).select("rep", "collisions")


@query(
    "lsh_collision_estimate",
    f"""WITH {HASH5}, sizes AS (SELECT rep, h[1:5] AS key, count(*) AS c FROM hashes GROUP BY 1, 2), tot AS (SELECT rep, count(*) AS n FROM hashes GROUP BY 1),
big AS (SELECT rep, key, c, c > sqrt(n) AS large FROM sizes JOIN tot USING (rep)),
parts AS (SELECT rep, c * (c - 1) // 2 AS n FROM big WHERE large UNION ALL
  SELECT x.rep, 1 FROM hashes x {MET.format(p=5)} JOIN big ON big.rep = x.rep AND big.key = x.h[1:5] AND NOT large)
SELECT rep, CAST(coalesce(sum(parts.n), 0) AS BIGINT) AS collisions FROM tot LEFT JOIN parts USING (rep) GROUP BY 1""",
)
def _(spark, sf):
    return lsh.collision_estimate(_table5(spark, sf), 5, WP).select("rep", "collisions")


@query(
    "lsh_collision_stats",
    f"""WITH {HASH5},\n{COUNTS}, r AS (SELECT collisions, row_number() OVER (ORDER BY collisions, rep) AS r, count(*) OVER () AS n FROM counts)
SELECT min(collisions) AS least, max(collisions) FILTER (r = n // 2 + 1) AS median, max(collisions) AS most, round(avg(collisions), 6) AS mean FROM r""",
)
def _(spark, sf):
    out = lsh.collision_stats(lsh.collision_counts(_table5(spark, sf), 8, WP))
    return out.select("least", "median", "most", F.round("mean", 6).alias("mean"))


GRID = [(round(probability.collision_probability(d, 5.0), 9), prefix, reps, prev, 50) for d in (0.5, 1.0, 2.0, 4.0) for prefix, prev in ((8, None), (5, 6)) for reps in (1, 10, 40)]


@query(
    "lsh_failure_probability",
    "WITH g(p, prefix, reps, prev, maximum) AS (VALUES "
    + ", ".join(f"(CAST({p} AS DOUBLE), {k}, {r}, {'NULL' if v is None else v}, {m})" for p, k, r, v, m in GRID)
    + """) SELECT p, CAST(prefix AS INTEGER) AS prefix, CAST(reps AS INTEGER) AS reps,
  round(pow(1 - pow(p, prefix), reps) * coalesce(pow(1 - pow(p, prev), greatest(0, maximum - reps)), 1.0), 9) AS failure,
  round(1 - pow(1 - pow(p, prefix), reps), 9) AS success FROM g""",
)
def _(spark, sf):
    grid = spark.createDataFrame(GRID, "p double, prefix int, reps int, prev int, maximum int")
    failure = probability.failure_expr(F.col("p"), F.col("prefix"), F.col("reps"), F.col("prev"), F.col("maximum"))
    success = 1 - F.pow(1 - F.pow("p", "prefix"), "reps")
    return grid.select("p", "prefix", "reps", F.round(failure, 9).alias("failure"), F.round(success, 9).alias("success"))


@query(
    "lsh_collision_probability",
    """WITH d AS (SELECT 0.25 * k AS distance FROM (SELECT unnest(range(1, 41)) AS k)), grid AS (SELECT unnest(range(0, 4001)) AS j),
p AS (SELECT distance, sum(CASE WHEN j IN (0, 4000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * 2 / (distance * sqrt(2 * pi())) * exp(-pow(5.0 * j / 4000 / distance, 2) / 2) * (1 - j / 4000.0))
  * (5.0 / 4000) / 3 AS p FROM d, grid GROUP BY 1)
SELECT CAST(distance AS DOUBLE) AS distance, round(p, 7) AS p, CAST(ceil(ln(0.05) / ln(1 - pow(p, 8))) AS INTEGER) AS repetitions FROM p""",
)
def _(spark, sf):
    rows = [(0.25 * k, round(probability.collision_probability(0.25 * k, 5.0), 7), probability.repetitions_needed(0.25 * k, 5.0, 8, 0.05)) for k in range(1, 41)]
    return spark.createDataFrame(rows, "distance double, p double, repetitions int")


PLANTED = "(VALUES (400, 2000), (500, 2100), (600, 2200), (700, 2300), (800, 2400)) t(a, b)"


@query(
    "lsh_empirical_collision",
    f"""WITH {F5},\n{_subs('f5', WP)},\n{_hash_sql(WP, 12)} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(avg(CAST(x.h[1:1] = y.h[1:1] AS INTEGER)), 6) AS share
FROM {PLANTED} JOIN hashes x ON x.i = a JOIN hashes y ON y.i = b AND y.rep = x.rep GROUP BY 1, 2""",
)
def _(spark, sf):
    known = spark.createDataFrame([(400 + 100 * k, 2000 + 100 * k) for k in range(5)], "a long, b long")
    return lsh.empirical_collision(_table5(spark, sf, 12), known, 1).select("a", "b", F.round("share", 6).alias("share"))


@query("motifs_lsh", f"{R}{PAIR5},\n{_greedy('pairs', 5, WP)} {PICKED}")
def _(spark, sf):
    return planner.motifs(f5(spark, sf), WP, 5, WP, "lsh", delta=0.01).select("rank", "a", "b", "distance")


MEMBERS = "SELECT support, g AS pos, idx[g + 1] AS idx, extent FROM best, (SELECT unnest(range(3)) AS g) WHERE g < support"


def _motiflets5(spark, sf, **options):
    found = list(planner.MotifletsIterator(f5(spark, sf), WP, 3, 1, WP, 0.01, **options))
    rows = [(m.support, pos, i, m.extent, m.confirmed) for m in found for pos, i in enumerate(m.indices)]
    return spark.createDataFrame(rows, "support int, pos long, idx long, extent double, confirmed boolean")


@query("motiflets_lsh", f"WITH {_knn(PAIR5, WP, False)}{SETS_OF},\n{BEST} {MEMBERS}")
def _(spark, sf):
    return _motiflets5(spark, sf).where("confirmed").drop("confirmed")


@query("motiflets_lsh_early_stop")
def _(spark, sf):
    return _motiflets5(spark, sf, fraction_threshold=0.002, stop_on_threshold=True)


# other methods


@query(
    "prescrimp_profile",
    f"""WITH {PAIR1}, near AS (SELECT src AS s, dst AS j FROM dirs WHERE src % 6 = 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1),
spread AS (SELECT DISTINCT least(s + k, j + k) AS a, greatest(s + k, j + k) AS b FROM near, (SELECT unnest(range(-5, 6)) AS k)),
hit AS MATERIALIZED (SELECT a, b, d FROM spread JOIN pairs USING (a, b)), two AS (SELECT a AS i, b AS j, d FROM hit UNION ALL SELECT b, a, d FROM hit)
SELECT i, d AS nn_dist, j AS nn_idx FROM two QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1""",
)
def _(spark, sf):
    return prescrimp.approximate_profile(f1(spark, sf), WH, WH, 6).select("i", "nn_dist", "nn_idx")


SAX = """words AS (SELECT i, list_transform(range(4), lambda c: CAST(len(list_filter([-0.67, 0.0, 0.67],
  lambda b: CAST(b AS DOUBLE) < round(list_sum(z[c * 6 + 1:c * 6 + 6]) / 6, 9))) AS INTEGER)) AS word FROM zs)"""


@query("sax_words", f"WITH {SUB1},\n{SAX} SELECT i, array_to_string(word, '') AS word FROM words")
def _(spark, sf):
    return sax.sax_words(f1(spark, sf), WH, 6, 4).select("i", F.array_join(F.transform("word", lambda x: x.cast("string")), "").alias("word"))


@query("sax_rle", f"WITH {SUB1},\n{SAX}, l AS (SELECT i, word, lag(word) OVER (ORDER BY i) AS last FROM words) SELECT i, array_to_string(word, '') AS word FROM l WHERE last IS NULL OR word <> last")
def _(spark, sf):
    kept = sax.drop_repeats(sax.sax_words(f1(spark, sf), WH, 6, 4))
    return kept.select("i", F.array_join(F.transform("word", lambda x: x.cast("string")), "").alias("word"))


SAMPLES = [[0, 2], [1, 3], [0, 3], [1, 2]]


@query(
    "sax_projection",
    f"""WITH {SUB1},\n{SAX}, s(rep, p, q) AS (VALUES (0, 0, 2), (1, 1, 3), (2, 0, 3), (3, 1, 2)),
kept AS (SELECT i, word FROM (SELECT i, word, lag(word) OVER (ORDER BY i) AS last FROM words) WHERE last IS NULL OR word <> last),
m AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM kept x JOIN kept y ON y.i - x.i >= {WH} JOIN s ON x.word[p + 1] = y.word[p + 1] AND x.word[q + 1] = y.word[q + 1] GROUP BY 1, 2)
SELECT a, b, n, CAST(level AS INTEGER) AS level FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS level FROM m) WHERE level <= 2""",
)
def _(spark, sf):
    words = sax.drop_repeats(sax.sax_words(f1(spark, sf), WH, 6, 4))
    return sax.most_collisions(sax.projection_collisions(words, SAMPLES, WH), 2).select("a", "b", "n", "level")


@query(
    "trivial_filter",
    f"""{R}{PAIR1}, ranked AS (SELECT row_number() OVER (ORDER BY d, a, b) AS rk, a, b, d FROM pairs ORDER BY d, a, b LIMIT 60),
kept AS (SELECT row_number() OVER (ORDER BY rk) AS n, * FROM ranked WHERE b - a > {WH}),
fold(n, pa, pb, keep) AS (SELECT CAST(1 AS BIGINT), a, b, true FROM kept WHERE n = 1 UNION ALL
  SELECT k.n, CASE WHEN ok THEN k.a ELSE pa END, CASE WHEN ok THEN k.b ELSE pb END, ok FROM fold f JOIN
    (SELECT n, a, b FROM kept) k ON k.n = f.n + 1, LATERAL (SELECT list_sort([k.a, k.b, pa, pb]) AS s) l, LATERAL (SELECT s[2] - s[1] >= {WH} AND s[3] - s[2] >= {WH} AND s[4] - s[3] >= {WH} AS ok) o)
SELECT CAST(rk AS INTEGER) AS rank, a, b, d AS distance FROM kept JOIN fold USING (n) WHERE keep""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    top = _pairs1(spark, sf).orderBy("d", "a", "b").limit(60)
    ranked = top.select(F.row_number().over(Window.orderBy("d", "a", "b")).alias("rank"), "a", "b", F.col("d").alias("distance"))
    return greedy.drop_trivial(ranked, WH)


@query(
    "motif_recall",
    f"""{R}{PAIR1},\n{_greedy('pairs', 10, WH)},\n{NEAREST}, found AS (SELECT least(i, nn_idx) AS a, greatest(i, nn_idx) AS b FROM near ORDER BY nn_dist, i LIMIT 8)
SELECT count(*) AS n_truth, count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE abs(f.a - pick.a) <= {WH} OR abs(f.b - pick.b) <= {WH})) AS n_found,
  round(count(*) FILTER (EXISTS (SELECT 1 FROM found f WHERE abs(f.a - pick.a) <= {WH} OR abs(f.b - pick.b) <= {WH})) / count(*), 6) AS recall FROM pick""",
)
def _(spark, sf):
    s = f1(spark, sf)
    truth = greedy.motifs_exact(s, WH, 10, WH, "kernel")
    near = pairs.matrix_profile(s, WH, WH, "kernel").orderBy("nn_dist", "i").limit(8).select(F.least("i", "nn_idx").alias("a"), F.greatest("i", "nn_idx").alias("b"))
    return evaluate.recall(truth, near, WH).select("n_truth", "n_found", F.round("recall", 6).alias("recall"))


@query(
    "sax_projection_motifs",
    f"""{R}{SUB1},\n{SAX}, s(rep, p, q) AS (VALUES (0, 0, 2), (1, 1, 3), (2, 0, 3), (3, 1, 2)),
kept AS (SELECT i, word FROM (SELECT i, word, lag(word) OVER (ORDER BY i) AS last FROM words) WHERE last IS NULL OR word <> last),
m AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM kept x JOIN kept y ON y.i - x.i >= {WH} JOIN s ON x.word[p + 1] = y.word[p + 1] AND x.word[q + 1] = y.word[q + 1] GROUP BY 1, 2),
likely AS MATERIALIZED (SELECT a, b, round(list_distance(p.z, q.z), 6) AS d FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS level FROM m) t
  JOIN zs p ON p.i = a JOIN zs q ON q.i = b WHERE level <= 2),\n{_greedy('likely', 5, WH)} {PICKED}""",
)
def _(spark, sf):
    return sax.projection_motifs(f1(spark, sf), WH, 6, 4, SAMPLES, 5, WH, 2).select("rank", "a", "b", "distance")


@query("out_of_range_hashes", f"WITH {HASH5} SELECT rep, count(*) FILTER (len(list_filter(h, lambda e: abs(e) > 2)) > 0) AS n FROM hashes GROUP BY 1")
def _(spark, sf):
    return _table5(spark, sf).groupBy("rep").agg(F.count_if(~D.in_range(F.col("h"), 2)).alias("n"))


@query("sampled_slice_min", f"WITH {PAIR1}, r AS (SELECT src, dst, d FROM dirs QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 100) SELECT src, dst, d FROM r")
def _(spark, sf):
    return X.slice_min(pairs.neighbours(_pairs1(spark, sf)), ["src"], "d", 100, "dst").select("src", "dst", "d")


# experiment tables

RUNS_SQL = """runs AS MATERIALIZED (SELECT concat('set-', o_custkey % 40) || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('-', 1000 * (o_custkey % 7)) END AS dataset,
  CASE WHEN o_orderkey % 2 = 0 THEN 'lsh' ELSE 'scan' END AS algorithm, CAST(year(o_orderdate) AS INTEGER) AS version, o_totalprice AS time_s,
  CAST(to_json(m) AS VARCHAR) AS motif_pairs FROM orders JOIN
  (SELECT l_orderkey, list({'a': l_partkey, 'b': l_suppkey, 'dist': l_quantity} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of experiments as the orders and their lines give them: a data set, an algorithm, a version, a time, and motif pairs as JSON."""
    one = F.struct("l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("dist"))
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("m"))
    found = F.transform("m", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["dist"].alias("dist")))
    key = F.col("o_custkey")
    tail = F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (1000 * (key % 7)).cast("string")))
    rows = _t(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.concat(F.lit("set-"), (key % 40).cast("string"), tail).alias("dataset"),
        F.when(F.col("o_orderkey") % 2 == 0, "lsh").otherwise("scan").alias("algorithm"),
        F.year("o_orderdate").alias("version"),
        F.col("o_totalprice").alias("time_s"),
        F.to_json(found).alias("motif_pairs"),
    )


@query(
    "json_motif_unnest",
    f"""WITH {RUNS_SQL}, j AS (SELECT dataset, algorithm, version, from_json(motif_pairs, '[{{"a":"BIGINT","b":"BIGINT","dist":"DOUBLE"}}]') AS m,
  CAST(json_extract_string(motif_pairs, '$[0].dist') AS DOUBLE) AS first FROM runs)
SELECT dataset, algorithm, version, CAST(g AS INTEGER) AS pos, m[g + 1].a AS a, m[g + 1].b AS b, m[g + 1].dist AS dist, first FROM j, (SELECT unnest(range(40)) AS g) WHERE g < len(m)""",
)
def _(spark, sf):
    runs = _runs(spark, sf).drop("time_s").withColumn("first", X.json_path("motif_pairs", "$[0].dist"))
    return X.unnest_pairs(runs)


@query("exp_props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.json_path("props", "$.k").alias("k"))


@query("exp_scan_filter", f"WITH {RUNS_SQL} SELECT dataset, algorithm, time_s FROM runs WHERE version = (SELECT max(version) FROM runs)")
def _(spark, sf):
    return X.latest_version(_runs(spark, sf)).select("dataset", "algorithm", "time_s")


@query("exp_anti_join", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    return X.not_yet_run(_t(spark, sf, "documents").select("doc_id", "source"), _t(spark, sf, "labels").select("doc_id"), ["doc_id"])


@query(
    "exp_joins",
    """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) GROUP BY 1""",
)
def _(spark, sf):
    nation, customer, orders, supplier = (_t(spark, sf, t) for t in ("nation", "customer", "orders", "supplier"))
    own = nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "right").join(own, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    return own.groupBy("n_name").agg(
        F.count_distinct("c_custkey").alias("customers"),
        F.count("o_orderkey").alias("orders"),
        F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0)), 2).alias("total"),
    )


@query(
    "exp_lead_phases",
    """SELECT user_id, event_id, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - epoch_us(ts)) AS duration,
  epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since_first FROM events""",
)
def _(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return X.phases(rows, ["user_id"], "at").select("user_id", "event_id", "duration", "since_first")


@query(
    "exp_pivot",
    f"""WITH {RUNS_SQL} SELECT dataset, min(time_s) FILTER (algorithm = 'lsh') AS lsh_best, round(sum(time_s) FILTER (algorithm = 'lsh'), 2) AS lsh_total,
  min(time_s) FILTER (algorithm = 'scan') AS scan_best, round(sum(time_s) FILTER (algorithm = 'scan'), 2) AS scan_total FROM runs GROUP BY 1""",
)
def _(spark, sf):
    wide = X.pivoted(_runs(spark, sf), "dataset", "algorithm", ["lsh", "scan"], best=F.min("time_s"), total=F.sum("time_s"))
    return wide.select("dataset", "lsh_best", F.round("lsh_total", 2).alias("lsh_total"), "scan_best", F.round("scan_total", 2).alias("scan_total"))


@query(
    "exp_best",
    f"""WITH {RUNS_SQL} SELECT dataset, algorithm, version, time_s, time_s = min(time_s) OVER (PARTITION BY dataset) AS is_best FROM runs
QUALIFY rank() OVER (PARTITION BY dataset, algorithm ORDER BY time_s) = 1""",
)
def _(spark, sf):
    marked = X.mark_best(_runs(spark, sf), ["dataset"], "time_s")
    return X.best_of_group(marked, ["dataset", "algorithm"], "time_s").select("dataset", "algorithm", "version", "time_s", "is_best")


@query(
    "exp_names",
    f"""WITH {RUNS_SQL} SELECT DISTINCT dataset, regexp_replace(dataset, '-[0-9]+$', '') AS name, CAST(nullif(regexp_extract(dataset, '-([0-9]+)$', 1), '') AS BIGINT) AS size,
  CASE algorithm WHEN 'lsh' THEN 'hashing' ELSE 'all pairs' END AS label FROM runs""",
)
def _(spark, sf):
    label = F.when(F.col("algorithm") == "lsh", "hashing").otherwise("all pairs")
    return _runs(spark, sf).select("dataset", *X.parts_of_name("dataset"), label.alias("label")).distinct()


@query(
    "exp_stack",
    f"WITH {RUNS_SQL} SELECT dataset, time_s, CAST(NULL AS BIGINT) AS n FROM runs WHERE algorithm = 'lsh' UNION ALL SELECT dataset, NULL, count(*) FROM runs GROUP BY dataset",
)
def _(spark, sf):
    runs = _runs(spark, sf)
    return X.stacked(runs.where("algorithm = 'lsh'").select("dataset", "time_s"), runs.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))


@query(
    "extent_ratio",
    """WITH e AS (SELECT l_shipmode_key AS dataset, l_linenumber AS support, kind, min(x) AS extent FROM
  (SELECT l_returnflag AS l_shipmode_key, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'exact' ELSE 'found' END AS kind, l_extendedprice AS x FROM lineitem) GROUP BY 1, 2, 3),
w AS (SELECT dataset, support, min(extent) FILTER (kind = 'exact') AS ex, min(extent) FILTER (kind = 'found') AS fo FROM e GROUP BY 1, 2)
SELECT dataset, round(max(fo / ex), 6) AS worst_ratio FROM w GROUP BY 1""",
)
def _(spark, sf):
    rows = _t(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linenumber").alias("support"),
        F.when(F.col("l_linestatus") == "O", "exact").otherwise("found").alias("kind"),
        F.col("l_extendedprice").alias("extent"),
    )
    return X.extent_ratio(rows).select("dataset", F.round("worst_ratio", 6).alias("worst_ratio"))


@query(
    "regr_linear",
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    fit = X.linear_fit(_t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return fit.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(
    "regr_quadratic",
    """WITH p AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS a0, sum(x) AS a1, sum(x * x) AS a2, sum(x * x * x) AS a3, sum(x * x * x * x) AS a4, sum(y) AS b0, sum(x * y) AS b1, sum(x * x * y) AS b2 FROM p GROUP BY g),
e AS (SELECT g, a0, a1, a2, b0, a2 - a1 * a1 / a0 AS u11, a3 - a1 * a2 / a0 AS u12, a4 - a2 * a2 / a0 AS u22, b1 - a1 * b0 / a0 AS v1, b2 - a2 * b0 / a0 AS v2 FROM s),
c AS (SELECT *, (v2 - u12 * v1 / u11) / (u22 - u12 * u12 / u11) AS c2 FROM e), d AS (SELECT *, (v1 - u12 * c2) / u11 AS c1 FROM c)
SELECT g, round((b0 - a1 * c1 - a2 * c2) / a0, 4) AS c0, round(c1, 4) AS c1, round(c2, 5) AS c2 FROM d""",
)
def _(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return X.quadratic_fit(rows, "g", "x", "y").select("g", F.round("c0", 4).alias("c0"), F.round("c1", 4).alias("c1"), F.round("c2", 5).alias("c2"))


SIZES = ["10 GB", "512k", "7", "1.5 mb", "3 bytes", "2 parsecs"]


@query(
    "byte_sizes",
    "SELECT * FROM (VALUES ('10 GB', 10737418240), ('512k', 524288), ('7', 7), ('1.5 mb', 1572864), ('3 bytes', 3), ('2 parsecs', NULL)) t(text, bytes)",
)
def _(spark, sf):
    return spark.createDataFrame([(s,) for s in SIZES], "text string").select("text", D.byte_size(F.col("text")).alias("bytes"))


@query("durations", "SELECT * FROM (VALUES (CAST(5.0 AS DOUBLE), '5.0 s'), (90.0, '1.5 m'), (7200.0, '2.0 h'), (172800.0, '2.0 days'), (63072000.0, '2.0 years')) t(seconds, label)")
def _(spark, sf):
    rows = spark.createDataFrame([(5.0,), (90.0,), (7200.0,), (172800.0,), (63072000.0,)], "seconds double")
    return rows.select("seconds", D.format_duration(F.col("seconds")).alias("label"))


@query(
    "vector_functions",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings), o AS (SELECT x AS y FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(x, y), 6) AS dot, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(list_distance(x, y), 6) AS euclid,
  CASE WHEN list_distance(x, y) <= 1.2 THEN round(list_distance(x, y), 6) END AS near FROM v, o""",
)
def _(spark, sf):
    v = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    one = v.where("vec_id = 0").select(F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    euclid = D.euclidean(x, y)
    return v.crossJoin(F.broadcast(one)).select(  # one row
        "vec_id", F.round(D.dot(x, y), 6).alias("dot"), F.round(D.norm(x), 6).alias("norm"), F.round(euclid, 6).alias("euclid"), F.round(D.within(euclid, 1.2), 6).alias("near")
    )


@query(
    "overlap_predicates",
    f"""SELECT a.i AS i, abs(a.i - 10) < {WH} AS one, len(list_filter([10, 30, 200], lambda p: abs(p - a.i) < {WH})) AS n,
  len(list_filter([10, 30, 200], lambda p: abs(p - a.i) < {WH})) > 0 AS some FROM (SELECT unnest(range(300)) AS i) a""",
)
def _(spark, sf):
    at = F.array(*[F.lit(p).cast("long") for p in (10, 30, 200)])
    rows = spark.range(300).select(F.col("id").alias("i"))
    return rows.select("i", D.overlaps(F.col("i"), F.lit(10), WH).alias("one"), D.overlap_count(F.col("i"), at, WH).cast("long").alias("n"), D.overlaps_any(F.col("i"), at, WH).alias("some"))


@query("stream_series_build", "SELECT date_trunc('hour', ts) AS slot, round(sum(value), 2) AS s, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    base = scratch(spark, "stream")
    out = series_stream.build_series(spark, sf, schema, f"{base}/checkpoint", f"{base}/sums", glob="events.parquet")
    return out.select(F.col("slot").cast("timestamp_ntz").alias("slot"), F.round("s", 2).alias("s"), "n")


# files


def _written_events(spark: SparkSession, sf: str, kind: str) -> str:
    """The events as files of one kind in a fresh folder, one file so that its order is that of the events."""
    path = scratch(spark, kind)
    rows = _t(spark, sf, "events").orderBy("event_id").coalesce(1)
    if kind == "text":
        rows.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").text(path)
    elif kind == "csv":
        rows.select("event_type", "value").write.csv(path, sep="\t")
    else:
        rows.select("event_id", F.struct("event_type", F.array("value").alias("values")).alias("run")).write.json(path)
    return path


@query("src_gzip_text", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS v FROM events")
def _(spark, sf):
    return S.read_text(spark, _written_events(spark, sf, "text")).select("i", "v")


@query("src_gzip_text_prefix", "SELECT i, v FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS v FROM events) WHERE i < 300")
def _(spark, sf):
    return S.read_text(spark, _written_events(spark, sf, "text"), 300).select("i", "v")


@query("src_csv_named", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS v FROM events")
def _(spark, sf):
    return S.read_csv(spark, _written_events(spark, sf, "csv"), "amount", "\t", names=["kind", "amount"]).select("i", "v")


@query("src_json_documents", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(spark, sf):
    rows = spark.read.json(_written_events(spark, sf, "json"), schema="event_id long, run struct<event_type:string,values:array<double>>")
    return rows.select("run.event_type", F.explode("run.values").alias("v")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("sink_motif_pairs", f"{R}{PAIR1},\n{_greedy('pairs', 5, WH)} SELECT a, b, d AS dist FROM pick")
def _(spark, sf):
    path = scratch(spark, "pairs")
    sinks.write_motif_pairs(planner.motifs(f1(spark, sf), WH, 5, WH), path)
    return spark.read.csv(path, header=True, schema="a long, b long, dist double")


@query("sink_profile", f"WITH {SUB1},\n{ONE} SELECT i, round(list_distance(z, q), 6) AS distance FROM zs, one WHERE list_distance(z, q) <= 6")
def _(spark, sf):
    path = scratch(spark, "profile")
    sinks.write_profile(pairs.distance_profile(f1(spark, sf), WH, 100), path, 6.0)
    return spark.read.csv(path, header=True, schema="i long, distance double").select("i", F.round("distance", 6).alias("distance"))


@query(
    "sink_measures_append",
    f"""WITH {SUB1},\n{ONE}, far AS (SELECT i, round(list_distance(z, q), 6) AS d FROM zs, one WHERE abs(i - 100) > {WH})
SELECT CAST(100 AS BIGINT) AS i, min(d) AS nn FROM far UNION ALL SELECT 100, min(d) FROM far""",
)
def _(spark, sf):
    path = scratch(spark, "measures")
    for _again in range(2):
        sinks.append_measures(measures.difficulty(f1(spark, sf), WH, 100).select("i", "nn"), path)
    return spark.read.csv(path, header=True, schema="i long, nn double")


@query("sink_parquet_new_only", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "results")
    docs = _t(spark, sf, "documents").select("doc_id").distinct()
    sinks.append_new(docs.where("doc_id % 3 = 0"), None, ["doc_id"], path)
    sinks.append_new(docs, spark.read.parquet(path), ["doc_id"], path)
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("sink_versioned", "SELECT 1 AS schema_version, count(*) AS n, CAST(0 AS BIGINT) AS named FROM nation UNION ALL SELECT 2, count(*), count(n_name) FROM nation")
def _(spark, sf):
    path = scratch(spark, "versions")
    sinks.append_versioned(_t(spark, sf, "nation").select("n_nationkey"), path, 1)
    sinks.append_versioned(_t(spark, sf, "nation").select("n_nationkey", "n_name"), path, 2)
    return sinks.read_versioned(spark, path).groupBy("schema_version").agg(F.count(F.lit(1)).alias("n"), F.count("n_name").alias("named"))


@query(
    "regr_fill_missing",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS x, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) / 1000 END AS y FROM lineitem),
s AS (SELECT g, CAST(count(*) AS DOUBLE) AS a0, sum(x) AS a1, sum(x * x) AS a2, sum(x * x * x) AS a3, sum(x * x * x * x) AS a4, sum(y) AS b0, sum(x * y) AS b1, sum(x * x * y) AS b2 FROM p WHERE y IS NOT NULL GROUP BY g),
e AS (SELECT g, a0, a1, a2, b0, a2 - a1 * a1 / a0 AS u11, a3 - a1 * a2 / a0 AS u12, a4 - a2 * a2 / a0 AS u22, b1 - a1 * b0 / a0 AS v1, b2 - a2 * b0 / a0 AS v2 FROM s),
c AS (SELECT *, (v2 - u12 * v1 / u11) / (u22 - u12 * u12 / u11) AS c2 FROM e), d AS (SELECT *, (v1 - u12 * c2) / u11 AS c1 FROM c)
SELECT x, p.g AS g, round(avg((b0 - a1 * c1 - a2 * c2) / a0 + c1 * x + c2 * x * x), 3) AS y, count(*) AS n FROM p JOIN d USING (g) WHERE y IS NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    y = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice").cast("double") / 1000)
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), y.alias("y"))
    filled = X.fill_missing(rows, "g", "x", "y").where("is_predicted")
    return filled.groupBy("x", "g").agg(F.round(F.avg("y"), 3).alias("y"), F.count(F.lit(1)).alias("n"))


@query("models_by_group", "SELECT l_returnflag AS g, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS c0, round(regr_slope(l_extendedprice / 1000, l_quantity), 4) AS c1 FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return X.models(rows, "g", "x", "y", 1).select("g", F.round(F.col("coefficients")[0], 4).alias("c0"), F.round(F.col("coefficients")[1], 4).alias("c1"))


@query(
    "exp_collapse",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'seen' WHEN event_type = 'purchase' THEN 'bought' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1""",
)
def _(spark, sf):
    kind = X.collapsed("event_type", {"click": "seen", "view": "seen", "purchase": "bought"})
    return _t(spark, sf, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("exp_sweep", "SELECT CAST(w AS BIGINT) AS w, delta, seed FROM (SELECT unnest([50, 100]) AS w), (SELECT unnest([0.1, 0.2, 0.5]::DOUBLE[]) AS delta), (SELECT CAST(unnest(range(29)) AS BIGINT) AS seed)")
def _(spark, sf):
    return X.sweep(spark, w=[50, 100], delta=[0.1, 0.2, 0.5], seed=list(range(29)))


@query("prefix_share", f"WITH {F1} SELECT i, v FROM f1 WHERE i < floor((SELECT count(*) FROM f1) * 0.4)")
def _(spark, sf):
    return S.share_of(f1(spark, sf), 0.4).select("i", "v")


@query("positions", "SELECT unnest(range(3, 100, 7)) AS i")
def _(spark, sf):
    return S.positions(spark, 3, 100, 7)
