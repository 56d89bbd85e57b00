"""Edges and properties of the operators on small series."""

from __future__ import annotations

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.functions import distance as D
from motifloom.functions import probability
from motifloom.operators import evaluate, greedy, lsh, measures, motiflets, pairs
from motifloom.operators import windows as W
from motifloom.plans import planner
from motifloom.sources import series as S
from motifloom.sources import sinks


def walk(n, seed=1):
    return np.cumsum(np.random.default_rng(seed).normal(size=n)).tolist()


def brute_pairs(values, w, ez):
    x = np.array(values)
    z = {}
    for i in range(len(x) - w):
        s = x[i : i + w]
        if s.std() > 1e-4:
            z[i] = (s - s.mean()) / s.std()
    return {(a, b): float(np.sqrt(((z[a] - z[b]) ** 2).sum())) for a in z for b in z if b - a >= ez}


def test_constant_and_short_series_have_no_pairs(spark):
    for values in ([5.0] * 40, walk(8), walk(5), []):
        s = S.from_values(spark, values)
        assert pairs.all_pairs(s, 8, 8).count() == 0
        assert planner.motifs(s, 8, 3).count() == 0
        assert list(planner.MotifletsIterator(s, 8)) == []
    stats = W.series_stats(S.from_values(spark, [5.0] * 40), 8).first()
    assert (stats["n_subsequences"], stats["n_flat"]) == (32, 32)


def test_both_tiers_agree_with_definition(spark):
    values = walk(150)
    expected = brute_pairs(values, 10, 12)
    s = S.from_values(spark, values)
    for tile in (16, 256):
        got = {(r["a"], r["b"]): r["d"] for r in pairs.all_pairs(s, 10, 12, tile).collect()}
        assert got.keys() == expected.keys()
        assert max(abs(got[k] - expected[k]) for k in got) < 1e-9
    near = {r["i"]: r["nn_dist"] for r in pairs.matrix_profile(s, 10, 12, "kernel", 32).collect()}
    for i, d in near.items():
        assert d == pytest.approx(min(v for k, v in expected.items() if i in k), abs=1e-6)
    bound = sorted(expected.values())[40]
    within = {(r["a"], r["b"]) for r in pairs.pairs_within(s, 10, 12, bound, 32).collect()}
    assert within == {k for k, v in expected.items() if v <= bound}
    one = planner.motifs(s, 10, 4, 12, "expression").collect()
    two = planner.motifs(s, 10, 4, 12, "kernel").collect()
    assert [(r["a"], r["b"]) for r in one] == [(r["a"], r["b"]) for r in two]


def test_rolling_statistics_in_small_tiles(spark):
    values = walk(300, 3)
    s = S.from_values(spark, values)
    x = np.array(values)
    for f in (W.rolling_stats, W.rolling_stats_fast):
        got = {r["i"]: r for r in f(s, 12, 48).collect()}
        assert sorted(got) == list(range(300 - 12))
        assert max(abs(got[i]["m"] - x[i : i + 12].mean()) for i in got) < 1e-9
        assert max(abs(got[i]["sd"] - x[i : i + 12].std()) for i in got) < 1e-7


def test_distances_do_not_change_under_affine_maps(spark):
    values = walk(90, 5)
    a = pairs.all_pairs(S.from_values(spark, values), 9, 9).orderBy("a", "b").collect()
    b = pairs.all_pairs(S.from_values(spark, [3 * v - 7 for v in values]), 9, 9).orderBy("a", "b").collect()
    assert max(abs(x["d"] - y["d"]) for x, y in zip(a, b)) < 1e-9


def test_exact_repeat_is_found_at_zero(spark):
    base = walk(30, 7)
    values = base + walk(40, 8) + base + walk(20, 9)
    top = planner.motifs(S.from_values(spark, values), 20, 1).first()
    assert (top["b"] - top["a"], top["distance"]) == (70, 0.0)


def test_motiflets_match_a_plain_search(spark):
    values, w, ez = walk(70, 11), 8, 8
    d = brute_pairs(values, w, ez)
    near = {}
    for (a, b), v in d.items():
        near.setdefault(a, []).append((round(v, 6), b))
        near.setdefault(b, []).append((round(v, 6), a))
    best = {}
    for root, others in near.items():
        chosen = [root]
        for v, j in sorted(others):
            if all(abs(j - c) >= ez for c in chosen) and len(chosen) < 4:
                chosen.append(j)
                extent = max(round(d[tuple(sorted((x, y)))], 6) for x in chosen for y in chosen if x < y)
                best[len(chosen)] = min(best.get(len(chosen), (math.inf, [])), (extent, sorted(chosen)))
    got = motiflets.motiflets_exact(S.from_values(spark, values), w, 4, ez).collect()
    assert {r["support"]: (r["extent"], r["indices"]) for r in got} == best


def test_hashed_motifs_are_the_exact_ones_with_planted_copies(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(1500)]
    for k in range(3):
        for t in range(30):
            values[900 + 150 * k + t] = values[100 * k + t] * 2 + 1 + rng.gauss(0, 0.01 * (k + 1))
    s = S.from_values(spark, values)
    exact = {(r["a"], r["b"]) for r in planner.motifs(s, 30, 3, 30, "kernel").collect()}
    hashed = {(r["a"], r["b"]) for r in planner.motifs(s, 30, 3, 30, "lsh", 0.01).collect()}
    assert exact == hashed == {(100 * k, 900 + 150 * k) for k in range(3)}


def test_greedy_pieces():
    top = greedy.TopK(2, 5)
    for d, a, b in ((3.0, 50, 70), (1.0, 0, 10), (1.5, 2, 12), (2.0, 20, 30)):
        top.insert(d, b, a)
    assert top.to_list() == [(1.0, 0, 10), (2.0, 20, 30)]
    assert top.kth_distance() == 2.0
    assert top.first_not_confirmed(lambda d: d < 1.8) == (2.0, 20, 30)


def test_trivial_filter_compares_with_the_kept_pair_before(spark):
    ranked = spark.createDataFrame([(1, 0, 50, 1.0), (2, 1, 51, 1.1), (3, 100, 150, 1.2), (4, 0, 5, 1.3)], "rank int, a long, b long, distance double")
    assert [r["rank"] for r in greedy.drop_trivial(ranked, 10).collect()] == [1, 3]


def test_recall_needs_one_side(spark):
    pair = "a long, b long"
    out = evaluate.recall(spark.createDataFrame([(0, 100), (200, 300)], pair), spark.createDataFrame([(3, 500)], pair), 5).first()
    assert (out["n_truth"], out["n_found"], out["recall"]) == (2, 1, 0.5)


def test_text_files_blank_and_malformed_lines(spark, tmp_path):
    plain, packed = tmp_path / "a.txt", tmp_path / "b.txt.gz"
    plain.write_text("1\n\n 2.5 \n3x\n-4e1\n")
    packed.write_bytes(gzip.compress(b"5\n6\n\n7\n"))
    assert [r["v"] for r in S.read_text(spark, str(plain), strict=False).orderBy("i").collect()] == [1.0, 2.5, -40.0]
    with pytest.raises(Exception):
        S.read_text(spark, str(plain)).collect()
    assert [(r["i"], r["v"]) for r in S.read_text(spark, str(packed), 2).orderBy("i").collect()] == [(0, 5.0), (1, 6.0)]
    table = tmp_path / "c.tsv"
    table.write_text("1\ta\n2\tb\n3\tc\n")
    assert [r["v"] for r in S.read_csv(spark, str(table), 0, "\t").orderBy("i").collect()] == [1.0, 2.0, 3.0]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(2, [1, 9], 0.5)], "support int, indices array<long>, extent double")
    sinks.write_motiflets(m, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "0.5, 1, 9"
    runs = spark.createDataFrame([("x", 1)], "k string, v int")
    sinks.append_new(runs, None, ["k"], str(tmp_path / "r"))
    sinks.append_new(runs.union(spark.createDataFrame([("y", 2)], runs.schema)), spark.read.parquet(str(tmp_path / "r")), ["k"], str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    sinks.write_series_text(S.from_values(spark, [1.0, 2.0]), str(tmp_path / "s"))
    assert [r["v"] for r in S.read_text(spark, str(tmp_path / "s")).orderBy("i").collect()] == [1.0, 2.0]
    log = sinks.Observations()
    log.note(1, 8, "candidates", 3)
    assert log.frame(spark).first()["value"] == 3.0


def test_probabilities():
    assert probability.collision_probability(0, 5) == 1
    assert probability.failure_probability(1.0, 5.0, 10, 8) < probability.failure_probability(1.0, 5.0, 5, 8) < 1
    n = probability.repetitions_needed(2.0, 5.0, 8, 0.05)
    assert probability.failure_probability(2.0, 5.0, n, 8) <= 0.05 < probability.failure_probability(2.0, 5.0, n - 1, 8)
    d = probability.largest_confirmed(10.0, 5.0, 20, 8, 0.05)
    assert probability.failure_probability(d, 5.0, 20, 8) < 0.05
    assert probability.normal_cdf(0) == 0.5


def test_collision_share_follows_the_formula(spark):
    values = walk(400, 2)
    table = lsh.hash_series(S.from_values(spark, values), 16, 60, 5.0)
    d = brute_pairs(values, 16, 16)
    pair = min(d, key=lambda k: abs(d[k] - 2.0))
    got = lsh.empirical_collision(table, spark.createDataFrame([pair], "a long, b long"), 1).first()["share"]
    assert abs(got - probability.collision_probability(d[pair], 5.0)) < 0.2


def test_predicates(spark):
    row = spark.range(1).select(
        D.motif_overlap(F.lit(0), F.lit(50), F.lit(20), F.lit(80), 10).alias("clear"),
        D.motif_overlap(F.lit(0), F.lit(50), F.lit(45), F.lit(80), 10).alias("near"),
        D.motiflet_overlap(F.array(F.lit(0), F.lit(50)), F.array(F.lit(59)), 10).alias("cross"),
        D.polynomial(F.lit(2.0), [1.0, 0.0, 3.0]).alias("p"),
        D.norm(D.normalized(F.array(F.lit(3.0), F.lit(4.0)))).alias("unit"),
        D.format_bytes(F.lit(2048)).alias("size"),
    ).first()
    assert (row["clear"], row["near"], row["cross"], row["p"], row["unit"], row["size"]) == (False, True, True, 13.0, 1.0, "2.00 KB")


def test_sampled_distances_are_distances_of_pairs(spark):
    values = walk(80, 6)
    d = brute_pairs(values, 8, 8)
    for r in measures.sampled_distances(S.from_values(spark, values), 8, 50, 8, 3).collect():
        assert r["d"] == pytest.approx(d[tuple(sorted((r["a"], r["b"])))], abs=1e-9)


def test_time_budget():
    assert len(list(planner.take_for(iter(range(5)), 0.0))) == 1


def test_running_sum_over_chunks(spark):
    got = [r["v"] for r in S.running_sum(S.from_values(spark, [1.0] * 25), 7).orderBy("i").collect()]
    assert got == [float(k + 1) for k in range(25)]
