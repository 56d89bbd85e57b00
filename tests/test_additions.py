"""The strip kernel, lazy enumeration, sources, sinks and analysis pieces on small inputs."""

from __future__ import annotations

import io
import math
import struct
import threading
import time
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom import cli
from motifloom import experiments as X
from motifloom.functions import distance as D
from motifloom.functions import probability
from motifloom.operators import greedy, hashing, kernel, lsh, motiflets, pairs, sax
from motifloom.operators import windows as W
from motifloom.plans import planner
from motifloom.sources import binary, sinks
from motifloom.sources import series as S
from motifloom.streaming import series_stream


def walk(n, seed=1):
    return np.cumsum(np.random.default_rng(seed).normal(size=n)).tolist()


def planted(n=1500, w=30, copies=3, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    for k in range(copies):
        v[900 + 150 * k : 900 + 150 * k + w] = v[100 * k : 100 * k + w] * 2 + 1 + rng.normal(0, 0.01 * (k + 1), w)
    return v.tolist()


def plain_greedy(values, w, k, ez):
    x = np.lib.stride_tricks.sliding_window_view(np.array(values), w)[: len(values) - w]
    at = np.flatnonzero(x.std(axis=1) > 1e-4)
    z = (x[at] - x[at].mean(axis=1, keepdims=True)) / x[at].std(axis=1, keepdims=True)
    found = []
    for i, a in enumerate(at):
        for j in range(i + 1, len(at)):
            if at[j] - a >= ez:
                found.append((round(float(np.sqrt(((z[i] - z[j]) ** 2).sum())), 6), int(a), int(at[j])))
    return greedy.greedy(sorted(found), k, ez)


# kernel


@pytest.mark.parametrize("listed", [kernel.LISTED, 8])
def test_strips_give_the_greedy_motifs_whatever_they_list(spark, monkeypatch, listed):
    monkeypatch.setattr(kernel, "STRIP", 64)
    for values in (walk(260), [math.sin(i / 3) for i in range(220)], [float(i % 7) for i in range(200)], walk(100) + [3.0] * 60 + walk(100, 2)):
        got = kernel.greedy_motifs(spark, {"s": np.array(values)}, 10, 5, 10, listed)
        assert [(d, a, b) for _, _, a, b, d in got] == plain_greedy(values, 10, 5, 10)


def test_all_tiers_agree_on_several_series(spark):
    series = S.from_values(spark, walk(220), "one").union(S.from_values(spark, planted(400, 12, 0), "two"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    motifs = [rows(greedy.motifs_exact(series, 12, 4, 12, t)) for t in ("expression", "kernel", "tiles")]
    assert motifs[0] == motifs[1] == motifs[2] and len(motifs[0]) == 8
    near = [rows(pairs.matrix_profile(series, 12, 12, t, 64 if t == "tiles" else None)) for t in ("expression", "kernel", "tiles")]
    assert near[0] == near[1] == near[2]
    p = pairs.all_pairs(series, 12, 12).withColumn("d", F.round("d", 6))
    columns = ["series_id", "src", "rank", "dst", "d"]
    knn = [rows(df.select(columns)) for df in (pairs.knn_nonoverlapping(p, 3, 12), pairs.knn_kernel(series, 12, 3, 12), pairs.knn_kernel(series, 12, 3, 12, 64))]
    assert knn[0] == knn[1] == knn[2]
    sets = [rows(motiflets.motiflets_exact(series, 12, 4, 12, 2, t)) for t in ("expression", "kernel")]
    assert sets[0] == sets[1]


def test_long_series_go_tile_by_tile(spark, monkeypatch):
    series = S.from_values(spark, walk(300)).persist()
    whole = [greedy.motifs_exact(series, 10, 3, 10, "kernel").collect(), motiflets.motiflets_exact(series, 10, 3, 10).collect()]
    monkeypatch.setattr(kernel, "HELD_VALUES", 100)
    assert kernel.collected(series) is None
    assert [greedy.motifs_exact(series, 10, 3, 10, "kernel").collect(), motiflets.motiflets_exact(series, 10, 3, 10).collect()] == whole


def test_distance_profile_by_transform_is_the_direct_one(spark):
    values = walk(700, 3)
    values[500:540] = values[100:140]  # a twin, whose distance the transform alone could not give
    s = S.from_values(spark, values)
    direct = {r["i"]: r["distance"] for r in pairs.distance_profile(s, 40, 100, D.euclidean).collect()}
    got = {r["i"]: r["distance"] for r in pairs.mass_profile(s, 40, 100, 128).collect()}
    assert got.keys() == direct.keys() and max(abs(got[i] - direct[i]) for i in got) < 1e-6 and got[100] == got[500] == 0.0


# hash tables and the planner


def test_met_pairs_are_all_pairs_of_equal_keys():
    keys = np.random.default_rng(3).integers(0, 9, 60).astype(np.uint64)
    got = {(int(a), int(b)) for x, y in hashing.met_pairs(keys) for a, b in zip(x, y)}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if keys[a] == keys[b]}
    assert hashing.number_met(keys) == len(got)


def test_tables_on_held_series_meet_as_the_tables_of_rows_do(spark):
    values, w, width = planted(500, 30, 0), 20, 6.0
    s = S.from_values(spark, values)
    rows = W.znormalized_subsequences(s, w)
    vectors, shares = lsh.projections(w, 1, 11)
    table = lsh.hashes(rows, vectors, shares, width)
    for prefix, previous in ((6, None), (4, 5)):
        near = lsh.verified(lsh.candidates(table, prefix, w, previous), rows).where("d <= 6").select(F.round("d", 6).alias("d"), "a", "b")
        expected = {(r["a"], r["b"]) for r in near.collect()}
        got = hashing.run_tables(spark, {"s": np.array(values)}, w, w, 0, 1, 11, prefix, previous, width, 6.0)
        # single precision may put a projection at the very edge of a bucket on its other side
        assert len(expected ^ {(a, b) for _, a, b in got.pairs}) <= max(2, 0.02 * len(expected)) and got.complete == math.inf


def test_planner_hashes_long_series_whose_motifs_stand_out(spark, monkeypatch):
    monkeypatch.setattr(planner, "MEDIUM", 500)
    clear = [math.sin(i / 9) * (1 + i / 3000) for i in range(1500)]
    assert planner.choose(S.from_values(spark, clear), 30, 1, 30) == "lsh"
    assert planner.choose(S.from_values(spark, np.random.default_rng(1).normal(size=900).tolist()), 30, 1, 30) == "kernel"
    assert planner.choose(S.from_values(spark, walk(300)), 30, 1, 30) == "kernel"
    assert planner.choose(S.from_values(spark, walk(100)), 30, 1, 30) == "expression"
    monkeypatch.setattr(kernel, "HELD_VALUES", 100)
    assert planner.choose(S.from_values(spark, planted()), 30, 1, 30) in ("lsh", "kernel")


def test_lazy_motifs_log_stop_early_and_keep_to_memory(spark, tmp_path):
    s = S.from_values(spark, planted())
    log = tmp_path / "log.json"
    it = planner.MotifletsIterator(s, 30, 2, 3, 30, 0.01, brute_force_threshold=0, max_memory=12 * 1470 * 40, observability_file=str(log))
    found = list(it)
    assert [m.indices for m in sorted(found, key=lambda m: m.extent)] == [(100 * k, 900 + 150 * k) for k in range(3)]
    assert it.max_repetitions == 40 and all(m.confirmed and m.relative_contrast > 1 for m in found)
    assert "candidates" in log.read_text() and it.timings["update"] > 0
    early = list(planner.MotifletsIterator(s, 30, 2, 9, 30, 0.01, brute_force_threshold=0, fraction_threshold=1e-6, stop_on_threshold=True))
    assert len(early) == 9 and any(not m.confirmed for m in early)
    whole = list(planner.MotifletsIterator(s, 30, 2, 9, 30, 0.01, brute_force_threshold=0, fraction_threshold=1e-6))
    exact = {(r["a"], r["b"]) for r in greedy.motifs_exact(s, 30, 9, 30, "kernel").collect()}
    assert {m.indices for m in whole} == exact


def test_sets_of_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    pairs_ = {(a, b): round(float(rng.uniform(1, 9)), 6) for a in range(60) for b in range(a + 4, 60)}
    best = {}
    for support, extent, members in motiflets.sets_of_pairs(pairs_, 4, 4):
        best[support] = min(best.get(support, (99.0, ())), (extent, members))
    limit = best[4][0]
    some = {}
    for support, extent, members in motiflets.sets_of_pairs({p: d for p, d in pairs_.items() if d <= limit}, 4, 4):
        some[support] = min(some.get(support, (99.0, ())), (extent, members))
    assert some == best and sorted(best) == [2, 3, 4]


def test_lazy_motiflets_of_three_members_are_the_exact_ones(spark):
    values = np.array(planted(1400, 30, 0, 9))
    for at, scale in ((50, 1.0), (400, 2.0), (800, -0.0 + 3.0)):
        values[at : at + 30] = np.sin(np.arange(30) / 2) * 5 * scale + np.random.default_rng(at).normal(0, 0.05, 30)
    s = S.from_values(spark, values.tolist())
    found = list(planner.MotifletsIterator(s, 30, 3, 1, 30, 0.01, brute_force_threshold=0))
    exact = {r["support"]: (r["indices"], r["extent"]) for r in motiflets.motiflets_exact(s, 30, 3, 30).collect()}
    assert {m.support: (list(m.indices), m.extent) for m in found} == exact and all(m.confirmed for m in found)


def test_a_running_job_is_cancelled(spark):
    flag = threading.Event()
    it = planner.MotifletsIterator(S.from_values(spark, planted()), 30, cancelled=flag.is_set)

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    threading.Timer(2.0, flag.set).start()
    begin = time.monotonic()
    assert it._job(lambda: spark.range(0, 2, 1, 2).mapInArrow(slow, "id long").count()) is None
    assert time.monotonic() - begin < 40
    assert list(it) == []


def test_single_motiflet_and_neighbours_of_each(spark):
    s = S.from_values(spark, walk(120))
    best = motiflets.motiflets_exact(s, 10, 3, 10).where("support = 3").first()
    got = planner.motiflet(s, 10, 3, ez=10)
    assert (list(got.indices), got.extent) == (best["indices"], best["extent"])
    near = dict(planner.nearest_of_each(s, 10, 2))
    first = {r["i"]: (r["nn_idx"], r["nn_dist"]) for r in pairs.matrix_profile(s, 10, 10).collect()}
    assert sorted(near) == sorted(first) and all(near[i][0] == first[i] for i in near)


def test_top_k_protocols():
    top = greedy.TopK(2, 5)
    for d, a, b in ((3.0, 50, 70), (1.0, 0, 10), (2.0, 20, 30)):
        top.insert(d, a, b)
    other, seen = greedy.TopK(2, 5), []
    other.insert(0.5, 100, 200)
    top.add_all(other)
    assert top.confirm_upto(0.7) == [(0.5, 100, 200)] and top.confirm_upto(0.7) == [] and top.num_confirmed() == 1
    assert top.last_confirmed() == (0.5, 100, 200)
    top.for_each(lambda d, a, b: seen.append(d))
    assert seen == [0.5, 1.0]
    sets = greedy.MotifletTopK(2, 5)
    for extent, own in ((3.0, (1, 50)), (1.0, (20, 10, 30)), (1.5, (22, 90)), (2.0, (60, 70))):
        sets.insert(extent, own)
    assert sets.to_list() == [(1.0, (10, 20, 30)), (2.0, (60, 70))] and sets.kth_distance() == 2.0
    sets.cleanup()
    assert len(sets.seen) == 3 and sets.emit(lambda d: d < 1.8) == [(1.0, (10, 20, 30))]
    assert sets.smallest_non_emitted_distance() == 2.0 and not sets.is_complete()
    assert sets.emit(lambda d: True) == [(2.0, (60, 70))] and sets.is_complete()
    sets.disable()
    sets.insert(0.1, (500, 600))
    assert sets.kth_distance() == 2.0


# functions


def test_error_functions_and_confirmed_distance():
    for y in (-0.9, 0.0, 0.3, 0.99):
        assert probability.erf(probability.erf_inv(y)) == pytest.approx(y, abs=1e-12)
        assert probability.erfc(probability.erfc_inv(1 - y)) == pytest.approx(1 - y, abs=1e-12)
    d = probability.largest_confirmed(10.0, 5.0, 20, 8, 0.05)
    assert probability.failure_probability(d, 5.0, 20, 8) < 0.05 <= probability.failure_probability(d + 1e-6, 5.0, 20, 8)
    assert probability.largest_confirmed(0.01, 5.0, 200, 8, 0.05) == 0.01 and probability.rho(0.5, 0.25) == 0.5


def test_new_predicates(spark):
    row = spark.range(1).select(
        D.relative_error(F.lit(9.0), F.lit(10.0)).alias("e"),
        D.neighbour_overlaps(F.struct(F.lit(1.0).alias("d"), F.lit(20).alias("j"), F.lit(True).alias("active")), F.lit(25), 6).alias("o"),
        D.in_range(F.array(F.lit(5), F.lit(-128))).alias("r"),
        D.euclidean_within(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)), 5.0).alias("five"),
        D.euclidean_within(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.1)), 5.0).alias("far"),
    ).first()
    assert (round(row["e"], 9), row["o"], row["r"], row["five"], row["far"]) == (0.1, True, False, 5.0, None)
    root = W.random_root(S.from_values(spark, [1.0] * 30 + walk(40) + [1.0] * 30), 8, 3).first()["i"]
    assert 22 < root < 70


# sources and sinks


def test_rows_of_many_series_are_numbered_over_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(("a", "b", "c")[int(rng.integers(3))], int(t), float(t)) for t in rng.permutation(500)] + [("d", 1, 1.0), (None, 1, 1.0)]
    got = S.numbered(spark.createDataFrame(rows, "k string, t long, v double"), ["t"], "v", "k", 7).collect()
    for key in "abcd":
        own = sorted((r["i"], r["v"]) for r in got if r["series_id"] == key)
        assert own == list(enumerate(sorted(v for k, _, v in rows if k == key)))


def mat_file(name, values, packed=False):
    body = lambda kind, raw: struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)
    x = np.array(values, "<f8")
    parts = body(6, struct.pack("<II", 6, 0)) + body(5, struct.pack("<ii", len(x), 1)) + body(1, name.encode()) + body(9, x.tobytes())
    whole = body(14, parts)
    if packed:
        raw = zlib.compress(whole)
        whole = struct.pack("<II", 15, len(raw)) + raw
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + whole


def test_binary_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", values=np.arange(6).reshape(2, 3))
    (tmp_path / "b.mat").write_bytes(mat_file("values", [1.5, -2.0, 8.0]))
    (tmp_path / "c.mat").write_bytes(mat_file("values", range(5), True))
    got = {}
    for r in S.read_arrays(spark, str(tmp_path), "values").orderBy("series_id", "i").collect():
        got.setdefault(r["series_id"], []).append(r["v"])
    assert got == {"a.npz": [0, 1, 2, 3, 4, 5], "b.mat": [1.5, -2.0, 8.0], "c.mat": [0, 1, 2, 3, 4]}
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(4000)
        tone = np.concatenate([np.zeros(8000), 8000 * np.sin(2 * np.pi * 365 * np.arange(8000) / 4000)])
        file.writeframes(tone.astype("<i2").tobytes())
    loud = binary.array_of("x.wav", out.getvalue(), "360-370")
    assert loud.max() == 0 and loud[:5].max() < -60 and loud[-3:].min() > -6
    assert binary.array_of("x.wav", out.getvalue(), "900-1000")[-3:].mean() <= 0 and len(binary.band_loudness(out.getvalue()[:400], 1, 2)) == 0


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = X.best_of_group(orders.where("o_totalprice > 1000").select("o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_readers_and_data_sets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,1\ny,oops\nz,\nw,4\n")
    assert [r["v"] for r in S.read_csv(spark, str(tmp_path / "t.csv"), "n", names=["k", "n"], strict=False).orderBy("i").collect()] == [1.0, 4.0]
    with pytest.raises(Exception):
        S.read_csv(spark, str(tmp_path / "t.csv"), "n", names=["k", "n"]).collect()
    (tmp_path / "d.json").write_text('[{"a": 1, "m": [{"d": 0.5}]},\n {"a": 2, "m": []}]')
    assert S.read_json(spark, str(tmp_path / "d.json")).select(F.sum("a"), F.sum(F.size("m"))).first()[:] == (3, 1)
    (tmp_path / "s.txt").write_text("".join(f"{k}\n" for k in range(50)))
    S.register_dataset("small", str(tmp_path / "s.txt"))
    assert [r["v"] for r in S.load_dataset(spark, "small", 3).orderBy("i").collect()] == [0.0, 1.0, 2.0]
    with pytest.raises(KeyError):
        S.load_dataset(spark, "unknown")


def test_random_walk_steps_are_standard_normal(spark):
    v = np.array([r["v"] for r in S.normal_steps(spark, 20_000, 5).collect()])
    assert abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.03 and abs((v > 1.645).mean() - 0.05) < 0.01
    walked = [r["v"] for r in S.random_walk(spark, 50, 5, 7).orderBy("i").collect()]
    steps = [r["v"] for r in S.normal_steps(spark, 50, 5).orderBy("i").collect()]
    assert np.allclose(walked, np.cumsum(steps))


def test_more_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1.5,)], "d double")
    sinks.write_sampled_distances(d, 7, str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).first()[:] == ("7", "1.5")
    sinks.write_deviations(W.rolling_stats(S.from_values(spark, walk(20)), 5), str(tmp_path / "sd"))
    assert spark.read.text(str(tmp_path / "sd")).count() == 15
    assert sinks.latex_table(spark.range(2)).splitlines() == [r"\begin{tabular}{l}", r"id \\ \hline", r"0 \\", r"1 \\", r"\end{tabular}"]
    log, costs = sinks.Observations(), sinks.Costs()
    log.note(1, 8, "candidates", 3)
    log.write(spark, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).first()["name"] == "candidates"
    assert [costs.add("a", x) for x in (1.0, 3.0)] == [1.0, 2.0] and costs.average("b") is None


def test_command_line(spark, tmp_path):
    path = tmp_path / "series.txt"
    path.write_text("\n".join(map(str, planted())))
    for extra in (["--exact"], ["--max-memory", "1GB"]):
        out = tmp_path / f"out{len(extra)}"
        assert cli.main([str(path), "--window", "30", "--topk", "2", "--exclusion-zone", "30", "--output", str(out), *extra], spark) == 0
        lines = sorted(r["value"] for r in spark.read.text(str(out)).collect())
        assert [line.split(", ")[1:] for line in lines] == [["0", "900"], ["100", "1050"]]
    with pytest.raises(SystemExit):
        cli.main([str(path), "--window", "30", "--max-memory", "2 parsecs"], spark)


# analysis


def test_models_predictions_and_targets(spark, tmp_path):
    rows = spark.createDataFrame([(g, float(x), None if x == 3 else 1.0 + g * x + 0.5 * x * x) for g in (1, 2) for x in range(8)], "g int, x double, y double")
    filled = {r["g"]: r["y"] for r in X.fill_missing(rows, "g", "x", "y").where("is_predicted").collect()}
    assert {g: round(v, 6) for g, v in filled.items()} == {1: 8.5, 2: 11.5}
    fit = X.quadratic_fit(rows.where("y IS NOT NULL"), "g", "x", "y")
    assert {r["g"]: round(r["predicted"], 6) for r in X.predicted(fit, spark.createDataFrame([(1, 10.0), (2, 10.0)], "g int, x double"), "g", "x").collect()} == {1: 61.0, 2: 71.0}
    model = X.models(rows.where("y IS NOT NULL"), "g", "x", "y").where("g = 2").first()
    assert np.allclose(model["coefficients"], [1.0, 2.0, 0.5]) and model["residual"] < 1e-6
    made = X.Targets(spark, str(tmp_path / "t"))
    made.rule("numbers", lambda: spark.range(5))
    made.rule("sum", lambda n: n.agg(F.sum("id").alias("s")), "numbers")
    assert made.get("sum").first()["s"] == 10 and made.made == ["numbers", "sum"]
    assert made.get("sum").first()["s"] == 10 and made.made == ["numbers", "sum"]
    made.rule("loop", lambda x: x, "loop")
    with pytest.raises(ValueError):
        made.get("loop")


def test_sax_repeats_over_tiles_and_gaps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [(("s", "t")[k % 2], k // 2, [int(rng.integers(2))]) for k in range(200) if k % 17]
    df = spark.createDataFrame(words, "series_id string, i long, word array<int>")
    monkeypatch.setattr(sax, "TILE", 8)
    expected = []
    for s in "st":
        last = None
        for _, i, word in sorted(w for w in words if w[0] == s):
            if word != last:
                expected.append((s, i))
            last = word
    assert sorted((r["series_id"], r["i"]) for r in sax.drop_repeats(df).collect()) == expected


def test_stream_takes_files_as_they_come_and_refuses_late_events(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, value double"
    base = {"checkpoint": str(tmp_path / "c"), "target": str(tmp_path / "t")}
    rows = lambda *own: spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(own)], "event_id long, t string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(name, df):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        part.rename(folder / f"events-{name}.parquet")
        out = series_stream.build_series(spark, str(folder), schema, base["checkpoint"], base["target"])
        return {str(r["slot"])[11:13]: (r["s"], r["n"]) for r in out.collect()}

    assert arrive("a", rows(("2024-01-01 01:10:00", 1.0), ("2024-01-01 04:20:00", 2.0))) == {"01": (1.0, 1), "04": (2.0, 1)}
    got = arrive("b", rows(("2024-01-01 04:40:00", 3.0), ("2024-01-01 01:30:00", 9.0)))
    assert got == {"01": (1.0, 1), "04": (5.0, 2)}  # the second event of hour 1 came after its window was closed
