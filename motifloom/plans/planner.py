"""Motif and motiflet queries: choice of strategy, and lazy enumeration with a failure probability."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import probability
from motifloom.operators import greedy, hashing, kernel, lsh, measures, motiflets, pairs
from motifloom.operators.windows import lengths, znormalized_subsequences
from motifloom.sources.sinks import Observations
from motifloom.sources.storage import written

#: Subsequences up to which all pairs are compared as expressions, and up to which as matrix products without looking for anything better.
SMALL, MEDIUM = 128, 150_000
#: Relative contrast from which hashing is tried on longer series.
CONTRAST = 2.5
#: Subsequences up to which the lazy enumeration compares all pairs.
BRUTE_FORCE = 1000
#: Share of all pairs after which hashing is no better than comparing them all.
EFFORT = 0.1
#: Subsequences that the width of buckets is looked for on.
WIDTH_ROWS = 4096


@dataclass(frozen=True)
class Motiflet:
    support: int
    indices: tuple[int, ...]
    extent: float
    lower_bound: float
    relative_contrast: float | None

    @property
    def confirmed(self) -> bool:
        return self.lower_bound == self.extent


@dataclass(frozen=True)
class Motif:
    a: int
    b: int
    distance: float
    confirmed: bool
    relative_contrast: float | None

    @staticmethod
    def of(m: Motiflet) -> Motif:
        if m.support != 2:
            raise ValueError("only a motiflet of support 2 is a motif")
        return Motif(min(m.indices), max(m.indices), m.extent, m.confirmed, m.relative_contrast)


def choose(series: DataFrame, w: int, k: int, ez: int, held: dict | None = None) -> str:
    """``expression``, ``kernel`` or ``lsh`` by the length of the longest series and how much its motifs stand out; ``held`` are its values, if a task can hold them."""
    longest = max(map(len, held.values()), default=0) if held is not None else lengths(series).agg(F.max("n")).first()[0] or 0
    n = longest - w
    if n <= MEDIUM:
        return "expression" if n <= SMALL else "kernel"
    if held is not None:
        return "lsh" if kernel.contrast(held, w, k, ez) >= CONTRAST else "kernel"
    # too long for a task to hold: what a few tables meet says whether hashing leaves most pairs alone
    width = 2.0 * w**0.25
    table = lsh.hashes(znormalized_subsequences(series, w), *lsh.projections(w, 2, 7), width)
    met = lsh.collision_estimate(table, lsh.K, ez).groupBy("series_id").agg(F.max("collisions").alias("m")).agg(F.max("m")).first()[0] or 0
    return "lsh" if met <= EFFORT / 256 * n * n / 2 else "kernel"


def motifs(series: DataFrame, w: int, k: int = 1, ez: int | None = None, strategy: str = "auto", delta: float = 0.05, seed: int = 1234) -> DataFrame:
    """``series_id, rank, a, b, distance`` of the ``k`` closest pairs that do not overlap.

    ``auto`` compares all pairs as expressions up to ``SMALL`` subsequences and as
    matrix products up to ``MEDIUM``; beyond, it hashes where motifs stand out.  ``lsh`` finds each motif
    with probability ``1 - delta``, and compares all pairs where hashing is no better.
    """
    ez, spark = w if ez is None else ez, series.sparkSession
    held = None if strategy == "expression" else kernel.collected(series)
    if strategy == "auto":
        strategy = choose(series, w, k, ez, held)
    if strategy == "expression" or held is None and strategy == "kernel":
        return greedy.motifs_exact(series, w, k, ez, "expression" if strategy == "expression" else "tiles")
    if strategy == "kernel":
        return spark.createDataFrame(kernel.greedy_motifs(spark, held, w, k, ez), greedy.MOTIF)
    rows = []
    names = list(held) if held is not None else [r["series_id"] for r in series.select("series_id").distinct().toLocalIterator()]
    for name in names:
        own = series.where(F.col("series_id") == name)
        values = None if held is None else {name: held[name]}
        found = [Motif.of(m) for m in MotifletsIterator(own, w, 2, k, ez, delta, seed, brute_force_threshold=0, held=values)]
        for n, one in enumerate(sorted(found, key=lambda m: (m.distance, m.a, m.b)), 1):
            rows.append((name, n, one.a, one.b, one.distance))
    return spark.createDataFrame(rows, greedy.MOTIF)


@dataclass
class MotifletsIterator:
    """Confirmed motiflets of one series, the sooner the closer, for supports 2 to ``support``.

    Every batch of hash tables is one job over (table, key, position) rows; pairs
    that meet are compared once; what has been found is confirmed when the
    probability of having missed something as close is below ``delta``.  Where the
    pairs compared reach ``fraction_threshold`` of all, the rest is found by comparing
    all pairs, unless ``stop_on_threshold`` asks for what there is, unconfirmed.
    Batches grow, so the number of jobs grows with the logarithm of the tables.
    ``max_memory`` bounds the tables of a prefix by 12 bytes for each of their subsequences.  ``observability_file``
    gets the log as JSON when the enumeration ends, however it ends.  ``cancelled`` is asked between jobs, and
    while one runs, which is then cancelled.  ``held`` are the series' values where they have been collected already.
    """

    series: DataFrame
    w: int
    support: int = 2
    top_k: int = 1
    ez: int | None = None
    delta: float = 0.05
    seed: int = 1234
    brute_force_threshold: int = BRUTE_FORCE
    fraction_threshold: float = EFFORT
    stop_on_threshold: bool = False
    max_repetitions: int = 256
    max_memory: int | None = None
    observability_file: str | None = None
    held: dict | None = None
    cancelled: Callable[[], bool] = field(default=lambda: False)

    def __post_init__(self) -> None:
        self.ez = self.w if self.ez is None else self.ez
        self.log, self.timings = Observations(), {}

    def __iter__(self) -> Iterator[Motiflet]:
        held = kernel.collected(self.series) if self.held is None else self.held
        n = (self.series.agg(F.max("i")).first()[0] or 0) + 1 if held is None else max(map(len, held.values()), default=0)
        sub = n - self.w
        if sub <= 0:
            return
        if sub <= self.brute_force_threshold:
            yield from self._exact(set())
            return
        if self.max_memory is not None:
            self.max_repetitions = max(1, min(self.max_repetitions, self.max_memory // (12 * sub)))
        try:
            yield from self._hashed(sub) if held is None else self._hashed_pairs(sub, held) if self.support == 2 else self._hashed_sets(sub, held)
        finally:
            if self.observability_file is not None:
                with open(self.observability_file, "w", encoding="utf-8") as file:
                    file.write(self.log.to_json())

    def _job(self, run: Callable):  # noqa: ANN202
        """The result of a job, or none if it was cancelled while it ran."""
        context, done = self.series.sparkSession.sparkContext, threading.Event()
        tag = f"motifs-{uuid.uuid4().hex}"

        def watch() -> None:
            while not done.wait(0.2):
                if self.cancelled():
                    context.cancelJobsWithTag(tag)
                    return

        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            return run()
        except Exception:
            if self.cancelled():
                return None
            raise
        finally:
            done.set()
            context.removeJobTag(tag)

    def _hashed_pairs(self, sub: int, held: dict) -> Iterator[Motiflet]:
        """Support 2 on a series that tasks hold: tables run where the series is, a job a batch."""
        spark, begin = self.series.sparkSession, time.monotonic()
        total = sub * (sub - 1) // 2
        width = hashing.fitting_width(spark, held, self.w, self.ez, self.seed, min(4.0 * sub, EFFORT / 64 * total))
        average = kernel.mean_distance(held, self.w, self.ez, 1000, self.seed)
        self._timed("setup", begin)
        top, examined, complete = greedy.TopK(self.top_k, self.ez), 0, float("inf")
        for prefix in range(lsh.K, 0, -1):
            previous, done, batch = (None if prefix == lsh.K else prefix + 1), 0, 8
            while done < self.max_repetitions:
                if self.cancelled():
                    return
                begin, n = time.monotonic(), min(batch, self.max_repetitions - done)
                bound = top.kth_distance() or 2 * self.w**0.5
                seen = partial(hashing.run_tables, spark, held, self.w, self.ez, done, n, self.seed, prefix, previous, width, bound)
                got = self._job(seen)
                if got is None:
                    return
                for d, a, b in got.pairs:
                    top.insert(d, a, b)
                done, batch, examined, complete = done + n, batch * 2, examined + got.met, min(complete, got.complete)
                self.log.note(done, prefix, "candidates", examined)
                sure = probability.largest_confirmed(2 * self.w**0.5, width, done, prefix, self.delta, previous, self.max_repetitions)
                self.log.note(done, prefix, "confirmed_distance", sure)
                self._timed("update", begin)
                for d, a, b in top.confirm_upto(min(sure, complete)):
                    yield self._of({"support": 2, "indices": [a, b], "extent": d}, average)
                if top.num_confirmed() >= self.top_k:
                    return
                if got.given_up or examined > self.fraction_threshold * total:
                    sent = {(2, tuple(sorted((a, b)))) for _, a, b in top.confirmed}
                    if self.stop_on_threshold:
                        for d, a, b in top.to_list():
                            if (2, (a, b)) not in sent:
                                yield self._of({"support": 2, "indices": [a, b], "extent": d}, average, 0.0)
                    else:
                        yield from self._exact(sent)
                    return
        yield from self._exact({(2, tuple(sorted((a, b)))) for _, a, b in top.confirmed})

    def _timed(self, name: str, begin: float) -> None:
        self.timings[name] = self.timings.get(name, 0.0) + time.monotonic() - begin

    def _average(self) -> float | None:
        got = measures.sampled_distances(self.series, self.w, 1000, self.ez, self.seed).agg(F.avg("d")).first()[0]
        return got

    def _of(self, r, average: float | None, lower: float | None = None) -> Motiflet:  # noqa: ANN001
        contrast = average / r["extent"] if average is not None and r["extent"] else None
        return Motiflet(r["support"], tuple(sorted(r["indices"])), r["extent"], r["extent"] if lower is None else lower, contrast)

    def _exact(self, done: set) -> Iterator[Motiflet]:
        begin = time.monotonic()
        average = self._average()
        if self.support == 2:
            found = greedy.motifs_exact(self.series, self.w, self.top_k, self.ez, "kernel").select(
                F.lit(2).alias("support"), F.array("a", "b").alias("indices"), F.col("distance").alias("extent")
            )
        else:
            found = motiflets.motiflets_exact(self.series, self.w, self.support, self.ez, self.top_k)
        rows = found.orderBy("support", "extent").collect()  # top_k for each support
        self._timed("exact", begin)
        for r in rows:
            if (r["support"], tuple(sorted(r["indices"]))) not in done:
                yield self._of(r, average)

    def _width(self, z: DataFrame, sub: int) -> float:
        """Bucket width at which tables have about as many whole-hash collisions as the root of the subsequences, or ten times that.

        A sample is projected once, without floors, and the width is looked for on the driver.
        """
        vectors, _ = lsh.projections(self.w, 4, self.seed + 1)
        share = min(1.0, WIDTH_ROWS / max(sub, 1))
        drawn = z.where(F.pmod(F.xxhash64("i"), F.lit(1 << 62)).cast("double") < share * (1 << 62))
        flat = vectors.reshape(4 * lsh.K, -1).T
        rows = drawn.limit(2 * WIDTH_ROWS).select("z").toArrow()["z"].to_pylist()  # bounded by WIDTH_ROWS
        if not rows:
            return 1.0
        points = (np.array(rows) @ flat).reshape(len(rows), 4, lsh.K)
        scale = (sub / len(rows)) ** 2
        low, high, width = 0.0, 4.0 * self.w**0.5, 1.0
        for _ in range(20):
            h = np.floor(points / width).astype(np.int64)
            got = scale * sum(hashing.number_met(hashing.keys_of(h[:, t], lsh.K)) for t in range(4)) / 4
            if sub**0.5 <= got <= 10 * sub**0.5 + self.ez * sub / 4:
                return width
            low, high = (width, high) if got < sub**0.5 else (low, width)
            width = (low + high) / 2
        return width

    def _hashed(self, sub: int) -> Iterator[Motiflet]:
        begin = time.monotonic()
        z = written(znormalized_subsequences(self.series, self.w).select("series_id", "i", "z"), "subsequences")
        average, width = self._average(), self._width(z, sub)
        self._timed("setup", begin)
        edges: DataFrame | None = None
        emitted: dict[int, list[tuple[int, ...]]] = {s: [] for s in range(2, self.support + 1)}
        examined, done, total = 0, 0, sub * (sub - 1) // 2
        tables: DataFrame | None = None
        for prefix in range(lsh.K, 0, -1):
            previous = None if prefix == lsh.K else prefix + 1
            done, batch = 0, 2
            while done < self.max_repetitions:
                if self.cancelled():
                    return
                begin = time.monotonic()
                n = min(batch, self.max_repetitions - done)
                vectors, shares = lsh.projections(self.w, n, self.seed + 7919 * done + 17)
                tables = written(lsh.hashes(z, vectors, shares, width, done), "tables")
                likely = tables and lsh.collision_estimate(tables, prefix, self.ez).agg(F.sum("collisions")).first()[0] or 0
                if examined + likely > self.fraction_threshold * total and not self.stop_on_threshold:
                    # the buckets are so full that comparing all pairs costs less than what these tables would list
                    yield from self._exact({(s, i) for s, own in emitted.items() for i in own})
                    return
                met = lsh.candidates(tables, prefix, self.ez, previous)
                # what has been compared stays; a pair is compared once
                fresh = met.select("series_id", "a", "b").distinct()
                if edges is not None:
                    fresh = fresh.join(edges.select("series_id", "a", "b"), ["series_id", "a", "b"], "left_anti")
                new = written(lsh.verified(fresh, z).withColumn("d", F.round("d", 6)), "edges")
                examined += new.count()
                edges = new if edges is None else written(edges.unionByName(new), "edges")
                done, batch = done + n, batch * 2
                self.log.note(done, prefix, "candidates", examined)
                self._timed("update", begin)
                yield from self._confirmed(edges, emitted, average, width, done, prefix, previous)
                if all(len(e) >= self.top_k for e in emitted.values()):
                    return
                if examined > self.fraction_threshold * total:
                    if self.stop_on_threshold:
                        yield from self._flush(edges, emitted, average)
                    else:
                        yield from self._exact({(s, i) for s, own in emitted.items() for i in own})
                    return
        yield from self._exact({(s, i) for s, own in emitted.items() for i in own})

    def _hashed_sets(self, sub: int, held: dict) -> Iterator[Motiflet]:
        """Supports above 2 on a series that tasks hold.

        A set of some extent has no two members farther apart, and nothing nearer to its root is
        farther, so the pairs up to that extent hold all that decides it.  Sets are made of the pairs that tables list.
        """
        spark, begin = self.series.sparkSession, time.monotonic()
        total = sub * (sub - 1) // 2
        width = hashing.fitting_width(spark, held, self.w, self.ez, self.seed, min(4.0 * sub, EFFORT / 64 * total))
        average = kernel.mean_distance(held, self.w, self.ez, 1000, self.seed)
        self._timed("setup", begin)
        tops = {k: greedy.MotifletTopK(self.top_k, self.ez) for k in range(2, self.support + 1)}
        known: dict[tuple[int, int], float] = {}
        examined, complete, sent = 0, float("inf"), set()
        for prefix in range(lsh.K, 0, -1):
            previous, done, batch = (None if prefix == lsh.K else prefix + 1), 0, 8
            while done < self.max_repetitions:
                if self.cancelled():
                    return
                begin, n = time.monotonic(), min(batch, self.max_repetitions - done)
                ends = [top.kth_distance() for top in tops.values()]
                bound = 2 * self.w**0.5 if None in ends else max(ends)
                got = self._job(partial(hashing.run_tables, spark, held, self.w, self.ez, done, n, self.seed, prefix, previous, width, bound))
                if got is None:
                    return
                before = len(known)
                known.update(((a, b), d) for d, a, b in got.pairs)
                known = {p: d for p, d in known.items() if d <= bound}
                if len(known) != before:
                    for support, extent, members in motiflets.sets_of_pairs(known, self.support, self.ez):
                        tops[support].insert(extent, members)
                    for top in tops.values():
                        top.cleanup()
                done, batch, examined, complete = done + n, batch * 2, examined + got.met, min(complete, got.complete)
                self.log.note(done, prefix, "candidates", examined)
                sure = probability.largest_confirmed(2 * self.w**0.5, width, done, prefix, self.delta, previous, self.max_repetitions)
                self._timed("update", begin)
                for support, top in tops.items():
                    for extent, members in top.emit(lambda d: d <= min(sure, complete)):
                        sent.add((support, members))
                        yield self._of({"support": support, "indices": members, "extent": extent}, average)
                if all(top.is_complete() for top in tops.values()):
                    return
                if got.given_up or examined > self.fraction_threshold * total:
                    if not self.stop_on_threshold:
                        yield from self._exact(sent)
                        return
                    for support, top in tops.items():
                        for extent, members in top.to_list():
                            if (support, members) not in sent:
                                yield self._of({"support": support, "indices": members, "extent": extent}, average, 0.0)
                    return
        yield from self._exact(sent)

    def _best(self, edges: DataFrame) -> list:
        if self.support == 2:
            top = greedy.top_motifs(edges, self.top_k, self.ez)
            return top.select(F.lit(2).alias("support"), F.array("a", "b").alias("indices"), F.col("distance").alias("extent")).orderBy("extent").collect()
        knn = pairs.knn_nonoverlapping(edges, self.support - 1, self.ez)
        # a set counts where all its pairs have been compared
        full = motiflets.extents(knn, edges)
        known = edges.select("series_id", "a", "b")
        inner = full.select("series_id", "root", "support", "indices", "extent", F.posexplode("indices").alias("p", "x")).select(
            "series_id", "root", "support", "indices", "extent", "p", "x", F.explode("indices").alias("y")
        ).where("x < y")
        met = inner.join(known, (inner.series_id == known.series_id) & (inner.x == known.a) & (inner.y == known.b), "left_semi")
        sets = met.groupBy("series_id", "root", "support", "indices", "extent").count().where(F.col("count") == F.expr("support * (support - 1) div 2"))
        return motiflets.best_by_support(sets, self.top_k, self.ez).orderBy("support", "extent").collect()

    def _confirmed(self, edges, emitted, average, width, done, prefix, previous) -> Iterator[Motiflet]:  # noqa: ANN001
        begin = time.monotonic()
        best = self._best(edges)
        self._timed("select", begin)
        for r in best:
            indices, own = tuple(sorted(r["indices"])), emitted[r["support"]]
            miss = probability.failure_probability(r["extent"], width, done, prefix, previous, self.max_repetitions)
            if indices not in own and len(own) < self.top_k and miss < self.delta:
                own.append(indices)
                yield self._of(r, average)

    def _flush(self, edges, emitted, average) -> Iterator[Motiflet]:  # noqa: ANN001
        for r in self._best(edges):
            indices = tuple(sorted(r["indices"]))
            if indices not in emitted[r["support"]] and len(emitted[r["support"]]) < self.top_k:
                yield self._of(r, average, 0.0)


def motiflet(series: DataFrame, w: int, support: int, repetitions: int = 256, **options) -> Motiflet | None:  # noqa: ANN003
    """The best motiflet of one support, from at most ``repetitions`` tables of a prefix."""
    return next((m for m in MotifletsIterator(series, w, support, 1, max_repetitions=repetitions, **options) if m.support == support), None)


def nearest_of_each(series: DataFrame, w: int, k: int, ez: int | None = None) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """For each subsequence in order its ``k`` nearest that do not overlap, as (position, distance), one after another."""
    found = pairs.knn_kernel(series, w, k, w if ez is None else ez)
    lists = found.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "d"))).alias("near"))
    for r in lists.orderBy("src").toLocalIterator():
        yield r["src"], [(p["dst"], p["d"]) for p in r["near"]]


def take_for(iterator: Iterator, seconds: float) -> Iterator:
    """Results of an iterator until a time budget is spent."""
    stop = time.monotonic() + seconds
    for item in iterator:
        yield item
        if time.monotonic() >= stop:
            return


def motif_values(found: DataFrame, series: DataFrame, w: int) -> DataFrame:
    """``series_id, rank, i, pos, val, zval``: values of both sides of each motif."""
    sides = found.select("series_id", "rank", F.explode(F.array("a", "b")).alias("i"))
    own = sides.join(znormalized_subsequences(series, w), ["series_id", "i"])
    both = F.arrays_zip(F.col("x").alias("val"), F.col("z").alias("zval"))
    return own.select("series_id", "rank", "i", F.posexplode(both).alias("pos", "e")).select("series_id", "rank", "i", "pos", "e.val", "e.zval")
