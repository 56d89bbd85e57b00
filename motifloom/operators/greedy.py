"""Greedy selection of motifs that do not overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators import kernel
from motifloom.operators import pairs as P

MOTIF = "series_id string, rank int, a long, b long, distance double"


def pair_overlap(x: tuple[int, int], y: tuple[int, int], ez: int) -> bool:
    s = sorted((*x, *y))
    return any(q - p < ez for p, q in zip(s, s[1:]))


class TopK:
    """Motifs in order of (distance, a, b) of which no two overlap, from candidates in any order."""

    def __init__(self, k: int, ez: int) -> None:
        self.k, self.ez, self.seen = k, ez, set()
        self.confirmed: list[tuple[float, int, int]] = []

    def insert(self, distance: float, a: int, b: int) -> None:
        self.seen.add((distance, min(a, b), max(a, b)))

    def add_all(self, other: TopK) -> None:
        self.seen |= other.seen

    def to_list(self) -> list[tuple[float, int, int]]:
        return greedy(sorted(self.seen), self.k, self.ez)

    def kth_distance(self) -> float | None:
        best = self.to_list()
        return best[-1][0] if len(best) == self.k else None

    def confirm_upto(self, distance: float) -> list[tuple[float, int, int]]:
        """Motifs no farther than ``distance`` are sure; those that were not so before."""
        fresh = [m for m in self.to_list() if m[0] <= distance and m not in self.confirmed]
        self.confirmed += fresh
        return fresh

    def last_confirmed(self) -> tuple[float, int, int] | None:
        return self.confirmed[-1] if self.confirmed else None

    def num_confirmed(self) -> int:
        return len(self.confirmed)

    def for_each(self, call: Callable[[float, int, int], None]) -> None:
        for motif in self.to_list():
            call(*motif)

    def first_not_confirmed(self, confirmed: Callable[[float], bool]) -> tuple[float, int, int] | None:
        return next((m for m in self.to_list() if not confirmed(m[0])), None)


class MotifletTopK:
    """Motiflets of one support in order of (extent, positions) of which no two overlap."""

    def __init__(self, k: int, ez: int) -> None:
        self.k, self.ez, self.seen, self.emitted, self.enabled = k, ez, set(), [], True

    def insert(self, extent: float, indices: Iterable[int]) -> None:
        if self.enabled:
            self.seen.add((extent, tuple(sorted(indices))))

    def to_list(self) -> list[tuple[float, tuple[int, ...]]]:
        chosen: list[tuple[float, tuple[int, ...]]] = []
        for extent, own in sorted(self.seen):
            if len(chosen) < self.k and not any(abs(x - y) < self.ez for _, other in chosen for x in own for y in other):
                chosen.append((extent, own))
        return chosen

    def cleanup(self) -> None:
        """Forget what is farther than the ``k``-th, once there are ``k``."""
        last = self.kth_distance()
        if last is not None:
            self.seen = {s for s in self.seen if s[0] <= last}

    def kth_distance(self) -> float | None:
        best = self.to_list()
        return best[-1][0] if len(best) == self.k else None

    def emit(self, sure: Callable[[float], bool]) -> list[tuple[float, tuple[int, ...]]]:
        """Those that ``sure`` confirms and that have not been emitted yet."""
        fresh = [m for m in self.to_list() if sure(m[0]) and m not in self.emitted]
        self.emitted += fresh
        return fresh

    def smallest_non_emitted_distance(self) -> float | None:
        return min((m[0] for m in self.to_list() if m not in self.emitted), default=None)

    def disable(self) -> None:
        self.enabled = False

    def is_complete(self) -> bool:
        return len(self.emitted) >= self.k


def greedy(candidates: Iterable[tuple[float, int, int]], k: int, ez: int) -> list[tuple[float, int, int]]:
    """The first ``k`` of sorted candidates that overlap none before them; reads no farther than that."""
    chosen: list[tuple[float, int, int]] = []
    for d, a, b in candidates:
        if not any(pair_overlap((a, b), m[1:], ez) for m in chosen):
            chosen.append((d, a, b))
            if len(chosen) == k:
                break
    return chosen


def top_motifs(candidates: DataFrame, k: int, ez: int) -> DataFrame:
    """Greedy motifs of each series from pairs ``series_id, a, b, d``.

    The pairs are sorted on the executors and read in order, so the driver holds
    the chosen motifs and one partition at most, and stops at the ``k``-th.
    """
    spark = candidates.sparkSession
    rows, chosen = [], {}
    candidates = candidates.select("series_id", F.round("d", 6).alias("d"), "a", "b").persist()  # counted, sampled for the sort, and sorted
    ranked = candidates.orderBy("d", "a", "b", "series_id")
    total = candidates.select("series_id").distinct().count()
    for r in ranked.toLocalIterator():
        own = chosen.setdefault(r["series_id"], [])
        if len(own) < k and not any(pair_overlap((r["a"], r["b"]), m, ez) for m in own):
            own.append((r["a"], r["b"]))
            rows.append((r["series_id"], len(own), r["a"], r["b"], r["d"]))
            if len(rows) == k * total:
                break
    candidates.unpersist()
    return spark.createDataFrame(rows, MOTIF)


def motifs_exact(series: DataFrame, w: int, k: int, ez: int, tier: str = "expression") -> DataFrame:
    """The ``k`` closest pairs over all pairs, no two of which overlap."""
    if tier == "expression":
        return top_motifs(P.all_pairs(series, w, ez), k, ez)
    held = None if tier == "tiles" else kernel.collected(series)
    if held is not None:
        return series.sparkSession.createDataFrame(kernel.greedy_motifs(series.sparkSession, held, w, k, ez), MOTIF)
    # the greedy motifs among nearest neighbours bound the distances worth listing; the bound grows until k are found
    profile = P.matrix_profile(series, w, ez, "tiles").persist()
    first = motifs_from_profile(profile, k, ez)
    bound = first.agg(F.max("distance")).first()[0]
    if bound is None:
        return first
    wanted, widest = first.count(), 2 * w**0.5
    while True:
        out = top_motifs(P.pairs_within(series, w, ez, bound + 1e-6), k, ez)
        found = out.count()
        if bound >= widest or (found >= wanted and found == k * profile.select("series_id").distinct().count()):
            profile.unpersist()
            return out
        bound = min(bound * 1.3 + 0.1, widest)


def motifs_from_profile(profile: DataFrame, k: int, ez: int) -> DataFrame:
    """Greedy motifs among the pairs of a matrix profile."""
    pairs = profile.select("series_id", F.least("i", "nn_idx").alias("a"), F.greatest("i", "nn_idx").alias("b"), F.col("nn_dist").alias("d")).distinct()
    return top_motifs(pairs, k, ez)


def drop_trivial(ranked: DataFrame, w: int) -> DataFrame:
    """Of a short ranked list ``rank, a, b, distance`` the pairs more than ``w`` apart that do not overlap the kept one before them."""
    kept, rows = None, []
    for r in ranked.where(F.col("b") - F.col("a") > w).orderBy("rank").toLocalIterator():
        s = sorted((r["a"], r["b"], *kept)) if kept else None
        if s is None or all(q - p >= w for p, q in zip(s, s[1:])):
            kept = (r["a"], r["b"])
            rows.append((r["rank"], r["a"], r["b"], r["distance"]))
    return ranked.sparkSession.createDataFrame(rows, "rank int, a long, b long, distance double")
