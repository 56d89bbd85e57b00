"""All pairs by matrix products, for series that every task can hold.

A series of up to ``HELD_VALUES`` values is sent to the executors once.  A task
takes a strip of roots and multiplies their z-normalised subsequences with those
of the whole series, block by block, in single precision.  Products only say
which pairs are worth a look: the error of a product is bounded, every pair within
that bound is computed again in double precision, and results hang on those alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.functions.distance import FLAT

#: Values of all series together that are sent to every task (32 MB); longer series go tile by tile.
HELD_VALUES = 4 << 20
#: Roots of a strip, rows and columns of a block, and bytes of z-normalised values that a worker keeps between tasks.
STRIP, ROWS, COLUMNS, KEPT = 2048, 512, 1024, 128 << 20
#: Closest pairs that all strips together hand to the driver.
LISTED = 200_000
#: Roots that give a first bound, and a position behind all others.
SAMPLED, BEYOND = 64, 1 << 62
EPS = float(np.finfo(np.float32).eps)


@dataclass
class Held:
    """One series and its subsequences that are not flat: ``at`` are their positions."""

    values: np.ndarray
    w: int
    at: np.ndarray = field(init=False)
    mean: np.ndarray = field(init=False)
    sd: np.ndarray = field(init=False)
    kept: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        n = max(len(self.values) - self.w, 0)
        if not n:
            self.at, self.mean, self.sd = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
            return
        x = np.lib.stride_tricks.sliding_window_view(self.values, self.w)[:n]
        step = max(1, (8 << 20) // self.w)
        mean = np.concatenate([x[k : k + step].mean(axis=1) for k in range(0, n, step)])
        sd = np.concatenate([x[k : k + step].std(axis=1) for k in range(0, n, step)])
        self.at = np.flatnonzero(sd > FLAT)
        self.mean, self.sd = mean[self.at], sd[self.at]

    def z(self, which: np.ndarray | slice) -> np.ndarray:
        """z-normalised rows of subsequences by their number among those that are not flat."""
        at = self.at[which]
        x = np.lib.stride_tricks.sliding_window_view(self.values, self.w)[at] if len(at) else np.zeros((0, self.w))
        return (x - self.mean[which][:, None]) / self.sd[which][:, None]

    def single(self, begin: int, stop: int) -> np.ndarray:
        """The same in single precision; all of them are kept where they are small."""
        if self.kept is None and len(self.at) * self.w * 4 <= KEPT:
            self.kept = np.concatenate([self.z(slice(k, k + STRIP)).astype(np.float32) for k in range(0, max(len(self.at), 1), STRIP)])
        return self.z(slice(begin, stop)).astype(np.float32) if self.kept is None else self.kept[begin:stop]

    def single_rows(self, which: np.ndarray) -> np.ndarray:
        return self.z(which).astype(np.float32) if self.kept is None else self.kept[which]

    def slack(self) -> float:
        """How far a single-precision product of two subsequences can be off, and what six digits of a distance can hide."""
        return (self.w + 4) * EPS * self.w + 4e-6 * self.w**0.5

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of pairs by number, to six digits."""
        out = np.empty(len(a))
        step = max(1, (4 << 20) // self.w)
        for k in range(0, len(a), step):
            out[k : k + step] = np.sqrt(((self.z(a[k : k + step]) - self.z(b[k : k + step])) ** 2).sum(axis=1))
        return np.round(out, 6)


_READY: dict[tuple, Held] = {}


def ready(key: tuple, shared: Broadcast, series_id: str, w: int) -> Held:
    """The worker's view of a series; the last one stays between tasks."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = Held(shared.value[series_id], w)
    return _READY[key]


def collected(series: DataFrame) -> dict[str, np.ndarray] | None:
    """Values of each series in order, or none where they are more than ``HELD_VALUES``."""
    got = series.select("series_id", "i", "v").limit(HELD_VALUES + 1).toArrow()  # one pass, whatever the length
    if got.num_rows > HELD_VALUES:
        return None
    ids = got["series_id"].combine_chunks().dictionary_encode()
    codes, at, v = ids.indices.to_numpy(), got["i"].to_numpy(), got["v"].to_numpy(zero_copy_only=False).astype(float)
    order = np.lexsort((at, codes))
    cuts = np.searchsorted(codes[order], np.arange(len(ids.dictionary) + 1))
    return {s: v[order[a:b]] for s, a, b in zip(ids.dictionary.to_pylist(), cuts, cuts[1:])}


def over_strips(
    spark: SparkSession,
    held: dict[str, np.ndarray],
    w: int,
    work: Callable[[str, Held, int, int], Iterator[list]],
    schema: str,
    strip: int = STRIP,
    tasks: int | None = None,
) -> DataFrame:
    """Rows that ``work`` makes of each strip ``begin`` to before ``stop`` of each series, a strip a task, the first and longest ones first.

    With ``tasks`` that many tasks of each series get their numbers instead of strips.
    """
    shared = spark.sparkContext.broadcast(held)  # bounded by HELD_VALUES
    strips = sorted((k, s) for s, v in held.items() for k in (range(0, max(len(v) - w, 0), strip) if tasks is None else range(tasks)))
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                begin, series_id = strips[k]
                own = ready((number, series_id, w), shared, series_id, w)
                for columns in work(series_id, own, begin, min(begin + strip, len(own.at))):
                    rows = len(columns[0])
                    if rows:
                        yield pa.record_batch([pa.array([series_id] * rows), *[pa.array(c) for c in columns]], names=names)

    if not strips:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(strips), 1, len(strips)).mapInArrow(run, schema)


def nearest(own: Held, begin: int, stop: int, k: int, ez: int) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """For each root of a strip, by number, its ``k`` nearest as (number, distance), each at least ``ez`` from the root and those before it."""
    n = len(own.at)
    rows = max(1, min(64, (32 << 20) // max(n, 1)))
    slack = np.float32(2 * own.slack())
    for first in range(begin, stop, rows):
        last = min(first + rows, stop)
        za = own.single(first, last)
        g = np.concatenate([za @ own.single(c, min(c + STRIP, n)).T for c in range(0, n, STRIP)], axis=1)
        roots = own.at[first:last]
        for r, lo, hi in zip(range(last - first), np.searchsorted(own.at, roots - ez + 1), np.searchsorted(own.at, roots + ez)):
            g[r, lo:hi] = -np.inf
        found: list[list[tuple[int, float]]] = [[] for _ in roots]
        for _ in range(k):
            best = g.max(axis=1)
            i, j = np.nonzero(g >= np.where(np.isfinite(best), best - slack, np.inf)[:, None])
            if not len(i):
                break
            d = own.distances(first + i, j)
            order = np.lexsort((j, d, i))
            for t in order[np.append(True, i[order][1:] != i[order][:-1])].tolist():
                r, c = int(i[t]), int(j[t])
                found[r].append((c, float(d[t])))
                lo, hi = np.searchsorted(own.at, (own.at[c] - ez + 1, own.at[c] + ez))
                g[r, lo:hi] = -np.inf
        yield from zip(range(first, last), found)


def profile(spark: SparkSession, held: dict[str, np.ndarray], w: int, ez: int) -> DataFrame:
    """``series_id, i, nn_dist, nn_idx`` of every subsequence that has a neighbour."""

    def work(_: str, own: Held, begin: int, stop: int) -> Iterator[list]:
        rows = [(own.at[r], near[0][1], own.at[near[0][0]]) for r, near in nearest(own, begin, stop, 1, ez) if near]
        yield [np.array([r[c] for r in rows], t) for c, t in enumerate((np.int64, float, np.int64))]

    return over_strips(spark, held, w, work, "series_id string, i long, nn_dist double, nn_idx long")


def knn(spark: SparkSession, held: dict[str, np.ndarray], w: int, k: int, ez: int) -> DataFrame:
    """``series_id, src, rank, dst, d`` as of ``pairs.knn_nonoverlapping``."""

    def work(_: str, own: Held, begin: int, stop: int) -> Iterator[list]:
        rows = [(own.at[r], n, own.at[c], d) for r, near in nearest(own, begin, stop, k, ez) for n, (c, d) in enumerate(near, 1)]
        yield [np.array([r[c] for r in rows], t) for c, t in enumerate((np.int64, np.int32, np.int64, float))]

    return over_strips(spark, held, w, work, "series_id string, src long, rank int, dst long, d double")


def rooted_sets(own: Held, begin: int, stop: int, support: int, ez: int) -> Iterator[tuple[int, int, list[int], float]]:
    """Root, support, members by position (the root first) and extent for every support from 2 on."""
    for r, near in nearest(own, begin, stop, support - 1, ez):
        members, extent = [r], 0.0
        for c, d in near:
            inner = own.distances(np.full(len(members) - 1, c), np.array(members[1:], np.int64)).max(initial=0.0) if len(members) > 1 else 0.0
            extent = max(extent, d, float(inner))
            members.append(c)
            yield int(own.at[r]), len(members), own.at[members].tolist(), extent


def sets(spark: SparkSession, held: dict[str, np.ndarray], w: int, support: int, ez: int, best: bool = False) -> DataFrame:
    """``series_id, root, support, indices, extent``; with ``best`` only each strip's least extent of each support, ties by positions."""

    def work(_: str, own: Held, begin: int, stop: int) -> Iterator[list]:
        rows = list(rooted_sets(own, begin, stop, support, ez))
        if best:
            least: dict[int, tuple] = {}
            for row in rows:
                key = (row[3], sorted(row[2]))
                if row[1] not in least or key < least[row[1]][0]:
                    least[row[1]] = (key, row)
            rows = [row for _, row in least.values()]
        yield [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            pa.array([r[3] for r in rows], pa.float64()),
        ]

    return over_strips(spark, held, w, work, "series_id string, root long, support int, indices array<long>, extent double")


class Closest:
    """The ``most`` closest pairs of a strip so far, by distance and positions."""

    def __init__(self, own: Held, most: int, bound: float = np.inf) -> None:
        self.own, self.most, self.bound, self.cut = own, most, bound, False
        self.d, self.a, self.b = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # products below it are of pairs farther than the bound, or than all kept
        self.floor = own.w - (bound + 1e-6) ** 2 / 2 - own.slack() if np.isfinite(bound) else -np.inf

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        d = self.own.distances(a, b)
        near = d <= self.bound
        self.d, self.a, self.b = np.append(self.d, d[near]), np.append(self.a, a[near]), np.append(self.b, b[near])
        if len(self.d) > 2 * self.most:
            self.trim()

    def trim(self) -> None:
        if len(self.d) > self.most:
            order = np.lexsort((self.b, self.a, self.d))[: self.most]
            self.d, self.a, self.b, self.cut = self.d[order], self.a[order], self.b[order], True
            self.floor = self.own.w - (self.d[-1] + 1e-6) ** 2 / 2 - self.own.slack()


def closest_pairs(own: Held, begin: int, stop: int, ez: int, most: int, blocked: np.ndarray, bound: float = np.inf) -> Closest:
    """The closest pairs, up to ``bound``, of a strip's roots with later subsequences at least ``ez`` on, none of them at a blocked position."""
    out = Closest(own, most, bound)
    n = len(own.at)
    buffer = np.empty((ROWS, COLUMNS), np.float32)
    for first in range(begin, stop, ROWS):
        last = min(first + ROWS, stop)
        if blocked[own.at[first:last]].all():
            continue
        za, ia = own.single(first, last), own.at[first:last]
        for c in range(int(np.searchsorted(own.at, ia[0] + ez)), n, COLUMNS):
            d = min(c + COLUMNS, n)
            g = np.matmul(za, own.single(c, d).T, out=buffer[: last - first, : d - c] if d - c == COLUMNS else None)
            ib = own.at[c:d]
            if ib[0] - ia[-1] < ez:
                g[ib[None, :] - ia[:, None] < ez] = -np.inf
            if g.max() < out.floor:
                continue
            if blocked[ia].any():
                g[blocked[ia]] = -np.inf
            if blocked[ib].any():
                g[:, blocked[ib]] = -np.inf
            floor = out.floor
            if g.size > 4 * most:  # of one block no more than ``most`` can be among the closest
                floor = max(floor, float(np.partition(g.reshape(-1), g.size - most)[g.size - most]) - 2 * own.slack())
                out.cut = True
            i, j = np.nonzero(g >= max(floor, np.finfo(np.float32).min))
            if len(i):
                out.add(first + i, c + j)
    out.trim()
    return out


def greedy_motifs(spark: SparkSession, held: dict[str, np.ndarray], w: int, k: int, ez: int, listed: int = LISTED) -> list[tuple[str, int, int, int, float]]:
    """``series_id, rank, a, b, distance`` of the ``k`` closest pairs no two of which overlap.

    Every strip lists its closest pairs, in the first round up to a distance that some roots suggest.  Where a strip had to leave some out, only
    pairs up to its last one are chosen from, and the next round lists again without
    positions that a chosen pair overlaps; a round beyond the first chooses the closest pair that is left at least.
    """
    bound = {s: float(np.append(sampled(v, w, ez)[0], np.inf)[k - 1 : k].min(initial=np.inf)) for s, v in held.items()}
    chosen: dict[str, list[tuple[float, int, int]]] = {s: [] for s in held}
    todo = dict(held)
    while todo:
        strips = sum(-(-max(len(v) - w, 0) // STRIP) for v in todo.values())
        most = max(256, listed // max(strips, 1))
        taken = {s: [p for _, a, b in chosen[s] for p in (a, b)] for s in todo}

        def work(series_id: str, own: Held, begin: int, stop: int) -> Iterator[list]:
            blocked = np.zeros(len(own.values) + 1, bool)
            for p in taken[series_id]:
                blocked[max(p - ez + 1, 0) : p + ez] = True
            got = closest_pairs(own, begin, stop, ez, most, blocked, bound[series_id])
            a, b, d, last = own.at[got.a], own.at[got.b], got.d, np.zeros(len(got.d), bool)
            if got.cut and len(last):
                last[-1] = True
            if np.isfinite(bound[series_id]):  # nothing is known beyond the bound
                a, b, d, last = np.append(a, BEYOND), np.append(b, BEYOND), np.append(d, bound[series_id]), np.append(last, True)
            yield [a, b, d, last]

        rows = over_strips(spark, todo, w, work, "series_id string, a long, b long, d double, last boolean").toArrow()  # LISTED rows, or 256 a strip
        names = np.array(rows["series_id"].to_pylist(), object)
        a, b, d, last = (rows[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "d", "last"))
        for s in list(todo):
            mine = np.flatnonzero(names == s)
            mine = mine[np.lexsort((b[mine], a[mine], d[mine]))]
            ends = np.flatnonzero(last[mine].astype(bool))
            mine = mine[: ends[0] + 1] if len(ends) else mine  # beyond the first strip's end some pairs are not listed
            x, y, own = a[mine], b[mine], chosen[s]
            free = x < BEYOND
            while len(own) < k and free.any():
                t = int(free.argmax())
                own.append((float(d[mine[t]]), int(x[t]), int(y[t])))
                for p in own[-1][1:]:
                    free &= (np.abs(x - p) >= ez) & (np.abs(y - p) >= ez)
            bound[s] = np.inf
            if len(own) >= k or not len(ends):
                del todo[s]
    return [(s, n, a, b, d) for s, own in chosen.items() for n, (d, a, b) in enumerate(own, 1)]


def sampled(values: np.ndarray, w: int, ez: int, roots: int = SAMPLED) -> tuple[np.ndarray, float]:
    """Nearest-neighbour distances of some evenly spaced roots, ascending, and the mean of all their distances."""
    own = Held(values, w)
    if len(own.at) < 2:
        return np.zeros(0), 0.0
    picked = np.unique(np.linspace(0, len(own.at) - 1, roots).astype(np.int64))
    za = own.z(picked).astype(np.float32)
    best, total, count = np.full(len(picked), -np.inf), 0.0, 0
    for c in range(0, len(own.at), STRIP):
        g = za @ own.single(c, min(c + STRIP, len(own.at))).T
        g[np.abs(own.at[c : c + STRIP][None, :] - own.at[picked][:, None]) < ez] = -np.inf
        far = np.isfinite(g)
        total, count = total + float(np.sqrt(np.maximum(2 * w - 2 * g[far], 0)).sum(dtype=float)), count + int(far.sum())
        best = np.maximum(best, g.max(axis=1))
    near = np.sqrt(np.maximum(2 * w - 2 * best[np.isfinite(best)], 0) + 2 * own.slack())  # no less than the distances themselves
    return np.sort(near), total / max(count, 1)


def contrast(held: dict[str, np.ndarray], w: int, k: int, ez: int) -> float:
    """A rough relative contrast: the mean distance against the ``k``-th nearest-neighbour distance of some roots of the longest series."""
    near, mean = sampled(max(held.values(), key=len), w, ez)
    return mean / max(float(near[min(k, len(near)) - 1]), 1e-9) if len(near) else 1.0


def mean_distance(held: dict[str, np.ndarray], w: int, ez: int, n: int, seed: int) -> float | None:
    """Mean distance of about ``n`` pairs of one series drawn at random, at least ``ez`` apart."""
    own = Held(next(iter(held.values())), w)
    rng = np.random.default_rng(seed)
    if not len(own.at):
        return None
    a, b = rng.integers(0, len(own.at), (2, n))
    apart = np.abs(own.at[a] - own.at[b]) >= max(ez, 1)
    return float(own.distances(a[apart], b[apart]).mean()) if apart.any() else None
