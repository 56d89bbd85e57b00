"""Hash tables of series that every task can hold: a table a task, in which buckets are made, met pairs compared, and the closest kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from motifloom.operators.kernel import Closest, Held, over_strips
from motifloom.operators.lsh import K, projections

#: Closest pairs that a table hands to the driver, pairs compared at once, and pairs that a table may meet before it is given up.
LISTED, TOGETHER, MOST_MET = 4096, 1 << 16, 50_000_000
#: Widths that are tried for the buckets, and tables they are tried on.
LADDER, TRIED = 28, 4


def floors(own: Held, vectors: np.ndarray, shares: np.ndarray, width: float) -> np.ndarray:
    """The floors of one table's projections for all subsequences of a series that are not flat."""
    flat = vectors.T.astype(np.float32)
    z = [own.single(k, k + 4096) @ flat for k in range(0, len(own.at), 4096)]
    return np.floor((np.concatenate(z) if z else np.zeros((0, K))) / width + shares).astype(np.int64)


def keys_of(h: np.ndarray, prefix: int) -> np.ndarray:
    """A number for each distinct prefix of floors."""
    out = np.zeros(len(h), np.uint64)
    for k in range(prefix):
        out = (out ^ h[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def met_pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal keys, the smaller first, in parts."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.arange(len(keys) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[ordered[at] == ordered[at + step]]
        if len(at):
            yield order[at], order[at + step]
        step += 1


def number_met(keys: np.ndarray) -> int:
    count = np.unique(keys, return_counts=True)[1]
    return int((count * (count - 1) // 2).sum())


@dataclass
class Round:
    """What a batch of tables found: the closest pairs, the distance up to which none was left out, and how many pairs met."""

    pairs: list[tuple[float, int, int]]
    complete: float
    met: int
    given_up: bool


def run_tables(spark: SparkSession, held: dict[str, np.ndarray], w: int, ez: int, first: int, count: int, seed: int, prefix: int, previous: int | None, width: float, bound: float) -> Round:
    """Tables ``first`` to before ``first + count`` of the one series in ``held``, at a prefix, without pairs that met at ``previous``; pairs up to ``bound``."""

    def work(_: str, own: Held, number: int, __: int) -> Iterator[list]:
        vectors, shares = projections(w, 1, seed + 7919 * (first + number))
        h = floors(own, vectors[0], shares[0], width)
        keys = keys_of(h, prefix)
        before = None if previous is None else keys_of(h, previous)
        closest, met = Closest(own, LISTED, bound), number_met(keys)
        lost = met > MOST_MET
        for a, b in () if lost else met_pairs(keys):
            fresh = own.at[b] - own.at[a] >= ez
            if before is not None:
                fresh &= before[a] != before[b]
            a, b = a[fresh], b[fresh]
            for k in range(0, len(a), TOGETHER):
                x, y = a[k : k + TOGETHER], b[k : k + TOGETHER]
                g = np.einsum("ij,ij->i", own.single_rows(x), own.single_rows(y))
                near = g >= closest.floor
                if near.any():
                    closest.add(x[near], y[near])
        closest.trim()
        full = float(closest.d[-1]) if closest.cut else np.inf
        yield [
            np.append(own.at[closest.a], -1),
            np.append(own.at[closest.b], -1 if lost else 0),
            np.append(closest.d, full),
            np.append(np.zeros(len(closest.d), np.int64), met),
        ]

    rows = over_strips(spark, held, w, work, "series_id string, a long, b long, d double, met long", tasks=count).toArrow()
    a, b, d, met = (rows[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "d", "met"))
    tables = a < 0
    pairs = set(zip(d[~tables].tolist(), a[~tables].tolist(), b[~tables].tolist()))
    return Round(sorted(pairs), float(d[tables].min()) if tables.any() else np.inf, int(met.sum()), bool((b[tables] < 0).any()))


def fitting_width(spark: SparkSession, held: dict[str, np.ndarray], w: int, ez: int, seed: int, wanted: float) -> float:
    """The least width of a ladder at which tables have ``wanted`` pairs in whole-hash collisions, counting places that overlap once."""

    def work(_: str, own: Held, number: int, __: int) -> Iterator[list]:
        vectors, shares = projections(w, 1, seed + 1 + number)
        met = []
        for width in widths:
            keys = keys_of(floors(own, vectors[0], shares[0], width), K)
            met.append(number_met(np.unique(np.stack([keys, (own.at // ez).astype(np.uint64)], axis=1), axis=0)[:, 0]))
        yield [np.arange(len(widths)), np.array(met, np.int64)]

    widths = (0.25 * (16 * w**0.5) ** (np.arange(LADDER) / (LADDER - 1))).tolist()
    rows = over_strips(spark, held, w, work, "series_id string, step long, met long", tasks=TRIED).toArrow()
    met = np.bincount(rows["step"].to_numpy(), rows["met"].to_numpy(), LADDER) / TRIED
    enough = np.flatnonzero(met >= wanted)
    return widths[int(enough[0])] if len(enough) else widths[-1]
