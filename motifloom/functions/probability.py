"""Collision and failure probabilities of the hash tables, on the driver and as expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc((mean - x) / (sd * math.sqrt(2)))


def erf(x: float) -> float:
    return math.erf(x)


def erfc(x: float) -> float:
    return math.erfc(x)


def erf_inv(y: float) -> float:
    """Inverse of ``erf`` on (-1, 1)."""
    return NormalDist().inv_cdf((y + 1) / 2) / math.sqrt(2)


def erfc_inv(y: float) -> float:
    return -NormalDist().inv_cdf(y / 2) / math.sqrt(2)


def collision_probability(d: float, r: float) -> float:
    """That one floor-quantised projection of width ``r`` agrees for two vectors at distance ``d``."""
    if d <= 0:
        return 1.0
    t = r / d
    return 1 - 2 * normal_cdf(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def failure_probability(d: float, r: float, repetitions: int, prefix: int, previous: int | None = None, maximum: int = 0) -> float:
    """That two vectors at distance ``d`` have met in none of the tables run so far.

    ``repetitions`` tables have been run at ``prefix``; where there was a longer prefix before, ``maximum`` of them at that.
    """
    p = collision_probability(d, r)
    out = (1 - p**prefix) ** repetitions
    if previous is not None:
        out *= (1 - p**previous) ** max(0, maximum - repetitions)
    return out


def success_probability(p: float, prefix: int, repetitions: int) -> float:
    return 1 - (1 - p**prefix) ** repetitions


def repetitions_needed(d: float, r: float, prefix: int, delta: float) -> int:
    p = collision_probability(d, r) ** prefix
    if p >= 1:
        return 1
    return math.ceil(math.log(delta) / math.log1p(-p)) if p > 0 else 1 << 31


def largest_confirmed(most: float, r: float, repetitions: int, prefix: int, delta: float, previous: int | None = None, maximum: int = 0) -> float:
    """The largest distance up to ``most`` whose failure probability is below ``delta``; 0 where there is none.

    The failure probability rises with the distance, so 50 halvings of the interval find it to the last digits.
    """
    missed = lambda d: failure_probability(d, r, repetitions, prefix, previous, maximum)
    if missed(most) < delta:
        return most
    step, at = most / 2, 0.0
    for _ in range(50):
        at, step = at + step if missed(at + step) < delta else at, step / 2
    return at


def failure_expr(p: Column, prefix: Column, repetitions: Column, previous: Column, maximum: Column) -> Column:
    """The failure probability given ``p``; without a previous prefix (null) its factor is 1."""
    own = F.pow(1 - F.pow(p, prefix), repetitions)
    before = F.pow(1 - F.pow(p, previous), F.greatest(F.lit(0), maximum - repetitions))
    return own * F.coalesce(before, F.lit(1.0))


def simhash_probability(cosine: Column) -> Column:
    return 1 - F.acos(cosine) / math.pi


def rho(p1: float, p2: float) -> float:
    return math.log(p1) / math.log(p2)
