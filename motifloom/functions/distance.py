"""Distances of arrays and predicates on positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard deviation up to which a subsequence counts as flat.
FLAT = 1e-4


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalized(x: Column) -> Column:
    n = norm(x)
    return F.transform(x, lambda e: F.try_divide(e, n))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))


def euclidean_within(x: Column, y: Column, threshold: float) -> Column:
    """The Euclidean distance where it is at most ``threshold``, else null; squares are added up only until they exceed it."""
    most = float(threshold) ** 2
    total = F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), F.lit(0.0), lambda s, e: F.when(s > most, s).otherwise(s + (e["x"] - e["y"]) * (e["x"] - e["y"])))
    return F.when(F.sqrt(total) <= threshold, F.sqrt(total))


def znormalized(x: Column, mean: Column, sd: Column) -> Column:
    """Null for a flat subsequence; guarded inside, for filters may move."""
    return F.when(sd > FLAT, F.transform(x, lambda e: F.try_divide(e - mean, sd)))


def zdot(x: Column, mx: Column, sx: Column, y: Column, my: Column, sy: Column, w: int) -> Column:
    """Dot product of z-normalised arrays from the raw one; null if either is constant."""
    return F.try_divide(dot(x, y) - w * mx * my, sx * sy)


def distance_of_zdot(z: Column, w: int) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 * w - 2.0 * z))


def correlation(distance: Column, w: int) -> Column:
    return 1 - distance * distance / (2.0 * w)


def raw_dot(distance: Column, w: int, ma: Column, sa: Column, mb: Column, sb: Column) -> Column:
    """Raw dot product behind a z-normalised distance."""
    return correlation(distance, w) * w * sa * sb + w * ma * mb


def within(distance: Column, threshold: Column | float) -> Column:
    """The distance where it is at most the threshold, else null."""
    return F.when(distance <= threshold, distance)


def relative_contrast(average: Column, extent: Column) -> Column:
    return F.try_divide(average, extent)


def relative_error(found: Column, true: Column) -> Column:
    return F.try_divide(F.abs(found - true), F.abs(true))


def neighbour_overlaps(neighbour: Column, position: Column, ez: int) -> Column:
    """Whether the ``j`` of a struct of a distance, a position and, where it has one, a flag ``active`` that is set, is closer than ``ez``."""
    return F.abs(neighbour["j"] - position) < ez


def in_range(floors: Column, most: int = 127) -> Column:
    """Whether all floors of a hash fit in a byte; full integers are kept, so nothing needs this but a count."""
    return F.forall(floors, lambda h: F.abs(h) <= most)


def overlaps(a: Column, b: Column, ez: int) -> Column:
    return F.abs(a - b) < ez


def overlaps_any(i: Column, positions: Column, ez: int) -> Column:
    return F.exists(positions, lambda p: F.abs(p - i) < ez)


def overlap_count(i: Column, positions: Column, ez: int) -> Column:
    return F.size(F.filter(positions, lambda p: F.abs(p - i) < ez))


def motif_overlap(a1: Column, b1: Column, a2: Column, b2: Column, ez: int) -> Column:
    """Whether any two of four positions that are next to each other in order are closer than ``ez``."""
    s = F.array_sort(F.array(a1, b1, a2, b2))
    return ((s[1] - s[0]) < ez) | ((s[2] - s[1]) < ez) | ((s[3] - s[2]) < ez)


def motiflet_overlap(x: Column, y: Column, ez: int) -> Column:
    """Whether any position of one is closer than ``ez`` to any of the other."""
    return F.exists(x, lambda a: F.exists(y, lambda b: F.abs(a - b) < ez))


def polynomial(z: Column, coefficients: list[float]) -> Column:
    """Horner evaluation; coefficients from the constant on."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * z + c
    return out


def byte_size(text: Column) -> Column:
    """Bytes of ``10 GB``, ``512k``, ``7``: binary multiples, null for other suffixes."""
    t = F.lower(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*(?:([kmg]?)(?:i?b|bytes)?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*(?:([kmg]?)(?:i?b|bytes)?)$", 2)
    scale = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return (number * scale).cast("long")


def format_bytes(n: Column) -> Column:
    return (
        F.when(n >= 1 << 30, F.concat(F.format_number(n / (1 << 30), 2), F.lit(" GB")))
        .when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 2), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(F.format_number(n / (1 << 10), 2), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes, hours, days or years, to one digit."""
    units = [(60.0, 1.0, "s"), (3600.0, 60.0, "m"), (86400.0, 3600.0, "h"), (31_536_000.0, 86400.0, "days")]
    out = None
    for below, scale, name in units:
        value = F.concat(F.round(seconds / scale, 1).cast("string"), F.lit(" " + name))
        out = F.when(seconds < below, value) if out is None else out.when(seconds < below, value)
    return out.otherwise(F.concat(F.round(seconds / 31_536_000.0, 1).cast("string"), F.lit(" years")))
