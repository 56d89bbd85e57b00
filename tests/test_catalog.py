"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from compare import same
from motifloom import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(catalog.queries()[name](spark, FOLDER), catalog.oracle_sql()[name], FOLDER)


def test_approximate_profile_is_an_upper_bound(spark):
    exact = {r["i"]: r["nn_dist"] for r in catalog.queries()["matrix_profile_exact"](spark, FOLDER).collect()}
    found = catalog.queries()["prescrimp_profile"](spark, FOLDER).collect()
    assert len(found) > 500
    assert all(r["nn_dist"] >= exact[r["i"]] - 1e-6 for r in found)
    assert sum(r["nn_dist"] <= exact[r["i"]] + 1e-6 for r in found) > 0.3 * len(found)


def test_an_early_stop_may_leave_motiflets_unconfirmed(spark):
    rows = catalog.queries()["motiflets_lsh_early_stop"](spark, FOLDER).collect()
    pair = [r for r in rows if r["support"] == 2]
    assert all(r["confirmed"] for r in pair) and [r["idx"] % 100 for r in pair] == [0, 0]
    best = {r["support"]: r["extent"] for r in catalog.queries()["motiflets_lsh"](spark, FOLDER).collect()}
    assert all(r["extent"] >= best[r["support"]] for r in rows)


def test_collision_probability_falls_with_distance(spark):
    p = [r["p"] for r in catalog.queries()["lsh_collision_probability"](spark, FOLDER).orderBy("distance").collect()]
    assert all(0 < y < x < 1 for x, y in zip(p, p[1:]))
