"""Queries over whole tables that have no SQL, against brute force."""

import pytest

from larkspur import queries as q


def test_weighted_means_of_all_users(spark, sf):
    sums, want = {}, {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        num, den = sums.get(r.user_id, (0.0, 0.0))
        sums[r.user_id] = num, den = r.value + 0.5 * num, 1 + 0.5 * den
        want[r.event_id] = num / den
    got = {r.event_id: r.m for r in q.QUERIES["weighted_all"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=6e-5) for k in want)
