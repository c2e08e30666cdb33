"""Scorers against their SQL where a value ties with a threshold, so that the last bit of a sum or a power decides."""

import pytest

import __spark_entry__ as entry
from tests.test_odd_events import by_sql, write_events

#: Anchors at hour 200 whose greatest visible share is 0.45, or whose nudges rise by 0.5, in decimals.
TIES = [
    (1, 200, "error", 45.89, 52), (1, 119.5, "view", 285.84, 29), (1, 147.5, "click", 47.97, 90), (1, 167.5, "purchase", 33.17, 73), (1, 194.5, "signup", 28.08, 80),
    (2, 200, "error", 19.26, 0), (2, 75.5, "signup", 47.09, 46), (2, 82.5, "signup", 2.24, 32), (2, 104.5, "view", 45.53, 20), (2, 129.5, "signup", 36.37, 2), (2, 132.5, "view", 13.79, 76),
    (2, 147.5, "purchase", 13.18, 72), (2, 161.5, "click", 16.6, 20), (2, 168.5, "click", 74.91, 70),
    (3, 200, "error", 9.91, 96), (3, 167.5, "view", 0.62, 61), (3, 190.5, "purchase", 164.98, 18), (3, 198.5, "signup", 72.25, 71),
    (4, 200, "error", 4.75, 98), (4, 104.5, "view", 12.72, 75), (4, 115.5, "view", 30.79, 50), (4, 146.5, "purchase", 5.82, 90), (4, 147.5, "click", 2.13, 60), (4, 182.5, "signup", 75.21, 50),
]


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    return write_events(spark, tmp_path_factory.mktemp("ties"), TIES)


@pytest.mark.parametrize("name", ["b52_score_v2", "b56_score_v3"])
def test_ties_with_a_threshold_go_as_in_sql(spark, ties, name):
    made, told = (sorted(map(tuple, rows), key=lambda r: r[0]) for rows in (entry.queries()[name](spark, ties).collect(), by_sql(ties, name)))
    assert len(made) == len(told) == 4
    for a, b in zip(made, told, strict=True):
        assert list(a) == [pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x for x in b]
