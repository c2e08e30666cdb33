"""Queries against their SQL on few events: distances of 0, and states that tie by their sums."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.operators import evaluate as EV
from tideline.operators import quality as Q

T = dt.datetime(2024, 1, 10)


def write_events(spark, path, rows):
    """rows: user_id, hours from T, event_type, value, k."""
    made = [(i, T + dt.timedelta(hours=h), u, kind, v, f'{{"k": {k}}}') for i, (u, h, kind, v, k) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def by_sql(d, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    return con.execute(entry.oracle_sql()[name]).fetchall()


#: An anchor with a chair at distance 0 beside a bed at 2, one with a room at 0, and one whose distances are all over 0.
ZEROS = [
    (1, 100, "error", 3.0, 4), (1, 95, "click", 0.0, 7), (1, 90, "view", 2.0, 8), (1, 80, "signup", 1.0, 9),
    (2, 100, "error", 3.0, 5), (2, 99, "purchase", 0.0, 21), (2, 85, "purchase", 0.0, 22), (2, 60, "click", 4.0, 24),
    (3, 100, "error", 3.0, 6), (3, 92, "click", 5.0, 31), (3, 91, "view", 7.0, 32),
]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    return write_events(spark, tmp_path_factory.mktemp("zeros"), ZEROS)


@pytest.mark.parametrize("name", ["b28_window_summary", "b30_legacy_state_probs", "b31_label_and_margin", "b52_score_v2", "b53_blended_state", "b56_score_v3", "b57_score_evaluation"])
def test_a_distance_of_0_counts_as_the_least(spark, zeros, name):
    made, told = (sorted(map(tuple, rows), key=lambda r: r[0]) for rows in (entry.queries()[name](spark, zeros).collect(), by_sql(zeros, name)))
    assert len(made) == len(told) == 3
    for a, b in zip(made, told, strict=True):
        assert list(a) == [pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x for x in b]


def test_sums_that_tie_go_to_the_first_state(spark):
    """0.1 + 0.2 and 0.3 differ by their last bit in doubles."""
    rows = [(1, "s", 0.3, 0.1, 0.1, 0.05), (2, "s", 0.0, 0.2, 0.2, 0.05)]
    p = [f"prob_{x}" for x in Q.STATES]
    m = spark.createDataFrame(rows, "row_id long, sequence_id string, " + ", ".join(f"{c} double" for c in p)).selectExpr("*", "'bed' AS truth_label", "row_id AS event_instance_ordinal", "1 AS response_latency", "1 AS predicted_latency")
    assert [r["derived"] for r in Q.sequence_predictions(m).collect()] == ["chair"]
    truth = m.selectExpr("row_id", "sequence_id", "'x' AS split", "truth_label", "event_instance_ordinal", "false AS offscreen", "true AS offscreen_counts")
    scored = EV.scored_sequences(truth, m.selectExpr("row_id", "row_id AS prediction_id"), m.selectExpr("'a' AS model", "row_id AS prediction_id", *p), ["a"])
    assert [r["derived"] for r in scored.collect()] == ["chair"]
