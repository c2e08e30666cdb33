import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import cohort as C
from tideline.operators import models as M
from tideline.operators import rates as R
from tideline.sources import tables


def hours(spark, rows):
    """(monitor, subject, cohort, hour string, valid) rows."""
    df = spark.createDataFrame(rows, "monitor_id long, subject_id long, cohort_type string, h string, row_valid_pct boolean")
    return df.select(F.lit(5).alias("site_id"), F.lit(1).cast("long").alias("division_id"), "monitor_id", "subject_id", "cohort_type", F.col("h").cast("timestamp").alias("hour_ts"), "row_valid_pct")


def test_cells_share_events_by_position(spark):
    df = spark.createDataFrame([("1", "d", "Monday", "2024Q1", 0.75, 0.25, 4), ("1", "d", "Monday", "2024Q1", 0.0, 0.0, 2)], "division_id string, daypart string, day_of_week string, calendar_quarter string, pct_chair double, pct_bed double, falls_in_hour long")
    got = {r.position: (r.exposure_hours, r.fall_count) for r in R.position_cells(df).collect()}
    assert got == {"chair": (0.75, 3.0), "bed": (0.25, 1.0)}


def test_eligibility_gates_and_reasons(spark):
    stamp = [f"2024-01-01 0{h}:00:00" for h in range(6)]
    rows = [(1, 1, "control", s, True) for s in stamp[:4]] + [(2, 2, "control", s, True) for s in stamp[:3]] + [(3, 3, "control", s, True) for s in (stamp[0], stamp[1], stamp[2], stamp[5])] + [(4, 4, None, s, i > 2) for i, s in enumerate(stamp[:4])]
    got = {r.monitor_id: (r.eligible, r.exclusion_reason) for r in C.eligibility(hours(spark, rows)).collect()}
    assert got == {1: (True, ""), 2: (False, "duration_lt_min_hours"), 3: (False, "incomplete_hourly_coverage"), 4: (False, "invalid_pct_row|unmapped_cohort")}


def test_shares_with_and_without_the_fourth(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.1, 0.1), (0.5, 0.3, 0.1, None), (1.2, -0.2, 0.0, 0.0), (0.49, 0.3, 0.1, 0.1)], "pct_chair double, pct_bed double, pct_ambulatory double, pct_not_located double")
    df = df.withColumn("hour_ts", F.lit("2024-01-01 07:30:00").cast("timestamp")).withColumns({c: F.lit(None).cast("long") for c in C.COUNTERS})
    got = [(r.row_valid_pct, r.daypart, r.num_alarms) for r in C.clean_hourly(df).orderBy("pct_chair", "pct_not_located").collect()]
    assert [g[0] for g in got] == [True, False, True, False] and got[0][1:] == ("window_06_08", 0)


def events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, monitor_id long, subject_id long, local string, utc string, injury string")
    return df.select("event_id", F.lit(5).alias("site_id"), F.lit(1).cast("long").alias("division_id"), "monitor_id", "subject_id", F.col("local").cast("timestamp").alias("ts_local"), F.col("utc").cast("timestamp").alias("ts_utc"), F.col("injury").alias("injury_label"))


def test_clean_events_falls_back_to_the_zone_and_dedupes(spark):
    df = events(spark, [(1, 1, 1, "2024-01-01 06:00:00", "2024-01-01 12:00:00", "x"), (2, 1, 1, None, "2024-01-01 12:00:00", None), (3, 1, None, None, None, None)])
    got = {r.event_id: (r.local_source, r.injury_complete) for r in C.clean_events(df).collect()}
    assert got == {1: ("timestamp_local", True), 3: ("missing", False)}


def test_unknown_subjects_link_through_hours_with_one_subject(spark):
    slots = hours(spark, [(1, 10, "control", "2024-01-01 06:00:00", True), (2, 20, "control", "2024-01-01 06:00:00", True), (2, 21, "control", "2024-01-01 06:00:00", True)])
    ev = events(spark, [(1, 1, None, "2024-01-01 06:10:00", None, None), (2, 2, None, "2024-01-01 06:10:00", None, None), (3, 2, 21, "2024-01-01 06:50:00", None, None)]).withColumn("cohort_type", F.lit("control")).withColumn("event_ts_local", F.col("ts_local"))
    got = {r.event_id: r.subject_id for r in C.link_events_to_hours(ev, slots, "event_ts_local").collect()}
    assert got == {1: 10, 3: 21}


def test_base_takes_the_clock_that_links_more(spark):
    h = hours(spark, [(1, 1, "control", f"2024-01-01 0{i}:00:00", True) for i in range(6)])
    elig = C.eligibility(h)
    ev = events(spark, [(1, 1, 1, "2023-12-31 20:00:00", "2024-01-01 02:10:00", None), (2, 1, 1, "2023-12-31 21:00:00", "2024-01-01 02:40:00", None)]).withColumn("cohort_type", F.lit("control")).withColumn("event_ts_local", F.col("ts_local"))
    got = {r.hour_ts.hour: r.falls_in_hour for r in C.analysis_base(h, ev, elig).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 0, 5: 0}


def test_cohort_events_win_and_overrides_add(spark):
    e, h = spark.createDataFrame([(1,), (None,)], "monitor_id long"), spark.createDataFrame([(1,), (2,)], "monitor_id long")
    cohort = C.derive_cohort(e, h)
    got = {r.monitor_id: r.cohort_type for r in C.override_cohort(cohort, [2834]).collect()}
    assert got == {1: "intervention", 2: "control", 2834: "intervention"}


def test_confidence_segments(spark):
    df = spark.createDataFrame([(0.9, 0.9, 10.0), (0.6, 0.6, 100.0), (0.9, 0.3, 10.0), (None, None, None)], "pre_state_visible_prob double, pre_dropout_visibility_ratio double, pre_dropout_last_visible_gap_seconds double")
    got = [(round(r.confidence_weight, 6), r.confidence_segment) for r in R.confidence_features(df).collect()]
    assert got == [(round(0.45 + 0.315 + 0.15 * (1 - 10 / 180), 6), "high_confidence"), (round(0.3 + 0.21 + 0.15 * (1 - 100 / 180), 6), "medium_confidence"), (round(0.45 + 0.105 + 0.15 * (1 - 10 / 180), 6), "low_confidence"), (0.0, "low_confidence")]


def cells(spark):
    rows = [(str(d), p, w, "2024Q1", s, h, f) for d in range(3) for p in ("am", "pm") for w in ("Monday", "Sunday") for s, h, f in (("chair", 10.0 + d, 6.0 + d), ("bed", 40.0, 5.0 + d + (p == "am")))]
    return spark.createDataFrame(rows, "division_id string, daypart string, day_of_week string, calendar_quarter string, position string, exposure_hours double, fall_count double")


def dense(rows, family, alpha=1.0):
    """Coefficients and covariances of one scenario by iterated weighted least squares on the whole design matrix."""
    levels = [sorted({r[i] for r in rows})[1:] for i in range(4)]
    x = np.array([[1.0, r[4] == "chair", *[r[i] == v for i in range(4) for v in levels[i]]] for r in rows], dtype=float)
    y, h = np.array([r[6] for r in rows]), np.array([r[5] for r in rows])
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.sum() / h.sum())
    for _ in range(200):
        mu = h * np.exp(x @ beta)
        v = mu / (1 + alpha * mu) if family != "poisson" else mu
        s = (y - mu) * v / mu
        beta = beta + np.linalg.solve(x.T @ (v[:, None] * x), x.T @ s)
    inverse = np.linalg.inv(x.T @ (v[:, None] * x))
    leverage = v * np.einsum("ij,jk,ik->i", x, inverse, x)
    scaled = x * (s / (1 - leverage))[:, None]
    by = {}
    for r, row in zip(rows, x * s[:, None], strict=True):
        by[r[0]] = by.get(r[0], 0) + row
    cluster = sum(np.outer(g, g) for g in by.values()) * len(by) / (len(by) - 1)
    return beta, {"default": inverse, "hc3": inverse @ scaled.T @ scaled @ inverse, "cluster": inverse @ cluster @ inverse}


@pytest.mark.parametrize("family", ["poisson", "negative_binomial"])
def test_models_of_many_scenarios_match_a_dense_fit(spark, family):
    rng, rows = np.random.default_rng(2), []
    for scenario, divisions, parts in (("a", 4, ("am", "pm")), ("b", 3, ("am", "noon", "pm")), ("few", 2, ("am",))):
        for d in range(divisions):
            for p in parts:
                for w in ("Monday", "Sunday"):
                    for s in ("chair", "bed"):
                        hours = float(rng.uniform(5, 60))
                        mean = hours * np.exp(-2 + 0.7 * (s == "chair") + 0.2 * d + 0.4 * (p == "pm"))
                        rows.append((scenario, str(d), p, w, "2024Q1", s, hours, 0.2 if scenario == "few" else float(rng.poisson(mean))))
    df = spark.createDataFrame(rows, "scenario string, division_id string, daypart string, day_of_week string, calendar_quarter string, position string, exposure_hours double, fall_count double").repartition(4)
    fits = M.Fits(df, family)
    assert sorted(fits.fitted) == ["a", "b"]
    table = {(r.label, r.covariate): r for r in fits.covariates().collect()}
    for scenario in ("a", "b"):
        beta, cov = dense([r[1:] for r in rows if r[0] == scenario], family)
        for kind in ("default", "hc3", "cluster"):
            (r,) = [r for r in fits.ratios(kind).collect() if r.label == scenario]
            se = np.sqrt(cov[kind][1, 1])
            assert (r.rr, r.ci_lower, r.ci_upper) == pytest.approx(tuple(np.exp(beta[1] + np.array([0, -1.96, 1.96]) * se)), rel=1e-5)
        own = table[(scenario, "division_id=1")]
        place = 2 + 0
        assert (own.coef, own.se) == pytest.approx((beta[place], np.sqrt(cov["default"][place, place])), rel=1e-5)
    (few,) = [r for r in fits.ratios().collect() if r.label == "few"]
    assert few.rr is None and few.notes == "insufficient_data"


def test_overdispersed_cells_get_a_negative_binomial_refit(spark):
    c = cells(spark)
    labels = {r.label for r in M.robust_models(c).collect()}
    assert labels == {"primary_adjusted", "primary_adjusted_hc3", "primary_adjusted_clustered"}
    wild = c.withColumn("fall_count", F.when(F.col("division_id") == "1", F.col("fall_count") * F.when(F.col("daypart") == "am", 30).otherwise(1)).otherwise(F.col("fall_count")))
    assert "primary_adjusted_negative_binomial" in {r.label for r in M.robust_models(wild).collect()}


def test_misclassification_refits_move_the_ratio(spark):
    c = cells(spark)
    rr = {r.label: r.rr for r in M.misclassification_models(c).collect()}
    assert rr["symmetric_swap_30pct"] < rr["symmetric_swap_10pct"] and rr["bed_to_chair_20pct"] > rr["chair_to_bed_20pct"]


def test_swap_keeps_the_events(spark):
    c = cells(spark)
    total = c.agg(F.sum("fall_count")).first()[0]
    for r in R.misclassification_swap(c).groupBy("scenario").agg(F.sum("fall_count").alias("n")).collect():
        assert r.n == pytest.approx(total)


def test_conform_casts_and_fills(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    got = tables.conform(spark.createDataFrame([("1", "x"), ("no", "2.5")], "a string, b string"), schema, {"c": "z"}).collect()
    assert [tuple(r) for r in got] == [(1, None, "z"), (None, 2.5, "z")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    for kind in ("csv", "json", "parquet"):
        path = f"{tmp_path}/t.{kind}"
        tables.write_table(df, path, kind)
        assert sorted(map(tuple, tables.read_table(spark, path, df.schema).collect())) == [(1, "x"), (2, None)]
    assert tables.read_table(spark, f"{tmp_path}/none.parquet", df.schema).count() == 0
    assert tables.read_validated_csv(spark, f"{tmp_path}/t.csv", ["a", "zz"])[1] == {"status": "missing_columns", "missing_columns": ["zz"]}
    assert tables.read_validated_csv(spark, f"{tmp_path}/no.csv", ["a"])[1]["status"] == "missing_file"
