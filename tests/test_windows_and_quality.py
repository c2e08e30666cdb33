import pytest
from pyspark.sql import functions as F

from tideline.functions import probs as P
from tideline.functions.timefn import circular_distance, clock_seconds, wrapped_difference
from tideline.operators import compare as X
from tideline.operators import joins as J
from tideline.operators import opstudy as O
from tideline.operators import quality as Q
from tideline.operators import sessions as S
from tideline.operators import windows as W
from tideline.plans import registry


def stamps(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 100


def test_interval_join_ends_and_wildcard(spark):
    a = stamps(spark, [(1, 7, 70, "2024-01-01 00:01:00"), (2, 7, None, "2024-01-01 00:01:00")], "anchor_id long, monitor_id long, subject_id long, anchor_ts string", "anchor_ts")
    s = stamps(spark, [(10, 7, 70, "2024-01-01 00:00:30"), (11, 7, 71, "2024-01-01 00:01:10"), (12, 7, 70, "2024-01-01 00:01:11"), (13, 8, 70, "2024-01-01 00:01:00")], "event_id long, monitor_id long, subject_id long, ts string", "ts")
    got = sorted((r.anchor_id, r.event_id) for r in J.interval_join(a, s, ["monitor_id"], -30, 10, wildcard="subject_id").collect())
    assert got == [(1, 10), (2, 10), (2, 11)]
    left = J.interval_join(a, s, ["monitor_id"], 5, 8, wildcard="subject_id", how="left")
    assert sorted((r.anchor_id, r.event_id) for r in left.collect()) == [(1, None), (2, None)]


def test_gap_sessions_and_unions(spark):
    s = stamps(spark, [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:00:11")], "monitor_id long, ts string", "ts")
    got = [(r.frame_count, r.duration_seconds) for r in S.gap_sessions(s, ["monitor_id"], 5, "UTC").orderBy("chunk").collect()]
    assert got == [(2, 5), (1, 0)]
    spans = stamps(spark, [(1, "2024-01-01 00:00:00", "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:05", "2024-01-01 00:00:12"), (1, "2024-01-01 00:01:00", "2024-01-01 00:01:00.5")], "monitor_id long, start string, end string", "start", "end")
    assert J.union_seconds(spans, ["monitor_id"]).first().active_seconds == 13


def test_dominant_state_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (None, 3.0, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(W.dominant_state("a", "b", "c")).collect()] == ["chair", "bed", "no_patient"]
    with pytest.raises(ValueError):
        W.control_anchors(df, (1,))


def test_majority_label_ties(spark):
    ev = stamps(spark, [(1, 1, "1970-01-01 00:00:10"), (2, 2, "1970-01-01 00:00:10"), (3, 3, "1970-01-01 00:00:10")], "event_id long, monitor_id long, ts string", "ts")
    grid = spark.createDataFrame([(1, 9, "bed"), (1, 10, "chair"), (2, 8, "room"), (2, 11, "bed")], "monitor_id long, step long, label string")
    got = {r.event_id: (r.assigned, r.tied) for r in O.window_majority_label(ev, grid, ["monitor_id"], (3,), 1).collect()}
    assert got == {1: ("chair", 2), 2: ("bed", 2), 3: ("missing_posture", 0)}


def test_clock_columns(spark):
    df = spark.createDataFrame([("23:59:50", "00:00:10"), ("25:00:00", "7:05")], "a string, b string")
    a, b = clock_seconds(F.col("a")), clock_seconds(F.col("b"))
    got = df.select(wrapped_difference(b, a), circular_distance(a, b), a, b).collect()
    assert tuple(got[0])[:2] == (20, 20) and got[1][2] is None and got[1][3] == 7 * 3600 + 300


def test_annotation_statuses_and_relabelling(spark):
    rows = [
        (1, "1|2024-01-01|10:00", "Room", "Chair", "10:00:00", "10:00:30", "09:59:51", "slip"), (2, "1|2024-01-01|10:00", "other", "chair", "10:00:10", None, "10:00:00", ""),
        (3, "2|2024-01-01|10:00", "bed", None, "-", None, None, "trip"), (4, "3|2024-01-01|10:00", "bed", None, "10:00:00", None, None, "No Fall, bad video"), (5, "4|2024-01-01|10:00", None, None, "10:00:00", None, None, "Bad Video"),
    ]
    ann = Q.prepare_annotations(spark.createDataFrame(rows, "row_id long, event_key string, prefall_location string, last_furniture string, fall_time string, response_time string, departure_time string, fall_tags string"))
    assert {r.row_id: r.status for r in ann.collect()} == {1: "included_fall", 2: "included_fall", 3: "excluded_offscreen", 4: "accepted_nonfall", 5: "excluded_bad_or_no_video"}
    t = {r.row_id: (r.truth_label, r.sequence_id, r.chain) for r in Q.truth_instances(ann).collect()}
    assert t == {1: ("chair", "1|2024-01-01|10:00#S01", "chair_origin_room"), 2: ("room", "1|2024-01-01|10:00#S02", "chair_origin_room"), 3: ("no_patient", "2|2024-01-01|10:00#S01", "direct_bed")}


def test_perfect_and_single_class_scores(spark):
    rows = [("chair", 0.9, 0.1, 0.0, 0.0), ("bed", 0.2, 0.8, 0.0, 0.0), ("chair", 0.9, 0.1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "truth string, prob_chair double, prob_bed double, prob_room double, prob_no_patient double").withColumn("derived", Q.argmax(["prob_chair", "prob_bed", "prob_room", "prob_no_patient"]))
    auc = {r.target_class: (r.roc_auc, r.pr_auc) for r in Q.auc_summary(df).collect()}
    assert auc["chair"][0] == auc["bed"][0] == 1.0 and auc["room"] == (0.0, 0.0)
    metrics = {r.metric: r.value for r in Q.classification_metrics(df).collect()}
    assert metrics["accuracy"] == 1.0 and metrics["macro_f1"] == 0.5
    assert {r.target_class: r.threshold for r in Q.operating_point(Q.threshold_sweep(df, 11)).collect()}["bed"] == pytest.approx(0.2)


def test_tag_jaccard_and_truth_choice(spark):
    truth = spark.createDataFrame([(1, "k", "bed", None, 100, None, ["a"]), (2, "k", "chair", None, 500, None, [])], "row_id long, event_key string, prefall_location string, last_furniture string, fall_seconds int, response_seconds int, tags array<string>")
    pred = spark.createDataFrame([("m", 1, "k", "chair", None, 460, []), ("m", 2, "k", "bed", None, None, ["a", "b"]), ("m", 3, "z", "bed", None, 5, [])], "model string, prediction_id long, event_key string, prefall_location string, last_furniture string, fall_seconds int, tags array<string>")
    got = {r.prediction_id: (r.match_source, r.location_match, r.tag_jaccard, r.time_error) for r in X.compare_to_truth(pred, truth).collect()}
    assert got == {1: ("nearest_fall_time", True, 1.0, 40), 2: ("earliest_truth_fallback", True, 0.5, None), 3: ("missing_truth", None, None, None)}


def plain_shift(p, label, target):
    """The greedy transfer, in plain Python."""
    target, p = min(0.95, max(0.0, target)), dict(p)
    if p[label] >= target:
        return p
    rest = target - p[label]
    for d in sorted((x for x in p if x != label), key=lambda x: -p[x]):
        give = min(rest, p[d] * (0.55 if d == "no_patient" else 0.45))
        p[d], p[label], rest = p[d] - give, p[label] + give, rest - give
        if rest <= 1e-6:
            break
    return p


@pytest.mark.parametrize("label,target", [("chair", 0.7), ("room", 0.2), ("no_patient", 0.99), ("bed", 0.05)])
def test_shift_to_a_state(spark, label, target):
    p = {"chair": 0.1, "bed": 0.3, "room": 0.2, "no_patient": 0.4}
    df = spark.createDataFrame([tuple(p.values())], "chair double, bed double, room double, no_patient double")
    got = df.select(P.shift_to(P.normalize({n: F.col(n) for n in p}), F.lit(label), F.lit(target)).alias("p")).first().p
    assert got.asDict() == pytest.approx(plain_shift(p, label, target))


def test_no_patient_target_and_regimes(spark):
    df = spark.createDataFrame([(0.1, 0.3, 0.2, 0.4)], "chair double, bed double, room double, no_patient double")
    p = P.normalize({n: F.col(n) for n in df.columns})
    prior = P.struct({"chair": F.lit(1.0), "bed": F.lit(0.0), "room": F.lit(0.0)})
    less = df.select(P.set_no_patient(p, F.lit(0.2), prior).alias("p")).first().p
    assert less.asDict() == pytest.approx({"chair": 0.1 + 0.2 * (0.6 / 6 + 0.4), "bed": 0.3 + 0.2 * 0.3, "room": 0.2 + 0.2 * 0.2, "no_patient": 0.2})
    more = df.select(P.set_no_patient(p, F.lit(0.7), prior).alias("p")).first().p
    assert more.no_patient == pytest.approx(0.7) and more.chair == pytest.approx(0.05)
    regimes = spark.createDataFrame([(0.9, 0.1, 0.1, 0.0), (0.1, 0.1, 0.6, 0.0), (0.1, 0.6, 0.1, 0.5), (0.1, 0.6, 0.1, 0.1), (0.1, 0.2, 0.2, 0.0)], "v double, t double, a double, p double")
    got = [r[0] for r in regimes.select(P.signal_regime(*[F.col(c) for c in "vtap"])).collect()]
    assert got == ["visible", "out_of_room", "present_but_sparse", "temporarily_not_visible", "unknown"]


def test_empty_probabilities_mean_nobody(spark):
    got = spark.range(1).select(P.normalize({n: F.lit(0.0) for n in ("chair", "bed", "room", "no_patient")}).alias("p")).first().p
    assert got.no_patient == 1.0 and got.chair == 0.0
