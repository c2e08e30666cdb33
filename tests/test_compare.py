import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tideline.operators import compare as X
from tideline.operators import evaluate as E


def test_file_names_become_keys(spark):
    names = {"854_2022-12-23_11-07.mp4": "854|2022-12-23|11:07", "a/b/854_2022-12-23_11-07": "854|2022-12-23|11:07", "854_2022-12-23_11-07.mp4.part": None, "clip_854_2022-12-23_11-07": None, "": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "file string").select("file", X.file_event_key(F.col("file")).alias("key"))
    assert {r.file: r.key for r in df.collect()} == names
    with pytest.raises(SparkRuntimeException):
        X.load_predictions(spark.createDataFrame([("x.mp4", "yes", "")], "file string, fall_detected string, fall_tags string")).collect()


def test_loose_booleans_numbers_and_clocks(spark):
    said = {"True": True, " YES ": True, "1": True, "maybe": True, "0": False, "no": False, "": False, None: False}
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert {r.s: r.b for r in df.select("s", X.as_bool(F.col("s")).alias("b")).collect()} == said
    numbers = {"1.5": 1.5, "-2": -2.0, "n/a": None, "nan": None, "": None}
    df = spark.createDataFrame([(s,) for s in numbers], "s string")
    assert {r.s: r.n for r in df.select("s", X.as_number(F.col("s")).alias("n")).collect()} == numbers
    df = spark.createDataFrame([("1|2024-01-01|23:10", 30), ("1|2024-01-01|00:10", 700), ("odd", 3), ("1|2024-01-01|x", 3)], "k string, s int")
    assert [r.d for r in df.select(X.relative_seconds(F.col("k"), F.col("s")).alias("d")).collect()] == [3630.0, 700.0, None, None]


def test_coverage_and_failures(spark):
    truth = spark.createDataFrame([("a", "included_fall"), ("a", "accepted_nonfall"), ("b", "included_fall"), ("c", "excluded_offscreen")], "event_key string, status string")
    found = spark.createDataFrame([("m1", "a", 1), ("m1", "b", 2), ("m2", "a", 3)], "model string, event_key string, prediction_id long")
    records = spark.createDataFrame([("f", "c", "m1", "error", "timeout"), ("g", "b", "m2", "error", "quota"), ("h", None, "m2", "error", "name")], "file string, event_key string, model string, record_status string, error string")
    got = {(r.model, r.scope): (r.total, r.successful, r.failed, r.missing, r.overlap) for r in X.model_coverage(truth, found, records, ["m1", "m2"]).collect()}
    assert got[("m1", "all")] == (3, 2, 1, 1, 1) and got[("m2", "all")] == (3, 1, 1, 2, 1) and got[("m2", "accepted_nonfall")] == (1, 1, 0, 0, 1)
    assert [tuple(r) for r in X.failure_table(truth, records, found).collect()] == [("c", "excluded_offscreen", "f", "m1", "timeout")]
    long = {(r.model, r.event_key): (r.status, r.in_overlap, r.visible_primary, r.diagnostic_only) for r in X.event_long(truth, found).collect()}
    assert long == {("m1", "a"): ("accepted_nonfall", True, True, False), ("m2", "a"): ("accepted_nonfall", True, True, False), ("m1", "b"): ("included_fall", False, True, False)}


def test_status_selects_the_last_candidate_that_passes(spark):
    rows = [("legacy", 0.50, 0.5, 0.5, 0.4, 0.5), ("v2", 0.56, 0.6, 0.48, 0.5, 0.5), ("v3", 0.58, 0.6, 0.40, 0.5, 0.6)]
    df = spark.createDataFrame([("departure_aware", *r) for r in rows], "split string, model string, macro_f1 double, f1_chair double, f1_bed double, f1_room double, f1_no_patient double")
    status = E.benchmark_status(df, ("legacy", "v2", "v3")).collect()
    assert {r.selected_model for r in status} == {"v2"}  # v3 loses 0.10 of the bed's F1
    failed = {(r.model, r.kind, r.check) for r in status if not r.passed}
    assert failed == {("v3", "check", "bed_f1_drop"), ("v3", "selection", "bed_f1_drop")}
    assert E.benchmark_status(df.filter("model <> 'legacy'"), ("legacy", "v2", "v3")).count() == 0


def test_metrics_by_key_are_those_of_each_key_alone(spark):
    import random

    from tideline.config import STATES
    from tideline.operators import quality as Q

    rng, rows = random.Random(6), []
    for i in range(240):
        p = [rng.random() for _ in STATES]
        rows.append(("abc"[i % 3], rng.choice(STATES), STATES[p.index(max(p))], *[x / sum(p) for x in p]))
    df = spark.createDataFrame(rows, "model string, truth string, derived string, " + ", ".join(f"prob_{s} double" for s in STATES))
    wide = E.measures(df, ["model"])
    got = {(r.model, r.metric): r.value for r in E.metrics(wide, ["model"]).unionByName(E.areas(df, ["model"])).collect()}
    one = df.filter("model = 'b'").drop("model")
    want = {r.metric: r.value for r in Q.classification_metrics(one).unionByName(Q.probability_quality(one)).collect()}
    assert {m: got[("b", m)] for m in want} == pytest.approx(want, abs=2e-6)
    areas = Q.auc_summary(one).agg(F.avg("roc_auc")).first()[0]
    assert got[("b", "macro_roc_auc")] == pytest.approx(areas)
    cells = {(r.truth, r.derived): r.n for r in E.confusion(wide.filter("model = 'b'"), ["model"]).collect()}
    assert cells == {(r.truth, r.derived): r.n for r in Q.confusion_matrix(one).collect()}
