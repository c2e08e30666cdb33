"""The third scorer's steps keep their values in columns: Spark interprets lambdas, row by row."""

from pyspark.sql import functions as F

from tideline.config import STATES
from tideline.functions import probs as P
from tideline.operators import scorer as S
from tideline.plans.scorer_queries import tick_signals


def test_second_states_have_no_lambdas(spark):
    states = S.second_states(tick_signals(spark, "/root/testdata/sf0.001"), ["monitor_id"], 264)
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "lambda " not in plan


def test_columns_and_lambdas_keep_the_same_values(spark):
    rows = [(0.25, 0.25, 0.25, 0.25, "room", 0.9), (0.4, 0.4, 0.1, 0.1, "bed", 0.7), (0.1, 0.2, 0.3, 0.4, "chair", 0.15), (0.5, 0.3, 0.2, 0.0, None, 0.6), (0.0, 0.0, 0.0, 1.0, "no_patient", 0.5)]
    df = spark.createDataFrame(rows, ", ".join(f"{s} double" for s in STATES) + ", label string, target double").withColumn("p", P.struct({s: F.col(s) for s in STATES}))
    bound = P.Bound(df)
    made = P.shift_to(F.col("p"), F.col("label"), F.col("target"), let=bound.let)
    got = [tuple(r.made) for r in bound.df.select(made.alias("made")).collect()]
    assert got == [tuple(r.p) for r in df.select(P.shift_to(F.col("p"), F.col("label"), F.col("target")).alias("p")).collect()]
    for (*p, label, target), q in zip(rows, got, strict=True):
        left, want = dict(zip(STATES, p, strict=True)), target
        rest = want - left.get(label, 1.0)
        for n in sorted(STATES, key=lambda n: -left[n]):
            if n != label and rest > 1e-6:
                give = min(rest, left[n] * (0.55 if n == "no_patient" else 0.45))
                rest, left[n], left[label] = rest - give, left[n] - give, left[label] + give
        assert all(abs(x - y) < 1e-12 for x, y in zip(q, left.values(), strict=True))
