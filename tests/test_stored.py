import random
import uuid

from pyspark.sql import functions as F

from tideline.operators import joins as J
from tideline.sources.tables import store_by_time


def test_stored_signals_are_joined_without_their_shuffle(spark):
    rng = random.Random(3)
    at = lambda c: F.timestamp_seconds(c)
    signals = spark.createDataFrame([(i, rng.randrange(6), rng.choice((None, 1, 2)), 1_700_000_000 + rng.randrange(90_000)) for i in range(4000)], "event_id long, unit int, subject_id int, s long").withColumn("ts", at("s"))
    anchors = spark.createDataFrame([(i, rng.randrange(7), rng.choice((None, 1)), 1_700_000_000 + rng.randrange(90_000)) for i in range(60)], "anchor_id long, unit int, subject_id int, s long").withColumn("anchor_ts", at("s"))
    name = f"stored_{uuid.uuid4().hex}"
    stored = store_by_time(signals.drop("s"), name, ["unit"], 3600, buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.stored_interval_join(anchors.drop("s"), stored, ["unit"], -7000, 500, 3600, wildcard="subject_id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.anchor_id, r.event_id) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((r.anchor_id, r.event_id) for r in J.interval_join(anchors.drop("s"), signals.drop("s"), ["unit"], -7000, 500, wildcard="subject_id").collect())
    assert got == want and len(got) > 100
    assert plan.count("Exchange hashpartitioning") == 1  # the anchors' alone
    spark.sql(f"DROP TABLE {name}")
