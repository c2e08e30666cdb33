"""Tasks stay of one size as the input grows, and predictions with one id stay apart."""

from pyspark.sql import functions as F

from tideline.operators import compare as X
from tideline.operators.joins import spread


def test_a_task_holds_no_more_rows_when_there_are_more(spark):
    """All rows alike pack into few bytes, by which AQE would merge their partitions."""
    for n in (20_000, 80_000):
        df = spread(spark.range(n).select((F.col("id") % 1000).alias("key"), F.lit("x" * 50).alias("text")), "key", rows=2_000)
        parts = df.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(r["n"] for r in parts) == n and len(parts) >= n // 4_000 and max(r["n"] for r in parts) <= 6_000


def test_predictions_of_one_id_keep_their_rows(spark):
    tags = F.array(F.lit("slip"))
    truth = spark.createDataFrame([("a", 1, "bed", "bed", 100, 110), ("a", 2, "chair", "bed", 300, 310)], "event_key string, row_id long, prefall_location string, last_furniture string, fall_seconds int, response_seconds int").withColumn("tags", tags)
    pred = spark.createDataFrame([("m", 7, "a", "bed", "bed", 290), ("m", 7, "a", "bed", "bed", 90), ("m", 8, None, "bed", "bed", 5)], "model string, prediction_id long, event_key string, prefall_location string, last_furniture string, fall_seconds int").withColumn("tags", tags)
    rows = {(r["prediction_id"], r["fall_seconds"]): (r["truth_rows"], r["match_source"], r["t"] and r["t"]["row_id"]) for r in X.compare_to_truth(pred, truth).collect()}
    assert rows == {(7, 290): (2, "nearest_fall_time", 2), (7, 90): (2, "nearest_fall_time", 1), (8, 5): (0, "missing_truth", None)}
