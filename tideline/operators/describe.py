"""Descriptive tables over events, windows and sources."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import timefn


def counts_by(events: DataFrame, column, order=None) -> DataFrame:
    """Events by a calendar column, with its place in the fixed order."""
    g = events.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", timefn.order_of(order, F.col("value"))) if order else g


def event_counts(events: DataFrame, ts: str) -> DataFrame:
    """Counts by site, weekday, daypart, month and month of year, stacked: one pass over grouping sets."""
    t = events.select(
        F.col("site_id").cast("string").alias("site"), timefn.day_name(F.col(ts)).alias("weekday"), timefn.daypart(F.hour(ts)).alias("daypart"),
        timefn.month_key(F.col(ts)).alias("month"), F.coalesce(F.date_format(ts, "MMMM"), F.lit("unknown")).alias("month_of_year"),
    )
    dims = t.columns
    g = t.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    name = reduce(lambda acc, d: F.when(F.col(f"_{d}") == 0, d).otherwise(acc), dims, F.lit(None))
    return g.select(name.alias("dimension"), F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dims]).alias("value"), "n")


def label_summary(windows: DataFrame) -> DataFrame:
    """Count, share and median margin by label."""
    g = windows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile("margin", F.lit(0.5)).alias("median_margin"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def expected_by_label(windows: DataFrame) -> DataFrame:
    """Summed probabilities by state."""
    g = windows.agg(*[F.sum(f"prob_{s}").alias(s) for s in ("chair", "bed", "room", "no_patient")])
    return g.unpivot([], list(g.columns), "label", "expected")


def probability_breakdown(windows: DataFrame, dims: list[str]) -> DataFrame:
    """Expected, mean and median probability of each state by each dimension."""
    states = ("chair", "bed", "room", "no_patient")
    long = windows.select(*[F.col(d).cast("string").alias(d) for d in dims], F.explode(F.array(*[F.struct(F.lit(s).alias("label"), F.col(f"prob_{s}").alias("p")) for s in states])).alias("x")).select(*dims, "x.*")
    tall = long.unpivot(["label", "p"], dims, "dimension", "value")
    return tall.groupBy("dimension", "value", "label").agg(F.sum("p").alias("expected"), F.avg("p").alias("mean"), F.percentile("p", F.lit(0.5)).alias("median"))


def response_summary(windows: DataFrame) -> DataFrame:
    """Response rate and latency quantiles."""
    q = F.percentile("response_latency_seconds", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    g = windows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("response_detected").cast("double")).alias("response_rate"), q.alias("q"))
    return g.select("n", "response_rate", *[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((50, 75, 90))])


def subject_day_hour(events: DataFrame, ts: str, label: str = "label") -> DataFrame:
    """Events of a subject by local date, hour and state, and their share of the subject's hour. Unknown keys are keys too."""
    keys = ["subject_id", "date", "hour"]
    g = events.groupBy("subject_id", F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("bucket_total", F.sum("n").over(Window.partitionBy(*keys)))
    return g.withColumn("pct_in_bucket", F.round(F.col("n") / F.col("bucket_total"), 4))


def circular_kde(events: DataFrame, hour, weight, by: str, bandwidth: float = 1.35) -> DataFrame:
    """Gaussian density at 24 hour centres that wraps round midnight, over the total weight; 0 without any. Only positive weights have a kernel.

    Equal hours are summed first, so the 72 kernels meet distinct hours only.
    """
    g = events.groupBy(F.col(by), hour.cast("double").alias("h")).agg(F.sum(F.greatest(weight, F.lit(0.0))).alias("w"), F.sum(weight).alias("t"))
    x = g.select(by, "h", "w", "t", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("centre"))
    kernel = reduce(lambda a, b: a + b, [F.exp(-0.5 * ((F.col("h") + s - F.col("centre")) / bandwidth) ** 2) for s in (-24, 0, 24)])
    d = x.groupBy(by, "centre").agg(F.sum(F.col("w") * kernel).alias("mass"), F.sum("t").alias("t"))
    return d.select(by, "centre", F.when(F.col("t") > 0, F.col("mass") / (F.col("t") * bandwidth * math.sqrt(2 * math.pi))).otherwise(0.0).alias("density"))


def weekday_daypart_matrix(events: DataFrame, ts: str) -> DataFrame:
    """Weekdays by dayparts."""
    d = events.select(timefn.day_name(F.col(ts)).alias("weekday"), timefn.daypart(F.hour(ts)).alias("daypart"))
    return d.groupBy("weekday").pivot("daypart", [x[0] for x in timefn.DAYPARTS]).count().na.fill(0)


def pareto(events: DataFrame, key: str, top: int = 8) -> DataFrame:
    """The top keys by events and their cumulative share of all events."""
    g = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    best = g.orderBy(F.col("n").desc(), key).limit(top)
    run = Window.orderBy(F.col("n").desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    return best.crossJoin(F.broadcast(total)).withColumn("cumulative_share", F.sum("n").over(run) / F.col("total")).drop("total")


def source_profile(df: DataFrame, keys: list[str], ts: str, name: str) -> DataFrame:
    """Rows, nulls and distinct values of each key, and the time range, in one pass."""
    g = df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *[f for k in keys for f in (F.count_if(F.col(k).isNull()).alias(f"{k}_nulls"), F.count_distinct(k).alias(f"{k}_distinct"))])
    return g.withColumn("source", F.lit(name))


def chunk_profile(chunks: DataFrame, events: DataFrame, expected_start: str, exact_s: int) -> DataFrame:
    """History status, chunks of exact length, and units that have events too."""
    units = events.select("monitor_id").distinct().withColumn("_hit", F.lit(True))
    g = chunks.join(units, "monitor_id", "left").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("duration_seconds") == exact_s).alias("exact_chunks"), F.min("chunk_start").alias("history_start"),
        F.count_distinct("monitor_id").alias("units"), F.count_distinct(F.when(F.col("_hit"), F.col("monitor_id"))).alias("units_with_events"),
    )
    partial = F.to_date("history_start") > F.lit(expected_start).cast("date")
    return g.withColumn("history_status", F.when(F.col("chunks") == 0, "missing").when(partial, "partial_history").otherwise("full_history"))


def compare_runs(base: DataFrame, candidate: DataFrame, abs_limit: float, rel_limit: float) -> DataFrame:
    """Metric by metric, the change and whether it is major: over both limits, or on one side only."""
    j = base.withColumnRenamed("value", "base").join(candidate.withColumnRenamed("value", "candidate"), "metric", "full_outer")
    delta = F.col("candidate") - F.col("base")
    rel = F.try_divide(F.abs(delta), F.abs("base"))
    major = F.col("base").isNull() | F.col("candidate").isNull() | ((F.abs(delta) > abs_limit) & (F.coalesce(rel, F.lit(1.0)) > rel_limit))
    return j.withColumn("delta", delta).withColumn("relative", rel).withColumn("major", major)
