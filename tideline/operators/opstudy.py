"""The operational study: sessions, exposure by the minute, and which state a signal belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import STATES


def session_audit(hourly: DataFrame, clicks: DataFrame, grain_s: int, split: str, min_hours: int = 4, min_coverage: float = 0.95, min_valid: float = 0.6) -> DataFrame:
    """B128: per unit the span, coverage, valid share and clicks of its session, four gates, and pre or post the split date."""
    span = (F.unix_seconds(F.max("hour_ts")) - F.unix_seconds(F.min("hour_ts"))) / grain_s
    g = hourly.groupBy("division_id", "monitor_id").agg(F.min("hour_ts").alias("start"), F.max("hour_ts").alias("last"), F.count_distinct("hour_ts").alias("hours"), (F.floor(span) + 1).alias("expected"), F.avg(F.col("row_valid_pct").cast("double")).alias("valid_ratio"))
    n = clicks.join(g.select("monitor_id", "start", "last"), "monitor_id").filter(F.col("ts").between(F.col("start"), F.timestamp_seconds(F.unix_seconds("last") + grain_s))).groupBy("monitor_id").agg(F.count(F.lit(1)).alias("clicks"))
    out = g.join(n, "monitor_id", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0).cast("long")))
    gates = {"gate_hours": F.col("hours") >= min_hours, "gate_coverage": F.col("hours") / F.col("expected") >= min_coverage, "gate_valid": F.col("valid_ratio") >= min_valid, "gate_clicks": F.col("clicks") > 0}
    out = out.withColumns(gates).withColumn("retained", gates["gate_hours"] & gates["gate_coverage"] & gates["gate_valid"] & gates["gate_clicks"])
    return out.withColumn("period", F.when(F.col("start") < F.lit(split).cast("timestamp"), "pre").otherwise("post"))


def minute_exposure(grid: DataFrame, keys: list[str], minute_s: int) -> DataFrame:
    """B129: steps of each state per minute; grid rows are steps with a label."""
    minute = F.floor(F.col("step") / minute_s) * minute_s
    return grid.groupBy(*keys, minute.alias("minute")).agg(*[F.count_if(F.col("label") == s).alias(f"steps_{s}") for s in STATES], F.count_if(F.col("label") == "missing_posture").alias("steps_missing"))


def threshold_onsets(signals: DataFrame, keys: list[str], score: str, threshold: float, tie: str) -> DataFrame:
    """B132: rows where a score rises to the threshold; the first row counts if it is there."""
    w = Window.partitionBy(*keys).orderBy("ts", tie)
    active = F.col(score) >= threshold
    return signals.withColumn("_p", F.lag(active).over(w)).filter(active & ~F.coalesce("_p", F.lit(False))).drop("_p")


def window_majority_label(events: DataFrame, grid: DataFrame, keys: list[str], widths: tuple[int, ...], step_s: int) -> DataFrame:
    """B133: for each width, the state of most steps within it, and all states of as many in alphabetical order; ties go to the event's own step, then the nearest (earlier first), then the alphabet."""
    at = F.floor(F.unix_micros("ts") / (step_s * 1_000_000)) * step_s
    width = F.explode(F.array(*[F.lit(w) for w in widths])).alias("width")
    e = events.select("event_id", *keys, at.cast("long").alias("own"), width)
    e = e.withColumn("step", F.explode(F.sequence(F.col("own") - F.col("width") * step_s, F.col("own") + F.col("width") * step_s, F.lit(step_s).cast("long"))))
    seen = grid.select(*keys, "step", "label").filter(F.col("label").isin(*STATES))
    obs = e.join(seen, [*keys, "step"], "left")
    votes = obs.groupBy("event_id", "width", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.abs(F.col("step") - F.col("own")), F.col("step"))).alias("near"), F.max((F.col("step") == F.col("own")).cast("int")).alias("here"))
    known = F.col("label").isNotNull()
    key = F.struct(-F.col("n"), -F.col("here"), F.col("near"), F.col("label"))
    g = votes.groupBy("event_id", "width").agg(
        F.coalesce(F.min_by("label", F.when(known, key)), F.lit("missing_posture")).alias("assigned"), F.coalesce(F.max(F.when(known & (F.col("here") == 1), F.col("label"))), F.lit("missing_posture")).alias("own_label"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0).cast("long")).alias("seen_steps"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0).cast("long")).alias("missing_steps"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0).cast("long")).alias("top_votes"), F.collect_list(F.when(known, F.struct("label", "n"))).alias("_v"),
    )
    g = g.withColumn("tied_states", F.array_sort(F.transform(F.filter("_v", lambda v: v["n"] == F.col("top_votes")), lambda v: v["label"])))
    return g.withColumn("tied", F.size("tied_states").cast("long")).drop("_v")


def unresolved_labels(scoped: DataFrame) -> DataFrame:
    """B134: events without one session, with what kept them out."""
    return scoped.filter("status <> 'matched'").select("event_id", F.lit("unresolved").alias("assigned"), "status")


def operational_summary(minutes: DataFrame, labels: DataFrame, step_s: int) -> DataFrame:
    """B135: exposure hours by state, the events assigned to it by width, and the rate per 100 hours."""
    hours = minutes.agg(*[(F.sum(f"steps_{s}") * step_s / 3600.0).alias(s) for s in STATES])
    exposure = hours.unpivot([], list(hours.columns), "state", "exposure_hours")
    n = labels.groupBy("width", F.col("assigned").alias("state")).agg(F.count(F.lit(1)).alias("events"))
    widths = labels.select("width").distinct()
    grid = exposure.crossJoin(F.broadcast(widths))
    out = grid.join(n, ["state", "width"], "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long")))
    return out.withColumn("rate_per_100_hours", F.round(F.try_divide(100.0 * F.col("events"), F.col("exposure_hours")), 6))


def operational_study(minutes: DataFrame, labels: DataFrame, active: DataFrame, step_s: int) -> DataFrame:
    """B135 in full: by metric, width and state, the events of the state, those excluded (other states, missing, unresolved) and their rate per 100 exposure hours; and the active seconds of the state per exposure hour.

    labels: metric, width, status (resolved or not) and assigned; active: state (null where missing) and seconds. Totals
    and exposure are a few rows, so every pair of them is a row of the result.
    """
    hours = minutes.agg(*[(F.sum(f"steps_{s}") * step_s / 3600.0).alias(s) for s in STATES])
    exposure = F.broadcast(hours.unpivot([], list(hours.columns), "state", "exposure_hours"))
    resolved = F.col("status") == "resolved"
    counts = {s: F.count_if(resolved & (F.col("assigned") == s)).cast("double") for s in STATES}
    events = labels.groupBy("metric", "width").agg(F.count(F.lit(1)).cast("double").alias("source_value"), F.count_if(~resolved).alias("excluded_unresolved"), F.count_if(resolved & (F.col("assigned") == "missing_posture")).cast("double").alias("excluded_missing"), *[c.alias(f"_{s}") for s, c in counts.items()])
    zero = F.lit(0.0)
    seconds = active.agg(
        F.lit("nudge_active_seconds").alias("metric"), F.lit(None).cast("int").alias("width"), F.coalesce(F.sum("seconds"), zero).alias("source_value"), F.lit(0).cast("long").alias("excluded_unresolved"),
        F.coalesce(F.sum(F.when(F.col("state").isNull(), F.col("seconds"))), zero).alias("excluded_missing"), *[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("seconds"))), zero).alias(f"_{s}") for s in STATES],
    )

    def by_state(totals):
        own = F.coalesce(*[F.when(F.col("state") == s, F.col(f"_{s}")) for s in STATES])
        every = sum((F.col(f"_{s}") for s in STATES), zero)
        return totals.crossJoin(exposure).withColumn("numerator", own).withColumn("excluded_other", every - own).drop(*[f"_{s}" for s in STATES])

    rate = F.try_divide("numerator", "exposure_hours")
    none = F.lit(None).cast("double")
    first = by_state(events).withColumn("rate_per_100_hours", 100.0 * rate).withColumn("active_seconds_per_hour", none)
    return first.unionByName(by_state(seconds).withColumn("rate_per_100_hours", none).withColumn("active_seconds_per_hour", rate))
