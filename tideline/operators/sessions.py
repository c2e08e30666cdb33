"""Sessions, runs and dense grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import timefn


def gap_sessions(signals: DataFrame, keys: list[str], gap_s: int, zone: str, lead_s: int = 1) -> DataFrame:
    """Chunks of a unit's signals with no gap over gap_s; rows of one time stay together. The anchor is lead_s after the end."""
    order = Window.partitionBy(*keys).orderBy("ts")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    marked = signals.withColumn("_new", F.when(gap.isNull() | (gap > gap_s * 1_000_000), 1).otherwise(0)).withColumn("_n", F.sum("_new").over(order))
    g = marked.groupBy(*keys, F.col("_n").alias("chunk")).agg(F.min("ts").alias("chunk_start"), F.max("ts").alias("chunk_end"), F.count(F.lit(1)).alias("frame_count"))
    anchor = F.timestamp_micros(F.unix_micros("chunk_end") + lead_s * 1_000_000)
    g = g.withColumn("anchor_ts", anchor).withColumn("duration_seconds", timefn.seconds_between(F.col("chunk_end"), F.col("chunk_start")))
    hour = F.hour(timefn.to_local(F.col("anchor_ts"), zone))
    return g.withColumn("anchor_hour", hour).withColumn("anchor_daypart", timefn.daypart(hour))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: run number, first and last order value, length. Nulls form runs of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    runs = df.withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"), F.count(F.lit(1)).alias("run_length"))


def dense_grid(hours: DataFrame, signals: DataFrame, keys: list[str], grain_s: int, step_s: int) -> DataFrame:
    """Every step of each owned hour with the least distances of its signals and a label; steps without a signal are missing_posture."""
    step = F.floor(F.unix_micros("ts") / (step_s * 1_000_000)) * step_s
    near = signals.withColumn("step", step).groupBy(*keys, "step").agg(*[F.min(f"d_{s}").alias(f"d_{s}") for s in ("chair", "bed", "room")], F.count(F.lit(1)).alias("frames"))
    start = F.floor(F.unix_micros("hour_ts") / 1_000_000)
    steps = F.explode(F.sequence(start, start + grain_s - step_s, F.lit(step_s).cast("long"))).alias("_s")
    grid = hours.select(*keys, "hour_ts", steps).select(*keys, "hour_ts", (F.floor(F.col("_s") / step_s) * step_s).alias("step")).distinct()
    from tideline.operators.windows import dominant_state

    out = grid.join(near, [*keys, "step"], "left")
    label = F.when(F.col("frames").isNull(), "missing_posture").otherwise(dominant_state("d_chair", "d_bed", "d_room"))
    return out.withColumn("label", label)
