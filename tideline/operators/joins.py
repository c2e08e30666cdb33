"""Joins on time: a range becomes an equality on time buckets, so that one busy unit doesn't meet itself whole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.timefn import seconds_between
from tideline.sources.staging import stage


def _bucket(ts, width: int):
    return F.floor(F.unix_micros(ts) / (width * 1_000_000))


def interval_join(anchors: DataFrame, signals: DataFrame, keys: list[str], lo_s: int, hi_s: int, at: str = "anchor_ts", ts: str = "ts", wildcard: str | None = None, how: str = "inner") -> DataFrame:
    """Signals of an anchor's unit from lo_s to hi_s seconds around it, both ends included.

    An anchor goes to the few buckets that its range touches; a signal to its own. wildcard: a key that matches if the
    anchor's is null. Columns of signals that anchors have too, but for the keys, get the suffix _signal.
    """
    width = max(1, hi_s - lo_s)
    micros = lambda s: F.timestamp_micros(F.unix_micros(at) + s * 1_000_000)
    left = anchors.withColumn("_b", F.explode(F.sequence(_bucket(micros(lo_s), width), _bucket(micros(hi_s), width))))
    named = {c: f"{c}_signal" if c in anchors.columns and c not in keys else c for c in signals.columns}
    right = signals.withColumnsRenamed({k: v for k, v in named.items() if k != v} | {k: f"_k_{k}" for k in keys}).withColumn("_c", _bucket(F.col(named[ts]), width))
    cond = (F.col("_b") == F.col("_c")) & (F.unix_micros(named[ts]) - F.unix_micros(at)).between(lo_s * 1_000_000, hi_s * 1_000_000)
    for k in keys:
        cond &= left[k] == F.col(f"_k_{k}")
    if wildcard:
        cond &= F.col(wildcard).isNull() | (F.col(wildcard) == F.col(named.get(wildcard, wildcard)))
    out = left.join(right, cond, "inner").drop("_b", "_c", *[f"_k_{k}" for k in keys])
    if how == "left":
        ids = anchors.columns
        hit = out.select("anchor_id").distinct()
        rest = anchors.join(hit, "anchor_id", "left_anti")
        return out.unionByName(rest.select(*ids), allowMissingColumns=True)
    return out


def stored_interval_join(anchors: DataFrame, stored: DataFrame, keys: list[str], lo_s: int, hi_s: int, width_s: int, at: str = "anchor_ts", ts: str = "ts", wildcard: str | None = None) -> DataFrame:
    """A24 on a table of sources.tables.store_by_time: the same pairs as interval_join's; only the anchors are shuffled, to the table's buckets.

    An anchor goes to every bucket of width_s seconds that its range touches.
    """
    micros = lambda s: F.timestamp_micros(F.unix_micros(at) + s * 1_000_000)
    left = anchors.withColumn("time_bucket", F.explode(F.sequence(_bucket(micros(lo_s), width_s), _bucket(micros(hi_s), width_s))))
    shared = {c: f"{c}_signal" for c in stored.columns if c in anchors.columns and c not in keys}
    out = left.join(stored.withColumnsRenamed(shared), [*keys, "time_bucket"])
    out = out.filter((F.unix_micros(shared.get(ts, ts)) - F.unix_micros(at)).between(lo_s * 1_000_000, hi_s * 1_000_000))
    if wildcard:
        out = out.filter(F.col(wildcard).isNull() | (F.col(wildcard) == F.col(shared.get(wildcard, wildcard))))
    return out.drop("time_bucket")


def nearest(anchors: DataFrame, records: DataFrame, keys: list[str], tolerance_s: int, value: str, at: str = "anchor_ts", ts: str = "ts") -> DataFrame:
    """Per anchor, the value of the record nearest in time on either side, within the tolerance; ties by smaller value."""
    found = interval_join(anchors.select("anchor_id", *keys, at), records.filter(F.col(value).isNotNull()).select(*keys, ts, value), keys, -tolerance_s, tolerance_s, at, ts)
    gap = F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(F.col(at)))
    return found.groupBy("anchor_id").agg(F.min_by(value, F.struct(gap, F.col(value))).alias(value))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width_s: int) -> DataFrame:
    """Pairs of half-open spans (start, end) and (start_r, end_r) of one unit that overlap, with the common part."""
    micros = lambda c: F.unix_micros(c)
    span = lambda s, e: F.sequence(_bucket(F.col(s), width_s), F.floor((micros(F.col(e)) - 1) / (width_s * 1_000_000)))
    a = left.filter("start < end").withColumn("_b", F.explode(span("start", "end")))
    b = right.filter("start_r < end_r").withColumn("_c", F.explode(span("start_r", "end_r"))).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    first = F.greatest(_bucket(F.col("start"), width_s), _bucket(F.col("start_r"), width_s))
    cond = (F.col("_b") == F.col("_c")) & (F.col("start") < F.col("end_r")) & (F.col("start_r") < F.col("end")) & (F.col("_b") == first)
    for k in keys:
        cond &= a[k] == F.col(f"_k_{k}")
    out = a.join(b, cond).drop("_b", "_c", *[f"_k_{k}" for k in keys])
    return out.withColumn("common_start", F.greatest("start", "start_r")).withColumn("common_end", F.least("end", "end_r"))


def union_seconds(spans: DataFrame, keys: list[str]) -> DataFrame:
    """A27, B130: whole seconds that at least one of a unit's spans covers, by merging spans rather than listing seconds."""
    s = spans.select(*keys, F.floor(F.unix_micros("start") / 1_000_000).alias("a"), F.ceil(F.unix_micros("end") / 1_000_000).alias("z")).filter("a < z")
    order = Window.partitionBy(*keys).orderBy("a", "z")
    before = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_p").isNull() | (F.col("a") > F.col("_p")), 1).otherwise(0)).over(order)
    g = s.withColumn("_p", before).withColumn("_i", island).groupBy(*keys, "_i").agg((F.max("z") - F.min("a")).alias("seconds"))
    return g.groupBy(*keys).agg(F.sum("seconds").alias("active_seconds"))


def resolve_subject(anchors: DataFrame, signals: DataFrame, hourly: DataFrame, keys: list[str], tol_s: int, tol_hourly_s: int) -> DataFrame:
    """B1: the subject of the nearest signal, else of the nearest exposure hour."""
    near = nearest(anchors, signals, keys, tol_s, "subject_id").withColumnRenamed("subject_id", "by_signal")
    hour = nearest(anchors, hourly, keys, tol_hourly_s, "subject_id", ts="hour_ts").withColumnRenamed("subject_id", "by_hour")
    out = anchors.drop("subject_id").join(near, "anchor_id", "left").join(hour, "anchor_id", "left")
    source = F.when(F.col("by_signal").isNotNull(), "signal").when(F.col("by_hour").isNotNull(), "hourly")
    return out.withColumn("subject_id", F.coalesce("by_signal", "by_hour")).withColumn("subject_source", source).drop("by_signal", "by_hour")


def point_in_session(points: DataFrame, sessions: DataFrame, keys: list[str], width_s: int) -> DataFrame:
    """A25, B131: points in the sessions of their unit; how many match, and the earliest of them."""
    span = F.sequence(_bucket(F.col("start"), width_s), _bucket(F.col("end"), width_s))
    s = sessions.withColumn("_c", F.explode(span)).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    p = points.withColumn("_b", _bucket(F.col("ts"), width_s))
    cond = (F.col("_b") == F.col("_c")) & F.col("ts").between(F.col("start"), F.col("end"))
    for k in keys:
        cond &= p[k] == F.col(f"_k_{k}")
    hit = p.join(s, cond, "left").groupBy("event_id").agg(F.count("session_id").alias("sessions"), F.min_by("session_id", F.struct("start", "session_id")).alias("session_id"))
    status = F.when(F.col("sessions") == 0, "unmatched").when(F.col("sessions") == 1, "matched").otherwise("ambiguous")
    return points.join(hit, "event_id").withColumn("status", status)


def latency_seconds(later: str, earlier: str):
    return seconds_between(F.col(later), F.col(earlier))


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with its place (from 1) in a total order, without one task for all rows: partitions by range are sorted, and each adds the rows of those before it."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row a partition
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(sizes.drop("_n")), "_part").withColumn(out, row + F.col("_before")).drop("_part", "_at", "_before")


#: Rows that one task sorts or joins at a time.
TASK_ROWS = 500_000


def spread(df: DataFrame, *keys, counted: DataFrame | None = None, rows: int = TASK_ROWS, least: int | None = None) -> DataFrame:
    """df dealt by keys over as many tasks as its rows need, so that a task holds no more as the input grows.

    By bytes AQE makes tasks too large where shuffled rows repeat each other: they pack well and are sorted unpacked. counted
    is a frame of about as many rows, by default df; a staged one costs only its footers. least: the fewest tasks, by default
    the session's shuffle partitions, as with fewer a join would deal both sides anew.
    """
    n = math.ceil((df if counted is None else counted).count() / rows)
    return df.repartition(max(n, least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
