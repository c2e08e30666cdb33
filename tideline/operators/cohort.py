"""Cleaning, cohorts, eligibility and the analysis base.

Keys are site_id, division_id, monitor_id and subject_id (nullable: unknown). Null keys group and join as equals
(eqNullSafe); the dimension tables are small aggregates, and AQE decides how to join them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import DEFAULT, UNIT, Thresholds
from tideline.functions import timefn
from tideline.operators.joins import global_rank

SHARES = ["pct_chair", "pct_bed", "pct_ambulatory", "pct_not_located"]
COUNTERS = ["num_alarms", "num_nudges", "num_announcements"]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; the keys of the left side stay."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    out = left.join(other, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def anchor_events(events: DataFrame, site: int, zone: str = DEFAULT.time_zone) -> DataFrame:
    """B2: events of a site with full unit keys, their UTC stamp from the wall clock, and a deterministic id.

    The id ranks all events, by sorted partitions.
    """
    kept = events.filter((F.col("site_id") == site) & F.col("ts_local").isNotNull() & F.col("division_id").isNotNull() & F.col("monitor_id").isNotNull())
    kept = kept.withColumn("ts_utc", timefn.to_utc(F.col("ts_local"), zone))
    return global_rank(kept, ["ts_utc", "site_id", "division_id", F.col("subject_id").asc_nulls_first(), "monitor_id", "summary"], "anchor_id")


def key_dimensions(events: DataFrame) -> DataFrame:
    """Distinct unit keys."""
    return events.select(*UNIT).distinct()


def hourly_exposure(raw: DataFrame, site: int, start: str, end: str, t: Thresholds = DEFAULT) -> DataFrame:
    """Rows of a site and date range with known units whose shares add up to 1 within the tolerance."""
    typed = raw.select(
        *UNIT,
        timefn.bin_floor(F.col("hour_ts"), t.grain_s).alias("hour_ts"),
        *[F.col(c).try_cast("double").alias(c) for c in SHARES],
        *[F.col(c).try_cast("long").alias(c) for c in COUNTERS],
    )
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in SHARES), F.lit(0.0))
    in_range = (F.col("hour_ts") >= F.lit(start).cast("timestamp")) & (F.col("hour_ts") < F.lit(end).cast("timestamp"))
    known = (F.col("site_id") == site) & F.col("subject_id").isNotNull() & F.col("monitor_id").isNotNull()
    return typed.filter(known & in_range & total.between(1 - t.share_tolerance, 1 + t.share_tolerance))


def clean_events(events: DataFrame, zone: str = DEFAULT.time_zone) -> DataFrame:
    """Local time from UTC where it is missing, its provenance, one row per unit and local time, completeness of injury columns."""
    local = F.coalesce(F.col("ts_local"), timefn.to_local(F.col("ts_utc"), zone))
    source = F.when(F.col("ts_local").isNotNull(), "timestamp_local").when(local.isNotNull(), "site_timezone").otherwise("missing")
    out = events.withColumn("local_source", source).withColumn("event_ts_local", local)
    first = Window.partitionBy(*UNIT, "event_ts_local").orderBy(F.col("ts_utc").asc_nulls_last(), "event_id")
    out = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    injury = [F.col(c).isNotNull() for c in events.columns if "injury" in c.lower()]
    any_, all_ = (reduce(f, injury) if injury else F.lit(False) for f in (lambda a, b: a | b, lambda a, b: a & b))
    return out.withColumn("injury_present", any_).withColumn("injury_complete", all_)


def clean_hourly(hourly: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Shares without nulls, their sum and violations, and the calendar parts of the local hour."""
    out = hourly.withColumn("hour_ts", timefn.bin_floor(F.col("hour_ts"), t.grain_s))
    out = out.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in SHARES})
    out = out.withColumns({c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long")) for c in COUNTERS})
    out = out.withColumn("pct_sum", sum((F.col(c) for c in SHARES[1:]), F.col(SHARES[0])))
    outside = reduce(lambda a, b: a | b, [(F.col(c) < 0) | (F.col(c) > 1) for c in SHARES])
    return out.withColumns({
        "pct_bounds_violation": outside,
        "pct_sum_violation": F.abs(F.col("pct_sum") - 1) > t.share_tolerance,
        "row_valid_pct": ~(outside | (F.abs(F.col("pct_sum") - 1) > t.share_tolerance)),
        "daypart": timefn.daypart(F.hour("hour_ts")),
        "day_of_week": timefn.day_name(F.col("hour_ts")),
        "calendar_month": timefn.month_key(F.col("hour_ts")),
        "calendar_quarter": timefn.quarter_key(F.col("hour_ts")),
    })


def canonical_names(events: DataFrame) -> DataFrame:
    """Per site, division and case-folded name, the most frequent spelling (ties: the first in order) and its aliases."""
    keys = ["site_id", "division_id", "folded"]
    named = events.filter(F.trim("name") != "").withColumn("name", F.trim("name")).withColumn("folded", F.lower(F.trim("name")))
    counts = named.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "name")
    every = Window.partitionBy(*keys)
    ranked = counts.withColumn("r", F.row_number().over(best)).withColumn("aliases", F.count(F.lit(1)).over(every)).withColumn("rows", F.sum("n").over(every))
    return ranked.filter("r = 1").select(*keys, F.col("name").alias("canonical_name"), "aliases", "rows")


def derive_cohort(events: DataFrame, hourly: DataFrame) -> DataFrame:
    """Units with an event are intervention, the other units with exposure are control."""
    both = events.select("monitor_id", F.lit(1).alias("hit")).unionByName(hourly.select("monitor_id", F.lit(0).alias("hit")))
    out = both.filter("monitor_id IS NOT NULL").groupBy("monitor_id").agg(F.max("hit").alias("hit"))
    return out.select("monitor_id", F.when(F.col("hit") == 1, "intervention").otherwise("control").alias("cohort_type"))


def override_cohort(cohort: DataFrame, monitors: list[int]) -> DataFrame:
    """The listed units are intervention; those that are missing come in."""
    spark = cohort.sparkSession
    forced = spark.createDataFrame([(int(m),) for m in monitors], "forced_id long")
    out = cohort.join(forced, F.col("monitor_id") == F.col("forced_id"), "full_outer")
    return out.select(
        F.coalesce("monitor_id", "forced_id").alias("monitor_id"),
        F.when(F.col("forced_id").isNotNull(), "intervention").otherwise(F.col("cohort_type")).alias("cohort_type"),
    )


def validate_cohort(cohort: DataFrame, allowed: tuple[str, ...] = DEFAULT.allowed_cohorts) -> tuple[DataFrame, DataFrame]:
    """The cleaned map, one row per unit, and a one-row report of what was wrong."""
    blank = F.col("cohort_type").isNull() | (F.trim("cohort_type") == "")
    tidy = F.lower(F.trim("cohort_type"))
    report = cohort.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("monitor_id").isNull()).alias("null_ids"),
        F.count_if(blank).alias("blank_cohorts"),
        (F.count("monitor_id") - F.count_distinct("monitor_id")).alias("duplicate_ids"),
        F.count_if(~blank & ~tidy.isin(*allowed)).alias("disallowed"),
    )
    good = cohort.filter(F.col("monitor_id").isNotNull() & ~blank).withColumn("cohort_type", tidy).filter(F.col("cohort_type").isin(*allowed))
    one = Window.partitionBy("monitor_id").orderBy("cohort_type")
    return good.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n"), report


def attach_cohort(facts: DataFrame, cohort: DataFrame) -> DataFrame:
    """Facts with cohort_type and cohort_mapped."""
    return facts.join(cohort, "monitor_id", "left").withColumn("cohort_mapped", F.col("cohort_type").isNotNull())


def cohort_report(hourly: DataFrame, events: DataFrame) -> DataFrame:
    """Mapped rows and rates of both facts, and units that stand in more than one site or division."""

    def one(df, name):
        return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("cohort_mapped").alias("mapped_rows")).withColumn("source", F.lit(name))

    scopes = hourly.filter("monitor_id IS NOT NULL").groupBy("monitor_id").agg(F.count_distinct("site_id").alias("s"), F.count_distinct("division_id").alias("d"))
    shared = scopes.agg(F.count_if((F.col("s") > 1) | (F.col("d") > 1)).alias("units_in_two_scopes"))
    both = one(hourly, "hourly").unionByName(one(events, "events")).withColumn("mapped_rate", F.coalesce(F.try_divide("mapped_rows", "total_rows"), F.lit(1.0)))
    return both.crossJoin(shared)


def eligibility(hourly: DataFrame, min_hours: int | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Per unit, hours observed and expected, the four gates and the reasons for exclusion."""
    min_hours = t.min_hours if min_hours is None else min_hours
    keys = [*UNIT, "cohort_type"]
    span = (F.unix_seconds(F.max("hour_ts")) - F.unix_seconds(F.min("hour_ts"))) / t.grain_s
    g = hourly.groupBy(*keys).agg(
        F.count_distinct("hour_ts").alias("observed_hours"),
        F.coalesce(F.floor(span) + 1, F.lit(0)).cast("long").alias("expected_hours"),
        F.avg(F.coalesce(F.col("row_valid_pct"), F.lit(False)).cast("double")).alias("_valid"),
    )
    g = g.withColumn("_cover", F.coalesce(F.try_divide("observed_hours", "expected_hours"), F.lit(0.0)))
    gates = {
        "complete_hourly_coverage": (F.col("_cover") >= t.min_coverage, "incomplete_hourly_coverage"),
        "duration_requirement_met": (F.col("observed_hours") >= min_hours, "duration_lt_min_hours"),
        "all_rows_valid_pct": (F.col("_valid") >= t.min_valid_ratio, "invalid_pct_row"),
        "cohort_mapped": (F.col("cohort_type").isNotNull(), "unmapped_cohort"),
    }
    g = g.withColumns({k: c for k, (c, _) in gates.items()})
    reasons = F.concat_ws("|", *[F.when(~F.col(k), r) for k, (_, r) in gates.items()])
    return g.select(
        *keys, "observed_hours", F.lit(min_hours).alias("min_hours"), "expected_hours", F.round("_cover", 6).alias("coverage_ratio"),
        *[k for k in gates if k != "cohort_mapped"], F.round("_valid", 6).alias("valid_pct_ratio"),
        reduce(lambda a, b: a & b, [F.col(k) for k in gates]).alias("eligible"), reasons.alias("exclusion_reason"),
    )


def unique_unit_hour(hours: DataFrame) -> DataFrame:
    """Hours of a unit that belong to exactly one subject."""
    keys = ["site_id", "division_id", "monitor_id", "hour_ts"]
    known = hours.filter(F.col("hour_ts").isNotNull() & F.col("subject_id").isNotNull())
    g = known.groupBy(*keys).agg(F.min("subject_id").alias("subject_id"), F.count_distinct("subject_id").alias("_n"), F.min("cohort_type").alias("cohort_type"))
    return g.filter("_n = 1").drop("_n")


def link_events_to_hours(events: DataFrame, hours: DataFrame, hour: str, t: Thresholds = DEFAULT) -> DataFrame:
    """Events on the hours of their units by the given clock column; events of unknown subjects by hours with one subject."""
    keys = [*UNIT, "cohort_type", "hour_ts"]
    stamped = events.withColumn("hour_ts", timefn.bin_floor(F.col(hour), t.grain_s))
    slots = hours.select(*keys).filter("hour_ts IS NOT NULL").distinct()
    known = null_safe_join(stamped.filter("subject_id IS NOT NULL"), slots, keys)
    owner = unique_unit_hour(slots)
    found = stamped.filter("subject_id IS NULL").drop("subject_id", "cohort_type").join(owner, ["site_id", "division_id", "monitor_id", "hour_ts"])
    return known.unionByName(found.select(*known.columns))


def better_clock(events: DataFrame, hours: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Events linked by the local clock, or by UTC if that links more. Both counts are one row; nothing is collected."""
    local = link_events_to_hours(events, hours, "event_ts_local", t).withColumn("clock", F.lit("local"))
    utc = link_events_to_hours(events, hours, "ts_utc", t).withColumn("clock", F.lit("utc"))
    both = local.unionByName(utc)
    best = both.groupBy().agg((F.count_if(F.col("clock") == "utc") > F.count_if(F.col("clock") == "local")).alias("_utc"))
    return both.crossJoin(F.broadcast(best)).filter((F.col("clock") == "utc") == F.col("_utc")).drop("_utc")


def analysis_base(hourly: DataFrame, events: DataFrame, elig: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Hours of eligible units with their number of events."""
    unit = [*UNIT, "cohort_type"]
    base = null_safe_join(hourly, elig.filter("eligible").select(*unit), unit, "left_semi")
    linked = better_clock(events, base, t)
    counts = linked.groupBy(*unit, "hour_ts").agg(F.count(F.lit(1)).alias("falls_in_hour"))
    out = null_safe_join(base, counts, [*unit, "hour_ts"], "left")
    n = F.coalesce("falls_in_hour", F.lit(0).cast("long"))
    return out.withColumn("falls_in_hour", n).withColumn("fall_event_flag", F.col("falls_in_hour") > 0)


def analysis_scope(base: DataFrame, elig: DataFrame) -> DataFrame:
    """Intervention rows if an intervention unit is eligible, else all; scope names which."""
    hit = elig.groupBy().agg(F.coalesce(F.max(F.col("eligible") & (F.col("cohort_type") == "intervention")), F.lit(False)).alias("_hit"))
    out = base.crossJoin(F.broadcast(hit)).filter(~F.col("_hit") | (F.col("cohort_type") == "intervention"))
    return out.withColumn("scope", F.when(F.col("_hit"), "intervention").otherwise("all")).drop("_hit")


def eligible_anchor_events(windows: DataFrame, elig: DataFrame, scope: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Scored events of eligible units that lie on an hour of the scope, by the better clock, with its daypart."""
    unit = [*UNIT, "cohort_type"]
    linked = better_clock(windows, scope, t)
    kept = null_safe_join(linked, elig.filter("eligible").select(*unit).distinct(), unit, "left_semi")
    return kept.withColumn("daypart", timefn.daypart(F.hour("hour_ts")))


def cohort_pack(elig: DataFrame, base: DataFrame) -> DataFrame:
    """Per cohort, units, passes and failures, describe() of observed hours, exposure hours and events."""
    units = elig.groupBy("cohort_type").agg(
        F.count(F.lit(1)).alias("units"), F.count_if("eligible").alias("eligible_units"),
        F.avg("observed_hours").alias("mean_hours"), F.stddev_samp("observed_hours").alias("std_hours"),
        F.min("observed_hours").alias("min_hours"), F.percentile("observed_hours", F.lit(0.25)).alias("p25_hours"),
        F.percentile("observed_hours", F.lit(0.5)).alias("p50_hours"), F.percentile("observed_hours", F.lit(0.75)).alias("p75_hours"),
        F.max("observed_hours").alias("max_hours"),
    )
    facts = base.groupBy("cohort_type").agg(F.count(F.lit(1)).alias("base_hours"), F.sum("falls_in_hour").alias("events"), F.sum(F.col("pct_chair") + F.col("pct_bed")).alias("state_hours"))
    out = null_safe_join(units, facts, ["cohort_type"], "left")
    return out.withColumn("events_per_1000_hours", F.round(F.try_divide(1000.0 * F.col("events"), F.col("base_hours")), 6))


def exclusions(elig: DataFrame) -> DataFrame:
    """Units per exclusion reason."""
    reason = F.explode(F.split("exclusion_reason", r"\|")).alias("reason")
    return elig.filter("NOT eligible").select("cohort_type", reason).groupBy("cohort_type", "reason").agg(F.count(F.lit(1)).alias("units"))


def qa_summary(elig: DataFrame, base: DataFrame) -> DataFrame:
    """Metric, value."""
    e = elig.agg(F.count(F.lit(1)).cast("double").alias("units"), F.count_if("eligible").cast("double").alias("eligible_units"), F.avg(F.col("eligible").cast("double")).alias("eligible_rate"))
    b = base.agg(F.count(F.lit(1)).cast("double").alias("base_rows"), F.sum("falls_in_hour").cast("double").alias("events"), F.count_if("fall_event_flag").cast("double").alias("event_hours"))
    wide = e.crossJoin(b)
    return wide.unpivot([], list(wide.columns), "metric", "value")
