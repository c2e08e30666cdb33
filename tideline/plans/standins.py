"""The analysis' tables, derived from the given ones, in Spark and, for checking, in SQL.

units: users; divisions: user_id % 5; states: kinds of event; exposure bins of 33 hours; anchors: errors.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import DEFAULT
from tideline.operators import cohort as C
from tideline.sources.staging import stage

SITE = 5
#: Bins of 33 hours, so that their starts go round the clock.
BINS = replace(DEFAULT, grain_s=118_800)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(SITE).alias("site_id"), (F.col("user_id") % 5).alias("division_id"), F.col("user_id").alias("monitor_id"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("subject_id"), "event_type", "value", F.from_json("props", "k int")["k"].alias("k"),
    )


def raw_hourly(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("subject_id", F.col("monitor_id")).withColumn("hour_ts", C.timefn.bin_floor(F.col("ts"), BINS.grain_s))
    share = lambda *kinds: F.avg(F.col("event_type").isin(*kinds).cast("double"))
    return e.groupBy(*C.UNIT, "hour_ts").agg(
        share("click").alias("pct_chair"), share("view").alias("pct_bed"), share("purchase").alias("pct_ambulatory"),
        F.when(F.sum("k") % 10 != 0, share("signup", "error")).alias("pct_not_located"),
        F.count_if(F.col("event_type") == "error").alias("num_alarms"), F.count_if(F.col("k") < 30).alias("num_nudges"), F.count_if(F.col("value") > 100).alias("num_announcements"),
    )


def raw_events(spark, sf_dir) -> DataFrame:
    """Errors as anchor events, with scores: the local clock is missing in some."""
    e = events(spark, sf_dir).filter("event_type = 'error'")
    return e.select(
        "event_id", *C.UNIT, C.timefn.to_utc(F.col("ts"), DEFAULT.time_zone).alias("ts_utc"), F.when(F.col("k") % 11 != 0, F.col("ts")).alias("ts_local"),
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("summary"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("injury_grade"),
        F.concat(F.when(F.col("k") % 2 == 0, "Ward ").otherwise("WARD "), F.col("division_id").cast("string")).alias("name"),
        ((F.col("k") % 10) / 20.0).alias("pre_prob_chair"), (F.floor(F.col("k") / 10) / 20.0).alias("pre_prob_bed"),
        F.when(F.col("k") % 10 > F.floor(F.col("k") / 10), "chair").when(F.col("k") % 10 < F.floor(F.col("k") / 10), "bed").otherwise("room").alias("label"),
        F.least(F.col("value") / 60, F.lit(1.0)).alias("pre_state_visible_prob"), F.least(F.col("k") / 70.0, F.lit(1.0)).alias("pre_dropout_visibility_ratio"),
        F.when(F.col("value") < 150, F.col("value") * 2).alias("pre_dropout_last_visible_gap_seconds"),
    )


class Study:
    """The chain from raw tables to the analysis base and its eligible events. Facts that several outputs share are staged."""

    def __init__(self, spark, sf_dir):
        self.raw_events, self.raw_hourly = raw_events(spark, sf_dir), raw_hourly(spark, sf_dir)

    @cached_property
    def events(self):
        return C.clean_events(self.raw_events)

    @cached_property
    def hourly(self):
        return C.clean_hourly(self.raw_hourly, BINS)

    @cached_property
    def cohort(self):
        return C.derive_cohort(self.events, self.hourly)

    @cached_property
    def hourly_c(self):
        return stage(C.attach_cohort(self.hourly, self.cohort), "hourly")

    @cached_property
    def events_c(self):
        return stage(C.attach_cohort(self.events, self.cohort), "events")

    @cached_property
    def elig(self):
        return stage(C.eligibility(self.hourly_c, None, BINS), "eligibility")

    @cached_property
    def base(self):
        return stage(C.analysis_base(self.hourly_c, self.events_c, self.elig, BINS), "base")

    @property
    def intervention(self):
        """What the rate models see: control units are context for denominators only."""
        return self.base.filter("cohort_type = 'intervention'")

    @cached_property
    def scope(self):
        return C.analysis_scope(self.base, self.elig)

    @cached_property
    def linked(self):
        return stage(C.eligible_anchor_events(self.events_c, self.elig, self.scope, BINS), "linked")


_DAYPART = "CASE WHEN {h} <= 5 THEN 'window_00_05' WHEN {h} <= 8 THEN 'window_06_08' WHEN {h} <= 11 THEN 'window_09_11' WHEN {h} <= 14 THEN 'window_12_14' WHEN {h} <= 17 THEN 'window_15_17' WHEN {h} <= 20 THEN 'window_18_20' ELSE 'window_21_23' END"
_BIN = "make_timestamp((epoch_us({t}) // 118800000000) * 118800000000)"
_LINK = """
  SELECT e.* EXCLUDE (subject_id, cohort_type), e.subject_id, e.cohort_type, {b} AS hour_ts FROM events_c e
    JOIN slots s ON e.monitor_id = s.monitor_id AND e.division_id = s.division_id AND e.subject_id = s.subject_id AND {b} = s.hour_ts
  UNION ALL
  SELECT e.* EXCLUDE (subject_id, cohort_type), s.subject_id, s.cohort_type, s.hour_ts FROM events_c e
    JOIN slots s ON e.subject_id IS NULL AND e.monitor_id = s.monitor_id AND e.division_id = s.division_id AND {b} = s.hour_ts"""

#: Common table expressions, in order of use.
CTES = {
    "ev": "SELECT event_id, ts, 5 AS site_id, user_id % 5 AS division_id, user_id AS monitor_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS subject_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "raw_hourly": f"""SELECT 5 AS site_id, division_id, monitor_id, monitor_id AS subject_id, {_BIN.format(t='ts')} AS hour_ts,
      avg((event_type = 'click')::INT) AS pct_chair, avg((event_type = 'view')::INT) AS pct_bed, avg((event_type = 'purchase')::INT) AS pct_ambulatory,
      CASE WHEN sum(k) % 10 <> 0 THEN avg((event_type IN ('signup', 'error'))::INT) END AS pct_not_located,
      count(*) FILTER (event_type = 'error') AS num_alarms, count(*) FILTER (k < 30) AS num_nudges, count(*) FILTER (value > 100) AS num_announcements
      FROM ev GROUP BY division_id, monitor_id, hour_ts""",
    "raw_events": """SELECT event_id, site_id, division_id, monitor_id, subject_id, timezone('America/Chicago', ts)::TIMESTAMP AS ts_utc, CASE WHEN k % 11 <> 0 THEN ts END AS ts_local,
      'k' || k AS summary, CASE WHEN k % 3 <> 0 THEN k END AS injury_grade, CASE WHEN k % 2 = 0 THEN 'Ward ' ELSE 'WARD ' END || division_id AS name, (k % 10) / 20 AS pre_prob_chair, (k // 10) / 20 AS pre_prob_bed,
      CASE WHEN k % 10 > k // 10 THEN 'chair' WHEN k % 10 < k // 10 THEN 'bed' ELSE 'room' END AS label, least(value / 60, 1) AS pre_state_visible_prob, least(k / 70, 1) AS pre_dropout_visibility_ratio,
      CASE WHEN value < 150 THEN value * 2 END AS pre_dropout_last_visible_gap_seconds FROM ev WHERE event_type = 'error'""",
    "events_clean": """SELECT *, coalesce(ts_local, (timezone('America/Chicago', timezone('UTC', ts_utc)))::TIMESTAMP) AS event_ts_local,
      CASE WHEN ts_local IS NOT NULL THEN 'timestamp_local' WHEN ts_utc IS NOT NULL THEN 'site_timezone' ELSE 'missing' END AS local_source, injury_grade IS NOT NULL AS injury_present, injury_grade IS NOT NULL AS injury_complete
      FROM raw_events QUALIFY row_number() OVER (PARTITION BY site_id, division_id, monitor_id, subject_id, event_ts_local ORDER BY ts_utc, event_id) = 1""",
    "h0": "SELECT * REPLACE (coalesce(pct_not_located, 0) AS pct_not_located) FROM raw_hourly",
    "h1": "SELECT *, pct_chair + pct_bed + pct_ambulatory + pct_not_located AS pct_sum FROM h0",
    "hourly": f"""SELECT *, false AS pct_bounds_violation, abs(pct_sum - 1) > 0.02 AS pct_sum_violation, abs(pct_sum - 1) <= 0.02 AS row_valid_pct, {_DAYPART.format(h='hour(hour_ts)')} AS daypart,
      dayname(hour_ts) AS day_of_week, strftime(hour_ts, '%Y-%m') AS calendar_month, year(hour_ts) || 'Q' || quarter(hour_ts) AS calendar_quarter FROM h1""",
    "cohort": "SELECT monitor_id, CASE WHEN max(hit) = 1 THEN 'intervention' ELSE 'control' END AS cohort_type FROM (SELECT monitor_id, 1 AS hit FROM events_clean UNION ALL SELECT monitor_id, 0 FROM hourly) GROUP BY monitor_id",
    "hourly_c": "SELECT h.*, c.cohort_type FROM hourly h LEFT JOIN cohort c USING (monitor_id)",
    "events_c": "SELECT e.*, c.cohort_type FROM events_clean e LEFT JOIN cohort c USING (monitor_id)",
    "g": """SELECT site_id, division_id, monitor_id, subject_id, cohort_type, count(DISTINCT hour_ts) AS observed_hours, ((epoch_us(max(hour_ts)) - epoch_us(min(hour_ts))) // 118800000000 + 1)::BIGINT AS expected_hours, avg(row_valid_pct::INT) AS v
      FROM hourly_c GROUP BY ALL""",
    "elig": """SELECT site_id, division_id, monitor_id, subject_id, cohort_type, observed_hours, 4 AS min_hours, expected_hours, round(observed_hours / expected_hours, 6) AS coverage_ratio, observed_hours / expected_hours >= 0.95 AS complete_hourly_coverage,
      observed_hours >= 4 AS duration_requirement_met, v >= 0.6 AS all_rows_valid_pct, round(v, 6) AS valid_pct_ratio, observed_hours / expected_hours >= 0.95 AND observed_hours >= 4 AND v >= 0.6 AND cohort_type IS NOT NULL AS eligible,
      concat_ws('|', CASE WHEN observed_hours / expected_hours < 0.95 THEN 'incomplete_hourly_coverage' END, CASE WHEN observed_hours < 4 THEN 'duration_lt_min_hours' END, CASE WHEN v < 0.6 THEN 'invalid_pct_row' END) AS exclusion_reason FROM g""",
    "base_hours": "SELECT h.* FROM hourly_c h SEMI JOIN (SELECT * FROM elig WHERE eligible) e ON h.monitor_id = e.monitor_id AND h.division_id = e.division_id",
    "slots": "SELECT DISTINCT site_id, division_id, monitor_id, subject_id, cohort_type, hour_ts FROM base_hours",
    "link_local": _LINK.format(b=_BIN.format(t="e.event_ts_local")),
    "link_utc": _LINK.format(b=_BIN.format(t="e.ts_utc")),
    "link": "SELECT *, 'utc' AS clock FROM link_utc WHERE (SELECT count(*) FROM link_utc) > (SELECT count(*) FROM link_local) UNION ALL SELECT *, 'local' FROM link_local WHERE (SELECT count(*) FROM link_utc) <= (SELECT count(*) FROM link_local)",
    "base": """SELECT b.*, coalesce(n, 0) AS falls_in_hour, coalesce(n, 0) > 0 AS fall_event_flag FROM base_hours b
      LEFT JOIN (SELECT monitor_id, hour_ts, count(*) AS n FROM link GROUP BY ALL) f ON b.monitor_id = f.monitor_id AND b.hour_ts = f.hour_ts""",
    "scope": "SELECT *, CASE WHEN (SELECT bool_or(eligible AND cohort_type = 'intervention') FROM elig) THEN 'intervention' ELSE 'all' END AS scope FROM base WHERE cohort_type = 'intervention' OR NOT (SELECT bool_or(eligible AND cohort_type = 'intervention') FROM elig)",
    "linked": f"SELECT l.*, {_DAYPART.format(h='hour(l.hour_ts)')} AS daypart FROM link l SEMI JOIN (SELECT DISTINCT monitor_id, hour_ts FROM scope) s ON l.monitor_id = s.monitor_id AND l.hour_ts = s.hour_ts",
    "confident": """SELECT *, least(greatest(0.5 * coalesce(pre_state_visible_prob, 0) + 0.35 * coalesce(pre_dropout_visibility_ratio, 0)
        + 0.15 * least(greatest(1 - greatest(coalesce(pre_dropout_last_visible_gap_seconds, 360), 0) / 180, 0), 1), 0), 1) AS confidence_weight,
      CASE WHEN coalesce(pre_state_visible_prob, 0) < 0.4 OR coalesce(pre_dropout_visibility_ratio, 0) < 0.4 OR coalesce(pre_dropout_last_visible_gap_seconds, 360) > 180 THEN 'low_confidence'
        WHEN pre_state_visible_prob >= 0.7 AND pre_dropout_visibility_ratio >= 0.7 AND pre_dropout_last_visible_gap_seconds <= 90 THEN 'high_confidence' ELSE 'medium_confidence' END AS confidence_segment FROM linked""",
    "exposure": "SELECT max(scope) AS scope, sum(pct_chair) AS h_chair, sum(pct_bed) AS h_bed FROM scope",
    "states": "SELECT unnest(['chair', 'bed']) AS position",
    "treated": "SELECT * FROM base WHERE cohort_type = 'intervention'",
    "cells": """SELECT division_id, daypart, day_of_week, calendar_quarter, position, greatest(sum(CASE position WHEN 'chair' THEN pct_chair ELSE pct_bed END), 1e-6) AS exposure_hours,
      sum(falls_in_hour * CASE position WHEN 'chair' THEN pct_chair ELSE pct_bed END / greatest(pct_chair + pct_bed, 1e-9)) AS fall_count FROM treated, states GROUP BY ALL""",
}


def sql(final: str, **more: str) -> str:
    """final after the expressions of CTES and more."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in (CTES | more).items()) + "\n" + final
