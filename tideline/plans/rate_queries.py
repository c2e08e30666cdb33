"""Queries over cohorts, the analysis base and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import cohort as C
from tideline.operators import rates as R
from tideline.plans.standins import BINS, SITE, Study, raw_events, raw_hourly, sql

KEYS = "site_id, division_id, monitor_id, subject_id"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


@query("b2_anchor_events", sql(f"SELECT event_id, {KEYS}, timezone('America/Chicago', ts_local)::TIMESTAMP AS ts_utc, row_number() OVER (ORDER BY timezone('America/Chicago', ts_local), site_id, division_id, subject_id NULLS FIRST, monitor_id, summary) AS anchor_id FROM raw_events WHERE ts_local IS NOT NULL"))
def b2(spark, d):
    return C.anchor_events(raw_events(spark, d), SITE).select("event_id", *C.UNIT, "ts_utc", "anchor_id")


@query("b3_key_dimensions", sql(f"SELECT DISTINCT {KEYS} FROM raw_events"))
def b3(spark, d):
    return C.key_dimensions(raw_events(spark, d))


@query("b4_hourly_exposure", sql(f"SELECT {KEYS}, hour_ts, pct_chair, pct_bed, num_alarms FROM raw_hourly WHERE hour_ts >= '2024-01-05' AND hour_ts < '2024-01-25' AND pct_chair + pct_bed + pct_ambulatory + coalesce(pct_not_located, 0) BETWEEN 0.98 AND 1.02"))
def b4(spark, d):
    return C.hourly_exposure(raw_hourly(spark, d), SITE, "2024-01-05", "2024-01-25", BINS).select(*C.UNIT, "hour_ts", "pct_chair", "pct_bed", "num_alarms")


@query("b6_clean_events", sql(f"SELECT event_id, {KEYS}, ts_utc, event_ts_local, local_source, injury_present, injury_complete FROM events_clean"))
def b6(spark, d):
    return C.clean_events(raw_events(spark, d)).select("event_id", *C.UNIT, "ts_utc", "event_ts_local", "local_source", "injury_present", "injury_complete")


@query("b7_clean_hourly", sql(f"SELECT {KEYS}, hour_ts, round(pct_sum, 6) AS pct_sum, pct_sum_violation, row_valid_pct, daypart, day_of_week, calendar_month, calendar_quarter FROM hourly"))
def b7(spark, d):
    return C.clean_hourly(raw_hourly(spark, d), BINS).select(*C.UNIT, "hour_ts", F.round("pct_sum", 6).alias("pct_sum"), "pct_sum_violation", "row_valid_pct", "daypart", "day_of_week", "calendar_month", "calendar_quarter")


@query("b8_daypart", sql("SELECT daypart, count(*) AS n FROM hourly GROUP BY daypart"))
def b8(spark, d):
    return C.clean_hourly(raw_hourly(spark, d), BINS).groupBy("daypart").agg(F.count(F.lit(1)).alias("n"))


@query("b9_canonical_names", sql("""SELECT site_id, division_id, folded, arg_max(name, (n, -ascii(substr(name, 2, 1)))) AS canonical_name, count(*) AS aliases, sum(n)::BIGINT AS rows
  FROM (SELECT site_id, division_id, lower(name) AS folded, name, count(*) AS n FROM raw_events GROUP BY ALL) GROUP BY ALL"""))  # fmt: skip
def b9(spark, d):
    return C.canonical_names(raw_events(spark, d))


@query("b10_derive_cohort", sql("SELECT * FROM cohort"))
def b10(spark, d):
    return Study(spark, d).cohort


@query("b11_override_cohort", sql("SELECT coalesce(monitor_id, f) AS monitor_id, CASE WHEN f IS NOT NULL THEN 'intervention' ELSE cohort_type END AS cohort_type FROM cohort FULL JOIN (SELECT unnest([3, 2834])::BIGINT AS f) ON monitor_id = f"))
def b11(spark, d):
    return C.override_cohort(Study(spark, d).cohort, [3, 2834])


_DIRTY = "SELECT CASE WHEN k % 13 <> 0 THEN monitor_id END AS monitor_id, CASE k % 5 WHEN 0 THEN ' Control ' WHEN 1 THEN 'intervention' WHEN 2 THEN '' WHEN 3 THEN 'other' ELSE 'OBSERVATIONAL' END AS cohort_type FROM ev"


def _dirty(spark, d):
    from tideline.plans.standins import events

    k = F.col("k") % 5
    kind = F.when(k == 0, " Control ").when(k == 1, "intervention").when(k == 2, "").when(k == 3, "other").otherwise("OBSERVATIONAL")
    return events(spark, d).select(F.when(F.col("k") % 13 != 0, F.col("monitor_id")).alias("monitor_id"), kind.alias("cohort_type"))


@query("b12_validate_cohort", sql("SELECT monitor_id, min(lower(trim(cohort_type))) AS cohort_type FROM dirty WHERE monitor_id IS NOT NULL AND lower(trim(cohort_type)) IN ('control', 'intervention', 'observational') GROUP BY monitor_id", dirty=_DIRTY))
def b12(spark, d):
    return C.validate_cohort(_dirty(spark, d))[0]


@query("b12_cohort_report", sql("""SELECT count(*) AS rows, count(*) FILTER (monitor_id IS NULL) AS null_ids, count(*) FILTER (trim(cohort_type) = '') AS blank_cohorts, count(monitor_id) - count(DISTINCT monitor_id) AS duplicate_ids,
  count(*) FILTER (trim(cohort_type) = 'other') AS disallowed FROM dirty""", dirty=_DIRTY))  # fmt: skip
def b12_report(spark, d):
    return C.validate_cohort(_dirty(spark, d))[1]


@query("b13_cohort_report", sql("SELECT 'hourly' AS source, count(*) AS total_rows, count(cohort_type) AS mapped_rows, count(cohort_type) / count(*) AS mapped_rate, 0::BIGINT AS units_in_two_scopes FROM hourly_c UNION ALL SELECT 'events', count(*), count(cohort_type), count(cohort_type) / count(*), 0 FROM events_c"))
def b13(spark, d):
    s = Study(spark, d)
    return C.cohort_report(s.hourly_c, s.events_c)


@query("b14_eligibility", sql("SELECT * FROM elig"))
def b14(spark, d):
    return Study(spark, d).elig


@query("b15_unique_unit_hour", sql("SELECT site_id, division_id % 2 AS division_id, monitor_id % 40 AS monitor_id, hour_ts, min(subject_id) AS subject_id, min(cohort_type) AS cohort_type FROM hourly_c GROUP BY ALL HAVING count(DISTINCT subject_id) = 1"))
def b15(spark, d):
    crowded = Study(spark, d).hourly_c.withColumn("division_id", F.col("division_id") % 2).withColumn("monitor_id", F.col("monitor_id") % 40)
    return C.unique_unit_hour(crowded).select("site_id", "division_id", "monitor_id", "hour_ts", "subject_id", "cohort_type")


@query("b16_link_events", sql("SELECT event_id, subject_id, hour_ts, cohort_type FROM link_local"))
def b16(spark, d):
    s = Study(spark, d)
    hours = C.null_safe_join(s.hourly_c, s.elig.filter("eligible"), [*C.UNIT, "cohort_type"], "left_semi")
    return C.link_events_to_hours(s.events_c, hours, "event_ts_local", BINS).select("event_id", "subject_id", "hour_ts", "cohort_type")


@query("b17_analysis_base", sql(f"SELECT {KEYS}, cohort_type, hour_ts, pct_chair, pct_bed, falls_in_hour, fall_event_flag FROM base"))
def b17(spark, d):
    return Study(spark, d).base.select(*C.UNIT, "cohort_type", "hour_ts", "pct_chair", "pct_bed", "falls_in_hour", "fall_event_flag")


@query("b18_analysis_scope", sql("SELECT scope, cohort_type, count(*) AS hours FROM scope GROUP BY ALL"))
def b18(spark, d):
    return Study(spark, d).scope.groupBy("scope", "cohort_type").agg(F.count(F.lit(1)).alias("hours"))


@query("b19_eligible_events", sql("SELECT event_id, monitor_id, hour_ts, daypart, clock FROM linked"))
def b19(spark, d):
    return Study(spark, d).linked.select("event_id", "monitor_id", "hour_ts", "daypart", "clock")


@query("b20_cohort_pack", sql("""SELECT e.*, b.base_hours, b.events, b.state_hours, round(1000.0 * b.events / b.base_hours, 6) AS events_per_1000_hours FROM
  (SELECT cohort_type, count(*) AS units, count(*) FILTER (eligible) AS eligible_units, avg(observed_hours) AS mean_hours, stddev_samp(observed_hours) AS std_hours, min(observed_hours) AS min_hours, quantile_cont(observed_hours, 0.25) AS p25_hours,
    quantile_cont(observed_hours, 0.5) AS p50_hours, quantile_cont(observed_hours, 0.75) AS p75_hours, max(observed_hours) AS max_hours FROM elig GROUP BY cohort_type) e
  LEFT JOIN (SELECT cohort_type, count(*) AS base_hours, sum(falls_in_hour)::BIGINT AS events, sum(pct_chair + pct_bed) AS state_hours FROM base GROUP BY cohort_type) b ON e.cohort_type IS NOT DISTINCT FROM b.cohort_type"""))  # fmt: skip
def b20(spark, d):
    s = Study(spark, d)
    return C.cohort_pack(s.elig, s.base)


@query("b21_exclusions", sql("SELECT cohort_type, reason, count(*) AS units FROM (SELECT cohort_type, unnest(string_split(exclusion_reason, '|')) AS reason FROM elig WHERE NOT eligible) GROUP BY ALL"))
def b21(spark, d):
    return C.exclusions(Study(spark, d).elig)


@query("b21_qa_summary", sql("""UNPIVOT (SELECT count(*)::DOUBLE AS units, count(*) FILTER (eligible)::DOUBLE AS eligible_units, avg(eligible::INT) AS eligible_rate, (SELECT count(*) FROM base)::DOUBLE AS base_rows,
  (SELECT sum(falls_in_hour) FROM base)::DOUBLE AS events, (SELECT count(*) FILTER (fall_event_flag) FROM base)::DOUBLE AS event_hours FROM elig) ON COLUMNS(*) INTO NAME metric VALUE value"""))  # fmt: skip
def b21_summary(spark, d):
    s = Study(spark, d)
    return C.qa_summary(s.elig, s.base)


_RATES = """SELECT x.scope, x.stratum AS daypart, position, coalesce(n, 0) AS eligible_event_count, round(h, 4) AS exposure_hours, round(coalesce(e, 0), 4) AS expected_falls, coalesce(l, 0) AS hard_label_falls,
  CASE WHEN h > 0 THEN round(coalesce(e, 0) / h * 1000, 4) END AS rate_per_1000_expected, CASE WHEN h > 0 THEN round(coalesce(l, 0) / h * 1000, 4) END AS rate_per_1000_hard
FROM (SELECT max(scope) AS scope, coalesce(daypart, 'all_dayparts') AS stratum, position, sum(CASE position WHEN 'chair' THEN pct_chair ELSE pct_bed END) AS h FROM scope, states GROUP BY GROUPING SETS ((daypart, position), (position))) x
LEFT JOIN (SELECT coalesce(daypart, 'all_dayparts') AS stratum, position, count(*) AS n, sum(CASE position WHEN 'chair' THEN pre_prob_chair ELSE pre_prob_bed END) AS e, count(*) FILTER (label = position) AS l
  FROM linked, states GROUP BY GROUPING SETS ((daypart, position), (position))) y USING (stratum, position)"""


@query("b71_rates_by_state", sql(_RATES))
def b71(spark, d):
    s = Study(spark, d)
    return R.rates_by_state(s.scope, s.linked)


@query("b72_operational_rates", sql("""SELECT scope, metric, position, round(h, 4) AS exposure_hours, round(w, 4) AS weighted_event_count, round(w / h, 6) AS rate_per_hour, round(w / h * 100, 4) AS rate_per_100_hours,
  round(max(round(w / h, 6)) FILTER (position = 'chair') OVER (PARTITION BY metric) / max(round(w / h, 6)) FILTER (position = 'bed') OVER (PARTITION BY metric), 6) AS rate_ratio
FROM (SELECT scope, metric, position, sum(s) AS h, sum(s * n) AS w FROM (SELECT scope, position, CASE position WHEN 'chair' THEN pct_chair ELSE pct_bed END AS s, metric, CASE metric WHEN 'alarms' THEN num_alarms WHEN 'nudges' THEN num_nudges ELSE num_announcements END AS n
  FROM scope, states, (SELECT unnest(['alarms', 'nudges', 'announcements']) AS metric)) GROUP BY ALL)"""))  # fmt: skip
def b72(spark, d):
    return R.operational_rates(Study(spark, d).scope)


@query("b73_confidence_features", sql("SELECT event_id, round(confidence_weight, 9) AS confidence_weight, confidence_segment FROM confident"))
def b73(spark, d):
    return R.confidence_features(Study(spark, d).linked).select("event_id", F.round("confidence_weight", 9).alias("confidence_weight"), "confidence_segment")


_EACH = "CASE position WHEN 'chair' THEN {c}_chair ELSE {c}_bed END"


@query("b74_confidence_sensitivity", sql("""SELECT scope, segment AS confidence_segment, position, n AS eligible_event_count, round(m, 4) AS mean_confidence_weight, round(h, 4) AS exposure_hours, round(e, 4) AS expected_falls, round(w, 4) AS weighted_expected_falls,
  l AS hard_label_falls, round(e / h * 1000, 4) AS rate_per_1000_expected, round(w / h * 1000, 4) AS rate_per_1000_weighted, round(l / h * 1000, 4) AS rate_per_1000_hard
FROM (SELECT coalesce(confidence_segment, 'all_events') AS segment, position, count(*) AS n, avg(confidence_weight) AS m, sum(p) AS e, sum(p * confidence_weight) AS w, count(*) FILTER (label = position) AS l
  FROM (SELECT *, CASE position WHEN 'chair' THEN pre_prob_chair ELSE pre_prob_bed END AS p FROM confident, states) GROUP BY GROUPING SETS ((confidence_segment, position), (position))),
  (SELECT scope, position AS q, CASE position WHEN 'chair' THEN h_chair ELSE h_bed END AS h FROM exposure, states) WHERE position = q"""))  # fmt: skip
def b74(spark, d):
    s = Study(spark, d)
    return R.confidence_sensitivity(s.scope, s.linked)


@query("b75_missingness_stress", sql("""SELECT scope, cut AS excluded_pct, n AS retained, t - n AS excluded, round(n / t, 4) AS retained_fraction, round(m, 4) AS mean_confidence_weight, position, round(h, 4) AS exposure_hours, round(e, 4) AS expected_falls,
  round(w, 4) AS weighted_expected_falls, l AS hard_label_falls, round(e / h * 1000, 4) AS rate_per_1000_expected, round(w / h * 1000, 4) AS rate_per_1000_weighted, round(l / h * 1000, 4) AS rate_per_1000_hard,
  round(max(round(e / h * 1000, 4)) FILTER (position = 'chair') OVER c / max(round(e / h * 1000, 4)) FILTER (position = 'bed') OVER c, 6) AS ratio_expected,
  round(max(round(w / h * 1000, 4)) FILTER (position = 'chair') OVER c / max(round(w / h * 1000, 4)) FILTER (position = 'bed') OVER c, 6) AS ratio_weighted,
  round(max(round(l / h * 1000, 4)) FILTER (position = 'chair') OVER c / max(round(l / h * 1000, 4)) FILTER (position = 'bed') OVER c, 6) AS ratio_hard
FROM (SELECT cut, t, position, count(*) AS n, avg(confidence_weight) AS m, sum(p) AS e, sum(p * confidence_weight) AS w, count(*) FILTER (label = position) AS l
  FROM (SELECT *, CASE position WHEN 'chair' THEN pre_prob_chair ELSE pre_prob_bed END AS p FROM (SELECT *, row_number() OVER (ORDER BY confidence_weight, event_id) AS r, count(*) OVER () AS t FROM confident), states, (SELECT unnest([0, 10, 20, 30]) AS cut))
  WHERE r > t * cut // 100 GROUP BY ALL), (SELECT scope, position AS q, CASE position WHEN 'chair' THEN h_chair ELSE h_bed END AS h FROM exposure, states) WHERE position = q
WINDOW c AS (PARTITION BY cut)"""))  # fmt: skip
def b75(spark, d):
    s = Study(spark, d)
    return R.missingness_stress(s.scope, s.linked)


@query("b76_reconciliation", sql("UNPIVOT (SELECT count(*) AS raw_events, count(*) FILTER (subject_id IS NULL) AS events_without_subject, (SELECT count(*) FROM linked) AS linked_events, (SELECT count(*) FROM linked WHERE label IN ('chair', 'bed')) AS hard_label_events FROM raw_events) ON COLUMNS(*) INTO NAME metric VALUE value"))
def b76(spark, d):
    s = Study(spark, d)
    return R.reconciliation(s.raw_events, s.linked)


@query("b77_position_cells", sql("SELECT * FROM cells"))
def b77(spark, d):
    return R.position_cells(Study(spark, d).intervention)


@query("b82_third_state_rate", sql("SELECT sum(falls_in_hour * pct_ambulatory / greatest(pct_chair + pct_bed + pct_ambulatory, 1e-9)) AS n_events, sum(pct_ambulatory) AS exposure_hours, n_events / exposure_hours * 1000 AS rate_per_1000 FROM treated"))
def b82(spark, d):
    return R.third_state_rate(Study(spark, d).intervention)


@query("b83_subset_rates", sql("""SELECT subset, sum(pct_chair) AS hours_chair, sum(pct_bed) AS hours_bed, sum(falls_in_hour * pct_chair / t) AS events_chair, sum(falls_in_hour * pct_bed / t) AS events_bed,
  (sum(falls_in_hour * pct_chair / t) / nullif(sum(pct_chair), 0)) / nullif(sum(falls_in_hour * pct_bed / t) / nullif(sum(pct_bed), 0), 0) AS rate_ratio
FROM (SELECT *, greatest(pct_chair + pct_bed, 1e-9) AS t, unnest(list_filter([daypart, CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 'weekend_only' ELSE 'weekday_only' END, CASE WHEN pct_chair >= 0.5 OR pct_bed >= 0.5 THEN 'position_certain_only' END], lambda x: x IS NOT NULL)) AS subset FROM treated) GROUP BY subset"""))  # fmt: skip
def b83(spark, d):
    return R.subset_rates(Study(spark, d).intervention)


@query("b84_misclassification_swap", sql("""SELECT division_id, daypart, day_of_week, calendar_quarter, scenario, position, greatest(CASE position WHEN 'chair' THEN ch ELSE bh END, 1e-6) AS exposure_hours,
  CASE position WHEN 'chair' THEN (1 - p) * cf + q * bf ELSE (1 - q) * bf + p * cf END AS fall_count
FROM (SELECT division_id, daypart, day_of_week, calendar_quarter, sum(exposure_hours) FILTER (position = 'chair') AS ch, sum(exposure_hours) FILTER (position = 'bed') AS bh, sum(fall_count) FILTER (position = 'chair') AS cf, sum(fall_count) FILTER (position = 'bed') AS bf FROM cells GROUP BY ALL),
  (VALUES ('symmetric_swap_10pct', 0.1::DOUBLE, 0.1::DOUBLE), ('symmetric_swap_20pct', 0.2, 0.2), ('symmetric_swap_30pct', 0.3, 0.3), ('chair_to_bed_20pct', 0.2, 0), ('bed_to_chair_20pct', 0, 0.2)) s(scenario, p, q), states"""))  # fmt: skip
def b84(spark, d):
    return R.misclassification_swap(R.position_cells(Study(spark, d).intervention))


_FLAGGED = "SELECT event_id, monitor_id, hour_ts FROM link WHERE pre_dropout_visibility_ratio > 0.5 UNION ALL SELECT -event_id, monitor_id, hour_ts + INTERVAL 1 HOUR FROM link WHERE pre_dropout_visibility_ratio <= 0.5"


def _flagged(s):
    from tideline.operators.cohort import better_clock

    linked = better_clock(s.events_c, s.base, BINS)
    hit = F.col("pre_dropout_visibility_ratio") > 0.5
    return linked.select(F.when(hit, F.col("event_id")).otherwise(-F.col("event_id")).alias("event_id"), "monitor_id", F.when(hit, F.col("hour_ts")).otherwise(F.col("hour_ts") + F.expr("INTERVAL 1 HOUR")).alias("hour_ts"))


@query("b86_origin_reclassify", sql("SELECT b.monitor_id, b.hour_ts, falls_in_hour, CASE WHEN f.monitor_id IS NOT NULL AND falls_in_hour > 0 THEN 1 ELSE pct_chair END AS pct_chair, CASE WHEN f.monitor_id IS NOT NULL AND falls_in_hour > 0 THEN 0 ELSE pct_bed END AS pct_bed FROM treated b LEFT JOIN (SELECT DISTINCT monitor_id, hour_ts FROM flagged) f USING (monitor_id, hour_ts)", flagged=_FLAGGED))
def b86(spark, d):
    s = Study(spark, d)
    return R.origin_reclassify(s.intervention, _flagged(s)).select("monitor_id", "hour_ts", "falls_in_hour", "pct_chair", "pct_bed")


@query("b87_reclassify_diagnostic", sql("SELECT f.*, b.monitor_id IS NOT NULL AS matched, coalesce(b.falls_in_hour, 0) AS falls_in_matched_hour, b.pct_chair AS pct_chair_original FROM flagged f LEFT JOIN treated b ON f.monitor_id = b.monitor_id AND f.hour_ts = b.hour_ts", flagged=_FLAGGED))
def b87(spark, d):
    s = Study(spark, d)
    return R.reclassify_diagnostic(s.intervention, _flagged(s)).select("event_id", "monitor_id", "hour_ts", "matched", "falls_in_matched_hour", "pct_chair_original")
