"""Queries over time joins, sessions and windows. Hours stand for the seconds of the study."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.config import DEFAULT
from tideline.operators import joins as J
from tideline.operators import sessions as S
from tideline.operators import windows as W
from tideline.plans.standins import BINS, events, raw_hourly, sql
from tideline.sources.staging import stage
from tideline.sources.tables import store_by_time

QUERIES: dict = {}
ORACLE_SQL: dict = {}
H = 3600
KEYS = ["division_id", "monitor_id"]


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def anchors(spark, d):
    e = events(spark, d).filter("event_type = 'error'")
    return e.select(F.col("event_id").alias("anchor_id"), *KEYS, F.when(F.col("k") % 2 == 0, F.col("subject_id")).alias("subject_id"), F.col("ts").alias("anchor_ts"))


def severe(spark, d):
    return anchors(spark, d).join(events(spark, d).filter(f"value > {SEVERE}").select(F.col("event_id").alias("anchor_id")), "anchor_id", "left_semi")


def signals(spark, d):
    e = events(spark, d).filter("event_type <> 'error'")
    near = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    p = F.col("k") % 4
    score = lambda i: F.when(p == i, F.col("k") / 100.0)
    return e.select(
        "event_id", *KEYS, "subject_id", "ts", near("click").alias("d_chair"), near("view").alias("d_bed"), near("purchase").alias("d_room"), F.when(F.col("k") >= 70, F.col("k") / 100.0).otherwise(0.0).alias("staff_iou"),
        F.when(p == 0, "sitting").when(p == 1, "standing").when(p == 2, "lying").alias("posture"), score(0).alias("score_sitting"), score(1).alias("score_standing"), score(2).alias("score_lying"), "k",
    )


#: Errors over this value are severe.
SEVERE = 150
SEV = f"SELECT * FROM a SEMI JOIN (SELECT event_id AS anchor_id FROM ev WHERE value > {SEVERE}) USING (anchor_id)"
A = "SELECT event_id AS anchor_id, division_id, monitor_id, CASE WHEN k % 2 = 0 THEN subject_id END AS subject_id, ts AS anchor_ts FROM ev WHERE event_type = 'error'"
G = """SELECT event_id, division_id, monitor_id, subject_id, ts, CASE WHEN event_type = 'click' THEN value END AS d_chair, CASE WHEN event_type = 'view' THEN value END AS d_bed, CASE WHEN event_type = 'purchase' THEN value END AS d_room,
  CASE WHEN k >= 70 THEN k / 100 ELSE 0 END AS staff_iou, CASE k % 4 WHEN 0 THEN 'sitting' WHEN 1 THEN 'standing' WHEN 2 THEN 'lying' END AS posture,
  CASE WHEN k % 4 = 0 THEN k / 100 END AS score_sitting, CASE WHEN k % 4 = 1 THEN k / 100 END AS score_standing, CASE WHEN k % 4 = 2 THEN k / 100 END AS score_lying,
  CASE event_type WHEN 'click' THEN 'chair' WHEN 'view' THEN 'bed' WHEN 'purchase' THEN 'room' ELSE 'no_patient' END AS state, event_type <> 'signup' AS loc, k % 4 <> 3 AS posed FROM ev WHERE event_type <> 'error'"""
WILD = "(a.subject_id IS NULL OR a.subject_id = s.subject_id)"
JOIN = "a JOIN s ON a.monitor_id = s.monitor_id AND {w} s.ts BETWEEN a.anchor_ts - INTERVAL {lo} HOUR AND a.anchor_ts + INTERVAL {hi} HOUR"
_J = f"SELECT a.anchor_id, a.anchor_ts, s.* EXCLUDE (subject_id), (epoch_us(a.anchor_ts) - epoch_us(s.ts)) / 3600e6 AS back FROM {JOIN.format(w=WILD + ' AND', lo=240, hi=240)}"
BASE = {"a": A, "s": G, "j": _J}


@query("a24_interval_join", sql(f"SELECT a.anchor_id, s.event_id FROM {JOIN.format(w=WILD + ' AND', lo=24, hi=12)}", a=A, s=G))
def a24(spark, d):
    return J.interval_join(anchors(spark, d), signals(spark, d), KEYS, -24 * H, 12 * H, wildcard="subject_id").select("anchor_id", "event_id")


@query("a8_stored_interval_join", sql(f"SELECT a.anchor_id, s.event_id FROM {JOIN.format(w=WILD + ' AND', lo=24, hi=12)}", a=A, s=G))
def a8(spark, d):
    """The signals stored by unit and day, then joined without a shuffle of theirs."""
    width = 24 * H
    stored = store_by_time(signals(spark, d), f"tideline_signals_{uuid.uuid4().hex}", KEYS, width, buckets=max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return J.stored_interval_join(anchors(spark, d), stored, KEYS, -24 * H, 12 * H, width, wildcard="subject_id").select("anchor_id", "event_id")


@query("a28_nearest", sql("SELECT a.anchor_id, arg_min(s.k, (abs(epoch_us(s.ts) - epoch_us(a.anchor_ts)), s.k)) AS k FROM a JOIN (SELECT * FROM ev WHERE event_type <> 'error') s ON a.monitor_id = s.monitor_id AND s.ts BETWEEN a.anchor_ts - INTERVAL 6 HOUR AND a.anchor_ts + INTERVAL 6 HOUR GROUP BY a.anchor_id", a=A))
def a28(spark, d):
    return J.nearest(anchors(spark, d), signals(spark, d), KEYS, 6 * H, "k")


_NEAR = "SELECT a.anchor_id, arg_min(s.subject_id, (abs(epoch_us(s.{t}) - epoch_us(a.anchor_ts)), s.subject_id)) AS subject_id FROM a JOIN {s} s ON a.monitor_id = s.monitor_id AND s.subject_id IS NOT NULL AND s.{t} BETWEEN a.anchor_ts - INTERVAL {n} HOUR AND a.anchor_ts + INTERVAL {n} HOUR GROUP BY a.anchor_id"


@query("b1_resolve_subject", sql("SELECT a.anchor_id, coalesce(n.subject_id, h.subject_id) AS subject_id, CASE WHEN n.subject_id IS NOT NULL THEN 'signal' WHEN h.subject_id IS NOT NULL THEN 'hourly' END AS subject_source FROM a LEFT JOIN n USING (anchor_id) LEFT JOIN h USING (anchor_id)", a=A, s=G, n=_NEAR.format(t="ts", s="s", n=5), h=_NEAR.format(t="hour_ts", s="raw_hourly", n=20)))
def b1(spark, d):
    return J.resolve_subject(anchors(spark, d), signals(spark, d), raw_hourly(spark, d), KEYS, 5 * H, 20 * H).select("anchor_id", "subject_id", "subject_source")


_CHUNKS = """SELECT division_id, monitor_id, chunk, min(ts) AS chunk_start, max(ts) AS chunk_end, count(*) AS frame_count, max(ts) + INTERVAL 1 SECOND AS anchor_ts, date_sub('second', min(ts), max(ts)) AS duration_seconds
  FROM (SELECT *, sum(CASE WHEN g IS NULL OR g > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY monitor_id ORDER BY ts) AS chunk FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY monitor_id ORDER BY ts) AS g FROM s)) GROUP BY ALL"""


def chunks(spark, d):
    return S.gap_sessions(signals(spark, d), KEYS, 12 * H, DEFAULT.time_zone)


@query("b5_gap_sessions", sql("SELECT monitor_id, chunk::BIGINT AS chunk, chunk_start, chunk_end, frame_count, duration_seconds, hour(timezone('America/Chicago', timezone('UTC', anchor_ts))) AS anchor_hour FROM c", s=G, c=_CHUNKS))
def b5(spark, d):
    return chunks(spark, d).select("monitor_id", "chunk", "chunk_start", "chunk_end", "frame_count", "duration_seconds", F.col("anchor_hour").cast("long").alias("anchor_hour"))


@query("b40_chunk_inventory", sql("SELECT division_id, count(*) AS chunks, sum(frame_count)::BIGINT AS frames, min(chunk_start) AS first_start, max(chunk_end) AS last_end, max(duration_seconds) AS longest FROM c GROUP BY division_id", s=G, c=_CHUNKS))
def b40(spark, d):
    return chunks(spark, d).groupBy("division_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("frame_count").alias("frames"), F.min("chunk_start").alias("first_start"), F.max("chunk_end").alias("last_end"), F.max("duration_seconds").alias("longest"))


@query("a68_islands", sql("SELECT monitor_id, run::BIGINT AS run, state, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM (SELECT *, sum(c) OVER (PARTITION BY monitor_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY monitor_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM s)) GROUP BY ALL", s=G))
def a68(spark, d):
    return S.islands(W.signal_flags(signals(spark, d)), ["monitor_id"], ["ts", "event_id"], "state")


@query("b22_primary_candidate", sql("""SELECT monitor_id, day, p.posture AS posture, CASE WHEN p IS NULL THEN NULL WHEN n > 0 THEN 'primary' ELSE 'fallback' END AS source FROM (SELECT monitor_id, date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'click') AS n,
  coalesce(arg_min({'posture': e}, (-score, -value, -t, event_id)) FILTER (event_type = 'click'), arg_min({'posture': e}, (-score, -value, -t, event_id)) FILTER (event_type = 'view')) AS p
  FROM (SELECT *, k / 100 AS score, (k % 2)::INT AS t, CASE k % 4 WHEN 0 THEN 'sitting' WHEN 1 THEN 'standing' WHEN 2 THEN 'lying' END AS e FROM ev) GROUP BY ALL)"""))  # fmt: skip
def b22(spark, d):
    p = F.col("k") % 4
    item = F.struct("event_id", F.when(p == 0, " Sitting ").when(p == 1, "standing").when(p == 2, "LYING").otherwise("").alias("posture"), (F.col("k") / 100.0).alias("score_patient"), F.col("value").alias("score"), (F.col("k") % 2 == 1).alias("has_tracked"))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, item)))
    days = events(spark, d).groupBy("monitor_id", F.date_trunc("day", "ts").alias("day")).agg(pick("click").alias("a"), pick("view").alias("b"))
    best = W.primary_candidate(F.col("a"), F.col("b"))
    return days.withColumn("p", best).select("monitor_id", "day", "p.posture", "p.source")


@query("b23_dominant_state", sql("SELECT state, posed AS has_posture, loc AS has_location, count(*) AS n FROM s GROUP BY ALL", s=G))
def b23(spark, d):
    return W.signal_flags(signals(spark, d)).groupBy("state", "has_posture", "has_location").agg(F.count(F.lit(1)).alias("n"))


@query("b25_normalise_score", sql("SELECT event_id, CASE WHEN value > 1 THEN least(value / 100, 1) ELSE greatest(value, 0) END AS score FROM ev"))
def b25(spark, d):
    return events(spark, d).select("event_id", W.normalise_score(F.col("value")).alias("score"))


_GRID = """SELECT h.monitor_id, h.hour_ts, g.step, coalesce(n.label, 'missing_posture') AS label FROM (SELECT DISTINCT monitor_id, hour_ts FROM raw_hourly) h, LATERAL (SELECT unnest(range((epoch_us(hour_ts) // 1000000)::BIGINT, (epoch_us(hour_ts) // 1000000)::BIGINT + 118800, 10800)) AS step) g
  LEFT JOIN (SELECT monitor_id, epoch_us(ts) // 10800000000 * 10800 AS step, CASE WHEN least(coalesce(min(d_chair), 1e12), coalesce(min(d_bed), 1e12), coalesce(min(d_room), 1e12)) = 1e12 THEN 'no_patient' WHEN coalesce(min(d_chair), 1e12) <= least(coalesce(min(d_bed), 1e12), coalesce(min(d_room), 1e12)) THEN 'chair'
    WHEN coalesce(min(d_bed), 1e12) <= coalesce(min(d_room), 1e12) THEN 'bed' ELSE 'room' END AS label FROM s GROUP BY ALL) n ON h.monitor_id = n.monitor_id AND g.step = n.step"""


@query("b26_dense_grid", sql("SELECT monitor_id, label, count(*) AS steps FROM grid GROUP BY ALL", s=G, grid=_GRID))
def b26(spark, d):
    grid = S.dense_grid(raw_hourly(spark, d).select(*KEYS, "hour_ts"), signals(spark, d), KEYS, BINS.grain_s, 3 * H)
    return grid.groupBy("monitor_id", "label").agg(F.count(F.lit(1)).alias("steps"))


def panel(spark, d):
    return W.window_panel(anchors(spark, d), signals(spark, d), KEYS, -240 * H, 240 * H, 48 * H, H)


@query("b27_window_panel", sql("SELECT anchor_id, event_id, floor(-back)::BIGINT AS offset, state, CASE WHEN back <= 0 THEN 'post' WHEN back <= 48 THEN 'pre_immediate' ELSE 'pre_long' END AS phase FROM j", **BASE))
def b27(spark, d):
    return panel(spark, d).select("anchor_id", "event_id", "offset", "state", "phase")


_SUM = """SELECT a.anchor_id, a.anchor_ts, count(back) FILTER (back > 0) AS pre_frames, count(back) FILTER (back <= 0) AS post_frames, count(*) FILTER (back > 0 AND back <= 30) AS focus_frames, count(*) FILTER (back > 0 AND back <= 30 AND loc) AS focus_visible_frames,
  count(DISTINCT epoch_us(ts) // 43200000000) FILTER (back > 0 AND back <= 180) AS drop_bins, count(DISTINCT epoch_us(ts) // 43200000000) FILTER (back > 0 AND back <= 180 AND loc) AS drop_visible_bins,
  min(d_chair) FILTER (back > 0 AND back <= 30) AS min_chair, min(d_bed) FILTER (back > 0 AND back <= 30) AS min_bed, min(d_room) FILTER (back > 0 AND back <= 30) AS min_room, max(ts) FILTER (back > 0 AND back <= 180 AND loc) AS last_visible_ts,
  coalesce(sum(1 / CASE WHEN d_chair < 1e-6 THEN 1e-6 ELSE d_chair END) FILTER (back > 0 AND back <= 30), 0) AS w_chair, coalesce(sum(1 / CASE WHEN d_bed < 1e-6 THEN 1e-6 ELSE d_bed END) FILTER (back > 0 AND back <= 30), 0) AS w_bed, coalesce(sum(1 / CASE WHEN d_room < 1e-6 THEN 1e-6 ELSE d_room END) FILTER (back > 0 AND back <= 30), 0) AS w_room,
  count(*) FILTER (back > 0 AND back <= 180 AND posed) AS posture_frames, avg(score_sitting) FILTER (back > 0 AND back <= 180) AS mean_sitting, avg(score_standing) FILTER (back > 0 AND back <= 180) AS mean_standing, avg(score_lying) FILTER (back > 0 AND back <= 180) AS mean_lying,
  count(*) FILTER (back > 0 AND back <= 180 AND prev <> posture) AS posture_switches, min(ts) FILTER (back <= 0 AND staff_iou > 0) AS first_response_ts, count(*) FILTER (back <= 0 AND staff_iou > 0) AS response_frames,
  count(*) FILTER (back > 0 AND back <= 180 AND posture = 'sitting') / nullif(posture_frames, 0) AS share_sitting, count(*) FILTER (back > 0 AND back <= 180 AND posture = 'standing') / nullif(posture_frames, 0) AS share_standing, count(*) FILTER (back > 0 AND back <= 180 AND posture = 'lying') / nullif(posture_frames, 0) AS share_lying,
  first_response_ts IS NOT NULL AS response_detected, date_sub('second', a.anchor_ts, first_response_ts) AS response_latency_seconds
  FROM a LEFT JOIN (SELECT *, last_value(posture IGNORE NULLS) OVER (PARTITION BY anchor_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM j) j ON a.anchor_id = j.anchor_id GROUP BY a.anchor_id, a.anchor_ts"""


def summary(spark, d):
    return W.window_summary(anchors(spark, d), signals(spark, d), KEYS, 240 * H, 30 * H, 180 * H, 12 * H)


@query("b28_window_summary", sql(_SUM, **BASE))
def b28(spark, d):
    return summary(spark, d)


_VIS = """SELECT *, (min_chair IS NOT NULL)::INT + (min_bed IS NOT NULL)::INT + (min_room IS NOT NULL)::INT AS signal_count, drop_visible_bins / nullif(drop_bins, 0) AS visibility_ratio, date_sub('second', last_visible_ts, anchor_ts) AS last_visible_gap_seconds,
  CASE WHEN last_visible_ts IS NULL THEN 1 ELSE least(1, last_visible_gap_seconds / 648000) END AS gap_ratio, CASE WHEN drop_bins = 0 THEN 0 ELSE 1 - drop_visible_bins / drop_bins END AS dropout_ratio,
  CASE WHEN drop_bins = 0 OR drop_visible_bins = 0 THEN 0 ELSE greatest(0.15::DOUBLE, 1 - least(0.85::DOUBLE, 0.65::DOUBLE * dropout_ratio + 0.35::DOUBLE * gap_ratio)) END AS visible_prob, CASE WHEN drop_bins = 0 THEN 1.0::DOUBLE ELSE 0 END AS unknown_prob FROM sm"""
_PROBS = """SELECT *, w_chair + w_bed + w_room AS wt, CASE WHEN drop_bins = 0 THEN 0 WHEN drop_visible_bins = 0 THEN 0.5::DOUBLE ELSE least(0.9::DOUBLE, greatest(0.1::DOUBLE, 0.3::DOUBLE + 0.55::DOUBLE * coalesce(w_room / nullif(w_chair + w_bed + w_room, 0), 0) + 0.15::DOUBLE * dropout_ratio)) END AS away,
  CASE WHEN drop_bins = 0 THEN 0 ELSE 1 - visible_prob - unknown_prob END AS missing, visible_prob * coalesce(w_chair / nullif(wt, 0), 0) AS prob_chair, visible_prob * coalesce(w_bed / nullif(wt, 0), 0) AS prob_bed, visible_prob * coalesce(w_room / nullif(wt, 0), 0) AS prob_room,
  missing * away AS prob_out_of_room, missing * (1 - away) AS prob_not_visible, missing * (1 - away) + missing * away + unknown_prob AS prob_no_patient FROM vis"""
_LABEL = """SELECT anchor_id, round(prob_chair, 9) AS prob_chair, round(prob_bed, 9) AS prob_bed, round(prob_room, 9) AS prob_room, round(prob_no_patient, 9) AS prob_no_patient, round(visible_prob, 9) AS visible_prob,
  CASE greatest(prob_chair, prob_bed, prob_room, prob_no_patient) WHEN prob_no_patient THEN 'no_patient' WHEN prob_chair THEN 'chair' WHEN prob_bed THEN 'bed' ELSE 'room' END AS label,
  round(list_reverse_sort([prob_chair, prob_bed, prob_room, prob_no_patient])[1] - list_reverse_sort([prob_chair, prob_bed, prob_room, prob_no_patient])[2], 9) AS margin FROM pr"""
LABELLED = BASE | {"sm": _SUM, "vis": _VIS, "pr": _PROBS, "lb": _LABEL}


def labelled(spark, d):
    return W.label_and_margin(W.legacy_state_probs(W.visibility_score(summary(spark, d), 180 * H)))


@query("b29_visibility_score", sql("SELECT anchor_id, signal_count, visibility_ratio, last_visible_gap_seconds, gap_ratio, dropout_ratio, visible_prob, unknown_prob FROM vis", **LABELLED))
def b29(spark, d):
    return W.visibility_score(summary(spark, d), 180 * H).select("anchor_id", "signal_count", "visibility_ratio", "last_visible_gap_seconds", "gap_ratio", "dropout_ratio", "visible_prob", "unknown_prob")


@query("b30_legacy_state_probs", sql("SELECT anchor_id, prob_chair, prob_bed, prob_room, prob_out_of_room, prob_not_visible, prob_no_patient FROM pr", **LABELLED))
def b30(spark, d):
    return W.legacy_state_probs(W.visibility_score(summary(spark, d), 180 * H)).select("anchor_id", "prob_chair", "prob_bed", "prob_room", "prob_out_of_room", "prob_not_visible", "prob_no_patient")


@query("b31_label_and_margin", sql("SELECT * FROM lb", **LABELLED))
def b31(spark, d):
    return labelled(spark, d).select("anchor_id", *[F.round(c, 9).alias(c) for c in ("prob_chair", "prob_bed", "prob_room", "prob_no_patient", "visible_prob")], "label", F.round("margin", 9).alias("margin"))


@query("b32_response_latency", sql("SELECT anchor_id, response_detected, response_latency_seconds FROM sm", **BASE, sm=_SUM))
def b32(spark, d):
    return summary(spark, d).select("anchor_id", "response_detected", "response_latency_seconds")


_ROLES = "SELECT a.* REPLACE (a.anchor_ts + day * INTERVAL 1 DAY AS anchor_ts), role AS window_role FROM a, (VALUES ('hazard', 0), ('control_1d', -1), ('control_2d', -2)) r(role, day)"
_NB = "SELECT r.*, (SELECT count(*) FROM a o WHERE o.monitor_id = r.monitor_id AND o.anchor_id <> r.anchor_id AND o.anchor_ts BETWEEN r.anchor_ts - INTERVAL 6 HOUR AND r.anchor_ts + INTERVAL 6 HOUR) AS nearby FROM roles r"


def proximity(spark, d):
    a = anchors(spark, d)
    return W.anchor_proximity(W.control_anchors(a, DEFAULT.control_days), a, KEYS, 6 * H)


@query("b33_control_anchors", sql("SELECT anchor_id, window_role, anchor_ts FROM roles", a=A, roles=_ROLES))
def b33(spark, d):
    return W.control_anchors(anchors(spark, d), DEFAULT.control_days).select("anchor_id", "window_role", "anchor_ts")


@query("b34_anchor_proximity", sql("SELECT anchor_id, window_role, nearby, window_role = 'hazard' OR nearby = 0 AS eligible_window FROM nb", a=A, roles=_ROLES, nb=_NB))
def b34(spark, d):
    return proximity(spark, d).select("anchor_id", "window_role", "nearby", "eligible_window")


_RS = """SELECT r.anchor_id, r.window_role, r.window_role = 'hazard' OR nearby = 0 AS eligible_window, count(f.ts) AS frame_count, avg(loc::INT) AS visibility_ratio, avg((state = 'chair')::INT) AS chair_share, avg((state = 'bed')::INT) AS bed_share, avg((state = 'room')::INT) AS room_share, avg((state = 'no_patient')::INT) AS no_patient_share,
  avg(d_chair) AS mean_d_chair, avg(d_bed) AS mean_d_bed, avg(d_room) AS mean_d_room, avg(staff_iou) AS mean_iou, max(staff_iou) AS max_iou, count(*) FILTER (prev <> state) AS switches FROM nb r LEFT JOIN
  (SELECT r.anchor_id, r.window_role, s.* EXCLUDE (subject_id), lag(state) OVER (PARTITION BY r.anchor_id, r.window_role ORDER BY s.ts, s.event_id) AS prev FROM roles r JOIN s ON r.monitor_id = s.monitor_id AND s.ts >= r.anchor_ts - INTERVAL 72 HOUR AND s.ts < r.anchor_ts) f ON r.anchor_id = f.anchor_id AND r.window_role = f.window_role GROUP BY ALL"""
ROLES = {"a": A, "s": G, "roles": _ROLES, "nb": _NB, "rs": _RS}


def role_summary(spark, d):
    return W.role_summary(stage(proximity(spark, d), "roles"), signals(spark, d), KEYS, 72 * H)


@query("b35_role_summary", sql("SELECT anchor_id, window_role, eligible_window, frame_count, visibility_ratio, chair_share, bed_share, mean_d_chair, mean_iou, max_iou, CASE WHEN frame_count > 0 THEN switches END AS switches FROM rs", **ROLES))
def b35(spark, d):
    return role_summary(spark, d).select("anchor_id", "window_role", "eligible_window", "frame_count", "visibility_ratio", "chair_share", "bed_share", "mean_d_chair", "mean_iou", "max_iou", "switches")


_METRICS = ["chair_share", "bed_share", "visibility_ratio", "mean_iou", "switches"]


@query("b41_crossover_effects", sql("""SELECT metric, avg(d) AS mean_delta, quantile_cont(d, 0.5) AS median_delta, count(*) AS pairs FROM (SELECT anchor_id, metric, avg(v) FILTER (window_role = 'hazard') - avg(v) FILTER (window_role <> 'hazard') AS d FROM
  (UNPIVOT (SELECT anchor_id, window_role, chair_share, bed_share, visibility_ratio, mean_iou, CASE WHEN frame_count > 0 THEN switches::DOUBLE END AS switches FROM rs WHERE eligible_window) ON chair_share, bed_share, visibility_ratio, mean_iou, switches INTO NAME metric VALUE v) GROUP BY ALL) WHERE d IS NOT NULL GROUP BY metric""", **ROLES))  # fmt: skip
def b41(spark, d):
    return W.paired_effects(role_summary(spark, d), _METRICS)


_MATCH = """SELECT anchor_id, chunk_id, tier, candidates, rank, gap // 1000000 AS gap_seconds FROM (SELECT *, count(*) OVER (PARTITION BY anchor_id) AS candidates, row_number() OVER (PARTITION BY anchor_id ORDER BY gap, chunk_id) AS rank FROM
  (SELECT *, min(tier) OVER (PARTITION BY anchor_id) AS best FROM (SELECT a.anchor_id, c.chunk_id, abs(epoch_us(c.anchor_ts) - epoch_us(a.anchor_ts)) AS gap, CASE WHEN c.h = a.h THEN 1 WHEN c.p = a.p THEN 2 ELSE 3 END AS tier FROM
    (SELECT *, hour(timezone('America/Chicago', timezone('UTC', anchor_ts))) AS h, CASE WHEN h <= 5 THEN 1 ELSE h // 3 END AS p FROM sev) a JOIN (SELECT *, monitor_id * 100000 + chunk AS chunk_id, hour(timezone('America/Chicago', timezone('UTC', anchor_ts))) AS h, CASE WHEN h <= 5 THEN 1 ELSE h // 3 END AS p FROM c WHERE monitor_id NOT IN (SELECT monitor_id FROM sev)) c USING (division_id))) WHERE tier = best) WHERE rank <= 3"""


def matches(spark, d):
    """Severe errors beside chunks of the units that have none."""
    a = severe(spark, d)
    c = chunks(spark, d).withColumn("chunk_id", F.col("monitor_id") * 100_000 + F.col("chunk"))
    return a, W.match_controls(a, c, a, DEFAULT.time_zone, DEFAULT.match_limit)


@query("b37_match_controls", sql("SELECT anchor_id, chunk_id::BIGINT AS chunk_id, tier, candidates, rank, gap_seconds FROM m", a=A, s=G, c=_CHUNKS, sev=SEV, m=_MATCH))
def b37(spark, d):
    return matches(spark, d)[1]


@query("b43_match_quality", sql("SELECT CASE tier WHEN 1 THEN 'same_hour' WHEN 2 THEN 'same_daypart' WHEN 3 THEN 'division' ELSE 'no_candidate' END AS match, count(*) AS anchors, coalesce(sum(n), 0)::BIGINT AS controls FROM sev LEFT JOIN (SELECT anchor_id, max(tier) AS tier, count(*) AS n FROM m GROUP BY anchor_id) USING (anchor_id) GROUP BY ALL", a=A, s=G, c=_CHUNKS, sev=SEV, m=_MATCH))
def b43(spark, d):
    return W.match_quality(*matches(spark, d))


@query("b44_localized_metrics", sql("""SELECT anchor_id, count(*) AS frames, avg((state = 'chair')::INT) AS chair_share, avg((state = 'bed')::INT) AS bed_share, avg((state = 'room')::INT) AS room_share, avg(x) AS mean_distance,
  (arg_max(x, (ts, event_id)) FILTER (x IS NOT NULL) - arg_min(x, (ts, event_id)) FILTER (x IS NOT NULL)) / nullif((epoch_us(max(ts) FILTER (x IS NOT NULL)) - epoch_us(min(ts) FILTER (x IS NOT NULL))) / 1e6, 0) AS distance_slope FROM (SELECT *, coalesce(d_chair, d_bed, d_room) AS x FROM j WHERE back > 0 AND back <= 48) GROUP BY anchor_id""", **BASE))  # fmt: skip
def b44(spark, d):
    return W.localized_metrics(panel(spark, d), 48 * H)


@query("b45_response_curve", sql("SELECT step, (SELECT count(*) FROM sm WHERE response_latency_seconds // 3600 <= step) AS detected, (SELECT count(*) FROM sm WHERE response_latency_seconds // 3600 <= step) / (SELECT count(*) FROM sm) AS rate FROM (SELECT unnest(range(181))::BIGINT AS step)", **BASE, sm=_SUM))
def b45(spark, d):
    return W.response_curve(summary(spark, d), 180, H)


_SPANS = "SELECT event_id, division_id, monitor_id, ts AS start, lead(ts) OVER (PARTITION BY monitor_id ORDER BY ts, event_id) AS \"end\" FROM ev WHERE event_type <> 'error'"


def spans(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).filter("event_type <> 'error'")
    return e.select("event_id", *KEYS, F.col("ts").alias("start"), F.lead("ts").over(Window.partitionBy("monitor_id").orderBy("ts", "event_id")).alias("end")).filter("end IS NOT NULL")


@query("a26_overlap_join", sql("SELECT p.event_id, q.event_id AS other_id, date_sub('microsecond', greatest(p.start, q.start), least(p.\"end\", q.\"end\")) AS common_us FROM sp p JOIN (SELECT event_id, monitor_id, ts AS start, ts + INTERVAL 5 HOUR AS \"end\" FROM ev WHERE event_type = 'error') q ON p.monitor_id = q.monitor_id AND p.start < q.\"end\" AND q.start < p.\"end\"", sp=_SPANS))
def a26(spark, d):
    o = events(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("other_id"), *KEYS, F.col("ts").alias("start_r"), (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("end_r"))
    j = J.overlap_join(spans(spark, d), o, KEYS, 12 * H)
    return j.select("event_id", "other_id", (F.unix_micros("common_end") - F.unix_micros("common_start")).alias("common_us"))


@query("b130_active_seconds", sql("""SELECT monitor_id, sum(z - a)::BIGINT AS active_seconds FROM (SELECT monitor_id, i, min(a) AS a, max(z) AS z FROM (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY monitor_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM
  (SELECT *, max(z) OVER (PARTITION BY monitor_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT monitor_id, epoch_us(ts) // 1000000 AS a, (epoch_us(ts) + (k::BIGINT * 600000000) + 999999) // 1000000 AS z FROM ev WHERE k > 0))) GROUP BY ALL) GROUP BY monitor_id"""))  # fmt: skip
def b130(spark, d):
    e = events(spark, d).filter("k > 0").select("monitor_id", F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + F.col("k") * F.lit(600_000_000).cast("long")).alias("end"))
    return J.union_seconds(e, ["monitor_id"])


@query("b131_scope_events", sql("""SELECT e.event_id, count(c.chunk) AS sessions, arg_min(c.chunk, (c.chunk_start, c.chunk))::BIGINT AS session_id, CASE count(c.chunk) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status
  FROM (SELECT * FROM ev WHERE event_type = 'error') e LEFT JOIN (SELECT monitor_id, chunk, chunk_start, chunk_end + INTERVAL 20 HOUR AS e FROM c) c ON e.monitor_id = c.monitor_id AND e.ts BETWEEN c.chunk_start AND c.e GROUP BY e.event_id""", s=G, c=_CHUNKS))  # fmt: skip
def b131(spark, d):
    s = chunks(spark, d).select(*KEYS, F.col("chunk").alias("session_id"), F.col("chunk_start").alias("start"), (F.col("chunk_end") + F.expr("INTERVAL 20 HOURS")).alias("end"))
    return J.point_in_session(events(spark, d).filter("event_type = 'error'"), s, KEYS, 48 * H).select("event_id", "sessions", "session_id", "status")
