"""Queries over trajectories, and the panels of controls."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideline.config import DEFAULT
from tideline.operators import quality as Q
from tideline.operators import shadow as H
from tideline.operators import trajectory as T
from tideline.operators import windows as W
from tideline.plans import quality_queries as QQ
from tideline.plans import window_queries as WQ
from tideline.plans.standins import events, sql
from tideline.sources.staging import stage

QUERIES: dict = {}
ORACLE_SQL: dict = {}
SIZES = (60, 180)


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


#: Hours stand for seconds, and frames are sparse.
LIMITS = T.Limits(min_presence=0.05, min_frames=5, max_gap=40, window=240, baseline=120, nudge=0.9)
_K = "anchor_id, window_role"
_KW = 'anchor_id, window_role, "window"'
_PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _quality(sizes):
    return f"""SELECT z.*, coalesce(frames, 0) AS frames, coalesce(observed, 0) AS observed, coalesce(gap, false) AS gap_exceeded, round(coalesce(observed, 0) / z."window", 6) AS presence,
      CASE WHEN coalesce(observed, 0) / z."window" < 0.05 - 5e-7 THEN 'insufficient_sample_presence' WHEN coalesce(frames, 0) < 5 THEN 'sparse_window' WHEN gap THEN 'inter_frame_gap' END AS reason
      FROM (SELECT DISTINCT {_K}, w AS "window" FROM rp, (SELECT unnest({list(sizes)})::INT AS w)) z LEFT JOIN (SELECT {_KW}, count(*) AS frames, count(DISTINCT o) AS observed, bool_or(g > 40) AS gap FROM
        (SELECT *, o - lag(o) OVER (PARTITION BY {_KW} ORDER BY o, event_id) AS g FROM (SELECT rp.*, w AS "window" FROM rp, (SELECT unnest({list(sizes)})::INT AS w) WHERE o < 0 AND o >= -w)) GROUP BY ALL) USING ({_KW})"""


_FRAME = """event_id, state, d_chair, d_bed, d_room, loc, coalesce(posture, '') AS posture, posture IS NOT NULL OR coalesce(score_sitting, score_standing, score_lying, 0) > 0 AS posed,
  CASE WHEN coalesce(score_sitting, score_standing, score_lying, 0) > 0 THEN (coalesce(score_sitting, 0) > 0)::INT::DOUBLE ELSE score_sitting END AS s1, CASE WHEN coalesce(score_sitting, score_standing, score_lying, 0) > 0 THEN (coalesce(score_standing, 0) > 0)::INT::DOUBLE ELSE score_standing END AS s2,
  CASE WHEN coalesce(score_sitting, score_standing, score_lying, 0) > 0 THEN (coalesce(score_lying, 0) > 0)::INT::DOUBLE ELSE score_lying END AS s3, staff_iou AS nudge"""
ONE = WQ.BASE | {"rp": f"SELECT anchor_id, 'hazard' AS window_role, floor(-back)::BIGINT AS o, {_FRAME} FROM j"}
ROLE = WQ.ROLES | {"rp": f"SELECT r.anchor_id, r.window_role, floor((epoch_us(s.ts) - epoch_us(r.anchor_ts)) / 3600e6)::BIGINT AS o, {_FRAME} FROM roles r JOIN s ON r.monitor_id = s.monitor_id AND (r.subject_id IS NULL OR r.subject_id = s.subject_id) AND s.ts >= r.anchor_ts - INTERVAL 240 HOUR AND s.ts <= r.anchor_ts"}
_CH = ("mean", "velocity_mean", "velocity_volatility", "accel_mean")
FEATURES = {
    "ql": _quality(SIZES),
    "rf": f'SELECT x.* FROM (SELECT rp.*, w AS "window" FROM rp, (SELECT unnest({list(SIZES)})::INT AS w) WHERE o < 0 AND o >= -w) x SEMI JOIN (SELECT * FROM ql WHERE reason IS NULL) q USING ({_KW})',
    "r1": f"SELECT *, lag(state) OVER x AS b, last_value(CASE WHEN posed THEN posture END IGNORE NULLS) OVER (PARTITION BY {_KW} ORDER BY o, event_id {_PAST}) AS pp FROM rf WINDOW x AS (PARTITION BY {_KW} ORDER BY o, event_id)",
    "r2": f"SELECT *, coalesce(state <> b, false)::INT AS sw, sum(coalesce(state <> b, false)::INT) OVER (PARTITION BY {_KW} ORDER BY o, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r1",
    "ft": f"""SELECT {_KW}, round(avg(loc::INT), 6) AS visible_ratio, sum(sw)::BIGINT AS switch_count, {', '.join(f"round(avg((state = '{x}')::INT), 6) AS {x}_share" for x in T.STATES)}, max(dw) AS location_dwell_max,
      {', '.join(f"count(*) FILTER (b = '{x}' AND state = '{y}') AS {x}_to_{y}_transitions" for x, y in T.MOVES)}, round(avg(posed::INT), 6) AS posture_observed_ratio, count(*) FILTER (posed AND posture <> pp) AS posture_switch_count,
      {', '.join(f"round(avg(s{i + 1}) FILTER (posed), 6) AS posture_{x}_score_mean, round(avg((posture = '{x}')::INT) FILTER (posed), 6) AS posture_{x}_share" for i, x in enumerate(T.POSTURES))}
      FROM (SELECT *, count(*) OVER (PARTITION BY {_KW}, run) AS dw FROM r2) GROUP BY ALL""",
    "c1": f"""SELECT *, o - lag(o) OVER x AS dt, d - lag(d) OVER x AS dv FROM ({' UNION ALL '.join(f"SELECT {_KW}, o, event_id, '{c}' AS c, d_{c} AS d FROM rf WHERE d_{c} IS NOT NULL" for c in T.CHANNELS)}) WINDOW x AS (PARTITION BY {_KW}, c ORDER BY o, event_id)""",
    "c2": f"SELECT *, last_value(v IGNORE NULLS) OVER x AS pv, last_value(CASE WHEN v IS NOT NULL THEN o END IGNORE NULLS) OVER x AS po FROM (SELECT *, CASE WHEN dt > 0 THEN dv / dt END AS v FROM c1) WINDOW x AS (PARTITION BY {_KW}, c ORDER BY o, event_id {_PAST})",
    "c3": f"""SELECT {_KW}, c, count(*) >= 2 AND min(d) = max(d) AS flat, count(*) >= 2 AND min(d) < max(d) AND max(dt) FILTER (dt > 0) <= 40 AS known, round(avg(d), 6) AS mean, round(avg(v), 6) AS velocity_mean, round(stddev_pop(v), 6) AS velocity_volatility, round(avg((v - pv) / (o - po)) FILTER (o > po), 6) AS accel_mean FROM c2 GROUP BY ALL""",
    "cw": f"SELECT {_KW}, bool_or(flat) AS flat, {', '.join(f"max({m}) FILTER (c = '{c}' AND known) AS {c}_distance_{m}" for c in T.CHANNELS for m in _CH)} FROM c3 GROUP BY ALL",
    "tf": f"""SELECT q.* EXCLUDE (reason), CASE WHEN q.reason IS NULL AND coalesce(flat, false) THEN 'zero_variance' ELSE q.reason END AS reason, q.reason IS NULL AND NOT coalesce(flat, false) AS eligible, f.* EXCLUDE ({_KW}), c.* EXCLUDE ({_KW}, flat)
      FROM ql q LEFT JOIN ft f USING ({_KW}) LEFT JOIN cw c USING ({_KW})""",
}
_IN = "o >= -240 AND o < 0"
ONSET = {
    "ql": _quality((240,)),
    "rq": f"SELECT rp.* FROM rp SEMI JOIN (SELECT * FROM ql WHERE reason IS NULL) q USING ({_K}) WHERE {_IN}",
    "us": f"SELECT {_K}, arg_min(state, (-n, state)) AS us FROM (SELECT {_K}, state, count(*) AS n FROM rq WHERE o < -120 GROUP BY ALL) GROUP BY ALL",
    "up": f"SELECT {_K}, arg_min(posture, (-n, posture)) AS up FROM (SELECT {_K}, posture, count(*) AS n FROM rq WHERE o < -120 AND posed AND posture <> '' GROUP BY ALL) GROUP BY ALL",
    "ut": f"SELECT {_K}, {', '.join(f'avg(d_{c}) + 2 * greatest(stddev_pop(d_{c}), 0.3) AS f_{c}' for c in T.CHANNELS)} FROM rq WHERE o < -120 GROUP BY ALL",
    "lt": f"""SELECT *, coalesce(posed AND posture <> '' AND posture <> up AND greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0)) >= 0.5, false) AS other, (nudge >= 0.9 AND NOT coalesce(lag(nudge >= 0.9) OVER x, false)) AS rises
      FROM rq JOIN us USING ({_K}) LEFT JOIN up USING ({_K}) JOIN ut USING ({_K}) WHERE o >= -120 WINDOW x AS (PARTITION BY {_K} ORDER BY o, event_id)""",
    "l2": f"SELECT *, count(*) OVER (PARTITION BY {_K}, other, run) AS len FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY o, event_id) - row_number() OVER (PARTITION BY {_K}, other ORDER BY o, event_id) AS run FROM lt)",
    "hit": """SELECT anchor_id, window_role, o, event_id, 0 AS i, 0 AS c, 'posture_transition' AS channel, up AS source, posture AS target FROM l2 WHERE other AND len >= 2
      UNION ALL SELECT anchor_id, window_role, o, event_id, 1, 0, 'location_departure', us, state FROM l2 WHERE state <> us
      UNION ALL SELECT anchor_id, window_role, o, event_id, 2, c, 'distance_breakout', n, NULL FROM (SELECT *, unnest([{'c': 1, 'n': 'chair', 'f': d_chair > f_chair}, {'c': 2, 'n': 'bed', 'f': d_bed > f_bed}, {'c': 3, 'n': 'room', 'f': d_room > f_room}], recursive := true) FROM l2) WHERE f
      UNION ALL SELECT anchor_id, window_role, o, event_id, 3, 0, 'nudge_escalation', NULL, NULL FROM l2 WHERE rises""",
    "fo": f"SELECT {_K}, arg_min({{'o': o, 'channel': channel, 'source': source, 'target': target}}, (o, i, c, event_id)) AS x FROM hit GROUP BY ALL",
    "ons": f"""SELECT {_K}, presence, frames, CASE WHEN reason IS NULL AND l.late IS NULL THEN 'sparse_window' ELSE reason END AS reason, fo.x IS NOT NULL AS onset_detected, x.channel AS onset_channel, x.o AS first_signal_offset, abs(x.o) AS latency_to_anchor, x.source AS departure_source, x.target AS destination_label
      FROM ql LEFT JOIN (SELECT {_K}, count(*) AS late FROM l2 GROUP BY ALL) l USING ({_K}) LEFT JOIN fo USING ({_K})""",
    "ons2": """SELECT o.*, o.onset_channel IS NOT NULL AND coalesce(n, 0) < (SELECT greatest(1, ceil(count(DISTINCT anchor_id) * 0.1)) FROM ons WHERE window_role = 'hazard') AS below_prevalence FROM ons o
      LEFT JOIN (SELECT onset_channel, count(DISTINCT anchor_id) AS n FROM ons WHERE window_role = 'hazard' AND onset_detected GROUP BY ALL) p ON o.onset_channel = p.onset_channel""",
    "oc": """SELECT c.anchor_id, c.window_role AS control_role, c.onset_detected AS control_onset_detected, c.latency_to_anchor AS control_latency_to_anchor, c.onset_channel AS control_onset_channel, h.onset_detected AS hazard_onset_detected, h.latency_to_anchor AS hazard_latency_to_anchor, h.onset_channel AS hazard_onset_channel,
      h.onset_detected::INT - c.onset_detected::INT AS detected_delta, h.latency_to_anchor - c.latency_to_anchor AS latency_delta, h.below_prevalence OR c.below_prevalence AS excluded FROM ons2 c JOIN ons2 h ON c.anchor_id = h.anchor_id AND h.window_role = 'hazard' WHERE c.window_role <> 'hazard'""",
}


_REAL = "(share|ratio|mean|volatility)$"
_ROUND = f"SELECT COLUMNS(lambda c: NOT regexp_matches(c, '{_REAL}')), round(COLUMNS(lambda c: regexp_matches(c, '{_REAL}')) + 3e-7, 4) FROM ({{q}})"


def rounded(df):
    """To four digits, off their ties, as two engines may round a tie at the sixth digit either way."""
    return df.select(*[F.round(F.col(c) + 3e-7, 4).alias(c) if re.search(_REAL, c) else F.col(c) for c in df.columns])


def hazard_panel(spark, d):
    return stage(T.normal_panel(WQ.panel(spark, d).withColumn("nudge_score", F.col("staff_iou"))).select(*T.FRAME), "hazard-panel")


def role_panel(spark, d):
    roles = stage(W.control_anchors(WQ.anchors(spark, d), DEFAULT.control_days), "roles")
    frames = W.window_panel(roles, WQ.signals(spark, d), WQ.KEYS, -240 * WQ.H, 0, 12 * WQ.H, WQ.H)
    return stage(T.normal_panel(frames.withColumn("nudge_score", F.col("staff_iou"))).select(*T.FRAME), "role-panel")


@query("b114_combine_panels", sql("SELECT anchor_id, event_id, floor(-back)::BIGINT AS offset, CASE WHEN floor(-back) >= -24 AND floor(-back) < 0 THEN 'near' ELSE 'whole' END AS panel FROM j", **WQ.BASE))
def b114(spark, d):
    p = WQ.panel(spark, d)
    near = p.filter("offset >= -24 AND offset < 0").withColumn("panel", F.lit("near"))
    return T.combine_panels(near, p.withColumn("panel", F.lit("whole"))).select("anchor_id", "event_id", "offset", "panel")


@query("b115_window_quality", sql("SELECT *, reason IS NULL AS eligible FROM ql", **ONE, ql=FEATURES["ql"]))
def b115(spark, d):
    return T.window_quality(hazard_panel(spark, d), SIZES, LIMITS)


@query("b116_trajectory_features", sql(_ROUND.format(q="SELECT * FROM tf"), **ONE, **FEATURES))
def b116(spark, d):
    return rounded(T.trajectory_features(hazard_panel(spark, d), SIZES, LIMITS))


@query("b117_detect_onset", sql("SELECT * FROM ons2", **ROLE, **ONSET))
def b117(spark, d):
    return T.detect_onset(role_panel(spark, d), LIMITS)


@query("b118_onset_crossover", sql("SELECT * FROM oc", **ROLE, **ONSET))
def b118(spark, d):
    return T.onset_crossover(stage(T.detect_onset(role_panel(spark, d), LIMITS), "onsets"))


_WIDE = ", ".join(
    f"""max({f}) FILTER ("window" = {w} AND window_role = 'hazard') AS "hazard_{w}__{f}\"""" for w in SIZES for f in T.HAZARD_FEATURES
) + ", " + ", ".join(f"""avg({f}) FILTER ("window" = {w} AND window_role <> 'hazard') AS "control_mean_{w}__{f}\"""" for w in SIZES for f in T.DELTA_FEATURES)
_DELTA = ", ".join(f'round("hazard_{w}__{f}" - "control_mean_{w}__{f}", 6) AS "delta_{w}__{f}"' for w in SIZES for f in T.DELTA_FEATURES)


@query("b119_trajectory_wide", sql(_ROUND.format(q=f"SELECT *, {_DELTA} FROM (SELECT anchor_id, {_WIDE} FROM tf GROUP BY anchor_id)"), **ROLE, **FEATURES))
def b119(spark, d):
    return rounded(T.trajectory_wide(T.trajectory_features(role_panel(spark, d), SIZES, LIMITS), SIZES))


@query("b119_onset_wide", sql(f"""SELECT anchor_id, onset_detected::INT::DOUBLE AS hazard_onset_detected, latency_to_anchor::DOUBLE AS hazard_onset_latency, below_prevalence::INT::DOUBLE AS hazard_onset_below_prevalence, {', '.join(f"coalesce(onset_channel = '{c}', false)::INT::DOUBLE AS hazard_onset_{c}" for c in T.ONSETS)}, round(dm, 6) AS onset_detected_delta_mean, round(lm, 6) AS onset_latency_delta_mean
  FROM ons2 LEFT JOIN (SELECT anchor_id, avg(detected_delta) AS dm, avg(latency_delta) AS lm FROM oc GROUP BY anchor_id) USING (anchor_id) WHERE window_role = 'hazard'""", **ROLE, **ONSET))  # fmt: skip
def b119_onset(spark, d):
    onsets = stage(T.detect_onset(role_panel(spark, d), LIMITS), "onsets")
    return T.onset_wide(onsets, T.onset_crossover(onsets))


EXIT = {
    "ex": "SELECT row_id, split_part(event_key, '|', 1)::BIGINT AS monitor_id, split_part(event_key, '|', 2) AS date, last_furniture, departure_seconds AS dep FROM an WHERE status = 'included_fall' AND last_furniture IS NOT NULL AND departure_seconds IS NOT NULL",
    "ew": """SELECT ex.row_id, ex.last_furniture, ex.dep, f.* FROM ex JOIN (SELECT event_id, monitor_id, strftime(ts, '%Y-%m-%d') AS date, (epoch_us(ts) // 1000000) % 86400 AS sec, state, posture, coalesce(score_sitting, score_standing, score_lying, 0) AS top, CASE WHEN staff_iou = 0 THEN 'green' WHEN staff_iou < 0.85 THEN 'yellow' ELSE 'red' END AS colour FROM s) f
      ON f.monitor_id = ex.monitor_id AND f.date = ex.date AND abs(f.sec - ex.dep) <= 21600""",
    "e1": "SELECT *, lag(colour) OVER x AS before, arg_min(posture, (sec, event_id)) FILTER (posture IS NOT NULL) OVER (PARTITION BY row_id) AS base FROM ew WINDOW x AS (PARTITION BY row_id ORDER BY sec, event_id)",
    "e2": "SELECT *, coalesce(posture <> base AND top >= 0.5, false) AS other FROM e1",
    "e3": "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sec, event_id) - row_number() OVER (PARTITION BY row_id, other ORDER BY sec, event_id) AS run FROM e2 WHERE posture IS NOT NULL",
    "e4": "SELECT row_id, min(sec) AS sec FROM (SELECT *, count(*) OVER (PARTITION BY row_id, other, run) AS n FROM e3) WHERE other AND n >= 2 GROUP BY row_id",
    "e5": "SELECT row_id, min(sec) FILTER (before = 'green' AND colour <> 'green') AS a, min(sec) FILTER (state <> CASE last_furniture WHEN 'floor' THEN 'room' ELSE last_furniture END) AS b FROM e2 GROUP BY row_id",
    "ec": """SELECT row_id, last_furniture, dep::INT AS departure_seconds, x.t AS signal_type, x.s::BIGINT AS signal_seconds, (x.s - dep)::BIGINT AS bias_seconds, x.s IS NOT NULL AS found FROM (SELECT ex.*, unnest([{'t': 'nudge_boundary', 's': e5.a}, {'t': 'location_label', 's': e5.b}, {'t': 'posture_transition', 's': e4.sec}]) AS x
      FROM ex LEFT JOIN e5 USING (row_id) LEFT JOIN e4 USING (row_id))""",
}


def concordance(spark, d):
    a = QQ.annotations(spark, d).filter("status = 'included_fall'")
    part = lambda i: F.get(F.split("event_key", r"\|"), F.lit(i))
    ev = a.select("row_id", part(0).cast("long").alias("monitor_id"), part(1).alias("date"), "last_furniture", F.col("departure_seconds").cast("int").alias("departure_seconds"))
    s = W.signal_flags(WQ.signals(spark, d))
    colour = F.when(F.col("staff_iou") == 0, "green").when(F.col("staff_iou") < 0.85, "yellow").otherwise("red")
    frames = s.select("event_id", "monitor_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.pmod(F.unix_seconds("ts"), F.lit(86_400)).alias("second"), "state", "posture", *[f"score_{p}" for p in T.POSTURES], colour.alias("nudge_state"))
    return Q.exit_concordance(ev, frames, 21_600)


@query("b127_exit_concordance", sql("SELECT * FROM ec", **QQ.AN, s=WQ.G, **EXIT))
def b127(spark, d):
    return concordance(spark, d)


@query("b127_exit_summary", sql("SELECT signal_type, count(*) AS events, count(bias_seconds) AS detected, quantile_cont(bias_seconds, 0.5) AS bias_median, round(avg(bias_seconds), 6) AS bias_mean, round(avg(abs(bias_seconds)), 6) AS mae, quantile_cont(abs(bias_seconds), 0.5) AS p50_abs_error, quantile_cont(abs(bias_seconds), 0.9) AS p90_abs_error FROM ec GROUP BY signal_type", **QQ.AN, s=WQ.G, **EXIT))
def b127_summary(spark, d):
    return Q.exit_summary(concordance(spark, d))


def shadow_frame(spark, d):
    """Anchors as sequences: their windows' probabilities, a truth by the event's k, and the features of their windows and onsets."""
    k = F.col("k")
    told = events(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("anchor_id"), "monitor_id", F.when(k % 10 > F.floor(k / 10), "chair").when(k % 10 < F.floor(k / 10), "bed").otherwise("room").alias("truth"))
    windows = WQ.labelled(spark, d).select("anchor_id", F.col("label").alias("derived"), *[f"prob_{s}" for s in T.STATES])
    scored = stage(told.join(windows, "anchor_id").withColumn("sequence_id", F.col("anchor_id")), "scored")
    panel = role_panel(spark, d)
    onsets = stage(T.detect_onset(panel, LIMITS), "onsets")
    wide = stage(T.trajectory_wide(T.trajectory_features(panel, SIZES, LIMITS), SIZES), "wide")
    frame, families = H.feature_frame(scored, scored.select("sequence_id", "anchor_id"), wide, T.onset_wide(onsets, T.onset_crossover(onsets)))
    return stage(frame, "features"), families


def predictions(spark, d):
    frame, families = shadow_frame(spark, d)
    return H.cv_predict(frame, [c for f in families.values() for c in f], "stacked", folds=3, repeats=1)


@query("b120_feature_frame")
def b120(spark, d):
    return shadow_frame(spark, d)[0]


@query("b123_cv_predict")
def b123(spark, d):
    return predictions(spark, d)


@query("b124_fold_metrics")
def b124(spark, d):
    return H.fold_metrics(predictions(spark, d))


@query("b125_feature_importance")
def b125(spark, d):
    frame, families = shadow_frame(spark, d)
    return H.feature_importance(frame, families, "stacked")


@query("b126_ablation")
def b126(spark, d):
    frame, families = shadow_frame(spark, d)
    return H.ablation(frame, families, folds=2, repeats=1)


@query("b121_grouped_folds", sql("""SELECT event_id, (((r - 2) % n + n) % n % 5)::INT AS fold FROM ev JOIN (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM ev WHERE subject_id IS NOT NULL)) USING (subject_id)
  UNION ALL SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1 + 2) % 5)::INT FROM ev WHERE subject_id IS NULL"""))  # fmt: skip
def b121(spark, d):
    return T.grouped_folds(events(spark, d), "subject_id", 5, 2, "event_id").select("event_id", F.col("fold").cast("int").alias("fold"))


_ROLEJ = "SELECT r.anchor_id, r.window_role, s.event_id, floor((epoch_us(s.ts) - epoch_us(r.anchor_ts)) / 3600e6)::BIGINT AS offset FROM roles r JOIN s ON r.monitor_id = s.monitor_id AND (r.subject_id IS NULL OR r.subject_id = s.subject_id) AND s.ts >= r.anchor_ts - INTERVAL 48 HOUR AND s.ts <= r.anchor_ts"


@query("b36_crossover_panel", sql("SELECT * FROM rj", **WQ.ROLES, rj=_ROLEJ))
def b36(spark, d):
    roles = stage(W.control_anchors(WQ.anchors(spark, d), DEFAULT.control_days), "roles")
    return W.window_panel(roles, WQ.signals(spark, d), WQ.KEYS, -48 * WQ.H, 0, 12 * WQ.H, WQ.H).select("anchor_id", "window_role", "event_id", "offset")


def matched(spark, d):
    """Matched chunks as control anchors of their units, clipped to the chunk."""
    _, m = WQ.matches(spark, d)
    c = WQ.chunks(spark, d).select((F.col("monitor_id") * 100_000 + F.col("chunk")).alias("chunk_id"), *WQ.KEYS, "chunk_start", F.col("anchor_ts"))
    return stage(m.select("anchor_id", "chunk_id").join(c, "chunk_id").withColumn("subject_id", F.lit(None).cast("long")).withColumn("window_role", F.lit("matched")), "matched")


_MP = "SELECT m.anchor_id, m.chunk_id::BIGINT AS chunk_id, s.event_id FROM m JOIN (SELECT *, monitor_id * 100000 + chunk AS chunk_id FROM c) c ON m.chunk_id = c.chunk_id JOIN s ON s.monitor_id = c.monitor_id AND s.ts >= c.chunk_start AND s.ts BETWEEN c.anchor_ts - INTERVAL 24 HOUR AND c.anchor_ts"
MT = {"a": WQ.A, "s": WQ.G, "c": WQ._CHUNKS, "sev": WQ.SEV, "m": WQ._MATCH}


@query("b39_matched_panel", sql("SELECT * FROM mp", **MT, mp=_MP))
def b39(spark, d):
    p = W.window_panel(matched(spark, d), WQ.signals(spark, d), WQ.KEYS, -24 * WQ.H, 0, 12 * WQ.H, WQ.H)
    return p.filter("ts >= chunk_start").select("anchor_id", "chunk_id", "event_id")


@query("b38_matched_window_summary", sql("SELECT anchor_id, chunk_id, count(*) AS frames, avg((state = 'chair')::INT) AS chair_share FROM (SELECT mp.*, s.state FROM mp JOIN s USING (event_id)) GROUP BY ALL", **MT, mp=_MP))
def b38(spark, d):
    p = W.window_panel(matched(spark, d), WQ.signals(spark, d), WQ.KEYS, -24 * WQ.H, 0, 12 * WQ.H, WQ.H).filter("ts >= chunk_start")
    return p.groupBy("anchor_id", "chunk_id").agg(F.count(F.lit(1)).alias("frames"), F.avg((F.col("state") == "chair").cast("double")).alias("chair_share"))


@query("b42_matched_effects", sql("""SELECT metric, avg(d) AS mean_delta, quantile_cont(d, 0.5) AS median_delta, count(*) AS pairs FROM (SELECT anchor_id, 'chair_share' AS metric, h.chair_share - x.chair_share AS d FROM (SELECT anchor_id, avg((state = 'chair')::INT) AS chair_share FROM (SELECT a.anchor_id, s.state FROM a JOIN s ON a.monitor_id = s.monitor_id AND s.ts >= a.anchor_ts - INTERVAL 24 HOUR AND s.ts < a.anchor_ts) GROUP BY anchor_id) h
  JOIN (SELECT anchor_id, avg(chair_share) AS chair_share FROM (SELECT anchor_id, chunk_id, avg((state = 'chair')::INT) AS chair_share FROM (SELECT mp.*, s.state FROM mp JOIN s USING (event_id)) GROUP BY ALL) GROUP BY anchor_id) x USING (anchor_id)) GROUP BY metric""", **MT, mp=_MP))  # fmt: skip
def b42(spark, d):
    hazard = WQ.anchors(spark, d).withColumn("window_role", F.lit("hazard")).withColumn("eligible_window", F.lit(True))
    h = W.role_summary(stage(hazard, "hazard"), WQ.signals(spark, d), WQ.KEYS, 24 * WQ.H).select("anchor_id", "window_role", "eligible_window", "chair_share")
    c = b38(spark, d).select("anchor_id", F.lit("matched").alias("window_role"), F.lit(True).alias("eligible_window"), "chair_share")
    return W.paired_effects(h.unionByName(c), ["chair_share"])
