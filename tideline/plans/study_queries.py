"""Queries over descriptive tables, the operational study and model comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import compare as X
from tideline.operators import describe as D
from tideline.operators import joins as J
from tideline.operators import opstudy as O
from tideline.operators import sessions as S
from tideline.operators import windows as W
from tideline.plans import quality_queries as QQ
from tideline.plans import window_queries as WQ
from tideline.plans.standins import BINS, Study, events, load, raw_events, raw_hourly, sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


_DP = "CASE WHEN hour(ts) <= 5 THEN 'window_00_05' WHEN hour(ts) <= 8 THEN 'window_06_08' WHEN hour(ts) <= 11 THEN 'window_09_11' WHEN hour(ts) <= 14 THEN 'window_12_14' WHEN hour(ts) <= 17 THEN 'window_15_17' WHEN hour(ts) <= 20 THEN 'window_18_20' ELSE 'window_21_23' END"


def falls(spark, d):
    return events(spark, d).filter("event_type = 'error'")


FALLS = {"fl": f"SELECT *, dayname(ts) AS weekday, {_DP} AS daypart FROM ev WHERE event_type = 'error'"}


@query("b59_event_counts", sql("""SELECT 'site' AS dimension, '5' AS value, count(*) AS n FROM fl UNION ALL SELECT 'weekday', weekday, count(*) FROM fl GROUP BY ALL UNION ALL SELECT 'daypart', daypart, count(*) FROM fl GROUP BY ALL
  UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM fl GROUP BY ALL UNION ALL SELECT 'month_of_year', monthname(ts), count(*) FROM fl GROUP BY ALL""", **FALLS))  # fmt: skip
def b59(spark, d):
    return D.event_counts(falls(spark, d), "ts")


@query("b60_label_summary", sql("SELECT label, count(*) AS n, quantile_cont(margin, 0.5) AS median_margin, count(*) / (SELECT count(*) FROM lb) AS share FROM lb GROUP BY label", **WQ.LABELLED))
def b60(spark, d):
    return D.label_summary(WQ.labelled(spark, d).withColumn("margin", F.round("margin", 9)))


@query("b61_expected_by_label", sql("UNPIVOT (SELECT sum(prob_chair) AS chair, sum(prob_bed) AS bed, sum(prob_room) AS room, sum(prob_no_patient) AS no_patient FROM pr) ON COLUMNS(*) INTO NAME label VALUE expected", **WQ.LABELLED))
def b61(spark, d):
    return D.expected_by_label(WQ.labelled(spark, d))


@query("b62_probability_breakdown", sql("""SELECT dimension, value, label, sum(p) AS expected, avg(p) AS mean, quantile_cont(p, 0.5) AS median FROM (SELECT x.dimension, x.value, l.label, CASE l.label WHEN 'chair' THEN prob_chair WHEN 'bed' THEN prob_bed WHEN 'room' THEN prob_room ELSE prob_no_patient END AS p
  FROM (SELECT *, unnest([{'dimension': 'truth', 'value': truth}, {'dimension': 'derived', 'value': derived}]) AS x FROM sc), st l) GROUP BY ALL""", **QQ.SC))  # fmt: skip
def b62(spark, d):
    return D.probability_breakdown(QQ.scored(spark, d), ["truth", "derived"])


@query("b63_response_summary", sql("SELECT count(*) AS n, avg(response_detected::INT) AS response_rate, quantile_cont(response_latency_seconds, 0.5) AS p50, quantile_cont(response_latency_seconds, 0.75) AS p75, quantile_cont(response_latency_seconds, 0.9) AS p90 FROM sm", **WQ.BASE, sm=WQ._SUM))
def b63(spark, d):
    return D.response_summary(WQ.summary(spark, d))


_LABEL = "CASE WHEN k % 10 > k // 10 THEN 'chair' WHEN k % 10 < k // 10 THEN 'bed' ELSE 'room' END"


@query("b64_subject_day_hour", sql(f"""SELECT *, sum(n) OVER b::BIGINT AS bucket_total, round(n / sum(n) OVER b, 4) AS pct_in_bucket FROM (SELECT subject_id, ts::DATE AS date, hour(ts)::INT AS hour, {_LABEL} AS label, count(*) AS n FROM fl GROUP BY ALL)
  WINDOW b AS (PARTITION BY subject_id, date, hour)""", **FALLS))  # fmt: skip
def b64(spark, d):
    tens = F.floor(F.col("k") / 10)
    label = F.when(F.col("k") % 10 > tens, "chair").when(F.col("k") % 10 < tens, "bed").otherwise("room")
    return D.subject_day_hour(falls(spark, d).withColumn("label", label), "ts")


@query("b65_circular_kde", sql("""SELECT division_id, centre, CASE WHEN t > 0 THEN mass / (t * 1.35 * sqrt(2 * pi())) ELSE 0 END AS density FROM (SELECT division_id, c::INT AS centre, sum(value) AS t, sum(CASE WHEN value > 0 THEN value * (exp(-0.5 * power((h - 24 - c) / 1.35, 2)) + exp(-0.5 * power((h - c) / 1.35, 2)) + exp(-0.5 * power((h + 24 - c) / 1.35, 2))) ELSE 0 END) AS mass
  FROM (SELECT division_id, hour(ts)::DOUBLE AS h, value FROM fl), (SELECT unnest(range(24)) AS c) GROUP BY ALL)""", **FALLS))  # fmt: skip
def b65(spark, d):
    return D.circular_kde(falls(spark, d), F.hour("ts"), F.col("value"), "division_id")


@query("b66_weekday_daypart_matrix", sql("SELECT weekday, " + ", ".join(f"count(*) FILTER (daypart = '{x[0]}') AS {x[0]}" for x in D.timefn.DAYPARTS) + " FROM fl GROUP BY weekday", **FALLS))
def b66(spark, d):
    return D.weekday_daypart_matrix(falls(spark, d), "ts")


@query("b67_pareto", sql("SELECT monitor_id, n, sum(n) OVER (ORDER BY n DESC, monitor_id) / (SELECT count(*) FROM fl) AS cumulative_share FROM (SELECT monitor_id, count(*) AS n FROM fl GROUP BY monitor_id ORDER BY n DESC, monitor_id LIMIT 8)", **FALLS))
def b67(spark, d):
    return D.pareto(falls(spark, d), "monitor_id")


@query("b68_source_profile", sql("SELECT 'events' AS source, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (monitor_id IS NULL) AS monitor_id_nulls, count(DISTINCT monitor_id) AS monitor_id_distinct, count(*) FILTER (subject_id IS NULL) AS subject_id_nulls, count(DISTINCT subject_id) AS subject_id_distinct FROM ev"))
def b68(spark, d):
    return D.source_profile(events(spark, d), ["monitor_id", "subject_id"], "ts", "events")


@query("b69_chunk_profile", sql("SELECT count(*) AS chunks, count(*) FILTER (duration_seconds = 0) AS exact_chunks, min(chunk_start) AS history_start, count(DISTINCT monitor_id) AS units, count(DISTINCT monitor_id) FILTER (monitor_id IN (SELECT monitor_id FROM ev WHERE event_type = 'error' AND value > 150)) AS units_with_events, 'partial_history' AS history_status FROM c", s=WQ.G, c=WQ._CHUNKS))
def b69(spark, d):
    return D.chunk_profile(WQ.chunks(spark, d), falls(spark, d).filter("value > 150"), "2023-12-01", 0)


_RUN = "SELECT event_type AS metric, avg(value) AS value FROM events WHERE {c} GROUP BY event_type"


@query("b70_compare_runs", f"SELECT metric, b.value AS base, c.value AS candidate, c.value - b.value AS delta, abs(c.value - b.value) / abs(b.value) AS relative, b.value IS NULL OR c.value IS NULL OR (abs(c.value - b.value) > 1 AND abs(c.value - b.value) / abs(b.value) > 0.01) AS major FROM ({_RUN.format(c='event_id % 2 = 0')}) b FULL JOIN ({_RUN.format(c='event_id % 2 = 1')}) c USING (metric)")
def b70(spark, d):
    e = load(spark, d, "events")
    run = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return D.compare_runs(run(0), run(1), 1.0, 0.01)


@query("b128_session_audit", sql("""SELECT g.*, coalesce(n, 0) AS clicks, hours >= 4 AS gate_hours, hours / expected >= 0.95 AS gate_coverage, valid_ratio >= 0.6 AS gate_valid, coalesce(n, 0) > 0 AS gate_clicks, hours >= 4 AND hours / expected >= 0.95 AND valid_ratio >= 0.6 AND coalesce(n, 0) > 0 AS retained,
  CASE WHEN start < '2024-01-02' THEN 'pre' ELSE 'post' END AS period FROM (SELECT division_id, monitor_id, min(hour_ts) AS start, max(hour_ts) AS last, count(DISTINCT hour_ts) AS hours, ((epoch_us(max(hour_ts)) - epoch_us(min(hour_ts))) // 118800000000 + 1)::BIGINT AS expected, avg(row_valid_pct::INT) AS valid_ratio FROM hourly GROUP BY ALL) g
  LEFT JOIN (SELECT monitor_id, count(*) AS n FROM ev WHERE event_type = 'click' AND k > 50 GROUP BY monitor_id) USING (monitor_id)"""))  # fmt: skip
def b128(spark, d):
    return O.session_audit(Study(spark, d).hourly, events(spark, d).filter("event_type = 'click' AND k > 50"), BINS.grain_s, "2024-01-02")


def grid(spark, d):
    return S.dense_grid(raw_hourly(spark, d).select(*WQ.KEYS, "hour_ts"), WQ.signals(spark, d), WQ.KEYS, BINS.grain_s, 3 * WQ.H)


_GRIDS = {"s": WQ.G, "grid": WQ._GRID}
_MIN = "SELECT monitor_id, step // 86400 * 86400 AS minute, count(*) FILTER (label = 'chair') AS steps_chair, count(*) FILTER (label = 'bed') AS steps_bed, count(*) FILTER (label = 'room') AS steps_room, count(*) FILTER (label = 'no_patient') AS steps_no_patient, count(*) FILTER (label = 'missing_posture') AS steps_missing FROM grid GROUP BY ALL"


@query("b129_minute_exposure", sql(_MIN, **_GRIDS))
def b129(spark, d):
    return O.minute_exposure(grid(spark, d), ["monitor_id"], 24 * WQ.H)


@query("b132_threshold_onsets", sql("SELECT event_id FROM (SELECT event_id, k >= 50 AS a, lag(k >= 50) OVER (PARTITION BY monitor_id ORDER BY ts, event_id) AS p FROM ev) WHERE a AND NOT coalesce(p, false)"))
def b132(spark, d):
    return O.threshold_onsets(events(spark, d), ["monitor_id"], "k", 50, "event_id").select("event_id")


_LABELS = """SELECT o.event_id, o.width, coalesce(arg_min(label, (-n, -here, dist, near, label)) FILTER (label IS NOT NULL), 'missing_posture') AS assigned, coalesce(max(label) FILTER (here = 1), 'missing_posture') AS own_label, coalesce(sum(n) FILTER (label IS NOT NULL), 0)::BIGINT AS seen_steps, coalesce(sum(n) FILTER (label IS NULL), 0)::BIGINT AS missing_steps,
  coalesce(max(n) FILTER (label IS NOT NULL), 0) AS top_votes, count(*) FILTER (label IS NOT NULL AND n = m) AS tied, coalesce(string_agg(label, ',' ORDER BY label) FILTER (label IS NOT NULL AND n = m), '') AS tied_states FROM
  (SELECT *, max(CASE WHEN label IS NOT NULL THEN n END) OVER (PARTITION BY event_id, width) AS m FROM (SELECT event_id, width, label, count(*) AS n, max((step = own AND label IS NOT NULL)::INT) AS here, min(abs(step - own)) AS dist, arg_min(step, (abs(step - own), step)) AS near
    FROM (SELECT e.event_id, e.monitor_id, epoch_us(e.ts) // 10800000000 * 10800 AS own, w AS width, unnest(range(own - w * 10800, own + w * 10800 + 1, 10800)) AS step FROM ev e, (SELECT unnest([3, 5]) AS w) WHERE e.event_type = 'error') x LEFT JOIN (SELECT DISTINCT monitor_id, step, label FROM grid WHERE label <> 'missing_posture') g USING (monitor_id, step) GROUP BY ALL)) o GROUP BY o.event_id, o.width"""


def labels(spark, d):
    return O.window_majority_label(falls(spark, d).select("event_id", *WQ.KEYS, "ts"), grid(spark, d).select(*WQ.KEYS, "step", "label").distinct(), WQ.KEYS, (3, 5), 3 * WQ.H)


@query("b133_window_majority_label", sql(_LABELS, **_GRIDS))
def b133(spark, d):
    return labels(spark, d).withColumn("tied_states", F.array_join("tied_states", ","))


@query("b134_unresolved_labels", sql("""SELECT event_id, 'unresolved' AS assigned, CASE WHEN n = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status FROM (SELECT e.event_id, count(c.chunk) AS n
  FROM (SELECT * FROM ev WHERE event_type = 'error') e LEFT JOIN (SELECT monitor_id, chunk, chunk_start, chunk_end + INTERVAL 20 HOUR AS e FROM c) c ON e.monitor_id = c.monitor_id AND e.ts BETWEEN c.chunk_start AND c.e GROUP BY e.event_id) WHERE n <> 1""", s=WQ.G, c=WQ._CHUNKS))  # fmt: skip
def b134(spark, d):
    s = WQ.chunks(spark, d).select(*WQ.KEYS, F.col("chunk").alias("session_id"), F.col("chunk_start").alias("start"), (F.col("chunk_end") + F.expr("INTERVAL 20 HOURS")).alias("end"))
    return O.unresolved_labels(J.point_in_session(falls(spark, d), s, WQ.KEYS, 48 * WQ.H))


@query("b135_operational_summary", sql("""SELECT state, width, exposure_hours, coalesce(n, 0) AS events, round(100.0::DOUBLE * coalesce(n, 0) / exposure_hours, 6) AS rate_per_100_hours FROM (SELECT unnest([3, 5]) AS width) w CROSS JOIN (UNPIVOT (SELECT sum(steps_chair) * 3.0::DOUBLE AS chair, sum(steps_bed) * 3.0::DOUBLE AS bed, sum(steps_room) * 3.0::DOUBLE AS room, sum(steps_no_patient) * 3.0::DOUBLE AS no_patient FROM mi) ON COLUMNS(*) INTO NAME state VALUE exposure_hours) x
  LEFT JOIN (SELECT width, assigned AS state, count(*) AS n FROM lb3 GROUP BY ALL) USING (state, width)""", **_GRIDS, mi=_MIN, lb3=_LABELS))  # fmt: skip
def b135(spark, d):
    return O.operational_summary(O.minute_exposure(grid(spark, d), ["monitor_id"], 24 * WQ.H), labels(spark, d), 3 * WQ.H)


_SCOPED = "SELECT e.event_id, count(c.chunk) AS n FROM (SELECT * FROM ev WHERE event_type = 'error') e LEFT JOIN (SELECT monitor_id, chunk, chunk_start, chunk_end + INTERVAL 20 HOUR AS e FROM c) c ON e.monitor_id = c.monitor_id AND e.ts BETWEEN c.chunk_start AND c.e GROUP BY e.event_id"
_EXPOSED = "UNPIVOT (SELECT sum(steps_chair) * 3.0::DOUBLE AS chair, sum(steps_bed) * 3.0::DOUBLE AS bed, sum(steps_room) * 3.0::DOUBLE AS room, sum(steps_no_patient) * 3.0::DOUBLE AS no_patient FROM mi) ON COLUMNS(*) INTO NAME state VALUE exposure_hours"
_EVENTS = "SELECT CASE WHEN v.value > 100 THEN 'alarm_trigger' ELSE 'talk_event' END AS metric, l.width, l.assigned, CASE WHEN sc.n = 1 THEN 'resolved' WHEN sc.n = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status FROM lb3 l JOIN sc ON l.event_id = sc.event_id JOIN ev v ON v.event_id = l.event_id"
_ACTIVE = "SELECT CASE WHEN loc THEN state END AS state, staff_iou * 100 AS seconds FROM s WHERE staff_iou > 0"


@query("b135_operational_study", sql("""SELECT metric, width, state, exposure_hours, source_value, numerator, excluded_other, excluded_missing, excluded_unresolved, round(rate_per_100_hours, 6) AS rate_per_100_hours, round(active_seconds_per_hour, 6) AS active_seconds_per_hour FROM
  (SELECT metric, width, x.state, exposure_hours, count(*)::DOUBLE AS source_value, count(*) FILTER (status = 'resolved' AND assigned = x.state)::DOUBLE AS numerator, count(*) FILTER (status = 'resolved' AND assigned NOT IN (x.state, 'missing_posture'))::DOUBLE AS excluded_other, count(*) FILTER (status = 'resolved' AND assigned = 'missing_posture')::DOUBLE AS excluded_missing, count(*) FILTER (status <> 'resolved') AS excluded_unresolved,
    100 * (count(*) FILTER (status = 'resolved' AND assigned = x.state)) / exposure_hours AS rate_per_100_hours, NULL::DOUBLE AS active_seconds_per_hour FROM es, ex x GROUP BY metric, width, x.state, exposure_hours
  UNION ALL SELECT 'nudge_active_seconds', NULL, x.state, exposure_hours, round(sum(seconds), 6), round(coalesce(sum(seconds) FILTER (a.state = x.state), 0), 6), round(coalesce(sum(seconds) FILTER (a.state <> x.state), 0), 6), round(coalesce(sum(seconds) FILTER (a.state IS NULL), 0), 6), 0, NULL, coalesce(sum(seconds) FILTER (a.state = x.state), 0) / exposure_hours FROM ac a, ex x GROUP BY x.state, exposure_hours)""", **_GRIDS, c=WQ._CHUNKS, mi=_MIN, lb3=_LABELS, sc=_SCOPED, ex=_EXPOSED, es=_EVENTS, ac=_ACTIVE))  # fmt: skip
def b135_study(spark, d):
    sessions = WQ.chunks(spark, d).select(*WQ.KEYS, F.col("chunk").alias("session_id"), F.col("chunk_start").alias("start"), (F.col("chunk_end") + F.expr("INTERVAL 20 HOURS")).alias("end"))
    scoped = J.point_in_session(falls(spark, d), sessions, WQ.KEYS, 48 * WQ.H).select("event_id", F.when(F.col("status") == "matched", "resolved").otherwise(F.col("status")).alias("status"), F.when(F.col("value") > 100, "alarm_trigger").otherwise("talk_event").alias("metric"))
    active = W.signal_flags(WQ.signals(spark, d)).filter("staff_iou > 0").select(F.when(F.col("has_location"), F.col("state")).alias("state"), (F.col("staff_iou") * 100).alias("seconds"))
    out = O.operational_study(O.minute_exposure(grid(spark, d), ["monitor_id"], 24 * WQ.H), labels(spark, d).join(scoped, "event_id"), active, 3 * WQ.H)
    return out.withColumns({c: F.round(c, 6) for c in ("source_value", "numerator", "excluded_other", "excluded_missing", "rate_per_100_hours", "active_seconds_per_hour")})


@query("b136_annotation_utc", sql("SELECT row_id, timezone('America/Chicago', strptime(string_split(event_key, '|')[2], '%Y-%m-%d') + fall_seconds * INTERVAL 1 SECOND)::TIMESTAMP AS fall_ts_utc FROM an", **QQ.AN))
def b136(spark, d):
    return X.annotation_utc(QQ.annotations(spark, d), "America/Chicago").select("row_id", "fall_ts_utc")


@query("b137_nearby_records", sql("SELECT a.anchor_id, s.event_id AS record_id, (epoch_us(s.ts) - epoch_us(a.anchor_ts)) / 1e6 AS seconds FROM a JOIN s ON a.monitor_id = s.monitor_id AND s.ts BETWEEN a.anchor_ts - INTERVAL 5 HOUR AND a.anchor_ts + INTERVAL 5 HOUR", a=WQ.A, s=WQ.G))
def b137(spark, d):
    return near(spark, d).select("anchor_id", "record_id", "seconds")


def near(spark, d):
    return X.nearby_records(WQ.anchors(spark, d), WQ.signals(spark, d).select(F.col("event_id").alias("record_id"), *WQ.KEYS, "ts"), WQ.KEYS, 5 * WQ.H)


@query("b139_context_summary", sql("""SELECT a.anchor_id, a.anchor_ts, coalesce(w1, 0) AS within_3600, coalesce(w3, 0) AS within_10800, coalesce(w5, 0) AS within_18000, nearest_record, nearest_seconds, CASE WHEN a.anchor_ts < '2024-01-03' THEN 'before_source' WHEN a.anchor_ts > '2024-01-28' THEN 'after_source' ELSE 'covered' END AS applicability
  FROM a LEFT JOIN (SELECT anchor_id, count(*) FILTER (d <= 3600) AS w1, count(*) FILTER (d <= 10800) AS w3, count(*) FILTER (d <= 18000) AS w5, arg_min(event_id, (d, event_id)) AS nearest_record, min(d) AS nearest_seconds FROM (SELECT a.anchor_id, s.event_id, abs((epoch_us(s.ts) - epoch_us(a.anchor_ts)) / 1e6) AS d FROM a JOIN s ON a.monitor_id = s.monitor_id AND s.ts BETWEEN a.anchor_ts - INTERVAL 5 HOUR AND a.anchor_ts + INTERVAL 5 HOUR) GROUP BY anchor_id) USING (anchor_id)""", a=WQ.A, s=WQ.G))  # fmt: skip
def b139(spark, d):
    return X.context_summary(WQ.anchors(spark, d), near(spark, d), (3600, 10800, 18000), F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-28").cast("timestamp"))


@query("b138_payload_mentions", """SELECT conv_id, turn, regexp_matches(l[1], '(?i)\\bthe\\b') AS in_report, len(list_filter(l[2:], lambda x: regexp_matches(x, '(?i)\\bthe\\b'))) > 0 AS in_event, CASE WHEN in_report AND in_event THEN 'both' WHEN in_report THEN 'report' WHEN in_event THEN 'event' ELSE 'none' END AS match_source
  FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '[.\\n]') AS l FROM conversations)""")  # fmt: skip
def b138(spark, d):
    """Whole texts as payloads: the first sentence or line is the report, each further one an event."""
    c = load(spark, d, "conversations")
    parts = F.split(F.coalesce("text", F.lit("")), "[.\\n]")
    body = F.to_json(F.struct(F.get(parts, F.lit(0)).alias("report"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(x.alias("description"))).alias("events")))
    return X.payload_mentions(c.withColumn("payload", body), "payload", r"(?i)\bthe\b").select("conv_id", "turn", "in_report", "in_event", "match_source")


def model_predictions(spark, d):
    """Three models' predictions for annotation keys: places, times and tags that are off by rule."""
    a = QQ.annotations(spark, d).withColumn("k", F.pmod(F.col("row_id") * 37, F.lit(100)))
    m = F.explode(F.array(*[F.struct(F.lit(f"model_{i}").alias("model"), F.lit(i).alias("i")) for i in (1, 2, 3)])).alias("m")
    a = a.select("*", m).select("*", "m.*").filter(F.pmod(F.col("row_id") + F.col("i"), F.lit(5)) != 0)
    off = F.pmod(F.col("k"), F.col("i") + 2) == 0
    return a.select(
        "model", F.col("row_id").alias("prediction_id"), "event_key", F.when(off, "bed").otherwise(F.col("prefall_location")).alias("prefall_location"), F.when(off, "chair").otherwise(F.col("last_furniture")).alias("last_furniture"),
        F.when(F.col("k") % 8 != 0, F.pmod(F.coalesce("fall_seconds", F.lit(100)) + F.col("k") * F.col("i"), F.lit(86_400))).alias("fall_seconds"), F.when(off, F.array(F.lit("slip"))).otherwise(F.col("tags")).alias("tags"),
    )


CM = {
    "mp": """SELECT 'model_' || i AS model, row_id AS prediction_id, event_key, CASE WHEN k2 % (i + 2) = 0 THEN 'bed' ELSE prefall_location END AS prefall_location, CASE WHEN k2 % (i + 2) = 0 THEN 'chair' ELSE last_furniture END AS last_furniture,
      CASE WHEN k2 % 8 <> 0 THEN (coalesce(fall_seconds, 100) + k2 * i) % 86400 END AS fall_seconds, CASE WHEN k2 % (i + 2) = 0 THEN ['slip'] ELSE tags END AS tags FROM (SELECT *, row_id * 37 % 100 AS k2 FROM an), (SELECT unnest([1, 2, 3]) AS i) WHERE (row_id + i) % 5 <> 0""",
    "cm": """SELECT p.*, t.n AS truth_rows, list_extract(t.l, 1) AS t, CASE WHEN t.n = 1 THEN 'direct_event_key' WHEN p.fall_seconds IS NOT NULL THEN 'nearest_fall_time' ELSE 'earliest_truth_fallback' END AS match_source, p.prefall_location IS NOT DISTINCT FROM t.l[1].prefall_location AS location_match, p.last_furniture IS NOT DISTINCT FROM t.l[1].last_furniture AS furniture_match,
      CASE WHEN len(list_distinct(list_concat(p.tags, t.l[1].tags))) = 0 THEN 1 ELSE len(list_intersect(p.tags, t.l[1].tags)) / len(list_distinct(list_concat(p.tags, t.l[1].tags))) END AS tag_jaccard, abs(p.fall_seconds - t.l[1].fall_seconds) AS time_error, least(abs(p.fall_seconds - t.l[1].fall_seconds), 86400 - abs(p.fall_seconds - t.l[1].fall_seconds)) AS clock_error
      FROM mp p JOIN (SELECT p.model, p.prediction_id, count(*) AS n, [arg_min({'row_id': a.row_id, 'prefall_location': a.prefall_location, 'last_furniture': a.last_furniture, 'fall_seconds': a.fall_seconds, 'tags': a.tags}, (coalesce(abs(a.fall_seconds - p.fall_seconds), CASE WHEN p.fall_seconds IS NOT NULL THEN 1e12 ELSE 0 END), coalesce(a.fall_seconds, 1e12), coalesce(CASE WHEN p.fall_seconds IS NULL THEN a.response_seconds END, 1e12), a.row_id))] AS l
        FROM mp p JOIN an a USING (event_key) GROUP BY p.model, p.prediction_id) t ON p.model = t.model AND p.prediction_id = t.prediction_id""",
    "ck": "SELECT event_key FROM cm GROUP BY event_key HAVING count(DISTINCT model) = 3",
}
_MET = "count(*)::DOUBLE AS events, avg(location_match::INT) AS location_accuracy, avg(furniture_match::INT) AS furniture_accuracy, avg(tag_jaccard) AS mean_tag_jaccard, avg(clock_error) AS time_mae, quantile_cont(clock_error, 0.5)::DOUBLE AS time_median, quantile_cont(clock_error, 0.9)::DOUBLE AS time_p90, avg((clock_error <= 10)::INT) AS within_10s, avg((clock_error <= 30)::INT) AS within_30s, avg((clock_error <= 60)::INT) AS within_60s"
CMP = QQ.AN | CM


def cmp(spark, d):
    return X.compare_to_truth(model_predictions(spark, d), QQ.annotations(spark, d))


@query("b141_compare_to_truth", sql("SELECT model, prediction_id, match_source, t.row_id AS truth_row, location_match, furniture_match, tag_jaccard, time_error::BIGINT AS time_error, clock_error::BIGINT AS clock_error FROM cm", **CMP))
def b141(spark, d):
    return cmp(spark, d).select("model", "prediction_id", "match_source", F.col("t.row_id").alias("truth_row"), "location_match", "furniture_match", "tag_jaccard", F.col("time_error").cast("long").alias("time_error"), F.col("clock_error").cast("long").alias("clock_error"))


@query("b142_coverage_table", sql("SELECT model, status, count(*) AS n FROM (SELECT k.event_key, m.model, CASE WHEN c.event_key IS NOT NULL THEN 'success' WHEN f.event_key IS NOT NULL THEN 'failed' ELSE 'missing' END AS status FROM (SELECT DISTINCT event_key FROM an) k CROSS JOIN (SELECT DISTINCT model FROM mp) m LEFT JOIN (SELECT DISTINCT model, event_key FROM mp WHERE prediction_id % 3 <> 0) c ON c.model = m.model AND c.event_key = k.event_key LEFT JOIN (SELECT DISTINCT model, event_key FROM mp WHERE prediction_id % 3 = 0) f ON f.model = m.model AND f.event_key = k.event_key) GROUP BY ALL", **CMP))
def b142(spark, d):
    p = model_predictions(spark, d)
    out = X.coverage_table(QQ.annotations(spark, d), p.filter("prediction_id % 3 <> 0"), p.filter("prediction_id % 3 = 0"))
    return out.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


@query("b143_comparison_metrics", sql(f"SELECT model, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT model, {_MET} FROM cm GROUP BY model) ON * EXCLUDE (model) INTO NAME metric VALUE value)", **CMP))
def b143(spark, d):
    return X.comparison_metrics(cmp(spark, d)).withColumn("value", F.round("value", 6))


@query("b144_model_metrics", sql(f"SELECT scope, model, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT scope, model, {_MET} FROM (SELECT 'full' AS scope, * FROM cm UNION ALL SELECT 'common_overlap', * FROM cm SEMI JOIN ck USING (event_key)) GROUP BY ALL) ON * EXCLUDE (scope, model) INTO NAME metric VALUE value)", **CMP))
def b144(spark, d):
    return X.model_metrics(cmp(spark, d)).withColumn("value", F.round("value", 6))


@query("b145_overlap_wide", sql("SELECT event_key, arg_min(prefall_location, prediction_id) FILTER (model = 'model_1') AS model_1, arg_min(prefall_location, prediction_id) FILTER (model = 'model_2') AS model_2, arg_min(prefall_location, prediction_id) FILTER (model = 'model_3') AS model_3 FROM cm SEMI JOIN ck USING (event_key) GROUP BY event_key", **CMP))
def b145(spark, d):
    return X.overlap_wide(cmp(spark, d), ["model_1", "model_2", "model_3"])


_FILE = "replace(replace(event_key, '|', '_'), ':', '-')"
#: Records of the three models, a third of them errors, with files of all kinds of names.
_RECORDS = f"""SELECT *, CASE WHEN regexp_matches(file, '^[0-9]+_') THEN event_key END AS found FROM (SELECT model, prediction_id, event_key, CASE prediction_id % 4 WHEN 0 THEN {_FILE} || '.mp4' WHEN 1 THEN {_FILE} WHEN 2 THEN 'clip-' || {_FILE} ELSE {_FILE} || '.m4v' END AS file, CASE WHEN prediction_id % 3 = 0 THEN 'timeout' END AS error FROM mp)"""
_STATUSES = "SELECT event_key, arg_min(status, list_position(['accepted_nonfall', 'excluded_bad_or_no_video', 'excluded_no_signal', 'excluded_offscreen', 'included_fall'], status)) AS status FROM an GROUP BY event_key"
_KEYS = {"rc": _RECORDS, "ts": _STATUSES}


def records(spark, d):
    p = model_predictions(spark, d)
    name, i = F.translate("event_key", "|:", "_-"), F.pmod("prediction_id", F.lit(4))
    file = F.when(i == 0, F.concat(F.lit("videos/"), name, F.lit(".mp4"))).when(i == 1, name).when(i == 2, F.concat(F.lit("clip-"), name)).otherwise(F.concat(name, F.lit(".m4v ")))
    return X.load_results(p.select("model", file.alias("file"), F.when(F.col("prediction_id") % 3 == 0, "timeout").alias("error")))


def successes(spark, d):
    return cmp(spark, d).filter("prediction_id % 3 <> 0")


@query("b140_load_results", sql("SELECT model, found AS event_key, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS record_status, count(*) AS n FROM rc GROUP BY ALL", **CMP, **_KEYS))
def b140_results(spark, d):
    return records(spark, d).groupBy("model", "event_key", "record_status").agg(F.count(F.lit(1)).alias("n"))


@query("b140_load_predictions", sql("""SELECT model, prediction_id, event_key, prediction_id % 5 IN (0, 1, 4) AS fall_detected, CASE WHEN fall_seconds IS NOT NULL AND prediction_id % 7 <> 0 THEN fall_seconds::DOUBLE END AS fall_time_seconds, array_to_string(tags, '+') AS tags FROM mp""", **CMP))
def b140(spark, d):
    p, i = model_predictions(spark, d), F.pmod("prediction_id", F.lit(5))
    said = F.when(i == 0, "True").when(i == 1, " yes").when(i == 2, "no").when(i == 4, "1")
    raw = p.select(
        "model", "prediction_id", F.concat(F.translate("event_key", "|:", "_-"), F.lit(".mp4")).alias("file"), said.alias("fall_detected"), F.when(F.col("prediction_id") % 7 == 0, "n/a").otherwise(F.col("fall_seconds").cast("string")).alias("fall_time_seconds"),
        F.when(F.size("tags") == 0, F.when(i == 0, "none").when(i == 1, "")).otherwise(F.array_join("tags", " | ")).alias("fall_tags"),
    )
    out = X.load_predictions(raw)
    return out.select("model", "prediction_id", "event_key", "fall_detected", "fall_time_seconds", F.array_join("tags", "+").alias("tags"))


@query("b142_failure_table", sql("SELECT t.event_key, t.status, e.model, e.error, count(*) AS n FROM ts t LEFT JOIN (SELECT * FROM rc WHERE error IS NOT NULL) e ON e.found = t.event_key WHERE t.event_key NOT IN (SELECT event_key FROM mp WHERE prediction_id % 3 <> 0) GROUP BY ALL", **CMP, **_KEYS))
def b142_failures(spark, d):
    f = X.failure_table(QQ.annotations(spark, d), records(spark, d), successes(spark, d))
    return f.groupBy("event_key", "status", "model", "error").agg(F.count(F.lit(1)).alias("n"))


_COVER = """SELECT m.model, scope, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT ok) AS missing, any_value((SELECT count(*) FROM (SELECT event_key FROM mp WHERE prediction_id % 3 <> 0 GROUP BY event_key HAVING count(DISTINCT model) = 3))) AS overlap FROM
  (SELECT m.model, t.event_key, t.status, EXISTS (SELECT 1 FROM mp p WHERE p.model = m.model AND p.event_key = t.event_key AND p.prediction_id % 3 <> 0) AS ok, EXISTS (SELECT 1 FROM rc r WHERE r.model = m.model AND r.found = t.event_key AND r.error IS NOT NULL) AS bad FROM ts t, (SELECT DISTINCT model FROM mp) m) m, LATERAL (SELECT unnest([m.status, 'all']) AS scope) GROUP BY ALL"""


@query("b145_model_coverage", sql(_COVER, **CMP, **_KEYS))
def b145_coverage(spark, d):
    return X.model_coverage(QQ.annotations(spark, d), successes(spark, d), records(spark, d), ["model_1", "model_2", "model_3"])


@query("b145_event_long", sql("""SELECT c.model, c.prediction_id, ts.status, c.event_key IN (SELECT event_key FROM mp WHERE prediction_id % 3 <> 0 GROUP BY event_key HAVING count(DISTINCT model) = 3) AS in_overlap, ts.status IN ('included_fall', 'accepted_nonfall') AS visible_primary, ts.status NOT IN ('included_fall', 'accepted_nonfall') AS diagnostic_only
  FROM mp c JOIN ts ON c.event_key = ts.event_key WHERE prediction_id % 3 <> 0""", **CMP, **_KEYS))  # fmt: skip
def b145_long(spark, d):
    return X.event_long(QQ.annotations(spark, d), successes(spark, d)).select("model", "prediction_id", "status", "in_overlap", "visible_primary", "diagnostic_only")


@query("b146_detection_confusion", sql("SELECT model, count(*) FILTER (t.fall_seconds IS NOT NULL AND fall_seconds IS NOT NULL) AS tp, count(*) FILTER (t.fall_seconds IS NULL AND fall_seconds IS NOT NULL) AS fp, count(*) FILTER (t.fall_seconds IS NOT NULL AND fall_seconds IS NULL) AS fn, count(*) FILTER (t.fall_seconds IS NULL AND fall_seconds IS NULL) AS tn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity FROM cm GROUP BY model", **CMP))
def b146(spark, d):
    return X.detection_confusion(cmp(spark, d))


@query("b146_location_confusion", sql("SELECT model, t.prefall_location AS truth, prefall_location AS predicted, count(*) AS n FROM cm GROUP BY ALL", **CMP))
def b146_location(spark, d):
    return X.location_confusion(cmp(spark, d))


@query("b146_false_negative_tags", sql("SELECT model, tag, count(*) AS n FROM (SELECT model, unnest(t.tags) AS tag FROM cm WHERE t.fall_seconds IS NOT NULL AND fall_seconds IS NULL) GROUP BY ALL", **CMP))
def b146_tags(spark, d):
    return X.false_negative_tags(cmp(spark, d))
