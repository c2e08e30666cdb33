"""Queries over truth, matching and label quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.config import STATES
from tideline.operators import evaluate as EV
from tideline.operators import quality as Q
from tideline.plans.standins import events, load, sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def scored(spark, d):
    """Events as scored sequences: truth by kind, probabilities from k and value, latencies in some."""
    e = events(spark, d).filter("event_type <> 'error'")
    truth = F.when(F.col("event_type") == "click", "chair").when(F.col("event_type") == "view", "bed").when(F.col("event_type") == "purchase", "room").otherwise("no_patient")
    e = e.withColumn("truth", truth)
    bump = lambda s: F.when((F.col("truth") == s) & (F.col("event_id") % 3 != 0), 12).otherwise(0)
    w = {s: 1 + F.pmod(F.col("k") * m, F.lit(10)) + bump(s) for s, m in zip(STATES, (1, 3, 7, 9), strict=True)}
    total = sum(w.values(), F.lit(0))
    e = e.withColumns({f"prob_{s}": c / total for s, c in w.items()})
    latency = F.when(F.col("k") % 4 != 0, F.floor("value"))
    return e.withColumn("derived", Q.argmax([f"prob_{s}" for s in STATES])).withColumn("truth_latency", latency).withColumn("predicted_latency", F.when(F.col("k") % 5 != 0, F.floor(F.col("value")) + F.col("k") % 7))


SC = {
    "w": """SELECT *, CASE event_type WHEN 'click' THEN 'chair' WHEN 'view' THEN 'bed' WHEN 'purchase' THEN 'room' ELSE 'no_patient' END AS truth, CASE WHEN event_id % 3 <> 0 THEN 12 ELSE 0 END AS b,
      1 + k % 10 + CASE truth WHEN 'chair' THEN b ELSE 0 END AS w1, 1 + k * 3 % 10 + CASE truth WHEN 'bed' THEN b ELSE 0 END AS w2, 1 + k * 7 % 10 + CASE truth WHEN 'room' THEN b ELSE 0 END AS w3, 1 + k * 9 % 10 + CASE truth WHEN 'no_patient' THEN b ELSE 0 END AS w4 FROM ev WHERE event_type <> 'error'""",
    "sc": """SELECT event_id, monitor_id, truth, w1 / (w1 + w2 + w3 + w4) AS prob_chair, w2 / (w1 + w2 + w3 + w4) AS prob_bed, w3 / (w1 + w2 + w3 + w4) AS prob_room, w4 / (w1 + w2 + w3 + w4) AS prob_no_patient,
      CASE greatest(w1, w2, w3, w4) WHEN w1 THEN 'chair' WHEN w2 THEN 'bed' WHEN w3 THEN 'room' ELSE 'no_patient' END AS derived, CASE WHEN k % 4 <> 0 THEN floor(value)::BIGINT END AS truth_latency, CASE WHEN k % 5 <> 0 THEN floor(value)::BIGINT + k % 7 END AS predicted_latency FROM w""",
    "st": "SELECT unnest(['chair', 'bed', 'room', 'no_patient']) AS label",
    "lm": """SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (derived = label) AS predicted, count(*) FILTER (truth = label AND derived = label) AS tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM sc, st GROUP BY label""",
    "lo": "SELECT label AS target_class, (truth = label)::INT AS y, CASE label WHEN 'chair' THEN prob_chair WHEN 'bed' THEN prob_bed WHEN 'room' THEN prob_room ELSE prob_no_patient END AS score FROM sc, st",
}


@query("b98_confusion_matrix", sql("SELECT t.label AS truth, d.label AS derived, count(sc.event_id) AS n FROM st t CROSS JOIN st d LEFT JOIN sc ON sc.truth = t.label AND sc.derived = d.label GROUP BY ALL", **SC))
def b98(spark, d):
    return Q.confusion_matrix(scored(spark, d))


@query("b99_classification_metrics", sql("UNPIVOT (SELECT (SELECT count(*) FROM sc)::DOUBLE AS scored_sequences, (SELECT round(avg((truth = derived)::INT), 6) FROM sc) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM lm) ON COLUMNS(*) INTO NAME metric VALUE value", **SC))
def b99(spark, d):
    return Q.classification_metrics(scored(spark, d))


@query("b100_label_metrics", sql("SELECT * FROM lm", **SC))
def b100(spark, d):
    return Q.label_metrics(scored(spark, d))


@query("b101_probability_quality", sql("""UNPIVOT (SELECT (SELECT round(avg(-ln(CASE truth WHEN 'chair' THEN prob_chair WHEN 'bed' THEN prob_bed WHEN 'room' THEN prob_room ELSE prob_no_patient END)), 6) FROM sc) AS log_loss,
  (SELECT round(avg((power(prob_chair - (truth = 'chair')::INT, 2) + power(prob_bed - (truth = 'bed')::INT, 2) + power(prob_room - (truth = 'room')::INT, 2) + power(prob_no_patient - (truth = 'no_patient')::INT, 2)) / 4), 6) FROM sc) AS brier_score,
  (SELECT round(sum(abs(c - h) * n) / sum(n), 6) FROM (SELECT avg(x) AS c, avg((truth = derived)::INT) AS h, count(*) AS n FROM (SELECT *, greatest(prob_chair, prob_bed, prob_room, prob_no_patient) AS x FROM sc) GROUP BY (SELECT count(*) FROM (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edge) WHERE edge <= x))) AS ece) ON COLUMNS(*) INTO NAME metric VALUE value""", **SC))  # fmt: skip
def b101(spark, d):
    return Q.probability_quality(scored(spark, d))


@query("b102_auc_summary", sql("""SELECT target_class, round(sum((fpr - coalesce(lf, 0)) * (tpr + coalesce(lt, 0)) / 2), 6) AS roc_auc, round(sum((tpr - coalesce(lt, 0)) * (prec + coalesce(lp, pos / total)) / 2), 6) AS pr_auc, max(pos)::BIGINT AS support FROM
  (SELECT *, lag(fpr) OVER o AS lf, lag(tpr) OVER o AS lt, lag(prec) OVER o AS lp FROM (SELECT *, tp / pos AS tpr, (a - tp) / (total - pos) AS fpr, tp / a AS prec FROM
    (SELECT target_class, score, sum(p) OVER (PARTITION BY target_class ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY target_class ORDER BY score DESC) AS a, sum(p) OVER (PARTITION BY target_class) AS pos, sum(n) OVER (PARTITION BY target_class) AS total
      FROM (SELECT target_class, score, sum(y) AS p, count(*) AS n FROM lo GROUP BY ALL))) WINDOW o AS (PARTITION BY target_class ORDER BY score DESC)) GROUP BY target_class""", **SC))  # fmt: skip
def b102(spark, d):
    return Q.auc_summary(scored(spark, d))


_SWEEP = """SELECT target_class, i / 100 AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1, 6) AS j_stat, tp, fp, tn, fn
  FROM (SELECT target_class, i, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 0 AND NOT hit) AS tn, count(*) FILTER (y = 1 AND NOT hit) AS fn FROM (SELECT *, floor(round(score * 100, 9)) >= i AS hit FROM lo, (SELECT unnest(range(101)) AS i)) GROUP BY ALL)"""


@query("b103_threshold_sweep", sql(_SWEEP, **SC))
def b103(spark, d):
    return Q.threshold_sweep(scored(spark, d))


@query("b104_calibration_curve", sql("""SELECT g.label AS target_class, g.bin_id, round(avg(score), 6) AS avg_confidence, round(avg(y), 6) AS empirical_accuracy, count(y) AS n FROM (SELECT label, unnest(range(10))::BIGINT AS bin_id FROM st) g
  LEFT JOIN (SELECT *, (SELECT count(*) FROM (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edge) WHERE edge <= score) AS b FROM lo) x ON x.target_class = g.label AND x.b = g.bin_id GROUP BY ALL""", **SC))  # fmt: skip
def b104(spark, d):
    return Q.calibration_curve(scored(spark, d))


@query("b105_operating_point", sql("SELECT target_class, threshold, precision, recall, f1, balanced_accuracy, j_stat FROM sw QUALIFY row_number() OVER (PARTITION BY target_class ORDER BY f1 DESC, balanced_accuracy DESC, abs(precision - recall), threshold) = 1", **SC, sw=_SWEEP))
def b105(spark, d):
    return Q.operating_point(Q.threshold_sweep(scored(spark, d)))


_RESP = """UNPIVOT (SELECT n::DOUBLE AS scored_sequences, round(tp / p, 6) AS detection_precision, round(tp / s, 6) AS detection_recall, round(2 * tp / (p + s), 6) AS detection_f1, round(mae, 6) AS latency_mae_seconds, round(p50, 6) AS latency_p50_seconds, round(p90, 6) AS latency_p90_seconds
  FROM (SELECT count(*) AS n, count(*) FILTER (truth_latency IS NOT NULL AND predicted_latency IS NOT NULL) AS tp, count(predicted_latency) AS p, count(truth_latency) AS s, avg(abs(predicted_latency - truth_latency)) AS mae, quantile_cont(abs(predicted_latency - truth_latency), 0.5) AS p50, quantile_cont(abs(predicted_latency - truth_latency), 0.9) AS p90 FROM sc)) ON COLUMNS(*) INTO NAME metric VALUE value"""


@query("b106_response_metrics", sql(_RESP, **SC))
def b106(spark, d):
    return Q.response_metrics(scored(spark, d))


@query("b110_signal_profile", sql("SELECT truth, count(*) AS n, round(avg(prob_chair), 6) AS mean_chair, round(avg(prob_bed), 6) AS mean_bed, round(avg(prob_room), 6) AS mean_room, round(avg(prob_no_patient), 6) AS mean_no_patient, round(avg((truth = derived)::INT), 6) AS hit_rate, round(avg((truth_latency IS NOT NULL)::INT), 4) AS truth_detect_rate, round(avg((predicted_latency IS NOT NULL)::INT), 4) AS derived_detect_rate, round(avg(truth_latency), 4) AS mean_truth_latency, round(avg(predicted_latency), 4) AS mean_derived_latency FROM sc GROUP BY truth", **SC))
def b110(spark, d):
    return Q.signal_profile(scored(spark, d))


_BINNED = "SELECT sum(abs(c - h) * n) / sum(n) AS ece FROM (SELECT least(floor(greatest(prob_chair, prob_bed, prob_room, prob_no_patient) * 10 + 1e-9), 9) AS b, count(*) AS n, avg(greatest(prob_chair, prob_bed, prob_room, prob_no_patient)) AS c, avg((truth = derived)::INT) AS h FROM sc GROUP BY b)"
_DETECT = "SELECT count(*) FILTER (truth_latency IS NOT NULL AND predicted_latency IS NOT NULL) AS tp, count(predicted_latency) AS p, count(truth_latency) AS s, avg(abs(predicted_latency - truth_latency)) AS mae FROM sc"


@query("b111_threshold_checks", sql("""SELECT "check", operator, threshold, actual, CASE operator WHEN '>=' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM (SELECT 'macro_f1' AS "check", '>=' AS operator, 0.55::DOUBLE AS threshold, (SELECT round(avg(f1), 6) FROM lm) AS actual
  UNION ALL SELECT 'ece_10_bin', '<=', 0.15, (SELECT round(ece, 6) FROM bn) UNION ALL SELECT 'response_detection_f1', '>=', 0.7, (SELECT round(2 * (tp / p) * (tp / s) / (tp / p + tp / s), 6) FROM de) UNION ALL SELECT 'response_latency_mae_seconds', '<=', 45, (SELECT round(mae, 6) FROM de))""", **SC, bn=_BINNED, de=_DETECT))  # fmt: skip
def b111(spark, d):
    s = scored(spark, d)
    return Q.threshold_checks(Q.classification_metrics(s).unionByName(Q.probability_quality(s)).unionByName(Q.response_metrics(s)))


def raw_annotations(spark, d):
    """Events as annotations; a key is a unit and a day."""
    e = events(spark, d)
    k = F.col("k")
    place = F.when(F.col("event_type") == "click", " Chair").when(F.col("event_type") == "view", "bed").when(F.col("event_type") == "purchase", "OTHER").when(F.col("event_type") == "signup", "room").otherwise("unknown")
    clock = lambda shift: F.date_format(F.timestamp_micros(F.unix_micros("ts") + shift * F.lit(1_000_000)), "HH:mm:ss")
    kinds = ("slip, Footrest", "trip,trip ", "No Fall, slip", "bad video", "off_screen", "support_bed, slip", "footrest", "", "nan", "trip, support_bed")
    tags = F.lit("")
    for i, t in enumerate(kinds):
        tags = F.when(k % 10 == i, t).otherwise(tags)
    return e.select(
        F.col("event_id").alias("row_id"), F.concat_ws("|", F.col("monitor_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.lit("00:00")).alias("event_key"), place.alias("prefall_location"),
        F.when(k % 6 == 0, "chair").when(k % 6 == 1, "Bed ").when(k % 6 == 2, "floor").when(k % 6 == 3, "").alias("last_furniture"),
        F.when(k % 9 != 0, clock(F.lit(0))).otherwise("25:00:00").alias("fall_time"), F.when(k % 4 != 0, clock(k)).alias("response_time"), F.when(k % 3 != 0, clock(-(k % 40))).alias("departure_time"), tags.alias("fall_tags"),
    )


def annotations(spark, d):
    raw = raw_annotations(spark, d)
    demote = events(spark, d).filter("k = 77").select(F.concat_ws("|", F.col("monitor_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.lit("00:00")).alias("event_key"))
    return Q.prepare_annotations(raw, demote)


AN = {
    "an0": """SELECT event_id AS row_id, monitor_id || '|' || strftime(ts, '%Y-%m-%d') || '|00:00' AS event_key, k, CASE event_type WHEN 'click' THEN 'chair' WHEN 'view' THEN 'bed' WHEN 'purchase' THEN 'room' WHEN 'signup' THEN 'room' ELSE 'no_patient' END AS prefall_location,
      CASE k % 6 WHEN 0 THEN 'chair' WHEN 1 THEN 'bed' WHEN 2 THEN 'floor' END AS last_furniture, epoch_us(ts) // 1000000 % 86400 AS s,
      CASE k % 10 WHEN 0 THEN ['footrest', 'slip'] WHEN 1 THEN ['trip'] WHEN 2 THEN ['no_fall', 'slip'] WHEN 3 THEN ['bad_video'] WHEN 4 THEN ['offscreen'] WHEN 5 THEN ['slip', 'support_bed'] WHEN 6 THEN ['footrest'] WHEN 9 THEN ['support_bed', 'trip'] ELSE []::VARCHAR[] END AS tags FROM ev""",
    "an1": "SELECT *, CASE WHEN k % 9 <> 0 THEN s END AS fall_seconds, CASE WHEN k % 4 <> 0 THEN (s + k) % 86400 END AS response_seconds, CASE WHEN k % 3 <> 0 THEN (s - k % 40 + 86400) % 86400 END AS departure_seconds FROM an0",
    "an": """SELECT *, CASE WHEN list_contains(tags, 'no_fall') THEN 'accepted_nonfall' WHEN list_contains(tags, 'bad_video') THEN 'excluded_bad_or_no_video' WHEN list_contains(tags, 'offscreen') OR fall_seconds IS NULL THEN 'excluded_offscreen'
      WHEN event_key IN (SELECT event_key FROM an0 WHERE k = 77) THEN 'excluded_no_signal' ELSE 'included_fall' END AS status FROM an1""",
    "sq": """SELECT *, row_number() OVER o AS event_instance_ordinal, count(response_seconds) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS sequence_ordinal, event_key || '#S' || lpad(sequence_ordinal::VARCHAR, 2, '0') AS sequence_id
      FROM an WHERE status IN ('included_fall', 'excluded_offscreen') WINDOW o AS (PARTITION BY event_key ORDER BY fall_seconds NULLS LAST, response_seconds NULLS LAST, row_id)""",
    "tr": """SELECT *, (response_seconds - fall_seconds + 86400) % 86400 AS response_latency, (fall_seconds - departure_seconds + 86400) % 86400 AS departure_latency,
      coalesce(prefall_location = 'room' AND last_furniture IN ('chair', 'bed') AND (fall_seconds - departure_seconds + 86400) % 86400 < 10, false) AS relabelled, CASE WHEN relabelled THEN last_furniture WHEN status = 'excluded_offscreen' THEN 'no_patient' ELSE prefall_location END AS truth_label,
      CASE WHEN prefall_location = 'chair' THEN 'direct_chair' WHEN prefall_location = 'bed' THEN 'direct_bed' WHEN last_furniture IS NOT NULL THEN last_furniture || '_origin_room' ELSE 'unknown_origin_room' END AS chain FROM sq""",
}


def truth(spark, d):
    return Q.truth_instances(annotations(spark, d))


@query("b88_prepare_annotations", sql("SELECT row_id, prefall_location, last_furniture, array_to_string(tags, ',') AS tags, fall_seconds::INT AS fall_seconds, response_seconds::INT AS response_seconds, status FROM an", **AN))
def b88(spark, d):
    return annotations(spark, d).select("row_id", "prefall_location", "last_furniture", F.array_join("tags", ",").alias("tags"), "fall_seconds", "response_seconds", "status")


@query("b89_assign_sequences", sql("SELECT row_id, event_instance_ordinal, sequence_ordinal, sequence_id FROM sq", **AN))
def b89(spark, d):
    return truth(spark, d).select("row_id", "event_instance_ordinal", "sequence_ordinal", "sequence_id")


@query("b90_adjudication_table", sql("""SELECT coalesce(status, 'all') AS scope, count(*) AS annotations_full, count(DISTINCT event_key) AS events_full, count(*) FILTER (w) AS annotations_window, count(DISTINCT event_key) FILTER (w) AS events_window
  FROM (SELECT *, event_key[-16:-7] BETWEEN '2024-01-08' AND '2024-01-20' AS w FROM an) GROUP BY ROLLUP (status)""", **AN))  # fmt: skip
def b90(spark, d):
    return Q.adjudication_table(annotations(spark, d), "2024-01-08", "2024-01-20")


@query("b91_truth_policy", sql("SELECT truth_label, relabelled, count(*) AS n FROM tr GROUP BY ALL", **AN))
def b91(spark, d):
    return truth(spark, d).groupBy("truth_label", "relabelled").agg(F.count(F.lit(1)).alias("n"))


@query("b92_truth_instances", sql("SELECT row_id, sequence_id, response_latency::INT AS response_latency, departure_latency::INT AS departure_latency, truth_label, chain FROM tr", **AN))
def b92(spark, d):
    return truth(spark, d).select("row_id", "sequence_id", "response_latency", "departure_latency", "truth_label", "chain")


@query("b93_origin_summary", sql("SELECT chain, count(*) AS event_count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tr), 1) AS pct_of_events FROM tr GROUP BY chain", **AN))
def b93(spark, d):
    return Q.origin_summary(truth(spark, d))


@query("b94_departure_latency", sql("SELECT last_furniture, count(*) AS n_events, round(quantile_cont(departure_latency, 0.5), 1) AS median, round(avg(departure_latency), 1) AS mean, round(quantile_cont(departure_latency, 0.25), 1) AS p25, round(quantile_cont(departure_latency, 0.75), 1) AS p75, min(departure_latency)::INT AS least, max(departure_latency)::INT AS most FROM tr WHERE departure_latency IS NOT NULL AND last_furniture IS NOT NULL GROUP BY last_furniture", **AN))
def b94(spark, d):
    return Q.departure_latency(truth(spark, d))


@query("b95_tag_chain_crosstab", sql("SELECT chain, tag, n AS count, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY chain), 1) AS pct_within_chain, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS pct_global FROM (SELECT chain, tag, count(*) AS n FROM (SELECT chain, unnest(tags) AS tag FROM tr) GROUP BY ALL)", **AN))
def b95(spark, d):
    return Q.tag_chain_crosstab(truth(spark, d))


_PRED = "SELECT event_id AS prediction_id, monitor_id || '|' || strftime(ts, '%Y-%m-%d') || '|00:00' AS event_key, row_number() OVER (PARTITION BY monitor_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS ordinal FROM ev WHERE event_type = 'click'"
_MATCH = """SELECT t.row_id, t.event_key, t.event_instance_ordinal AS ordinal, coalesce(x.prediction_id, n.prediction_id) AS prediction_id, CASE WHEN x.prediction_id IS NOT NULL THEN 'exact' WHEN n.c = 1 THEN 'single_event_key_fallback' WHEN n.c > 1 THEN 'nearest_ordinal_fallback' ELSE 'unmatched' END AS match_source
  FROM tr t LEFT JOIN pd x ON t.event_key = x.event_key AND t.event_instance_ordinal = x.ordinal LEFT JOIN (SELECT t.row_id, arg_min(p.prediction_id, (abs(p.ordinal - t.event_instance_ordinal), p.ordinal)) AS prediction_id, count(*) AS c FROM tr t JOIN pd p USING (event_key) GROUP BY t.row_id) n ON n.row_id = t.row_id"""


def predictions(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).filter("event_type = 'click'")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(F.col("event_id").alias("prediction_id"), F.concat_ws("|", F.col("monitor_id").cast("string"), day, F.lit("00:00")).alias("event_key"), F.row_number().over(Window.partitionBy("monitor_id", day).orderBy("ts", "event_id")).alias("ordinal"))


@query("b96_match_truth", sql(_MATCH, **AN, pd=_PRED))
def b96(spark, d):
    return Q.match_truth(truth(spark, d), predictions(spark, d))


_SEQ = """SELECT sequence_id, truth_label, instances, truth_latency, predicted_latency, t > 0 AS scored, round(CASE WHEN t > 0 THEN c / t ELSE 0 END, 9) AS prob_chair, round(CASE WHEN t > 0 THEN b / t ELSE 0 END, 9) AS prob_bed,
  CASE WHEN t = 0 THEN 'no_patient' WHEN c / t >= greatest(c, b, r, n) / t - 1e-9 THEN 'chair' WHEN b / t >= greatest(c, b, r, n) / t - 1e-9 THEN 'bed' WHEN r / t >= greatest(c, b, r, n) / t - 1e-9 THEN 'room' ELSE 'no_patient' END AS derived
  FROM (SELECT sequence_id, arg_max(truth_label, event_instance_ordinal) AS truth_label, count(*) AS instances, min(response_latency)::INT AS truth_latency, min(s.predicted_latency)::BIGINT AS predicted_latency, coalesce(sum(prob_chair), 0) AS c, coalesce(sum(prob_bed), 0) AS b, coalesce(sum(prob_room), 0) AS r, coalesce(sum(prob_no_patient), 0) AS n, c + b + r + n AS t
    FROM tr JOIN m USING (row_id) LEFT JOIN sc s ON s.event_id = m.prediction_id GROUP BY sequence_id)"""


@query("b97_sequence_predictions", sql(_SEQ, **SC, **AN, pd=_PRED, m=_MATCH))
def b97(spark, d):
    t = truth(spark, d)
    m = Q.match_truth(t, predictions(spark, d)).select("row_id", "prediction_id")
    s = scored(spark, d).select(F.col("event_id").alias("prediction_id"), *[f"prob_{x}" for x in STATES], "predicted_latency")
    out = Q.sequence_predictions(t.join(m, "row_id").join(s, "prediction_id", "left"))
    return out.select("sequence_id", "truth_label", "instances", "truth_latency", "predicted_latency", "scored", F.round("prob_chair", 9).alias("prob_chair"), F.round("prob_bed", 9).alias("prob_bed"), "derived")


@query("b107_population_stats", sql("""UNPIVOT (SELECT count(*)::DOUBLE AS truth_rows, count(DISTINCT event_key)::DOUBLE AS truth_unique_event_keys, count(DISTINCT split_part(event_key, '|', 1))::DOUBLE AS truth_unique_monitors, (count(DISTINCT split_part(event_key, '|', 1)) = 150)::INT::DOUBLE AS truth_monitor_count_matches_expectation,
  count(*) FILTER (status = 'excluded_offscreen')::DOUBLE AS truth_offscreen_rows, count(*) FILTER (truth_label = 'chair')::DOUBLE AS truth_label_count_chair, count(*) FILTER (truth_label = 'bed')::DOUBLE AS truth_label_count_bed, count(*) FILTER (truth_label = 'room')::DOUBLE AS truth_label_count_room, count(*) FILTER (truth_label = 'no_patient')::DOUBLE AS truth_label_count_no_patient,
  (SELECT count(*) FROM sqs)::DOUBLE AS sequence_count, (SELECT count(*) FROM sqs WHERE o)::DOUBLE AS sequence_offscreen_count, (SELECT round(avg(n), 6) FROM sqs) AS sequence_mean_instances, (SELECT count(*) FROM sqs WHERE NOT o)::DOUBLE AS sequence_scored_for_location, (SELECT count(*) FROM sqs WHERE NOT o AND f IS NOT NULL)::DOUBLE AS sequence_scored_for_response FROM tr)
  ON COLUMNS(*) INTO NAME metric VALUE value""", **AN, sqs="SELECT sequence_id, count(*) AS n, bool_or(status = 'excluded_offscreen') AS o, min(fall_seconds) AS f FROM tr GROUP BY sequence_id"))  # fmt: skip
def b107(spark, d):
    return Q.population_stats(truth(spark, d), 150)


_PAIRS = """SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY tag)::BIGINT AS n_tag FROM (SELECT label, tag, count(*) AS n FROM (SELECT p_type AS label, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY label, tag)) WHERE n_tag >= 3"""


def part_tags(spark, d):
    return Q.tag_association(load(spark, d, "part").withColumn("tags", F.split("p_name", " ")), "p_type", "tags")


@query("b108_tag_association", sql("SELECT label, tag, n, sum(n) OVER (PARTITION BY label)::BIGINT AS n_label, n_tag, round(n / sum(n) OVER (PARTITION BY label), 4) AS pct_of_label, round(n_tag / sum(n) OVER (), 4) AS pct_global, round((n / sum(n) OVER (PARTITION BY label)) / (n_tag / sum(n) OVER ()), 4) AS lift FROM pr", pr=_PAIRS))
def b108(spark, d):
    return part_tags(spark, d)


@query("b109_cramers_v", sql("""SELECT sqrt(greatest(0, (q - n) / n - (k - 1) * (r - 1) / (n - 1)) / (least(k - power(k - 1, 2) / (n - 1), r - power(r - 1, 2) / (n - 1)) - 1)) AS cramers_v FROM
  (SELECT sum(n) AS n, sum(n * n / e) AS q, count(DISTINCT label) AS r, count(DISTINCT tag) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY label) * sum(n) OVER (PARTITION BY tag) / sum(n) OVER () AS e FROM pr))""", pr=_PAIRS))  # fmt: skip
def b109(spark, d):
    return Q.cramers_v(part_tags(spark, d))


_ASSOC = """SELECT (SELECT count(*) FROM tr)::DOUBLE AS truth_rows, (SELECT max(n) FROM (SELECT count(*) AS n FROM tr GROUP BY truth_label))::DOUBLE AS top_truth_location_count, round((SELECT max(n) FROM (SELECT count(*) AS n FROM tr GROUP BY truth_label)) / (SELECT count(*) FROM tr), 6) AS top_truth_location_share,
  (SELECT sum(n) FROM pr)::DOUBLE AS tag_annotations_total, (SELECT count(DISTINCT tag) FROM pr)::DOUBLE AS distinct_tags_retained, (SELECT round(cramers_v, 6) FROM (SELECT sqrt(greatest(0, (q - n) / n - (k - 1) * (r - 1) / (n - 1)) / (least(k - power(k - 1, 2) / (n - 1), r - power(r - 1, 2) / (n - 1)) - 1)) AS cramers_v FROM
  (SELECT sum(n) AS n, sum(n * n / e) AS q, count(DISTINCT label) AS r, count(DISTINCT tag) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY label) * sum(n) OVER (PARTITION BY tag) / sum(n) OVER () AS e FROM pr)))) AS tag_location_cramers_v,
  (SELECT count(DISTINCT truth) FROM sc)::DOUBLE AS signal_profile_rows, (SELECT round(avg(h), 6) FROM (SELECT round(round(avg((truth = derived)::INT), 6), 4) AS h FROM sc GROUP BY truth)) AS signal_profile_mean_accuracy"""


@query("b110_association_summary", sql(f"UNPIVOT ({_ASSOC}) ON COLUMNS(*) INTO NAME metric VALUE value", **SC, **AN, pr=_PAIRS))
def b110_summary(spark, d):
    return Q.association_summary(truth(spark, d), part_tags(spark, d), Q.signal_profile(scored(spark, d)))


_TAX = """SELECT event_key, arg_min(prefall_location, (p, row_id)) AS prefall_location, arg_min(m, (p, row_id)) AS mechanism, count(*) AS annotations, CASE WHEN arg_min(prefall_location, (p, row_id)) IN ('room', 'no_patient') THEN coalesce(arg_min(coalesce(last_furniture, ''), (p, row_id)), '') END AS own,
  arg_min(last_furniture, row_id) FILTER (last_furniture IS NOT NULL) AS first_known
  FROM (SELECT *, CASE WHEN prefall_location = 'chair' AND list_contains(tags, 'footrest') THEN 'footrest_positioning' WHEN list_contains(tags, 'support_bed') THEN 'transfer_failure' ELSE 'other' END AS m, CASE m WHEN 'footrest_positioning' THEN 0 WHEN 'transfer_failure' THEN 1 ELSE 2 END AS p FROM an) GROUP BY event_key"""


@query("b113_mechanism_taxonomy", sql("SELECT event_key, prefall_location, mechanism, annotations, CASE WHEN own IS NULL THEN NULL WHEN own <> '' THEN own ELSE first_known END AS last_furniture FROM tx", **AN, tx=_TAX))
def b113(spark, d):
    return Q.mechanism_taxonomy(annotations(spark, d))


@query("b147_mechanism_crosstab", sql("SELECT mechanism, count(*) FILTER (prefall_location = 'chair') AS chair, count(*) FILTER (prefall_location = 'bed') AS bed, count(*) FILTER (prefall_location = 'room') AS room, count(*) FILTER (prefall_location = 'no_patient') AS no_patient, 0::BIGINT AS unknown, count(*) AS total, round(100.0::DOUBLE * chair / sum(count(*) FILTER (prefall_location = 'chair')) OVER (), 1) AS pct_of_chair FROM tx GROUP BY mechanism", **AN, tx=_TAX))
def b147(spark, d):
    return Q.mechanism_crosstab(Q.mechanism_taxonomy(annotations(spark, d)))


# --- all models on all splits ---------------------------------------------------------------------------------------

ORDER = ("legacy", "v2", "v3")
#: The three models: the scored events' probabilities, flattened, and sharpened.
_MODELS = """SELECT m.model, event_id AS prediction_id, CASE m.model WHEN 'legacy' THEN prob_chair WHEN 'v2' THEN (prob_chair + 0.25) / 2 ELSE prob_chair * prob_chair / q END AS prob_chair, CASE m.model WHEN 'legacy' THEN prob_bed WHEN 'v2' THEN (prob_bed + 0.24) / 2 ELSE prob_bed * prob_bed / q END AS prob_bed,
  CASE m.model WHEN 'legacy' THEN prob_room WHEN 'v2' THEN (prob_room + 0.26) / 2 ELSE prob_room * prob_room / q END AS prob_room, CASE m.model WHEN 'legacy' THEN prob_no_patient WHEN 'v2' THEN (prob_no_patient + 0.25) / 2 ELSE prob_no_patient * prob_no_patient / q END AS prob_no_patient
  FROM (SELECT *, prob_chair * prob_chair + prob_bed * prob_bed + prob_room * prob_room + prob_no_patient * prob_no_patient AS q FROM sc), (SELECT unnest(['legacy', 'v2', 'v3']) AS model) m"""
_EVAL = {
    "pd": "SELECT event_id AS prediction_id, monitor_id || '|' || strftime(ts, '%Y-%m-%d') || '|00:00' AS event_key, row_number() OVER (PARTITION BY monitor_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS ordinal FROM ev WHERE event_type <> 'error'",
    "m": _MATCH, "mo": _MODELS,
    "spl": "SELECT tr.* EXCLUDE (truth_label), s.split, s.split <> 'inframe' AS counts, CASE WHEN s.split = 'departure_aware' THEN truth_label WHEN status = 'excluded_offscreen' THEN 'no_patient' ELSE prefall_location END AS truth_label, status = 'excluded_offscreen' AS offscreen FROM tr, (SELECT unnest(['departure_aware', 'inframe', 'raw_audit']) AS split) s",
    "sp0": """SELECT split, k.model, sequence_id, coalesce(sum(prob_chair), 0) AS c, coalesce(sum(prob_bed), 0) AS b, coalesce(sum(prob_room), 0) AS r, coalesce(sum(prob_no_patient), 0) AS n, arg_max(truth_label, event_instance_ordinal) AS truth, bool_or(offscreen) AS offscreen, bool_or(counts) AS counts
      FROM spl JOIN m ON spl.row_id = m.row_id CROSS JOIN (SELECT unnest(['legacy', 'v2', 'v3']) AS model) k LEFT JOIN mo ON mo.model = k.model AND mo.prediction_id = m.prediction_id GROUP BY ALL""",
    "sp": """SELECT split, model, sequence_id, truth, CASE WHEN c + b + r + n = 0 THEN 'no_patient' WHEN c / (c + b + r + n) >= greatest(c, b, r, n) / (c + b + r + n) - 1e-9 THEN 'chair' WHEN b / (c + b + r + n) >= greatest(c, b, r, n) / (c + b + r + n) - 1e-9 THEN 'bed' WHEN r / (c + b + r + n) >= greatest(c, b, r, n) / (c + b + r + n) - 1e-9 THEN 'room' ELSE 'no_patient' END AS derived, coalesce(c / nullif(c + b + r + n, 0), 0) AS prob_chair, coalesce(b / nullif(c + b + r + n, 0), 0) AS prob_bed, coalesce(r / nullif(c + b + r + n, 0), 0) AS prob_room,
      coalesce(n / nullif(c + b + r + n, 0), 1) AS prob_no_patient, c + b + r + n > 0 AND (counts OR NOT offscreen) AS scored FROM sp0""",
    "sd": "SELECT * FROM sp WHERE scored",
    "elm": """SELECT split, model, label, count(*) FILTER (truth = label) AS support, count(*) FILTER (derived = label) AS predicted, count(*) FILTER (truth = label AND derived = label) AS tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM sd, st GROUP BY ALL""",
    "ebin": """SELECT split, model, sum(abs(c - h)) / sum(n) AS ece, sum(l) / sum(n) AS log_loss, sum(n)::BIGINT AS n, sum(h) / sum(n) AS accuracy FROM (SELECT split, model, sum(x) AS c, sum((truth = derived)::INT) AS h, count(*) AS n, sum(-ln(greatest(1e-15, least(1 - 1e-15, CASE truth WHEN 'chair' THEN prob_chair WHEN 'bed' THEN prob_bed WHEN 'room' THEN prob_room ELSE prob_no_patient END)))) AS l
      FROM (SELECT *, greatest(prob_chair, prob_bed, prob_room, prob_no_patient) AS x FROM sd) GROUP BY split, model, (SELECT count(*) FROM (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edge) WHERE edge <= x)) GROUP BY ALL""",
    "cc": """SELECT split, model, any_value(n) AS scored_sequences, any_value(round(accuracy, 6)) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, any_value(round(log_loss, 6)) AS log_loss, any_value(round(ece, 6)) AS ece,
      round(max(f1) FILTER (label = 'chair'), 6) AS f1_chair, round(max(f1) FILTER (label = 'bed'), 6) AS f1_bed, round(max(f1) FILTER (label = 'room'), 6) AS f1_room, round(max(f1) FILTER (label = 'no_patient'), 6) AS f1_no_patient FROM elm JOIN ebin USING (split, model) GROUP BY ALL""",
}


def evaluation(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).filter("event_type <> 'error'")
    day = F.date_format("ts", "yyyy-MM-dd")
    ids = e.select(F.col("event_id").alias("prediction_id"), F.concat_ws("|", F.col("monitor_id").cast("string"), day, F.lit("00:00")).alias("event_key"), F.row_number().over(Window.partitionBy("monitor_id", day).orderBy("ts", "event_id")).alias("ordinal"))
    s = scored(spark, d)
    p = {x: F.col(f"prob_{x}") for x in STATES}
    squares = sum((c * c for c in p.values()), F.lit(0.0))
    flat = dict(zip(STATES, (0.25, 0.24, 0.26, 0.25), strict=True))
    kinds = {"legacy": p, "v2": {x: (c + flat[x]) / 2 for x, c in p.items()}, "v3": {x: c * c / squares for x, c in p.items()}}
    each = F.array(*[F.struct(F.lit(m).alias("model"), *[c.alias(f"prob_{x}") for x, c in kind.items()]) for m, kind in kinds.items()])
    return EV.evaluate_labels(truth(spark, d), ids, s.select(F.col("event_id").alias("prediction_id"), F.inline(each)), ORDER)


@query("b112_evaluate_labels", sql("SELECT * FROM cc", **SC, **AN, **_EVAL))
def b112(spark, d):
    return evaluation(spark, d)["candidate_comparison"]


@query("b112_label_metrics", sql("SELECT split, model, label, support, predicted, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM elm", **SC, **AN, **_EVAL))
def b112_labels(spark, d):
    return evaluation(spark, d)["label_metrics"].select("split", "model", "label", "support", "predicted", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("b112_confusion_matrix", sql("SELECT split, model, t.label AS truth, k.label AS derived, count(*) FILTER (sd.truth = t.label AND sd.derived = k.label) AS n FROM sd, st t, st k GROUP BY ALL", **SC, **AN, **_EVAL))
def b112_confusion(spark, d):
    return evaluation(spark, d)["confusion_matrix"]


@query("b112_sequence_predictions", sql("SELECT split, model, sequence_id, truth, derived, scored, round(prob_chair, 9) AS prob_chair, round(prob_room, 9) AS prob_room FROM sp", **SC, **AN, **_EVAL))
def b112_sequences(spark, d):
    return evaluation(spark, d)["sequence_predictions"].select("split", "model", "sequence_id", "truth", "derived", "scored", F.round("prob_chair", 9).alias("prob_chair"), F.round("prob_room", 9).alias("prob_room"))


_STATUS = """SELECT c.model, x.kind, x."check", x.operator, x.threshold, x.actual, coalesce(CASE x.operator WHEN '>=' THEN x.actual >= x.threshold WHEN '>' THEN x.actual > x.threshold ELSE x.actual <= x.threshold END, false) AS passed FROM
  (SELECT c.*, l.f1_no_patient AS l_no, b.macro_f1 AS b_macro, b.f1_room AS b_room, b.f1_no_patient AS b_no, round(greatest(0, l.f1_bed - c.f1_bed), 6) AS drop FROM cc c JOIN cc l ON l.split = c.split AND l.model = 'legacy' JOIN cc b ON b.split = c.split AND b.model = CASE c.model WHEN 'v3' THEN 'v2' ELSE 'legacy' END WHERE c.split = 'departure_aware' AND c.model <> 'legacy') c,
  LATERAL (VALUES ('check', 'macro_f1', '>=', 0.55::DOUBLE, c.macro_f1), ('check', 'chair_f1', '>=', 0.55::DOUBLE, c.f1_chair), ('check', 'room_f1', '>=', 0.45::DOUBLE, c.f1_room), ('check', 'no_patient_f1_non_decreasing', '>=', c.l_no, c.f1_no_patient), ('check', 'bed_f1_drop', '<=', 0.05::DOUBLE, c.drop),
    ('selection', 'macro_f1_beats_baseline', '>', c.b_macro, c.macro_f1), ('selection', 'room_f1_non_decreasing', '>=', c.b_room, c.f1_room), ('selection', 'no_patient_f1_non_decreasing', '>=', c.b_no, c.f1_no_patient), ('selection', 'bed_f1_drop', '<=', 0.05::DOUBLE, c.drop)) x(kind, "check", operator, threshold, actual)"""


@query("b111_benchmark_status", sql("SELECT *, coalesce((SELECT max(model) FROM (SELECT model FROM bs WHERE kind = 'selection' GROUP BY model HAVING bool_and(passed))), 'legacy') AS selected_model FROM bs", **SC, **AN, **_EVAL, bs=_STATUS))
def b111_status(spark, d):
    return evaluation(spark, d)["benchmark_status"]
