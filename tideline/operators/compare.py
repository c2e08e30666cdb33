"""Records near events, payloads, and predictions of several models against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.timefn import circular_distance, to_utc
from tideline.operators.joins import interval_join, spread
from tideline.sources.staging import stage


def annotation_utc(ann: DataFrame, zone: str) -> DataFrame:
    """B136: date of the key and wall clock as UTC."""
    day = F.get(F.split("event_key", r"\|"), F.lit(1))
    return ann.withColumn("fall_ts_utc", to_utc(F.concat_ws(" ", day, F.col("fall_time")).try_cast("timestamp"), zone))


def payload_mentions(records: DataFrame, payload: str, pattern: str) -> DataFrame:
    """B138: does the report, or any event's description, mention the pattern; payloads that don't parse mention nothing."""
    parsed = F.from_json(payload, "report string, events array<struct<description:string>>")
    out = records.withColumn("_p", parsed)
    report = F.coalesce(F.col("_p.report").rlike(pattern), F.lit(False))
    event = F.coalesce(F.exists("_p.events", lambda e: F.coalesce(e["description"].rlike(pattern), F.lit(False))), F.lit(False))
    source = F.when(report & event, "both").when(report, "report").when(event, "event").otherwise("none")
    return out.withColumn("in_report", report).withColumn("in_event", event).withColumn("match_source", source).drop("_p")


def nearby_records(anchors: DataFrame, records: DataFrame, keys: list[str], reach_s: int) -> DataFrame:
    """B137: records within reach of an anchor, with their distance."""
    near = interval_join(anchors, records, keys, -reach_s, reach_s)
    return near.withColumn("seconds", (F.unix_micros("ts") - F.unix_micros("anchor_ts")) / 1e6)


def context_summary(anchors: DataFrame, near: DataFrame, widths_s: tuple[int, ...], first, last) -> DataFrame:
    """B139: records within each width, the nearest one, and whether the source covers the anchor at all."""
    d = F.abs("seconds")
    g = near.groupBy("anchor_id").agg(*[F.count_if(d <= w).alias(f"within_{w}") for w in widths_s], F.min_by("record_id", F.struct(d, F.col("record_id"))).alias("nearest_record"), F.min(d).alias("nearest_seconds"))
    out = anchors.select("anchor_id", "anchor_ts").join(g, "anchor_id", "left").na.fill(0, [f"within_{w}" for w in widths_s])
    reason = F.when(F.col("anchor_ts") < first, "before_source").when(F.col("anchor_ts") > last, "after_source").otherwise("covered")
    return out.withColumn("applicability", reason)


def tag_jaccard(a: Column, b: Column) -> Column:
    """1 where neither has a tag."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def compare_to_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """B141: each prediction with the truth row of its key: the only one, else the nearest in time, else the earliest; matches and errors.

    Truth rows per key are few; min_by picks one beside its prediction, in the distribution by key, without a second shuffle.
    """
    t = truth.select("event_key", F.struct(F.col("row_id").alias("row_id"), "prefall_location", "last_furniture", "fall_seconds", "response_seconds", "tags").alias("t"))
    p = pred.withColumn("_n", F.monotonically_increasing_id())  # a row each, also where an id comes twice
    far = F.lit(1e12)
    gap = F.coalesce(F.abs(F.col("t.fall_seconds") - F.col("fall_seconds")).cast("double"), F.when(F.col("fall_seconds").isNotNull(), far).otherwise(0.0))
    order = F.struct(gap, F.coalesce(F.col("t.fall_seconds").cast("double"), far), F.coalesce(F.when(F.col("fall_seconds").isNull(), F.col("t.response_seconds").cast("double")), far), F.col("t.row_id"))
    row = F.first(F.struct(*[F.col(c) for c in pred.columns]))
    g = spread(p, "event_key", counted=pred).join(t, "event_key", "left").groupBy("event_key", "_n").agg(row.alias("_p"), F.min_by("t", order).alias("t"), F.count("t").alias("truth_rows"))
    out = g.select("_p.*", "t", "truth_rows")
    source = F.when(F.col("truth_rows") == 0, "missing_truth").when(F.col("truth_rows") == 1, "direct_event_key").when(F.col("fall_seconds").isNotNull(), "nearest_fall_time").otherwise("earliest_truth_fallback")
    hit = F.col("truth_rows") > 0
    return out.withColumns({
        "match_source": source,
        "location_match": F.when(hit, F.col("prefall_location").eqNullSafe(F.col("t.prefall_location"))),
        "furniture_match": F.when(hit, F.col("last_furniture").eqNullSafe(F.col("t.last_furniture"))),
        "tag_jaccard": F.when(hit, tag_jaccard(F.col("tags"), F.col("t.tags"))),
        "time_error": F.abs(F.col("fall_seconds") - F.col("t.fall_seconds")),
        "clock_error": circular_distance(F.col("fall_seconds"), F.col("t.fall_seconds")),
    })


def coverage_table(truth: DataFrame, comparisons: DataFrame, failures: DataFrame) -> DataFrame:
    """B142: each truth key and model: success, failed or missing, in that order."""
    keys = truth.select("event_key").distinct()
    ok = comparisons.select("model", "event_key", F.lit(0).alias("p")).unionByName(failures.select("model", "event_key", F.lit(1).alias("p")))
    models = ok.select("model").distinct()
    best = ok.groupBy("model", "event_key").agg(F.min("p").alias("p"))
    grid = keys.crossJoin(F.broadcast(models)).join(best, ["model", "event_key"], "left")
    return grid.select("model", "event_key", F.when(F.col("p") == 0, "success").when(F.col("p") == 1, "failed").otherwise("missing").alias("status"))


def _metrics():
    e = F.col("clock_error")
    return [
        F.count(F.lit(1)).cast("double").alias("events"), F.avg(F.col("location_match").cast("double")).alias("location_accuracy"), F.avg(F.col("furniture_match").cast("double")).alias("furniture_accuracy"), F.avg("tag_jaccard").alias("mean_tag_jaccard"),
        F.avg(e).alias("time_mae"), F.percentile(e, F.lit(0.5)).alias("time_median"), F.percentile(e, F.lit(0.9)).alias("time_p90"), *[F.avg(F.when(e.isNotNull(), (e <= w).cast("double"))).alias(f"within_{w}s") for w in (10, 30, 60)],
    ]


def comparison_metrics(cmp: DataFrame) -> DataFrame:
    """B143: accuracies, time errors and shares within limits, as metric, value."""
    g = cmp.groupBy("model").agg(*_metrics())
    return g.unpivot(["model"], [c for c in g.columns if c != "model"], "metric", "value")


def common_keys(cmp: DataFrame) -> DataFrame:
    """Keys that all models compared."""
    models = cmp.agg(F.count_distinct("model").alias("n_models"))
    g = cmp.groupBy("event_key").agg(F.count_distinct("model").alias("n"))
    return g.crossJoin(F.broadcast(models)).filter("n = n_models").select("event_key")


def model_metrics(cmp: DataFrame) -> DataFrame:
    """B144: the metrics of each model on all its keys and on the common ones."""
    cmp = stage(cmp, "comparison")
    both = cmp.withColumn("scope", F.lit("full")).unionByName(cmp.join(common_keys(cmp), "event_key", "left_semi").withColumn("scope", F.lit("common_overlap")))
    g = both.groupBy("scope", "model").agg(*_metrics())
    return g.unpivot(["scope", "model"], [c for c in g.columns if c not in ("scope", "model")], "metric", "value")


def overlap_wide(cmp: DataFrame, models: list[str]) -> DataFrame:
    """B145: the common keys with a column of locations by model."""
    kept = cmp.join(common_keys(cmp), "event_key", "left_semi")
    return kept.groupBy("event_key").pivot("model", models).agg(F.min_by("prefall_location", "prediction_id"))


def location_confusion(cmp: DataFrame) -> DataFrame:
    """B146: predicted by true location and model."""
    return cmp.filter("truth_rows > 0").groupBy("model", F.col("t.prefall_location").alias("truth"), F.col("prefall_location").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def detection_confusion(cmp: DataFrame) -> DataFrame:
    """B146: detections against truth, where a time means a fall; rates by model."""
    t, p = F.col("t.fall_seconds").isNotNull(), F.col("fall_seconds").isNotNull()
    g = cmp.filter("truth_rows > 0").groupBy("model").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return g.withColumn("sensitivity", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6)).withColumn("specificity", F.round(F.try_divide("tn", F.col("tn") + F.col("fp")), 6))


def false_negative_tags(cmp: DataFrame) -> DataFrame:
    """B146: tags of the falls that a model missed."""
    missed = cmp.filter(F.col("t.fall_seconds").isNotNull() & F.col("fall_seconds").isNull())
    return missed.select("model", F.explode("t.tags").alias("tag")).groupBy("model", "tag").agg(F.count(F.lit(1)).alias("n"))


def latest_per_file(records: DataFrame, tie: str) -> DataFrame:
    """B140: the last successful record of each file."""
    w = Window.partitionBy("file").orderBy(F.col(tie).desc())
    return records.filter("status = 'success'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Statuses of a truth key, the first of which counts, and those that models are judged on (fixed values).
STATUSES = ("accepted_nonfall", "excluded_bad_or_no_video", "excluded_no_signal", "excluded_offscreen", "included_fall")
HEADLINE = ("included_fall", "accepted_nonfall")
#: File names of recordings: unit, date, hour and minute, with or without a suffix (fixed pattern).
FILE_NAME = r"^(\d+)_(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})(?:\.\w+)?$"


def file_event_key(file: Column) -> Column:
    """unit|date|hour:minute of a recording's file name, with or without a path; null for other names."""
    name = F.trim(F.regexp_extract(file, r"([^/]*)$", 1))
    part = [F.regexp_extract(name, FILE_NAME, i) for i in range(1, 5)]
    return F.when(part[0] != "", F.concat(part[0], F.lit("|"), part[1], F.lit("|"), part[2], F.lit(":"), part[3]))


def as_bool(c: Column) -> Column:
    """True, 1 and yes are true; false, 0, no, nothing and null are false; any other text is true."""
    token = F.lower(F.trim(c.cast("string")))
    return F.when(token.isNull() | token.isin("false", "0", "no", ""), False).otherwise(True)


def as_number(c: Column) -> Column:
    """A finite or infinite number, null for anything else."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def relative_seconds(event_key: Column, clock: Column) -> Column:
    """Seconds from the hour of a key to a clock's seconds, over midnight where that comes first."""
    parts = F.split(event_key, r"\|")
    hour = F.regexp_extract(F.get(parts, F.lit(2)), r"^(\d+):", 1).try_cast("int")
    gap = clock - hour * 3600
    return F.when(F.size(parts) == 3, F.when(gap < 0, gap + 86_400).otherwise(gap)).cast("double")


def load_predictions(summary: DataFrame) -> DataFrame:
    """B140: a model's summary with event_key from its file, typed detections, times and tags. A file of another name is an error when its row is read.

    Tags come as text, split at commas and bars; nothing, none and nan are no tags.
    """
    key = file_event_key(F.col("file"))
    bad = F.raise_error(F.concat(F.lit("no event key in the file name "), F.coalesce("file", F.lit("(null)")))).cast("string")
    text = F.lower(F.trim(F.col("fall_tags")))
    tags = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,|]"), lambda t: F.trim(t)), lambda t: t != "")
    out = summary.withColumn("event_key", F.coalesce(key, bad)).withColumn("fall_detected", as_bool(F.col("fall_detected")))
    out = out.withColumns({c: as_number(F.col(c)) for c in ("fall_time_seconds", "staff_entry_time_seconds", "staff_response_time_seconds") if c in summary.columns})
    return out.withColumn("tags", F.when(text.isin("none", "nan", "<na>"), F.array().cast("array<string>")).otherwise(F.array_distinct(tags)))


def load_results(records: DataFrame) -> DataFrame:
    """B140: a record per file and model: event_key (null for other names), and error or success by whether an error came with it."""
    return records.select(F.trim("file").alias("file"), file_event_key(F.col("file")).alias("event_key"), "model", F.when(F.col("error").isNotNull(), "error").otherwise("success").alias("record_status"), "error")


def truth_status(truth: DataFrame) -> DataFrame:
    """event_key and the first of its statuses."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")), F.lit(0).cast("long"))
    return truth.groupBy("event_key").agg(F.min_by("status", F.when(rank > 0, rank).otherwise(999)).alias("status"))


def failure_table(truth: DataFrame, records: DataFrame, comparisons: DataFrame) -> DataFrame:
    """B142: truth keys that no comparison reached, with their status and the errors of their records."""
    lost = truth_status(truth).join(comparisons.select("event_key").distinct(), "event_key", "left_anti")
    errors = records.filter("record_status = 'error'").select("file", "event_key", "model", "error")
    return lost.join(errors, "event_key", "left").select("event_key", "status", "file", "model", "error")


def model_coverage(truth: DataFrame, comparisons: DataFrame, records: DataFrame, models: list[str]) -> DataFrame:
    """B142, B145: by model and status (and all): truth keys, those with a success, an error or nothing, and keys that all models share.

    Models are few, so the truth keys are repeated for each.
    """
    keys = truth_status(truth).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    ok = comparisons.select("model", "event_key").distinct().withColumn("_ok", F.lit(True))
    failed = records.filter("record_status = 'error' AND event_key IS NOT NULL").select("model", "event_key").distinct().withColumn("_failed", F.lit(True))
    j = keys.join(ok, ["model", "event_key"], "left").join(failed, ["model", "event_key"], "left")
    each = j.withColumn("scope", F.explode(F.array(F.col("status"), F.lit("all"))))
    seen = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = each.groupBy("model", "scope").agg(F.count(F.lit(1)).alias("total"), seen("_ok").alias("successful"), seen("_failed").alias("failed"), F.count_if(F.col("_ok").isNull()).alias("missing"))
    shared = common_keys(comparisons).agg(F.count(F.lit(1)).alias("overlap"))
    return g.join(F.broadcast(shared))


def event_long(truth: DataFrame, comparisons: DataFrame) -> DataFrame:
    """B145: every comparison with its key's status, whether all models compared the key, and whether it counts or only diagnoses."""
    both = comparisons.drop("status").join(truth_status(truth), "event_key", "left").join(common_keys(comparisons).withColumn("_common", F.lit(True)), "event_key", "left")
    headline = F.coalesce(F.col("status").isin(*HEADLINE), F.lit(False))
    return both.withColumn("in_overlap", F.col("_common").isNotNull()).withColumn("visible_primary", headline).withColumn("diagnostic_only", F.coalesce(F.col("status").startswith("excluded_"), F.lit(False))).drop("_common")
