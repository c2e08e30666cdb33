"""Adjudicated truth, matching it to predictions, and how good labels and probabilities are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.config import STATES
from tideline.functions.timefn import clock_seconds, wrapped_difference

#: Normal forms of tags and labels, and what some tags mean (fixed values).
TAG_ALIASES = {"off_screen": "offscreen", "no fall": "no_fall", "bad video": "bad_video", "no video": "no_video"}
LABEL_ALIASES = {"other": "room", "unknown": "no_patient"}
NONFALL_TAGS = ("no_fall",)
BAD_VIDEO_TAGS = ("bad_video", "no_video")
OFFSCREEN_TAGS = ("offscreen",)
DEPARTURE_S = 10
#: Summed probabilities closer than this tie: sums of doubles depend on their order.
TIE = 1e-9
MECHANISMS = ("footrest_positioning", "transfer_failure", "other")


def _grid(spark, name: str, values=STATES) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _alias(c: Column, names: dict[str, str]) -> Column:
    out = c
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def clean(c: Column) -> Column:
    """Trimmed lower-case text; null for blanks and the spellings of null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("", "nan", "none", "<na>"), None).otherwise(t)


def normal_tags(c: Column) -> Column:
    """Sorted distinct tags of a comma list, by their normal names."""
    parts = F.transform(F.split(F.coalesce(clean(c), F.lit("")), ","), lambda t: F.trim(t))
    named = F.transform(F.filter(parts, lambda t: t != ""), lambda t: _alias(t, TAG_ALIASES))
    return F.array_sort(F.array_distinct(F.transform(named, lambda t: F.replace(t, F.lit(" "), F.lit("_")))))


def prepare_annotations(ann: DataFrame, demote: DataFrame | None = None) -> DataFrame:
    """Normal tags and labels, and a status: non-fall, then bad video, then off screen, else included; demoted keys without a signal."""
    out = ann.withColumn("event_key", F.trim("event_key")).withColumn("tags", normal_tags(F.col("fall_tags")))
    out = out.withColumn("prefall_location", _alias(clean(F.col("prefall_location")), LABEL_ALIASES)).withColumn("last_furniture", clean(F.col("last_furniture")))
    out = out.withColumn("fall_seconds", clock_seconds(F.col("fall_time"))).withColumn("response_seconds", clock_seconds(F.col("response_time"))).withColumn("departure_seconds", clock_seconds(F.col("departure_time")))
    has = lambda tags: F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    status = F.when(has(NONFALL_TAGS), "accepted_nonfall").when(has(BAD_VIDEO_TAGS), "excluded_bad_or_no_video")
    status = status.when(has(OFFSCREEN_TAGS) | F.col("fall_seconds").isNull(), "excluded_offscreen").otherwise("included_fall")
    out = out.withColumn("status", status)
    if demote is not None:
        keys = demote.select(F.col("event_key").alias("_k"), F.lit(True).alias("_d")).distinct()
        out = out.join(keys, out["event_key"] == F.col("_k"), "left")
        out = out.withColumn("status", F.when(F.col("_d") & (F.col("status") == "included_fall"), "excluded_no_signal").otherwise(F.col("status"))).drop("_k", "_d")
    return out


def assign_sequences(ann: DataFrame, tie: str = "row_id") -> DataFrame:
    """Ordinal within the key by fall and response time, and a sequence that a known response ends."""
    w = Window.partitionBy("event_key").orderBy(F.col("fall_seconds").asc_nulls_last(), F.col("response_seconds").asc_nulls_last(), tie)
    ended = F.count("response_seconds").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = ann.withColumn("event_instance_ordinal", F.row_number().over(w).cast("long")).withColumn("sequence_ordinal", ended + 1)
    return out.withColumn("sequence_id", F.concat(F.col("event_key"), F.lit("#S"), F.lpad(F.col("sequence_ordinal").cast("string"), 2, "0")))


def adjudication_table(ann: DataFrame, start: str, end: str) -> DataFrame:
    """Annotations and events by status, in all and in the study window."""
    day = F.get(F.split("event_key", r"\|"), F.lit(1)).try_cast("date")
    flagged = ann.withColumn("_in", day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    counts = lambda c, n: [F.count_if(c).alias(f"annotations_{n}"), F.count_distinct(F.when(c, F.col("event_key"))).alias(f"events_{n}")]
    total = F.when(F.grouping("status") == 1, "all").otherwise(F.col("status")).alias("scope")
    return flagged.rollup("status").agg(total, *counts(F.lit(True), "full"), *counts(F.coalesce("_in", F.lit(False)), "window")).drop("status")


def origin_chain(location: Column, furniture: Column) -> Column:
    """Where the subject came from."""
    away = location.isin("room", "no_patient")
    out = F.when(location == "chair", "direct_chair").when(location == "bed", "direct_bed")
    for f in ("chair", "bed", "floor"):
        out = out.when(away & (furniture == f), f"{f}_origin_room")
    return out.when(away, "unknown_origin_room").otherwise("other")


def truth_instances(ann: DataFrame) -> DataFrame:
    """Included annotations with sequences, latencies over midnight, origin chain, and the departure-aware label.

    A fall in the room within DEPARTURE_S seconds of leaving a chair or bed counts for that furniture; off screen is no_patient.
    """
    seq = assign_sequences(ann.filter(F.col("status").isin("included_fall", "excluded_offscreen")))
    offscreen = F.col("status") == "excluded_offscreen"
    out = seq.withColumn("response_latency", wrapped_difference(F.col("response_seconds"), F.col("fall_seconds"))).withColumn("departure_latency", wrapped_difference(F.col("fall_seconds"), F.col("departure_seconds")))
    raw = F.coalesce("prefall_location", F.lit("no_patient"))
    relabel = (raw == "room") & F.col("last_furniture").isin("chair", "bed") & (F.col("departure_latency") < DEPARTURE_S)
    out = out.withColumn("relabelled", F.coalesce(relabel, F.lit(False))).withColumn("truth_label", F.when(F.col("relabelled"), F.col("last_furniture")).when(offscreen, "no_patient").otherwise(raw))
    return out.withColumn("chain", origin_chain(raw, F.col("last_furniture")))


def origin_summary(truth: DataFrame) -> DataFrame:
    """Events and share by origin chain."""
    g = truth.groupBy("chain").agg(F.count(F.lit(1)).alias("event_count"))
    return g.withColumn("pct_of_events", F.round(100.0 * F.col("event_count") / F.sum("event_count").over(Window.partitionBy()), 1))


def departure_latency(truth: DataFrame) -> DataFrame:
    """Latency since leaving the last furniture."""
    lat = F.col("departure_latency")
    q = lambda p: F.round(F.percentile(lat, F.lit(p)), 1)
    return truth.filter(lat.isNotNull() & F.col("last_furniture").isNotNull()).groupBy("last_furniture").agg(
        F.count(F.lit(1)).alias("n_events"), q(0.5).alias("median"), F.round(F.avg(lat), 1).alias("mean"), q(0.25).alias("p25"), q(0.75).alias("p75"), F.min(lat).alias("least"), F.max(lat).alias("most")
    )


def tag_chain_crosstab(truth: DataFrame) -> DataFrame:
    """Tags by origin chain, with shares within the chain and overall."""
    g = truth.select("chain", F.explode("tags").alias("tag")).groupBy("chain", "tag").agg(F.count(F.lit(1)).alias("count"))
    share = lambda *by: F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(*by)), 1)
    return g.withColumn("pct_within_chain", share("chain")).withColumn("pct_global", share())


def match_truth(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each truth instance with the prediction of its key and ordinal, else the key's only one, else the nearest ordinal.

    A key's instances are few: predictions per key are ranked beside each unmatched truth row.
    """
    p = predictions.select(F.col("event_key").alias("_k"), F.col("ordinal").alias("_o"), "prediction_id")
    size = p.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    t = truth.select("row_id", "event_key", F.col("event_instance_ordinal").alias("ordinal"))
    exact = t.join(p, (t["event_key"] == F.col("_k")) & (t["ordinal"] == F.col("_o"))).select("row_id", "prediction_id", F.lit("exact").alias("match_source"))
    rest = t.join(exact, "row_id", "left_anti")
    near = rest.join(p, rest["event_key"] == F.col("_k")).join(size, "_k")
    key = F.struct(F.abs(F.col("_o") - F.col("ordinal")), F.col("_o"))
    source = F.when(F.max("_n") == 1, "single_event_key_fallback").otherwise("nearest_ordinal_fallback")
    near = near.groupBy("row_id").agg(F.min_by("prediction_id", key).alias("prediction_id"), source.alias("match_source"))
    found = exact.unionByName(near)
    return t.join(found, "row_id", "left").withColumn("match_source", F.coalesce("match_source", F.lit("unmatched")))


def sequence_predictions(matched: DataFrame) -> DataFrame:
    """Per sequence the renormalised sum of its probabilities, the last truth label, first truth and predicted latencies."""
    p = [f"prob_{s}" for s in STATES]
    g = matched.groupBy("sequence_id").agg(
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in p], F.max_by("truth_label", "event_instance_ordinal").alias("truth_label"), F.count(F.lit(1)).alias("instances"),
        F.min("response_latency").alias("truth_latency"), F.min("predicted_latency").alias("predicted_latency"),
    )
    total = sum((F.col(c) for c in p[1:]), F.col(p[0]))
    g = g.withColumn("_t", total).withColumn("scored", F.col("_t") > 0)
    g = g.withColumns({c: F.when(F.col("_t") > 0, F.col(c) / F.col("_t")).otherwise(F.lit(1.0 if c == "prob_no_patient" else 0.0)) for c in p}).drop("_t")
    return g.withColumn("derived", argmax(p, TIE))


def argmax(columns: list[str], within: float = 0.0) -> Column:
    """The state of the greatest probability; ties in the order of STATES. What lies ``within`` of the greatest ties with it."""
    top = F.greatest(*columns)
    out = F.lit(STATES[-1])
    for c, s in reversed(list(zip(columns, STATES, strict=True))[:-1]):
        out = F.when(F.col(c) >= top - within, s).otherwise(out)
    return out


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Counts for all pairs of classes."""
    spark = scored.sparkSession
    grid = _grid(spark, "truth").crossJoin(_grid(spark, "derived"))
    counts = scored.groupBy("truth", "derived").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "derived"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def label_metrics(scored: DataFrame) -> DataFrame:
    """B100: support, precision, recall and F1 of each class."""
    pairs = scored.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("d"), (F.col("truth") == F.col("derived")).cast("int").alias("h")), F.struct(F.col("derived").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    g = pairs.groupBy("label").agg(F.sum("t").alias("support"), F.sum("d").alias("predicted"), F.sum("h").alias("tp"))
    g = _grid(scored.sparkSession, "label").join(g, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    g = g.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def classification_metrics(scored: DataFrame) -> DataFrame:
    """Metric, value: sequences, accuracy and macro averages."""
    m = label_metrics(scored).agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    a = scored.agg(F.count(F.lit(1)).cast("double").alias("scored_sequences"), F.round(F.avg((F.col("truth") == F.col("derived")).cast("double")), 6).alias("accuracy"))
    wide = a.crossJoin(m)
    return wide.unpivot([], list(wide.columns), "metric", "value")


def probability_quality(scored: DataFrame, bins: int = 10) -> DataFrame:
    """B101: log loss, Brier score over four classes and expected calibration error; only the last bin holds its upper end."""
    p = {s: F.coalesce(F.col(f"prob_{s}"), F.lit(0.0)) for s in STATES}
    own = sum((F.when(F.col("truth") == s, c).otherwise(0.0) for s, c in p.items()), F.lit(0.0))
    loss = F.when(F.col("truth").isin(*STATES), -F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), own))))
    brier = sum(((c - F.when(F.col("truth") == s, 1.0).otherwise(0.0)) ** 2 for s, c in p.items()), F.lit(0.0)) / len(STATES)
    conf = F.greatest(*p.values())
    base = scored.select(loss.alias("loss"), brier.alias("brier"), conf.alias("conf"), (F.col("truth") == F.col("derived")).cast("double").alias("hit"), score_bin(conf, bins).alias("bin"))
    by_bin = base.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("l"), F.count("loss").alias("ln"), F.sum("brier").alias("b"), F.avg("conf").alias("c"), F.avg("hit").alias("h"))
    wide = by_bin.agg(F.round(F.sum("l") / F.sum("ln"), 6).alias("log_loss"), F.round(F.sum("b") / F.sum("n"), 6).alias("brier_score"), F.round(F.sum(F.abs(F.col("c") - F.col("h")) * F.col("n")) / F.sum("n"), 6).alias("ece"))
    return wide.unpivot([], list(wide.columns), "metric", "value")


def score_bin(score: Column, bins: int) -> Column:
    """The bin of [i/bins, (i+1)/bins) by comparing with the edges; 1 belongs to the last."""
    out = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        out = F.when(score < (i + 1) / bins, i).otherwise(out)
    return out


def long_scores(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row per class: the keys, target_class, y and score."""
    rows = F.array(*[F.struct(F.lit(s).alias("target_class"), (F.col("truth") == s).cast("int").alias("y"), F.coalesce(F.col(f"prob_{s}"), F.lit(0.0)).alias("score")) for s in STATES])
    return scored.select(*(keys or []), F.explode(rows).alias("x")).select(*(keys or []), "x.*")


def auc_summary(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """B102: areas under the ROC and PR curves by class (and keys), over distinct scores; 0 where a class is empty or full.

    Rows are first summed by (class, score), so the ordered window runs over distinct scores.
    """
    group = [*(keys or []), "target_class"]
    g = long_scores(scored, keys).groupBy(*group, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("score").desc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*group)
    c = g.withColumn("tp", F.sum("p").over(run)).withColumn("all", F.sum("n").over(run)).withColumn("pos", F.sum("p").over(every)).withColumn("total", F.sum("n").over(every))
    c = c.withColumn("tpr", F.try_divide("tp", "pos")).withColumn("fpr", F.try_divide(F.col("all") - F.col("tp"), F.col("total") - F.col("pos"))).withColumn("prec", F.col("tp") / F.col("all"))
    before = lambda col, first: F.coalesce(F.lag(col).over(w), first)
    c = c.withColumn("_roc", (F.col("fpr") - before("fpr", F.lit(0.0))) * (F.col("tpr") + before("tpr", F.lit(0.0))) / 2)
    c = c.withColumn("_pr", (F.col("tpr") - before("tpr", F.lit(0.0))) * (F.col("prec") + before("prec", F.col("pos") / F.col("total"))) / 2)
    out = c.groupBy(*group).agg(F.sum("_roc").alias("roc"), F.sum("_pr").alias("pr"), F.max("pos").alias("support"), F.max("total").alias("total"))
    both = (F.col("support") > 0) & (F.col("support") < F.col("total"))
    return out.select(*group, F.when(both, F.round("roc", 6)).otherwise(0.0).alias("roc_auc"), F.when(both, F.round("pr", 6)).otherwise(0.0).alias("pr_auc"), "support")


def threshold_sweep(scored: DataFrame, points: int = 101) -> DataFrame:
    """B103: rates at each threshold and class. Scores are counted once by the thresholds they pass, then summed from the top."""
    spark = scored.sparkSession
    steps = max(3, points) - 1
    passed = F.floor(F.round(F.col("score") * steps, 9))
    g = long_scores(scored).groupBy("target_class", F.least(passed, F.lit(steps)).alias("i")).agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    grid = _grid(spark, "target_class").crossJoin(spark.range(steps + 1).withColumnRenamed("id", "i"))
    full = grid.join(g, ["target_class", "i"], "left").na.fill(0, ["p", "n"])
    down = Window.partitionBy("target_class").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("target_class")
    c = full.withColumn("tp", F.sum("p").over(down)).withColumn("_a", F.sum("n").over(down)).withColumn("_p", F.sum("p").over(every)).withColumn("_n", F.sum("n").over(every))
    c = c.withColumn("fp", F.col("_a") - F.col("tp")).withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("_p") - F.col("fp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    prec, rec, spec = ratio(F.col("tp"), F.col("_a")), ratio(F.col("tp"), F.col("_p")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    c = c.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", ratio(2 * prec * rec, prec + rec)).withColumn("balanced_accuracy", (rec + spec) / 2).withColumn("j_stat", rec + spec - 1)
    return c.select("target_class", (F.col("i") / steps).alias("threshold"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "balanced_accuracy", "j_stat")], "tp", "fp", "tn", "fn")


def operating_point(sweep: DataFrame) -> DataFrame:
    """B105: per class the threshold of best F1, then balanced accuracy, then closeness of precision and recall, then the lowest."""
    w = Window.partitionBy("target_class").orderBy(F.col("f1").desc(), F.col("balanced_accuracy").desc(), F.abs(F.col("precision") - F.col("recall")), "threshold")
    return sweep.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("target_class", "threshold", "precision", "recall", "f1", "balanced_accuracy", "j_stat")


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """B104: mean score and share of hits by class and bin; empty bins too."""
    spark = scored.sparkSession
    g = long_scores(scored).groupBy("target_class", score_bin(F.col("score"), bins).cast("long").alias("bin_id")).agg(F.round(F.avg("score"), 6).alias("avg_confidence"), F.round(F.avg("y"), 6).alias("empirical_accuracy"), F.count(F.lit(1)).alias("n"))
    grid = _grid(spark, "target_class").crossJoin(spark.range(bins).withColumnRenamed("id", "bin_id"))
    return grid.join(g, ["target_class", "bin_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def response_metrics(scored: DataFrame) -> DataFrame:
    """B106: detection precision, recall and F1, and latency errors where both sides detect."""
    t, d = F.col("truth_latency").isNotNull(), F.col("predicted_latency").isNotNull()
    err = F.when(t & d, F.abs(F.col("predicted_latency") - F.col("truth_latency")))
    g = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & d).alias("tp"), F.count_if(d).alias("p"), F.count_if(t).alias("s"), F.avg(err).alias("mae"), F.percentile(err, F.lit(0.5)).alias("p50"), F.percentile(err, F.lit(0.9)).alias("p90"))
    prec, rec = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "s"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    wide = g.select(F.col("n").cast("double").alias("scored_sequences"), F.round(prec, 6).alias("detection_precision"), F.round(rec, 6).alias("detection_recall"), F.round(f1, 6).alias("detection_f1"), F.round("mae", 6).alias("latency_mae_seconds"), F.round("p50", 6).alias("latency_p50_seconds"), F.round("p90", 6).alias("latency_p90_seconds"))
    return wide.unpivot([], list(wide.columns), "metric", "value")


def sequences(truth: DataFrame) -> DataFrame:
    """A row per sequence: its instances, whether any is off screen, and whether it is scored for location and for response."""
    g = truth.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("instances"), F.max(F.col("status") == "excluded_offscreen").alias("offscreen"), F.min("fall_seconds").alias("_fall"))
    return g.select("sequence_id", "instances", "offscreen", (~F.col("offscreen")).alias("scored_for_location"), (~F.col("offscreen") & F.col("_fall").isNotNull()).alias("scored_for_response"))


def population_stats(truth: DataFrame, monitors: int | None = None) -> DataFrame:
    """B107: metric, value: rows, keys, monitors (and whether they are as many as expected), sequences, and rows by truth label."""
    unit = F.get(F.split("event_key", r"\|"), F.lit(0))
    off = F.count_if(F.col("status") == "excluded_offscreen")
    t = truth.agg(
        F.count(F.lit(1)).alias("truth_rows"), F.count_distinct("event_key").alias("truth_unique_event_keys"), F.count_distinct(unit).alias("truth_unique_monitors"),
        (F.count_distinct(unit) == F.lit(monitors)).cast("int").alias("truth_monitor_count_matches_expectation"), off.alias("truth_offscreen_rows"),
        *[F.count_if(F.col("truth_label") == s).alias(f"truth_label_count_{s}") for s in STATES],
    )
    counted = lambda c: F.count_if(F.col(c))
    s = sequences(truth).agg(
        F.count(F.lit(1)).alias("sequence_count"), counted("offscreen").alias("sequence_offscreen_count"), F.round(F.avg("instances"), 6).alias("sequence_mean_instances"),
        counted("scored_for_location").alias("sequence_scored_for_location"), counted("scored_for_response").alias("sequence_scored_for_response"),
    )
    wide = t.crossJoin(F.broadcast(s))
    return wide.unpivot([], [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in wide.columns], "metric", "value")


def tag_association(df: DataFrame, label: str, tags: str, min_count: int = 3) -> DataFrame:
    """B108: how often a tag goes with a label, against its overall share, for tags of at least min_count uses."""
    x = df.select(F.col(label).alias("label"), F.explode(tags).alias("tag"))
    per_tag = x.groupBy("tag").agg(F.count(F.lit(1)).alias("n_tag")).filter(F.col("n_tag") >= min_count)
    pairs = x.groupBy("label", "tag").agg(F.count(F.lit(1)).alias("n")).join(per_tag, "tag")
    by_label, every = Window.partitionBy("label"), Window.partitionBy()
    out = pairs.withColumn("n_label", F.sum("n").over(by_label)).withColumn("_t", F.sum("n").over(every))
    share, overall = F.col("n") / F.col("n_label"), F.col("n_tag") / F.col("_t")
    return out.select("label", "tag", "n", "n_label", "n_tag", F.round(share, 4).alias("pct_of_label"), F.round(overall, 4).alias("pct_global"), F.round(share / overall, 4).alias("lift"))


def cramers_v(pairs: DataFrame) -> DataFrame:
    """B109: bias-corrected association of label and tag from their counts; one row. Chi-square needs only the filled cells."""
    r, c, every = Window.partitionBy("label"), Window.partitionBy("tag"), Window.partitionBy()
    x = pairs.withColumn("e", F.sum("n").over(r) * F.sum("n").over(c) / F.sum("n").over(every))
    g = x.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("e")).alias("q"), F.count_distinct("label").alias("r"), F.count_distinct("tag").alias("k"))
    phi = F.greatest(F.lit(0.0), (F.col("q") - F.col("n")) / F.col("n") - (F.col("k") - 1) * (F.col("r") - 1) / (F.col("n") - 1))
    rc, kc = F.col("r") - (F.col("r") - 1) ** 2 / (F.col("n") - 1), F.col("k") - (F.col("k") - 1) ** 2 / (F.col("n") - 1)
    low = F.least(kc - 1, rc - 1)
    return g.select(F.when((F.col("r") > 1) & (F.col("k") > 1) & (F.col("n") > 1) & (low > 0), F.sqrt(phi / low)).alias("cramers_v"))


def signal_profile(scored: DataFrame) -> DataFrame:
    """B110: by truth label: sequences, mean probabilities, hits, and, of those scored for response, detection rates and mean latencies.

    A sequence is scored for response unless scored_for_response says otherwise.
    """
    counts = F.col("scored_for_response") if "scored_for_response" in scored.columns else F.lit(True)
    found = lambda c: F.round(F.avg(F.when(counts, F.col(c).isNotNull().cast("double"))), 4)
    late = lambda c: F.round(F.avg(F.when(counts, F.col(c).cast("double"))), 4)
    return scored.groupBy("truth").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"prob_{s}"), 6).alias(f"mean_{s}") for s in STATES], F.round(F.avg((F.col("truth") == F.col("derived")).cast("double")), 6).alias("hit_rate"),
        found("truth_latency").alias("truth_detect_rate"), found("predicted_latency").alias("derived_detect_rate"), late("truth_latency").alias("mean_truth_latency"), late("predicted_latency").alias("mean_derived_latency"),
    )


def association_summary(truth: DataFrame, tags: DataFrame, profile: DataFrame) -> DataFrame:
    """B110: metric, value: truth rows and the share of their commonest label, tag uses, tags kept, their association with labels, and the profile's rows and mean hits."""
    labels = truth.groupBy("truth_label").agg(F.count(F.lit(1)).alias("n"))
    top = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("truth_rows"), F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("top_truth_location_count"))
    used = tags.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("tag_annotations_total"), F.count_distinct("tag").cast("double").alias("distinct_tags_retained"))
    shape = profile.agg(F.count(F.lit(1)).cast("double").alias("signal_profile_rows"), F.round(F.avg(F.round("hit_rate", 4)), 6).alias("signal_profile_mean_accuracy"))
    v = cramers_v(tags).select(F.round("cramers_v", 6).alias("tag_location_cramers_v"))
    wide = top.withColumn("top_truth_location_share", F.coalesce(F.round(F.try_divide("top_truth_location_count", "truth_rows"), 6), F.lit(0.0)))
    for one in (used, v, shape):  # frames of one row
        wide = wide.crossJoin(F.broadcast(one))
    return wide.unpivot([], list(wide.columns), "metric", "value")


#: Check, metric, operator and limit (fixed values).
CHECKS = (("macro_f1", "macro_f1", ">=", 0.55), ("ece_10_bin", "ece", "<=", 0.15), ("response_detection_f1", "detection_f1", ">=", 0.70), ("response_latency_mae_seconds", "latency_mae_seconds", "<=", 45.0))


def threshold_checks(metrics: DataFrame, checks=CHECKS) -> DataFrame:
    """B111: each check's value, limit and whether it passes; a missing metric fails."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame(list(checks), "check string, metric string, operator string, threshold double")
    j = rules.join(metrics, "metric", "left")
    ok = F.when(F.col("operator") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return j.select("check", "operator", "threshold", F.col("value").alias("actual"), F.coalesce(ok, F.lit(False)).alias("passed"))


def choose_model(status: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """B111: the first model of the order whose checks all pass, else the last."""
    rank = F.lit(len(order))
    for i, m in enumerate(order):
        rank = F.when(F.col("model") == m, i).otherwise(rank)
    g = status.groupBy("model").agg(F.bool_and("passed").alias("ok"), F.min(rank).alias("rank"))
    pick = F.struct(F.when(F.col("ok"), 0).otherwise(1), F.when(F.col("ok"), F.col("rank")).otherwise(-F.col("rank")))
    return g.agg(F.min_by("model", pick).alias("model"), F.bool_or("ok").alias("any_passed"))


def mechanism(location: Column, tags: Column) -> Column:
    return F.when((location == "chair") & F.array_contains(tags, "footrest"), MECHANISMS[0]).when(F.array_contains(tags, "support_bed"), MECHANISMS[1]).otherwise(MECHANISMS[2])


def mechanism_taxonomy(ann: DataFrame, tie: str = "row_id") -> DataFrame:
    """B113: one row per key, by mechanism priority then order; for falls away from furniture, the first furniture known."""
    m = ann.withColumn("mechanism", mechanism(F.col("prefall_location"), F.col("tags")))
    prio = F.when(F.col("mechanism") == MECHANISMS[0], 0).when(F.col("mechanism") == MECHANISMS[1], 1).otherwise(2)
    m = m.withColumn("_o", F.struct(prio, F.col(tie)))
    g = m.groupBy("event_key").agg(
        F.min_by("prefall_location", "_o").alias("prefall_location"), F.min_by("mechanism", "_o").alias("mechanism"), F.count(F.lit(1)).alias("annotations"),
        F.min_by("last_furniture", "_o").alias("_own"), F.min_by("last_furniture", F.when(F.col("last_furniture").isNotNull(), F.col(tie))).alias("_any"),
    )
    away = F.col("prefall_location").isin("room", "no_patient")
    return g.withColumn("last_furniture", F.when(away, F.coalesce("_own", "_any"))).drop("_own", "_any")


def mechanism_crosstab(taxonomy: DataFrame) -> DataFrame:
    """B147: mechanisms by location, with totals and the share within chair."""
    loc = F.coalesce("prefall_location", F.lit("unknown"))
    wide = taxonomy.withColumn("_l", loc).groupBy("mechanism").pivot("_l", [*STATES, "unknown"]).count().na.fill(0)
    total = sum((F.col(s) for s in (*STATES, "unknown")), F.lit(0))
    return wide.withColumn("total", total.cast("long")).withColumn("pct_of_chair", F.round(100 * F.col("chair") / F.sum("chair").over(Window.partitionBy()), 1))


#: Signals of leaving the furniture, nudge colours, and where the furniture stands among the states (fixed values).
EXIT_SIGNALS = ("nudge_boundary", "location_label", "posture_transition")
COLOURS = ("green", "yellow", "red")
POSTURES = ("sitting", "standing", "lying")
FURNITURE_STATE = {"floor": "room"}


def exit_concordance(events: DataFrame, frames: DataFrame, reach: int = 300, min_score: float = 0.5, min_run: int = 2) -> DataFrame:
    """B127: by event and signal, the second of the day at which a signal shows that the furniture was left, against the adjudicated one.

    events: row_id, monitor_id, date, last_furniture, departure_seconds. frames: monitor_id, date, second, event_id, state, posture, scores
    and nudge_state. Frames within ``reach`` of the departure count: a nudge from green to yellow or red, a state other than
    the furniture's, or a run of a posture other than the first.
    """
    bucket = lambda c: F.floor(c / reach)
    known = events.filter(F.col("last_furniture").isNotNull() & F.col("departure_seconds").isNotNull())
    near = known.select("row_id", "monitor_id", "date", "last_furniture", "departure_seconds", F.explode(F.sequence(bucket(F.col("departure_seconds")) - 1, bucket(F.col("departure_seconds")) + 1)).alias("_b"))
    f = frames.withColumn("_b", bucket(F.col("second")))
    rows = near.join(f, ["monitor_id", "date", "_b"]).filter(F.abs(F.col("second") - F.col("departure_seconds")) <= reach)
    order = Window.partitionBy("row_id").orderBy("second", "event_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    colour = F.lower(F.trim("nudge_state"))
    state, home = F.lower(F.trim("state")), _alias(F.col("last_furniture"), FURNITURE_STATE)
    posture = F.lower(F.trim("posture"))
    posed = posture.isin(*POSTURES)
    rows = rows.withColumn("_colour", F.when(colour.isin(*COLOURS), colour)).withColumn("_posture", F.when(posed, posture))
    first = F.first("_posture", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = F.greatest(*[F.coalesce(f"score_{p}", F.lit(0.0)) for p in POSTURES])
    rows = rows.withColumn("_before", F.last("_colour", ignorenulls=True).over(past)).withColumn("_other", F.coalesce((F.col("_posture") != first) & (top >= min_score), F.lit(False)))
    of = Window.partitionBy("row_id", F.col("_posture").isNotNull()).orderBy("second", "event_id")
    run = F.row_number().over(of) - F.row_number().over(Window.partitionBy("row_id", F.col("_posture").isNotNull(), "_other").orderBy("second", "event_id"))
    rows = rows.withColumn("_run", run).withColumn("_length", F.count(F.lit(1)).over(Window.partitionBy("row_id", F.col("_posture").isNotNull(), "_other", "_run")))
    hits = (
        (F.col("_before") == "green") & F.col("_colour").isin("yellow", "red"),
        state.isNotNull() & ~state.isin("", "nan", "unknown") & (state != home),
        F.col("_other") & F.col("_posture").isNotNull() & (F.col("_length") >= min_run),
    )
    found = rows.groupBy("row_id").agg(*[F.min(F.when(h, F.col("second"))).alias(n) for n, h in zip(EXIT_SIGNALS, hits, strict=True)])
    wide = known.select("row_id", "last_furniture", "departure_seconds").join(found, "row_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signal_type"), F.col(n).alias("signal_seconds")) for n in EXIT_SIGNALS])).alias("x")
    out = wide.select("row_id", "last_furniture", "departure_seconds", each).select("row_id", "last_furniture", "departure_seconds", "x.*")
    return out.withColumn("bias_seconds", F.col("signal_seconds") - F.col("departure_seconds")).withColumn("found", F.col("signal_seconds").isNotNull())


def exit_summary(concordance: DataFrame) -> DataFrame:
    """B127: events, detections, bias and absolute error by signal."""
    err, q = F.abs("bias_seconds"), lambda c, p: F.percentile(c, F.lit(p))
    return concordance.groupBy("signal_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("bias_seconds").alias("detected"), q(F.col("bias_seconds"), 0.5).alias("bias_median"), F.round(F.avg("bias_seconds"), 6).alias("bias_mean"),
        F.round(F.avg(err), 6).alias("mae"), q(err, 0.5).alias("p50_abs_error"), q(err, 0.9).alias("p90_abs_error"),
    )
