"""Windows around anchors, control windows, and how the two differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import timefn
from tideline.operators.joins import interval_join
from tideline.sources.staging import stage

DISTANCES = ("chair", "bed", "room")


def primary_candidate(arr: Column, fallback: Column) -> Column:
    """The element of highest (score_patient, score, tracked), from the fallback array where there is none, with its source."""
    rank = lambda x: F.struct(-F.coalesce(x["score_patient"], F.lit(0.0)), -F.coalesce(x["score"], F.lit(0.0)), -F.coalesce(x["has_tracked"], F.lit(False)).cast("int"))

    def best(a):
        return F.get(F.array_sort(F.transform(a, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x")))), F.lit(0))["x"]

    first, second = best(arr), best(fallback)
    label = lambda x: F.nullif(F.lower(F.trim(x["posture"])), F.lit(""))
    return F.when(first.isNotNull(), F.struct(label(first).alias("posture"), F.lit("primary").alias("source"))).when(second.isNotNull(), F.struct(label(second).alias("posture"), F.lit("fallback").alias("source")))


def dominant_state(chair: str, bed: str, room: str) -> Column:
    """The state of the least distance; ties in the order chair, bed, room; no_patient without any."""
    far = 1e12
    c, b, r = (F.coalesce(F.col(x), F.lit(far)) for x in (chair, bed, room))
    least = F.least(c, b, r)
    return F.when(least == far, "no_patient").when(c == least, "chair").when(b == least, "bed").otherwise("room")


def signal_flags(signals: DataFrame) -> DataFrame:
    """Which parts of a signal are there, its label, and scores on 0..1."""
    located = F.coalesce(*[F.col(f"d_{s}") for s in DISTANCES]).isNotNull()
    posture = F.coalesce(F.col("posture"), F.col("score_sitting").cast("string"), F.col("score_standing").cast("string"), F.col("score_lying").cast("string")).isNotNull()
    return signals.withColumn("has_location", located).withColumn("has_posture", posture).withColumn("state", dominant_state("d_chair", "d_bed", "d_room"))


def normalise_score(score: Column) -> Column:
    """Scores over 1 are percentages."""
    return F.least(F.greatest(F.when(score > 1, score / 100).otherwise(score), F.lit(0.0)), F.lit(1.0))


def window_panel(anchors: DataFrame, signals: DataFrame, keys: list[str], lo_s: int, hi_s: int, near_s: int, unit_s: int = 1) -> DataFrame:
    """The signals around each anchor with their offset (in unit_s) and phase: pre_long, pre_immediate or post."""
    found = interval_join(anchors, signals, keys, lo_s, hi_s, wildcard="subject_id")
    micros = F.unix_micros("ts") - F.unix_micros("anchor_ts")
    phase = F.when(micros >= 0, "post").when(micros >= -near_s * 1_000_000, "pre_immediate").otherwise("pre_long")
    return signal_flags(found).withColumn("offset", F.floor(micros / (unit_s * 1_000_000))).withColumn("phase", phase)


def window_summary(anchors: DataFrame, signals: DataFrame, keys: list[str], reach_s: int, focus_s: int, dropout_s: int, bin_s: int) -> DataFrame:
    """A row per anchor: counts and bins of the focus and dropout windows, inverse-distance weights, posture shares and switches, first response."""
    j = signal_flags(interval_join(anchors, signals, keys, -reach_s, reach_s, wildcard="subject_id", how="left"))
    back = F.unix_micros("anchor_ts") - F.unix_micros("ts")
    j = j.withColumn("seen", F.col("ts").isNotNull()).withColumn("focus", (back > 0) & (back <= focus_s * 1_000_000)).withColumn("drop", (back > 0) & (back <= dropout_s * 1_000_000))
    j = j.withColumn("bin", timefn.bin_floor(F.col("ts"), bin_s)).withColumn("visible", F.col("seen") & F.col("has_location")).withColumn("posed", F.col("seen") & F.col("has_posture"))
    past = Window.partitionBy("anchor_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("prev", F.last(F.when(F.col("posed"), F.col("posture")), ignorenulls=True).over(past))
    overlap = (back <= 0) & (F.col("staff_iou") > 0)
    weight = lambda s: F.coalesce(F.sum(F.when(F.col("focus") & F.col(f"d_{s}").isNotNull(), 1 / F.greatest(f"d_{s}", F.lit(1e-6)))), F.lit(0.0))
    count = F.count_if
    posture = ("sitting", "standing", "lying")
    g = j.groupBy("anchor_id", "anchor_ts").agg(
        count(F.col("seen") & (back > 0)).alias("pre_frames"), count(F.col("seen") & (back <= 0)).alias("post_frames"),
        count("focus").alias("focus_frames"), count(F.col("focus") & F.col("visible")).alias("focus_visible_frames"),
        F.count_distinct(F.when(F.col("drop"), F.col("bin"))).alias("drop_bins"), F.count_distinct(F.when(F.col("drop") & F.col("visible"), F.col("bin"))).alias("drop_visible_bins"),
        *[F.min(F.when(F.col("focus"), F.col(f"d_{s}"))).alias(f"min_{s}") for s in DISTANCES],
        F.max(F.when(F.col("drop") & F.col("visible"), F.col("ts"))).alias("last_visible_ts"),
        *[weight(s).alias(f"w_{s}") for s in DISTANCES],
        count(F.col("drop") & F.col("posed")).alias("posture_frames"),
        *[F.avg(F.when(F.col("drop") & F.col("posed"), F.col(f"score_{p}"))).alias(f"mean_{p}") for p in posture],
        *[count(F.col("drop") & (F.col("posture") == p)).alias(f"n_{p}") for p in posture],
        count(F.col("drop") & F.col("posed") & (F.col("prev") != F.col("posture"))).alias("posture_switches"),
        F.min(F.when(overlap, F.col("ts"))).alias("first_response_ts"), count(overlap).alias("response_frames"),
    )
    g = g.withColumns({f"share_{p}": F.try_divide(f"n_{p}", "posture_frames") for p in posture}).drop(*[f"n_{p}" for p in posture])
    g = g.withColumn("response_detected", F.col("first_response_ts").isNotNull())
    return g.withColumn("response_latency_seconds", timefn.seconds_between(F.col("first_response_ts"), F.col("anchor_ts")))


def visibility_score(summary: DataFrame, dropout_s: int) -> DataFrame:
    """Visibility and gap ratios, and the probabilities of a visible and of an unknown state."""
    gap = timefn.seconds_between(F.col("anchor_ts"), F.col("last_visible_ts"))
    clip = lambda c, lo=0.0, hi=1.0: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    out = summary.withColumn("signal_count", sum((F.col(f"min_{s}").isNotNull().cast("int") for s in DISTANCES), F.lit(0)))
    out = out.withColumn("visibility_ratio", F.try_divide("drop_visible_bins", "drop_bins")).withColumn("last_visible_gap_seconds", gap)
    out = out.withColumn("gap_ratio", F.when(F.col("last_visible_ts").isNull(), 1.0).otherwise(clip(gap / F.lit(float(dropout_s)))))
    out = out.withColumn("dropout_ratio", F.when(F.col("drop_bins") == 0, 0.0).otherwise(1 - F.col("drop_visible_bins") / F.col("drop_bins")))
    seen = F.greatest(F.lit(0.15), 1 - clip(0.65 * F.col("dropout_ratio") + 0.35 * F.col("gap_ratio"), 0.0, 0.85))
    out = out.withColumn("visible_prob", F.when((F.col("drop_bins") == 0) | (F.col("drop_visible_bins") == 0), 0.0).otherwise(seen))
    return out.withColumn("unknown_prob", F.when(F.col("drop_bins") == 0, 1.0).otherwise(0.0))


def legacy_state_probs(scored: DataFrame) -> DataFrame:
    """The visible mass by inverse distance, and the rest split into not visible, out of room and unknown."""
    total = F.col("w_chair") + F.col("w_bed") + F.col("w_room")
    cond = lambda s: F.when((F.col("visible_prob") > 0) & (total > 0), F.col(f"w_{s}") / total).otherwise(0.0)
    room = F.when(total > 0, F.col("w_room") / total).otherwise(0.0)
    away = F.least(F.lit(0.90), F.greatest(F.lit(0.10), 0.30 + 0.55 * room + 0.15 * F.col("dropout_ratio")))
    away = F.when(F.col("drop_bins") == 0, 0.0).when(F.col("drop_visible_bins") == 0, 0.5).otherwise(away)
    missing = F.when(F.col("drop_bins") == 0, 0.0).otherwise(1 - F.col("visible_prob") - F.col("unknown_prob"))
    out = scored.withColumns({f"prob_{s}": F.col("visible_prob") * cond(s) for s in DISTANCES})
    out = out.withColumn("prob_out_of_room", missing * away).withColumn("prob_not_visible", missing * (1 - away))
    out = out.withColumn("out_of_room_share", away)
    return out.withColumn("prob_no_patient", F.col("prob_not_visible") + F.col("prob_out_of_room") + F.col("unknown_prob"))


def label_and_margin(probs: DataFrame) -> DataFrame:
    """The likeliest state, ties in the order no_patient, chair, bed, room, and its lead over the next."""
    p = {s: F.col(f"prob_{s}") for s in ("no_patient", "chair", "bed", "room")}
    top = F.greatest(*p.values())
    label = F.lit("room")
    for s in ("bed", "chair", "no_patient"):
        label = F.when(p[s] == top, s).otherwise(label)
    ordered = F.sort_array(F.array(*p.values()), asc=False)
    return probs.withColumn("label", label).withColumn("margin", F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def control_anchors(anchors: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """The hazard anchor and one control per earlier day; offsets must be negative, and repeated ones count once."""
    if any(d >= 0 for d in days) or not days:
        raise ValueError("control days must be negative, and there must be one")
    roles = [("hazard", 0)] + [(f"control_{-d}d", d) for d in dict.fromkeys(days)]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("window_role"), F.lit(d).alias("day")) for r, d in roles]))
    out = anchors.withColumn("event_ts", F.col("anchor_ts")).withColumn("_r", each)
    shifted = F.timestamp_micros(F.unix_micros("anchor_ts") + F.col("_r.day") * 86_400_000_000)
    return out.withColumn("window_role", F.col("_r.window_role")).withColumn("anchor_ts", shifted).drop("_r")


def anchor_proximity(roles: DataFrame, anchors: DataFrame, keys: list[str], reach_s: int) -> DataFrame:
    """Events of the unit within reach of each role's anchor, its own event aside; controls with any are not eligible."""
    others = anchors.select(*keys, F.col("anchor_id").alias("other_id"), F.col("anchor_ts").alias("ts"))
    near = interval_join(roles.select("anchor_id", "window_role", *keys, "anchor_ts"), others, keys, -reach_s, reach_s)
    n = near.filter("other_id <> anchor_id").groupBy("anchor_id", "window_role").agg(F.count(F.lit(1)).alias("nearby"))
    out = roles.join(n, ["anchor_id", "window_role"], "left").withColumn("nearby", F.coalesce("nearby", F.lit(0).cast("long")))
    return out.withColumn("eligible_window", (F.col("window_role") == "hazard") | (F.col("nearby") == 0))


def role_summary(roles: DataFrame, signals: DataFrame, keys: list[str], before_s: int) -> DataFrame:
    """State shares, mean distances, overlap and state switches of the time before each role's anchor."""
    frames = roles.select("anchor_id", "window_role", *keys, "anchor_ts")
    j = signal_flags(interval_join(frames, signals, keys, -before_s, 0)).filter("ts < anchor_ts")
    w = Window.partitionBy("anchor_id", "window_role").orderBy("ts", "event_id")
    j = j.withColumn("prev", F.lag("state").over(w))
    g = j.groupBy("anchor_id", "window_role").agg(
        F.count(F.lit(1)).alias("frame_count"), F.avg(F.col("has_location").cast("double")).alias("visibility_ratio"),
        *[F.avg((F.col("state") == s).cast("double")).alias(f"{s}_share") for s in (*DISTANCES, "no_patient")],
        *[F.avg(f"d_{s}").alias(f"mean_d_{s}") for s in DISTANCES], F.avg("staff_iou").alias("mean_iou"), F.max("staff_iou").alias("max_iou"),
        F.count_if(F.col("prev") != F.col("state")).alias("switches"),
    )
    return roles.join(g, ["anchor_id", "window_role"], "left").withColumn("frame_count", F.coalesce("frame_count", F.lit(0).cast("long")))


def _nearest_in(anchors: DataFrame, chunks: DataFrame, keys: list[str], tier: int, k: int) -> DataFrame:
    """For every anchor the k chunks of its keys that are nearest in time, ties by chunk_id, and how many there are.

    An anchor's place among the chunks of its keys, in order of time, tells which k before it and k after it to look at.
    """
    by = Window.partitionBy(*keys)
    placed = chunks.select(*keys, "chunk_id", "ct", F.row_number().over(by.orderBy("ct", "chunk_id")).alias("up"), F.row_number().over(by.orderBy("ct", F.col("chunk_id").desc())).alias("down"), F.count(F.lit(1)).over(by).alias("candidates"))
    both = chunks.select(*keys, F.col("ct").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor_id")).unionByName(anchors.select(*keys, F.col("et").alias("t"), F.lit(1).alias("kind"), "anchor_id"))
    before = F.sum(1 - F.col("kind")).over(by.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("_p", before).filter("kind = 1").select(*keys, "anchor_id", F.col("t").alias("et"), "_p")
    look = lambda lo, hi: F.explode(F.sequence(F.col("_p") + lo, F.col("_p") + hi))
    down = at.select(*keys, "anchor_id", "et", look(1 - k, 0).alias("down")).join(placed.drop("up"), [*keys, "down"]).drop("down")
    up = at.select(*keys, "anchor_id", "et", look(1, k).alias("up")).join(placed.drop("down"), [*keys, "up"]).drop("up")
    found = down.unionByName(up).withColumn("gap", F.abs(F.col("ct") - F.col("et")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy("gap", "chunk_id"))).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "chunk_id", F.lit(tier).alias("tier"), "candidates", F.col("rank").cast("long").alias("rank"), (F.col("gap") / 1_000_000).cast("long").alias("gap_seconds"))


def match_controls(anchors: DataFrame, chunks: DataFrame, event_units: DataFrame, zone: str, k: int) -> DataFrame:
    """Up to k chunks of units without events, of the anchor's division: of its hour, else its daypart, else any; nearest in time first.

    Each tier looks only for the anchors that those before it left, and at 2k chunks an anchor.
    """
    free = chunks.join(event_units.select("monitor_id").filter("monitor_id IS NOT NULL").distinct(), "monitor_id", "left_anti")
    local = F.hour(timefn.to_local(F.col("anchor_ts"), zone))
    a = stage(anchors.select("anchor_id", "division_id", F.unix_micros("anchor_ts").alias("et"), local.alias("h"), timefn.daypart(local).alias("p")), "match-anchors")
    c = stage(free.select("division_id", "chunk_id", F.unix_micros("anchor_ts").alias("ct"), F.col("anchor_hour").alias("h"), F.col("anchor_daypart").alias("p")), "match-chunks")
    out = None
    for tier, keys in ((1, ["division_id", "h"]), (2, ["division_id", "p"]), (3, ["division_id"])):
        made = stage(_nearest_in(a, c, keys, tier, k), "matched")
        out = made if out is None else out.unionByName(made)
        a = a.join(made.select("anchor_id").distinct(), "anchor_id", "left_anti")
    return out


def paired_effects(windows: DataFrame, metrics: list[str]) -> DataFrame:
    """Hazard less the mean of the event's eligible controls, by metric: mean, median and pairs."""
    long = windows.filter("eligible_window").unpivot(["anchor_id", "window_role"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    hazard = F.avg(F.when(F.col("window_role") == "hazard", F.col("value")))
    control = F.avg(F.when(F.col("window_role") != "hazard", F.col("value")))
    delta = long.groupBy("anchor_id", "metric").agg((hazard - control).alias("delta")).filter("delta IS NOT NULL")
    return delta.groupBy("metric").agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", F.lit(0.5)).alias("median_delta"), F.count(F.lit(1)).alias("pairs"))


def match_quality(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched anchors and control counts by tier, with the unmatched."""
    per = matches.groupBy("anchor_id").agg(F.max("tier").alias("tier"), F.count(F.lit(1)).alias("n"))
    j = anchors.select("anchor_id").join(per, "anchor_id", "left")
    name = F.when(F.col("tier") == 1, "same_hour").when(F.col("tier") == 2, "same_daypart").when(F.col("tier") == 3, "division").otherwise("no_candidate")
    return j.groupBy(name.alias("match")).agg(F.count(F.lit(1)).alias("anchors"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("controls"))


def localized_metrics(panel: DataFrame, near_s: int) -> DataFrame:
    """Shares, mean distance, its slope from first to last signal, and the first overlap, of the time just before the anchor."""
    back = F.unix_micros("anchor_ts") - F.unix_micros("ts")
    p = panel.filter((back > 0) & (back <= near_s * 1_000_000)).withColumn("d", F.least("d_chair", "d_bed", "d_room"))
    key = F.when(F.col("d").isNotNull(), F.struct("ts", "event_id"))
    g = p.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("frames"), *[F.avg((F.col("state") == s).cast("double")).alias(f"{s}_share") for s in DISTANCES],
        F.avg("d").alias("mean_distance"), F.min_by("d", key).alias("_a"), F.max_by("d", key).alias("_z"), F.min(F.when(F.col("d").isNotNull(), F.col("ts"))).alias("_ta"), F.max(F.when(F.col("d").isNotNull(), F.col("ts"))).alias("_tz"),
    )
    span = (F.unix_micros("_tz") - F.unix_micros("_ta")) / 1e6
    return g.withColumn("distance_slope", F.when(span > 0, (F.col("_z") - F.col("_a")) / span)).drop("_a", "_z", "_ta", "_tz")


def response_curve(summary: DataFrame, last: int, unit_s: int = 1) -> DataFrame:
    """Share of anchors with a response by each step 0..last."""
    spark = summary.sparkSession
    step = F.floor(F.col("response_latency_seconds") / unit_s)
    hits = summary.filter("response_detected").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    total = summary.agg(F.count(F.lit(1)).alias("total"))
    grid = spark.range(last + 1).withColumnRenamed("id", "step").join(hits, "step", "left").crossJoin(F.broadcast(total))
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("step"))
    return grid.select("step", run.alias("detected"), F.try_divide(run.cast("double"), "total").alias("rate"))
