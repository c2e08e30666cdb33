"""Events per exposure by state, and how the rates hold up under other assumptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import DEFAULT
from tideline.operators.joins import global_rank

CELL = ["division_id", "daypart", "day_of_week", "calendar_quarter"]


def per(count: Column, exposure: Column, hours: int, digits: int = 4) -> Column:
    """Events per so many exposure hours; null without exposure."""
    return F.when(exposure > 0, F.round(count / exposure * hours, digits))


def _two_states(df: DataFrame, keep: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Long form: a row per state; pairs maps a new column to the (chair, bed) columns behind it."""
    rows = [F.struct(F.lit(s).alias("position"), *[F.col(p[i]).alias(n) for n, p in pairs.items()]) for i, s in enumerate(("chair", "bed"))]
    return df.select(*keep, F.explode(F.array(*rows)).alias("_s")).select(*keep, "_s.*")


def rates_by_state(scope: DataFrame, events: DataFrame) -> DataFrame:
    """Exposure, expected and hard-label events per 1,000 hours, in total and by daypart. A daypart needs exposure to show."""
    zero = F.lit(0.0)
    total = F.when(F.grouping("daypart") == 1, "all_dayparts").otherwise(F.coalesce("daypart", F.lit("unknown"))).alias("stratum")
    scope, events = (d.withColumn("daypart", F.coalesce("daypart", F.lit("unknown"))) for d in (scope, events))
    hours = scope.rollup("daypart").agg(total, F.max("scope").alias("scope"), F.sum(F.coalesce("pct_chair", zero)).alias("h_chair"), F.sum(F.coalesce("pct_bed", zero)).alias("h_bed")).drop("daypart")
    found = events.rollup("daypart").agg(
        total, F.count(F.lit(1)).alias("eligible_event_count"),
        F.sum(F.coalesce("pre_prob_chair", zero)).alias("e_chair"), F.sum(F.coalesce("pre_prob_bed", zero)).alias("e_bed"),
        F.count_if(F.col("label") == "chair").alias("l_chair"), F.count_if(F.col("label") == "bed").alias("l_bed"),
    ).drop("daypart")
    wide = hours.join(found, "stratum", "left").na.fill(0)
    long = _two_states(wide, ["scope", "stratum", "eligible_event_count"], {"hours": ("h_chair", "h_bed"), "expected": ("e_chair", "e_bed"), "hard": ("l_chair", "l_bed")})
    return long.select(
        "scope", F.col("stratum").alias("daypart"), "position", "eligible_event_count", F.round("hours", 4).alias("exposure_hours"),
        F.round("expected", 4).alias("expected_falls"), F.col("hard").alias("hard_label_falls"),
        per(F.col("expected"), F.col("hours"), 1000).alias("rate_per_1000_expected"), per(F.col("hard"), F.col("hours"), 1000).alias("rate_per_1000_hard"),
    )


def operational_rates(scope: DataFrame) -> DataFrame:
    """Counters weighted by state shares, per exposure hour, and the ratio of the two states."""
    metrics = {"alarms": "num_alarms", "nudges": "num_nudges", "announcements": "num_announcements"}
    wide = scope.groupBy("scope").agg(
        F.sum("pct_chair").alias("h_chair"), F.sum("pct_bed").alias("h_bed"),
        *[F.sum(F.col(c) * F.col(f"pct_{s}")).alias(f"{m}_{s}") for m, c in metrics.items() for s in ("chair", "bed")],
    )
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_chair").alias("w_chair"), F.col(f"{m}_bed").alias("w_bed")) for m in metrics])
    by_metric = wide.select("scope", "h_chair", "h_bed", F.explode(rows).alias("m")).select("scope", "h_chair", "h_bed", "m.*")
    rate = lambda s: F.when(F.col(f"h_{s}") > 0, F.round(F.col(f"w_{s}") / F.col(f"h_{s}"), 6))
    ratio = by_metric.withColumn("rate_ratio", F.when(rate("bed") > 0, F.round(rate("chair") / rate("bed"), 6)))
    long = _two_states(ratio, ["scope", "metric", "rate_ratio"], {"hours": ("h_chair", "h_bed"), "weighted": ("w_chair", "w_bed")})
    return long.select(
        "scope", "metric", "position", F.round("hours", 4).alias("exposure_hours"), F.round("weighted", 4).alias("weighted_event_count"),
        per(F.col("weighted"), F.col("hours"), 1, 6).alias("rate_per_hour"), per(F.col("weighted"), F.col("hours"), 100).alias("rate_per_100_hours"), "rate_ratio",
    )


def confidence_features(events: DataFrame) -> DataFrame:
    """A weight of visibility, its ratio and how long ago the subject was seen, and a segment of three."""
    seen = F.coalesce(F.col("pre_state_visible_prob"), F.lit(0.0))
    ratio = F.coalesce(F.col("pre_dropout_visibility_ratio"), F.lit(0.0))
    gap = F.greatest(F.coalesce(F.col("pre_dropout_last_visible_gap_seconds").cast("double"), F.lit(360.0)), F.lit(0.0))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    weight = clip(0.50 * seen + 0.35 * ratio + 0.15 * clip(1 - gap / 180))
    low = (seen < 0.40) | (ratio < 0.40) | (gap > 180)
    high = (seen >= 0.70) & (ratio >= 0.70) & (gap <= 90)
    segment = F.when(low, "low_confidence").when(high, "high_confidence").otherwise("medium_confidence")
    return events.withColumn("confidence_weight", weight).withColumn("confidence_segment", segment)


def _event_sums():
    p = lambda s: F.coalesce(F.col(f"pre_prob_{s}"), F.lit(0.0))
    out = [F.count(F.lit(1)).alias("n"), F.avg("confidence_weight").alias("mean_weight")]
    for s in ("chair", "bed"):
        out += [F.sum(p(s)).alias(f"e_{s}"), F.sum(p(s) * F.col("confidence_weight")).alias(f"w_{s}"), F.count_if(F.col("label") == s).alias(f"l_{s}")]
    return out


def _exposure(scope: DataFrame) -> DataFrame:
    return scope.groupBy().agg(F.max("scope").alias("scope"), F.sum("pct_chair").alias("h_chair"), F.sum("pct_bed").alias("h_bed"))


_SUMS = {"hours": ("h_chair", "h_bed"), "expected": ("e_chair", "e_bed"), "weighted": ("w_chair", "w_bed"), "hard": ("l_chair", "l_bed")}


def _rates():
    return [
        F.round("hours", 4).alias("exposure_hours"), F.round("expected", 4).alias("expected_falls"), F.round("weighted", 4).alias("weighted_expected_falls"), F.col("hard").alias("hard_label_falls"),
        *[per(F.col(c), F.col("hours"), 1000).alias(f"rate_per_1000_{c}") for c in ("expected", "weighted", "hard")],
    ]


def confidence_sensitivity(scope: DataFrame, events: DataFrame) -> DataFrame:
    """Rates of all events and of each confidence segment, over the same exposure."""
    scored = confidence_features(events)
    seg = F.when(F.grouping("confidence_segment") == 1, "all_events").otherwise(F.col("confidence_segment")).alias("segment")
    sums = scored.rollup("confidence_segment").agg(seg, *_event_sums()).filter("n > 0").drop("confidence_segment")
    long = _two_states(sums.crossJoin(F.broadcast(_exposure(scope))), ["scope", "segment", "n", "mean_weight"], _SUMS)
    return long.select("scope", F.col("segment").alias("confidence_segment"), "position", F.col("n").alias("eligible_event_count"), F.round("mean_weight", 4).alias("mean_confidence_weight"), *_rates())


def missingness_stress(scope: DataFrame, events: DataFrame, cuts: tuple[int, ...] = DEFAULT.missingness_cuts, tie: str = "event_id") -> DataFrame:
    """Rates and their ratios after dropping the least confident events, for each cut in percent.

    Ties in the weight fall by ``tie``. The order over all events is that of sorted partitions, see joins.global_rank.
    """
    scored = confidence_features(events)
    ranked = global_rank(scored, ["confidence_weight", tie], "_r")
    total = scored.groupBy().agg(F.count(F.lit(1)).alias("n_total"))
    cut = F.explode(F.array(*[F.lit(c) for c in sorted(set(cuts))])).alias("cut")
    marked = ranked.crossJoin(F.broadcast(total)).select("*", cut).withColumn("_out", F.floor(F.col("n_total") * F.col("cut") / 100)).filter("_r > _out")
    sums = marked.groupBy("cut", "n_total").agg(*_event_sums())
    wide = sums.crossJoin(F.broadcast(_exposure(scope)))
    rate = lambda c, s: per(F.col(f"{c}_{s}"), F.col(f"h_{s}"), 1000)
    ratios = {f"ratio_{n}": F.when(rate(c, "bed") > 0, F.round(rate(c, "chair") / rate(c, "bed"), 6)) for n, c in (("expected", "e"), ("weighted", "w"), ("hard", "l"))}
    long = _two_states(wide.withColumns(ratios), ["scope", "cut", "n", "n_total", "mean_weight", *ratios], _SUMS)
    return long.select(
        "scope", F.col("cut").alias("excluded_pct"), F.col("n").alias("retained"), (F.col("n_total") - F.col("n")).alias("excluded"), F.round(F.col("n") / F.col("n_total"), 4).alias("retained_fraction"),
        F.round("mean_weight", 4).alias("mean_confidence_weight"), "position", *_rates(), *ratios,
    )


def reconciliation(events: DataFrame, linked: DataFrame) -> DataFrame:
    """How many events each step of the funnel keeps, by metric."""
    raw = events.agg(F.count(F.lit(1)).alias("raw_events"), F.count_if(F.col("subject_id").isNull()).alias("events_without_subject"))
    kept = linked.agg(F.count(F.lit(1)).alias("linked_events"), F.count_if(F.col("label").isin("chair", "bed")).alias("hard_label_events"))
    wide = raw.crossJoin(kept)
    return wide.unpivot([], list(wide.columns), "metric", "value")


def position_cells(base: DataFrame, floor: float = DEFAULT.exposure_floor, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events of an hour shared out by the two states' shares, summed by cell and state (and keys)."""
    total = F.greatest(F.col("pct_chair") + F.col("pct_bed"), F.lit(1e-9))
    wide = base.withColumns({f"f_{s}": F.col("falls_in_hour") * F.col(f"pct_{s}") / total for s in ("chair", "bed")})
    long = _two_states(wide, [*keys, *CELL], {"hours": ("pct_chair", "pct_bed"), "events": ("f_chair", "f_bed")})
    cells = long.groupBy(*keys, *CELL, "position").agg(F.sum("hours").alias("exposure_hours"), F.sum("events").alias("fall_count"))
    return cells.withColumn("exposure_hours", F.greatest("exposure_hours", F.lit(floor)))


def third_state_rate(base: DataFrame) -> DataFrame:
    """The ambulatory state's unadjusted rate per 1,000 hours."""
    total = F.greatest(F.col("pct_chair") + F.col("pct_bed") + F.col("pct_ambulatory"), F.lit(1e-9))
    s = base.agg(F.coalesce(F.sum(F.col("falls_in_hour") * F.col("pct_ambulatory") / total), F.lit(0.0)).alias("n_events"), F.coalesce(F.sum("pct_ambulatory"), F.lit(0.0)).alias("exposure_hours"))
    return s.withColumn("rate_per_1000", F.col("n_events") / F.greatest("exposure_hours", F.lit(1e-9)) * 1000)


def subset_of() -> Column:
    """The subsets of the sensitivity analysis that an hour belongs to: its daypart, weekdays or weekends, and hours mostly in one state."""
    weekend = F.col("day_of_week").isin("Saturday", "Sunday")
    certain = (F.col("pct_chair") >= 0.5) | (F.col("pct_bed") >= 0.5)
    return F.array_compact(F.array(F.col("daypart"), F.when(weekend, "weekend_only").otherwise("weekday_only"), F.when(certain, "position_certain_only")))


def subset_rates(base: DataFrame) -> DataFrame:
    """Crude rates and their ratio in the subsets; models.subset_models refits the model on each."""
    tagged = base.withColumn("subset", F.explode(subset_of()))
    total = F.greatest(F.col("pct_chair") + F.col("pct_bed"), F.lit(1e-9))
    g = tagged.groupBy("subset").agg(*[F.sum(f"pct_{s}").alias(f"hours_{s}") for s in ("chair", "bed")], *[F.sum(F.col("falls_in_hour") * F.col(f"pct_{s}") / total).alias(f"events_{s}") for s in ("chair", "bed")])
    rate = lambda s: F.try_divide(f"events_{s}", f"hours_{s}")
    return g.withColumn("rate_ratio", F.try_divide(rate("chair"), rate("bed")))


#: Scenario, chair-to-bed and bed-to-chair rates (fixed values).
SWAPS = (("symmetric_swap_10pct", 0.10, 0.10), ("symmetric_swap_20pct", 0.20, 0.20), ("symmetric_swap_30pct", 0.30, 0.30), ("chair_to_bed_20pct", 0.20, 0.0), ("bed_to_chair_20pct", 0.0, 0.20))


def misclassification_swap(cells: DataFrame, scenarios=SWAPS, floor: float = DEFAULT.exposure_floor) -> DataFrame:
    """The cells of each scenario, with event mass moved between the states of a stratum."""
    wide = cells.groupBy(*CELL).pivot("position", ["chair", "bed"]).agg(F.sum("exposure_hours").alias("h"), F.sum("fall_count").alias("f")).na.fill(0.0)
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("p"), F.lit(q).alias("q")) for n, p, q in scenarios])
    each = wide.withColumn("_s", F.explode(rows)).select("*", "_s.*").drop("_s")
    each = each.withColumn("a_chair", (1 - F.col("p")) * F.col("chair_f") + F.col("q") * F.col("bed_f")).withColumn("a_bed", (1 - F.col("q")) * F.col("bed_f") + F.col("p") * F.col("chair_f"))
    long = _two_states(each, [*CELL, "scenario"], {"exposure_hours": ("chair_h", "bed_h"), "fall_count": ("a_chair", "a_bed")})
    return long.withColumn("exposure_hours", F.greatest("exposure_hours", F.lit(floor))).withColumn("fall_count", F.greatest("fall_count", F.lit(0.0)))


def origin_reclassify(base: DataFrame, flagged: DataFrame) -> DataFrame:
    """Hours with events whose unit and hour are flagged count as the chair state alone."""
    keys = flagged.select(F.col("monitor_id").alias("_m"), F.col("hour_ts").alias("_h"), F.lit(True).alias("_flag")).distinct()
    out = base.join(keys, (F.col("monitor_id") == F.col("_m")) & (F.col("hour_ts") == F.col("_h")), "left")
    hit = F.col("_flag").isNotNull() & (F.col("falls_in_hour") > 0)
    return out.withColumn("pct_chair", F.when(hit, 1.0).otherwise(F.col("pct_chair"))).withColumn("pct_bed", F.when(hit, 0.0).otherwise(F.col("pct_bed"))).drop("_m", "_h", "_flag")


def reclassify_diagnostic(base: DataFrame, flagged: DataFrame) -> DataFrame:
    """Which flagged events lie on an hour of the base, and what was there."""
    hours = base.groupBy("monitor_id", "hour_ts").agg(F.sum("falls_in_hour").alias("falls_in_matched_hour"), F.min("pct_chair").alias("pct_chair_original"))
    out = flagged.join(hours, ["monitor_id", "hour_ts"], "left")
    matched = F.col("falls_in_matched_hour").isNotNull()
    return out.withColumn("matched", matched).withColumn("falls_in_matched_hour", F.coalesce("falls_in_matched_hour", F.lit(0).cast("long")))
