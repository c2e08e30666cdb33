"""State attribution from the seconds before an anchor: recency-weighted features, and their blend with the window's priors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.config import STATES
from tideline.functions import probs as P
from tideline.operators.joins import spread

#: Offsets of the anchor and the tail window, in seconds before the event (fixed values).
ANCHOR, TAIL = (-180, -61), (-60, -1)
#: Columns of a frame that not every source has.
MORE = ("nudge_score", "motion", "n_patient", "n_staff", "n_other", "n_bed", "n_chair", "in_bed_score")


def prepare_panel(panel: DataFrame) -> DataFrame:
    """The frames of the two windows with what a source may lack as null, nudges on 0..1 by the panel's greatest, and posture scores that add up to 1 a frame.

    Nudges over 1 are percentages, or shares of the greatest where that is over 100; the greatest is a one-row frame.
    """
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in MORE if c not in panel.columns}).filter(F.col("offset").between(ANCHOR[0], TAIL[1]))
    top = panel.agg(F.max("nudge_score").alias("_top"))
    divisor = F.when(F.col("_top") > 100, F.col("_top")).when(F.col("_top") > 1, 100.0).otherwise(1.0)
    panel = panel.join(F.broadcast(top)).withColumn("nudge_score", P.clamp(F.coalesce(F.col("nudge_score") / divisor, F.lit(0.0)))).drop("_top")
    positive = {c: F.greatest(F.col(c), F.lit(0.0)) for c in MORE if c != "nudge_score"}
    panel = panel.withColumns({c: F.coalesce(v, F.lit(0.0)) if c.startswith("n_") else F.when(F.col(c).isNotNull(), v) for c, v in positive.items()})
    score = {x: F.when(F.col(f"score_{x}").isNotNull(), P.clamp(F.col(f"score_{x}"))) for x in P.POSTURES}
    total = sum((F.coalesce(c, F.lit(0.0)) for c in score.values()), F.lit(0.0))
    return panel.withColumn("_total", total).withColumns({f"score_{x}": F.when(F.col("_total") > 0, F.coalesce(c, F.lit(0.0)) / F.col("_total")).otherwise(c) for x, c in score.items()}).drop("_total")


def panel_summary(panel: DataFrame, half_life: float = 45.0, digits: int | None = None) -> DataFrame:
    """Per anchor with frames in the windows, their features in one aggregation, all in one distribution by anchor.

    Distances count by 2^(offset / half_life) / distance (0.75) beside label shares (0.25). Numbers are rounded to ``digits``
    where that is given. Sums are those of the posed frames in order and those of the others in order, which the scorers'
    thresholds can depend on where means tie with them.
    """
    inside = lambda w: F.col("offset").between(*w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    in_pose = F.coalesce(F.col("has_posture"), F.lit(False))

    def total(c):
        posed_sum, other_sum = F.sum(F.when(in_pose, c)), F.sum(F.when(~in_pose, c))
        return F.coalesce(posed_sum + other_sum, posed_sum, other_sum)

    panel = spread(prepare_panel(panel), "anchor_id", counted=panel, least=panel.sparkSession.sparkContext.defaultParallelism)
    seen = Window.partitionBy("anchor_id", inside(TAIL), "has_location").orderBy("offset", "event_id")
    pose = F.coalesce("posture", F.lit(""))
    posed_rows = Window.partitionBy("anchor_id", "has_posture").orderBy("offset", "event_id")
    speed = {f"v_{s}": (F.col(f"d_{s}") - F.lag(f"d_{s}").over(seen)) / F.nullif(F.col("offset") - F.lag("offset").over(seen), F.lit(0)) for s in P.VISIBLE}
    panel = panel.withColumns(speed).withColumn("_switch", F.lag(pose).over(posed_rows) != pose)
    recency = _recency(panel, half_life)
    average = lambda c: F.try_divide(total(c), F.count(c))
    aggs = [zero(average(F.when(inside(TAIL) & F.col("has_location"), F.col(f"v_{s}")))).alias(f"velocity_{s}") for s in P.VISIBLE]
    for name, win in (("anchor", ANCHOR), ("tail", TAIL)):
        on = inside(win) & F.col("has_location")
        aggs.append(F.count_if(on).alias(f"{name}_frames"))
        for s in P.VISIBLE:
            d = F.col(f"d_{s}")
            aggs.append(zero(total(F.when(on & d.isNotNull(), recency / F.greatest(d, F.lit(1e-6))))).alias(f"{name}_w_{s}"))
            aggs.append(F.count_if(on & (F.col("state") == s)).alias(f"{name}_n_{s}"))
        posed = inside(win) & F.col("has_posture")
        aggs.append(F.count_if(posed).alias(f"{name}_posture_frames"))
        among = lambda c, when=None, win=win: F.when(inside(win) if when is None else inside(win) & when, c)
        mean = lambda c, when=None, among=among: F.avg(among(c, when))
        aggs += [zero(mean((F.col("state") == s).cast("double"))).alias(f"{name}_share_{s}") for s in (*P.VISIBLE, "no_patient")]
        nearest = F.when(F.least(*[F.col(f"d_{s}") for s in P.VISIBLE]).isNotNull(), _nearest())
        aggs += [zero(mean((nearest == s).cast("double"), F.col("has_location"))).alias(f"{name}_nearest_{s}") for s in P.VISIBLE]
        aggs.append(average(among(F.col("d_bed") - F.col("d_room"), F.col("has_location"))).alias(f"{name}_room_bed_margin"))
        aggs += [zero(mean((F.col("posture") == p).cast("double"), F.col("has_posture") & F.col("posture").isin(*P.POSTURES))).alias(f"{name}_posture_share_{p}") for p in P.POSTURES]
        aggs += [zero(average(among(F.col(c)))).alias(f"{name}_{c}_mean") for c in MORE] + [zero(F.max(F.when(inside(win), F.col(c)))).alias(f"{name}_{c}_max") for c in MORE]
        aggs.append(zero(average(among(F.col("staff_iou")))).alias(f"{name}_overlap_mean"))
        aggs += [zero(F.sum(F.when(posed, recency * zero(F.col(f"score_{p}"))))).alias(f"{name}_p_{p}") for p in P.POSTURES]
    aggs += [
        F.max(F.when(inside(TAIL), F.col("staff_iou"))).alias("tail_overlap_max"), zero(F.max(F.when(inside(TAIL) & F.col("has_location"), F.col("staff_iou")))).alias("_seen_overlap"),
        F.max(F.when(F.col("has_location"), F.col("offset"))).alias("_last"), F.count_if("has_posture").alias("posture_frames"), F.count_if(F.col("has_posture") & F.col("_switch")).alias("posture_switches"),
    ]
    g = panel.groupBy("anchor_id").agg(*aggs)
    for name in ("anchor", "tail"):
        near = P.normalize_visible({s: F.col(f"{name}_w_{s}") for s in P.VISIBLE})
        share = P.normalize_visible({s: F.col(f"{name}_n_{s}") for s in P.VISIBLE})
        g = g.withColumn(f"{name}_near", near).withColumn(f"{name}_share", share)
        g = g.withColumn(f"{name}_probs", P.normalize_visible({s: 0.75 * F.col(f"{name}_near.{s}") + 0.25 * F.col(f"{name}_share.{s}") for s in P.VISIBLE}))
        g = g.withColumn(f"{name}_posture", P.normalize_posture({p: F.col(f"{name}_p_{p}") for p in P.POSTURES}))
        sum_ = sum((F.col(f"{name}_probs.{s}") for s in P.VISIBLE), F.lit(0.0))
        g = g.withColumn(f"{name}_label", F.when(sum_ > 0, P.argmax(F.col(f"{name}_probs"), P.VISIBLE)).otherwise("no_patient"))
    g = g.withColumn("last_visible_gap", (-F.col("_last")).cast("double"))
    room = F.greatest(F.col("tail_probs.room"), F.col("tail_share_room"), F.col("_seen_overlap"), F.col("tail_nudge_score_max"))
    g = g.withColumn("departure_detected", (room >= 0.35) & (F.col("tail_share_room") >= 0.10)).withColumn("room_bed_margin_delta", F.col("tail_room_bed_margin") - F.col("anchor_room_bed_margin"))
    drop = [c for c in g.columns if c in ("_last", "_seen_overlap") or c.endswith(("_near", "_share")) or c.startswith(tuple(f"{n}_{x}_" for n in ("anchor", "tail") for x in "wp")) or c in {f"{n}_n_{x}" for n in ("anchor", "tail") for x in P.VISIBLE}]
    g = g.drop(*drop)
    if digits is not None:
        rounded = {c: F.round(c, digits) for c, kind in g.dtypes if kind == "double"}
        rounded |= {c: P.struct({n: F.round(f"{c}.{n}", digits) for n in names}) for k in ("anchor", "tail") for c, names in ((f"{k}_probs", P.VISIBLE), (f"{k}_posture", P.POSTURES))}
        g = g.withColumns(rounded)
    return g


def _recency(panel: DataFrame, half_life: float) -> Column:
    """2^(offset / half_life). Whole offsets of the two windows are looked up: Spark's power and that of the C library, which SQL takes, differ in the last bit of some."""
    if isinstance(panel.schema["offset"].dataType, T.IntegralType):
        powers = F.array(*[F.lit(2.0 ** (o / half_life)) for o in range(TAIL[1], ANCHOR[0] - 1, -1)])
        return F.get(powers, (TAIL[1] - F.col("offset")).cast("int"))
    return F.pow(F.lit(2.0), F.col("offset") / half_life)


def _nearest() -> Column:
    """The visible state of least distance, ties in the order of VISIBLE."""
    least = F.least(*[F.col(f"d_{s}") for s in P.VISIBLE])
    return F.when(F.col("d_chair") == least, "chair").when(F.col("d_bed") == least, "bed").otherwise("room")


def blended_state(windows: DataFrame, summary: DataFrame, base_weight: float = 0.45, recent_gap_s: float = 60.0) -> DataFrame:
    """B51, B53-B55 together: the panel's blend of both windows under the window's own no_patient mass, a close race settled by approach, and the label."""
    j = windows.join(summary, "anchor_id", "left")
    zero = P.struct({s: F.lit(0.0) for s in P.VISIBLE})
    for n in ("anchor", "tail"):
        j = j.withColumn(f"{n}_probs", F.coalesce(f"{n}_probs", zero)).withColumn(f"{n}_frames", F.coalesce(f"{n}_frames", F.lit(0).cast("long")))
    weight = P.dynamic_anchor_weight(base_weight, F.col("anchor_probs"), F.col("tail_probs"), F.col("anchor_frames"), F.col("tail_frames"), F.col("last_visible_gap"), recent_gap_s)
    j = j.withColumn("anchor_weight", weight)
    mixed = P.normalize_visible({s: F.col("anchor_weight") * F.col(f"anchor_probs.{s}") + (1 - F.col("anchor_weight")) * F.col(f"tail_probs.{s}") for s in P.VISIBLE})
    j = j.withColumn("panel_visible", mixed).withColumn("legacy", P.normalize({s: F.col(f"prob_{s}") for s in ("chair", "bed", "room", "no_patient")}))
    j = j.withColumn("legacy_visible", P.normalize_visible({s: F.col(f"legacy.{s}") for s in P.VISIBLE}))
    j = j.withColumn("visible", P.blend((0.7, F.col("panel_visible")), (0.3, F.col("legacy_visible"))))
    seen = 1 - F.col("legacy.no_patient")
    j = j.withColumn("probs", P.normalize({**{s: seen * F.col(f"visible.{s}") for s in P.VISIBLE}, "no_patient": F.col("legacy.no_patient")}))
    cap = F.when(F.col("tail_frames") > 0, F.least(F.col("probs.no_patient"), F.lit(0.35))).otherwise(F.col("probs.no_patient"))
    j = j.withColumn("probs", P.set_no_patient(F.col("probs"), cap, F.col("visible")))
    speed = {s: F.col(f"velocity_{s}") for s in P.VISIBLE}
    j = j.withColumn("probs", P.velocity_tiebreak(F.col("probs"), speed, F.col("panel_visible.room")))
    return j.withColumn("label", P.argmax(F.col("probs"))).drop("legacy", "legacy_visible", "panel_visible", "visible")


def history_summary(signals: DataFrame, keys: list[str], bucket: int, half_life: float = 45.0) -> DataFrame:
    """The panel's features of every signal's own history, in time linear in the signals.

    signals: one row per unit and second ``t`` (a long), with has_location, state, d_..., staff_iou, posture, has_posture,
    score_... and MORE. A unit's time is cut into buckets of ``bucket`` seconds, each with a copy of the 180 seconds before
    it, so no task sees a unit's whole life. Within a bucket every sum over a window is a difference of running sums at its
    edges; weights decay from the bucket's start, so they stay in range. Only the four greatest values of the tail are
    taken over its 60 seconds. Rows without a history go.
    """
    t, reach = F.col("t"), -ANCHOR[0]
    copies = F.explode(F.sequence(F.floor(t / bucket), F.floor((t + reach) / bucket)))
    j = signals.withColumns({c: F.lit(None).cast("double") for c in MORE if c not in signals.columns}).withColumn("_own", F.floor(t / bucket)).withColumn("_bucket", copies)
    part = Window.partitionBy(*keys, "_bucket")
    w = part.orderBy("t")
    located, posed = F.col("has_location"), F.col("has_posture")
    j = j.withColumn("_up", F.pow(F.lit(2.0), (t - F.col("_bucket") * bucket) / half_life)).withColumn("_before", F.lag("t").over(w))
    for s in P.VISIBLE:
        j = j.withColumn(f"_v_{s}", F.when(located, (F.col(f"d_{s}") - F.lag(f"d_{s}").over(w)) / (t - F.col("_before"))))
    named = lambda c: F.when(F.col(c).isin(*P.POSTURES), F.col(c))
    j = j.withColumn("_switch", F.coalesce(posed & (named("posture") != F.lag(named("posture")).over(w)), F.lit(False)).cast("int"))
    nearest = lambda s: F.coalesce(located & (F.col(f"d_{s}") == F.least(*[F.col(f"d_{x}") for x in P.VISIBLE])) & _all_distances(), F.lit(False))
    one, zero = lambda c: F.coalesce(c, F.lit(False)).cast("int"), lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    margin = F.when(located, F.col("d_bed") - F.col("d_room"))
    sums = {"rows": F.lit(1), "frames": one(located), "share_room": one(F.col("state") == "room"), "share_no_patient": one(F.col("state") == "no_patient"), "posture_frames": one(posed), "switches": F.col("_switch"), "nearest_room": one(nearest("room")), "nearest_bed": one(nearest("bed"))}
    sums |= {f"w_{s}": zero(F.when(located & F.col(f"d_{s}").isNotNull(), F.col("_up") / F.greatest(F.col(f"d_{s}"), F.lit(1e-6)))) for s in P.VISIBLE} | {f"n_{s}": one(located & (F.col("state") == s)) for s in P.VISIBLE}
    sums |= {f"p_{x}": zero(F.when(posed, F.col(f"score_{x}") * F.col("_up"))) for x in P.POSTURES} | {f"c_{x}": one(posed & (F.col("posture") == x)) for x in P.POSTURES}
    means = {"overlap": F.col("staff_iou"), "margin": margin} | {c: F.col(c) for c in MORE} | {f"velocity_{s}": F.col(f"_v_{s}") for s in P.VISIBLE}
    sums |= {f"s_{n}": zero(c) for n, c in means.items()} | {f"k_{n}": one(c.isNotNull()) for n, c in means.items()}
    j = j.withColumns({f"_x_{n}": c for n, c in sums.items()})
    after = {n: F.lead(f"_x_{n}").over(w) for n in ("switches", *[f"{k}_velocity_{s}" for k in "sk" for s in P.VISIBLE])}
    j = j.withColumns({f"_y_{n}": F.coalesce(c, F.lit(0)) for n, c in after.items()})
    upto = {e: w.rangeBetween(Window.unboundedPreceding, end) for e, end in (("a", TAIL[1]), ("b", ANCHOR[1]), ("c", ANCHOR[0] - 1))}
    total = {f"_{e}_{n}": F.coalesce(F.sum(f"_x_{n}").over(frame), F.lit(0)) for e, frame in upto.items() for n in sums} | {f"_d_{n}": F.coalesce(F.sum(f"_y_{n}").over(upto["c"]), F.lit(0)) for n in after}
    tail = w.rangeBetween(*TAIL)
    tops = {"overlap": "staff_iou", "nudge_score": "nudge_score", "motion": "motion", "in_bed_score": "in_bed_score"}
    j = j.withColumns(total | {f"tail_{n}_max": F.max(c).over(tail) for n, c in tops.items()} | {"_last": F.max(F.when(located, t)).over(upto["a"])})
    j = j.filter((F.col("_own") == F.col("_bucket")) & (F.col("_a_rows") > F.col("_c_rows")))
    part_of = {"tail": lambda n: F.col(f"_a_{n}") - F.col(f"_b_{n}"), "anchor": lambda n: F.col(f"_b_{n}") - F.col(f"_c_{n}")}
    first_in_tail = part_of["anchor"]("rows") == 0

    def speeds(n):
        """A history's first row has no row before it: where that one lies in the tail, its speed is taken off again."""
        return part_of["tail"](n) - F.when(first_in_tail, F.col(f"_d_{n}") - F.col(f"_b_{n}")).otherwise(0)

    out = {"last_visible_gap": F.when(F.col("_last") >= t - reach, (t - F.col("_last")).cast("double")), "posture_frames": F.col("_a_posture_frames") - F.col("_c_posture_frames"), "posture_switches": F.col("_a_switches") - F.col("_d_switches")}
    out |= {f"velocity_{s}": F.try_divide(speeds(f"s_velocity_{s}"), speeds(f"k_velocity_{s}")) for s in P.VISIBLE}
    for n, x in part_of.items():
        frames, rows = x("frames"), x("rows")
        near = {s: x(f"w_{s}") / F.col("_up") + 0.25 * F.coalesce(F.try_divide(x(f"n_{s}"), frames), F.lit(0.0)) for s in P.VISIBLE}
        shares = P.normalize_posture({p: x(f"c_{p}") for p in P.POSTURES})
        out |= {f"{n}_frames": frames, f"{n}_probs": P.normalize_visible(near), f"{n}_posture_frames": x("posture_frames"), f"{n}_posture": P.normalize_posture({p: x(f"p_{p}") for p in P.POSTURES}), f"{n}_room_bed_margin": F.try_divide(x("s_margin"), x("k_margin"))}
        out |= {f"{n}_posture_share_{p}": shares[p] for p in P.POSTURES} | {f"{n}_{c}": F.try_divide(x(c), rows) for c in ("share_room", "share_no_patient")}
        out |= {f"{n}_{c}": F.try_divide(x(c), frames) for c in ("nearest_room", "nearest_bed")} | {f"{n}_{c}_mean": F.try_divide(x(f"s_{c}"), x(f"k_{c}")) for c in ("overlap", *MORE)}
    kept = [c for c in signals.columns if c not in (*MORE, "posture", "has_posture", "has_location", "state", "staff_iou", *[f"d_{s}" for s in P.VISIBLE], *[f"score_{p}" for p in P.POSTURES])]
    return j.select(*kept, *[F.col(f"tail_{n}_max") for n in tops], *[c.alias(n) for n, c in out.items()])


def _all_distances() -> Column:
    return F.col("d_chair").isNotNull() & F.col("d_bed").isNotNull() & F.col("d_room").isNotNull()


def second_states(signals: DataFrame, keys: list[str], bucket: int = 3600, w: Weights | None = None, t: Third | None = None) -> DataFrame:
    """The third scorer at every signal, over its own history: keys, t and probs.

    signals: as for history_summary, with base_... of the four states and, where known, EVIDENCE. Nudges over 1 are percentages.
    """
    w, t = w or Weights(), t or Third()
    frame = {x: P.clamp(F.coalesce(f"score_{x}", F.lit(0.0))) for x in P.POSTURES}
    score = P.normalize_posture(frame)
    nudge = F.col("nudge_score") if "nudge_score" in signals.columns else F.lit(None).cast("double")
    s = signals.withColumns({c: F.lit(None).cast("double") for c in EVIDENCE if c not in signals.columns}).withColumn("posture", F.lower(F.trim("posture")))
    posed = F.coalesce(F.col("posture").isin(*P.POSTURES), F.lit(False)) | (sum(frame.values(), F.lit(0.0)) > 0)
    s = s.withColumn("nudge_score", F.coalesce(P.clamp(F.when((nudge > 1) & (nudge <= 100), nudge / 100).otherwise(nudge)), F.lit(0.0))).withColumn("has_posture", posed).withColumn("_score", score)
    s = s.withColumns({f"score_{x}": F.col("_score")[x] for x in P.POSTURES}).drop("_score")
    j = history_summary(s, keys, bucket)
    raw = {n: F.coalesce(f"base_{n}", F.lit(0.0)) for n in STATES}
    j = j.withColumns({"base": P.normalize(raw), "base_label": first_of(raw)})
    j = j.withColumn("own", _visible(F.col("base"))).withColumn("prior", F.col("own"))
    place = {n: F.when(_most(F.col(f"{n}_probs")) >= 0.40, first_of(F.col(f"{n}_probs"), P.VISIBLE)).otherwise("none") for n in ("anchor", "tail")}
    room = F.greatest(F.col("tail_probs.room"), _num("tail_share_room"), _num("tail_overlap_max"), _num("tail_nudge_score_max"))
    j = j.withColumns({f"{n}_label": c for n, c in place.items()} | {"departure_detected": (room >= 0.35) & (_num("tail_share_room") >= 0.10), "room_bed_margin_delta": F.col("tail_room_bed_margin") - F.col("anchor_room_bed_margin")})
    weight = P.dynamic_anchor_weight(w.anchor, F.col("anchor_probs"), F.col("tail_probs"), F.col("anchor_frames"), F.col("tail_frames"), F.col("last_visible_gap"), w.recent_gap, (F.col("anchor_label"), F.col("tail_label")))
    return third_steps(third_evidence(j.withColumn("anchor_weight", weight), t), t, windowed=False).select(*keys, "t", "probs")


def hourly_state_table(signals: DataFrame, keys: list[str], grain: int = 3600, bucket: int = 3600, tolerance: float = 0.02) -> DataFrame:
    """The mean of second_states by unit and stretch of ``grain`` seconds (``start``), where the shares add up to 1."""
    p = second_states(signals, keys, bucket)
    shares = {"pct_chair": "chair", "pct_bed": "bed", "pct_ambulatory": "room", "pct_not_located": "no_patient"}
    g = p.groupBy(*keys, (F.floor(F.col("t") / grain) * grain).alias("start")).agg(F.count(F.lit(1)).alias("scored"), *[F.avg(f"probs.{s}").alias(c) for c, s in shares.items()])
    return g.filter(F.abs(sum((F.col(c) for c in shares), F.lit(0.0)) - 1) <= tolerance)


@dataclass(frozen=True)
class Weights:
    """Presets of the second scorer."""

    anchor: float = 0.45
    room_bonus: float = 0.28
    overlap_cap: float = 0.20
    safety: float = 0.50
    recent_gap: float = 60.0
    dropout: float = 180.0
    strong_no_patient: float = 0.75


def score_v2(windows: DataFrame, summary: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Per anchor, the four probabilities, the label, its margin and the reason, from the window's own probabilities (prob_..., label) and its panel (see _second)."""
    p = F.col("probs")
    j = _second(windows.select("anchor_id", "label", *[f"prob_{s}" for s in STATES]), summary, w)
    return j.select("anchor_id", *[p[s].alias(f"prob_{s}") for s in STATES], "second_label", "second_margin", "reason", F.coalesce("departure_detected", F.lit(False)).alias("departure_detected")).withColumnsRenamed({"second_label": "label", "second_margin": "margin"})


def _second(windows: DataFrame, summary: DataFrame, w: Weights) -> DataFrame:
    """The windows with their panel's summary and the second scorer's probs, reason, second_label and second_margin.

    Evidence of the room is its share of the tail, overlap with staff, a rising nudge, and distances; it sets how much the
    window's own prior counts, how much no_patient may keep, and what the room takes from the greatest other state. Without
    any located frame the prior decides alone, if it is sure enough.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    none = P.struct({s: F.lit(0.0) for s in P.VISIBLE})
    prior = {s: F.col(f"prob_{s}") for s in STATES}
    j = windows.withColumn("_own", F.lower(F.trim("label"))).withColumn("legacy", P.normalize(prior)).drop("label", *[f"prob_{s}" for s in STATES]).join(summary, "anchor_id", "left")
    j = j.withColumns({f"{n}_probs": F.coalesce(f"{n}_probs", none) for n in ("anchor", "tail")} | {f"{n}_frames": F.coalesce(f"{n}_frames", F.lit(0).cast("long")) for n in ("anchor", "tail")})
    a, t, legacy = (F.col(c) for c in ("anchor_probs", "tail_probs", "legacy"))
    level = P.clamp((num("tail_nudge_score_max") - w.safety) / max(1e-6, 1 - w.safety))
    rise = F.greatest(zero, num("tail_nudge_score_mean") - num("anchor_nudge_score_mean"))
    mixed = P.struct({s: F.when(F.col("anchor_frames") <= 0, t[s]).when(F.col("tail_frames") <= 0, a[s]).otherwise(w.anchor * a[s] + (1 - w.anchor) * t[s]) for s in P.VISIBLE})
    j = j.withColumns({
        "_lv": P.normalize_visible({s: legacy[s] for s in P.VISIBLE}), "_panel": mixed,
        "_overlap": F.least(one, F.greatest(num("tail_overlap_max"), 2 * num("tail_overlap_mean"))), "_safety": F.least(one, F.greatest(level, rise)),
        "_gap": F.coalesce(P.clamp(F.col("last_visible_gap") / w.dropout), one), "_room": F.greatest(t["room"], num("tail_share_room")),
        "_dist": F.greatest(num("tail_nearest_room"), P.margin_score(F.col("tail_room_bed_margin")), P.margin_score(F.col("room_bed_margin_delta"))),
    })
    j = j.withColumn("_gate", F.greatest(num("tail_share_room"), F.col("_overlap"), F.col("_safety")))
    gate, dist, room = F.col("_gate"), F.col("_dist"), F.col("_room")
    open_ = gate >= 0.15
    sits = (legacy["chair"] >= 0.50) & (num("tail_share_room") < 0.05) & (dist < 0.25)
    own = F.when(open_, 0.35).when((legacy["room"] >= 0.70) & (a["chair"] >= 0.60), 0.30).otherwise(0.15)
    weight = F.when(sits, F.greatest(own, F.lit(0.55))).otherwise(own)
    j = j.withColumns({"_sits": sits, "_weight": weight, "_rest": F.round(1 - weight, 9), "_lock": (t["bed"] >= 0.60) & (num("tail_nearest_bed") >= 0.60) & ~open_ & (dist < 0.55)})
    lv, panel, weight, rest = F.col("_lv"), F.col("_panel"), F.col("_weight"), F.col("_rest")
    near = F.least(one, 0.60 * room + 0.25 * F.col("_overlap") + 0.15 * F.col("_safety"))
    near = F.when(open_, near).otherwise(F.least(near, F.lit(0.34)))
    far = F.when(open_ & ~F.col("_lock"), F.least(one, 0.65 * dist + 0.20 * room + 0.10 * F.col("_overlap") + 0.05 * F.col("_safety"))).otherwise(zero)
    direct = F.greatest(near, far)
    gone = P.clamp(F.greatest(F.least(F.lit(0.85), legacy["no_patient"]), 0.55 * num("tail_share_no_patient") + 0.45 * F.col("_gap")), 0.05, 0.85)
    recent = (F.col("tail_frames") > 0) & (F.greatest(*[t[s] for s in P.VISIBLE]) >= 0.65) & (F.col("last_visible_gap").isNull() | (F.col("last_visible_gap") <= w.recent_gap))
    j = j.withColumns({
        "_visible": P.normalize_visible({s: weight * lv[s] + rest * panel[s] for s in P.VISIBLE}), "_direct": F.when(F.col("_sits"), F.least(direct, F.lit(0.34))).otherwise(direct),
        "_recent": recent, "_gone": F.when(recent, F.least(gone, F.lit(0.25))).otherwise(gone),
    })
    visible = F.col("_visible")
    capped = (F.col("_overlap") >= 0.05) & (F.greatest(*[visible[s] for s in P.VISIBLE]) >= 0.45) & (F.col("_gone") > w.overlap_cap)
    j = j.withColumn("_capped", capped).withColumn("_gone", F.when(F.col("_capped"), w.overlap_cap).otherwise(F.col("_gone")))
    mass = F.greatest(F.lit(0.15), 1 - F.col("_gone"))
    j = j.withColumns({f"_p_{s}": mass * visible[s] for s in P.VISIBLE} | {"_p_no_patient": F.col("_gone")})
    givers = ("chair", "bed", "no_patient")
    top = F.greatest(*[F.col(f"_p_{s}") for s in givers])
    giver = F.when(F.col("_p_chair") == top, "chair").when(F.col("_p_bed") == top, "bed").otherwise("no_patient")
    scale = w.room_bonus * F.col("_direct") * F.when((F.col("_own") == "room") & (F.col("_safety") >= 0.50) & (room >= 0.25), 1.25).otherwise(1.0)
    moves = (F.col("_direct") >= 0.35) & (F.greatest(room, dist) >= 0.15) & ~F.col("_lock")
    j = j.withColumn("_giver", giver).withColumn("_moved", F.when(moves, F.least(scale, top * F.when(giver == "no_patient", 0.40).otherwise(0.35))).otherwise(zero))
    moved = {s: F.col(f"_p_{s}") - F.when(F.col("_giver") == s, F.col("_moved")).otherwise(0.0) for s in givers} | {"room": F.col("_p_room") + F.col("_moved")}
    blind = (F.col("anchor_frames") <= 0) & (F.col("tail_frames") <= 0)
    sure = (F.greatest(*[lv[s] for s in P.VISIBLE]) >= 0.45) & (legacy["no_patient"] < 0.80)
    kept = F.least(F.lit(0.35), F.greatest(F.lit(0.10), legacy["no_patient"]))
    alone = P.normalize({**{s: F.when(sure, (1 - kept) * lv[s]).otherwise(0.0) for s in P.VISIBLE}, "no_patient": F.when(sure, kept).otherwise(1.0)})
    j = j.withColumn("_blind", blind).withColumn("_sure", sure).withColumn("probs", F.when(blind, alone).otherwise(P.normalize(moved)))
    p = F.col("probs")
    reason = (
        F.when(F.col("_blind") & F.col("_sure"), "sparse_panel_sql_fallback").when(F.col("_blind"), "zero_signal_default").when(F.col("_moved") > 0, "room_recovery_v2").when(F.col("_recent"), "recent_visible_fallback")
        .when(F.col("_capped"), "overlap_present_reallocation").when(p["no_patient"] >= w.strong_no_patient, "strong_no_patient").otherwise("direct_focus_argmax")
    )
    j = j.withColumn("reason", reason).withColumn("second_label", first_of(p)).withColumn("second_margin", lead(p))
    return j.drop(*[c for c in j.columns if c.startswith("_") and c not in windows.columns])


def first_of(p: Column, names=STATES) -> Column:
    """The greatest part; ties go to the first name."""
    top = F.greatest(*[p[n] for n in names])
    return F.coalesce(*[F.when(p[n] == top, n) for n in names])


def lead(p: Column) -> Column:
    """By how much the greatest part exceeds the next."""
    ordered = F.sort_array(F.array(*[p[s] for s in STATES]), asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


@dataclass(frozen=True)
class Third:
    """Presets of the third scorer (fixed values)."""

    visible_cap: float = 0.35
    transient_cap: float = 0.50
    sparse_cap: float = 0.45
    away_floor: float = 0.55
    presence: float = 0.35
    departure: float = 0.35
    in_bed: float = 0.55
    in_bed_unseen: float = 0.95
    motion_scale: float = 0.15
    object_scale: float = 0.50
    corroboration: float = 0.60
    posture_frames: int = 6
    posture_switches: int = 2
    lying: float = 0.60
    chair_bed_gap: float = 0.20
    race: float = 0.10
    approach: float = 0.05


#: Columns of a window beside its probabilities that the third scorer reads; those that are absent count as null.
EVIDENCE = ("visible_prob", "not_visible_prob", "out_of_room_prob", "out_of_room_share", "visibility_ratio", "prob_not_visible", "prob_out_of_room", "signal_count", "own_posture_frames")


def _visible(p: Column) -> Column:
    return P.normalize_visible({s: p[s] for s in P.VISIBLE})


def _most(p: Column) -> Column:
    return F.greatest(*[p[s] for s in P.VISIBLE])


def _num(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def posture_label(name: str, least: float = 0.45) -> Column:
    """A window's posture by scores, or by label shares (_..._shares) where it has no scores; none under ``least``."""
    score = F.col(f"{name}_posture")
    share = F.col(f"_{name}_shares")
    total = sum((F.coalesce(score[x], F.lit(0.0)) for x in P.POSTURES), F.lit(0.0))
    best = lambda p: F.when(F.greatest(*[p[x] for x in P.POSTURES]) >= least, first_of(p, P.POSTURES)).otherwise("none")
    return F.coalesce(F.when(total > 0, best(score)).otherwise(best(share)), F.lit("none"))


def third_evidence(j: DataFrame, t: Third) -> DataFrame:
    """Supports, regime and corroboration of rows with a panel's summary, ``own`` and ``prior`` (visible structs), ``anchor_weight`` and EVIDENCE."""
    f = {c: F.col(c) for c in j.columns}
    j = j.withColumns({"support": P.struct(P.presence_support(f, t.motion_scale, t.object_scale, t.posture_frames)), "departure_confidence": P.departure_confidence(f)})
    support = F.col("support")
    j = j.withColumns({
        "visible_support": F.greatest(_most(F.col("own")), _most(F.col("prior")), _num("visible_prob"), _num("visibility_ratio"), F.least(F.lit(1.0), _num("signal_count") / 20)),
        "transient_support": F.greatest(_num("not_visible_prob"), 1 - _num("visibility_ratio"), _num("prob_not_visible")),
        "out_of_room_support": F.greatest(_num("out_of_room_prob"), _num("out_of_room_share"), _num("prob_out_of_room")),
        "_seen_twice": F.greatest(P.scaled_support(F.col("tail_frames"), 2.0), P.scaled_support(F.col("signal_count"), 2.0), P.scaled_support(F.col("tail_n_patient_mean")), 0.75 * support["motion"]),
        "_located": (F.col("anchor_frames") > 0) | (F.col("tail_frames") > 0),
    } | {f"_{n}_shares": P.normalize_posture({x: F.col(f"{n}_posture_share_{x}") for x in P.POSTURES}) for n in ("anchor", "tail")})
    unseen = F.greatest(support["patient_candidate"], support["posture"], 0.75 * support["motion"], 0.75 * support["chair_candidate"])
    room_share, room_near = _num("tail_share_room"), _num("tail_nearest_room")
    w, shares = F.col("anchor_weight"), {n: F.col(f"_{n}_shares") for n in ("anchor", "tail")}
    mixed = {x: 0.75 * (w * F.col(f"anchor_posture.{x}") + (1 - w) * F.col(f"tail_posture.{x}")) + 0.25 * (w * shares["anchor"][x] + (1 - w) * shares["tail"][x]) for x in P.POSTURES}
    return j.withColumns({
        "signal_regime": P.signal_regime(F.col("visible_support"), F.col("transient_support"), F.col("out_of_room_support"), support["presence"], t.presence),
        "_sure": F.greatest(F.col("_seen_twice"), support["posture"]) >= t.corroboration, "_room_sure": F.col("_seen_twice") >= t.corroboration,
        "_bed_allowed": F.col("_located") | ((support["bed_in_bed"] >= t.in_bed_unseen) & (unseen >= t.corroboration) & (support["bed_candidate"] >= t.presence)),
        "_lock": ((_num("tail_nearest_bed") >= 0.75) & (room_share < 0.10) & (room_near < 0.15)) | ((support["bed_in_bed"] >= t.in_bed) & (room_share < 0.20) & (room_near < 0.25)),
        "_approach": _num("velocity_room") <= -t.approach, "_strong": (F.col("visible_support") >= 0.80) & (_most(F.col("prior")) >= 0.60),
        "panel_visible": P.normalize_visible({s: w * F.col(f"anchor_probs.{s}") + (1 - w) * F.col(f"tail_probs.{s}") for s in P.VISIBLE}),
        "posture_probs": P.normalize_posture(mixed), "anchor_posture_label": posture_label("anchor"), "tail_posture_label": posture_label("tail"),
        "_all_posture_frames": F.greatest(_num("posture_frames"), _num("own_posture_frames")), "_switches": _num("posture_switches"),
    })


def third_steps(j: DataFrame, t: Third, windowed: bool) -> DataFrame:
    """Rows of third_evidence with ``base`` (a struct of the four states) and ``base_label`` corrected step by step into ``probs``.

    no_patient is held to its regime's cap or floor; then the room takes what departures and presence support, the bed
    what a bed score supports, a close race goes to the state approached fastest, and a lying posture moves mass from chair
    to bed. Windowed: the second scorer's room stands, steps must gain over 0.02, the race comes before the bed and
    counts if it changes the leader. Otherwise (the hourly table) each step that applies counts, and the race comes last.
    """
    base, prior, support, regime = F.col("base"), F.col("prior"), F.col("support"), F.col("signal_regime")
    j = j.withColumn("_base_seen", _visible(base))
    mixed = P.blend((0.70, F.col("_base_seen")), (0.20, F.col("panel_visible")), (0.10, prior))
    j = j.withColumn("_room_base", F.col("base_label") == "room").withColumn("_mixed", mixed)
    mass = F.greatest(F.lit(0.0), 1 - base["no_patient"])
    first = P.normalize({**{s: mass * F.col("_mixed")[s] for s in P.VISIBLE}, "no_patient": base["no_patient"]})
    j = j.withColumn("probs", F.when(F.col("_room_base"), base).otherwise(first) if windowed else first)
    j = j.withColumn("seen", F.when(F.col("_room_base"), _visible(F.col("probs"))).otherwise(F.col("_mixed")) if windowed else F.col("_mixed"))
    now = F.col("probs.no_patient")
    target = (
        F.when((regime == "visible") & F.col("_sure"), F.least(now, F.when(F.col("_strong"), t.visible_cap).otherwise(t.transient_cap)))
        .when((regime == "temporarily_not_visible") & (_most(prior) >= 0.45) & F.col("_sure"), F.least(now, F.lit(t.transient_cap)))
        .when((regime == "present_but_sparse") & F.col("_sure"), F.least(now, F.lit(t.sparse_cap)))
        .when(regime == "out_of_room", F.greatest(now, F.lit(t.away_floor))).otherwise(now)
    )
    j = j.withColumn("_target", target).withColumn("_moved", F.abs(F.col("_target") - now) > 0.02)
    if not windowed:
        j = j.withColumn("_moved", F.col("_moved") & ~F.col("_room_base")).withColumn("probs", F.when(F.col("_room_base"), base).otherwise(F.col("probs")))
    freed_to = P.blend((0.60, F.col("seen")), (0.40, prior)) if windowed else prior
    j = _tried(j, P.set_no_patient, F.col("probs"), F.col("_target"), freed_to)
    j = _step(j, "_moved", F.col("_try"))
    j = j.withColumn("_carried", F.col("_moved") & (F.col("_target") < base["no_patient"]) & (F.col("_strong") | (regime == "present_but_sparse")))
    hidden = (regime == "present_but_sparse") & (support["room"] >= t.presence) & F.col("_room_sure")
    near = (_num("tail_nearest_room") >= 0.35) | F.col("_approach")
    evidence = near | hidden | (F.coalesce("departure_detected", F.lit(False)) & (near | (_num("tail_share_room") >= 0.35)))
    takes = ~F.col("_lock") & (((F.col("departure_confidence") >= t.departure) & evidence & F.col("_room_sure")) | hidden)
    goal = F.least(F.lit(0.70), F.greatest(F.col("probs.room"), 0.18 + 0.60 * F.greatest(F.col("departure_confidence"), support["room"])))
    j = _tried(j, P.shift_to, F.col("probs"), F.lit("room"), goal)
    j = _step(j.withColumn("_room_used", (takes & ~F.col("_room_base") & (F.col("_try.room") > F.col("probs.room") + 0.02)) if windowed else takes), "_room_used", F.col("_try"))
    for step in (("race", "bed") if windowed else ("bed", "race")):
        if step == "race":
            speed, room_support = {s: F.col(f"velocity_{s}") for s in P.VISIBLE}, F.greatest(_num("tail_share_room"), _num("tail_nearest_room"))
            j = _tried(j, P.velocity_tiebreak, F.col("probs"), speed, room_support, t.race, t.approach, P.VISIBLE if windowed else P.VISIBLE[::-1])
            j = j.withColumns({"_try_seen": _visible(F.col("_try")), "_probs_seen": _visible(F.col("probs"))}) if windowed else j
            changed = P.dominant(F.col("_try_seen")) != P.dominant(F.col("_probs_seen"))
            j = _step(j.withColumn("_race_used", changed if windowed else F.lit(True)), "_race_used", F.col("_try"))
        else:
            likely = (support["bed_in_bed"] >= t.in_bed) & (support["bed"] >= F.greatest(support["room"], support["chair"])) & (F.col("probs.room") < 0.30) & F.col("_bed_allowed") & ~F.col("_room_used")
            goal = F.least(F.lit(0.80), F.greatest(F.col("probs.bed"), 0.20 + 0.60 * support["bed_in_bed"]))
            j = _tried(j, P.shift_to, F.col("probs"), F.lit("bed"), goal)
            gained = F.col("_try.bed") > F.col("probs.bed") + 0.02
            j = _step(j.withColumn("_bed_used", (likely & ~F.col("_room_base") & gained) if windowed else likely), "_bed_used", F.col("_try"))
    lying = F.col("posture_probs")["lying"]
    leader = P.argmax(F.col("probs")) if windowed else first_of(F.col("probs"))
    disagree = (F.col("anchor_posture_label") != "none") & (F.col("tail_posture_label") != "none") & (F.col("anchor_posture_label") != F.col("tail_posture_label"))
    gate = (
        F.when(~leader.isin("chair", "bed"), "winner_not_furniture").when(F.greatest(F.col("probs.room"), F.col("probs.no_patient")) >= 0.35, "room_or_no_patient_evidence")
        .when(F.col("departure_confidence") >= t.departure, "departure_evidence").when(F.col("_all_posture_frames") < t.posture_frames, "insufficient_posture_frames")
        .when(F.col("_switches") > t.posture_switches, "unstable_posture").when(disagree, "anchor_tail_posture_disagree").when(lying < t.lying, "lying_not_dominant")
        .when(F.abs(F.col("probs.chair") - F.col("probs.bed")) > t.chair_bed_gap, "chair_bed_gap_too_wide").otherwise("applied")
    )
    ahead = F.greatest(F.lit(0.0), lying - F.greatest(F.col("posture_probs.sitting"), F.col("posture_probs.standing")))
    weight = P.clamp(ahead / 0.25) * F.least(F.lit(1.0), F.col("_all_posture_frames") / t.posture_frames)
    j = j.withColumn("posture_gate", gate).withColumn("posture_blend", F.when(F.col("posture_gate") == "applied", weight).otherwise(0.0))
    k = F.col("posture_blend")
    j = _tried(j, P.posture_adjust, F.col("seen"), F.col("posture_probs"), out="_leaning")
    seen = P.normalize_visible({s: (1 - k) * F.col("seen")[s] + k * F.col("_leaning")[s] for s in P.VISIBLE})
    mass = F.greatest(F.lit(0.0), 1 - F.col("probs.no_patient"))
    j = j.withColumn("_blended", seen)
    j = j.withColumn("_try", P.normalize({**{s: mass * F.col("_blended")[s] for s in P.VISIBLE}, "no_patient": F.col("probs.no_patient")}))
    applies = (k > 0) & (F.col("_try.bed") > F.col("probs.bed") + 0.02) if windowed else k > 0
    return _step(j.withColumn("_posture_used", applies), "_posture_used", F.col("_try"))


def _tried(j: DataFrame, move, *args, out: str = "_try") -> DataFrame:
    """j with what a step would make of its probabilities. The step's values are columns, not lambdas, so that they are compiled."""
    bound = P.Bound(j)
    made = move(*args, let=bound.let)
    return bound.df.withColumn(out, made).drop(*[c for c in bound.df.columns if c not in j.columns])


def _step(j: DataFrame, used: str, moved: Column) -> DataFrame:
    """probs moved where a step is used, and ``seen`` to its visible part."""
    j = j.withColumn("probs", F.when(F.col(used), moved).otherwise(F.col("probs")))
    return j.withColumn("seen", F.when(F.col(used), _visible(F.col("probs"))).otherwise(F.col("seen")))


def score_v3(windows: DataFrame, summary: DataFrame, w: Weights = Weights(), t: Third = Third()) -> DataFrame:
    """Per anchor, the third scorer's probabilities, label, margin and reasons, beside those of the second.

    windows holds label, prob_... of the four states, and where known focus_... and cond_... of the visible ones and EVIDENCE.
    """
    extra = {c: F.lit(None).cast("double") for c in (*EVIDENCE, *[f"{k}_{s}" for k in ("focus", "cond") for s in P.VISIBLE]) if c not in windows.columns}
    j = _second(windows.withColumns(extra), summary, w)
    none = {n: P.struct({x: F.lit(0.0) for x in P.POSTURES}) for n in ("anchor", "tail")}
    j = j.withColumns({f"{n}_posture": F.coalesce(f"{n}_posture", c) for n, c in none.items()}).withColumn("own", _visible(F.col("legacy")))
    j = j.withColumns({f"_{k}": P.normalize_visible({s: F.col(f"{k}_{s}") for s in P.VISIBLE}) for k in ("focus", "cond")})
    weight = P.dynamic_anchor_weight(w.anchor, F.col("anchor_probs"), F.col("tail_probs"), F.col("anchor_frames"), F.col("tail_frames"), F.col("last_visible_gap"), w.recent_gap)
    j = j.withColumns({"prior": P.blend((0.45, F.col("own")), (0.35, F.col("_focus")), (0.20, F.col("_cond"))), "anchor_weight": weight, "base": F.col("probs"), "base_label": F.col("second_label")})
    j = third_steps(third_evidence(j, t), t, windowed=True)
    carry = F.col("_carried") & ((F.col("signal_regime") == "present_but_sparse") | (F.col("_strong") & ~F.col("_located")))
    carried = F.when(F.col("_carried"), "sparse_signal_carry_forward_v3")
    room = F.when(F.col("_room_used"), "room_departure_recovery_v3")
    race = F.when(F.col("_race_used") & ~F.col("_room_used") & ~carry, "velocity_tiebreak_v3")
    bed = F.when(F.col("_bed_used"), "bed_in_bed_recovery_v3")
    recovery = F.coalesce(bed, race, room, carried)
    used = F.coalesce(F.when(F.col("_posture_used"), "posture_state_collapse_v3"), room, bed, F.when(F.col("_race_used"), "velocity_tiebreak_v3"), recovery, F.col("reason"))
    p, b, support = F.col("probs"), F.col("base"), F.col("support")
    return j.select(
        "anchor_id", *[p[s].alias(f"prob_{s}") for s in STATES], first_of(p).alias("label"), lead(p).alias("margin"), used.alias("reason"), F.coalesce(recovery, F.col("reason")).alias("base_recovery_reason"),
        "signal_regime", "departure_confidence", support["presence"].alias("presence_support"), support["room"].alias("room_presence_support"), support["bed_in_bed"].alias("bed_in_bed_support"),
        carry.alias("carry_forward_used"), F.col("_posture_used").alias("posture_applied"), F.when(F.col("posture_gate") == "applied", "lying_bed_bias").otherwise("none").alias("posture_mode"), "posture_gate",
        *[b[s].alias(f"v2_prob_{s}") for s in STATES], F.col("second_label").alias("v2_label"), F.col("second_margin").alias("v2_margin"), F.col("reason").alias("v2_reason"),
        F.coalesce("anchor_label", F.lit("no_patient")).alias("anchor_label"), F.coalesce("tail_label", F.lit("no_patient")).alias("tail_label"),
        F.coalesce("departure_detected", F.lit(False)).alias("departure_detected"), "last_visible_gap", "anchor_weight", _profile().alias("signal_profile"),
    )


def _profile() -> Column:
    """What the third scorer saw, as one line of name=value."""
    support = F.col("support")
    posture = first_of(F.col("posture_probs"), P.POSTURES)
    values = {
        "anchor": F.coalesce("anchor_label", F.lit("<NA>")), "tail": F.coalesce("tail_label", F.lit("<NA>")), "gap": F.coalesce(F.round("last_visible_gap", 1).cast("string"), F.lit("")),
        "anchor_weight": F.col("anchor_weight"), "room_tail": _num("tail_share_room"), "room_nearest": _num("tail_nearest_room"), "room_margin_delta": _num("room_bed_margin_delta"), "overlap": _num("tail_overlap_max"),
        "nudge": _num("tail_nudge_score_max"), "signal_regime": F.col("signal_regime"), "visible_support": F.col("visible_support"), "transient_support": F.col("transient_support"),
        "out_of_room_support": F.col("out_of_room_support"), "presence_support": support["presence"], "room_presence_support": support["room"], "bed_in_bed": support["bed_in_bed"],
        "departure_conf": F.col("departure_confidence"), "posture": posture, "posture_blend": F.col("posture_blend"), "posture_gate": F.col("posture_gate"), "posture_switch": F.round("_switches", 1).cast("string"),
    }
    text = {"anchor", "tail", "gap", "signal_regime", "posture", "posture_gate", "posture_switch"}
    return F.concat_ws(";", *[F.concat(F.lit(f"{n}="), c if n in text else F.round(c, 3).cast("string")) for n, c in values.items()])


def evaluation_summary(panel: DataFrame, focus_s: int = 30, half_life: float = 45.0) -> DataFrame:
    """Per anchor, the decayed location distribution of the last ``focus_s`` seconds and of the whole look-back (drop), in one aggregation.

    Distances (0.7) and label shares (0.3) are mixed where there are both; shares are of all located frames.
    """
    located = F.col("has_location") & F.col("offset").between(ANCHOR[0], TAIL[1])
    recency = _recency(panel, half_life)
    windows = {"focus": located & (F.col("offset") >= -focus_s), "drop": located}
    aggs = [F.max(F.when(located, F.col("offset"))).alias("_last")]
    for n, on in windows.items():
        aggs.append(F.count_if(on).alias(f"{n}_frames"))
        for s in P.VISIBLE:
            d = F.col(f"d_{s}")
            aggs.append(F.coalesce(F.sum(F.when(on & d.isNotNull(), recency / F.greatest(d, F.lit(1e-6)))), F.lit(0.0)).alias(f"_{n}_w_{s}"))
            aggs.append(F.count_if(on & (F.col("state") == s)).alias(f"_{n}_n_{s}"))
    g = panel.groupBy("anchor_id").agg(*aggs)
    for n in windows:
        weights = sum((F.col(f"_{n}_w_{s}") for s in P.VISIBLE), F.lit(0.0))
        seen = sum((F.col(f"_{n}_n_{s}") for s in P.VISIBLE), F.lit(0))
        near = lambda s, n=n, weights=weights: F.coalesce(F.try_divide(F.col(f"_{n}_w_{s}"), weights), F.lit(0.0))
        share = lambda s, n=n: F.coalesce(F.try_divide(f"_{n}_n_{s}", f"{n}_frames"), F.lit(0.0))
        part = {s: F.when((weights > 0) & (seen > 0), 0.7 * near(s) + 0.3 * share(s)).when(weights > 0, near(s)).otherwise(share(s)) for s in P.VISIBLE}
        g = g.withColumn(f"{n}_probs", P.normalize_visible(part))
    room = sum((F.col(f"_{n}_n_room") for n in windows), F.lit(0)) + F.when(F.col("focus_probs.room") + F.col("drop_probs.room") > 0, 1).otherwise(0)
    g = g.withColumn("room_support", room > 0).withColumn("panel_gap", (-F.col("_last")).cast("double"))
    return g.drop(*[c for c in g.columns if c.startswith("_")])


@dataclass(frozen=True)
class Evaluation:
    """Presets of the evaluation scorer (fixed values)."""

    recent_gap: float = 60.0
    least_strength: float = 0.55
    strong_no_patient: float = 0.75
    floor_min: float = 0.10
    floor_max: float = 0.25


def score_evaluation(windows: DataFrame, summary: DataFrame, e: Evaluation = Evaluation()) -> DataFrame:
    """Per anchor, the window's own probabilities with what its panel says of visible states, the label, its margin and the reason.

    The focus window decides where it has located frames; else the whole look-back, where the window's own focus has none
    or nobody is seen for sure; else the window stands. A room that is supported but has nothing takes a floor from the
    greatest other state. windows holds prob_..., focus_visible_frames, visible_prob, last_visible_gap_seconds and, where
    known, drop_visible_frames.
    """
    if "drop_visible_frames" not in windows.columns:
        windows = windows.withColumn("drop_visible_frames", F.lit(0))
    own = ("focus_visible_frames", "drop_visible_frames", "visible_prob", "last_visible_gap_seconds")
    j = windows.select("anchor_id", *own, P.normalize({s: F.col(f"prob_{s}") for s in STATES}).alias("legacy")).join(summary, "anchor_id", "left")
    none = P.struct({s: F.lit(0.0) for s in P.VISIBLE})
    j = j.withColumns({f"{n}_probs": F.coalesce(f"{n}_probs", none) for n in ("focus", "drop")} | {"gap": F.coalesce(F.col("panel_gap"), F.col("last_visible_gap_seconds").cast("double"))})
    gone, focus, drop = F.col("legacy.no_patient"), F.col("focus_probs"), F.col("drop_probs")
    recent = F.col("gap").isNull() | (F.col("gap") <= e.recent_gap)
    legacy_focus = _num("focus_visible_frames")
    dropped = F.greatest(_num("drop_visible_frames"), _num("drop_frames"))

    def held(p):
        """no_patient for a visible distribution: the surer that is, the less."""
        top = _most(p)
        strength = F.greatest(F.lit(e.least_strength), _num("visible_prob"), F.least(F.lit(0.90), 0.20 + 0.75 * top))
        strength = F.when((top >= 0.70) & recent, F.greatest(strength, F.lit(0.75))).otherwise(strength)
        strength = F.when(recent, strength).otherwise(F.least(strength, F.lit(0.50)))
        return F.least(gone, F.greatest(F.lit(0.0), 1 - P.clamp(strength, 0.35, 0.90)))

    by_focus, by_drop = (_num("focus_frames") > 0) & (_most(focus) > 0), (legacy_focus <= 0) & (dropped > 0) & (_most(drop) > 0)
    sparse = (gone >= e.strong_no_patient) & (dropped > 0) & (_most(drop) > 0) & recent
    alone = 1 - P.clamp(F.greatest(F.lit(e.least_strength), 1 - F.least(gone, F.lit(0.45))), 0.35, 0.85)
    blind = (dropped <= 0) & (F.greatest(legacy_focus, _num("focus_frames")) <= 0)
    case = F.when(blind, "blind").when(by_focus, "focus").when(by_drop, "drop").when(sparse & (alone < gone), "sparse").otherwise("own")
    j = j.withColumns({"_case": case, "_focus_gone": held(focus), "_drop_gone": held(drop), "_recent": recent, "_alone": alone})
    sure = lambda p: (_most(p) >= 0.70) & F.col("_recent")
    fallback = (F.col("_case") == "focus") & (legacy_focus <= 0) & sure(focus)
    quarter = lambda c: F.least(c, F.lit(0.25))
    left = (
        F.when(F.col("_case") == "blind", 1.0).when(F.col("_case") == "focus", F.when(fallback, quarter(F.col("_focus_gone"))).otherwise(F.col("_focus_gone")))
        .when(F.col("_case") == "drop", F.when(sure(drop), quarter(F.col("_drop_gone"))).otherwise(F.col("_drop_gone"))).when(F.col("_case") == "sparse", F.col("_alone")).otherwise(gone)
    )
    j = j.withColumns({"_left": left, "_fallback": fallback | F.col("_case").isin("drop", "sparse")})
    visible = {s: F.when(F.col("_case") == "focus", focus[s]).otherwise(drop[s]) for s in P.VISIBLE}
    j = j.withColumns({f"_p_{s}": F.when(F.col("_case") == "blind", 0.0).when(F.col("_case") == "own", F.col("legacy")[s]).otherwise((1 - F.col("_left")) * c) for s, c in visible.items()} | {"_p_no_patient": F.col("_left")})
    givers = ("chair", "bed", "no_patient")
    top = F.greatest(*[F.col(f"_p_{s}") for s in givers])
    giver = F.coalesce(*[F.when(F.col(f"_p_{s}") == top, s) for s in givers])
    floor = F.least(F.lit(e.floor_max), F.greatest(F.lit(e.floor_min), drop["room"]))
    wants = (F.col("_p_room") <= 0) & F.coalesce("room_support", F.lit(False)) & (drop["room"] > 0)
    j = j.withColumn("_giver", giver).withColumn("_moved", F.when(wants, F.least(floor, top * F.when(F.col("_giver") == "no_patient", 0.35).otherwise(0.50))).otherwise(0.0))
    j = j.withColumn("probs", P.normalize({s: F.col(f"_p_{s}") - F.when(F.col("_giver") == s, F.col("_moved")).otherwise(0.0) for s in givers} | {"room": F.col("_p_room") + F.col("_moved")}))
    reason = F.when(F.col("_case") == "blind", "zero_signal_default").when(F.col("_fallback"), "recent_visible_fallback").when(F.col("_moved") > 0, "room_recovery_v2").when(F.col("probs.no_patient") >= e.strong_no_patient, "strong_no_patient").otherwise("direct_focus_argmax")
    p = F.col("probs")
    return j.select("anchor_id", *[p[s].alias(f"prob_{s}") for s in STATES], first_of(p).alias("label"), lead(p).alias("margin"), reason.alias("reason"))
