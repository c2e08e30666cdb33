"""Columns on probability structs: {chair, bed, room, no_patient} and the visible three. Static classes, so structs, not maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import STATES

VISIBLE = STATES[:3]
POSTURES = ("sitting", "standing", "lying")


def _pos(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def _sum(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def let(values: list[Column], body) -> Column:
    """body(*values) with every value evaluated once, so that nested expressions don't double at each use.

    A lambda keeps them, which Spark interprets; where many rows are scored, Bound keeps them in columns instead.
    """
    one = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(values)])
    return F.element_at(F.transform(F.array(one), lambda v: body(*[v[f"_{i}"] for i in range(len(values))])), 1)


class Bound:
    """A let for the rows of ``df``: every value becomes a column of df, which compiled code reads. Expressions made with it belong to df as it is then."""

    def __init__(self, df: DataFrame):
        self.df = df

    def let(self, values: list[Column], body) -> Column:
        names = [f"_let{len(self.df.columns)}_{i}" for i in range(len(values))]
        self.df = self.df.withColumns(dict(zip(names, values, strict=True)))
        return body(*[F.col(n) for n in names])


def struct(values: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in values.items()])


def parts(p: Column, names=STATES) -> dict[str, Column]:
    return {n: p[n] for n in names}


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def scaled_support(c: Column, scale: float = 1.0) -> Column:
    """C over a scale, on 0..1; 0 for null or no scale."""
    return clamp(F.coalesce(c.cast("double"), F.lit(0.0)) / scale) if scale > 0 else F.lit(0.0)


def margin_score(c: Column) -> Column:
    """M / (m + 0.05) of a positive margin."""
    m = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(m > 0, F.least(F.lit(1.0), m / (m + 0.05))).otherwise(0.0)


def normalize(values: dict[str, Column], names=STATES) -> Column:
    """Nonnegative parts that add up to 1; nothing at all is no_patient, or zeros without that class.

    Each value is written out once a name and twice more, so one that is itself normalized should be a column or kept by let.
    """
    pos = {n: _pos(values[n]) for n in names}
    total = _sum(list(pos.values()))
    return F.when(total > 0, struct({n: c / total for n, c in pos.items()})).otherwise(struct({n: F.lit(1.0 if n == "no_patient" else 0.0) for n in names}))


def normalize_visible(values: dict[str, Column]) -> Column:
    return normalize(values, VISIBLE)


def normalize_posture(values: dict[str, Column]) -> Column:
    return normalize(values, POSTURES)


def argmax(p: Column, names=STATES) -> Column:
    """The greatest part; ties go to the last name in the alphabet."""
    top = F.greatest(*[p[n] for n in names])
    out = F.lit(None).cast("string")
    for n in sorted(names):
        out = F.when(p[n] == top, n).otherwise(out)
    return out


def dominant(p: Column, names=VISIBLE, least: float = 0.0) -> Column:
    """A101: argmax, or none where all parts are zero or the greatest is under ``least``."""
    top = F.greatest(*[p[n] for n in names])
    return F.when((top <= 0) | (top < least), "none").otherwise(argmax(p, names))


def blend(*sources: tuple[float, Column]) -> Column:
    """Weighted mean of visible structs that skips the empty ones."""
    used = [(w, p, F.when(_sum([p[n] for n in VISIBLE]) > 0, float(w)).otherwise(0.0)) for w, p in sources if w > 0]
    return normalize_visible({n: _sum([w * p[n] for _, p, w in used]) for n in VISIBLE})


def posture_adjust(visible: Column, posture: Column, let=let) -> Column:
    """Lying that beats the other postures moves mass from chair to bed; the room's stays."""
    return let([visible, posture], _posture_adjust)


def _posture_adjust(visible: Column, posture: Column) -> Column:
    chair, bed, room = (visible[n] for n in VISIBLE)
    both = chair + bed
    bias = F.greatest(F.lit(0.0), posture["lying"] - F.greatest(posture["sitting"], posture["standing"]))
    signal = bed + bias * both
    share = chair / F.greatest(F.lit(1e-6), chair + signal)
    moved = normalize_visible({"chair": both * share, "bed": both * signal / F.greatest(F.lit(1e-6), chair + signal), "room": room})
    return F.when((both > 0) & (bias > 0), moved).otherwise(normalize_visible(parts(visible, VISIBLE)))


def set_no_patient(p: Column, target: Column, prior: Column, let=let) -> Column:
    """A102, B55: no_patient at the target (at most 0.95). Freed mass goes by 0.6 own and 0.4 prior shares; needed mass comes by share."""
    mixed = lambda p, target, prior, own: let([p, target, blend((0.60, own), (0.40, prior))], _set_no_patient)
    return let([p, target, prior], lambda p, target, prior: let([p, target, prior, normalize_visible(parts(p, VISIBLE))], mixed))


def _set_no_patient(p: Column, target: Column, mixed: Column) -> Column:
    want = clamp(target, 0.0, 0.95)
    now = p["no_patient"]
    less = normalize({**{n: p[n] + (now - want) * mixed[n] for n in VISIBLE}, "no_patient": want})
    donors = _sum([p[n] for n in VISIBLE])
    share = lambda n: F.when(donors > 0, p[n] / donors).otherwise(0.0)
    more = normalize({**{n: F.greatest(F.lit(0.0), p[n] - (want - now) * share(n)) for n in VISIBLE}, "no_patient": want})
    return F.when(F.abs(want - now) <= 1e-6, p).when(want < now, less).otherwise(more)


def shift_to(p: Column, label: Column, target: Column, let=let) -> Column:
    """A102, A69, B55: raise label's part to the target (at most 0.95) from the other classes, the greatest first.

    A donor gives at most 0.55 of its mass if it is no_patient and 0.45 otherwise, after what the greater ones can; ties
    give in the order of STATES.
    """
    return let([p, label, clamp(target, 0.0, 0.95)], lambda p, label, want: let([p, label, want, *_given(p, label, want)], _shift_to))


def _own(p: Column, label: Column) -> Column:
    return _sum([F.when(label == n, p[n]).otherwise(0.0) for n in STATES])


def _given(p: Column, label: Column, want: Column) -> list[Column]:
    """What every class gives."""
    cap = {n: F.when(label == n, 0.0).otherwise(p[n] * (0.55 if n == "no_patient" else 0.45)) for n in STATES}
    earlier = lambda m, n: p[m] >= p[n] if STATES.index(m) < STATES.index(n) else p[m] > p[n]
    rest = {n: want - _own(p, label) - _sum([F.when(earlier(m, n), cap[m]).otherwise(0.0) for m in STATES if m != n]) for n in STATES}
    return [F.when((label != n) & (rest[n] > 1e-6), F.least(rest[n], cap[n])).otherwise(0.0) for n in STATES]


def _shift_to(p: Column, label: Column, want: Column, *given: Column) -> Column:
    moved = normalize({n: F.when(label == n, p[n] + _sum(list(given))).otherwise(p[n] - g) for n, g in zip(STATES, given, strict=True)})
    return F.when(_own(p, label) >= want, p).otherwise(moved)


def dynamic_anchor_weight(base: float, anchor: Column, tail: Column, anchor_frames: Column, tail_frames: Column, gap: Column, recent_gap_s: float, labels: tuple[Column, Column] | None = None) -> Column:
    """How much the anchor window counts beside the tail, within 0.2..0.8; 1 without a tail and 0 without an anchor."""
    conf = lambda p, n: F.greatest(*[p[x] for x in VISIBLE]) * F.least(F.lit(1.0), n / 4.0)
    a, t = conf(anchor, anchor_frames), conf(tail, tail_frames)
    w = F.when(t > a + 0.15, round(base - 0.15, 9)).when(a > t + 0.15, round(base + 0.15, 9)).otherwise(float(base))
    w = w + F.coalesce(0.15 * clamp(gap / max(1.0, recent_gap_s)), F.lit(0.0))
    la, lt = labels or (dominant(anchor, least=0.40), dominant(tail, least=0.40))
    w = w + F.when((la != "none") & (lt != "none") & (la != lt), F.when(tail_frames < 3, 0.10).otherwise(-0.05)).otherwise(0.0)
    return F.when(tail_frames <= 0, 1.0).when(anchor_frames <= 0, 0.0).otherwise(clamp(w, 0.20, 0.80))


def signal_regime(visible: Column, transient: Column, away: Column, presence: Column, min_presence: float = 0.35) -> Column:
    """Visible, out_of_room, present_but_sparse, temporarily_not_visible or unknown, by the strongest support."""
    out = F.when((visible >= F.greatest(transient, away)) & (visible >= 0.35), "visible")
    out = out.when((away >= F.greatest(visible, transient)) & (away >= 0.45), "out_of_room")
    hidden = (transient >= F.greatest(visible, away)) & (transient >= 0.35)
    return out.when(hidden & (presence >= min_presence), "present_but_sparse").when(hidden, "temporarily_not_visible").otherwise("unknown")


def departure_confidence(f: dict[str, Column]) -> Column:
    """How surely the room was reached from a chair or bed, from a window's features (see scorer.panel_summary)."""
    part = lambda c, scale: F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0)) / scale)
    left = f["anchor_label"].isin("chair", "bed") & (f["tail_label"] == "room")
    moved = F.when(F.coalesce(f["departure_detected"], F.lit(False)), 0.30).otherwise(0.0) + F.when(F.coalesce(left, F.lit(False)), 0.10).otherwise(0.0)
    shares = moved + 0.25 * part(f["tail_share_room"], 0.25) + 0.20 * part(f["tail_nearest_room"], 0.35) + 0.10 * margin_score(f["room_bed_margin_delta"])
    return clamp(shares + 0.03 * part(f["tail_overlap_max"], 0.25) + 0.02 * part(f["tail_nudge_score_max"], 0.70))


def presence_support(f: dict[str, Column], motion_scale: float = 0.15, object_scale: float = 0.50, posture_frames: float = 6.0) -> dict[str, Column]:
    """Support for anyone being there, and for each place, from a window's features; each on 0..1."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    motion = scaled_support(F.greatest(zero(f["tail_motion_max"]), zero(f["tail_motion_mean"])), motion_scale)
    patient = F.greatest(scaled_support(f["anchor_n_patient_mean"]), scaled_support(f["tail_n_patient_mean"]))
    other, bed, chair = scaled_support(f["tail_n_other_mean"], object_scale), scaled_support(f["tail_n_bed_mean"]), scaled_support(f["tail_n_chair_mean"])
    posture = scaled_support(f["tail_posture_frames"], posture_frames)
    in_bed = F.greatest(zero(f["tail_in_bed_score_max"]), zero(f["tail_in_bed_score_mean"]))
    out = {
        "presence": F.greatest(patient, posture, 0.75 * in_bed, 0.60 * motion, 0.50 * F.greatest(other, bed, chair)),
        "room": F.greatest(zero(f["tail_share_room"]), zero(f["tail_nearest_room"]), 0.60 * other, 0.40 * motion),
        "bed": F.greatest(zero(f["tail_probs"]["bed"]), zero(f["tail_nearest_bed"]), 0.65 * in_bed, 0.50 * bed),
        "chair": F.greatest(zero(f["tail_probs"]["chair"]), 0.50 * chair, 0.35 * patient),
        "bed_in_bed": in_bed, "motion": motion, "patient_candidate": patient, "other_candidate": other, "bed_candidate": bed, "chair_candidate": chair, "posture": posture,
    }
    return {n: clamp(c) for n, c in out.items()}


def velocity_tiebreak(p: Column, velocity: dict[str, Column], room_support: Column, margin: float = 0.10, min_approach: float = 0.05, order=VISIBLE, let=let) -> Column:
    """Where the two leading visible states are close, the one approached fastest gets the mass; ties in the given order."""
    speed = [F.greatest(F.lit(0.0), -F.coalesce(velocity[n], F.lit(0.0))) for n in order]
    ordered = F.sort_array(F.array(*[p[n] for n in VISIBLE]), asc=False)
    return let([p, ordered, room_support, *speed], lambda p, ordered, room, *speed: _velocity_tiebreak(p, ordered, dict(zip(order, speed, strict=True)), room, margin, min_approach, let))


def _velocity_tiebreak(p, ordered, speed, room_support, margin, min_approach, let) -> Column:
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    top = F.greatest(*speed.values())
    winner = F.coalesce(*[F.when(c == top, n) for n, c in speed.items()])
    stays = (first - second > margin) | (top < min_approach) | ((winner == "room") & (room_support < 0.10))
    target = F.least(F.lit(0.70), F.greatest(first + 0.03, 0.40 + top))
    return F.when(stays, p).otherwise(shift_to(p, winner, target, let))
