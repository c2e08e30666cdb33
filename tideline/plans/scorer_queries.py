"""Queries over the state scorers, and their rules in SQL.

Structs of probabilities are four (or three) columns of one prefix in SQL: p_chair, p_bed, p_room, p_no_patient.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.config import STATES
from tideline.functions import probs as P
from tideline.operators import scorer as S
from tideline.plans import window_queries as WQ
from tideline.plans.standins import BINS, events, sql
from tideline.sources.staging import stage

QUERIES: dict = {}
ORACLE_SQL: dict = {}
VISIBLE, POSTURES = P.VISIBLE, P.POSTURES
TICK = 3600


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


class Steps:
    """Common table expressions that each add columns to the one before."""

    def __init__(self, start: str, prefix: str):
        self.ctes, self.last, self.prefix = {}, start, prefix

    def add(self, **columns: str) -> None:
        name = f"{self.prefix}{len(self.ctes)}"
        self.ctes[name] = f"SELECT *, {', '.join(f'{c} AS {n}' for n, c in columns.items())} FROM {self.last}"
        self.last = name

    def norm(self, out: str, names=STATES, **parts: str) -> None:
        """Columns out_...: nonnegative parts that add up to 1."""
        self.add(**{f"{out}_q_{n}": f"greatest(coalesce({parts[n]}, 0), 0)" for n in names})
        total = " + ".join(f"{out}_q_{n}" for n in names)
        self.add(**{f"{out}_{n}": f"CASE WHEN {total} > 0 THEN {out}_q_{n} / ({total}) ELSE {int(n == 'no_patient')} END" for n in names})

    def visible(self, out: str, p: str) -> None:
        self.norm(out, VISIBLE, **{s: f"{p}_{s}" for s in VISIBLE})

    def blend(self, out: str, *sources: tuple[float, str]) -> None:
        """Sources are normalized or empty, so a sum needs no weights of its own."""
        self.norm(out, VISIBLE, **{s: " + ".join(f"{w} * {p}_{s}" for w, p in sources) for s in VISIBLE})

    def shift(self, out: str, p: str, label: str, goal: str) -> None:
        """p with label raised to the goal; a donor gives what those ahead of it (greater, or first of equals) leave to ask for."""
        cap = {s: 0.55 if s == "no_patient" else 0.45 for s in STATES}
        own = " + ".join(f"CASE WHEN ({label}) = '{s}' THEN {p}_{s} ELSE 0 END" for s in STATES)
        self.add(**{f"{out}_l": label, f"{out}_need": f"least(0.95, greatest(0, {goal})) - ({own})"})
        self.add(**{f"{out}_cap_{s}": f"CASE WHEN {out}_l = '{s}' THEN 0 ELSE {cap[s]} * {p}_{s} END" for s in STATES})
        ahead = lambda s: " + ".join(f"CASE WHEN {p}_{e} > {p}_{s} OR {p}_{e} = {p}_{s} AND {STATES.index(e) < STATES.index(s)} THEN {out}_cap_{e} ELSE 0 END" for e in STATES if e != s)
        self.add(**{f"{out}_give_{s}": f"least({out}_cap_{s}, greatest(0, {out}_need - ({ahead(s)})))" for s in STATES})
        gets = " + ".join(f"{out}_give_{s}" for s in STATES)
        self.norm(f"{out}_m", **{s: f"{p}_{s} - {out}_give_{s} + CASE WHEN {out}_l = '{s}' THEN {gets} ELSE 0 END" for s in STATES})
        self.add(**{f"{out}_{s}": f"CASE WHEN {out}_need <= 0 THEN {p}_{s} ELSE {out}_m_{s} END" for s in STATES})

    def hold(self, out: str, p: str, target: str, prior: str) -> None:
        """p with no_patient at the target; freed mass goes by 0.6 own and 0.4 prior shares, needed mass comes by share."""
        self.visible(f"{out}_own", p)
        self.blend(f"{out}_mix", (0.6, f"{out}_own"), (0.4, prior))
        self.add(**{f"{out}_t": f"least(0.95, greatest(0, {target}))"})
        less = {s: f"{p}_{s} + ({p}_no_patient - {out}_t) * {out}_mix_{s}" for s in VISIBLE}
        more = {s: f"{p}_{s} - ({out}_t - {p}_no_patient) * {out}_own_{s}" for s in VISIBLE}
        self.norm(f"{out}_n", **{s: f"CASE WHEN {out}_t < {p}_no_patient THEN {less[s]} ELSE greatest(0, {more[s]}) END" for s in VISIBLE}, no_patient=f"{out}_t")
        self.add(**{f"{out}_{s}": f"CASE WHEN abs({out}_t - {p}_no_patient) <= 1e-6 THEN {p}_{s} ELSE {out}_n_{s} END" for s in STATES})

    def pick(self, out: str, used: str, a: str, b: str, names=STATES) -> None:
        self.add(**{f"{out}_{s}": f"CASE WHEN {used} THEN {a}_{s} ELSE {b}_{s} END" for s in names})

    def race(self, out: str, p: str, order, room: str = "greatest(coalesce(tail_share_room, 0), coalesce(tail_nearest_room, 0))") -> None:
        """The state approached fastest takes a close race between the two leading visible states of p."""
        self.add(**{f"{out}_a_{s}": f"greatest(0, -coalesce(velocity_{s}, 0))" for s in VISIBLE})
        self.add(**{f"{out}_top": most(p), f"{out}_mid": f"{p}_chair + {p}_bed + {p}_room - {most(p)} - least({p}_chair, {p}_bed, {p}_room)", f"{out}_fast": most(f"{out}_a")})
        self.add(**{f"{out}_win": first(f"{out}_a", order)})
        stays = f"{out}_top - {out}_mid > 0.10 OR {out}_fast < 0.05 OR ({out}_win = 'room' AND {room} < 0.10)"
        self.shift(f"{out}_s", p, f"{out}_win", f"least(0.70, greatest({out}_top + 0.03, 0.40 + {out}_fast))")
        self.pick(out, stays, p, f"{out}_s")


def most(p: str, names=VISIBLE) -> str:
    return f"greatest({', '.join(f'{p}_{s}' for s in names)})"


def first(p: str, names=STATES) -> str:
    """The greatest part; the first of equals."""
    return "CASE " + " ".join(f"WHEN {p}_{s} = {most(p, names)} THEN '{s}'" for s in names) + " END"


def scaled(c: str, by: float = 1) -> str:
    return f"least(1, greatest(0, coalesce({c}, 0) / {by}))"


def margin(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN {c} / ({c} + 0.05) ELSE 0 END"


# --- windows -----------------------------------------------------------------------------------------------------------

#: Frames before an anchor, with stand-ins for what the signals lack, and with speeds and posture changes.
FRAMES = {
    "fr0": """SELECT * REPLACE (CASE WHEN score_sitting > 0 THEN 1.0 ELSE score_sitting END AS score_sitting, CASE WHEN score_standing > 0 THEN 1.0 ELSE score_standing END AS score_standing, CASE WHEN score_lying > 0 THEN 1.0 ELSE score_lying END AS score_lying)
      FROM (SELECT j.*, floor(-back)::BIGINT AS o, ev.k FROM j JOIN ev USING (event_id)) WHERE o BETWEEN -180 AND -1""",
    "fr1": """SELECT *, least(greatest(k / CASE WHEN mk > 100 THEN mk WHEN mk > 1 THEN 100 ELSE 1 END, 0), 1) AS nudge_score, staff_iou AS motion, staff_iou AS in_bed_score, (k % 2) / 2 AS n_patient, 0 AS n_staff, (k % 3) / 4 AS n_other, (k % 5) / 4 AS n_bed, (k % 7) / 8 AS n_chair
      FROM fr0, (SELECT max(k) AS mk FROM fr0)""",
    "fr2": """SELECT *, (d_chair - lag(d_chair) OVER s) / nullif(o - lag(o) OVER s, 0) AS v_chair, (d_bed - lag(d_bed) OVER s) / nullif(o - lag(o) OVER s, 0) AS v_bed, (d_room - lag(d_room) OVER s) / nullif(o - lag(o) OVER s, 0) AS v_room, lag(coalesce(posture, '')) OVER p <> coalesce(posture, '') AS switched
      FROM fr1 WINDOW s AS (PARTITION BY anchor_id, o >= -60, loc ORDER BY o, event_id), p AS (PARTITION BY anchor_id, posed ORDER BY o, event_id)""",
}
_MORE = ("nudge_score", "motion", "n_patient", "n_staff", "n_other", "n_bed", "n_chair", "in_bed_score")


def _summary_columns() -> str:
    out = ["count(*) FILTER (posed) AS posture_frames", "count(*) FILTER (posed AND switched) AS posture_switches", "(-max(o) FILTER (loc))::DOUBLE AS last_visible_gap", "max(staff_iou) FILTER (o >= -60) AS tail_overlap_max", "coalesce(max(staff_iou) FILTER (o >= -60 AND loc), 0) AS seen_overlap"]
    out += [f"coalesce(avg(v_{s}) FILTER (o >= -60 AND loc), 0) AS velocity_{s}" for s in VISIBLE]
    for n, on in (("anchor", "o < -60"), ("tail", "o >= -60")):
        out += [f"count(*) FILTER ({on} AND loc) AS {n}_frames", f"count(*) FILTER ({on} AND posed) AS {n}_posture_frames", f"coalesce(avg(staff_iou) FILTER ({on}), 0) AS {n}_overlap_mean", f"avg(d_bed - d_room) FILTER ({on} AND loc) AS {n}_room_bed_margin"]
        out += [f"coalesce(sum(power(2, o / 45) / greatest(d_{s}, 1e-6)) FILTER ({on} AND loc AND d_{s} IS NOT NULL), 0) AS {n}_w_{s}" for s in VISIBLE] + [f"count(*) FILTER ({on} AND loc AND state = '{s}') AS {n}_n_{s}" for s in VISIBLE]
        out += [f"coalesce(avg((state = '{s}')::INT) FILTER ({on}), 0) AS {n}_share_{s}" for s in STATES] + [f"coalesce(avg((state = '{s}')::INT) FILTER ({on} AND loc), 0) AS {n}_nearest_{s}" for s in VISIBLE]
        out += [f"coalesce(avg({c}) FILTER ({on}), 0) AS {n}_{c}_mean, coalesce(max({c}) FILTER ({on}), 0) AS {n}_{c}_max" for c in _MORE]
        out += [f"coalesce(sum(power(2, o / 45) * coalesce(score_{x}, 0)) FILTER ({on} AND posed), 0) AS {n}_p_{x}, coalesce(avg((posture = '{x}')::INT) FILTER ({on} AND posture IS NOT NULL), 0) AS {n}_posture_share_{x}" for x in POSTURES]
    return ", ".join(out)


def _panel_steps() -> Steps:
    st = Steps("pn", "pq")
    for n in ("anchor", "tail"):
        st.norm(f"{n}_near", VISIBLE, **{s: f"{n}_w_{s}" for s in VISIBLE})
        st.norm(f"{n}_cnt", VISIBLE, **{s: f"{n}_n_{s}" for s in VISIBLE})
        st.norm(f"{n}_pr", VISIBLE, **{s: f"0.75 * {n}_near_{s} + 0.25 * {n}_cnt_{s}" for s in VISIBLE})
        st.norm(f"{n}_posture", POSTURES, **{x: f"{n}_p_{x}" for x in POSTURES})
        st.add(**{f"{n}_label": f"CASE WHEN {most(f'{n}_pr')} > 0 THEN {first(f'{n}_pr', ('room', 'chair', 'bed'))} ELSE 'no_patient' END"})
    st.add(departure_detected="greatest(tail_pr_room, tail_share_room, seen_overlap, tail_nudge_score_max) >= 0.35 AND tail_share_room >= 0.10", room_bed_margin_delta="tail_room_bed_margin - anchor_room_bed_margin")
    return st


_PS = _panel_steps()
PANEL = WQ.LABELLED | FRAMES | {"pn": f"SELECT anchor_id, {_summary_columns()} FROM fr2 GROUP BY anchor_id"} | _PS.ctes | {"sm6": f"SELECT * FROM {_PS.last}"}


def panel(spark, d):
    """The frames before every anchor. Nudges, motion, bed scores and counts of candidates are stand-ins."""
    p = WQ.panel(spark, d).filter(F.col("offset").between(-180, -1))
    iou, k = F.col("staff_iou"), F.col("k")
    return p.withColumns({"nudge_score": k.cast("double"), "motion": iou, "in_bed_score": iou, "n_patient": k % 2 / 2, "n_staff": F.lit(0.0), "n_other": k % 3 / 4, "n_bed": k % 5 / 4, "n_chair": k % 7 / 8})


def summary(spark, d):
    return stage(S.panel_summary(stage(panel(spark, d), "frames")), "panel")


_FLAT = [c for n in ("anchor", "tail") for c in (f"{n}_frames", f"{n}_posture_frames", f"{n}_label")] + ["posture_frames", "posture_switches", "last_visible_gap", "departure_detected"]
_EXACT = ("anchor_frames", "tail_frames", "anchor_posture_frames", "tail_posture_frames", "posture_frames", "posture_switches")
_ROUNDED = ["tail_overlap_max", "room_bed_margin_delta"] + [f"velocity_{s}" for s in VISIBLE]
for _n in ("anchor", "tail"):
    _ROUNDED += [f"{_n}_overlap_mean", f"{_n}_room_bed_margin"] + [f"{_n}_share_{s}" for s in STATES] + [f"{_n}_nearest_{s}" for s in VISIBLE] + [f"{_n}_{c}_{k}" for c in _MORE for k in ("mean", "max")] + [f"{_n}_posture_share_{x}" for x in POSTURES]
_STRUCTS = {f"{n}_{k}": names for n in ("anchor", "tail") for k, names in (("probs", VISIBLE), ("posture", POSTURES))}
_SQL_OF = {f"{n}_probs": f"{n}_pr" for n in ("anchor", "tail")} | {f"{n}_posture": f"{n}_posture" for n in ("anchor", "tail")}


@query("b50_panel_summary", sql(f"SELECT anchor_id, {', '.join(_FLAT)}, {', '.join(f'round({c}, 8) AS {c}' for c in _ROUNDED)}, {', '.join(f'round({_SQL_OF[c]}_{n}, 8) AS {c}_{n}' for c, names in _STRUCTS.items() for n in names)} FROM sm6", **PANEL))
def b50(spark, d):
    s = summary(spark, d)
    return s.select("anchor_id", *_FLAT, *[F.round(c, 8).alias(c) for c in _ROUNDED], *[F.round(f"{c}.{n}", 8).alias(f"{c}_{n}") for c, names in _STRUCTS.items() for n in names])


def _support_steps(st: Steps) -> None:
    """Supports and the confidence in a departure, of a panel's summary (t_... are the tail's probabilities)."""
    st.add(
        u_motion=scaled("greatest(coalesce(tail_motion_max, 0), coalesce(tail_motion_mean, 0))", 0.15), u_patient=f"greatest({scaled('anchor_n_patient_mean')}, {scaled('tail_n_patient_mean')})", u_other=scaled("tail_n_other_mean", 0.5),
        u_bedc=scaled("tail_n_bed_mean"), u_chairc=scaled("tail_n_chair_mean"), u_posture=scaled("tail_posture_frames", 6), u_in_bed="least(1, greatest(coalesce(tail_in_bed_score_max, 0), coalesce(tail_in_bed_score_mean, 0), 0))", u_share="coalesce(tail_share_room, 0)", u_near="coalesce(tail_nearest_room, 0)",
        departure_confidence=f"least(1, CASE WHEN departure_detected THEN 0.30 ELSE 0 END + CASE WHEN anchor_label IN ('chair', 'bed') AND tail_label = 'room' THEN 0.10 ELSE 0 END + 0.25 * {scaled('tail_share_room', 0.25)} + 0.20 * {scaled('tail_nearest_room', 0.35)} + 0.10 * {margin('coalesce(room_bed_margin_delta, 0)')} + 0.03 * {scaled('tail_overlap_max', 0.25)} + 0.02 * {scaled('tail_nudge_score_max', 0.70)})",
    )
    st.add(
        s_presence="least(1, greatest(u_patient, u_posture, 0.75 * u_in_bed, 0.60 * u_motion, 0.50 * greatest(u_other, u_bedc, u_chairc)))", s_room="least(1, greatest(u_share, u_near, 0.60 * u_other, 0.40 * u_motion))",
        s_bed="least(1, greatest(coalesce(tail_pr_bed, 0), coalesce(tail_nearest_bed, 0), 0.65 * u_in_bed, 0.50 * u_bedc))", s_chair="least(1, greatest(coalesce(tail_pr_chair, 0), 0.50 * u_chairc, 0.35 * u_patient))",
    )


_SUP = Steps("sm6", "su")
_support_steps(_SUP)


@query("b54_presence_support", sql(f"SELECT anchor_id, round(departure_confidence, 8) AS departure_confidence, round(s_presence, 8) AS presence, round(s_room, 8) AS room, round(s_bed, 8) AS bed, round(s_chair, 8) AS chair FROM {_SUP.last}", **PANEL, **_SUP.ctes))
def b54(spark, d):
    s = summary(spark, d)
    f = {c: F.col(c) for c in s.columns}
    p = P.presence_support(f)
    return s.select("anchor_id", F.round(P.departure_confidence(f), 8).alias("departure_confidence"), *[F.round(p[n], 8).alias(n) for n in ("presence", "room", "bed", "chair")])


def _second_steps() -> Steps:
    """The second scorer: g_... are its probabilities, lg_... the window's own."""
    st = Steps("wn", "sc")
    st.norm("lg", **{s: f"prob_{s}" for s in STATES})
    st.visible("lv", "lg")
    st.add(**{f"{n}_{s}": f"coalesce({n}_pr_{s}, 0)" for n in ("anchor", "tail") for s in VISIBLE}, fa="coalesce(anchor_frames, 0)", ft="coalesce(tail_frames, 0)", sr="coalesce(tail_share_room, 0)", ov="least(1, greatest(coalesce(tail_overlap_max, 0), 2 * coalesce(tail_overlap_mean, 0)))",
           sa="least(1, greatest((coalesce(tail_nudge_score_max, 0) - 0.5) / 0.5, coalesce(tail_nudge_score_mean, 0) - coalesce(anchor_nudge_score_mean, 0), 0))", gr="coalesce(least(1, last_visible_gap / 180), 1)",
           dist=f"greatest(coalesce(tail_nearest_room, 0), {margin('coalesce(tail_room_bed_margin, 0)')}, {margin('coalesce(room_bed_margin_delta, 0)')})")
    st.add(room="greatest(tail_room, sr)", gate="greatest(sr, ov, sa)", wa="CASE WHEN fa <= 0 THEN 0 WHEN ft <= 0 THEN 1 ELSE 0.45 END")
    st.add(sits="lg_chair >= 0.5 AND sr < 0.05 AND dist < 0.25", lock="tail_bed >= 0.6 AND coalesce(tail_nearest_bed, 0) >= 0.6 AND gate < 0.15 AND dist < 0.55", w0="CASE WHEN gate >= 0.15 THEN 0.35 WHEN lg_room >= 0.7 AND anchor_chair >= 0.6 THEN 0.3 ELSE 0.15 END", near="least(1, 0.6 * room + 0.25 * ov + 0.15 * sa)",
           recent=f"ft > 0 AND {most('tail')} >= 0.65 AND coalesce(last_visible_gap, 0) <= 60", g0="least(0.85, greatest(0.05, least(0.85, lg_no_patient), 0.55 * coalesce(tail_share_no_patient, 0) + 0.45 * gr))")
    st.add(w="CASE WHEN sits THEN greatest(w0, 0.55) ELSE w0 END", g1="CASE WHEN recent THEN least(g0, 0.25) ELSE g0 END", d0="greatest(CASE WHEN gate >= 0.15 THEN near ELSE least(0.34, near) END, CASE WHEN gate >= 0.15 AND NOT lock THEN least(1, 0.65 * dist + 0.2 * room + 0.1 * ov + 0.05 * sa) ELSE 0 END)")
    st.norm("vi", VISIBLE, **{s: f"w * lv_{s} + (1 - w) * (wa * anchor_{s} + (1 - wa) * tail_{s})" for s in VISIBLE})
    st.add(dr="CASE WHEN sits THEN least(d0, 0.34) ELSE d0 END", capped=f"ov >= 0.05 AND {most('vi')} >= 0.45 AND g1 > 0.2")
    st.add(gone="CASE WHEN capped THEN 0.2 ELSE g1 END")
    st.add(**{f"x_{s}": f"greatest(0.15, 1 - gone) * vi_{s}" for s in VISIBLE})
    st.add(giver="CASE greatest(x_chair, x_bed, gone) WHEN x_chair THEN 'chair' WHEN x_bed THEN 'bed' ELSE 'no_patient' END", blind="fa <= 0 AND ft <= 0", sure=f"{most('lv')} >= 0.45 AND lg_no_patient < 0.8", keep="least(0.35, greatest(0.1, lg_no_patient))")
    st.add(mv="CASE WHEN dr >= 0.35 AND greatest(room, dist) >= 0.15 AND NOT lock THEN least(0.28 * dr * CASE WHEN own_label = 'room' AND sa >= 0.5 AND room >= 0.25 THEN 1.25 ELSE 1 END, greatest(x_chair, x_bed, gone) * CASE giver WHEN 'no_patient' THEN 0.4 ELSE 0.35 END) ELSE 0 END")
    seen = {s: f"x_{s} - CASE giver WHEN '{s}' THEN mv ELSE 0 END" for s in ("chair", "bed")} | {"room": "x_room + mv"}
    st.norm("g", **{s: f"CASE WHEN blind THEN CASE WHEN sure THEN (1 - keep) * lv_{s} ELSE 0 END ELSE {seen[s]} END" for s in VISIBLE}, no_patient="CASE WHEN blind THEN CASE WHEN sure THEN keep ELSE 1 END ELSE gone - CASE giver WHEN 'no_patient' THEN mv ELSE 0 END END")
    st.add(v2_label=first("g"), v2_reason="CASE WHEN blind AND sure THEN 'sparse_panel_sql_fallback' WHEN blind THEN 'zero_signal_default' WHEN mv > 0 THEN 'room_recovery_v2' WHEN recent THEN 'recent_visible_fallback' WHEN capped THEN 'overlap_present_reallocation' WHEN g_no_patient >= 0.75 THEN 'strong_no_patient' ELSE 'direct_focus_argmax' END")
    return st


_SECOND = _second_steps()
_WN = """SELECT l.anchor_id, l.label AS own_label, prob_chair, prob_bed, prob_room, prob_no_patient, w_chair, w_bed, w_room, visible_prob, visibility_ratio, prob_not_visible, prob_out_of_room, away, signal_count, l.posture_frames AS own_frames, s.* EXCLUDE (anchor_id) FROM (SELECT pr.*, lb.label FROM pr JOIN lb ON pr.anchor_id = lb.anchor_id) l LEFT JOIN sm6 s ON l.anchor_id = s.anchor_id"""
SECOND = PANEL | {"wn": _WN} | _SECOND.ctes


def windows(spark, d):
    l = WQ.labelled(spark, d)
    cond = {f"cond_{s}": F.when(F.col("visible_prob") > 0, F.col(f"w_{s}")).otherwise(0.0) for s in VISIBLE}
    return l.select(
        "anchor_id", "label", *[f"prob_{s}" for s in STATES], *[F.col(f"w_{s}").alias(f"focus_{s}") for s in VISIBLE], *[c.alias(n) for n, c in cond.items()], "visible_prob", "visibility_ratio", "prob_not_visible", "prob_out_of_room",
        "out_of_room_share", "signal_count", F.col("posture_frames").alias("own_posture_frames"),
    )


@query("b52_score_v2", sql(f"SELECT anchor_id, {', '.join(f'round(g_{s} + 3e-8, 6) AS prob_{s}' for s in STATES)}, v2_label AS label, coalesce(departure_detected, false) AS departure_detected, v2_reason AS reason FROM {_SECOND.last}", **SECOND))
def b52(spark, d):
    v2 = S.score_v2(stage(windows(spark, d), "windows"), summary(spark, d))
    return v2.select("anchor_id", *[F.round(F.col(f"prob_{s}") + 3e-8, 6).alias(f"prob_{s}") for s in STATES], "label", "departure_detected", "reason")


def _weight(labels: str) -> str:
    """The anchor window's weight beside the tail's."""
    a, t = f"{most('anchor')} * least(1, fa / 4)", f"{most('tail')} * least(1, ft / 4)"
    return f"""CASE WHEN ft <= 0 THEN 1 WHEN fa <= 0 THEN 0 ELSE least(0.80, greatest(0.20, 0.45 + CASE WHEN {t} > {a} + 0.15 THEN -0.15 WHEN {a} > {t} + 0.15 THEN 0.15 ELSE 0 END
      + coalesce(0.15 * least(1, greatest(0, last_visible_gap / 60)), 0) + CASE WHEN {labels} THEN CASE WHEN ft < 3 THEN 0.10 ELSE -0.05 END ELSE 0 END)) END"""


def _third_steps(st: Steps, windowed: bool) -> None:
    """Evidence and steps of the third scorer, from base_..., base_label, ow_... (own), pi_... (prior), aw (weight) and a panel's summary; f_... is its result."""
    _support_steps(st)
    n = lambda c: f"coalesce({c}, 0)"
    st.norm("pv", VISIBLE, **{s: f"aw * anchor_{s} + (1 - aw) * tail_{s}" for s in VISIBLE})
    for k in ("anchor", "tail"):
        st.norm(f"{k}_ps", POSTURES, **{x: f"{k}_posture_share_{x}" for x in POSTURES})
    st.norm("po", POSTURES, **{x: f"0.75 * (aw * coalesce(anchor_posture_{x}, 0) + (1 - aw) * coalesce(tail_posture_{x}, 0)) + 0.25 * (aw * anchor_ps_{x} + (1 - aw) * tail_ps_{x})" for x in POSTURES})
    best = lambda k: f"CASE WHEN {most(f'{k}_posture', POSTURES)} > 0 THEN CASE WHEN {most(f'{k}_posture', POSTURES)} >= 0.45 THEN {first(f'{k}_posture', POSTURES)} ELSE 'none' END WHEN {most(f'{k}_ps', POSTURES)} >= 0.45 THEN {first(f'{k}_ps', POSTURES)} ELSE 'none' END"
    st.add(
        vis_support=f"greatest({most('ow')}, {most('pi')}, {n('visible_prob')}, {n('visibility_ratio')}, least(1, {n('signal_count')} / 20))", tra_support=f"greatest({n('not_visible_prob')}, 1 - {n('visibility_ratio')}, {n('prob_not_visible')})", out_support=f"greatest({n('out_of_room_prob')}, {n('out_of_room_share')}, {n('prob_out_of_room')})",
        twice=f"greatest({scaled('ft', 2)}, {scaled('signal_count', 2)}, {scaled('tail_n_patient_mean')}, 0.75 * u_motion)", located="fa > 0 OR ft > 0", posture_a=best("anchor"), posture_t=best("tail"), pframes=f"greatest({n('posture_frames')}, {n('own_frames')})",
        blocked=f"({n('tail_nearest_bed')} >= 0.75 AND u_share < 0.10 AND u_near < 0.15) OR (u_in_bed >= 0.55 AND u_share < 0.20 AND u_near < 0.25)", approach=f"{n('velocity_room')} <= -0.05",
    )
    st.add(
        regime="CASE WHEN vis_support >= greatest(tra_support, out_support) AND vis_support >= 0.35 THEN 'visible' WHEN out_support >= greatest(vis_support, tra_support) AND out_support >= 0.45 THEN 'out_of_room' WHEN tra_support >= greatest(vis_support, out_support) AND tra_support >= 0.35 THEN CASE WHEN s_presence >= 0.35 THEN 'present_but_sparse' ELSE 'temporarily_not_visible' END ELSE 'unknown' END",
        certain="greatest(twice, u_posture) >= 0.60", room_certain="twice >= 0.60", bed_ok="located OR (u_in_bed >= 0.95 AND greatest(u_patient, u_posture, 0.75 * u_motion, 0.75 * u_chairc) >= 0.60 AND u_bedc >= 0.35)", strong=f"vis_support >= 0.80 AND {most('pi')} >= 0.60",
    )
    st.visible("bv", "base")
    st.blend("mx", (0.7, "bv"), (0.2, "pv"), (0.1, "pi"))
    st.norm("fi", **{s: f"(1 - base_no_patient) * mx_{s}" for s in VISIBLE}, no_patient="base_no_patient")
    st.add(rb="base_label = 'room'")
    if windowed:
        st.pick("h", "rb", "base", "fi")
        st.visible("hv", "h")
        st.pick("z0", "rb", "hv", "mx", VISIBLE)
    else:
        st.pick("h", "false", "fi", "fi")
        st.pick("z0", "true", "mx", "mx", VISIBLE)
    st.add(goal=f"""CASE WHEN regime = 'visible' AND certain THEN least(h_no_patient, CASE WHEN strong THEN 0.35 ELSE 0.50 END) WHEN regime = 'temporarily_not_visible' AND {most('pi')} >= 0.45 AND certain THEN least(h_no_patient, 0.50)
      WHEN regime = 'present_but_sparse' AND certain THEN least(h_no_patient, 0.45) WHEN regime = 'out_of_room' THEN greatest(h_no_patient, 0.55) ELSE h_no_patient END""")
    st.add(moved="abs(goal - h_no_patient) > 0.02" + ("" if windowed else " AND NOT rb"))
    st.blend("to", (0.6, "z0"), (0.4, "pi"))
    st.hold("hd", "h", "goal", "to" if windowed else "pi")
    if not windowed:
        st.pick("hb", "rb", "base", "h")
    st.pick("a", "moved", "hd", "h" if windowed else "hb")
    st.visible("av", "a")
    st.pick("z1", "moved", "av", "z0", VISIBLE)
    st.add(carried="moved AND goal < base_no_patient AND (strong OR regime = 'present_but_sparse')", hidden="regime = 'present_but_sparse' AND s_room >= 0.35 AND room_certain")
    st.add(takes="NOT blocked AND ((departure_confidence >= 0.35 AND room_certain AND (u_near >= 0.35 OR approach OR hidden OR (coalesce(departure_detected, false) AND (u_near >= 0.35 OR u_share >= 0.35 OR approach)))) OR hidden)")
    st.shift("rs", "a", "'room'", "least(0.70, greatest(a_room, 0.18 + 0.60 * greatest(departure_confidence, s_room)))")
    st.add(room_used="takes AND NOT rb AND rs_room > a_room + 0.02" if windowed else "takes")
    st.pick("b", "room_used", "rs", "a")
    likely = "u_in_bed >= 0.55 AND s_bed >= greatest(s_room, s_chair) AND {p}_room < 0.30 AND bed_ok AND NOT room_used"
    if windowed:
        st.race("rc", "b", VISIBLE)
        lead = lambda p: f"CASE WHEN {most(p)} > 0 THEN {first(p, ('room', 'chair', 'bed'))} ELSE 'none' END"
        st.add(race_used=f"{lead('rc')} <> {lead('b')}")
        st.pick("c", "race_used", "rc", "b")
        st.shift("bs", "c", "'bed'", "least(0.80, greatest(c_bed, 0.20 + 0.60 * u_in_bed))")
        st.add(bed_used=likely.format(p="c") + " AND NOT rb AND bs_bed > c_bed + 0.02")
        st.pick("e", "bed_used", "bs", "c")
        st.add(touched="rb OR moved OR room_used OR race_used OR bed_used")
    else:
        st.shift("bs", "b", "'bed'", "least(0.80, greatest(b_bed, 0.20 + 0.60 * u_in_bed))")
        st.add(bed_used=likely.format(p="b"))
        st.pick("c", "bed_used", "bs", "b")
        st.race("e", "c", VISIBLE[::-1])
        st.add(touched="true")
    st.visible("ev", "e")
    st.pick("z2", "touched", "ev", "z1", VISIBLE)
    four = ("room", "no_patient", "chair", "bed") if windowed else STATES
    st.add(leader=first("e", four))
    st.add(posture_gate=f"""CASE WHEN leader NOT IN ('chair', 'bed') THEN 'winner_not_furniture' WHEN greatest(e_room, e_no_patient) >= 0.35 THEN 'room_or_no_patient_evidence' WHEN departure_confidence >= 0.35 THEN 'departure_evidence' WHEN pframes < 6 THEN 'insufficient_posture_frames'
      WHEN {n('posture_switches')} > 2 THEN 'unstable_posture' WHEN posture_a <> 'none' AND posture_t <> 'none' AND posture_a <> posture_t THEN 'anchor_tail_posture_disagree' WHEN po_lying < 0.60 THEN 'lying_not_dominant' WHEN abs(e_chair - e_bed) > 0.20 THEN 'chair_bed_gap_too_wide' ELSE 'applied' END""", ahead="greatest(0, po_lying - greatest(po_sitting, po_standing))")
    st.add(pb="CASE WHEN posture_gate = 'applied' THEN least(1, ahead / 0.25) * least(1, pframes / 6) ELSE 0 END", seated="z2_chair + z2_bed", signal="z2_bed + ahead * (z2_chair + z2_bed)")
    st.norm("ln", VISIBLE, chair="seated * z2_chair / greatest(1e-6, z2_chair + signal)", bed="seated * signal / greatest(1e-6, z2_chair + signal)", room="z2_room")
    st.norm("bl", VISIBLE, **{s: f"(1 - pb) * z2_{s} + pb * ln_{s}" for s in VISIBLE})
    st.norm("pp", **{s: f"(1 - e_no_patient) * bl_{s}" for s in VISIBLE}, no_patient="e_no_patient")
    st.add(posture_used="pb > 0 AND pp_bed > e_bed + 0.02" if windowed else "pb > 0")
    st.pick("f", "posture_used", "pp", "e")


def _third() -> Steps:
    st = Steps(_SECOND.last, "td")
    st.visible("fo", "w")
    st.norm("co", VISIBLE, **{s: f"CASE WHEN visible_prob > 0 THEN w_{s} ELSE 0 END" for s in VISIBLE})
    st.add(**{f"ow_{s}": f"lv_{s}" for s in VISIBLE})
    st.blend("pi", (0.45, "ow"), (0.35, "fo"), (0.20, "co"))
    lead = lambda p: first(p, ("room", "chair", "bed"))
    differ = f"{most('anchor')} >= 0.40 AND {most('tail')} >= 0.40 AND {lead('anchor')} <> {lead('tail')}"
    st.add(aw=_weight(differ), base_label="v2_label", not_visible_prob="NULL::DOUBLE", out_of_room_prob="NULL::DOUBLE", out_of_room_share="away", **{f"base_{s}": f"g_{s}" for s in STATES})
    _third_steps(st, windowed=True)
    st.add(carry="carried AND (regime = 'present_but_sparse' OR (strong AND NOT located))")
    st.add(recovery="CASE WHEN bed_used THEN 'bed_in_bed_recovery_v3' WHEN race_used AND NOT room_used AND NOT carry THEN 'velocity_tiebreak_v3' WHEN room_used THEN 'room_departure_recovery_v3' WHEN carried THEN 'sparse_signal_carry_forward_v3' END")
    st.add(v3_reason="CASE WHEN posture_used THEN 'posture_state_collapse_v3' WHEN room_used THEN 'room_departure_recovery_v3' WHEN bed_used THEN 'bed_in_bed_recovery_v3' WHEN race_used THEN 'velocity_tiebreak_v3' ELSE coalesce(recovery, v2_reason) END")
    return st


_THIRD = _third()
_KEPT = ("departure_confidence", "presence_support", "room_presence_support", "bed_in_bed_support", "anchor_weight")


@query("b56_score_v3", sql(f"""SELECT anchor_id, {', '.join(f'round(f_{s} + 3e-8, 6) AS prob_{s}' for s in STATES)}, v3_reason AS reason, coalesce(recovery, v2_reason) AS base_recovery_reason, regime AS signal_regime, carry AS carry_forward_used, posture_used AS posture_applied, posture_gate, v2_reason,
  round(departure_confidence, 8) AS departure_confidence, round(s_presence, 8) AS presence_support, round(s_room, 8) AS room_presence_support, round(u_in_bed, 8) AS bed_in_bed_support, round(aw, 8) AS anchor_weight FROM {_THIRD.last}""", **SECOND, **_THIRD.ctes))  # fmt: skip
def b56(spark, d):
    v3 = S.score_v3(stage(windows(spark, d), "windows"), summary(spark, d))
    return v3.select("anchor_id", *[F.round(F.col(f"prob_{s}") + 3e-8, 6).alias(f"prob_{s}") for s in STATES], "reason", "base_recovery_reason", "signal_regime", "carry_forward_used", "posture_applied", "posture_gate", "v2_reason", *[F.round(c, 8).alias(c) for c in _KEPT])


def _blended() -> Steps:
    st = Steps("wn", "bd")
    st.add(**{f"{n}_{s}": f"coalesce({n}_pr_{s}, 0)" for n in ("anchor", "tail") for s in VISIBLE}, fa="coalesce(anchor_frames, 0)", ft="coalesce(tail_frames, 0)")
    lead = lambda p: first(p, ("room", "chair", "bed"))
    st.add(aw=_weight(f"{most('anchor')} >= 0.40 AND {most('tail')} >= 0.40 AND {lead('anchor')} <> {lead('tail')}"))
    st.norm("lg", **{s: f"prob_{s}" for s in STATES})
    st.visible("lv", "lg")
    st.norm("pv", VISIBLE, **{s: f"aw * anchor_{s} + (1 - aw) * tail_{s}" for s in VISIBLE})
    st.blend("vi", (0.7, "pv"), (0.3, "lv"))
    st.norm("a", **{s: f"(1 - lg_no_patient) * vi_{s}" for s in VISIBLE}, no_patient="lg_no_patient")
    st.hold("b", "a", "CASE WHEN ft > 0 THEN least(a_no_patient, 0.35) ELSE a_no_patient END", "vi")
    st.race("f", "b", VISIBLE, "pv_room")
    return st


_BLENDED = _blended()


@query("b53_blended_state", sql(f"SELECT anchor_id, round(aw, 8) AS anchor_weight, {', '.join(f'round(f_{s} + 3e-8, 6) AS {s}' for s in STATES)}, {first('f', ('room', 'no_patient', 'chair', 'bed'))} AS label FROM {_BLENDED.last}", **PANEL, wn=_WN, **_BLENDED.ctes))
def b53(spark, d):
    p = S.blended_state(stage(windows(spark, d).select("anchor_id", *[f"prob_{s}" for s in STATES]), "windows"), summary(spark, d))
    return p.select("anchor_id", F.round("anchor_weight", 8).alias("anchor_weight"), *[F.round(F.col("probs")[s] + 3e-8, 6).alias(s) for s in STATES], "label")


def _evaluation() -> Steps:
    st = Steps("ew", "ee")
    for n in ("focus", "drop"):
        w, c = " + ".join(f"{n}_w_{s}" for s in VISIBLE), " + ".join(f"{n}_n_{s}" for s in VISIBLE)
        st.norm(n, VISIBLE, **{s: f"CASE WHEN {w} > 0 AND {c} > 0 THEN 0.7 * {n}_w_{s} / ({w}) + 0.3 * {n}_n_{s} / {n}_frames WHEN {w} > 0 THEN {n}_w_{s} / ({w}) ELSE {n}_n_{s} / nullif({n}_frames, 0) END" for s in VISIBLE})
    st.norm("lg", **{s: f"prob_{s}" for s in STATES})
    st.add(gap="coalesce(panel_gap, last_visible_gap_seconds)", ff="coalesce(focus_frames, 0)", df="coalesce(drop_frames, 0)")
    st.add(recent="gap IS NULL OR gap <= 60", **{f"{n}_s0": f"greatest(0.55, coalesce(visible_prob, 0), least(0.90, 0.20 + 0.75 * {most(n)}))" for n in ("focus", "drop")})
    st.add(**{f"{n}_s1": f"CASE WHEN NOT recent THEN least({n}_s0, 0.50) WHEN {most(n)} >= 0.70 THEN greatest({n}_s0, 0.75) ELSE {n}_s0 END" for n in ("focus", "drop")}, alone="1 - least(0.85, greatest(0.35, 0.55, 1 - least(lg_no_patient, 0.45)))")
    st.add(**{f"{n}_gone": f"least(lg_no_patient, 1 - least(0.90, greatest(0.35, {n}_s1)))" for n in ("focus", "drop")})
    st.add(kind=f"CASE WHEN df <= 0 AND ff <= 0 AND focus_visible_frames <= 0 THEN 'blind' WHEN ff > 0 AND {most('focus')} > 0 THEN 'focus' WHEN focus_visible_frames <= 0 AND df > 0 AND {most('drop')} > 0 THEN 'drop' WHEN lg_no_patient >= 0.75 AND df > 0 AND {most('drop')} > 0 AND recent AND alone < lg_no_patient THEN 'sparse' ELSE 'own' END")
    st.add(back=f"kind = 'focus' AND focus_visible_frames <= 0 AND {most('focus')} >= 0.70 AND recent")
    st.add(gone=f"CASE kind WHEN 'blind' THEN 1 WHEN 'focus' THEN CASE WHEN back THEN least(focus_gone, 0.25) ELSE focus_gone END WHEN 'drop' THEN CASE WHEN {most('drop')} >= 0.70 AND recent THEN least(drop_gone, 0.25) ELSE drop_gone END WHEN 'sparse' THEN alone ELSE lg_no_patient END")
    st.add(**{f"x_{s}": f"CASE kind WHEN 'blind' THEN 0 WHEN 'own' THEN lg_{s} WHEN 'focus' THEN (1 - gone) * focus_{s} ELSE (1 - gone) * drop_{s} END" for s in VISIBLE})
    st.add(giver="CASE greatest(x_chair, x_bed, gone) WHEN x_chair THEN 'chair' WHEN x_bed THEN 'bed' ELSE 'no_patient' END")
    st.add(mv="CASE WHEN x_room <= 0 AND drop_room > 0 THEN least(0.25, greatest(0.10, drop_room), greatest(x_chair, x_bed, gone) * CASE giver WHEN 'no_patient' THEN 0.35 ELSE 0.50 END) ELSE 0 END")
    st.norm("g", **{s: f"x_{s} - CASE giver WHEN '{s}' THEN mv ELSE 0 END" for s in ("chair", "bed")}, room="x_room + mv", no_patient="gone - CASE giver WHEN 'no_patient' THEN mv ELSE 0 END")
    st.add(why="CASE WHEN kind = 'blind' THEN 'zero_signal_default' WHEN back OR kind IN ('drop', 'sparse') THEN 'recent_visible_fallback' WHEN mv > 0 THEN 'room_recovery_v2' WHEN g_no_patient >= 0.75 THEN 'strong_no_patient' ELSE 'direct_focus_argmax' END")
    return st


_EVALUATION = _evaluation()


def _evaluation_columns() -> str:
    out = ["(-max(o) FILTER (loc))::DOUBLE AS panel_gap"]
    for n, on in (("focus", "loc AND o >= -30"), ("drop", "loc")):
        out += [f"count(*) FILTER ({on}) AS {n}_frames"] + [f"coalesce(sum(power(2, o / 45) / greatest(d_{s}, 1e-6)) FILTER ({on} AND d_{s} IS NOT NULL), 0) AS {n}_w_{s}, count(*) FILTER ({on} AND state = '{s}') AS {n}_n_{s}" for s in VISIBLE]
    return ", ".join(out)


EVALUATION = WQ.LABELLED | {
    "es": f"SELECT anchor_id, {_evaluation_columns()} FROM (SELECT *, floor(-back)::BIGINT AS o FROM j) WHERE o BETWEEN -180 AND -1 GROUP BY anchor_id",
    "ew": "SELECT p.anchor_id, prob_chair, prob_bed, prob_room, prob_no_patient, focus_visible_frames, visible_prob, last_visible_gap_seconds / 3600 AS last_visible_gap_seconds, es.* EXCLUDE (anchor_id) FROM pr p LEFT JOIN es ON p.anchor_id = es.anchor_id",
} | _EVALUATION.ctes


@query("b57_score_evaluation", sql(f"SELECT anchor_id, {', '.join(f'round(g_{s} + 3e-8, 6) AS prob_{s}' for s in STATES)}, {first('g')} AS label, why AS reason FROM {_EVALUATION.last}", **EVALUATION))
def b57(spark, d):
    own = WQ.labelled(spark, d).withColumn("last_visible_gap_seconds", F.col("last_visible_gap_seconds") / TICK)
    frames = WQ.panel(spark, d).filter(F.col("offset").between(-180, -1))
    e = S.score_evaluation(stage(own.select("anchor_id", *[f"prob_{s}" for s in STATES], "focus_visible_frames", "visible_prob", "last_visible_gap_seconds"), "windows"), stage(S.evaluation_summary(frames), "panel"))
    return e.select("anchor_id", *[F.round(F.col(f"prob_{s}") + 3e-8, 6).alias(f"prob_{s}") for s in STATES], "label", "reason")


def tick_signals(spark, d):
    """One signal a unit and hour (an hour stands for a second), the last of equals, with base probabilities and evidence from its counter."""
    k, value = F.col("k"), F.col("value")
    e = events(spark, d).filter("event_type <> 'error'").withColumn("t", F.floor(F.unix_seconds("ts") / TICK))
    last = e.groupBy("monitor_id", "t").agg(F.max_by(F.struct("event_id", "event_type", "value", "k"), "event_id").alias("x")).select("monitor_id", "t", "x.*")
    near = lambda kind, other, by: F.when(F.col("event_type") == kind, value / 100).when(k % other == 0, value / by + 0.1)
    s = last.withColumns({"d_chair": near("click", 2, 50), "d_bed": near("view", 3, 45), "d_room": near("purchase", 2, 40)}).withColumn("has_location", F.col("event_type") != "signup")
    score = {x: F.when(k % 4 == i, k / 100.0) for i, x in enumerate(POSTURES)}
    return s.withColumns(
        {f"score_{x}": c for x, c in score.items()}
        | {
            "state": F.when(F.col("event_type") == "click", "chair").when(F.col("event_type") == "view", "bed").when(F.col("event_type") == "purchase", "room").otherwise("no_patient"), "staff_iou": F.when(k >= 70, k / 100.0).otherwise(0.0),
            "posture": F.when(k % 4 == 0, "sitting").when(k % 4 == 1, "standing").when(k % 4 == 2, "Lying "), "nudge_score": k.cast("double"), "motion": F.when(k % 2 == 0, value / 2000), "in_bed_score": F.when(k % 3 == 0, k / 100.0),
            "n_patient": F.when(k % 5 != 0, k % 2 / 2), "n_staff": F.lit(0.0), "n_other": k % 3 / 8, "n_bed": k % 5 / 4, "n_chair": k % 7 / 8, "base_chair": k % 10 / 21, "base_bed": F.floor(k / 10) / 23, "base_room": F.lit(0.1), "base_no_patient": 0.9 - k % 10 / 21 - F.floor(k / 10) / 23,
            "visible_prob": k % 9 / 12, "visibility_ratio": k % 8 / 8, "not_visible_prob": k % 7 / 8, "out_of_room_prob": k % 6 / 7, "signal_count": (k % 4).cast("double"),
        }
    ).drop("event_type", "value", "k")


_TICKS = """SELECT monitor_id, t, event_id, CASE WHEN event_type = 'click' THEN value / 100 WHEN k % 2 = 0 THEN value / 50 + 0.1 END AS d_chair, CASE WHEN event_type = 'view' THEN value / 100 WHEN k % 3 = 0 THEN value / 45 + 0.1 END AS d_bed, CASE WHEN event_type = 'purchase' THEN value / 100 WHEN k % 2 = 0 THEN value / 40 + 0.1 END AS d_room,
  event_type <> 'signup' AS loc, CASE event_type WHEN 'click' THEN 'chair' WHEN 'view' THEN 'bed' WHEN 'purchase' THEN 'room' ELSE 'no_patient' END AS state, CASE WHEN k >= 70 THEN k / 100 ELSE 0 END AS iou, CASE k % 4 WHEN 0 THEN 'sitting' WHEN 1 THEN 'standing' WHEN 2 THEN 'lying' END AS posture, k % 4 <> 3 AS posed,
  (k % 4 = 0 AND k > 0)::INT AS sc_sitting, (k % 4 = 1)::INT AS sc_standing, (k % 4 = 2)::INT AS sc_lying, CASE WHEN k > 1 THEN k / 100 ELSE k END AS nudge_score, CASE WHEN k % 2 = 0 THEN value / 2000 END AS motion, CASE WHEN k % 3 = 0 THEN k / 100 END AS in_bed_score, CASE WHEN k % 5 <> 0 THEN (k % 2) / 2 END AS n_patient, 0 AS n_staff, (k % 3) / 8 AS n_other, (k % 5) / 4 AS n_bed, (k % 7) / 8 AS n_chair,
  (k % 10) / 21 AS raw_chair, (k // 10) / 23 AS raw_bed, 0.1 AS raw_room, 0.9 - (k % 10) / 21 - (k // 10) / 23 AS raw_no_patient, (k % 9) / 12 AS visible_prob, (k % 8) / 8 AS visibility_ratio, (k % 7) / 8 AS not_visible_prob, (k % 6) / 7 AS out_of_room_prob, k % 4 AS signal_count
  FROM (SELECT *, epoch_us(ts) // 3600000000 AS t FROM ev WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY monitor_id, epoch_us(ts) // 3600000000 ORDER BY event_id DESC) = 1)"""
_HIST = """SELECT x.monitor_id, x.t AS scored, y.t - x.t AS o, y.* EXCLUDE (monitor_id) FROM tk x JOIN tk y ON x.monitor_id = y.monitor_id AND y.t BETWEEN x.t - 180 AND x.t - 1"""
_LAGS = ", ".join(f"CASE WHEN o >= -60 AND loc THEN (d_{s} - lag(d_{s}) OVER h) / (o - lag(o) OVER h) END AS v_{s}" for s in VISIBLE)


def _history_columns() -> str:
    out = ["count(*) FILTER (posed) AS posture_frames", "count(*) FILTER (switched) AS posture_switches", "(-max(o) FILTER (loc))::DOUBLE AS last_visible_gap", "max(iou) FILTER (o >= -60) AS tail_overlap_max"] + [f"avg(v_{s}) AS velocity_{s}" for s in VISIBLE]
    out += [f"max({c}) FILTER (o >= -60) AS tail_{c}_max" for c in ("nudge_score", "motion", "in_bed_score")]
    for n, on in (("anchor", "o < -60"), ("tail", "o >= -60")):
        out += [f"count(*) FILTER ({on} AND loc) AS {n}_frames", f"count(*) FILTER ({on} AND posed) AS {n}_posture_frames", f"avg(d_bed - d_room) FILTER ({on} AND loc) AS {n}_room_bed_margin", f"avg((state = 'room')::INT) FILTER ({on}) AS {n}_share_room"]
        out += [f"coalesce(sum(power(2, o / 45) / greatest(d_{s}, 1e-6)) FILTER ({on} AND loc AND d_{s} IS NOT NULL), 0) + 0.25 * coalesce(avg((state = '{s}')::INT) FILTER ({on} AND loc), 0) AS {n}_q0_{s}" for s in VISIBLE]
        out += [f"avg(coalesce(d_{s} <= least(d_chair, d_bed, d_room) AND d_chair + d_bed + d_room IS NOT NULL, false)::INT) FILTER ({on} AND loc) AS {n}_nearest_{s}" for s in ("room", "bed")]
        out += [f"avg({c}) FILTER ({on}) AS {n}_{c}_mean" for c in _MORE]
        out += [f"coalesce(sum(power(2, o / 45) * sc_{x}) FILTER ({on} AND posed), 0) AS {n}_pw_{x}, count(*) FILTER ({on} AND posture = '{x}') AS {n}_posture_share_{x}" for x in POSTURES]
    return ", ".join(out)


def _seconds() -> Steps:
    st = Steps("tp", "th")
    st.norm("base", **{s: f"raw_{s}" for s in STATES})
    st.visible("ow", "base")
    st.visible("pi", "base")
    for n in ("anchor", "tail"):
        st.norm(f"{n}_pr", VISIBLE, **{s: f"{n}_q0_{s}" for s in VISIBLE})
        st.norm(f"{n}_posture", POSTURES, **{x: f"{n}_pw_{x}" for x in POSTURES})
        st.add(**{f"{n}_label": f"CASE WHEN {most(f'{n}_pr')} >= 0.40 THEN {first(f'{n}_pr', VISIBLE)} ELSE 'none' END"}, **{f"{n}_{s}": f"{n}_pr_{s}" for s in VISIBLE})
    st.add(base_label=first("raw"), fa="anchor_frames", ft="tail_frames", departure_detected="greatest(tail_room, coalesce(tail_share_room, 0), coalesce(tail_overlap_max, 0), coalesce(tail_nudge_score_max, 0)) >= 0.35 AND coalesce(tail_share_room, 0) >= 0.10", room_bed_margin_delta="tail_room_bed_margin - anchor_room_bed_margin")
    st.add(aw=_weight("anchor_label <> 'none' AND tail_label <> 'none' AND anchor_label <> tail_label"), prob_not_visible="NULL::DOUBLE", prob_out_of_room="NULL::DOUBLE", out_of_room_share="NULL::DOUBLE", own_frames="0")
    _third_steps(st, windowed=False)
    return st


_SECONDS = _seconds()
TICKS = {
    "tk": _TICKS, "hi": _HIST, "hs": f"SELECT *, {_LAGS}, posture <> lag(posture) OVER h AS switched FROM hi WINDOW h AS (PARTITION BY monitor_id, scored ORDER BY o)",
    "hp": f"SELECT monitor_id, scored, {_history_columns()} FROM hs GROUP BY monitor_id, scored",
    "tp": "SELECT tk.monitor_id, tk.t, raw_chair, raw_bed, raw_room, raw_no_patient, visible_prob, visibility_ratio, not_visible_prob, out_of_room_prob, signal_count, hp.* EXCLUDE (monitor_id, scored) FROM tk JOIN hp ON tk.monitor_id = hp.monitor_id AND tk.t = hp.scored",
} | _SECONDS.ctes
#: Hours of a bin, and of a bucket of running sums.
GRAIN, BUCKET = BINS.grain_s // TICK, 8 * BINS.grain_s // TICK


@query("b58_second_states", sql(f"SELECT monitor_id, t, {', '.join(f'round(f_{s} + 3e-8, 6) AS prob_{s}' for s in STATES)} FROM {_SECONDS.last}", **TICKS))
def b58_seconds(spark, d):
    p = S.second_states(tick_signals(spark, d), ["monitor_id"], BUCKET)
    return p.select("monitor_id", "t", *[F.round(F.col("probs")[s] + 3e-8, 6).alias(f"prob_{s}") for s in STATES])


@query("b58_hourly_state_table", sql(f"""SELECT monitor_id, t // {GRAIN} * {GRAIN} AS start, count(*) AS scored, {', '.join(f'round(avg(f_{s}) + 3e-8, 6) AS {c}' for s, c in (('chair', 'pct_chair'), ('bed', 'pct_bed'), ('room', 'pct_ambulatory'), ('no_patient', 'pct_not_located')))} FROM {_SECONDS.last} GROUP BY ALL""", **TICKS))
def b58(spark, d):
    g = S.hourly_state_table(tick_signals(spark, d), ["monitor_id"], GRAIN, BUCKET)
    return g.select("monitor_id", "start", "scored", *[F.round(F.col(c) + 3e-8, 6).alias(c) for c in ("pct_chair", "pct_bed", "pct_ambulatory", "pct_not_located")])
