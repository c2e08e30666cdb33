import pytest
from pyspark.sql import functions as F

from tideline.functions import probs as P
from tideline.operators import scorer as S
from tideline.operators import windows as W

FRAME = "anchor_id long, event_id long, offset long, d_chair double, d_bed double, d_room double, staff_iou double, state string, nudge_score double, posture string, score_sitting double, score_standing double, score_lying double, has_location boolean, has_posture boolean"


def scored(spark, prior, frames=(), label=None):
    windows = spark.createDataFrame([(1, label, *map(float, prior))], "anchor_id long, label string, prob_chair double, prob_bed double, prob_room double, prob_no_patient double")
    rows = [(1, i, o, c, b, r, iou, s, nudge / 100, None, None, None, None, True, False) for i, (o, c, b, r, iou, s, nudge) in enumerate(frames)]
    return S.score_v2(windows, S.panel_summary(spark.createDataFrame(rows, FRAME))).first()


def test_no_signal_and_a_sure_prior(spark):
    r = scored(spark, (0, 0, 0, 1))
    assert (r.label, r.reason, r.prob_no_patient) == ("no_patient", "zero_signal_default", 1.0)
    r = scored(spark, (0.05, 0.90, 0.0, 0.05))
    assert (r.label, r.reason) == ("bed", "sparse_panel_sql_fallback") and r.prob_no_patient == pytest.approx(0.10)
    assert r.prob_bed == pytest.approx(0.9 * 0.90 / 0.95)


def test_a_recent_tail_overrides_a_stale_prior(spark):
    r = scored(spark, (0, 0, 0, 1), [(-50, 0.2, 1.2, 2.0, 0.0, "chair", 0.0), (-30, 0.25, 1.0, 2.0, 0.0, "chair", 0.0), (-10, 0.3, 0.9, 2.0, 0.0, "chair", 0.0)])
    assert (r.label, r.reason) == ("chair", "recent_visible_fallback") and r.prob_no_patient < 0.5


def test_overlap_and_nudges_are_evidence_of_the_room(spark):
    frames = [(-150, 1.5, 0.3, 1.6, 0.0, "bed", 0.0), (-110, 1.8, 0.4, 1.7, 0.0, "bed", 5.0), (-40, 2.4, 1.6, 0.4, 0.22, "room", 60.0), (-10, 2.8, 2.0, 0.3, 0.35, "room", 100.0)]
    r = scored(spark, (0.10, 0.75, 0.10, 0.05), frames)
    assert (r.label, r.reason, r.departure_detected) == ("room", "room_recovery_v2", True) and r.prob_room > r.prob_bed
    assert r.prob_chair + r.prob_bed + r.prob_room + r.prob_no_patient == pytest.approx(1)
    ordered = sorted((r.prob_chair, r.prob_bed, r.prob_room, r.prob_no_patient), reverse=True)
    assert r.margin == pytest.approx(ordered[0] - ordered[1])


def test_support_and_confidence_are_bounded(spark):
    frames = [(-150, 1.5, 0.3, 1.6, 0.0, "bed", 0.0), (-10, 2.8, 2.0, 0.3, 0.35, "room", 100.0)]
    rows = [(1, i, o, c, b, r, iou, s, nudge / 100, None, None, None, None, True, False) for i, (o, c, b, r, iou, s, nudge) in enumerate(frames)]
    s = S.panel_summary(spark.createDataFrame(rows, FRAME))
    f = {c: s[c] for c in s.columns}
    got = s.select(P.departure_confidence(f).alias("d"), *[c.alias(n) for n, c in P.presence_support(f).items()]).first()
    margin = (2.0 - 0.3) - (0.3 - 1.6)
    assert got.d == pytest.approx(0.40 + 0.25 + 0.20 + 0.10 * margin / (margin + 0.05) + 0.03 + 0.02)
    assert got.room == 1.0 and got.presence == 0.0 and got.bed < 0.3


def test_controls_are_the_nearest_of_the_best_tier(spark):
    """Against all pairs, with ties in time, anchors of no chunk's hour, and a division without chunks."""
    import random

    rng = random.Random(5)
    anchors = [(i, i % 3, 1_700_000_000 + rng.randrange(40) * 3600) for i in range(60)]
    chunks = [(100 + i, i % 2, 900 + i, 1_700_000_000 + rng.randrange(30) * 3600 * (1 if i % 2 else 5)) for i in range(50)]
    at = lambda c: F.timestamp_seconds(c)
    a = spark.createDataFrame(anchors, "anchor_id long, division_id long, s long").withColumn("anchor_ts", at("s"))
    c = spark.createDataFrame(chunks, "chunk_id long, division_id long, monitor_id long, s long").withColumn("anchor_ts", at("s"))
    c = c.withColumn("anchor_hour", F.hour("anchor_ts")).withColumn("anchor_daypart", W.timefn.daypart(F.hour("anchor_ts")))
    got = {}
    for r in W.match_controls(a, c, a.select(F.lit(905).cast("long").alias("monitor_id")), "UTC", 3).collect():
        got.setdefault(r.anchor_id, []).append((r["rank"], r.chunk_id, r.tier, r.candidates))
    part = lambda h: 0 if h <= 5 else h // 3
    for i, div, s in anchors:
        h = s // 3600 % 24
        tiers = [[], [], []]
        for k, d, m, t in chunks:
            if d == div and m != 905:
                g = t // 3600 % 24
                tiers[0 if g == h else 1 if part(g) == part(h) else 2].append((abs(t - s), k))
        n = next((j for j in range(3) if tiers[j]), None)
        if n is None:
            assert i not in got
            continue
        best = sorted(sum(tiers[: n + 1], []))
        assert sorted(got[i]) == [(j + 1, k, n + 1, len(best)) for j, (_, k) in enumerate(best[:3])]


def test_third_scorer(spark):
    """Fixed values of three windows: one whose own evidence is all there is, a walk from the bed into the room, and a near tie with a lying posture."""
    evidence = dict.fromkeys(("visible_prob", "not_visible_prob", "out_of_room_prob", "visibility_ratio", "prob_not_visible", "prob_out_of_room", "signal_count", *[f"{k}_{s}" for k in ("focus", "cond") for s in P.VISIBLE]))
    known = dict(zip(evidence, (0.85, 0.1, 0.05, 0.7, 0.1, 0.05, 18.0, 0.7, 0.2, 0.1, 0.65, 0.2, 0.15), strict=True))
    priors = {1: (0.0, 0.0, 0.0, 1.0), 2: (0.05, 0.75, 0.05, 0.15), 3: (0.45, 0.40, 0.10, 0.05)}
    schema = "anchor_id long, label string, prob_chair double, prob_bed double, prob_room double, prob_no_patient double, " + ", ".join(f"{c} double" for c in evidence)
    windows = spark.createDataFrame([(i, None, *p, *(known if i == 1 else evidence).values()) for i, p in priors.items()], schema)
    bed = (0.35, 0.38, 0.42, 0.46, 0.5, 0.55, 0.7, 0.75, 0.8, 0.85, 0.95, 1.1)
    room = (1.8, 1.75, 0.95, 0.9, 0.8, 0.76, 0.68, 0.64, 0.6, 0.55, 0.5, 0.45)
    overlap = (0.0, 0.0, 0.08, 0.08, 0.08, 0.08, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1)
    rows = [(2, o, o, 2.0, b, r, x, "room" if o == -4 else "bed", 40.0 if o == -4 else 0.0, None, None, None, None, True, False) for o, b, r, x in zip((-170, -140, *range(-58, -3, 6)), bed, room, overlap, strict=True)]
    rows += [(3, o, o, c, 0.7, 2.0, 0.0, s, 0.0, "lying", 0.05, 0.05, 0.9, True, True) for o, c, s in ((-150, 0.8, "chair"), (-120, 0.8, "chair"), (-90, 0.8, "chair"), (-60, 0.9, "bed"), (-30, 0.9, "bed"), (-10, 1.0, "bed"))]
    got = {r.anchor_id: r for r in S.score_v3(windows, S.panel_summary(spark.createDataFrame(rows, FRAME), digits=6)).collect()}
    probs = {i: (r.prob_chair, r.prob_bed, r.prob_room, r.prob_no_patient) for i, r in got.items()}
    assert probs[1] == pytest.approx((0.443182, 0.13, 0.076818, 0.35), abs=1e-6)
    assert probs[2] == pytest.approx((0.058602, 0.261861, 0.612037, 0.0675), abs=1e-6)
    assert probs[3] == pytest.approx((0.204857, 0.632399, 0.112744, 0.05), abs=1e-6)
    assert [(got[i].label, got[i].reason, got[i].signal_regime, got[i].v2_reason) for i in (1, 2, 3)] == [
        ("chair", "sparse_signal_carry_forward_v3", "visible", "zero_signal_default"),
        ("room", "room_departure_recovery_v3", "temporarily_not_visible", "room_recovery_v2"),
        ("bed", "posture_state_collapse_v3", "present_but_sparse", "direct_focus_argmax"),
    ]
    assert got[1].carry_forward_used and got[1].signal_profile.startswith("anchor=<NA>;tail=<NA>;gap=;anchor_weight=1.0;room_tail=0.0;") and got[1].signal_profile.endswith("posture_gate=room_or_no_patient_evidence;posture_switch=0.0")
    assert (got[2].v2_prob_chair, got[2].v2_prob_bed, got[2].v2_prob_room) == pytest.approx((0.074018, 0.41599, 0.359992), abs=1e-6)
    assert got[2].departure_confidence == pytest.approx(0.720062, abs=1e-6) and got[2].departure_detected
    assert got[3].posture_gate == "applied" and got[3].posture_applied and got[3].v2_prob_bed == pytest.approx(0.45271, abs=1e-6)


def test_departures_need_a_tenth_of_the_tail_and_one_strong_sign(spark):
    tails = {1: ((3, 0.0, 0.0), True), 2: ((1, 0.0, 0.0), False), 3: ((1, 0.4, 0.0), True), 4: ((1, 0.0, 40.0), True), 5: ((0, 0.9, 90.0), False)}
    rows = []
    for a, ((in_room, overlap, nudge), _) in tails.items():
        rows.append((a, 0, -100, 1.0, 0.2, 3.0, 0.0, "bed", 0.0, None, None, None, None, True, False))
        rows += [(a, 1 + i, -50 + 5 * i, 1.0, 0.001, 9.0, overlap, "room" if i < in_room else "bed", nudge, None, None, None, None, True, False) for i in range(8)]
    got = {r.anchor_id: r.departure_detected for r in S.panel_summary(spark.createDataFrame(rows, FRAME)).collect()}
    assert got == {a: want for a, (_, want) in tails.items()}


def test_evaluation_scorer_falls_back_in_order(spark):
    cases = {
        1: ((0.1, 0.1, 0.0, 0.8), 0, []), 2: ((0.0, 0.0, 0.0, 1.0), 0, [(-20, "chair"), (-10, "chair")]), 3: ((0.0, 0.0, 0.0, 1.0), 0, [(-150, "bed"), (-140, "bed")]),
        4: ((0.5, 0.2, 0.1, 0.2), 2, [(-150, "bed")]), 5: ((0.1, 0.1, 0.0, 0.8), 2, [(-50, "bed")]), 6: ((0.6, 0.2, 0.0, 0.2), 2, [(-150, "room"), (-149, "bed")]),
    }
    windows = spark.createDataFrame([(i, *p, f, 0.0, None) for i, (p, f, _) in cases.items()], "anchor_id long, prob_chair double, prob_bed double, prob_room double, prob_no_patient double, focus_visible_frames int, visible_prob double, last_visible_gap_seconds double")
    rows = [(i, o, o, *[0.1 if s == x else 5.0 for x in P.VISIBLE], 0.0, s, 0.0, None, None, None, None, True, False) for i, (_, _, frames) in cases.items() for o, s in frames]
    got = {r.anchor_id: r for r in S.score_evaluation(windows, S.evaluation_summary(spark.createDataFrame(rows, FRAME))).collect()}
    assert {i: (r.label, r.reason) for i, r in got.items()} == {
        1: ("no_patient", "zero_signal_default"), 2: ("chair", "recent_visible_fallback"), 3: ("no_patient", "recent_visible_fallback"), 4: ("chair", "direct_focus_argmax"), 5: ("bed", "recent_visible_fallback"), 6: ("chair", "room_recovery_v2"),
    }
    assert got[2].prob_no_patient < 0.15 and got[3].prob_no_patient == pytest.approx(0.5)
    assert got[6].prob_room == pytest.approx(0.25) and got[6].prob_chair == pytest.approx(0.35)


def test_second_states_do_not_depend_on_the_buckets(spark):
    import random

    rng, rows, t = random.Random(11), [], {1: 0, 2: 5}
    for i in range(500):
        unit = rng.choice((1, 2))
        t[unit] += rng.choice((1, 1, 2, 7, 40, 130, 170, 250))
        d = [rng.choice((None, rng.random() * 3)) for _ in range(3)]
        seen = any(x is not None for x in d)
        state = min((x, s) for x, s in zip(d, P.VISIBLE, strict=True) if x is not None)[1] if seen else "no_patient"
        base = [rng.random() for _ in range(4)]
        rows.append((unit, t[unit], *d, seen, state, rng.random() / 2, rng.choice((None, "lying", "sitting")), *[rng.random() for _ in range(3)], *base, rng.random(), rng.random() * 3, rng.choice((None, rng.random()))))
    schema = "unit int, t long, d_chair double, d_bed double, d_room double, has_location boolean, state string, staff_iou double, posture string, score_sitting double, score_standing double, score_lying double, base_chair double, base_bed double, base_room double, base_no_patient double, visibility_ratio double, n_patient double, in_bed_score double"
    df = spark.createDataFrame(rows, schema)
    got = {}
    for bucket in (50, 1 << 12):
        for r in S.second_states(df, ["unit"], bucket).collect():
            got.setdefault((r.unit, r.t), []).append(tuple(r.probs))
    history = {(u, x) for u, x, *_ in rows if any(v == u and x - 180 <= y < x for v, y, *_ in rows)}
    assert set(got) == history
    for found in got.values():
        assert len(found) == 2 and sum(found[0]) == pytest.approx(1) and found[1] == pytest.approx(found[0], abs=1e-9)
