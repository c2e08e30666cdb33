"""Queries over probability structs and rate models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import probs as P
from tideline.operators import cohort as C
from tideline.operators import models as M
from tideline.operators import rates as R
from tideline.plans import quality_queries as QQ
from tideline.plans.standins import BINS, Study, sql
from tideline.sources.staging import stage

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


@query("b46_normalize_probs", sql("SELECT event_id, CASE WHEN t > 0 THEN a / t ELSE 0 END AS chair, CASE WHEN t > 0 THEN b / t ELSE 0 END AS bed, CASE WHEN t > 0 THEN c / t ELSE 0 END AS room, CASE WHEN t > 0 THEN 0 ELSE 1 END AS no_patient FROM (SELECT event_id, greatest(k % 10 - 4, 0)::DOUBLE AS a, greatest(k % 7 - 3, 0)::DOUBLE AS b, greatest(k % 5 - 2, 0)::DOUBLE AS c, a + b + c AS t FROM ev)"))
def b46(spark, d):
    from tideline.plans.standins import events

    raw = {"chair": F.col("k") % 10 - 4, "bed": F.col("k") % 7 - 3, "room": F.col("k") % 5 - 2, "no_patient": F.lit(0)}
    return events(spark, d).select("event_id", P.normalize(raw).alias("p")).select("event_id", "p.chair", "p.bed", "p.room", F.col("p.no_patient").cast("int").alias("no_patient"))


@query("b51_blend_sources", sql("""SELECT event_id, chair / t AS chair, bed / t AS bed, room / t AS room FROM (SELECT event_id, 0.7::DOUBLE * prob_chair / v + CASE WHEN z THEN 0.3::DOUBLE ELSE 0 END AS chair, 0.7::DOUBLE * prob_bed / v AS bed, 0.7::DOUBLE * prob_room / v AS room, chair + bed + room AS t FROM (SELECT *, prob_chair + prob_bed + prob_room AS v, monitor_id % 2 = 0 AS z FROM sc))""", **QQ.SC))
def b51(spark, d):
    one = P.struct({"chair": F.when(F.col("monitor_id") % 2 == 0, 1.0).otherwise(0.0), "bed": F.lit(0.0), "room": F.lit(0.0)})
    own = P.normalize_visible({s: F.col(f"prob_{s}") for s in P.VISIBLE})
    return QQ.scored(spark, d).select("event_id", own.alias("o"), one.alias("z")).select("event_id", P.blend((0.7, F.col("o")), (0.3, F.col("z"))).alias("p")).select("event_id", "p.chair", "p.bed", "p.room")


def cells(spark, d):
    return stage(R.position_cells(Study(spark, d).intervention), "cells")


#: Both states' events and hours in the whole and in every subset; one factor is left, so the model has a closed form.
_TWO = """SELECT label, sum(falls_in_hour * pct_chair / greatest(pct_chair + pct_bed, 1e-9)) AS yc, sum(falls_in_hour * pct_bed / greatest(pct_chair + pct_bed, 1e-9)) AS yb, sum(pct_chair) AS hc, sum(pct_bed) AS hb FROM
  (SELECT *, 'all' AS label FROM treated UNION ALL SELECT *, daypart FROM treated UNION ALL SELECT *, CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 'weekend_only' ELSE 'weekday_only' END FROM treated UNION ALL SELECT *, 'position_certain_only' FROM treated WHERE pct_chair >= 0.5 OR pct_bed >= 0.5) GROUP BY label"""
_RATIO = "CASE WHEN least(yc, yb) >= 5 THEN round({x}, 6) END AS {n}"
_CLOSED = {"rr": "yc / hc / (yb / hb)", "ci_lower": "exp(ln(yc / hc / (yb / hb)) - 1.96 * sqrt(1 / yc + 1 / yb))", "ci_upper": "exp(ln(yc / hc / (yb / hb)) + 1.96 * sqrt(1 / yc + 1 / yb))"}


def two_cells(spark, d):
    """The cells of the whole and of all subsets without the factors of place and time."""
    base = Study(spark, d).intervention.withColumn("scenario", F.explode(F.array_append(R.subset_of(), F.lit("all"))))
    flat = base.withColumns({c: F.lit("all") for c in ("division_id", "daypart", "day_of_week", "calendar_quarter")})
    return stage(R.position_cells(flat, keys=("scenario",)), "two-cells")


@query("b78_two_cell_models", sql(f"SELECT label, {', '.join(_RATIO.format(x=x, n=n) for n, x in _CLOSED.items())}, round(yc + yb, 6) AS n_events, round(hc, 6) AS exposure_hours, CASE WHEN least(yc, yb) >= 5 THEN '' ELSE 'insufficient_data' END AS notes FROM tw", tw=_TWO))
def b78_two(spark, d):
    """The Poisson model where chair and bed alone are told apart, whose ratio and interval SQL can write."""
    r = M.Fits(two_cells(spark, d)).ratios()
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("rr", "ci_lower", "ci_upper", "n_events", "exposure_hours")], "notes")


@query("b81_two_cell_covariates", sql("SELECT label, covariate, round(coef, 6) AS coef, round(se, 6) AS se FROM (SELECT label, 'Intercept' AS covariate, ln(yb / hb) AS coef, sqrt(1 / yb) AS se, yc, yb FROM tw UNION ALL SELECT label, 'position=chair', ln(yc / hc / (yb / hb)), sqrt(1 / yc + 1 / yb), yc, yb FROM tw) WHERE least(yc, yb) >= 5", tw=_TWO))
def b81_two(spark, d):
    c = M.Fits(two_cells(spark, d)).covariates()
    return c.select("label", "covariate", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"))


@query("b80_two_cell_negative_binomial", sql("SELECT label, CASE WHEN least(yc, yb) >= 5 THEN round(yc / hc / (yb / hb), 6) END AS rr, CASE WHEN least(yc, yb) >= 5 THEN round(exp(ln(yc / hc / (yb / hb)) - 1.96 * sqrt((1 + yc) / yc + (1 + yb) / yb)), 6) END AS ci_lower FROM tw", tw=_TWO))
def b80_two(spark, d):
    r = M.Fits(two_cells(spark, d), "negative_binomial").ratios()
    return r.select("label", F.round("rr", 6).alias("rr"), F.round("ci_lower", 6).alias("ci_lower"))


@query("b78_rate_model")
def b78(spark, d):
    return M.fit_rate_model(cells(spark, d), "primary")


@query("b79_robust_errors")
def b79(spark, d):
    return M.robust_models(cells(spark, d))


@query("b80_negative_binomial")
def b80(spark, d):
    return M.negative_binomial(cells(spark, d))


@query("b81_covariate_table")
def b81(spark, d):
    return M.covariate_table(cells(spark, d))


@query("b84_misclassification_models")
def b84_models(spark, d):
    return M.misclassification_models(cells(spark, d))


_SWAPPED = "SELECT s.label, (1 - p) * yc + q * yb AS yc, (1 - q) * yb + p * yc AS yb, hc, hb FROM tw, (VALUES ('symmetric_swap_10pct', 0.1::DOUBLE, 0.1::DOUBLE), ('symmetric_swap_20pct', 0.2, 0.2), ('symmetric_swap_30pct', 0.3, 0.3), ('chair_to_bed_20pct', 0.2, 0), ('bed_to_chair_20pct', 0, 0.2)) s(label, p, q) WHERE tw.label = 'all'"


@query("b84_two_cell_models", sql(f"SELECT label, {', '.join(_RATIO.format(x=x, n=n) for n, x in _CLOSED.items())} FROM sw", tw=_TWO, sw=_SWAPPED))
def b84_two(spark, d):
    r = M.misclassification_models(two_cells(spark, d).filter("scenario = 'all'").drop("scenario"))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("rr", "ci_lower", "ci_upper")])


@query("b86_adjusted_ratios")
def b86_ratios(spark, d):
    """The whole table of the rate models; hours with events whose dropout was mostly visible stand for those of chair origin."""
    s = Study(spark, d)
    return M.adjusted_ratios(s.intervention, s.linked.filter("pre_dropout_visibility_ratio > 0.5").select("monitor_id", "hour_ts"))


@query("b85_threshold_sensitivity")
def b85(spark, d):
    s = Study(spark, d)

    def base(hours):
        elig = stage(C.eligibility(s.hourly_c, hours, BINS), "eligibility")
        return elig, stage(C.analysis_base(s.hourly_c, s.events_c, elig, BINS), "base").filter("cohort_type = 'intervention'")

    return M.threshold_sensitivity(base)


@query("b83_subset_models")
def b83_models(spark, d):
    return M.subset_models(Study(spark, d).intervention)
