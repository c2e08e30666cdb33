"""Rate models: Poisson and negative binomial regressions of any number of scenarios at once, one job a step.

A cell's design row is sparse: the intercept, the chair state, and one level of each factor but its first. A step sends
every scenario's coefficients to its cells (a broadcast table of scenarios x coefficients numbers), and sums the outer
products of the rows' few entries by scenario and pair of coefficients: partial sums in every task, one shuffle, and
sums of fixed size on the driver, which solves all scenarios' normal equations. Scenarios that have converged drop out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.config import DEFAULT
from tideline.operators import rates as R
from tideline.sources.staging import stage

FACTORS = ("division_id", "daypart", "day_of_week", "calendar_quarter")
#: A deviance per degree of freedom over this calls for the negative binomial refit (fixed value).
OVERDISPERSED = 1.5
RESULT = "label string, rr double, ci_lower double, ci_upper double, p_value double, n_events double, exposure_hours double, family string, se_type string, deviance_df double, pearson_df double, iterations int, notes string"
COVARIATES = "label string, covariate string, coef double, se double, rr double, ci_lower double, ci_upper double, p_value double"


class Fits:
    """Fits of all scenarios of a cells frame (scenario, FACTORS, position, exposure_hours, fall_count)."""

    def __init__(self, cells: DataFrame, family: str = "poisson", alpha: float = 1.0, steps: int = 100, tolerance: float = 1e-8):
        self.spark, self.family, self.alpha = cells.sparkSession, family, alpha
        c = cells.select("scenario", "position", F.greatest("exposure_hours", F.lit(DEFAULT.exposure_floor)).alias("h"), F.col("fall_count").cast("double").alias("y"), *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in FACTORS])
        self.totals = {r.scenario: r for r in c.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("h").alias("h"), *[F.sum(F.when(F.col("position") == s, F.col(x))).alias(f"{x}_{s}") for s in ("chair", "bed") for x in "yh"]).collect()}
        levels = c.select("scenario", F.explode(F.array(*FACTORS)).alias("level")).distinct().collect()  # scenarios x (divisions, dayparts, days, quarters)
        self.names: dict[str, list[str]] = {}
        for s in self.totals:
            mine = sorted(r.level for r in levels if r.scenario == s)
            first = {min(x for x in mine if x.startswith(f"{f}=")) for f in FACTORS}
            self.names[s] = ["Intercept", "position=chair", *[x for x in mine if x not in first]]
        self.fitted = [s for s, t in self.totals.items() if min(t.y_chair or 0.0, t.y_bed or 0.0) >= DEFAULT.min_events_per_state]
        place = self.spark.createDataFrame([(s, {x: i for i, x in enumerate(self.names[s])}) for s in self.fitted] or [("", {})], "scenario string, places map<string,int>")
        active = F.array_compact(F.array(F.lit(0), F.when(F.col("position") == "chair", 1), *[F.try_element_at("places", F.col(f)) for f in FACTORS]))
        self.rows = c.join(F.broadcast(place), "scenario").select("scenario", "division_id", "h", "y", active.alias("x"))
        self.beta = {s: np.concatenate([[math.log(max(self.totals[s].y, 1e-6) / self.totals[s].h)], np.zeros(len(self.names[s]) - 1)]) for s in self.fitted}
        self.deviance: dict[str, float] = {}
        self.iterations = dict.fromkeys(self.fitted, 0)
        self._fit(steps, tolerance)

    def _at(self, scenarios: list[str], **more: dict) -> DataFrame:
        """The cells of some scenarios with their mean mu at the current coefficients, and other arrays by scenario."""
        kinds = ", ".join(f"{n} array<double>" for n in more)
        table = self.spark.createDataFrame([(s, self.beta[s].tolist(), *[m[s] for m in more.values()]) for s in scenarios], f"scenario string, beta array<double>{', ' + kinds if kinds else ''}")
        eta = F.aggregate("x", F.log("h"), lambda acc, i: acc + F.get("beta", i))
        return self.rows.join(F.broadcast(table), "scenario").withColumn("mu", F.exp(F.least(eta, F.lit(700.0))))

    def _sums(self, rows: DataFrame, weight: Column, score: Column, extra: dict[str, Column] | None = None):
        """By scenario: the summed outer products of the design rows times weight, their sums times score, and other sums."""
        p = F.flatten(F.transform("x", lambda i: F.transform(F.filter("x", lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j"), F.col("_w").alias("v")))))
        g = F.transform("x", lambda i: F.struct(F.lit(-1).alias("i"), i.alias("j"), F.col("_s").alias("v")))
        more = [F.struct(F.lit(-2).alias("i"), F.lit(k).alias("j"), F.coalesce(c, F.lit(0.0)).alias("v")) for k, c in enumerate((extra or {}).values())]
        each = F.concat(p, g, F.array(*more)) if more else F.concat(p, g)
        out = rows.withColumn("_w", weight).withColumn("_s", score).select("scenario", F.inline(each)).groupBy("scenario", "i", "j").agg(F.sum("v").alias("v"))
        gram, grad, sums = {}, {}, {}
        for r in out.collect():
            n = len(self.names[r.scenario])
            a = gram.setdefault(r.scenario, np.zeros((n, n)))
            if r.i >= 0:
                a[r.i, r.j] = a[r.j, r.i] = r.v
            elif r.i == -1:
                grad.setdefault(r.scenario, np.zeros(n))[r.j] = r.v
            else:
                sums.setdefault(r.scenario, {})[list(extra)[r.j]] = r.v
        return gram, grad, sums

    def _parts(self) -> tuple[Column, Column, dict[str, Column]]:
        """Weight and score of a step, and each cell's deviance and squared Pearson residual."""
        y, mu = F.col("y"), F.col("mu")
        if self.family == "poisson":
            own = 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))
            return mu, y - mu, {"deviance": own, "pearson": (y - mu) ** 2 / F.greatest(mu, F.lit(1e-12))}
        a = self.alpha
        own = 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y + 1 / a) * (F.log1p(a * y) - F.log1p(a * mu)))
        return mu / (1 + a * mu), (y - mu) / (1 + a * mu), {"deviance": own, "pearson": (y - mu) ** 2 / (mu * (1 + a * mu))}

    def _fit(self, steps: int, tolerance: float) -> None:
        open_ = list(self.fitted)
        self.gram, self.pearson = {}, {}
        for _ in range(steps):
            if not open_:
                return
            gram, grad, sums = self._sums(self._at(open_), *self._parts())
            still = []
            for s in open_:
                before, now = self.deviance.get(s), sums[s]["deviance"]
                self.gram[s], self.deviance[s], self.pearson[s] = gram[s], now, sums[s]["pearson"]
                if before is None or abs(before - now) > tolerance:
                    self.beta[s] = self.beta[s] + np.clip(np.linalg.pinv(gram[s], rcond=1e-12) @ grad[s], -5, 5)
                    self.iterations[s] += 1
                    still.append(s)
            open_ = still

    def covariance(self, se_type: str = "default") -> dict[str, np.ndarray]:
        """The coefficients' covariance: the inverse information, or a sandwich of it (hc3: residuals over 1 - leverage; cluster: scores summed by division)."""
        inverse = {s: np.linalg.pinv(self.gram[s], rcond=1e-12) for s in self.fitted}
        if se_type == "default" or not self.fitted:
            return inverse
        weight, score, _ = self._parts()
        if se_type == "hc3":
            n = F.sqrt(F.size("inverse"))
            rows = self._at(self.fitted, inverse={s: m.ravel().tolist() for s, m in inverse.items()})
            quad = F.aggregate("x", F.lit(0.0), lambda acc, i: acc + F.aggregate("x", F.lit(0.0), lambda b, j: b + F.get("inverse", (i * n + j).cast("int"))))
            rows = rows.withColumn("_h", F.least(weight * quad, F.lit(0.999999)))
            meat, _, _ = self._sums(rows, (score / (1 - F.col("_h"))) ** 2, F.lit(0.0))
            return {s: inverse[s] @ meat[s] @ inverse[s] for s in self.fitted}
        rows = self._at(self.fitted).withColumn("_s", score).select("scenario", "division_id", F.explode("x").alias("i"), "_s")
        summed = rows.groupBy("scenario", "division_id", "i").agg(F.sum("_s").alias("s"))
        by_division = summed.groupBy("scenario", "division_id").agg(F.collect_list(F.struct("i", "s")).alias("g"))  # one entry a coefficient
        pairs = F.flatten(F.transform("g", lambda a: F.transform("g", lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["s"] * b["s"]).alias("v")))))
        meat = {s: np.zeros_like(inverse[s]) for s in self.fitted}
        for r in by_division.select("scenario", F.inline(pairs)).groupBy("scenario", "i", "j").agg(F.sum("v").alias("v")).collect():
            meat[r.scenario][r.i, r.j] = r.v
        groups = {r.scenario: r.n for r in self.rows.groupBy("scenario").agg(F.count_distinct("division_id").alias("n")).collect()}
        return {s: inverse[s] @ meat[s] @ inverse[s] * (groups[s] / (groups[s] - 1) if groups[s] > 1 else 1.0) for s in self.fitted}

    def ratios(self, se_type: str = "default", label: str = "{}") -> DataFrame:
        """One row a scenario: the rate ratio of chair to bed with its interval; scenarios of under five events in either state have none."""
        cov, out = self.covariance(se_type), []
        for s, t in self.totals.items():
            head, n = label.format(s), float(t.y or 0.0)
            if s not in self.fitted:
                out.append((head, None, None, None, None, n, float(t.h_chair or 0.0), self.family, se_type, None, None, 0, "insufficient_data"))
                continue
            b, free = float(self.beta[s][1]), t.n - int(np.linalg.matrix_rank(self.gram[s], hermitian=True))
            rr, low, high, p = _interval(b, cov[s][1, 1])
            out.append((head, rr, low, high, p, n, float(t.h_chair), self.family, se_type, self.deviance[s] / free if free > 0 else None, self.pearson[s] / free if free > 0 else None, self.iterations[s], ""))
        return self.spark.createDataFrame(out, RESULT)

    def covariates(self) -> DataFrame:
        """Every scenario's coefficients with standard errors, intervals and p-values."""
        cov = self.covariance()
        rows = [(s, x, float(b), math.sqrt(max(v, 0.0)), *_interval(float(b), v)) for s in self.fitted for x, b, v in zip(self.names[s], self.beta[s], np.diag(cov[s]), strict=True)]
        return self.spark.createDataFrame(rows, COVARIATES)


def _interval(b: float, variance: float) -> tuple[float, float, float, float | None]:
    """Ratio, lower and upper end of its 95 % interval, and the two-sided p-value."""
    se = math.sqrt(max(float(variance), 0.0))
    e = lambda x: math.exp(max(min(x, 700.0), -700.0))
    return e(b), e(b - 1.96 * se), e(b + 1.96 * se), math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else None


def _one(cells: DataFrame, label: str) -> DataFrame:
    return cells.withColumn("scenario", F.lit(label))


def fit_rate_model(cells: DataFrame, label: str, se_type: str = "default") -> DataFrame:
    """One row: the rate ratio of chair to bed with its interval; refused under five events in either state."""
    return Fits(_one(cells, label)).ratios(se_type)


def negative_binomial(cells: DataFrame, label: str = "negative_binomial", alpha: float = 1.0) -> DataFrame:
    """The rate ratio of the negative binomial model of fixed dispersion."""
    return Fits(_one(cells, label), "negative_binomial", alpha).ratios()


def covariate_table(cells: DataFrame, label: str = "primary") -> DataFrame:
    """Coefficient, standard error, ratio, interval and p-value of every covariate of the Poisson model."""
    return Fits(_one(cells, label)).covariates()


def overdispersed(fits: Fits, scenario: str) -> bool:
    if scenario not in fits.fitted:
        return False
    free = fits.totals[scenario].n - int(np.linalg.matrix_rank(fits.gram[scenario], hermitian=True))
    return free > 0 and fits.deviance[scenario] / free > OVERDISPERSED


def robust_models(cells: DataFrame, label: str = "primary_adjusted") -> DataFrame:
    """The model with default, HC3 and clustered errors, and its negative binomial refit where it is overdispersed."""
    rows = stage(_one(cells, label), "cells")
    fits = Fits(rows)
    out = fits.ratios().unionByName(fits.ratios("hc3", "{}_hc3")).unionByName(fits.ratios("cluster", "{}_clustered"))
    return out.unionByName(Fits(rows, "negative_binomial").ratios(label="{}_negative_binomial")) if overdispersed(fits, label) else out


def subset_models(base: DataFrame) -> DataFrame:
    """The model refitted on every subset of the sensitivity analysis, all at once."""
    tagged = base.withColumn("scenario", F.explode(R.subset_of()))
    return Fits(stage(R.position_cells(tagged, keys=("scenario",)), "subsets")).ratios()


def misclassification_models(cells: DataFrame, scenarios=R.SWAPS) -> DataFrame:
    """The model refitted on the cells of every misclassification scenario, with the scenario's rates."""
    rates = cells.sparkSession.createDataFrame(list(scenarios), "label string, chair_to_bed_rate double, bed_to_chair_rate double")
    return Fits(stage(R.misclassification_swap(cells, scenarios), "swaps")).ratios().join(F.broadcast(rates), "label")


def adjusted_ratios(base: DataFrame, flagged: DataFrame) -> DataFrame:
    """The primary model, its robust errors, its refits on all subsets and on the hours reclassified by origin, and the ambulatory state's crude rate.

    The Poisson fits of all scenarios share every step's job.
    """
    whole = base.withColumn("scenario", F.explode(F.array_append(R.subset_of(), F.lit("primary_adjusted"))))
    moved = _one(R.origin_reclassify(base, flagged), "furniture_origin_reclassified")
    rows = stage(R.position_cells(whole.unionByName(moved), keys=("scenario",)), "scenarios")
    fits = Fits(rows)
    out = fits.ratios()
    for kind, name in (("hc3", "hc3"), ("cluster", "clustered")):
        out = out.unionByName(fits.ratios(kind, f"{{}}_{name}").filter(F.col("label") == f"primary_adjusted_{name}"))
    if overdispersed(fits, "primary_adjusted"):
        out = out.unionByName(Fits(rows.filter("scenario = 'primary_adjusted'"), "negative_binomial").ratios(label="{}_negative_binomial"))
    third = R.third_state_rate(base)
    note = F.format_string("unadjusted_rate_per_1000h=%.4f", "rate_per_1000")
    plain = {"label": F.lit("exploratory_unadjusted"), "n_events": F.col("n_events"), "exposure_hours": F.col("exposure_hours"), "family": F.lit("unadjusted"), "se_type": F.lit("na"), "notes": note}
    return out.unionByName(third.select(*[plain.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in out.schema]))


def threshold_sensitivity(make_base, thresholds: tuple[int, ...] = DEFAULT.min_hours_sweep) -> DataFrame:
    """The model refitted at each minimum of observed hours, all at once; make_base gives (eligibility, base) for a minimum."""
    cells = counts = None
    for t in thresholds:
        elig, base = make_base(t)
        label = F.lit(f"min_observed_hours_{t}")
        n = elig.agg(F.count_if("eligible").alias("eligible_units")).crossJoin(base.agg(F.count(F.lit(1)).alias("analysis_rows"))).select(label.alias("label"), F.lit(t).alias("threshold_hours"), "*")
        c = R.position_cells(base).withColumn("scenario", label)
        cells, counts = (c, n) if cells is None else (cells.unionByName(c), counts.unionByName(n))
    return Fits(stage(cells, "thresholds")).ratios().join(F.broadcast(counts), "label")
