"""Mixing sources to target weights by soft membership.

A classifier learnt from a labelled table gives every document posteriors over domains. With t the tokens of a document
and p its posteriors, nonnegative rates w minimise sum over domains of (sum(w t p) - target)^2 / target
+ ridge * sum(t (w - 1)^2), by projected gradient: w = max(0, 1 - p . lam), where lam, one number a domain, collects the
steps. Each step sums the K gradient numbers over all documents in Spark, and the K x K Gram matrix of those whose rate
isn't 0, by which it is scaled (Newton's method on the dual). A rate
depends on the posteriors alone, so one very long text doesn't slow or stop the others. A fit that hasn't reached the
optimum raises an error; targets that no nonnegative rates can meet (all posteriors equal, say) give a warning.

Null and empty texts have no tokens: their rate is 1. Labels that are null in any field, and documents without a label,
don't teach. Documents without an id count like all others; the hash that draws their copies is that of the text, so
that equal texts without an id share a draw. Without labels all posteriors are equal. Repeated rows count each and get
the same rate. A very long text counts with all its words. Columns to keep may have any names but those of the results.
An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, materialize, others, table
from tideline.llm.quality_classifier import STATS, Features, text_stats

DOMAINS = ("clean", "junk", "toxic")
#: Target shares of tokens.
WEIGHTS = {"clean": 0.96, "junk": 0.03, "toxic": 0.01}
_BUCKETS = 1 << 16


def domain_label():
    """Index into DOMAINS of a row of labels."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def buckets(text: bytes) -> list[int]:
    """The hashed lower-case words of a text without punctuation, each once."""
    return list({zlib.crc32(w) % _BUCKETS for w in set(text.lower().translate(None, b".,;:!?").split())})


@dataclass
class DomainModel:
    """Word evidence by domain (naive Bayes over hashed words) beside text statistics, through one logistic fit a domain."""

    evidence: np.ndarray
    features: Features | None
    beta: np.ndarray

    def inputs(self, text: bytes) -> list[float]:
        found = self.evidence[:, buckets(text)]
        strong = np.sort(np.maximum(found, 0), axis=1)[:, -3:].sum(axis=1)
        return text_stats(text) + strong.tolist()

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        k = len(DOMAINS)
        if self.features is None:
            return np.full((len(x), k), 1 / k)
        p = 1 / (1 + np.exp(-np.clip(self.features(x) @ self.beta, -12, 12)))
        return p / p.sum(axis=1, keepdims=True)


def logistic(z: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        beta += np.linalg.solve(hessian, z.T @ (y - p) - ridge * beta)
    return beta


def fit_domains(docs: DataFrame, labels: DataFrame, most: int = 20_000, n_features: int = 256, gamma: float = 0.02, ridge: float = 1e-2, seed: int = 11) -> DomainModel:
    """Learns from at most ``most`` labelled rows, those of least hashed id; their ids alone are broadcast.

    Half of them teach the word evidence, the other half the logistic fits, which so see evidence from words they didn't make.
    A word's evidence is the lower bound of its log ratio, at 1.5 deviations.
    """
    known = labels.select("doc_id", domain_label().alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)))
    rows = materialize(rows.select("text", "y", "half"), "labelled-texts")
    k = len(DOMAINS)

    def count(batches):
        seen = np.zeros((k, _BUCKETS + 1))
        for b in batches:
            for t, y in zip(b.column(0).cast(pa.large_binary()), b.column(1), strict=True):
                seen[y.as_py(), buckets(t.as_py() or b"")] += 1
                seen[y.as_py(), -1] += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(seen.ravel()[at])], names=["k", "v"])

    seen = np.zeros(k * (_BUCKETS + 1))
    counted = rows.filter("half = 0").select("text", "y").mapInArrow(count, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    seen[np.asarray(counted["k"])] = np.asarray(counted["v"])  # at most k * _BUCKETS numbers
    seen = seen.reshape(k, -1)
    n = seen[:, -1:]
    own = seen[:, :-1] + 0.5
    rest = own.sum(axis=0) - own + 0.5
    ratio = np.log(own / (n + 1)) - np.log(rest / (n.sum() - n + 1))
    model = DomainModel(ratio - 1.5 * np.sqrt(1 / own + 1 / rest), None, np.zeros(0))

    def encode(batches):
        for b in batches:
            x = [model.inputs(t.as_py() or b"") for t in b.column(0).cast(pa.large_binary())]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    taught = rows.filter("half = 1").select("text", "y").mapInArrow(encode, "x array<double>, y int").toPandas()  # at most ``most`` short rows
    if taught.empty:
        return model
    x, y = np.array(taught["x"].tolist()), np.eye(k)[taught["y"].to_numpy()]
    scale = x.std(axis=0)
    features = Features.draw(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), n_features, gamma, seed)
    z = features(x)
    return DomainModel(model.evidence, features, np.stack([logistic(z, y[:, i], ridge) for i in range(k)], axis=1))


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """docs with tokens (words) and post, the posteriors in the order of DOMAINS."""

    @F.arrow_udf("struct<tokens:bigint,post:array<double>>")
    def member(texts: pa.Array) -> pa.Array:
        raw = [t.as_py() or b"" for t in texts.cast(pa.large_binary())]
        x = np.array([model.inputs(t) for t in raw]).reshape(len(raw), len(STATS) + len(DOMAINS))
        post = pa.array(list(model.posteriors(x)), pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array([len(t.split()) for t in raw], pa.int64()), post], names=["tokens", "post"])

    (m,) = fresh(docs, "_m")
    return docs.withColumn(m, member(F.col("text"))).select(*others(docs, "tokens", "post"), f"{m}.*")


def _sums(members: DataFrame, columns: list) -> np.ndarray:
    return np.array([x or 0.0 for x in members.agg(*[F.sum(c) for c in columns]).first()], dtype=float)


def rate_by_tokens(lam: np.ndarray):
    """Column: max(0, 1 - p . lam)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.get("post", F.lit(i)) * float(x) for i, x in enumerate(lam)), F.lit(0.0)))


def solve_rates(members: DataFrame, weights: dict[str, float] = WEIGHTS, ridge: float = 1e-4, most_steps: int = 100, tolerance: float = 2e-3, upsample: bool = True):
    """Column of the rates at the optimum. The anchor, the first domain, keeps its expected total; others come to their share of it.

    With ``upsample`` off, shares are upper bounds: a domain that has less keeps what it has.

    At the optimum the miss of a domain is ridge * target * lam. Newton's steps are halved until the dual falls enough.
    """
    k = len(DOMAINS)
    part = [F.col("tokens") * F.get("post", F.lit(i)) for i in range(k)]
    total = _sums(members, part)
    if not total.sum():
        return F.lit(1.0)
    share = np.array([weights[d] for d in DOMAINS])
    target = np.where(total > 0, share * total[0] / share[0], 0.0)
    target = target if upsample and total[0] else np.minimum(total, target)
    slack = ridge * np.maximum(target, 1e-9 * total.sum())
    pairs = [p * F.get("post", F.lit(j)) for p in part for j in range(k)]

    def at(lam):
        w = rate_by_tokens(lam)
        s = _sums(members, [F.col("tokens") * w * w, *[w * p for p in part], *[F.when(w > 0, q).otherwise(0.0) for q in pairs]])
        return s[0] / 2 + target @ lam + slack @ lam**2 / 2, s[1 : k + 1], s[k + 1 :].reshape(k, k)

    lam = np.zeros(k)
    value, now, gram = at(lam)
    for _ in range(most_steps):
        slope = target + slack * lam - now
        if np.abs(slope).max() <= 1e-6 * target.sum():
            break
        move, size = -np.linalg.solve(gram + np.diag(slack), slope), 1.0
        while (tried := at(lam + size * move))[0] > value + 1e-4 * size * (slope @ move) + 1e-12 * abs(value) and size > 1e-9:
            size /= 2
        lam, (value, now, gram) = lam + size * move, tried
    else:
        raise RuntimeError(f"rates haven't converged after {most_steps} steps: expected {now.tolist()}, targets {target.tolist()}")
    if np.abs(now - target).max() > tolerance * target.sum() / k:
        warnings.warn(f"no rates meet the targets: expected {now.tolist()}, targets {target.tolist()}", stacklevel=2)
    return rate_by_tokens(lam)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, keep: tuple[str, ...] = ("doc_id",), upsample: bool = True) -> DataFrame:
    """The columns keep of docs with tokens, post, rate and copies: how often the mix takes the document, by its rate and a hash.

    copies is the rate rounded up or down by the hash of the id, or of the text where the id is null, so that the
    expected totals of the mix are those of the fit.
    """
    model = fit_domains(docs, labels)
    seed = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("mix"))).otherwise(F.xxhash64("text", F.lit("mix")))
    keyed = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn("_seed", seed)
    members = materialize(memberships(keyed, model).select(*keep, "tokens", "post", "_seed"), "members")
    fitted = F.when(F.col("tokens") == 0, 1.0).otherwise(solve_rates(members, weights, upsample=upsample))
    draw = F.pmod(F.col("_seed"), F.lit(1_000_000)) / 1_000_000
    rated = members.withColumn("rate", fitted).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))
    return rated.drop("_seed")


def op5(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    post = [F.get("post", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return out.select("doc_id", "tokens", *post, "rate", "copies")
