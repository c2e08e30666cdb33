"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each text becomes a short vector of statistics. Random Fourier features of the standardised statistics approximate a
Gaussian kernel; every partition of the labelled rows sums its part of the normal equations, Spark adds the parts, and
the driver solves one system of fixed size. A second part of the labelled rows calibrates the raw scores by pool
adjacent violators over fixed bins. Labels are read from the fitting rows alone; score inputs come from the text alone.

Null and empty texts have the statistics of an empty text and get a score. Labelled rows whose label is null are left
out; repeated ones count each. Without labelled rows every score is 0.5. A very long text is read whole, in one task. Extra
columns stay; one with the name of the score is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize

STATS = (
    "log_words", "word_len", "upper", "digits", "bangs", "symbols", "punct", "non_ascii",
    "distinct", "adjacent", "symbol_words", "log_lines", "dup_lines", "line_words", "space", "top_word", "grams",
)
_SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_PUNCT_BYTES = np.frombuffer(b".,;:?'\"()-", dtype=np.uint8)
_SPACE_BYTES = np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8)


def text_stats(text: bytes | None) -> list[float]:
    """The statistics named in STATS, from one pass over the whole text."""
    text = text or b""
    tokens = text.split()
    n, size = len(tokens), max(len(text), 1)
    chars = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(tokens)
    adjacent = sum(map(eq, tokens, tokens[1:]))
    pairs = len(set(zip(tokens, tokens[3:], strict=False))) / max(n - 3, 1) if n > 3 else 1.0
    symbols = int(chars[_SYMBOL_BYTES].sum())
    return [
        math.log1p(n),
        math.log1p(len(text) / max(n, 1)),
        chars[65:91].sum() / max(chars[65:91].sum() + chars[97:123].sum(), 1),
        chars[48:58].sum() / size,
        math.log1p(100 * chars[33] / max(n, 1)),
        math.log1p(100 * symbols / max(n, 1)),
        chars[_PUNCT_BYTES].sum() / size,
        chars[128:].sum() / size,
        len(counts) / max(n, 1) * math.log1p(n),
        math.log1p(100 * adjacent / max(n, 1)),
        math.log1p(symbols),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
        chars[_SPACE_BYTES].sum() / size,
        max(counts.values(), default=0) / max(n, 1),
        pairs,
    ]


def stats_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and x, the statistics of every text."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            x = [text_stats(t.as_py()) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=[key, "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, x array<double>")


@dataclass
class Features:
    """Standardised statistics, held within four deviations, through random cosines."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def draw(cls, mean, scale, n: int, gamma: float, seed: int) -> Features:
        rng = np.random.default_rng(seed)
        return cls(np.asarray(mean), np.asarray(scale), rng.normal(0, math.sqrt(2 * gamma), (len(mean), n)), rng.uniform(0, 2 * math.pi, n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(self.shift)) * np.cos(z @ self.weights + self.shift)])


@dataclass
class QualityModel:
    features: Features | None
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.beta, self.knots, self.values), 0, 1)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def normal_equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over (x, y) rows. A partition sends the upper triangle once, and Spark sums by entry."""
    d = len(features.shift) + 1
    iu = np.triu_indices(d)

    def run(batches):
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                z = features(_matrix(batch.column(0)))
                a += z.T @ z
                b += z.T @ np.asarray(batch.column(1), dtype=np.float64)
        if a[0, 0]:
            v = np.concatenate([a[iu], b])
            yield pa.record_batch([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["k", "v"])

    parts = rows.select("x", "y").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    v = np.zeros(len(iu[0]) + d)
    for k, x in parts.collect():  # d (d + 3) / 2 numbers, whatever the table's size
        v[k] = x
    a = np.zeros((d, d))
    a[iu] = v[: len(iu[0])]
    return a + np.triu(a, 1).T, v[len(iu[0]) :]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing fit of y, weighted by w, at sorted x."""
    blocks: list[list[float]] = []
    for yi, wi in zip(y, w, strict=True):
        blocks.append([yi, wi, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def raw_scores(rows: DataFrame, features: Features, beta: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            raw = features(_matrix(b.column(0))) @ beta if b.num_rows else np.zeros(0)
            yield pa.record_batch([pa.array(raw), b.column(1)], names=["raw", "y"])

    return rows.select("x", "y").mapInArrow(run, "raw double, y double")


def fit(stats: DataFrame, labelled: DataFrame, n_features: int = 192, gamma: float = 0.03, ridge: float = 1e-2, bins: int = 400, seed: int = 7) -> QualityModel:
    """stats: (doc_id, x) of all documents. labelled: (doc_id, y, part), where rows of part 0 fit and those of part 1 calibrate."""
    rows = materialize(stats.join(labelled, "doc_id").select("x", F.col("y").cast("double").alias("y"), "part"), "labelled")
    n_stats = len(STATS)
    moments = stats.agg(*[f(F.get("x", F.lit(i))) for i in range(n_stats) for f in (F.avg, F.stddev_pop)]).first()
    counts = dict(rows.groupBy("part").count().collect())
    if not counts:
        return QualityModel(None, np.zeros(0), np.zeros(0), np.zeros(0))
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in moments[1::2]])
    features = Features.draw(np.array(moments[0::2], dtype=float), scale, n_features, gamma, seed)
    fitting = rows.filter("part = 0") if counts.get(0) else rows
    a, b = normal_equations(fitting, features)
    beta = np.linalg.solve(a + ridge * np.eye(len(b)), b)
    judged = raw_scores(rows.filter("part = 1") if counts.get(1) else rows, features, beta)
    bin_of = F.least(F.greatest(F.round((F.col("raw") + 0.5) * (bins / 2)), F.lit(0)), F.lit(bins))
    found = judged.groupBy(bin_of.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    knots, y, w = (np.array([r[c] for r in found], dtype=float) for c in ("raw", "y", "n"))
    return QualityModel(features, beta, knots, isotonic(knots, y, w))


def score_stats(stats: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(s)], names=[key, "score"])

    return stats.mapInArrow(run, f"{key} {stats.schema[key].dataType.simpleString()}, score double")


def score_texts(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score; the texts themselves stay in the JVM."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = [text_stats(t.as_py()) for t in texts.cast(pa.large_binary())]
        return pa.array(model.score(np.array(x, dtype=float).reshape(len(x), len(STATS))))

    return docs.withColumn(out, score(F.col(text)))


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def fit_on_labels(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from labels whose fold is not 2: folds 0 and 1 fit, fold 3 calibrates."""
    known = labels.filter(F.col("quality").isNotNull() & (fold() != 2)).select("doc_id", F.col("quality").alias("y"), (fold() == 3).cast("int").alias("part"))
    return fit(stats, known)


def op10(spark, sf_dir):
    from tideline.llm.common import table

    stats = materialize(stats_table(table(spark, sf_dir, "documents")), "stats")
    model = fit_on_labels(stats, table(spark, sf_dir, "labels"))
    out = score_stats(stats, model)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
