"""Quality rules with a verdict per host, on DataFrame functions alone.

Every document gets counts and a base verdict. The failures of a host's documents are then pooled: a beta prior is
fitted to the failure rates of all hosts by the method of moments, each host's rate is shrunk towards it, and hosts
whose shrunk rate is over ``max_rate`` lose all their documents.

Nulls: a null text has no words (so it fails the base rule); a null host has no pooled verdict and its documents keep
the base one. An empty table gives an empty result. Repeated rows are counted as often as they occur. A very long text is
one row of arrays of its words and window hashes. Extra columns stay; those with the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, let, materialize, others, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(tokens):
    """Words covered by a window of eight that occurs at least twice in the text.

    Windows are compared by 64-bit hashes. Where all differ, which one hash set tells, nothing is sorted.
    """

    def covered(hashes):
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s):
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))

        def length(p):
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

        return let(let(order, positions), length)

    def of(w):
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    return F.when(F.size(tokens) > WINDOW, of(tokens)).otherwise(F.lit(0)).cast("long")


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    plain = F.coalesce(F.col(text), F.lit(""))
    symbols = sum((F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))

    def counts(w):
        lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    keep = others(docs, text, *COUNTS, "base_failed")
    (rules,) = fresh(docs, "_rules")
    out = docs.select(*keep, let(words(F.col(text)), counts).alias(rules))
    out = out.select(*keep, f"{rules}.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(counts: DataFrame, host: str) -> DataFrame:
    """A row per host: n_docs, n_failed and the shrunk failure rate. The prior comes from one aggregate row."""
    hosts = counts.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    hosts = materialize(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")
    ).first()
    alpha, beta = beta_prior(s["mean"], s["var"], s["inv"])
    return hosts.withColumn("rate", F.round((F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)), 9))


def beta_prior(mean: float | None, var: float | None, inv: float | None) -> tuple[float, float]:
    """Moments of the hosts' rates, less the sampling variance mean(1-mean)/n, give the prior's strength, held in 2..1000."""
    mean = min(max(mean if mean is not None else 0.5, 1e-3), 1 - 1e-3)
    between = (var or 0.0) - mean * (1 - mean) * (inv or 0.0)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0) if between > 1e-9 else 1000.0
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """rule_counts with host_rate and kept: not base_failed, and the host's shrunk failure rate is at most max_rate."""
    counts = materialize(rule_counts(docs.select(*others(docs, "host_rate", "kept")), text), "rules")
    (named,) = fresh(counts, "_host")
    rates = host_rates(counts, host).select(F.col(host).alias(named), F.col("rate").alias("host_rate"))
    out = counts.join(rates, F.col(host) == F.col(named), "left").drop(named)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_rate))


def op9(spark, sf_dir):
    from tideline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM documents),
k AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, w FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM k),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM r) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT greatest(least(avg(k / n), 0.999), 0.001) AS m, var_pop(k / n) AS v, avg(1.0 / n) AS inv FROM h),
p AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 1e-9 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 2), 1000) ELSE 1000 END AS s FROM m),
v AS (SELECT source, (k + m * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM b LEFT JOIN v USING (source)
"""
