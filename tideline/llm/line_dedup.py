"""Line dedup by winnowing, on DataFrame functions alone.

A text is the sequence of its content lines (those with a word). A run of ``run`` consecutive content lines that has
occurred before, in the same text or in one with a smaller key, is repeated, and all of its lines go. Of each window of
``run`` line hashes the least one is selected, so that two places that share a run share a fingerprint inside it. Only
selected lines become rows; neighbouring windows mostly select the same line. Fingerprints that occur once are dropped
after a partial count. The others are joined by position to the first place where the lines around them, as far as the
windows reach to both sides, are the same, and matches at one distance from one text extend each other both ways into runs.

With ``words``, fewer lines that hold that many words together are a run as well, and so is the whole of a text that has
fewer than ``run`` lines, where it repeats another such text. op7 goes by ``run`` alone, as its SQL does.

Lines are compared whole, by pairs of 64-bit hashes. A null or empty text has no lines and stays as it is. Blank lines
go only with the deleted line before them. First occurrences always stay; repeated rows of one key count as one text that
occurs once, and each gets the same result. Rows without a key keep everything. A very long text is one row of an array of
line hashes. Extra columns stay; one named n_removed is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import fresh, let, materialize, others, table

_CONTENT = r"[^\x20\x09-\x0D]"


def _hash(c):
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))


def fingerprints(docs: DataFrame, run: int, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """A row per selected line: key, mark (the fingerprint), and windows: at (first line), width and hash of those that selected it.

    Windows have ``run`` content lines. With ``words``, those of fewer lines that hold as many words count too, and the
    whole of a text that has fewer lines than ``run``, which equals other whole texts only; each is a row of its own.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(_CONTENT))

    def window(h, i, width, salt=()):
        part = F.slice(h, i, width)
        wide = F.lit(width) if isinstance(width, int) else width
        return F.struct(i.alias("at"), wide.alias("width"), F.xxhash64(part, *salt).alias("a"), F.xxhash64(F.lit(1), part, *salt).alias("b"))

    def selected(h):
        """The least line of every window, the first of equals, and with it the windows that it is the least of."""

        def place(i):
            return F.array_min(F.transform(F.slice(h, i, run), lambda x, j: F.struct(x["a"], (i + j).alias("p"))))["p"]

        def rows(places):
            def row(p):
                near = F.sequence(F.greatest(p - (run - 1), F.lit(1)), F.least(p, F.size(places)))
                mine = F.filter(near, lambda i: F.get(places, i - 1) == p)
                return F.struct(F.get(h, p - 1)["a"].alias("mark"), F.transform(mine, lambda i: window(h, i, run)).alias("windows"))

            return F.transform(F.array_distinct(places), row)

        return F.when(F.size(h) >= run, let(F.transform(F.sequence(F.lit(1), F.size(h) - (run - 1)), place), rows))

    def alone(h, i, width, salt):
        w = window(h, i, width, (F.lit(salt),))
        return F.struct(F.xxhash64(w).alias("mark"), F.array(w).alias("windows"))

    def made(h):
        if words is None:
            return selected(h)

        def rich(width):
            return lambda i: sum((F.get(h, i + (j - 1))["n"] for j in range(width)), F.lit(0)) >= words

        def unplaced(row):
            return F.struct(F.xxhash64(F.transform(row["windows"], lambda w: F.struct(w["width"], w["a"], w["b"]))).alias("mark"), row["windows"].alias("windows"))

        def unplaced_words(width):
            return lambda i: unplaced(alone(h, i, width, "words"))

        kinds = [selected(h), F.when(F.size(h).between(1, run - 1), F.array(unplaced(alone(h, F.lit(1), F.size(h), "whole"))))]
        for width in range(1, run):
            places = F.filter(F.sequence(F.lit(1), F.size(h) - (width - 1)), rich(width))
            kinds.append(F.when(F.size(h) >= width, F.transform(places, unplaced_words(width))))
        return F.flatten(F.filter(F.array(*kinds), lambda x: x.isNotNull()))

    counted = _hash if words is None else lambda x: _hash(x).withField("n", F.regexp_count(x, F.lit(_CONTENT + "+")))
    rows = docs.select(F.col(key), F.explode(let(F.transform(lines, counted), made)).alias("w"))
    return rows.select(F.col(key), "w.*")


def repeated_runs(docs: DataFrame, run: int = 3, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """key, start and end (content lines from 1, end excluded) of the runs that stood before, with src and src_start, where."""
    selected = materialize(fingerprints(docs.filter(F.col(key).isNotNull()), run, text, key, words), "fingerprints")
    marks = selected.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    shared = selected.join(marks, "mark", "left_semi").select(F.col(key), F.explode("windows").alias("w")).select(F.col(key), "w.*").distinct()
    place = F.struct(F.col(key).alias("k"), F.col("at"))
    first = shared.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = shared.join(first, ["a", "b"]).filter(place != F.col("first"))
    apart = later.select(F.col(key), "at", "width", F.col("first.k").alias("src"), (F.col("at") - F.col("first.at")).alias("apart"))
    one = Window.partitionBy(key, "src", "apart", "width")
    chained = apart.withColumn("chain", F.col("at") - F.dense_rank().over(one.orderBy("at")))
    runs = chained.groupBy(key, "src", "apart", "width", "chain").agg(F.min("at").alias("start"), (F.max("at") + F.col("width")).alias("end"))
    return runs.select(F.col(key), "start", "end", "src", (F.col("start") - F.col("apart")).alias("src_start"))


def repeated_lines(docs: DataFrame, run: int = 3, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """key and lines, the sorted numbers (from 1) of the content lines that go, for the texts that lose any."""
    covered = repeated_runs(docs, run, text, key, words).groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    spread = F.flatten(F.transform("runs", lambda w: F.sequence(w["start"], w["end"] - 1)))
    return covered.select(F.col(key), F.array_sort(F.array_distinct(spread)).alias("lines"))


def without_lines(text, gone):
    """The text less its content lines with the numbers in gone, and less the blank lines that follow these."""

    def cut(lines):
        places = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike(_CONTENT))

        def kept(at):
            spans = F.transform(gone, lambda g: F.sequence(F.get(at, g - 1), F.coalesce(F.get(at, g) - 1, F.size(lines))))
            stay = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.flatten(spans))
            return F.array_join(F.transform(stay, lambda i: F.get(lines, i - 1)), "\n")

        return let(places, kept)

    return let(F.split(text, "\n"), cut)


def dedup_lines(docs: DataFrame, run: int = 3, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """docs with the text less its repeated runs, and n_removed, the number of content lines that went."""
    gone = repeated_lines(docs, run, text, key, words)
    kept = docs.select(*others(docs, "n_removed"))
    at, lines = fresh(kept, "_key", "_lines")
    out = kept.join(gone.select(F.col(key).alias(at), F.col("lines").alias(lines)), F.col(key) == F.col(at), "left")
    cut = F.when(F.col(lines).isNull(), F.col(text)).otherwise(without_lines(F.col(text), F.col(lines)))
    removed = F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_removed")
    return out.select(*(cut.alias(text) if c == text else F.col(c) for c in kept.columns), removed)


def op7(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, regexp_matches(x, '[^ \t-\r]') AS content FROM l),
n AS (SELECT *, sum(content::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM m),
k AS (
  SELECT doc_id, c AS pos, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM n WHERE content
  WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
f AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS r FROM k WHERE z IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS c FROM f WHERE r > 1),
t AS (
  SELECT n.doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (g.c IS NULL), '') AS kept,
    count(*) FILTER (g.c IS NOT NULL AND content) AS gone
  FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.c = g.c GROUP BY n.doc_id)
SELECT d.doc_id, length(kept)::BIGINT AS n_chars, coalesce(gone, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
