"""Spelling variant grouping: words of a corpus that are one edit from a much more frequent word.

Words are counted over all texts. Near words, those one inserted, deleted or replaced code point apart, are found by a
variable-length gram index. Words are set between two marks, and a *gram dictionary* is counted over all words: every
gram of two characters, and a longer gram where the one without its last character is common, so that common grams are
split and rare ones are left short. A word is decomposed into the longest gram of the dictionary at every place, without
those that lie inside an earlier one. For every place of an edit the grams it may change are counted; the largest count
is the word's *affected-gram bound* ``a``. Near words share all but ``a`` grams of either at least, in one order of rarity,
so the rarest they share is among the ``a + 1`` rarest of both: only these go into lists. An edit leaves a gram's distance
from the word's start or from its end as it was, so lists are kept by gram, place and length, and merged by an equality
join whose pairs are verified by their edit distance in the join itself.

The longest gram grows with the words (``BANDS``): a word of n characters and two marks has grams of at most
(n + 1) / 2, which leaves a gram whole before or behind any edit, so no bound reaches the number of grams. Words at the
limit of two bands are in both, so near words always have a band in common.

The dictionary is broadcast: at most ``SPLIT`` grams of a length are split, whatever the corpus's size. Links are reduced to one
row a word before chains of forms are followed, by doubling, over written tables.

Null and empty texts have no words; a null id counts as an empty one. Repeated rows count as often as they occur; of
forms of equal frequency the first in code-point order is taken. A very long text is one row of its words. Other columns aren't
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import drop_scratch, materialize, table

RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (shortest word, longest word, longest gram) of each band.
BANDS = ((5, 7, 3), (7, 9, 4), (9, None, 5))
SHORTEST = 2
#: Grams of fewer words than this are common enough for no split, and so many of a length are split at most.
COMMON, SPLIT = 32, 4096
OPENS, CLOSES = "\x02", "\x03"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """word, n: lower-cased runs of letters, every ``noise``-th by hash with one code point less, of some length and frequency."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(1))).alias("run"))
    plain = F.length("run") == F.octet_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % noise == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def gram_dictionary(words: DataFrame, longest: int) -> dict[str, int]:
    """Grams and the number of places they have in the words: those of two characters, and continuations of common ones.

    Level by level, so a level's counts are of grams whose parent was split; at most SPLIT grams of a level are.
    """
    marked = F.concat(F.lit(OPENS), "word", F.lit(CLOSES))
    known: dict[str, int] = {}
    split: list[str] | None = None
    for q in range(SHORTEST, longest + 1):
        places = F.explode(F.sequence(F.lit(1), F.length(marked) - (q - 1)))
        grams = words.filter(F.length(marked) >= q).select("word", places.alias("place")).select(F.substring(marked, F.col("place"), F.lit(q)).alias("gram"))
        if split is not None:
            parents = words.sparkSession.createDataFrame([(g,) for g in split], "parent string")
            grams = grams.join(F.broadcast(parents), F.substring("gram", 1, q - 1) == F.col("parent"), "left_semi")
        level = {r.gram: r["count"] for r in grams.groupBy("gram").count().toLocalIterator()}
        known |= level
        split = sorted((g for g, n in level.items() if n > COMMON), key=lambda g: (-level[g], g))[:SPLIT]
        if not split:
            break
    return known


def decompose(marked: str, known, longest: int) -> list[tuple[int, str]]:
    """(place, gram): the longest known gram at every place, but for those inside an earlier one."""
    out, reach = [], 0
    for p in range(len(marked) - SHORTEST + 1):
        size = SHORTEST
        while size < longest and p + size < len(marked) and marked[p : p + size + 1] in known:
            size += 1
        if p + size > reach:
            reach = p + size
            out.append((p, marked[p:reach]))
    return out


def affected(marked: str, grams: list[tuple[int, str]], longest: int) -> int:
    """The most grams that one edit may change. Grams are sure to stay where all that decides them lies on one side of it.

    On the left, that's the ``longest`` characters from a gram's start on; on the right, the gram itself, where it reaches
    beyond any gram that starts before it can.
    """
    most, n = 0, len(marked)
    ends = [(p, p + len(g)) for p, g in grams]
    for i in range(1, n):  # an insertion before character i
        stay = sum(p + longest <= i or (p >= i and end >= i + longest) for p, end in ends)
        most = max(most, len(ends) - stay)
    for i in range(1, n - 1):  # character i replaced or deleted
        stay = sum(p + longest <= i or (p > i and end > i + longest) for p, end in ends)
        most = max(most, len(ends) - stay)
    return most


def index_entries(words: DataFrame, known: dict[str, int]) -> DataFrame:
    """word and its list keys: gram, place from the start (or, negative, from the end), length of the longer word, and side.

    Sides: 'r' for words of one length, 'x' for the longer and 'd' for the shorter of two lengths.
    """
    shared = words.sparkSession.sparkContext.broadcast(known)

    def keys(word: str) -> Iterator[tuple[str, int, int, str]]:
        marked, known = OPENS + word + CLOSES, shared.value
        for low, high, longest in BANDS:
            if len(word) >= low and (high is None or len(word) <= high):
                grams = decompose(marked, known, longest)
                bound = affected(marked, grams, longest)
                grams.sort(key=lambda pg: (known[pg[1]], pg[1], pg[0]))
                for p, g in grams[: bound + 1]:
                    gram, back, n = f"{longest}{g}", p - len(marked), len(word)
                    if high is None or n < high:
                        yield gram, p, n, "r"
                        yield gram, p, n + 1, "d"
                        yield gram, back, n + 1, "d"
                    if n > low:
                        yield gram, p, n, "x"
                        yield gram, back, n, "x"

    def run(batches):
        for b in batches:
            for part in range(0, len(b), 2000):
                rows = [(w, *key) for w in b.column(0)[part : part + 2000].to_pylist() for key in keys(w)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "gram", "place", "size", "side"])

    return words.select("word").mapInArrow(run, "word string, gram string, place int, size int, side string")


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) of words that are one edit apart, each pair once, a the longer or, of one length, the first."""
    known = gram_dictionary(words, max(longest for _, _, longest in BANDS))
    entries = materialize(index_entries(words, known), "grams")
    key = ["gram", "place", "size"]
    left = entries.filter("side <> 'd'").select(*key, F.col("word").alias("a"), (F.col("side") == "r").alias("same"))
    right = entries.filter("side <> 'x'").select(*key, F.col("word").alias("b"), (F.col("side") == "r").alias("same"))
    met = left.join(right, [*key, "same"]).filter((~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = materialize(met.select("a", "b").distinct(), "near")
    drop_scratch(entries)
    return pairs


def follow(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): the last form of every chain, by doubling until no chain gets longer."""
    chains = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("grew"))
        longer = materialize(longer, "chains")
        drop_scratch(chains)
        if not longer.filter("grew").limit(1).count():
            return longer.select("word", "root")
        chains = longer.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of (word, n): the form is the most frequent near word, if ``ratio`` times as frequent."""
    words = materialize(words.select("word", "n"), "words")
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    ranked = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = ranked.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    linked = words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.n")).alias("form_n"),
    )
    linked = materialize(linked, "forms")
    drop_scratch(pairs)
    drop_scratch(words)
    roots = follow(linked.filter(F.col("form").isNotNull()))
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir):
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))
