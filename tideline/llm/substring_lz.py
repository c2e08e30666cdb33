"""Substring dedup by relative Lempel-Ziv parsing: word passages that texts with smaller keys hold already go.

Every text is a reference block for all texts with larger keys. The index maps the phrase at each anchor (see matching) to
its first place in the smallest key that holds it. Each text is factored greedily against it: from an anchor whose phrase
stands in an earlier block, a factor goes on from anchor to anchor while these stand at the same distance in the same
block. Factors of 50 words or more are duplicate spans. Windows of 50 words that no factor holds whole lie at factor
boundaries; where an earlier block has their phrase, they are checked word for word by 128-bit hashes.

Null texts have no words; texts under 50 words and rows without a key keep everything. Rows of one key must have one text;
they don't repeat each other. A very long text is parsed in one task, by blocks. Other columns aren't read. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import drop_scratch, materialize, table
from tideline.llm.matching import WORDS_50, Units, anchors, by_text, union, whole_texts, window_rows

#: Anchors whose windows are looked at at once.
_ANCHORS = 1 << 14


def reference_index(phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """phrase, ref and ref_pos, the first place in the smallest key that holds it, for phrases that a larger key holds too."""
    place = F.struct(F.col(key).alias("ref"), F.col("pos").alias("ref_pos"))
    found = phrases.groupBy("phrase").agg(F.min(place).alias("_first"), F.max(key).alias("_last"))
    return found.filter(F.col("_first.ref") < F.col("_last")).select("phrase", "_first.*")


def parse(owner, pos, earlier, ref, ref_pos, phrase: int):
    """Greedy factors of texts whose anchors are given in order: (first, last) anchors of each.

    From an anchor whose phrase stands in an earlier block, a factor goes on to the next one as long as that stands at the
    same distance in the same block and no unit between them is left out.
    """
    if not len(pos):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    on = np.zeros(len(pos), dtype=bool)
    same = (owner[1:] == owner[:-1]) & (ref[1:] == ref[:-1]) & (ref_pos[1:] - ref_pos[:-1] == pos[1:] - pos[:-1])
    on[1:] = same & earlier[1:] & earlier[:-1] & (pos[1:] - pos[:-1] <= phrase)
    first = np.flatnonzero(earlier & ~on)
    ends = earlier & ~np.append(on[1:], False)
    return first, np.flatnonzero(ends)


def factors(found: DataFrame, units: Units, key: str = "doc_id") -> DataFrame:
    """The parse of every text, from its anchors with ref and ref_pos (see reference_index).

    Rows with a null phrase are factors: key's units lo..hi (hi excluded) stand in ref from ref_pos on. The others are
    ranges lo..hi of starts of windows that no factor holds whole; needs tells whether an earlier block has their phrase.
    """
    earlier, place = (F.col("ref") < F.col(key)).alias("earlier"), F.xxhash64("ref").alias("block")
    ordered = by_text(found.select(key, "pos", "phrase", "back_lo", "back_hi", "ref_pos", earlier, place, "ref"), key)
    kind = found.schema[key].dataType.simpleString()
    names = ["phrase", key, "needs", "lo", "hi", "ref", "ref_pos"]

    def rows(keys, phrase, needs, lo, hi, ref, ref_pos):
        n = len(lo)
        cols = [
            pa.array(phrase) if phrase is not None else pa.nulls(n, pa.int64()), keys, pa.array(needs),
            pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), ref if ref is not None else pa.nulls(n, keys.type),
            pa.array(ref_pos.astype(np.int32)) if ref_pos is not None else pa.nulls(n, pa.int32()),
        ]
        return pa.record_batch(cols, names=names)

    def block(b, owner):
        keys, ref_key = b.column(0), b.column(8)
        pos, phrase, back_lo, back_hi, ref_pos, earlier, ref = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8))
        pos, ref_pos = pos.astype(np.int64), ref_pos.astype(np.int64)
        first, last = parse(owner, pos, earlier, ref, ref_pos, units.phrase)
        start, end = pos[first], pos[last] + units.phrase
        whole = end - start >= units.length
        at = pa.array(first[whole])
        yield rows(keys.take(at), None, np.zeros(len(at), dtype=bool), start[whole], end[whole], ref_key.take(at), ref_pos[first][whole])
        # Factors begin and end in order, so the last one that begins no later than a window is the one that may hold it.
        far = int(pos.max(initial=0)) + 2 * units.length + 1
        begins = owner[first] * far + start
        for c in range(0, len(pos), _ANCHORS):
            part = slice(c, c + _ANCHORS)
            low, high = (pos - back_lo)[part], (pos - back_hi)[part]
            at = low[:, None] + np.arange(units.w)
            real = at <= high[:, None]
            j = np.searchsorted(begins, owner[part][:, None] * far + at, side="right") - 1
            held = np.zeros(at.shape, dtype=bool)
            if len(first):
                held = (j >= 0) & (owner[first][j] == owner[part][:, None]) & (at + units.length <= end[j])
            edges = np.diff(np.pad((real & ~held).astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, lo = np.nonzero(edges == 1)
            _, hi = np.nonzero(edges == -1)
            yield rows(keys.take(pa.array(c + row)), phrase[part][row], earlier[part][row], low[row] + lo, low[row] + hi - 1, None, None)

    def run(batches):
        for b, owner in whole_texts(batches):
            yield from block(b, owner)

    return ordered.mapInArrow(run, f"phrase long, {key} {kind}, needs boolean, lo int, hi int, ref {kind}, ref_pos int")


def repeated_words(docs: DataFrame, units: Units = WORDS_50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and spans of the words that windows of units.length words cover which start in a text with a smaller key too."""
    phrases = materialize(anchors(docs, units, text, key), "phrases")
    found = phrases.join(reference_index(phrases, key), "phrase")
    parsed = materialize(factors(found, units, key), "factors")
    drop_scratch(phrases)
    ranges = parsed.filter("phrase IS NOT NULL")
    wanted = ranges.filter("needs").select("phrase").distinct()
    rows = materialize(window_rows(docs, ranges.join(wanted, "phrase", "left_semi"), units, text, key), "windows")
    first = rows.groupBy("h1", "h2").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).filter("_first < _last").drop("_last")
    later = rows.join(first, ["h1", "h2"]).filter(F.col("_first") < F.col(key))
    single = later.select(key, F.col("at").alias("s"), (F.col("at") + units.length).alias("e"))
    whole = parsed.filter("phrase IS NULL").select(key, F.col("lo").alias("s"), F.col("hi").alias("e"))
    spans = materialize(whole.unionByName(single).groupBy(key).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    drop_scratch(parsed)
    drop_scratch(rows)
    return spans


def dedup_words(docs: DataFrame, units: Units = WORDS_50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, removed (disjoint word ranges, in order) and kept (the other words, joined by one space)."""
    spans = repeated_words(docs, units, text, key).withColumnRenamed(key, "_key")
    joined = docs.select(key, text).join(spans, docs[key] == F.col("_key"), "left").drop("_key")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, removed, kept = [], [], []
            for t, spans in zip(b.column(1).cast(pa.large_binary()), b.column(2), strict=True):
                tokens, u = (t.as_py() or b"").split(), union(spans)
                cuts = np.concatenate([[0], u.ravel(), [len(tokens)]]).tolist()
                counts.append(len(tokens))
                removed.append([{"start": int(x), "end": int(y)} for x, y in u])
                kept.append(b" ".join(w for x, y in zip(cuts[::2], cuts[1::2], strict=True) for w in tokens[x:y]))
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, kinds), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "removed", "kept"])

    return joined.mapInArrow(run, f"{key} {kind}, n_words long, removed array<struct<start:int,end:int>>, kept string")


def op3(spark, sf_dir):
    out = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
