"""Suffix-array dedup: repeated strings of at least 400 bytes go, found by a logarithmic family of suffix indexes.

The index takes a corpus in batches of BATCH bytes (larger ones from 32 batches on). A batch's suffix array is sparse: it
holds the suffixes at anchors (see matching), in the order of their first 8 bytes and then of the fingerprint of their
first 273, so that suffixes with a long match stand side by side. It is written as a bucketed, sorted table. A new batch
is merge-scanned against every level; suffixes that agree with one of a level, or of the batch, have a long match. Before
the next batch comes, levels of equal size merge, so that an entry is rewritten once for each doubling.

Among the suffixes with one long match, in the order of their places, each is compared with its neighbours: the first of
all (the first with the last), and the one before it in its own text (the first there with the next). Where neighbours
stay at one distance from anchor to anchor, the match goes on, which gives its length; matches of 400 bytes or more go.
Only at the ends of matches can another suffix share a string that no neighbour does. The strings there are taken in
blocks of 16 neighbouring starts: where what all of a block have in common stands nowhere else, none of them does; where
all of it together does, each of them does; the others are compared one by one. All this goes by 128-bit hashes, with
one place of each string inside matches.

Null texts are empty; texts under 400 bytes and rows without a key keep everything. Repeated rows repeat each other's
strings; where a key holds several texts, each is a text of its own (found by their hashes beforehand). A very long text is indexed and matched in one task, by blocks. Other columns
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import drop_scratch, fresh, materialize, scratch_dir, shuffle_cleanup, table
from tideline.llm.hashing import binary_parts, signed
from tideline.llm.matching import BYTES_400, Units, anchors, by_text, hashed_ranges, union, whole_texts, window_rows

#: Bytes of a batch, and the most batches.
BATCH, MOST_BATCHES = 128 << 20, 32
_BUCKET_BYTES = 64 << 20
#: Anchors whose strings are looked at at once.
_ANCHORS = 1 << 12


class SuffixIndex:
    """Levels of sorted suffix tables; level i holds 2^i batches. Use it in a with statement, which drops its tables."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels, self.tables = spark, buckets, [], []

    def __enter__(self) -> SuffixIndex:
        return self

    def __exit__(self, *failure) -> None:
        for name in list(self.tables):
            self._drop(name)

    def _store(self, entries: DataFrame) -> str:
        name = f"tideline_level_{uuid.uuid4().hex}"
        path = f"{scratch_dir(self.spark)}/{name.replace('_', '-')}"
        dealt = entries.repartition(self.buckets, "phrase").sortWithinPartitions("head", "phrase")
        self.tables.append(name)
        with shuffle_cleanup(self.spark):
            dealt.write.bucketBy(self.buckets, "phrase").sortBy("head", "phrase").option("path", path).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.tables.remove(name)
        if self.spark.catalog.tableExists(name):
            drop_scratch(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def _merge(self) -> None:
        """Equal-sized levels become one of twice the size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = self.spark.table(a).unionByName(self.spark.table(b)).groupBy("phrase", "head").agg(F.sum("n").alias("n"))
            self.levels.append((2 * size, self._store(both)))
            self._drop(a)
            self._drop(b)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index a batch of (head, phrase) rows; the phrases that it shares with a level, or holds twice."""
        self._merge()
        name = self._store(suffixes.groupBy("phrase", "head").agg(F.count(F.lit(1)).alias("n")))
        batch = self.spark.table(name)
        found = batch.filter("n > 1").select("phrase")
        for _, level in self.levels:
            found = found.unionByName(batch.select("phrase").join(self.spark.table(level).select("phrase"), "phrase"))
        found = materialize(found, "matches")
        self.levels.append((1, name))
        return found


def long_matches(suffixes: DataFrame, batches: int, buckets: int, key: str) -> DataFrame:
    """The phrases that stand at two places or more, from all batches in turn."""
    with SuffixIndex(suffixes.sparkSession, buckets) as index:
        found = [index.add(suffixes.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b).select("head", "phrase")) for b in range(batches)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def with_neighbours(suffixes: DataFrame, key: str) -> DataFrame:
    """phrase, key, pos, back_lo, back_hi, and near_key, near (its hash) and near_pos: the first place of the phrase, or for that one (lead) the last."""
    place = F.struct(F.col(key).alias("k"), F.col("pos").alias("p"))
    ends = suffixes.groupBy("phrase").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    lead = place == F.col("_first")
    near = F.when(lead, F.col("_last")).otherwise(F.col("_first"))
    joined = suffixes.join(ends, "phrase").select("phrase", key, "pos", "back_lo", "back_hi", lead.alias("lead"), near.alias("n"))
    return joined.select("phrase", key, "pos", "back_lo", "back_hi", "lead", F.xxhash64("n.k").alias("near"), F.col("n.p").alias("near_pos"), F.col("n.k").alias("near_key"))


def own_neighbours(owner: np.ndarray, phrase: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order of text and place: the index of the one before with the same text and phrase, and of the one after; -1 where there is none."""
    order = np.lexsort((pos, phrase, owner))
    same = (owner[order[1:]] == owner[order[:-1]]) & (phrase[order[1:]] == phrase[order[:-1]]) & (pos[order[1:]] > pos[order[:-1]])
    before, after = np.full(len(pos), -1), np.full(len(pos), -1)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def match_lengths(owner, pos, chosen, near, near_pos, phrase: int) -> tuple[np.ndarray, ...]:
    """(owner, start, end, first suffix) of the matches of suffixes, in order of text and place, with their neighbours, where chosen."""
    if not chosen.any():
        return owner[:0], pos[:0], pos[:0], np.zeros(0, dtype=np.int64)
    on = (owner[1:] == owner[:-1]) & (near[1:] == near[:-1]) & (near_pos[1:] - near_pos[:-1] == pos[1:] - pos[:-1])
    on &= chosen[1:] & chosen[:-1] & (pos[1:] - pos[:-1] <= phrase)
    first = np.flatnonzero(chosen & ~np.concatenate([[False], on]))
    last = np.flatnonzero(chosen & ~np.concatenate([on, [False]]))
    return owner[first], pos[first], pos[last] + phrase, first


def _held(found, owner, at, length: int, far: int) -> np.ndarray:
    """Mask of the strings of some texts, by their starts, that a match holds whole. Matches of a text begin and end in order."""
    of, start, end, _ = found
    if not len(of):
        return np.zeros(at.shape, dtype=bool)
    j = np.searchsorted(of * far + start, owner[:, None] * far + at, side="right") - 1
    return (j >= 0) & (of[j] == owner[:, None]) & (at + length <= end[j])


def matches(candidates: DataFrame, units: Units, key: str = "doc_id") -> DataFrame:
    """The matches of every text's suffixes with their neighbours, and what these don't decide.

    Rows with a null phrase are matches, the bytes lo..hi (hi excluded), at the suffix and at its neighbour. The others are
    blocks of strings to be compared: of those that start so many bytes before pos, the block-th group, in lo..hi; needs
    tells whether some string there is in no match. Left out are strings in a match with the first place, or with an
    earlier one of the same text: these stand there again.
    """
    b = units.block
    ordered = by_text(with_neighbours(candidates, key).select(key, "pos", "phrase", "back_lo", "back_hi", "near_pos", "near", "lead", "near_key"), key)
    kind = candidates.schema[key].dataType.simpleString()

    def rows(keys, phrase, needs, lo, hi, pos, block):
        cols = [pa.nulls(len(lo), pa.int64()) if phrase is None else pa.array(phrase), keys, pa.array(needs), *(pa.array(x.astype(np.int32)) for x in (lo, hi, pos, block))]
        return pa.record_batch(cols, names=["phrase", key, "needs", "lo", "hi", "pos", "block"])

    def block(batch, owner):
        keys = batch.column(0)
        pos, phrase, back_lo, back_hi, near_pos, near, lead = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8))
        pos, near_pos = pos.astype(np.int64), near_pos.astype(np.int64)
        before, after = own_neighbours(owner, phrase, pos)
        zero = np.zeros(len(pos), dtype=np.int64)
        again = [match_lengths(owner, pos, ~lead, near, near_pos, units.phrase), match_lengths(owner, pos, before >= 0, zero, pos[before], units.phrase)]
        kept = [match_lengths(owner, pos, lead, near, near_pos, units.phrase), match_lengths(owner, pos, (before < 0) & (after >= 0), zero, pos[after], units.phrase)]
        for i, (of, start, end, first) in enumerate(again + kept):
            whole = end - start >= units.length
            of, start, end, first = (x[whole] for x in (of, start, end, first))
            shift = pos[first] - (near_pos[first] if i in (0, 2) else pos[(before if i == 1 else after)[first]])
            here = keys.take(pa.array(first))
            there = batch.column(8).take(pa.array(first)) if i in (0, 2) else here
            none, zeros = np.zeros(len(of), dtype=bool), np.zeros(len(of))
            yield rows(here, None, none, start, end, zeros, zeros)
            yield rows(there, None, none, start - shift, end - shift, zeros, zeros)
        far = int(pos.max(initial=0)) + 2 * units.length + 1
        for c in range(0, len(pos), _ANCHORS):
            part = slice(c, c + _ANCHORS)
            at = pos[part][:, None] - np.arange(units.w)
            real = (np.arange(units.w) <= back_lo[part][:, None]) & (np.arange(units.w) >= back_hi[part][:, None])
            skip = np.logical_or.reduce([_held(m, owner[part], at, units.length, far) for m in again])
            done = np.logical_or.reduce([skip, *(_held(m, owner[part], at, units.length, far) for m in kept)])
            left = (real & ~skip).reshape(len(at), -1, b)
            row, group = np.nonzero(left.any(axis=2))
            mine, here = left[row, group], pos[part][row] - group * b
            needs = (real & ~done).reshape(left.shape)[row, group].any(axis=1)
            yield rows(keys.take(pa.array(c + row)), phrase[part][row], needs, here - (b - 1 - mine[:, ::-1].argmax(axis=1)), here - mine.argmax(axis=1), pos[part][row], group)

    def run(batches):
        for x, owner in whole_texts(batches):
            yield from block(x, owner)

    return ordered.mapInArrow(run, f"phrase long, {key} {kind}, needs boolean, lo int, hi int, pos int, block int")


def block_hashes(docs: DataFrame, blocks: DataFrame, units: Units, text: str = "text", key: str = "doc_id") -> DataFrame:
    """blocks (key, pos, block, lo, hi) with start, where they begin, and hashes: c1, c2 of what all strings of the block share, u1, u2 of all of it (null beyond the text)."""
    b = units.block
    kind = docs.schema[key].dataType.simpleString()
    names = ["c1", "c2", "u1", "u2", key, "start", "lo", "hi"]

    def run(batches):
        for x in batches:
            data, offsets = binary_parts(x.column(1))
            for r in range(x.num_rows):
                part = data[offsets[r] : offsets[r + 1]]
                pos, group, lo, hi = (np.asarray(c).astype(np.int64) for c in x.column(2)[r].values.flatten())
                first = pos - group * b
                inside = (first - (b - 1) >= 0) & (first + units.length <= len(part))
                out = [signed(hashed_ranges(part, first, first - (b - 1) + units.length, units, f)) for f in (0, 1)]
                out += [pc.if_else(pa.array(inside), signed(hashed_ranges(part, np.maximum(first - (b - 1), 0), np.minimum(first + units.length, len(part)), units, f)), None) for f in (0, 1)]
                keys = x.column(0).take(pa.array(np.full(len(pos), r)))
                yield pa.record_batch([*out, keys, *(pa.array(v.astype(np.int32)) for v in (first - (b - 1), lo, hi))], names=names)

    per_text = blocks.groupBy(key).agg(F.collect_list(F.struct("pos", "block", "lo", "hi")).alias("blocks"))
    return docs.select(key, text).join(per_text, key).mapInArrow(run, f"c1 long, c2 long, u1 long, u2 long, {key} {kind}, start int, lo int, hi int")


def repeated_bytes(docs: DataFrame, units: Units = BYTES_400, batches: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and spans of the bytes that strings of units.length bytes cover which start at another place too."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    suffixes = materialize(anchors(docs, units, text, key, head=True), "suffixes")
    batches = batches or int(min(MOST_BATCHES, max(2, -(-total // BATCH))))
    buckets = max(12, total // _BUCKET_BYTES)
    candidates = materialize(suffixes.drop("head").join(long_matches(suffixes, batches, buckets, key), "phrase", "left_semi"), "candidates")
    drop_scratch(suffixes)
    found = materialize(matches(candidates, units, key), "found")
    drop_scratch(candidates)
    blocks = found.filter("phrase IS NOT NULL")
    wanted = blocks.filter("needs").select("phrase").distinct()
    hashed = materialize(block_hashes(docs, blocks.join(wanted, "phrase", "left_semi"), units, text, key), "blocks")
    place = F.struct(key, "start")
    ends = [F.min(place).alias("_first"), F.max(place).alias("_last")]
    whole = hashed.filter("u1 IS NOT NULL").groupBy("u1", "u2").agg(*ends).filter("_first < _last").drop("_last")
    told = materialize(hashed.join(whole, ["u1", "u2"], "left").select("c1", "c2", key, "start", "lo", "hi", F.col("_first").isNotNull().alias("whole"), (F.col("_first") != place).alias("again")), "told")
    drop_scratch(hashed)
    mixed = told.groupBy("c1", "c2").agg(*ends, F.max(~F.col("whole")).alias("_some")).filter("_first < _last AND _some").select("c1", "c2")
    ranges = told.filter("NOT coalesce(again, false)").join(mixed, ["c1", "c2"], "left_semi")
    strings = materialize(window_rows(docs, ranges, units, text, key), "strings")
    twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    spans = [
        found.filter("phrase IS NULL").select(key, F.col("lo").alias("s"), F.col("hi").alias("e")),
        told.filter("whole").select(key, F.col("start").alias("s"), (F.col("start") + (units.length + units.block - 1)).alias("e")),
        strings.join(twice, ["h1", "h2"], "left_semi").select(key, F.col("at").alias("s"), (F.col("at") + units.length).alias("e")),
    ]
    # By start: a text has no more of them than bytes, however many others match it.
    longest = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy(key, "s").agg(F.max("e").alias("e"))
    out = materialize(longest.groupBy(key).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    for used in (found, told, strings):
        drop_scratch(used)
    return out


def several_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> bool:
    """Whether any key holds two different texts."""
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    g = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(h).alias("_a"), F.max(h).alias("_b"))
    return g.filter("_a <> _b").limit(1).count() > 0


def dedup_bytes(docs: DataFrame, units: Units = BYTES_400, batches: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, removed (disjoint byte ranges, in order) and kept (the other bytes)."""
    if several_texts(docs, text, key):
        (own,) = fresh(docs, "_own_key")
        whole = docs.select(F.concat_ws(":", F.col(key).cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256)).alias(own), F.col(key).isNull().alias("_none"), text)
        whole = whole.select(F.when(~F.col("_none"), F.col(own)).alias(own), text)
        out = dedup_bytes(whole, units, batches, text, own)
        return out.select(F.substring(own, F.lit(1), F.length(own) - 65).cast(docs.schema[key].dataType).alias(key), "n_bytes", "removed", "kept")
    spans = repeated_bytes(docs, units, batches, text, key).withColumnRenamed(key, "_key")
    joined = docs.select(key, text).join(spans, docs[key] == F.col("_key"), "left").drop("_key")
    kind = docs.schema[key].dataType.simpleString()

    def run(found):
        for b in found:
            data, offsets = binary_parts(b.column(1))
            removed, kept = [], []
            for r in range(b.num_rows):
                part, u = data[offsets[r] : offsets[r + 1]], union(b.column(2)[r])
                cuts = np.concatenate([[0], u.ravel(), [len(part)]])
                removed.append([{"start": int(x), "end": int(y)} for x, y in u])
                kept.append(b"".join(part[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            sizes = pa.array(np.diff(offsets))
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([b.column(0), sizes, pa.array(removed, kinds), pa.array(kept, pa.binary())], names=[key, "n_bytes", "removed", "kept"])

    return joined.mapInArrow(run, f"{key} {kind}, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")


def op2(spark, sf_dir):
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
