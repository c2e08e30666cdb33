"""Near-duplicate texts by an exact Jaccard join of word 5-grams (similarity of 0.75 or more).

Texts with one set of shingles are one record, named by the set's fingerprint. A record of n shingles belongs to the
size band of 2^j <= n < 2^(j+1), whose scheme hashes the universe of shingles into 1.25 * 2^j segments (under 64 shingles:
one for each). Two linked records differ in at most H = (n + 4n/3) / 7 shingles, so more than H segments that no other
record has rule out any link. A record indexes its segments in its band's scheme, and in the next lower one if a smaller
partner may be there.

1. Keys are matched in buckets of bounded size, after equal keys of a batch are combined. A key that one record alone
   has, or one component, is free; a record with more than H free segments is done.
2. Each open key names its most central record as hub (the one whose keys are the most common); every record is verified
   against the hub that most of its keys name, and components follow.
3. For what is left, shingles are looked at one by one. With c of its n shingles live, that is shared with another
   component's record that may still be linked, a pair needs 7 min(c, c') >= 3 (n + n'): a bound by counts alone, which
   is repeated, with rounds of hubs, as long as they merge much. Groups around a common passage go here, without pairs.
4. What is still open gets segments and one-deletion neighbourhoods over its live shingles, in a scheme of its live
   count's band. A segment counts 1 if equal and 2 if all but one of its shingles are; each record takes the cheapest
   of these, by the counted records behind their keys, until they add up to more than it can differ in. The records of
   the smaller component are compared with those of larger ones that they meet there.

Verification intersects whole sets, which are at most 4/3 as large as each other, so what is shipped follows the members
of a group. No link between components is lost, and no group is expanded into pairs. Each step's cost follows its rows,
but records of different components that are all just under the limit to each other must be compared pair by pair.

Null and empty texts, and texts without words, have no shingles and no links. A null key is a text of its own. Repeated
rows are copies; rows of one key with other texts are texts of their own with that key. A very long text is one record of
one row; its set must fit a task. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tideline.llm.common import drop_scratch, materialize, table
from tideline.llm.components import components
from tideline.llm.hashing import Prefix, binary_parts, blocks, mix, signed, word_values

N = 5
_BLOCK = 1 << 20
#: Bands under this one have a segment per shingle.
_FIRST_BAND = 6
_SALT = 0x9E3779B97F4A7C15
_ENTRIES = 1_000_000
#: Rounds of hubs go on while they link so large a share of the open records.
_GAIN = 0.05
_FP = np.uint64(0xFFFFFFFFFFFFFFFE)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer than n words is one shingle."""
    values, at = word_values(data, offsets, lower=True)
    if not len(values):
        return [np.zeros(0, dtype=np.uint64)] * (len(offsets) - 1)
    prefix = Prefix(values)
    grams = prefix.grams(n) if len(values) >= n else np.zeros(0, dtype=np.uint64)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= n:
            out.append(np.unique(grams[s : e - n + 1]))
        else:
            out.append(mix(prefix.at(np.array([s]), np.array([e])) + np.uint64(e - s)) if e > s else np.zeros(0, dtype=np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """Of a set; the lowest bit is left free."""
    return int(mix(s).sum(dtype=np.uint64) & _FP)


def differences(n):
    """The most shingles in which a record of n differs from a linked one that is at least as large; of its own, where each is a segment."""
    return np.where(n < 1 << _FIRST_BAND, n // 4, (n + n * 4 // 3) // 7)


def scheme_keys(sets: list[np.ndarray], band: int):
    """(set, key) of the segments of some sets in a band's scheme, and how many each set has."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    if band < _FIRST_BAND:
        return which, mix(tokens ^ np.uint64(_SALT)), np.array([len(s) for s in sets])
    m = (5 << band) // 4
    spread = mix(tokens ^ np.uint64(band * _SALT & (2**64 - 1)))
    place = which * m + (spread % np.uint64(m)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, spread = place[order], mix(spread[order])
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    segment = ((place[first] % m).astype(np.uint64) << np.uint64(6)) + np.uint64(band)
    owner = place[first] // m
    return owner, mix(np.add.reduceat(spread, first) ^ mix(segment)), np.bincount(owner, minlength=len(sets)).astype(np.int64)


def _bands(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.log2(np.maximum(n, 1) + 0.5)).astype(np.int64), _FIRST_BAND - 1)


def record_keys(sets: list[np.ndarray]):
    """(set, key, own) of all segments, and how many each set has in its own scheme and in the next lower one."""
    n = np.array([len(s) for s in sets])
    own = _bands(n)
    value, value_below = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    parts = []
    lower = (own >= _FIRST_BAND) & (3 * n < 4 << own)
    for band in np.unique(own).tolist():
        for chosen, mine in ((np.flatnonzero((own == band) & (n > 0)), True), (np.flatnonzero((own == band + 1) & lower), False)):
            if len(chosen):
                which, keys, total = scheme_keys([sets[i] for i in chosen], band)
                parts.append((chosen[which], keys, np.full(len(keys), mine)))
                (value if mine else value_below)[chosen] = total
    for band in set((own[lower] - 1).tolist()) - set(own.tolist()):
        chosen = np.flatnonzero((own == band + 1) & lower)
        which, keys, value_below[chosen] = scheme_keys([sets[i] for i in chosen], band)
        parts.append((chosen[which], keys, np.zeros(len(keys), dtype=bool)))
    empty = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool))
    return *(tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else empty), value, value_below


def _text_blocks(batches):
    for b in batches:
        data, offsets = binary_parts(b.column(1))
        for i, j in blocks(offsets, _BLOCK):
            yield b.column(0).slice(i, j - i), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def digests(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, n, fp, and value and need: the segments it has, and how many must be free; value_below: in the next lower scheme."""

    def run(batches):
        for keys, sets in _text_blocks(batches):
            n = np.array([len(s) for s in sets], dtype=np.int64)
            *_, value, below = record_keys(sets)
            fps = np.array([fingerprint(s) for s in sets], dtype=np.uint64)
            yield pa.record_batch([keys, pa.array(n), signed(fps), pa.array(value), pa.array(differences(n) + 1), pa.array(below)], names=[key, "n", "fp", "value", "need", "value_below"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n long, fp long, value long, need long, value_below long")


def _shared(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Mask of the entries, sorted by key, whose key more than one record has."""
    edge = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(edge)
    if not len(first):
        return np.zeros(0, dtype=bool)
    low, high = np.minimum.reduceat(fps & _FP, first), np.maximum.reduceat(fps & _FP, first)
    return np.repeat(low != high, np.diff(np.concatenate([first, [len(keys)]])))


def packed_keys(docs: DataFrame, buckets: int, text: str, key: str) -> DataFrame:
    """(bucket, found, keys, fps): the index entries of a block of texts, dealt by key. Entries of keys that the block already shares are found, and spread anyhow."""

    def run(batches):
        for _, sets in _text_blocks(batches):
            fps = np.array([fingerprint(s) for s in sets], dtype=np.uint64)
            which, keys, own, *_ = record_keys(sets)
            if not len(keys):
                continue
            fps = fps[which] | own.astype(np.uint64)
            order = np.lexsort((fps, keys))
            keys, fps = keys[order], fps[order]
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])])
            keys, fps = keys[fresh], fps[fresh]
            shared = _shared(keys, fps)
            lead = np.concatenate([[True], keys[1:] != keys[:-1]])
            for found, chosen in ((False, np.flatnonzero(lead)), (True, np.flatnonzero(shared))):
                if not len(chosen):
                    continue
                k, f = keys[chosen], fps[chosen]
                bucket = ((mix(f if found else k) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                k, f, bucket = k[order], f[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.concatenate([cuts[1:], [len(bucket)]])
                rows = [(k[i:j].tobytes(), f[i:j].tobytes()) for i, j in zip(cuts, ends, strict=True)]
                cols = [pa.array(bucket[cuts]), pa.array([found] * len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
                yield pa.record_batch(cols, names=["bucket", "found", "keys", "fps"])

    return docs.select(key, text).mapInArrow(run, "bucket int, found boolean, keys binary, fps binary")


def shared_entries(packed: DataFrame) -> DataFrame:
    """(key, fp, own) of the keys that more than one record has. A group is one bucket, of about a million entries."""

    def run(t: pa.Table) -> pa.Table:
        def read(column):
            return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint64)

        found = t.filter(t["found"])
        rest = t.filter(pc.invert(t["found"]))
        keys, fps = read(rest["keys"]), read(rest["fps"])
        order = np.argsort(keys, kind="stable")
        keys, fps = keys[order], fps[order]
        hit = _shared(keys, fps)
        keys, fps = np.concatenate([keys[hit], read(found["keys"])]), np.concatenate([fps[hit], read(found["fps"])])
        return pa.table({"key": signed(keys), "fp": signed(fps & _FP), "own": pa.array((fps & np.uint64(1)).astype(bool))})

    return packed.groupBy("bucket").applyInArrow(run, "key long, fp long, own boolean")


def set_table(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """fp, n and shingles (sorted hashes) of the records whose (fp, n, rep) are wanted."""

    def run(batches):
        for b in batches:
            data, offsets = binary_parts(b.column(0))
            for i, j in blocks(offsets, _BLOCK):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                fps = np.array([fingerprint(s) for s in sets], dtype=np.uint64)
                rows = pa.record_batch([signed(fps), b.column(2).slice(i, j - i), _lists(sets)], names=["fp", "n", "shingles"])
                yield rows.filter(pc.equal(rows.column(0), b.column(1).slice(i, j - i)))

    joined = docs.select(F.col(key).alias("rep"), F.col(text).alias("_text")).join(wanted.select("rep", "fp", "n"), "rep")
    return joined.select("_text", "fp", "n").mapInArrow(run, "fp long, n long, shingles array<long>").dropDuplicates(["fp"])


def _lists(sets: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), signed(values))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs of records whose sets have 100 * intersection >= 75 * union. Written as a table."""
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
    near = both.filter("4 * least(na, nb) >= 3 * greatest(na, nb) AND 7 * size(array_intersect(sa, sb)) >= 3 * (na + nb)")
    return materialize(near.select("a", "b"), "links")


def _narrow(rows: DataFrame, records: DataFrame, rounds: int) -> DataFrame:
    """The (key, fp, own, root) rows that may still show a link between two roots, with pop, how many records have each of fp's segments on the average.

    A key is open if rows of two roots have it, one of them in its own scheme; all other segments are free. A record with
    more free segments in a scheme than two linked records can differ in has no link there, so its rows go, which frees
    segments of others. Linked records of two roots never go: what they share is open.
    """
    limits = records.select("fp", "value", "need", "value_below", (F.floor(2 * F.col("n") / 7) + 1).alias("need_below"))
    spare = F.when(F.col("own"), F.col("value") - F.col("lost") < F.col("need")).otherwise(F.col("value_below") - F.col("lost") < F.col("need_below"))
    for i in range(rounds):
        found = rows.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max("own").alias("_own"), F.count(F.lit(1)).alias("_df"))
        left = materialize(rows.drop("pop").join(found.filter("_lo < _hi AND _own").select("key", "_df"), "key"), "open")
        lost = left.groupBy("fp", "own").agg(F.count(F.lit(1)).alias("lost"), F.sum("_df").alias("pop"))
        needy = lost.join(limits, "fp").filter(spare).select("fp", "own", (F.col("pop") / F.when(F.col("own"), F.col("value")).otherwise(F.col("value_below"))).alias("pop"))
        kept = materialize(left.drop("_df").join(needy, ["fp", "own"]), "narrow")
        drop_scratch(left)
        if i:
            drop_scratch(rows)
        rows = kept
    return rows


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """For every record, the hub of another root that most of its keys name: one pair a record at most."""
    hubs = rows.groupBy("key").agg(F.max_by(F.struct(F.col("fp").alias("hub"), F.col("root").alias("hub_root")), F.struct("pop", "fp")).alias("h")).select("key", "h.*")
    return _voted(rows.join(hubs, "key").filter("root <> hub_root"))


def _live_hub_pairs(live: DataFrame) -> DataFrame:
    """The same by shingles. A shingle has a hub in each band of sizes: the record that is live for the largest part."""
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3)))
    best = F.max_by(F.struct(F.col("fp").alias("hub"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("c").alias("c_a")), F.struct(F.col("c") / F.col("n"), F.col("df"), F.col("fp")))
    hubs = live.groupBy("token", band.alias("band")).agg(best.alias("h")).select("token", "band", "h.*")
    near = live.select("fp", "root", "n", "c", "token", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    return _voted(near.join(hubs, ["token", "band"]).filter(_POSSIBLE))


def _voted(named: DataFrame) -> DataFrame:
    votes = named.groupBy("fp", "hub").agg(F.count(F.lit(1)).alias("votes"))
    return _pairs(votes.groupBy(F.col("fp").alias("a")).agg(F.max_by("hub", F.struct("votes", "hub")).alias("b")))


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _live(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """The live (fp, n, root, token) rows, with c (live shingles), most: the largest 7c - 6n at the token, and df.

    Two linked records share 3/7 of their sizes together at least, all of it live, and 3/4 of either size. So a token is
    live for a record if two roots have it, if the record's c suffices for the smallest record there and if some record's
    c there suffices for a partner of its size.
    """
    own = Window.partitionBy("fp")
    enough = "4 * c >= 3 * n AND 7 * c >= 3 * (n + _least) AND _room >= 3 * n AND 7 * c - 6 * n + most >= 0"
    for i in range(rounds):
        stats = F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min("n").alias("_least"), F.max(7 * F.col("c") - 3 * F.col("n")).alias("_room")
        spread = rows.groupBy("token").agg(*stats, F.max(7 * F.col("c") - 6 * F.col("n")).alias("most"), F.count(F.lit(1)).alias("df"))
        left = rows.select("fp", "n", "root", "token", "c").join(spread.filter("_lo < _hi").drop("_lo", "_hi"), "token").filter(enough)
        counted = left.withColumn("c", F.count(F.lit(1)).over(own))
        kept = materialize(counted.filter(enough).drop("_least", "_room"), "live")
        drop_scratch(rows)
        rows = kept
    return rows


def _band(c):
    return F.when(c < 1 << _FIRST_BAND, F.lit(_FIRST_BAND - 1)).otherwise(F.length(F.bin(c)) - 1)


def _shifted(n: int, band):
    return F.call_function("shiftleft", F.lit(n).cast("long"), band)


def _indexed(live: DataFrame) -> DataFrame:
    """(fp, root, n, c, most, own, scheme, seg, key, kind, size): the segments of all live records and what is left of them with a shingle less.

    kind is E for a segment, D for one with a shingle deleted. A record is in the scheme of its live count's band, and in
    those of the bands next to it where a linked record's count may fall: counts of linked records differ by 4/3 at most.
    """
    band = _band(F.col("c"))
    low = F.when((band >= _FIRST_BAND) & (3 * F.col("c") < _shifted(4, band)), band - 1)
    high = F.when(4 * F.col("c") >= _shifted(6, band), band + 1)
    rows = live.select("fp", "root", "n", "c", "token", "most", band.alias("_own"), F.explode(F.array_compact(F.array(low, band, high))).alias("scheme"))
    place = F.xxhash64("token", "scheme")
    seg = F.when(F.col("scheme") < _FIRST_BAND, place).otherwise(F.pmod(place, F.floor(_shifted(5, F.col("scheme")) / 4)))
    per = rows.select("*", seg.alias("seg"), F.xxhash64(F.lit(7), "token").alias("h")).groupBy("fp", "root", "n", "c", "scheme", "seg")
    made = per.agg((F.col("scheme") == F.max("_own")).alias("own"), F.max("most").alias("most"), F.bit_xor("h").alias("whole"), F.collect_list("h").alias("hs"))
    less = F.when(F.size("hs") > 1, F.transform("hs", lambda h: F.struct(F.col("whole").bitwiseXOR(h).alias("x"), F.lit("D").alias("kind")))).otherwise(F.array())
    keys = F.explode(F.concat(F.array(F.struct(F.col("whole").alias("x"), F.lit("E").alias("kind"))), less)).alias("k")
    out = made.select("fp", "root", "n", "c", "most", "own", "scheme", "seg", F.size("hs").alias("size"), keys)
    return out.select("*", F.xxhash64("scheme", "seg", "k.x").alias("key"), "k.kind").drop("k")


def _allocated_pairs(live: DataFrame) -> DataFrame:
    """Pairs of open records of two roots where one meets the other's root at an allocated segment or neighbourhood.

    Within its live shingles, a record of c differs from a linked one in at most H = c - 2n/3, and in no more than
    (7c - 6n + most) / 7. Its segments give a value of 1 for the records that have them whole, or of 2 for those with one
    shingle more or less too; it takes the cheapest of them, by counted records, up to a value of H + 1. The records of
    smaller roots look up the larger roots there, and are compared with such a root's records whose sizes allow it.
    """
    index = materialize(_indexed(live), "index")
    counts = index.groupBy("key").agg(F.count_if(F.col("kind") == "E").alias("e"), F.count_if(F.col("kind") == "D").alias("d"), (F.min("root") < F.max("root")).alias("open"))
    exact = F.col("kind") == "E"
    mine = index.filter("own").join(counts, "key")
    seen = mine.withColumn("one", F.when(exact & F.col("open"), F.col("e") - 1).otherwise(0)).withColumn("both", F.when(~F.col("open"), 0).when(exact, F.col("e") - 1 + F.col("d")).otherwise(F.col("e")))
    costs = seen.groupBy("fp", "n", "c", "seg").agg(F.max("one").alias("one"), F.sum("both").alias("both"), F.max("size").alias("size"), F.max("most").alias("most"))
    first, second = F.struct(F.col("one").alias("cost"), F.lit(1).alias("step")), F.struct(F.greatest("one", F.col("both") - F.col("one")).alias("cost"), F.lit(2).alias("step"))
    steps = costs.withColumn("s", F.explode(F.when(F.col("size") > 1, F.array(first, second)).otherwise(F.array(first)))).select("*", "s.*")
    own = Window.partitionBy("fp")
    ranked = steps.withColumn("most", F.max("most").over(own)).withColumn("value", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("cost", "step", "seg")))
    need = F.least(F.floor(F.col("c") - 2 * F.col("n") / 3), F.floor((7 * F.col("c") - 6 * F.col("n") + F.col("most")) / 7)) + 1
    taken = materialize(ranked.withColumn("need", need).filter("rank <= need").select("fp", "seg", "step", "cost", "value", "need"), "taken")
    chosen = taken.filter("cost > 0").groupBy("fp", "seg").agg(F.max("step").alias("step"))
    probes = index.filter("own").join(chosen, ["fp", "seg"]).filter((F.col("kind") == "E") | (F.col("step") == 2))
    wanted = F.when(F.col("kind") == "D", F.array(F.lit("E"))).when(F.col("step") == 2, F.array(F.lit("E"), F.lit("D"))).otherwise(F.array(F.lit("E")))
    probes = probes.join(counts.filter("open").select("key"), "key", "left_semi").select("key", F.explode(wanted).alias("kind"), "fp", "root")
    # Segments that can't add up to what a record needs: as many of its rarest shingles, each looked up whole.
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("df", "token"))
    short = live.join(taken.filter("value < need").groupBy("fp").agg(F.max("need").alias("need")), "fp").withColumn("_rank", rank).filter("_rank <= need")
    single = F.lit("T").alias("kind")
    probes = probes.unionByName(short.select(F.col("token").alias("key"), single, "fp", "root"))
    places = index.select("key", "kind", "root").unionByName(live.select(F.col("token").alias("key"), single, "root")).distinct()
    size = live.groupBy("root").agg(F.count_distinct("fp").alias("size"))
    probes = probes.join(size.withColumnRenamed("size", "own_size"), "root")
    places = places.join(size, "root").select("key", "kind", F.col("root").alias("other"), "size")
    met = probes.join(places, ["key", "kind"]).filter("root <> other AND struct(own_size, root) <= struct(size, other)").select(F.col("fp").alias("fp_a"), "other").distinct()
    records = live.groupBy("fp", "root", "n").agg(F.max("c").alias("c"))
    a, b = records.select(*(F.col(x).alias(f"{x}_a") for x in records.columns)), records.withColumnRenamed("root", "other")
    found = met.join(a, "fp_a").join(b.withColumn("root", F.col("other")), "other").filter(_POSSIBLE)
    out = materialize(_pairs(found.select(F.col("fp_a").alias("a"), F.col("fp").alias("b"))), "pairs")
    drop_scratch(index)
    drop_scratch(taken)
    return out


#: Two roots, and live shingles that may suffice.
_POSSIBLE = "root_a <> root AND 4 * least(n_a, n) >= 3 * greatest(n_a, n) AND 7 * least(c_a, c) >= 3 * (n_a + n)"


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id, the least key that can be reached by links."""
    told = materialize(digests(docs, text, key), "digests")
    records = told.filter(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy("fp", "n", "value", "need", "value_below").agg(F.min(key).alias("rep"))
    records = materialize(records, "records")
    buckets = max(12, (records.agg(F.sum("n")).first()[0] or 0) // _ENTRIES + 1)
    named = docs.filter(F.col(key).isNotNull())
    entries = materialize(shared_entries(packed_keys(named, buckets, text, key)), "entries")
    # Where a hash falls so badly that a record has too few segments to tell, all records stay open.
    hard = not records.filter("value < need OR value_below > 0 AND value_below < floor(2 * n / 7) + 1").isEmpty()

    left = _narrow(entries.withColumn("root", F.col("fp")), records, 2)
    drop_scratch(entries)
    opened = records if hard else records.join(left.select("fp").distinct(), "fp", "left_semi")
    sets = materialize(set_table(named, opened, text, key), "sets")
    links = [linked(_hub_pairs(left), sets)]
    roots = components(links[0])
    placed = materialize(_rooted(left, roots), "placed")
    drop_scratch(left)
    still = _narrow(placed, records, 1)
    drop_scratch(placed)
    reached = _rooted((sets if hard else sets.join(still.select("fp").distinct(), "fp", "left_semi")).withColumn("root", F.col("fp")), roots)
    live = materialize(reached.select("fp", "n", "root", F.explode("shingles").alias("token"), F.col("n").alias("c")), "live")
    drop_scratch(still)
    while True:
        live = _live(live)
        made = linked(_live_hub_pairs(live), sets)
        open_records, gained = live.select("fp").distinct().count(), made.count()
        if not gained:
            break
        links.append(made)
        roots = components(_all(links))
        moved = materialize(_rooted(live, roots), "live")
        drop_scratch(live)
        live = moved
        if gained < _GAIN * open_records:
            break
    live = _live(live, 1)
    pairs = _allocated_pairs(live)
    made = linked(pairs, sets)
    if not made.isEmpty():
        roots = components(_all([*links, made]))
    for used in (live, sets, pairs):
        drop_scratch(used)

    named_roots = _rooted(records.withColumn("root", F.col("fp")), roots)
    smallest = named_roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(named_roots.join(smallest, "root").select("fp", "component_id"), "classes")
    out = told.withColumn("_fp", F.when(F.col(key).isNotNull() & (F.col("n") > 0), F.col("fp"))).join(classes.withColumnRenamed("fp", "_c"), F.col("_fp") == F.col("_c"), "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col(key)).alias("component_id"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with root from the table of roots, by fp."""
    told = roots.select(F.col("node").alias("fp"), F.col("root").alias("_root"))
    return rows.join(told, "fp", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")


def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
