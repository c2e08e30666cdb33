"""Best-fit packing of token pieces by a grouping genetic algorithm, on islands with elite migration.

Texts are tokenized and closed by an end id; texts over the capacity are cut so that all pieces but the first are
full. Full pieces are sequences already. The others are dealt into shards of bounded size, and several islands work on
each shard: an island's individuals are whole packings, crossover injects the other parent's well-filled bins, drops the
bins that now hold a piece twice, and best-fits the displaced pieces. Between epochs the best packings of a shard's
islands migrate to its other islands. Bins that stay poorly filled are dealt again, over all shards, until one shard is left.

Null and empty texts are one piece of the end id. Repeated rows are packed as often as they occur. Memory follows the
shard's size, not the table's, and the ids of one text; a very long one is one row. Other columns aren't read. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize

#: Texts of these characters alone are split alike by both tokenizer libraries; all others go to the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")


@cache
def _encoder(path: str, ranks_path: str | None):
    """text -> ids of the vocabulary at path. The rank file holds the same vocabulary for a library that is four times as fast."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    if not ranks_path:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text):
        if _PLAIN.fullmatch(text) and not any(s in text for s in special):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, ranks_path: str | None = None, end: int = 2, capacity: int = 1024, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every text."""

    def run(batches):
        encode = _encoder(path, ranks_path)
        for b in batches:
            rows = []
            for key, t in zip(b.column(0), b.column(1), strict=True):
                ids = np.array([*encode(t.as_py() or ""), end], dtype="<u4")
                rows += [(key.as_py(), i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins under construction, with their free room kept sorted for best fit."""

    def __init__(self, sizes, capacity: int):
        self.sizes, self.capacity, self.bins, self.room = sizes, capacity, [], []

    def add(self, items: list[int]) -> None:
        insort(self.room, (self.capacity - sum(self.sizes[i] for i in items), len(self.bins)))
        self.bins.append(items)

    def best_fit(self, item: int) -> None:
        size = self.sizes[item]
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            self.add([item])
            return
        free, b = self.room.pop(at)
        self.bins[b].append(item)
        insort(self.room, (free - size, b))


def fit_in_order(sizes, order, capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    made = Bins(sizes, capacity)
    for b in start:
        made.add(b)
    for i in order:
        made.best_fit(i)
    return made.bins


def fitness(bins: list[list[int]], sizes, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller full ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], sizes, capacity: int, rng) -> list[list[int]]:
    """b's well-filled bins, whole, then a's bins without their pieces; the pieces left over are best-fitted by size."""
    full = [x for x in b if sum(sizes[i] for i in x) >= capacity * 0.995]
    taken = [full[i] for i in rng.permutation(len(full))[: max(1, len(full) // 2)]] if full else []
    inside = {i for x in taken for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    poor = sorted(kept, key=lambda x: sum(sizes[i] for i in x))[: max(1, len(kept) // 20)]
    chosen = {id(x) for x in poor}
    displaced += [i for x in poor for i in x]
    kept = [x for x in kept if id(x) not in chosen]
    return fit_in_order(sizes, sorted(displaced, key=lambda i: -sizes[i]), capacity, [list(x) for x in taken] + kept)


def evolve(sizes, capacity: int, seed: int, settled: list[list[list[int]]], population: int = 3, generations: int = 3) -> list[list[int]]:
    """The best packing that an island finds, from the packings that migrated to it and its own first ones."""
    rng = np.random.default_rng(seed)
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    crowd = [[list(b) for b in s] for s in settled] or [fit_in_order(sizes, down, capacity)]
    noise = np.asarray(sizes, dtype=float)
    least = -(-sum(sizes) // capacity)
    while len(crowd) < population:
        crowd.append(fit_in_order(sizes, np.argsort(-noise * rng.uniform(0.8, 1.2, len(sizes)), kind="stable").tolist(), capacity))
    score = lambda x: fitness(x, sizes, capacity)
    for _ in range(generations):
        crowd.sort(key=score, reverse=True)
        if len(crowd[0]) <= least:
            break
        i, j = rng.choice(len(crowd), 2, replace=False)
        child = crossover(crowd[i], crowd[j], sizes, capacity, rng)
        if score(child) > score(crowd[-1]):
            crowd[-1] = child
    return max(crowd, key=score)


def _labels(bins, n):
    out = np.zeros(n, dtype=np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _bins(labels) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(np.asarray(labels)[order])) + 1)]


def _island(capacity: int, seed: int, epoch: int, names: list[str]):
    """One epoch of one island: (uid, length, shard, island, m0...) of a shard in, its best packing out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes, shard, island = pdf["length"].tolist(), int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        settled = [_bins(pdf[m].to_numpy()) for m in names if pdf[m].iloc[0] >= 0]
        best = evolve(sizes, capacity, seed * 1_000_003 + shard * 101 + island * 11 + epoch, settled)
        bins, fuller = fitness(best, sizes, capacity)
        out = pdf[["uid", "length", "shard", "island"]]
        return out.assign(bin=_labels(best, len(sizes)), score=bins * 1e6 + fuller)

    return run


def pack_shards(items: DataFrame, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(uid, length, shard) with bin, its place in the shard's best packing. State between epochs is each island's best."""
    spread = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    names = [f"m{i}" for i in range(islands)]
    state = spread.select("uid", "length", "shard", "island", *[F.lit(-1).alias(m) for m in names])
    for epoch in range(epochs):
        found = state.groupBy("shard", "island").applyInPandas(_island(capacity, seed, epoch, names), "uid long, length long, shard long, island int, bin int, score double")
        found = materialize(found, "islands")
        if epoch + 1 < epochs:
            elite = found.groupBy("uid").agg(*[F.max(F.when(F.col("island") == i, F.col("bin"))).alias(f"m{i}") for i in range(islands)])
            state = found.select("uid", "length", "shard", "island").join(elite, "uid")
    best = found.groupBy("shard", "island").agg(F.max("score").alias("score")).groupBy("shard").agg(F.max_by("island", F.struct("score", -F.col("island"))).alias("island"))
    return found.join(best, ["shard", "island"], "left_semi").select("uid", "length", "shard", "bin")


def pack(pieces: DataFrame, capacity: int = 1024, shard_items: int = 4096, islands: int = 2, epochs: int = 2, good: float = 0.97, seed: int = 5) -> DataFrame:
    """pieces (with uid and length) and their sequence_id and offset.

    Rounds: every shard's bins that are at least ``good`` full are final; the rest are dealt anew over all shards. The
    last round, of one shard, keeps all its bins; so does one in which no bin gets so full, as more rounds wouldn't.
    """
    spark = pieces.sparkSession
    items = pieces.filter(F.col("length") < capacity).select("uid", "length")
    done, n, level = [], items.count(), 0
    while n:
        shards = max(1, -(-n // shard_items))
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
        packed = pack_shards(dealt, capacity, islands, epochs, seed + level)
        filled = packed.groupBy("shard", "bin").agg(F.sum("length").alias("filled"))
        packed = materialize(packed.join(filled, ["shard", "bin"]), "packed")
        poor = packed.filter(F.col("filled") < good * capacity)
        left = poor.count()
        last = shards == 1 or left == n
        final = packed if last else packed.filter(F.col("filled") >= good * capacity)
        done.append(final.select("uid", "length", F.xxhash64(F.lit(level), "shard", "bin").alias("sequence_id")))
        items, n, level = poor.select("uid", "length"), 0 if last else left, level + 1
    placed = spark.createDataFrame([], "uid long, length long, sequence_id long")
    for d in done:
        placed = placed.unionByName(d)
    before = F.sum("length").over(_window())
    placed = placed.select("uid", "sequence_id", (before - F.col("length")).alias("offset"))
    full = pieces.filter(F.col("length") == capacity)
    full = full.withColumn("sequence_id", F.xxhash64(F.lit("full"), "uid")).withColumn("offset", F.lit(0).cast("long"))
    return pieces.filter(F.col("length") < capacity).join(placed, "uid").unionByName(full)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    pieces = token_pieces(docs, path, ranks_path, end, capacity)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8(spark, sf_dir):
    import public_tokenizers

    from tideline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
