"""Anchors and hashed windows, which the operators on repeated strings and passages share.

Every window of L units picks one anchor inside itself (see hashing). The phrase from the anchor, of L - w + 1 units,
lies inside the window, so a window can repeat only where its anchor's phrase does. Windows that an operator can't decide
by phrases are hashed one by one, to 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.hashing import BYTE_VALUES, Prefix, binary_parts, blocks, signed, window_minima, word_values

_BLOCK = 1 << 20
_SEGMENT = 1 << 20


@dataclass(frozen=True)
class Units:
    """What a text is made of, and the sizes of windows: length units a window, w the anchor window, gram the anchor's own size."""

    kind: str
    length: int
    w: int
    gram: int

    @property
    def phrase(self) -> int:
        return self.length - self.w + 1

    @property
    def block(self) -> int:
        return max(1, self.w // 8)

    def of(self, data: np.ndarray, offsets: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Values of the units of some texts, and each text's offset in units."""
        if self.kind == "words":
            return word_values(data, offsets, family)
        return BYTE_VALUES[family][data], offsets


BYTES_400 = Units("bytes", 400, 128, 12)
WORDS_50 = Units("words", 50, 16, 3)


def _anchor_rows(values, offsets, units: Units, known: bool = False):
    """(text, pos, back_lo, back_hi, phrase, place in values) of the anchors of the windows in some texts.

    known: the first window belongs to what came before and only tells whether its anchor is known already.
    """
    starts, ends = offsets[:-1], offsets[1:] - units.length
    fits = np.flatnonzero(ends >= starts)
    if not len(fits):
        return None
    prefix = Prefix(values)
    least = window_minima(prefix.grams(units.gram), units.w)
    counts = ends[fits] - starts[fits] + 1
    text = np.repeat(fits, counts)
    i = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[fits], counts)
    pos = least[i]
    edge = np.flatnonzero((pos[1:] != pos[:-1]) | (text[1:] != text[:-1])) + 1
    lo_at, hi_at = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(i) - 1]])
    text, pos, lo, hi = text[lo_at], pos[lo_at], i[lo_at], i[hi_at]
    lo[0] += known
    keep = lo <= hi
    text, pos, lo, hi = (x[keep] for x in (text, pos, lo, hi))
    return text, pos - offsets[text], pos - lo, pos - hi, prefix.at(pos, pos + units.phrase), pos


def anchors(docs: DataFrame, units: Units, text: str = "text", key: str = "doc_id", head: bool = False) -> DataFrame:
    """A row per anchor: phrase, key, pos, and back_lo and back_hi: its windows start so many units before it.

    head, for bytes: with the number of the first 8 bytes from the anchor, which sorts as they do.
    """
    names = ["phrase", key, "pos", "back_lo", "back_hi", "head"][: 5 + head]

    def batch(keys, found, part, shift=0):
        t, pos, lo, hi, phrase, at = found
        cols = [signed(phrase), keys.take(pa.array(t)), *(pa.array(x.astype(k)) for x, k in ((pos + shift, np.int32), (lo, np.int16), (hi, np.int16)))]
        if head:
            first = np.zeros(len(at), dtype=np.uint64)
            for i in range(8):
                first = (first << np.uint64(8)) | part[at + i].astype(np.uint64)
            cols.append(signed(first ^ np.uint64(1 << 63)))
        return pa.record_batch(cols, names=names)

    def run(batches):
        for b in batches:
            data, offsets = binary_parts(b.column(1))
            for i, j in blocks(offsets, _BLOCK):
                keys, part = b.column(0).slice(i, j - i), data[offsets[i] : offsets[j]]
                values, at = units.of(part, offsets[i : j + 1] - offsets[i])
                if len(values) <= 2 * _SEGMENT:
                    if found := _anchor_rows(values, at, units):
                        yield batch(keys, found, part)
                    continue
                for s in range(0, len(values), _SEGMENT):  # one long text, by segments of window starts
                    a, last = max(0, s - 1), min(s + _SEGMENT + units.length - 1, len(values))
                    if found := _anchor_rows(values[a:last], np.array([0, last - a]), units, s > 0):
                        yield batch(keys, found, part[a:last], a)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).filter(F.col(key).isNotNull())
    return rows.mapInArrow(run, f"phrase long, {key} {kind}, pos int, back_lo short, back_hi short" + ", head long" * head)


def by_text(anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows in order of key and pos, all of a key in one partition, for whole_texts."""
    return anchors.repartition(key).sortWithinPartitions(key, "pos")


def whole_texts(batches):
    """Batches, in order of their first column, cut so that all rows of a key are in one; and for each row the number of its key in the batch."""
    rest = None
    for b in batches:
        b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        keys = b.column(0)
        change = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1
        cut = int(change[-1]) if len(change) else 0
        rest = b.slice(cut)
        if cut:
            yield b.slice(0, cut), np.searchsorted(change, np.arange(cut), side="right")
    if rest is not None:
        yield rest, np.zeros(rest.num_rows, dtype=np.int64)


def window_rows(docs: DataFrame, ranges: DataFrame, units: Units, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(h1, h2, key, at) of the windows that start in a text's ranges."""

    def run(batches):
        for b in batches:
            data, offsets = binary_parts(b.column(1))
            for r in range(b.num_rows):
                part = data[offsets[r] : offsets[r + 1]]
                spans = b.column(2)[r].values
                lo, hi = (np.asarray(x).astype(np.int64) for x in spans.flatten())
                n = hi - lo + 1
                at = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))
                hashes = [hashed_ranges(part, at, at + units.length, units, family) for family in (0, 1)]
                keys = b.column(0).take(pa.array(np.full(len(at), r)))
                yield pa.record_batch([signed(hashes[0]), signed(hashes[1]), keys, pa.array(at.astype(np.int32))], names=["h1", "h2", key, "at"])

    kind = docs.schema[key].dataType.simpleString()
    per_text = ranges.groupBy(key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = docs.select(key, text).join(per_text, key)
    return joined.mapInArrow(run, f"h1 long, h2 long, {key} {kind}, at int")


def hashed_ranges(part: np.ndarray, start: np.ndarray, end: np.ndarray, units: Units, family: int) -> np.ndarray:
    """Hashes of ranges of one text's units, by blocks of a long one; ranges are shorter than a block."""
    values, _ = units.of(part, np.array([0, len(part)]), family)
    if len(values) <= _SEGMENT:
        return Prefix(values, family).at(start, end)
    out = np.empty(len(start), dtype=np.uint64)
    order = np.argsort(start, kind="stable")
    for s in range(0, len(values), _SEGMENT):
        i, j = np.searchsorted(start[order], [s, s + _SEGMENT])
        if j > i:
            which = order[i:j]
            out[which] = Prefix(values[s : int(end[which].max())], family).at(start[which] - s, end[which] - s)
    return out


def union(spans: pa.Scalar) -> np.ndarray:
    """(n, 2) disjoint sorted ranges that cover the same units; touching ranges become one."""
    if spans.values is None or not len(spans.values):
        return np.zeros((0, 2), dtype=np.int64)
    s, e = (np.asarray(x).astype(np.int64) for x in spans.values.flatten())
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return np.stack([s[new], e[np.concatenate([new[1:] - 1, [len(e) - 1]])]], axis=1)
