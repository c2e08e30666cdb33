"""Token counts without tokens: a word-end BPE vocabulary compiled into counting transducers.

Two deterministic transducers in cascade read the normalized bytes of a text.

1. The *splitter* (five states) marks where the words of the vocabulary's pattern begin. A chunk of bytes is a map of
   its five entry states to exit states; the maps of all chunks are composed by a parallel prefix scan, which gives
   every chunk its entry state.
2. The *counter* reads a word's bytes, the last of them as a symbol of its own, and emits the change of the number of
   tokens on every transition. Its state is what the merges can still reach back to: the longest end of the word so far
   that begins a token, and, for each place in it, the last token and the number of tokens up to there. The token that
   ends at a place is the only one that is compatible with the last token where it begins, and all but that token stay
   as they were; so a transition needs no more than the state. Transitions are compiled when first met and kept in a
   table, up to ``MOST_STATES``; beyond, the table is emptied between blocks and fills again.
   All chunks advance at once. A chunk that ends with a word maps every entry state to the state at a word's start, so
   chunks are cut at words where they can be. Those inside one long word are taken to enter at that state too, and are
   run again from the exits of those before them, until no entry state changes.

Special strings of the vocabulary in a text are one token each, as the library has it. Texts without code points from
U+0300 on are lower-cased by a table; others go through the library's normalizer. Character kinds are asked of the library
once for every code point.

Null and empty texts have no bytes and no tokens. A very long text is cut at white space into blocks, so memory follows
the block (or a longer word). Repeated rows are counted as often as they occur; an empty table gives an empty result.
Other columns stay; those with the name of a result are replaced.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import others, table

BLOCK = 1 << 18
CHUNK = 64
MOST_STATES = 150_000
END = 256
#: Character kinds, and the splitter's states.
SPACE, LETTER, NUMBER, OTHER, SHORT, LONG, INNER = range(7)
BETWEEN, IN_LETTERS, IN_OTHERS, ONE_LEFT, TWO_LEFT = range(5)
#: splitter[state][kind] = (next state, a word begins). SHORT and LONG are apostrophes with a contraction of one or two
#: letters behind them; inside other characters they begin nothing.
_NEXT = {
    BETWEEN: (BETWEEN, IN_LETTERS, BETWEEN, IN_OTHERS, ONE_LEFT, TWO_LEFT),
    IN_LETTERS: (BETWEEN, IN_LETTERS, BETWEEN, IN_OTHERS, ONE_LEFT, TWO_LEFT),
    IN_OTHERS: (BETWEEN, IN_LETTERS, BETWEEN, IN_OTHERS, IN_OTHERS, IN_OTHERS),
    ONE_LEFT: (BETWEEN,) * 6,
    TWO_LEFT: (ONE_LEFT,) * 6,
}
_BEGINS = {
    BETWEEN: (0, 1, 1, 1, 1, 1),
    IN_LETTERS: (0, 0, 1, 1, 1, 1),
    IN_OTHERS: (0, 1, 1, 0, 0, 0),
    ONE_LEFT: (0,) * 6,
    TWO_LEFT: (0,) * 6,
}
STEP = np.array([[*_NEXT[s], s] for s in range(5)], dtype=np.uint8)
BEGINS = np.array([[*_BEGINS[s], 0] for s in range(5)], dtype=bool)
#: The contractions that the vocabulary's pattern takes as words.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Prefix composition of state maps, one a row: row k of the result maps a state through maps 0 to k."""
    out, gap = maps.copy(), 1
    while gap < len(out):
        out[gap:] = np.take_along_axis(out[gap:], out[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return out


def split_starts(kinds: np.ndarray) -> np.ndarray:
    """Where words begin in a sequence of character kinds that starts between words."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, INNER, dtype=np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(5, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = STEP[maps, column[:, None]]
    state = np.zeros(chunks, dtype=np.uint8)
    state[1:] = scan_maps(maps)[:-1, BETWEEN]
    begins = np.empty((CHUNK, chunks), dtype=bool)
    for j, column in enumerate(columns):
        begins[j] = BEGINS[state, column]
        state = STEP[state, column]
    return begins.T.reshape(-1)[:n]


def chunk_starts(symbols: np.ndarray) -> np.ndarray:
    """Starts of chunks of about CHUNK symbols. They are starts of words, but for those inside words of over CHUNK symbols."""
    words = np.concatenate([[0], np.flatnonzero(symbols[:-1] >= END) + 1])
    near = np.searchsorted(words, np.arange(0, len(symbols), CHUNK))
    cuts = words[np.minimum(near, len(words) - 1)]
    sizes = np.diff(words, append=len(symbols))
    long = np.flatnonzero(sizes > CHUNK)
    inner = [np.arange(words[w], words[w] + sizes[w], CHUNK) for w in long]
    return np.unique(np.concatenate([words[:1], cuts, *inner]))


class Merges:
    """The vocabulary's merges over symbols: characters of code 0 to 255 for bytes, 256 more for the last byte of a word."""

    def __init__(self, model: dict):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        suffix = model["end_of_word_suffix"]

        def symbols(token):
            ends = token.endswith(suffix) and len(token) > len(suffix)
            codes = [byte_of[c] for c in (token[: -len(suffix)] if ends else token)]
            codes[-1] += END * ends
            return "".join(map(chr, codes))

        self.ranks = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(model["merges"])}
        self.parts = list(self.ranks)
        #: Every token and the rank of the merge that makes it, -1 for single symbols.
        self.born = {symbols(t): -1 for t in model["vocab"]} | {a + b: i for (a, b), i in self.ranks.items()}
        self.longest = max(map(len, self.born))
        self.heads = {t[:i] for t in self.born for i in range(len(t))}
        self.known: dict[str, bool] = {}

    def encode(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: str) -> bool:
        """Whether a string of symbols is a token that its own merges make."""
        if token not in self.known:
            self.known[token] = token in self.born and self.encode(token) == [token]
        return self.known[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether two whole tokens stand side by side when their text is encoded: no merge ever joins them.

        The pieces at the seam are followed back in time, the later made one first, each with the rank of the merge that
        ends it. Of merges of one rank the leftmost comes first.
        """
        left_ends = right_ends = len(self.ranks)
        while True:
            rank = self.ranks.get((left, right), len(self.ranks))
            if rank < left_ends and rank <= right_ends and rank < len(self.ranks):
                return False
            made_left, made_right = self.born[left], self.born[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left_ends, left = made_left, self.parts[made_left][1]
            else:
                right_ends, right = made_right, self.parts[made_right][0]


class Counter:
    """The counting transducer, compiled as its transitions are met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.states = [("", (("", 0),))]
        self.ids = {self.states[0]: 0}
        self.column = np.full(2 * END, -1, dtype=np.int32)
        self.columns = 0
        self.step = np.full((1024, 64), -1, dtype=np.int32)
        self.emit = np.zeros((1024, 64), dtype=np.int8)

    def columns_of(self, symbols: np.ndarray) -> np.ndarray:
        new = np.flatnonzero((np.bincount(symbols, minlength=2 * END) > 0) & (self.column < 0))
        self.column[new] = np.arange(self.columns, self.columns + len(new))
        self.columns += len(new)
        self.symbols = np.zeros(self.columns, dtype=np.int32)
        used = np.flatnonzero(self.column >= 0)
        self.symbols[self.column[used]] = used
        self._grow()
        return self.column[symbols]

    def _grow(self) -> None:
        rows, width = self.step.shape
        more_rows, more_width = rows, width
        while more_rows < len(self.states):
            more_rows *= 2
        while more_width < self.columns:
            more_width += 64
        if (more_rows, more_width) != (rows, width):
            step = np.full((more_rows, more_width), -1, dtype=np.int32)
            emit = np.zeros((more_rows, more_width), dtype=np.int8)
            step[:rows, :width], emit[:rows, :width] = self.step, self.emit
            self.step, self.emit = step, emit

    def _compile(self, state: int, column: int) -> None:
        tail, marks = self.states[state]
        symbol = int(self.symbols[column])
        text = tail + chr(symbol)
        # marks[j] is (last token, tokens) at place j of the tail; the count at its end is 0.
        for start in range(len(text)):
            token, before = text[start:], marks[start][0]
            if token in self.merges.born and self.merges.whole(token) and (not before or self.merges.compatible(before, token)):
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        delta = marks[start][1] + 1
        if symbol >= END:
            target = 0
        else:
            begin = next(i for i in range(len(text) + 1) if text[i:] in self.merges.heads)
            after = (*((last, n - delta) for last, n in marks), (token, 0))[begin:]
            key = (text[begin:], after)
            target = self.ids.setdefault(key, len(self.states))
            if target == len(self.states):
                self.states.append(key)
                self._grow()
        self.step[state, column], self.emit[state, column] = target, delta

    def advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self.step[state, column]
        if (after < 0).any():
            missing = np.flatnonzero(after < 0)
            for key in np.unique(state[missing].astype(np.int64) << 32 | column[missing]):
                self._compile(int(key >> 32), int(key & 0xFFFFFFFF))
            after = self.step[state, column]
        return after, self.emit[state, column]

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """The change of the token count at every symbol; sums over whole words are their numbers of tokens."""
        if len(self.states) > MOST_STATES:
            self.reset()
        n = len(symbols)
        columns = self.columns_of(symbols)
        starts = chunk_starts(symbols)
        lengths = np.diff(starts, append=n)
        emitted = np.zeros(n, dtype=np.int8)
        leaves = np.zeros(len(starts), dtype=np.int32)
        entered = np.zeros(len(starts), dtype=np.int32)
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[np.argsort(-lengths[todo], kind="stable")]
            state, first, size = entered[todo], starts[todo], lengths[todo]
            for j in range(int(size[0])):
                live = int(np.searchsorted(-size, -j, side="left"))
                at = first[:live] + j
                state[:live], emitted[at] = self.advance(state[:live], columns[at])
            leaves[todo] = state
            enters = np.concatenate([[0], leaves[:-1]]).astype(np.int32)
            todo = np.flatnonzero(enters != entered)
            entered = enters
        return emitted


class TokenCounter:
    """texts -> token counts, for a vocabulary file of the kind this module's docstring describes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.counter = Counter(Merges(spec["model"]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kind_of = np.full(0x110000, INNER, dtype=np.uint8)
        self.asked = np.zeros(0x110000, dtype=bool)
        self.lower = {c: self.library.normalizer.normalize_str(chr(c)) for c in range(0x300)}

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if max(text) < "̀":
            return text.translate(self.lower)
        return self.library.normalizer.normalize_str(text)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """Kinds of characters; what isn't known yet is asked of the library's splitter."""
        for code in np.unique(codes[~self.asked[codes]]).tolist():
            c = chr(code)
            parts = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}a{c}{c}a")]
            if c.isspace() and self.library.normalizer.normalize_str(f"a{c}a") == "a a" or code == 32:
                kind = SPACE
            elif len(parts) == 1:
                kind = LETTER
            else:
                kind = NUMBER if len(parts) == 6 else OTHER
            self.kind_of[code], self.asked[code] = kind, True
        return self.kind_of[codes]

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For a normalized text: the places of its letters in bytes, and the running number of tokens at every byte."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kinds = self._kinds(codes).copy()
        ahead = np.zeros((2, len(codes)), dtype=np.uint32)
        ahead[0, :-1], ahead[1, :-2] = codes[1:], codes[2:]
        quotes = np.flatnonzero(codes == 39)
        for c in CONTRACTIONS:
            fits = quotes[ahead[0, quotes] == ord(c[1])]
            if len(c) == 3:
                fits = fits[ahead[1, fits] == ord(c[2])]
            kinds[fits] = SHORT if len(c) == 2 else LONG
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[lead] = split_starts(kinds)
        begins[-1] = True
        inside = np.ones(len(data) + 1, dtype=bool)
        inside[lead] = kinds != SPACE
        inside[-1] = False
        symbols = data.astype(np.int32)
        symbols[inside[:-1] & (begins[1:] | ~inside[1:])] += END
        total = np.zeros(len(data) + 1, dtype=np.int64)
        taken = np.flatnonzero(inside[:-1])
        if len(taken):
            total[taken + 1] = self.counter.emissions(symbols[taken])
        return lead, np.cumsum(total)

    def count(self, texts: list[str | None]) -> np.ndarray:
        counts = np.zeros(len(texts), dtype=np.int64)
        waiting, sizes, owners = [], [], []

        def flush():
            if waiting:
                lead, total = self._block(" ".join(waiting))
                at = np.cumsum([0, *(n + 1 for n in sizes)])
                lead = np.append(lead, len(total) - 1)
                first, last = lead[at[:-1]], lead[np.minimum(at[1:] - 1, len(lead) - 1)]
                np.add.at(counts, owners, total[last] - total[first])
                waiting.clear(), sizes.clear(), owners.clear()

        for i, text in enumerate(texts):
            for piece in self._pieces(text or "", counts, i):
                if sum(sizes) + len(piece) > BLOCK:
                    flush()
                waiting.append(piece), sizes.append(len(piece)), owners.append(i)
        flush()
        return counts

    def _pieces(self, text: str, counts: np.ndarray, i: int):
        """Normalized pieces of a text, cut at its special strings (counted here) and, where long, before white space."""
        at = 0
        cuts = [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special and "<|" in text else []
        counts[i] += len(cuts)
        for start, end in [*cuts, (len(text), len(text))]:
            while at < start:
                stop = start
                if start - at > BLOCK:
                    blank = re.compile(r"[ \n\t]").search(text, at + BLOCK, start)
                    stop = blank.start() if blank else start
                yield self.normalized(text[at:stop])
                at = stop
            at = end


@cache
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        return pa.array(token_counter(path).count(column.to_pylist()), pa.int64())

    plain = F.coalesce(F.col(text), F.lit(""))
    values = {"n_bytes": F.octet_length(plain).cast("long"), "n_tokens": counted(plain)}
    out = docs.select(*others(docs, *values, "over_limit"), *(v.alias(k) for k, v in values.items()))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
