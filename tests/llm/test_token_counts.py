import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import token_counts
from tideline.llm.token_counts import STEP, TokenCounter, chunk_starts, count_tokens, scan_maps

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    vocabulary = Tokenizer.from_file(PATH)
    return lambda text: len(vocabulary.encode(text or "", add_special_tokens=False).ids)


def test_counts_match_the_library(spark, docs, texts, library):
    got = {r.doc_id: r for r in count_tokens(docs.withColumn("N_TOKENS", F.lit("x")), PATH).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: library(t) for i, t in texts.items()}
    assert all(r.n_bytes == len((texts[i] or "").encode()) and r.over_limit == (r.n_tokens > 2048) and r.n == "n" for i, r in got.items())
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_random_strings(library):
    rng = random.Random(7)
    parts = ["'s't're'lle'", "İßẞΣσςAÀé", "́̀e̸>", "123٣", "  \n\t\x85\x1c　", "!?'\"-_", "日本語한", "😂🇺🇸", "<|endoftext|>", "<|ENDOFTEXT|>", "aaaa", "\x00​", "lolthe"]
    said = []
    for _ in range(4000):
        some = [rng.choice(parts) for _ in range(rng.randint(0, 10))]
        said.append("".join(p if rng.random() < 0.3 else "".join(rng.choice(p) for _ in range(rng.randint(1, 6))) for p in some))
    said += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    assert TokenCounter(PATH).count(said).tolist() == [library(s) for s in said]


def test_words_longer_than_chunks_and_texts_longer_than_blocks(library, monkeypatch):
    rng = random.Random(8)
    said = ["a" * 5000, "ab" * 701, "lol" * 900, "haha" * 300 + "h", "😂" * 500, "".join(rng.choice("etaoin") for _ in range(4000))]
    said.append(" ".join("".join(rng.choice("etaoinshr'") for _ in range(rng.randint(1, 150))) for _ in range(300)) + "<|endoftext|>é́ x" * 40)
    want = [library(s) for s in said]
    assert TokenCounter(PATH).count(said).tolist() == want
    monkeypatch.setattr(token_counts, "BLOCK", 200)
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    assert TokenCounter(PATH).count([*said, None, ""]).tolist() == [*want, 0, 0]


def test_scan_composes_maps():
    rng = random.Random(9)
    kinds = [rng.randrange(7) for _ in range(100)]
    maps = scan_maps(STEP[:, kinds].T.copy())
    for enter in range(5):
        state = enter
        for k, kind in enumerate(kinds):
            state = STEP[state, kind]
            assert maps[k, enter] == state


def test_chunks_cover_everything():
    import numpy as np

    symbols = np.full(1000, 97)
    symbols[[5, 9, 300, 640, 999]] = 256 + 97
    starts = chunk_starts(symbols)
    assert starts[0] == 0 and (np.diff(starts) > 0).all() and (np.diff(starts, append=1000) <= 2 * token_counts.CHUNK).all()
