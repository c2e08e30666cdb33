import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import spelling
from tideline.llm.spelling import affected, decompose, gram_dictionary, near_words, op12, spelling_variants, word_counts

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near_of(words):
    """Near words by brute force over the strings that two of them have in common with one code point left out or masked."""
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault(("mask", w[:i], w[i + 1 :]), set()).add(w)
            by.setdefault(("cut", w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for key, group in by.items():
        if key[0] == "mask":
            for w in group:
                near[w] |= group - {w}
        elif key[1] in near:
            near[key[1]] |= group
            for w in group:
                near[w].add(key[1])
    return near


def variants(n):
    near = near_of(n)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def vocabulary():
    """Words with many variants, few letters (long lists), and chains of forms."""
    rng = random.Random(4)
    n = {}
    for _ in range(260):
        w = "".join(rng.choice("abeé" if rng.random() < 0.5 else "abcdefghijklmnopqrstuvwxyzü") for _ in range(rng.choice([5, 5, 6, 7, 8, 9, 10, 11, 14, 22])))
        n[w] = rng.choice([3, 4, 8, 16, 50, 200])
        for _ in range(rng.randint(0, 6)):
            i, c = rng.randrange(len(w)), rng.choice("abeéz")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c, c + w])
            if len(w) >= 5:
                n[w] = rng.choice([3, 3, 6, 12, 100])
    return n | {"a" * i: 2**i for i in range(5, 30)}


@pytest.mark.parametrize(("common", "split"), [(2, 4096), (32, 4096), (0, 3)])
def test_variants_match_brute_force(spark, vocabulary, monkeypatch, common, split):
    monkeypatch.setattr(spelling, "COMMON", common)
    monkeypatch.setattr(spelling, "SPLIT", split)
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long").withColumn("form", F.lit("x"))
    assert rows_of(spelling_variants(words)) == variants(vocabulary)


def test_bounds_hold_for_every_edit(spark, vocabulary):
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    known = gram_dictionary(words, 5)
    for low, high, longest in spelling.BANDS:
        for w in [w for w in vocabulary if len(w) >= low and (high is None or len(w) <= high)][:60]:
            marked = spelling.OPENS + w + spelling.CLOSES
            grams = decompose(marked, known, longest)
            bound = affected(marked, grams, longest)
            assert bound < len(grams)
            for i in range(1, len(marked)):
                for other, shift in ((marked[:i] + "b" + marked[i:], 1), (marked[:i] + marked[i + 1 :], -1), (marked[:i] + "b" + marked[i + 1 :], 0)):
                    if i == len(marked) - 1 and shift < 1:
                        continue
                    theirs = set(decompose(other, known, longest))
                    kept = sum((p, g) in theirs if p < i else (p + shift, g) in theirs for p, g in grams)
                    assert len(grams) - kept <= bound


def test_counts_and_odd_tables(spark, docs, texts):
    assert {r.word: r.n for r in word_counts(docs).collect()} == counted(texts.items())
    odd = spark.createDataFrame([(None, "Straße STRASSE straße"), (1, None), (2, ""), (2, "ÀÉÎ×÷ àbcdefg"), (2, "ÀÉÎ×÷ àbcdefg")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()] * 3
    assert {r.word: r.n for r in word_counts(odd.union(odd).union(odd)).collect()} == counted(rows)
    assert spelling_variants(word_counts(docs.limit(0))).count() == 0
    assert near_words(spark.createDataFrame([("lonely",)], "word string")).count() == 0


def test_query(spark, tmp_path, docs, texts):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == variants(counted(texts.items()))
