import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import matching, ngram_join
from tideline.llm.components import components
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.matching import Units
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.substring_lz import dedup_words, factors, op3, reference_index
from tideline.llm.suffix_dedup import SuffixIndex, dedup_bytes, op2

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    from tests.llm.conftest import WORD

    return WORD.findall(text or "")


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_match_brute_force(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    want = brute_components(texts)
    assert sum(c != d for d, (_, c) in want.items()) > 40
    assert got == want


def test_near_duplicates_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (1, "A B c d e f g"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None), (3, 1), (3, 1), (1, 1), (2, 2)], key=str)


@pytest.mark.parametrize("operator", [near_duplicates, dedup_lines, dedup_words, dedup_bytes])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_records_take_the_exact_way(spark, monkeypatch):
    """Where segments can't add up, records that share a shingle are compared."""
    monkeypatch.setattr(ngram_join, "differences", lambda n: n * 0 + 10**6)
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(60)]
    rows = [(i, " ".join(base[:-1] + [str(i)])) for i in range(4)] + [(9, "something else that is alone here")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_linked_sets_lose_no_more_segments_than_they_differ_in():
    """The pigeonhole: of two sets at the limit of similarity, either one's segments that the other lacks are under need."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 20, 31, 32, 40, 63, 64, 100, 127, 128, 250, 600):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, n // 4 + 1)
            add = 0
            while 4 * (n - drop) >= 3 * (n + add + 1):
                add += 1
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            if not len(b):
                continue
            small, large = sorted((a, b), key=len)
            _, keys, own, value, _ = ngram_join.record_keys([small])
            _, other, *_ = ngram_join.record_keys([large])
            need = ngram_join.differences(len(small)) + 1
            assert value[0] >= need
            assert len(set(keys[own].tolist()) - set(other.tolist())) < need


def test_large_groups_around_a_passage_and_an_original(spark):
    """Copies of an absent original with changed words, texts that share most of a passage, and mixtures, in several size bands."""
    rng = random.Random(11)

    def new(k):
        return [f"{rng.randrange(10**9):x}" for _ in range(k)]

    texts, i = {}, 0
    for size in (40, 90, 200, 420):
        original, passage = new(size), new(size * 3 // 4)
        for _ in range(70):
            copy = list(original)
            for _ in range(rng.randrange(0, size // 18 + 1)):
                copy[rng.randrange(size)] = new(1)[0]
            texts[i] = " ".join(copy)
            texts[i + 1] = " ".join(passage + new(rng.randrange(size // 30, size // 3)))
            texts[i + 2] = " ".join(copy[: size * rng.randrange(60, 100) // 100] + new(rng.randrange(0, size // 6)))
            i += 3
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want
    assert 30 < len({c for _, c in want.values()}) < len(texts) - 100


def test_allocated_segments_find_every_pair_of_open_records(spark, monkeypatch):
    """Without rounds of hubs, segments and one-deletion neighbourhoods alone must find the links."""
    for name in ("_hub_pairs", "_live_hub_pairs"):
        monkeypatch.setattr(ngram_join, name, lambda rows: rows.select(rows.fp.alias("a"), rows.fp.alias("b")).filter("a <> b"))
    test_large_groups_around_a_passage_and_an_original(spark)


def brute_spans(seqs, length, rule):
    where = defaultdict(list)
    for d, s in seqs.items():
        for i in range(len(s) - length + 1):
            where[tuple(s[i : i + length])].append((d, i))
    gone = {d: [False] * len(s) for d, s in seqs.items()}
    for places in where.values():
        first = min(d for d, _ in places)
        for d, i in places:
            if (rule == "any" and len(places) > 1) or (rule == "smaller" and first < d):
                gone[d][i : i + length] = [True] * length
    return gone


def test_words_match_brute_force(docs, texts):
    seqs = {d: words(t) for d, t in texts.items()}
    gone = brute_spans(seqs, 50, "smaller")
    for r in dedup_words(docs).collect():
        assert r.n_words == len(seqs[r.doc_id])
        assert r.kept == " ".join(w for w, g in zip(seqs[r.doc_id], gone[r.doc_id], strict=True) if not g)
    assert sum(map(sum, gone.values())) > 500


def test_bytes_match_brute_force(docs, texts):
    seqs = {d: (t or "").encode() for d, t in texts.items()}
    gone = brute_spans(seqs, 400, "any")
    for r in dedup_bytes(docs, batches=3).collect():
        s, g = seqs[r.doc_id], gone[r.doc_id]
        assert r.n_bytes == len(s)
        assert bytes(r.kept) == bytes(c for c, x in zip(s, g, strict=True) if not x)
        assert len(r.removed) == sum(x and not y for x, y in zip(g, [False, *g], strict=False))


def test_the_dedup_queries_match_brute_force(spark, docs, texts, tmp_path):
    """op2 and op3 themselves, on the table with its null, empty, repeated and long texts."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    seqs = {d: (t or "").encode() for d, t in texts.items()}
    gone = brute_spans(seqs, 400, "any")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2(spark, str(tmp_path)).collect()}
    assert got == {
        d: (len(s), sum(gone[d]), sum(x and not y for x, y in zip(gone[d], [False, *gone[d]], strict=False)), sha(bytes(c for c, x in zip(s, gone[d], strict=True) if not x)))
        for d, s in seqs.items()
    }
    lists = {d: words(t) for d, t in texts.items()}
    gone = brute_spans(lists, 50, "smaller")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op3(spark, str(tmp_path)).collect()}
    assert got == {d: (len(w), sum(gone[d]), sha(" ".join(x for x, g in zip(w, gone[d], strict=True) if not g).encode())) for d, w in lists.items()}


@pytest.mark.parametrize("seed", [1, 2, 7])
def test_tangled_repeats_match_brute_force(spark, seed):
    """Small alphabets, periods, pieces of pieces and repeated rows of neighbours: matches that start, end and switch anywhere."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 200))) for _ in range(6)] + ["ab" * 90, "a" * 130, "aab" * 50]
    texts = {}
    for d in range(40):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(pool)
            i = rng.randrange(len(p))
            parts.append(p[i : i + rng.randint(10, 200)] if rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(rng.randint(1, 60))))
        texts[d] = "".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = brute_spans(texts, 60, "any")
    found = {r.doc_id: bytes(r.kept).decode() for r in dedup_bytes(df, Units("bytes", 60, 16, 6), batches=5).collect()}
    assert found == {d: "".join(c for c, g in zip(t, gone[d], strict=True) if not g) for d, t in texts.items()}
    gone = brute_spans(texts, 30, "smaller")
    spaced = df.select("doc_id", F.array_join(F.split("text", ""), " ").alias("text"))
    found = {r.doc_id: r.kept.replace(" ", "") for r in dedup_words(spaced, Units("words", 30, 8, 3)).collect()}
    assert found == {d: "".join(c for c, g in zip(t, gone[d], strict=True) if not g) for d, t in texts.items()}


def test_factors_name_their_reference_block(spark):
    rng = random.Random(4)
    said = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(said)), (2, " ".join(["x", *said[50:250], "y", *said[300:330]])), (3, " ".join(said[100:200]))]
    units = Units("words", 50, 16, 3)
    phrases = matching.anchors(spark.createDataFrame(rows, "doc_id long, text string"), units)
    made = factors(phrases.join(reference_index(phrases), "phrase"), units).filter("phrase IS NULL").collect()
    found = {r.doc_id: (r.lo, r.hi, r.ref, r.ref_pos) for r in made}
    assert set(found) == {2, 3} and len(made) == 2
    for d, shift in ((2, 49), (3, 100)):
        lo, hi, ref, at = found[d]
        assert ref == 1 and at - lo == shift and hi - lo >= 70
    assert phrases.join(reference_index(phrases), "phrase").filter("ref_pos IS NULL").count() == 0


def test_levels_merge_geometrically(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(70)], "phrase long, b long").withColumn("head", F.col("phrase") * 0)
    with SuffixIndex(spark, 2) as index:
        sizes = []
        for b in range(5):
            index.add(df.filter(df.b % 5 == b).select("head", "phrase"))
            sizes.append([n for n, _ in index.levels])
        names = list(index.tables)
        assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]
        assert spark.table(index.levels[0][1]).agg(F.sum("n")).first()[0] == 56
    assert not any(spark.catalog.tableExists(n) for n in names)
    with pytest.raises(ZeroDivisionError), SuffixIndex(spark, 2) as index:
        index.add(df.select("head", "phrase"))
        names = list(index.tables)
        1 / 0
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_long_texts_go_through_segments(spark, monkeypatch):
    monkeypatch.setattr(matching, "_SEGMENT", 300)
    monkeypatch.setattr(matching, "_BLOCK", 500)
    rng = random.Random(2)
    part = bytes(rng.choice(b"ab") for _ in range(150)).decode()
    rows = [(i, "".join(rng.choice("ab") for _ in range(900)) + part + "".join(rng.choice("ab") for _ in range(700))) for i in range(3)] + [(7, "a" * 2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    units = Units("bytes", 60, 16, 6)
    gone = brute_spans({d: t for d, t in rows}, 60, "any")

    found = {r.doc_id: bytes(r.kept) for r in dedup_bytes(df, units).collect()}
    for d, t in rows:
        assert found[d] == bytes(c for c, g in zip(t.encode(), gone[d], strict=True) if not g)


def test_segments_give_the_anchors_of_the_whole():
    from tideline.llm.matching import _anchor_rows

    rng = np.random.default_rng(8)
    units = Units("bytes", 60, 16, 6)
    values = rng.integers(0, 3, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    whole = _anchor_rows(values, np.array([0, len(values)]), units)
    covered = set()
    for s in range(0, len(values), 300):
        a, last = max(0, s - 1), min(s + 300 + units.length - 1, len(values))
        got = _anchor_rows(values[a:last], np.array([0, last - a]), units, s > 0)
        if got is None:
            continue
        for pos, lo, hi, phrase in zip(got[1] + a, *got[2:5], strict=True):
            covered |= {(pos, i, phrase) for i in range(pos - lo, pos - hi + 1)}
    assert covered == {(p, i, h) for p, lo, hi, h in zip(*whole[1:5], strict=True) for i in range(p - lo, p - hi + 1)}


def test_lines_match_brute_force(docs, texts):
    seen, gone = set(), defaultdict(set)
    content = {d: [x for x in (t or "").split("\n") if words(x)] for d, t in texts.items()}
    for d in sorted(content):
        lines = content[d]
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            if key in seen:
                gone[d] |= {i, i + 1, i + 2}
            seen.add(key)
    for r in dedup_lines(docs).collect():
        assert r.n_removed == len(gone[r.doc_id])
        kept, n, drop = [], -1, False
        for x in (texts[r.doc_id] or "").split("\n"):
            if words(x):
                n += 1
                drop = n in gone[r.doc_id]
            if not drop:
                kept.append(x)
        assert (r.text or "") == "\n".join(kept)
    assert sum(map(len, gone.values())) > 100


def brute_runs(texts):
    """The numbers of the content lines that go by the pipeline's rule."""
    seen, gone = set(), defaultdict(set)
    for d in sorted(texts):
        lines = [x for x in (texts[d] or "").split("\n") if words(x)]
        for i in range(len(lines)):
            for n in range(1, min(3, len(lines) - i) + 1):
                part = tuple(lines[i : i + n])
                units = [part] if n == 3 or len(words(" ".join(part))) >= 50 else []
                for unit in units + ([("whole", part)] if n == len(lines) < 3 else []):
                    if (unit, n) in seen:
                        gone[d] |= set(range(i, i + n))
                    seen.add((unit, n))
    return gone


def test_short_runs_go_by_their_words(spark):
    import corpus_pipeline

    long, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25))
    texts = {
        1: f"a\n{long}\nb", 2: f"c\n\n{long}\nd", 3: f"e\n{half}\n{half} x\nf", 4: f"g\n{half}\n{half} x\nh", 5: f"{half}\ni\nj",
        6: "short", 7: "short", 8: "two\nlines", 9: "\ntwo\n\nlines", 10: "two\nlines\nmore", 11: "lines", 12: f"{long}\n{long}", 13: None, 14: "",
    }
    gone = brute_runs(texts)
    docs = spark.createDataFrame([(d, t, "s", 0) for d, t in texts.items()], "doc_id long, text string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs, words=50).collect()}
    assert got == {d: len(gone[d]) for d in texts}
    assert {d for d in texts if gone[d]} == {2, 4, 7, 9, 12}
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, None).collect()}
    assert kept[2] == "c\n\nd" and kept[4] == "g\nh" and {7, 9, 12}.isdisjoint(kept) and kept[10] == texts[10]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_spans_unite_when_they_touch():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    spans = pa.scalar([{"s": 5, "e": 9}, {"s": 0, "e": 3}, {"s": 3, "e": 4}, {"s": 6, "e": 7}], kind)
    assert matching.union(spans).tolist() == [[0, 4], [5, 9]]


def test_bytes_of_ids_with_several_texts(spark):
    """Each text of an id is judged by itself, repeated rows and rows without an id too."""
    from collections import Counter

    from tideline.llm.suffix_dedup import dedup_bytes

    shared = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(700))
    rows = [(1, "another text " + shared), (1, "short"), (2, shared + " end"), (None, shared), (3, "only here"), (3, "only here"), (4, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_bytes(df).collect()
    starts = Counter(t[i : i + 400] for t in (r[1] or "" for r in rows if r[0] is not None) for i in range(len(t) - 399))
    want = []
    for d, t in rows:
        t = t or ""
        gone = {j for i in range(len(t) - 399) if d is not None and starts[t[i : i + 400]] > 1 for j in range(i, i + 400)}
        want.append((d, len(t), "".join(c for j, c in enumerate(t) if j not in gone)))
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept).decode()) for r in got), key=lambda x: (x[0] or 0, x[2])) == sorted(want, key=lambda x: (x[0] or 0, x[2]))
