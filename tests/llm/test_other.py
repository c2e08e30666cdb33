import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideline.llm import audio, chat_format, mixing, packing, quality_rules
from tideline.llm.quality_classifier import STATS, fit_on_labels, fold, isotonic, score_stats, score_texts, stats_table, text_stats


def test_chat_round_trip(spark):
    said = ["", "</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [ROLE]x[/ROLE]", "<<SYS>>\n<</SYS>>", "plain", None]
    rows = [(c, t, r, said[(c + t) % 6]) for c in range(12) for t, r in enumerate([["user", "assistant"], ["system", "user", "assistant"], ["user", "tool[INST]", None, "assistant"]][c % 3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.format_conversations(df).collect()}
    for c in range(12):
        want = [(r or "", s or "") for cc, _, r, s in rows if cc == c]
        assert [(role or "", text) for role, text in got[c]] == [tuple(x) for x in want]


def test_chat_layouts_by_fingerprint(spark):
    rows = spark.createDataFrame(
        [(1, ("hi", "yo", None, None)), (2, (None, None, [("human", "a"), ("gpt", "b")], None)), (3, ("only", None, None, None)), (4, (None, None, None, [("user", "q")]))],
        "id long, record struct<prompt:string,response:string,conversations:array<struct<`from`:string,value:string>>,messages:array<struct<role:string,content:string>>>",
    )
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in chat_format.canonical_turns(rows).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "a"), ("assistant", "b")], 3: None, 4: [("user", "q")]}


def test_host_rules_reject_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad", "x y" if i % 10 else good) for i in range(60)] + [(100 + i, "good", good) for i in range(60)] + [(200, None, good), (201, None, None), (202, "good", "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality_rules.host_rules(df).collect()}
    assert not got[0].base_failed and not got[0].kept
    assert got[100].kept and got[200].kept and not got[201].kept and not got[202].kept
    assert got[201].n_words == 0


def test_repeated_windows_count_their_words(spark):
    rows = [(1, "a b c d e f g h a b c d e f g h"), (2, "a " * 9), (3, "a b c d e f g h i"), (4, "a b c d e f g h x a b c d e f g h")]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.rule_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 16, 2: 9, 3: 0, 4: 16}


def test_packing_is_whole_and_tight(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    for d, pieces in rows.groupby("doc_id"):
        ids = np.array([*slow.encode(texts[d] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = pieces.sort_values("piece")
        assert pieces.piece.tolist() == list(range(len(pieces))) and pieces.length.sum() == len(ids)
        assert (pieces.length[1:] == 1024).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert set(rows.doc_id) == set(texts)
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by.length.sum().max() <= 1024
    assert all((g.length.cumsum() - g.length == g.offset).all() for _, g in by)
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 2


def test_both_tokenizers_agree_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, encode = Tokenizer.from_file(path), packing._encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in ("", " ", "a  b\n\n c\t\r\n", "don't WE'LL", "ñandú çà 12,3", "<|endoftext|> x", " \x85 \xa0z", "日本 語", "x" * 500, "😀 ́"):
        assert list(encode(t)) == slow.encode(t, add_special_tokens=False).ids


def test_both_tokenizers_agree_on_long_runs_without_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, encode = Tokenizer.from_file(path), packing._encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!#$%&*|<>-=_", "äöüßéñ", "aA1!é"):
        for size in (3000, 30_000):
            t = "".join(rng.choice(list(alphabet), size))
            assert list(encode(t)) == slow.encode(t, add_special_tokens=False).ids


def test_the_genetic_algorithm_beats_best_fit():
    """Triplets that fill their bins exactly, which best fit by size doesn't find."""
    rng = np.random.default_rng(1)
    gained = 0
    for seed in range(6):
        sizes = []
        for _ in range(20):
            a = int(rng.integers(260, 500))
            b = int(rng.integers(200, 1024 - a - 200))
            sizes += [a, b, 1024 - a - b]
        best = packing.fit_in_order(sizes, sorted(range(60), key=lambda i: -sizes[i]), 1024)
        found = packing.evolve(sizes, 1024, seed, [], population=12, generations=400)
        assert sorted(i for b in found for i in b) == list(range(60)) and max(sum(sizes[i] for i in b) for b in found) <= 1024
        assert len(found) <= len(best)
        gained += len(best) - len(found)
    assert gained > 0


def test_packing_where_no_bin_gets_full(spark):
    df = spark.createDataFrame([(i, 600) for i in range(500)], "uid long, length long")
    assert packing.pack(df, shard_items=100).select("sequence_id").distinct().count() == 500


def test_packing_many_shards(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(1, 1025, 900)]
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    got = packing.pack(df, shard_items=200).toPandas()
    assert sorted(got.uid) == list(range(900))
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    whole = packing.fit_in_order(lengths, sorted(range(900), key=lambda i: -lengths[i]), 1024)
    assert got.sequence_id.nunique() <= len(whole) * 1.02


def test_audio_reads_back(docs, texts):
    made = audio.audio_features(audio.store_media(docs.select("doc_id", "text"))).collect()
    same = {}
    for r in made:
        b = (texts[r.doc_id] or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        assert audio.from_wav(bytes(r.media)) == (payload, audio.RATE)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        t = audio.read_tensors(bytes(r.tensor))
        assert t["tensor"].type.shape == [audio.PATCH, audio.MELS] and t["end_s"][-1].as_py() > 0
        assert same.setdefault(b, (r.feature, bytes(r.tensor))) == (r.feature, bytes(r.tensor))


def test_segments_keep_their_time_spans(spark):
    loud = bytes(int(128 + 100 * np.sin(i * 0.35)) for i in range(16_000))
    payload = bytes([128]) * 16_000 + loud + bytes([128]) * 16_000
    row = audio.audio_features(spark.createDataFrame([(1, bytearray(audio.to_wav(payload)), "x", 5)], "id long, media binary, frames string, blob int")).first()
    assert [f for f in row.__fields__][:3] == ["id", "media", "blob"] and row.segments == len(row.spans) == 1
    assert abs(row.spans[0].start_s - 1) < 0.05 and abs(row.spans[0].end_s - 2) < 0.05


def test_blocks_give_the_frames_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    for size in (64, 128, 511, 512, 4096, 70_001):
        payload = rng.integers(0, 256, size, dtype=np.uint8).tobytes()
        whole = audio.log_mel(audio.resample((np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128) / 128), 8000)
        monkeypatch.setattr(audio, "_FRAMES", 7)
        parts = audio.mel_frames(payload, audio.RATE)
        assert parts.shape == whole.shape and np.allclose(parts, whole, atol=1e-4)


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 8000
    assert abs(np.argmax(np.abs(np.fft.rfft(y))) - 440) <= 1
    assert len(audio.resample(np.ones(1000, dtype=np.float32), 3, 2)) == 1500


def test_energy_spans_hysteresis():
    e = np.array([0, 0, 10, 4, 4, 0, 4, 0, 9, 0], dtype=float)
    assert audio.active_spans(e).tolist() == [[2, 5], [8, 9]]


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    stats = stats_table(docs)
    model = fit_on_labels(stats, labels)
    got = score_stats(stats, model).join(labels.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"), "doc_id").toPandas()
    assert ((got.score >= 0.7) == (got.quality == 1)).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    scores = [r.score for r in score_texts(odd, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    none = fit_on_labels(stats, labels.filter("false"))
    assert score_texts(odd, none).first().score == 0.5
    assert score_texts(docs.filter("false"), model).count() == 0


def test_normal_equations_match_a_dense_solution(spark):
    """The sums by partition, and the whole fit with its calibration, against numpy on all labelled rows."""
    d = "/root/testdata/sf0.01"
    stats = stats_table(spark.read.parquet(f"{d}/documents.parquet"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = fit_on_labels(stats, labels)
    known = labels.filter("quality IS NOT NULL").withColumn("fold", fold()).filter("fold <> 2")
    pdf = stats.join(known, "doc_id").select("x", "quality", "fold").toPandas()
    z = model.features(np.array(pdf.x.tolist()))
    fit_rows, y = (pdf.fold != 3).to_numpy(), pdf.quality.to_numpy(dtype=float)
    beta = np.linalg.solve(z[fit_rows].T @ z[fit_rows] + 1e-2 * np.eye(z.shape[1]), z[fit_rows].T @ y[fit_rows])
    assert np.allclose(z @ beta, z @ model.beta, atol=1e-5)
    raw, told = z[~fit_rows] @ beta, y[~fit_rows]
    bins = np.clip(np.round((raw + 0.5) * 200), 0, 400)
    groups = [bins == b for b in np.unique(bins)]
    want = isotonic(np.array([raw[g].mean() for g in groups]), np.array([told[g].mean() for g in groups]), np.array([g.sum() for g in groups]))
    assert np.allclose(model.values, want, atol=1e-3)


PATHS = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")]
CLASHES = ["lines", "_key", "n_removed", "n_words", "_rules", "host_rate", "_host", "kept", "n_bytes", "media", "feature", "_f", "_m", "post", "score", "_id", "copies", "tokens", "row", "fp", "token", "phrase", "pos"]


def test_columns_may_have_any_name(spark):
    """Columns with the names that operators use inside or return: kept where they aren't results, replaced where they are."""
    import corpus_pipeline
    from tideline.llm.line_dedup import dedup_lines
    from tideline.llm.ngram_join import near_duplicates
    from tideline.llm.substring_lz import dedup_words
    from tideline.llm.suffix_dedup import dedup_bytes

    text = "\n".join(f"line {i} has some words of its own" for i in range(6))
    df = spark.createDataFrame([(1, text, "h"), (2, text, "h"), (3, None, None), (4, "", "i")], "doc_id long, text string, source string").withColumns({c: F.lit(f"was {c}") for c in CLASHES})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out, results in (
        (dedup_lines(df), {"n_removed"}), (quality_rules.host_rules(df), {*quality_rules.COUNTS, "host_rate", "kept"}), (audio.audio_features(audio.store_media(df)), {"n_bytes", "media", "feature"}),
        (mixing.memberships(df, mixing.DomainModel(np.zeros((3, 1 << 16)), None, np.zeros(0))), {"tokens", "post"}), (score_texts(df, fit_on_labels(stats_table(df), labels)), {"score"}),
    ):
        rows = out.collect()
        assert len(rows) == 4 and len(set(out.columns)) == len(out.columns)
        for c in CLASHES:
            assert (c in results) != all(r[c] == f"was {c}" for r in rows), c
    for made in (near_duplicates(df), dedup_bytes(df), dedup_words(df), packing.token_pieces(df, PATHS[0], PATHS[1])):
        assert made.count() == 4
    mixed_docs = corpus_pipeline.mixing(spark, df, "/root/testdata/sf0.001")
    assert mixed_docs.columns == df.columns
    assert all(r[c] == f"was {c}" for r in mixed_docs.collect() for c in CLASHES)


def test_isotonic_pools():
    assert isotonic(np.arange(4), np.array([1.0, 0.0, 2.0, 3.0]), np.ones(4)).tolist() == [0.5, 0.5, 2.0, 3.0]
    assert len(STATS) == 17


def test_rates_match_a_projected_gradient_in_numpy(spark):
    """Plain steps on the same objective, in units of tokens, until they stand still."""
    rng = np.random.default_rng(4)
    post = rng.dirichlet([4, 1, 1], 200)
    tokens = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(i, int(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, post, strict=True))], "doc_id long, tokens long, post array<double>")
    rate = mixing.solve_rates(df, ridge=0.05, tolerance=1.0)
    w = np.array([r.r for r in df.select("doc_id", rate.alias("r")).orderBy("doc_id").collect()])
    a = tokens[:, None] * post
    share = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    target = share * a.sum(0)[0] / share[0]
    slack = 0.05 * target
    v, pace = np.ones(200), 1 / (np.linalg.eigvalsh((a.T @ post) / np.sqrt(slack[:, None] * slack)).max() + 1)
    for _ in range(200_000):
        new = np.maximum(0, v - pace * (post @ ((v @ a - target) / slack) + (v - 1)))
        if np.abs(new - v).max() < 1e-12:
            break
        v = new
    assert np.allclose(w, v, atol=1e-4) and (w >= 0).all()


def test_a_domain_that_is_too_small_is_raised_or_kept(spark):
    rows = [(i, 100, [0.98, 0.01, 0.01] if i < 97 else [0.01, 0.98, 0.01] if i < 98 else [0.01, 0.01, 0.98]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, post array<double>")
    a = np.array([r[2] for r in rows]) * 100
    for up in (True, False):
        w = np.array([r.r for r in df.select("doc_id", mixing.solve_rates(df, upsample=up).alias("r")).orderBy("doc_id").collect()])
        want = np.array([0.96, 0.03, 0.01]) * a.sum(0)[0] / 0.96
        want = want if up else np.minimum(want, a.sum(0))
        assert np.abs(w @ a - want).max() < 2e-3 * want.sum()
        assert (w[97] > 1.3) == up


def test_the_mix_of_the_given_tables_meets_its_targets(spark):
    """op5 itself: the totals of the fit, and of the copies drawn, within 2 % of all tokens' targets."""
    out = mixing.op5(spark, "/root/testdata/sf0.01").toPandas()
    a = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy() * out.tokens.to_numpy()[:, None]
    share = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    target = share * a.sum(0)[0] / share[0]
    assert np.abs(out.rate.to_numpy() @ a - target).max() <= 2e-3 * target.sum() / 3
    # The draw adds its own chance: four deviations.
    rate = out.rate.to_numpy()
    assert (np.abs(out.copies.to_numpy() @ a - target) <= 4 * np.sqrt((rate % 1 * (1 - rate % 1)) @ a**2) + 0.02 * target).all()


def mixed(spark, monkeypatch, n, long=()):
    """A mix by production defaults of texts whose posteriors are given, its table of posteriors * tokens, and the targets."""
    rng = np.random.default_rng(8)
    kind = rng.choice(3, n, p=[0.7, 0.15, 0.15])
    post = np.where(np.arange(3) == kind[:, None], 0.98, 0.01)
    tokens = rng.integers(20, 600, n)
    for t, i in long:
        post, tokens = np.vstack([post, np.where(np.arange(3) == i, 0.98, 0.01)]), np.append(tokens, t)
    df = spark.createDataFrame([(i, "x", int(t), p.tolist()) for i, (t, p) in enumerate(zip(tokens, post, strict=True))], "doc_id long, text string, tokens long, post array<double>")
    monkeypatch.setattr(mixing, "fit_domains", lambda docs, labels: None)
    monkeypatch.setattr(mixing, "memberships", lambda docs, model: docs.join(df.drop("text"), "doc_id"))
    out = mixing.mix(df.select("doc_id", "text"), None).orderBy("doc_id").toPandas()
    a = tokens[:, None] * post
    share = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    return out, a, share * a.sum(0)[0] / share[0]


@pytest.mark.parametrize("long", [[], [(1_000_000, 2)], [(1_000_000, 2), (1_000_000, 1)]])
def test_mix_meets_the_targets_beside_very_long_texts(spark, monkeypatch, long):
    out, a, target = mixed(spark, monkeypatch, 2000, long)
    assert np.abs(out.rate.to_numpy() @ a - target).max() <= 2e-3 * target.sum() / 3
    assert (out.rate >= 0).all()


def test_drawn_copies_have_the_totals_of_the_fit(spark, monkeypatch):
    out, a, target = mixed(spark, monkeypatch, 6000)
    rate, copies = out.rate.to_numpy(), out.copies.to_numpy()
    deviation = np.sqrt((rate % 1 * (1 - rate % 1)) @ a**2)
    assert (np.abs(copies @ a - target) <= 4 * deviation + 2e-3 * target.sum() / 3).all()
    rare = (rate > 0) & (rate <= 0.1)
    assert rare.sum() > 500 and copies[rare].sum() > 0


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(i, 10, [1 / 3] * 3) for i in range(5)], "doc_id long, tokens long, post array<double>")
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        mixing.solve_rates(df)
    with pytest.raises(RuntimeError, match="haven't converged"):
        mixing.solve_rates(df, most_steps=1)


def test_mix_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.tokens, r.rate) for r in mixing.mix(docs, labels).collect()}
    assert got[2] == (0, 1.0) and got[3] == (0, 1.0) and got[1][0] == 2
    assert mixing.mix(docs.filter("false"), labels).count() == 0


def test_documents_without_an_id_are_mixed_too(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    kinds = ["clean"] * 280 + ["junk"] * 60 + ["toxic"] * 120
    post = {"clean": [0.98, 0.01, 0.01], "junk": [0.01, 0.98, 0.01], "toxic": [0.01, 0.01, 0.98]}
    rows = [(None if i % 2 else i, f"{k} {i}", 100, post[k]) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens long, post array<double>")
    monkeypatch.setattr(mixing, "fit_domains", lambda docs, labels: None)
    monkeypatch.setattr(mixing, "memberships", lambda docs, model: docs.join(df.drop("doc_id"), "text"))
    out = mixing.mix(df.select("doc_id", "text"), None).toPandas()
    a = np.array(out.post.tolist()) * out.tokens.to_numpy()[:, None]
    share = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    target = share * a.sum(0)[0] / share[0]
    assert len(out) == 460 and out.doc_id.isna().sum() == 230
    assert np.abs(out.rate.to_numpy() @ a - target).max() <= 2e-3 * target.sum() / 3
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r for r in corpus_pipeline.mixing(spark, df.select("doc_id", "text"), str(tmp_path)).collect() if r.doc_id is None]
    n = {k: sum(r.text.startswith(k) for r in kept) for k in post}
    assert n["toxic"] < 15 and n["junk"] < 25 and 125 <= n["clean"] <= 155


@pytest.mark.parametrize("operator", [quality_rules.host_rules, audio.store_media])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_pipeline_keeps_its_contract(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, d).toPandas(), docs.schema)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count() * 1.1
    last = corpus_pipeline.STAGES[-1][1](spark, kept, d).toPandas()
    assert set(last.doc_id) == {r.doc_id for r in kept.collect()}


def test_pipeline_stages_match_brute_force(spark):
    """Every stage's own decision on the whole of a small table, by plain Python."""
    import corpus_pipeline
    from tests.llm.test_dedup import brute_components, brute_runs, words

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = stages[name](spark, df, d).toPandas()
        return spark.createDataFrame(out, docs.schema), {r.doc_id: r.text for r in out.itertuples()}

    texts = {r.doc_id: r.text for r in docs.collect()}
    model = fit_on_labels(stats_table(docs), spark.read.parquet(f"{d}/labels.parquet"))
    scores = dict(zip(texts, model.score(np.array([text_stats((t or "").encode()) for t in texts.values()])), strict=True))
    df, kept = run("quality", docs)
    assert set(kept) == {i for i, x in scores.items() if x >= 0.7} and all(kept[i] == texts[i] for i in kept)

    gone, want = brute_runs(kept), {}
    for i, t in kept.items():
        n, drop, left = -1, False, []
        for x in (t or "").split("\n"):
            if words(x):
                n += 1
                drop = n in gone[i]
            if not drop:
                left.append(x)
        if not gone[i] or words("\n".join(left)):
            want[i] = "\n".join(left) if gone[i] else t
    df, kept = run("lines", df)
    assert kept == want

    least = {i: c for i, (_, c) in brute_components(kept).items()}
    df, near = run("near", df)
    assert near == {i: t for i, t in kept.items() if least[i] == i}

    df, mixed = run("mixing", df)
    assert set(mixed) <= set(near) and all(mixed[i] == near[i] for i in mixed) and len(mixed) > 0.8 * len(near)
    copies = df.groupBy("doc_id").count().toPandas()
    packed = stages["packing"](spark, df, d).toPandas()
    encode = packing._encoder(*PATHS)
    for i, n in zip(copies.doc_id, copies["count"], strict=True):
        own = packed[packed.doc_id == i]
        assert own.length.sum() == n * (len(list(encode(mixed[i] or ""))) + 1) and (own.piece == 0).sum() == n
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_chat_ties_and_long_texts(spark):
    long = "</s>[INST] word " * 40_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", long), (2, 0, None, None)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b"), ("assistant", long)], 2: [("", "")]}
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
