"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.llm import chat, common, components, decontaminate, encode, hilbert, jaccard, langid, packing, quality, tokencount, tokenids, topk

LONG = "alpha beta gamma delta " * 6000
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n\n ", "de"),
    (5, LONG, "en"),
    (6, "the cat sat on the mat and looked at the dog", "en"),
    (6, "the cat sat on the mat and looked at the dog", "en"),
    (None, "no id here but some words all the same", None),
    (8, "日本語 text <|endoftext|> émigré 12 🙂", "fr"),
]
CLASH = ["language", "leaks", "quality_score", "key", "c", "n", "shard", "deal", "rest", "text_crc32", "size", "doc", "x", "i", "__language"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)], F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))


def empty(spark):
    return table(spark).where("false")


def words(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# language


def test_language_backs_off_for_unseen_words_and_handles_edges(spark):
    rng = random.Random(1)
    en, de = ["the", "house", "and", "thing", "with", "water"], ["der", "haus", "und", "schrank", "mit", "wasser"]
    rows = [(k, words(rng, en if k % 2 else de, 30), "en" if k % 2 else "de") for k in range(200)]
    model = langid.train_languages(table(spark, rows))
    assert model.langs == ["de", "en"]
    assert model.predict("schrankhaus")[0] == "de" and model.predict("WITHTHING waterhouse")[0] == "en"
    assert model.predict(None) == model.predict("") == model.predict("12 ²!") == ("und", 0.0)
    assert model.predict("и")[0] in model.langs
    got = langid.identify_languages(table(spark), model).select("doc_id", "language.*").collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify_languages(empty(spark), model).count() == 0
    assert langid.train_languages(empty(spark)).predict("some text") == ("und", 0.0)


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    got = langid.op1_language_id(spark, folder).join(common.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_scores_match_a_plain_sum(spark):
    """A model of a few words against frequencies, backoff and posterior written out."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("aa bb aa", "x"), ("bb cc", "y"), ("aa dd dd", "x"), ("cc cc longword" + "z" * 100, "y")])]
    model = langid.train_languages(table(spark, rows))
    counts = {}
    for _, text, lang in rows:
        for w in text.split():
            counts.setdefault(w, {"x": 0, "y": 0})[lang] += 1
    assert set(model.words) == set(counts)  # whole words, however long
    total = {g: sum(c[g] for c in counts.values()) for g in "xy"}

    def contrast(c, sums, n):
        rate = {g: np.log((c[g] + 0.5) / (sums[g] + 0.5 * n + 1)) for g in "xy"}
        return {g: rate[g] - (rate["x"] + rate["y"]) / 2 for g in "xy"}

    grams = {}
    for w, c in counts.items():
        for size in range(1, 6):
            for at in range(len(w) + 3 - size):
                own = grams.setdefault(f"^{w}$"[at : at + size], {"x": 0.0, "y": 0.0})
                for g in "xy":
                    own[g] += c[g] ** 0.5
    gram_total = {g: sum(c[g] for c in grams.values()) for g in "xy"}

    def plain(text):
        score = {"x": np.log(0.5), "y": np.log(0.5)}
        for w in text.split():
            parts = [contrast(counts[w], total, len(counts))] if w in counts else []
            marked, at = f"^{w}$", 0
            while not (w in counts) and at < len(marked):
                size = next((k for k in range(min(5, len(marked) - at), 0, -1) if marked[at : at + k] in grams), 0)
                if size:
                    parts.append(contrast(grams[marked[at : at + size]], gram_total, len(grams)))
                at += size or 1
            for part in parts:
                score = {g: score[g] + part[g] for g in "xy"}
        best = "x" if score["x"] >= score["y"] else "y"
        return best, 1 / sum(np.exp(score[g] - score[best]) for g in "xy")

    for text in ("aa", "cc dd", "aabb ddz", "q aa zzzz", "longword"):
        got = model.predict(text)
        assert got[0] == plain(text)[0] and abs(got[1] - plain(text)[1]) < 1e-9


# quality


def test_pooling_and_network_match_plain_loops():
    rng = np.random.default_rng(23)
    ids = {t: k + len(quality.SHAPES) for k, t in enumerate(["the", "cat", "!"])}
    vectors = rng.normal(size=(len(ids) + len(quality.SHAPES), quality.WIDTH)).astype(np.float32)
    text = "The the the cat CAT 12 ! ! x"
    tokens = ["The", "the", "the", "cat", "CAT", "12", "!", "!", "x"]
    rows = [ids.get(t, {"The": quality.TITLE, "CAT": quality.UPPER, "12": quality.DIGIT, "x": quality.LOWER}.get(t)) for t in tokens]
    total = sum(vectors[r].astype(float) for r in rows) + 2 * vectors[quality.AGAIN].astype(float)  # "the the" and "! !"
    pooled = quality.pool(text, ids, vectors)
    assert np.allclose(pooled, np.concatenate([total / 9, [2 / 9, np.log1p(9)]]), atol=1e-5)
    layers = [rng.normal(size=(quality.WIDTH + 2, quality.HIDDEN)), rng.normal(size=quality.HIDDEN), rng.normal(size=quality.HIDDEN), rng.normal(size=1)]
    model = quality.QualityModel(ids, vectors, layers, np.zeros(quality.WIDTH + 2), np.ones(quality.WIDTH + 2), 1.7, 0.5)
    hidden = [np.tanh(sum(pooled[i] * layers[0][i, h] for i in range(len(pooled))) + layers[1][h]) for h in range(quality.HIDDEN)]
    logit = sum(hidden[h] * layers[2][h] for h in range(quality.HIDDEN)) + layers[3][0]
    assert abs(model.score(pooled[None])[0] - 1 / (1 + np.exp(-logit / 1.7))) < 1e-9


def test_the_sample_bound_holds_for_any_number_of_rows(spark):
    ids = spark.range(200_000)
    for share, low, high in ((0.5, 95_000, 105_000), (1e-3, 120, 290), (1e-7, 0, 3), (1.0, 200_000, 200_000)):
        assert low <= ids.where(common.drawn_share(share, "id")).count() <= high


def test_quality_held_out_and_edges(spark):
    folder = "/root/testdata/sf0.01"
    labels = common.table(spark, folder, "labels").select("doc_id", "quality")
    got = quality.op2_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9
    assert all(r["predicted"] == 1 for r in got if r["quality"] == 1)


def test_quality_without_labels_and_on_odd_texts(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train_quality(table(spark), none)
    assert {r["quality_score"] for r in quality.score_quality(table(spark), model).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (8, 0)], "doc_id long, quality int")
    got = quality.score_quality(table(spark), quality.train_quality(table(spark), some)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.score_quality(empty(spark), model).count() == 0


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(1)
    logit = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(float)
    assert 2.0 < quality.fit_temperature(3 * logit, y) < 4.5


# token ids


ODD = ["", " ", "a  b", "a\tb c", "x\n\ny", "\nfoo", "foo \n", "<|endoftext|> a<|endoftext|>", "Σ ǅ İ é", "a\x1cb c", "it's I'M 12 4", "a b", "ﬁ ＡＢ", " lead", "😀 👍🏽", "▁x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_library(name):
    own = encode.encoder(name)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", "\n", "'s", "1", "é", "!", "\t", "日", "\xa0", "İ", "<|endoftext|>"]) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for text, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.kind).tolist() == own.library.encode(text, add_special_tokens=False).ids


LETTERS_AND_SIGNS = ["a", "B", " ", "\n", "'", "s", "t", "re", "1", "é", "É", "ß", "ж", "×", "!", ",", "=", "\u0301", "\u0338", "\u0331", "\u0482", "日", "\xa0", "\u3000", "İ", "ǅ", "\x1c", "\t", "<|endoftext|>", "<|"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_sends_plain_words_to_the_model_once(name, monkeypatch):
    """Words beside signs, digits and letters beyond ASCII go to the model alone, and a word counts once whatever stands beside it."""
    own, seen = encode.UnitEncoder(encode.vocabulary(name)), []

    class Watched:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, key):
            return getattr(self.of, key)

        def encode_batch_fast(self, texts, **how):
            seen.append((self.of is library, sum(map(len, texts))))
            return self.of.encode_batch_fast(texts, **how)

    library = own.library
    texts = [" ".join(f"{w}{s}" for s in ("", ",", ".", "!", "?", ";") for w in ("house", "Straße", "été", "дом", "thonerinea")) + "\nend"] * 40
    for key in ("library", "model"):
        if hasattr(own, key):
            monkeypatch.setattr(own, key, Watched(getattr(own, key)))
    got = own.encode(texts)
    assert sum(n for whole, n in seen if whole) < 20 and sum(n for _, n in seen) < 200
    monkeypatch.undo()
    assert all(np.frombuffer(g, own.kind).tolist() == library.encode(t, add_special_tokens=False).ids for t, g in zip(texts, got))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_cuts_only_where_the_library_does(name, monkeypatch):
    own, rng = encode.UnitEncoder(encode.vocabulary(name)), random.Random(8)
    monkeypatch.setattr(encode, "REMEMBERED", 300)  # generations change
    monkeypatch.setattr(encode, "UNITS", 50)
    letters = [chr(c) for c in (*range(0xC0, 0x280), *range(0x400, 0x480))]
    texts = [None, "", *(f"a{c} {c}b {c}{c}," for c in letters)]
    texts += ["".join(rng.choice(LETTERS_AND_SIGNS) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for column in (encode.pa.array(texts), encode.pa.array(["x", *texts], encode.pa.large_string()).slice(1), encode.pa.array(["", None]), encode.pa.array([], encode.pa.string())):
        ids, sizes = own.encode_documents(column, 7)
        want = [[*own.library.encode(t or "", add_special_tokens=False).ids, 7] for t in column.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        assert encode.pa.concat_arrays([s for _, s in encode.text_slices(column, 50)] or [column]).equals(column)


def test_words_of_ids_round_trip():
    rng = np.random.default_rng(2)
    for k in range(300):
        ids = rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64) >> rng.integers(0, 64, 1, dtype=np.uint64)[0]
        ids = np.where(rng.random(len(ids)) < 0.1, ids * np.uint64(2) + np.uint64(1), ids >> np.uint64(rng.integers(0, 40)))
        assert (tokenids.unpack(tokenids.pack(ids), len(ids)) == ids).all()
    small = rng.integers(0, 2, 6000)
    assert len(tokenids.pack(small.astype(np.uint16))) == 100


def test_token_file_takes_documents_by_the_slice(monkeypatch):
    """A file does not depend on how its documents are dealt to slices; null ids, empty documents and documents over many blocks."""
    import io

    pa = encode.pa
    monkeypatch.setattr(tokenids, "BLOCK_IDS", 64)
    rng = np.random.default_rng(12)
    docs, sizes = pa.array([None, None, 0, 3, 3, 7, 8], pa.int64()), np.array([5, 0, 1, 700, 64, 0, 33])
    ids = rng.integers(0, 50_000, sizes.sum()).astype("<u2")
    ends = np.append(0, np.cumsum(sizes))
    files = []
    for cuts in ([0, 7], [0, 1, 2, 3, 4, 5, 6, 7], [0, 0, 3, 5, 7]):
        writer = tokenids.TokenFileWriter(out := io.BytesIO())
        for a, b in zip(cuts, cuts[1:]):
            writer.add(docs.slice(a, b - a), ids[ends[a] : ends[b]], sizes[a:b])
        writer.close()
        files.append(out.getvalue())
    assert files[0] == files[1] == files[2]
    file = tokenids.TokenFile(pa.BufferReader(files[0]))
    assert file.doc_ids.tolist() == [0, 0, 0, 3, 3, 7, 8] and file.known.tolist() == [False, False] + [True] * 5
    assert file.tokens.tolist() == sizes.tolist() and (file.ids(0, file.n_ids) == ids).all()


def test_token_files_hold_every_document_in_order(spark):
    path = common.shared_path(spark, "test-ids")
    files = tokenids.write_token_files(table(spark), path)
    got = tokenids.read_token_files(files).orderBy("start").collect()
    own, start = encode.encoder("byte_bpe_50k.json"), 0
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (doc, text, _) in zip(got, rows):
        ids = np.array(own.library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(ROWS)
    store, name = tokenids.filesystem(max(files.collect(), key=lambda r: r["ids"])["file"])
    with store.open_input_file(name) as source:
        file = tokenids.TokenFile(source)
        whole = file.ids(0, file.n_ids)
        assert len(whole) == file.n_ids and (file.ids(7, 90) == whole[7:90]).all()
    assert tokenids.read_token_files(tokenids.write_token_files(empty(spark), common.shared_path(spark, "test-ids"))).count() == 0


# token counts


def test_transducer_counts_as_the_library_does(spark):
    own = tokencount.transducer(tokencount.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = ODD + ["   a", "▁▁a", "a" * 3000, "ab " * 2000, " " * 70 + "x" + " " * 9, "日本語のテスト"]
    texts += ["".join(rng.choice("ab ▁é日\n .!😀thein") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    assert own.count(texts).tolist() == [len(x) for x in own.library.encode(texts)]
    got = tokencount.count_tokens(table(spark)).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == sorted((len((t or "").encode()), len(own.library.encode(t or ""))) for _, t, _ in ROWS)
    assert tokencount.count_tokens(empty(spark)).count() == 0


def test_runs_of_open_chunks_are_composed_by_a_scan():
    import time

    own = tokencount.CountingTransducer(tokencount.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(51)
    letters = [c for c in "etaoinshrdluabcdefg"]
    texts = ["a" * n for n in (255, 256, 257, 511, 5000, 40_001)] + ["ab" * 9000, "the" * 7000, "日本語テキスト" * 3000, "x y" + "zq" * 4000 + " end " + "w" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(200, 9000))) for _ in range(30)]
    assert own.count(texts).tolist() == [len(x) for x in own.library.encode(texts)]
    long = ["".join(rng.choice(letters[:6]) for _ in range(400_000)) for _ in range(2)]
    own.count(long)  # states are made once
    begin = time.perf_counter()
    got = own.count(long).tolist()
    seconds = time.perf_counter() - begin
    print("seconds for 800000 characters without spaces:", round(seconds, 2))
    assert got == [len(x) for x in own.library.encode(long)] and seconds < 3  # under half a second on an idle machine


def bare_model(kind, charsmap=b"", spaces=0, fallback=1):
    """A model's trainer and normaliser alone, serialised."""
    part = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    trainer = bytes([3 << 3, kind, 0x98, 0x02, fallback])
    text = (part(2, charsmap) if charsmap else b"") + bytes([4 << 3, spaces])
    return part(2, trainer) + part(3, text)


def test_models_of_other_kinds_are_refused():
    tokencount.check_model(bare_model(2))
    for other in (bare_model(1), bare_model(2, b"nfkc"), bare_model(2, b"", 1), bare_model(2, b"", 0, 0), bare_model(3), b""):
        with pytest.raises(tokencount.Unfit):
            tokencount.check_model(other)


def test_texts_that_the_transducer_cannot_follow_go_to_the_library(monkeypatch):
    own = tokencount.CountingTransducer(tokencount.vocabulary("piece_bpe_32k.model"))

    def refuse(text):
        raise tokencount.Unfit("no")

    monkeypatch.setattr(own, "symbols", refuse)
    assert own.count(["some text", ""]).tolist() == [len(x) for x in own.library.encode(["some text", ""])]


def test_forgetting_the_transducer_does_not_change_counts(monkeypatch):
    own = tokencount.CountingTransducer(tokencount.vocabulary("piece_bpe_32k.model"))
    texts = ["the quick brown fox", "jumps over the lazy dog", LONG[:5000]]
    first = own.count(texts).tolist()
    monkeypatch.setattr(tokencount, "MAX_TRANSITIONS", 0)
    assert own.count(texts).tolist() == first


# exact top k


def brute_top(vectors, k):
    ok = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for q, x in ok:
        if q % 50 == 0:
            near = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_top_k_with_ties_and_broken_vectors(spark):
    rng = random.Random(6)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(230)]
    vectors += [(300 + k, vectors[3][1]) for k in range(20)] + [(50 * k + 1000, vectors[3][1]) for k in range(3)]
    vectors += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] + [0.0] * 5), (600, [2.0, 3.0]), (601, [1.0, 1.0]), (650, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("score"), F.lit(2).alias("id"))
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    vectors32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top(vectors32, 5)
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def exact_share(rows, monkeypatch, queries=40):
    """Share of the pairs that got an exact product; the results are held against all products."""
    ids = np.arange(len(rows))
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 512)
    own = topk.Candidates(ids, rows, np.linalg.svd(rows, full_matrices=True)[2].T)
    best = own.search(ids[:queries], rows[:queries], np.full(queries, -np.inf), 5)
    exact = rows[:queries] @ rows.T
    for q in range(queries):
        mine = best.of == q
        assert list(zip((-best.scores[mine]).tolist(), best.ids[mine].tolist())) == sorted((-int(exact[q, i]), i) for i in ids if i != q)[:5]
    return own.exact / (queries * len(rows))


def test_top_k_bounds_prune_pairs_without_loss(monkeypatch):
    rng = np.random.default_rng(7)
    spread = np.floor(256 * rng.normal(size=(3000, 16)) * rng.lognormal(0, 1, (3000, 1)))
    centres = rng.normal(size=(30, 64))
    clustered = centres[rng.integers(0, 30, 6000)] + 0.25 * rng.normal(size=(6000, 64))
    clustered = np.floor(256 * clustered / np.linalg.norm(clustered, axis=1, keepdims=True))
    alike = rng.normal(size=(6000, 64))
    alike = np.floor(256 * alike / np.linalg.norm(alike, axis=1, keepdims=True))
    shares = {"lengths differ": exact_share(spread, monkeypatch), "clusters": exact_share(clustered, monkeypatch), "no structure": exact_share(alike, monkeypatch)}
    print("share of exact products:", shares)
    assert shares["lengths differ"] < 0.2 and shares["clusters"] < 0.1 and shares["no structure"] < 0.3


def test_top_k_of_a_query_repeated_over_many_blocks(spark):
    rng = random.Random(61)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(120)]
    rows = vectors + [vectors[50]] * 2999
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0).groupBy("query_id", "rank", "vec_id", "score").count().collect()
    fifty = {r["rank"]: r for r in got if r["query_id"] == 50}
    alone = [r for r in brute_top(vectors, 5) if r[0] == 50]
    assert sorted((50, r["rank"], r["vec_id"], r["score"]) for r in fifty.values()) == alone and {r["count"] for r in fifty.values()} == {3000}
    exact = brute_top(rows[:120] + [vectors[50]] * 9, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] != 50) == [r for r in exact if r[0] != 50]


def test_top_k_beyond_the_range_of_doubles(spark):
    vectors = [(50, [2.0**40, 3.0]), (1, [2.0**40, 1.0]), (2, [2.0**20, -7.0]), (3, [-(2.0**40), 5.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    exact = lambda v: min(max(sum(int(256 * a) * int(256 * b) for a, b in zip(vectors[0][1], v)), -(1 << 63)), (1 << 63) - 1)
    assert got == [(i, exact(v)) for i, v in vectors[1:]]


# chats


def test_chats_round_trip_with_hostile_texts(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end\\|>", "a<", "|im_end|>", "<|", "\n", "", None, "<|im_end|>\n<|im_start|>user\nx", "x" * 50_000]
    rows = [(k % 4, k, ("assistant", "user", "odd|role\n%0A", None)[k % 3 if k < 9 else 3], t) for k, t in enumerate(texts)]
    rows += [(1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (None, None, "user", "alone"), (2, None, "user", "no turn"), (2, -5, "user", "before")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("x")).withColumn("turns", F.lit("y"))
    formatted = chat.format_chats(df, chunk_turns=2)
    back = {}
    for r in chat.read_chats(formatted).orderBy("chunk").collect():
        own = back.setdefault(r["conv_id"], ([], []))
        own[0].extend((t["role"], t["text"]) for t in r["turns"])
        own[1].append(r["loss_text"])
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert back[conv][0] == [(role, text) for _, role, text in turns]
        assert "".join(back[conv][1]) == "".join(text for _, role, text in turns if role == "assistant")
    for r in formatted.collect():
        assert r["formatted"].count("<|im_start|>") == r["n_turns"] == r["formatted"].count("<|im_end|>")
    assert chat.format_chats(df.where("false")).count() == 0


# sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    side, at = 1 << bits, {}
    for n in range(side**dims):
        cell = [n // side**k % side for k in range(dims)]
        at[hilbert.hilbert_index(cell, bits)] = cell
    assert sorted(at) == list(range(side**dims))
    assert all(sum(abs(x - y) for x, y in zip(at[k], at[k + 1])) == 1 for k in range(side**dims - 1))


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 3), (3, 2), (3, 6)])
def test_curve_columns_give_the_index(spark, dims, bits):
    rng = random.Random(dims * bits)
    cells = [[rng.randrange(1 << bits) for _ in range(dims)] for _ in range(200)]
    df = spark.createDataFrame(cells, ", ".join(f"k{i} int" for i in range(dims)))
    for name, column in hilbert.curve_index([F.col(f"k{i}") for i in range(dims)], bits):
        df = df.withColumn(name, column)
    assert all(r["curve"] == hilbert.hilbert_index([r[f"k{i}"] for i in range(dims)], bits) for r in df.collect())


def test_strings_are_cut_by_their_whole_length(spark):
    rng = random.Random(21)
    names = [f"a very long prefix shared by all sources/{rng.choice(['news', 'web', 'été', 'books', 'code'])}/{k % 37}" for k in range(900)] + ["one hot source"] * 500 + [None] * 30
    cuts = hilbert.string_cuts(spark.createDataFrame([(n,) for n in names], "k0 string"), "k0", 8)
    ordered = sorted((n for n in names if n is not None), key=str.encode)
    expected = {ordered[-(-len(ordered) * part // 8) - 1] for part in range(1, 8)} - {ordered[-1]}  # nothing lies behind the last
    assert set(cuts) == expected and len(cuts) > 4


def test_order_and_slots_match_a_plain_rebuild(spark):
    rng = random.Random(22)
    rows = [(k, words(rng, ["x", "yy", "zzz"], rng.randint(0, 9)), rng.choice(["de", "en", "fr", None])) for k in range(300)] + ROWS
    got = hilbert.shard_by_curve(table(spark, rows), {"lang": F.col("lang"), "len": F.char_length("text")}, n_shards=7, bits=3).collect()
    langs, lengths = sorted(r[2] for r in rows if r[2] is not None), sorted(len(r[1]) for r in rows if r[1] is not None)
    cuts = {langs[-(-len(langs) * part // 8) - 1] for part in range(1, 8)} - {langs[-1]}
    bounds = {lengths[-(-len(lengths) * part // 8) - 1] for part in range(1, 8)}
    place = lambda r: hilbert.hilbert_index([sum(c < r[2] for c in cuts) if r[2] is not None else 0, sum(b < len(r[1]) for b in bounds) if r[1] is not None else 0], 3)
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    plain = sorted(((place(r), crc(r[1]), r[0], len((r[1] or "").encode()) + 1) for r in rows), key=lambda x: [(v is not None, v or 0) for v in x])
    n = len(plain)
    expected = []
    for k, row in enumerate(plain):
        shard = k * 7 // n
        expected.append((*row, shard, k - -(-shard * n // 7)))
    assert sorted(((r["curve"], r["text_crc32"], r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got), key=repr) == sorted(expected, key=repr)


def test_shards_are_even_and_gapless(spark):
    rows = ROWS + [(100 + k, "copy" if k % 3 else f"text {k}", "en") for k in range(150)]
    got = hilbert.shard_by_curve(table(spark, rows), {"lang": F.col("lang"), "len": F.char_length("text")}, n_shards=8).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8)) and len(got) == len(rows)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert all(max(r["curve"] for r in by[k]) <= min(r["curve"] for r in by[k + 1]) for k in range(7))
    expected = sorted(((len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for _, t, _ in rows), key=repr)
    assert sorted(((r["size"], r["text_crc32"]) for r in got), key=repr) == expected
    assert hilbert.shard_by_curve(empty(spark), {"lang": F.col("lang")}).count() == 0


# decontamination


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row)


def test_leaks_are_found_within_the_allowed_edits(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, words(rng, vocabulary, rng.randint(10, 40))) for k in range(30)] + [(90, ""), (91, None), (92, "two words")]
    rows, planted = [], set()
    for k in range(200):
        own = words(rng, vocabulary, 60).split()
        if k % 2 == 0:
            item = rng.choice(items[:30])
            edited = item[1].split()
            for _ in range(rng.randint(0, int(0.15 * len(edited)))):
                edited[rng.randrange(len(edited))] = "changed"
            own[20:20] = edited
            planted.add((k, item[0]))
        rows.append((k, " ".join(own).upper() + ".", "en"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("leaks", F.lit(1))
    got = decontaminate.find_leaks(table(spark, rows + ROWS), bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(planted - found) <= 2 and found <= planted
    by = dict(items)
    for r in got:
        text, item = re.findall(r"\w+", rows[r["doc_id"]][1].lower()), by[r["item_id"]].split()
        assert plain_distance(item, text[r["start"] : r["start"] + len(item) + int(0.2 * len(item))]) == r["distance"]
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(table(spark), bench.where("false")).select(F.sum(F.size("leaks"))).first()[0] == 0


def test_a_large_benchmark_is_searched_index_by_index(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 2)
    bench = spark.createDataFrame([(k, f"one two three four five six number{k} end{k}") for k in range(5)], "item_id long, text string")
    docs = table(spark, [(1, "x y one two three four five six number3 end3 z", "en")]).withColumn("__leaks_0", F.lit(5))
    got = decontaminate.find_leaks(docs, bench).first()
    assert got["__leaks_0"] == 5
    got = got["leaks"]
    assert min(got, key=lambda m: m["distance"]).asDict() == {"item_id": 3, "start": 2, "distance": 0}


def edited_words(rng, item, pattern, k):
    """A fifth of an item's words edited: all over, in front, at the back, by insertions, by deletions."""
    own = list(item)
    for e in range(len(own) // 5):
        place = [rng.randrange(len(own)), e, max(len(own) - 1 - e, 0), rng.randrange(len(own)), rng.randrange(len(own))][pattern]
        kind = [rng.randrange(3), 0, 0, 1, 2][pattern]
        own[place : place + (kind != 1)] = [] if kind == 2 else [f"new{k}x{e}"]
    return own


@pytest.mark.parametrize("size,copies", [(5, 200), (10, 200), (25, 200), (50, 150), (100, 60), (200, 30), (500, 15)])
def test_leaks_at_the_limit_match_a_scan_of_all_windows(size, copies):
    rng = random.Random(81 + size)
    vocabulary = [f"w{k}" for k in range(800)]
    items = [words(rng, vocabulary, size).split() for _ in range(20)]
    index = decontaminate.build_index([(k, " ".join(i)) for k, i in enumerate(items)])
    texts, missed = [], []
    for k in range(copies):
        texts.append(words(rng, vocabulary, 15).split() + edited_words(rng, items[k % 20], k % 5, k) + words(rng, vocabulary, 15).split())
    for k, leaks in enumerate(index.search([" ".join(t) for t in texts])):
        item, text = items[k % 20], texts[k]
        span = size + size // 5
        rows = np.array([[hash(w) for w in text[s : s + span]] + [0] * (span - len(text[s : s + span])) for s in range(len(text))])
        far = decontaminate.edit_distances(np.array([hash(w) for w in item]), rows).tolist()
        if k % 20 == 0 and size <= 50:
            assert far[14:17] == [min(plain_distance(item, text[s:e]) for e in range(s, min(s + span, len(text)) + 1)) for s in range(14, 17)]
        assert min(far) <= size // 5
        found = {m["item_id"]: (m["start"], m["distance"]) for m in leaks}
        if k % 20 not in found:
            missed.append(k)
        else:
            assert found[k % 20] == (far.index(min(far)), min(far))
    print(f"items of {size} words: {copies - len(missed)} of {copies} copies at the limit found, {int(index.tables.max())} tables")
    assert len(missed) <= 0.01 * copies


def test_an_index_of_many_items_is_small():
    import pickle

    rng = random.Random(83)
    vocabulary = [f"w{k}" for k in range(30_000)]
    rows = [(k, words(rng, vocabulary, rng.choice((10, 20, 30)))) for k in range(20_000)]
    assert len(pickle.dumps(decontaminate.build_index(rows))) < 100e6


# packing


def check_pieces(rows, texts, window):
    own = encode.encoder("word_bpe_49k.json")
    coded = sorted([np.array(own.library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t, _ in texts])
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append(r)
    for part in held.values():
        part.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in part] == np.cumsum([0] + [r["length"] for r in part])[:-1].tolist()
        assert sum(r["length"] for r in part) <= window
    assert sum(r["length"] for r in rows) == sum(len(c) // 4 for c in coded)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (doc, n), part in by.items():
        options = [c for c in coded if len(c) == 4 * n]
        assert all(any(zlib.crc32(c[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for c in options) for r in part)
        copies = sum(r["length"] for r in part) // n
        places = np.zeros(n, int)
        for r in part:
            places[r["start"] : r["start"] + r["length"]] += 1
        assert (places == copies).all()
    return held


def test_packing_covers_every_id_once(spark):
    rng = random.Random(9)
    topics = [[f"topic{t}word{k}" for k in range(40)] for t in range(4)]
    texts = ROWS + [(100 + k, words(rng, topics[k % 4], rng.randint(1, 60)), "en") for k in range(120)]
    rows = packing.pack_documents(table(spark, texts), window=256, shard_docs=64).collect()
    held = check_pieces(rows, texts, 256)
    short = [k for k, part in held.items() if sum(r["length"] for r in part) < 256]
    assert len(short) <= 3
    assert packing.pack_documents(empty(spark)).count() == 0


def test_neighbours_of_all_the_corpus_share_windows(spark):
    rng = random.Random(91)
    lines = ["river water fish boat stream bank", "music song guitar piano sound band", "school teacher student class book lesson", "bread butter cheese milk salt sugar"]
    lines += ["doctor hospital patient nurse health blood", "king queen castle army sword battle", "planet star moon sun orbit space", "market price money trade stock profit"]
    topic = [rng.randrange(8) for _ in range(320)]
    texts = [(k, words(rng, lines[topic[k]].split(), 30), "en") for k in range(320)]
    rows = packing.pack_documents(table(spark, texts), window=256, shard_docs=40).collect()
    held = check_pieces(rows, texts, 256)
    most = [max(sum(r["length"] for r in part if topic[r["doc_id"]] == t) for t in range(8)) for part in held.values()]
    assert sum(most) > 0.8 * sum(r["length"] for r in rows)


def plain_bm25(texts, seed, idf, mean):
    """Score of every text for all terms of the seed's, term by term."""
    out = []
    for text in texts:
        score = 0.0
        for term in set(texts[seed].tolist()):
            tf = int((text == term).sum())
            score += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(text) / mean)) if tf else 0.0
        out.append(score)
    return out


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_neighbours_are_those_of_plain_bm25(kind):
    rng = np.random.default_rng(12)
    texts = [rng.zipf(1.4, rng.integers(1, 400)).clip(max=900).astype(kind) for _ in range(60)] + [np.zeros(0, kind)]
    held = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=1000)
    idf, mean = np.log1p((60 - held + 0.5) / (held + 0.5)), float(np.mean([len(t) for t in texts]))
    index, used = packing.ShardIndex(texts, idf, mean), rng.random(61) < 0.2
    for seed in range(60):
        scores = plain_bm25(texts, seed, idf, mean)
        got = index.neighbours(seed, used).tolist()
        assert set(got) == {k for k in range(61) if scores[k] > 0 and k != seed and not used[k]}
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_windows_are_filled_as_a_plain_greedy_fill_does():
    rng = np.random.default_rng(13)
    texts = [rng.zipf(1.5, rng.integers(1, 300)).clip(max=500).astype(np.uint16) for _ in range(80)]
    idf, mean = np.linspace(3, 1, 600), 120.0
    left, done = [len(t) for t in texts], [0] * 80
    expected = []
    for seed in sorted(range(80), key=lambda k: (-len(texts[k]), k)):
        if not left[seed]:
            continue
        sequence, room = [], 500

        def take(k):
            nonlocal room
            n = min(left[k], room)
            sequence.append((k, done[k], n))
            done[k], left[k], room = done[k] + n, left[k] - n, room - n

        scores = plain_bm25(texts, seed, idf, mean)
        take(seed)
        ranked = [k for k in sorted(range(80), key=lambda k: (-scores[k], k)) if scores[k] > 0 and left[k] and k != seed]
        for k in ranked:
            if left[k] <= room:
                take(k)
        for k in ranked:
            if room and left[k]:
                take(k)
        for k in sorted(range(80), key=lambda k: (-len(texts[k]), k)):
            if room and left[k]:
                take(k)
        expected.append(sequence)
    assert packing.fill_windows(texts, idf, mean, 500) == expected


def test_windows_prefer_lexical_neighbours():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(100 * (k % 2), 100 * (k % 2) + 80, 50) for k in range(40)]
    idf = np.ones(300)
    for sequence in packing.fill_windows(pieces, idf, 50.0, 200)[:5]:
        assert len({k % 2 for k, _, _ in sequence}) == 1

def test_bm25_counts_cover_whole_documents(spark):
    rng = np.random.default_rng(5)
    heads = [rng.integers(100 * (k % 2), 100 * (k % 2) + 80, 300) for k in range(40)]
    rests = [rng.integers(200, 280, 50) for _ in heads]
    for sequence in packing.fill_windows(rests, np.ones(300), 350.0, 200, [np.append(h, r) for h, r in zip(heads, rests)])[:5]:
        assert len({k % 2 for k, _, _ in sequence}) == 1
    coded = spark.createDataFrame([(np.array([7] * 300 + [9], "<u2").tobytes(),), (np.array([9, 9], "<u2").tobytes(),)], "ids binary")
    held, n, mean = packing.document_frequencies(coded, "<u2")
    assert (held[7], held[9], n, mean) == (1, 2, 2, 151.5)


def test_short_pieces_fill_windows_with_neighbours_only():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(100 * (k % 2), 100 * (k % 2) + 8, 4) for k in range(400)]
    for sequence in packing.fill_windows(pieces, np.ones(300), 4.0, 400)[:2]:
        assert len(sequence) == 100 and len({k % 2 for k, _, _ in sequence}) == 1



# n-gram join


def brute_join(texts):
    sets = []
    for _, text in texts:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(sets)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in link[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [texts[k][0] for k in seen if texts[k][0] is not None]
        label[i] = min(ids) if ids and sets[i] else texts[i][0]
    return sorted(((texts[i][0], label[i], len(link[i])) for i in range(n)), key=repr)


@pytest.mark.parametrize("paired,block", [(24, 256), (3, 8)])
def test_join_matches_brute_force_with_pairs_and_with_blocks(spark, monkeypatch, paired, block):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(10)
    vocabulary = [f"v{k}" for k in range(300)]
    texts = [(r[0], r[1]) for r in ROWS]
    base = words(rng, vocabulary, 120).split()
    for k in range(60):  # a large group of near copies
        own = list(base)
        own[rng.randrange(120)] = f"z{k % 40}"
        if k % 3 == 0:
            own[rng.randrange(120)] = f"y{k}"
        texts.append((1000 + k, " ".join(own)))
    for k in range(40):
        text = words(rng, vocabulary, rng.randint(3, 60))
        texts += [(2000 + 3 * k, text), (2001 + 3 * k, text + " tail" if k % 2 else text.upper()), (2002 + 3 * k, words(rng, vocabulary, 20))]
    df = table(spark, [(i, t, None) for i, t in texts])
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(df).collect()), key=repr)
    assert got == brute_join(texts)


def test_join_of_nothing(spark):
    assert jaccard.jaccard_join(empty(spark)).count() == 0
    bands, rows = jaccard.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= jaccard.MAX_HASHES


def test_join_refuses_what_no_banding_reaches():
    for threshold in (0.01, 0.0, 1.5):
        with pytest.raises(ValueError):
            jaccard.choose_bands(threshold, 0.9995)


def test_join_of_many_null_ids(spark):
    texts = [(None, "the same text under no id at all")] * 5000 + [(None, f"text number {k} under no id at all") for k in range(50)] + [(3, "the same text under no id at all")]
    got = jaccard.jaccard_join(table(spark, [(i, t, None) for i, t in texts])).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(3, 3, 5000, 1), (None, 3, 5000, 5000), (None, None, 0, 50)], key=repr)


def test_one_of_each_judges_rows_and_not_ids(spark):
    a, c, p, q = (f"{w} one two three four five six seven {w}" for w in ("a", "c", "p", "q"))
    rows = [(3, a, "x"), (7, a, "x"), (7, c, "x"), (9, p, "x"), (9, q, "x"), (9, q, "y"), (None, a, "x"), (None, "b " + c, "x"), (None, None, "x"), (None, None, "x"), (4, " - ", "x"), (4, " - ", "x")]
    kept = jaccard.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    expected = [(3, a, "x"), (7, c, "x"), (9, p, "x"), (9, q, "x"), (None, None, "x"), (None, None, "x"), (4, " - ", "x"), (4, " - ", "x")]
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()), key=repr) == sorted(expected, key=repr)
    assert jaccard.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("one_task", [0, 50, components.ONE_TASK])
def test_components_of_paths_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {500: 500, 501: 500}


def test_components_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", 0)
    monkeypatch.setattr(components, "HOT", 2)
    monkeypatch.setattr(components, "HOT_KEYS", 10)
    rng, label = random.Random(11), list(range(300))
    edges = [(0, k) for k in range(1, 60)] + [(k, 299) for k in range(200, 260)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(60)]
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: label[k] for e in edges if e[0] != e[1] for k in e}
