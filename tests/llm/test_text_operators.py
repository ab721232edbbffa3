"""Operators that treat each text by itself: token counts, BPE, language, quality; and the kernels."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarmac.llm import bpe, kernels, langid, quality, queries, token_counts

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a ", "a  ", " a", "  a b", "\n", "a\n b\t\tc", "▁ a", "a▁ b", "a ▁b", "é ü  ", "<s> x</s> <unk>", "x" * 3000, "日本 語 ", "it's 'store' 'S we'll they've 've  's ''s a'd!", "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|><|endoftext|>", "word " * 5000, " x  y", "1234 5²³ 6", "a\u0000b", "😀 👍🏽 é",
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, size int, label int"


def odd(spark, rows):
    """Documents with further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2) for i, t in rows], ODD_SCHEMA)


def large(texts):
    return pa.array(texts, pa.large_string())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tÀé▁", max_size=12), max_size=6))
def test_words_and_shingles(texts):
    data, offsets = kernels.buffer(large(texts))
    starts, ends, first = kernels.words(data, offsets)
    raw = "".join(texts).encode()
    for i, t in enumerate(texts):
        own = [raw[s:e] for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert own == t.encode().split()
    h = kernels.range_hashes(data, starts, ends)
    row, value = kernels.shingles(h, first, 2)
    _, at = kernels.distinct_in_rows(row, value, len(texts))
    for i, t in enumerate(texts):
        w = t.encode().split()
        assert at[i + 1] - at[i] == len({tuple(w[j : j + 2]) for j in range(max(len(w) - 1, min(1, len(w))))})


def test_token_counts_match_the_library():
    model = token_counts.model(PIECE)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": large(TEXTS)})
    assert token_counts.counted(batch, PIECE, 10).column("n_tokens").to_pylist() == [len(model.encode(t)) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé 's'ret\n\t,.!0’dmlvLSB9日▁\r<|endoftext|>", max_size=40))
def test_any_text_matches_both_libraries(text):
    from tokenizers import Tokenizer

    model = token_counts.model(PIECE)
    batch = pa.RecordBatch.from_pydict({"doc_id": [0], "text": large([text])})
    assert token_counts.counted(batch, PIECE, 10).column("n_tokens").to_pylist() == [len(model.encode(text))]
    if "lib" not in globals():
        globals()["lib"] = Tokenizer.from_file(BYTE)
    ids, _ = bpe.codec(BYTE).encode([text])
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids  # noqa: F821
    assert bpe.codec(BYTE).decode(ids).tobytes().decode() == text


def test_bpe_matches_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op2_bpe_round_trip(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(lib.encode(docs[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_every_code_point_matches_the_library():
    """Between a letter, a number, a mark and a space, so that its class decides."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    points = [*range(1, 0xD800), *range(0xE000, 0x40000), *range(0x40000, 0x110000, 0x101)]
    for at in range(0, len(points), 4096):
        texts = ["".join(f"a{chr(p)}1{chr(p)}!{chr(p)} {chr(p)}" for p in points[k : k + 32]) for k in range(at, min(at + 4096, len(points)), 32)]
        ids, offsets = own.encode(texts)
        found = [ids[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)], hex(points[at])


def test_bpe_with_a_small_memory(monkeypatch):
    texts = ["alpha beta gamma", "delta beta epsilon zeta", "alpha eta theta"] * 3
    expected = [bpe.codec(BYTE).encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 2)
    small = bpe.Codec(BYTE)
    assert [small.encode([t])[0].tolist() for t in texts] == expected


def test_encode_and_decode(spark):
    docs = odd(spark, list(enumerate(TEXTS)) + [(None, "x"), (99, None), (0, TEXTS[0])])
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert bpe.round_trip(docs, BYTE, keep_ids=True).where("size(ids) <> n_tokens").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 30000)]])
def test_odd_tables(spark, rows):
    docs = odd(spark, rows)
    assert token_counts.token_counts(docs, PIECE).count() == bpe.round_trip(docs, BYTE).count() == len(rows)
    assert quality.score(docs, quality.train(docs, spark.createDataFrame([(3, 1), (3, None), (None, 0), (77, 0)], "doc_id long, quality int"))).count() == len(rows)
    found = langid.predict(docs, langid.train(docs)).collect()
    assert len(found) == len(rows) and all((r.lang_pred == "und") == (r.doc_id in (1, 2)) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    if rows:
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECE).collect()}[2] == 0


def test_language_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries.op5_language_id(spark, sf_dir).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert sum(held) / len(held) >= 0.97


def test_no_languages(spark):
    docs = odd(spark, [(1, "a b")]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    model = langid.train(docs)
    assert model == {} and langid.predict(docs, model).first().lang_pred == "und" and langid.accepted(docs, model, 0.0).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_behind_a_shared_opening(spark):
    """Texts that all open with the same long header are told apart by what follows it."""
    import random

    rng = random.Random(3)
    header = " ".join(f"license{k}" for k in range(200))
    vocabulary = {lang: ["".join(rng.choices("abcdefghijklm", k=8)) for _ in range(300)] for lang in ("p", "q", "r")}
    rows = [(k, f"{header} {' '.join(rng.choices(vocabulary[lang], k=600))}", lang) for k, lang in enumerate("pqr" * 40)]
    model = langid.train(labelled(spark, rows))
    plain = [(1000 + k, " ".join(rng.choices(vocabulary[lang], k=30)), lang) for k, lang in enumerate("pqr" * 10)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(labelled(spark, plain), model).collect()}
    assert got == {i: lang for i, _, lang in plain}


def test_more_languages_than_a_block(spark):
    """No language is left out, however many are more frequent."""
    import hashlib

    def words(k, n):
        return " ".join(hashlib.md5(f"{k}-{j}".encode()).hexdigest()[:12] for j in range(n))

    rows = [(k, words(k, 30), f"l{k:03}") for k in range(300)] + [(1000 + k, words(k, 30), f"l{k:03}") for k in range(290)]
    docs = labelled(spark, rows)
    model = langid.train(docs)
    assert len(model) == 300
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.where("doc_id % 1000 in (0, 5, 280, 295, 299)"), model).collect()}
    assert got == {i: lang for i, _, lang in rows if i % 1000 in (0, 5, 280, 295, 299)}


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op6_quality_ranking(spark, sf_dir).collect()
    held = [(marked[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in marked]
    assert sum(a == b for a, b in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_quality_of_one_kind(spark):
    docs = odd(spark, [(1, "a b c"), (2, ""), (3, None), (4, "a b c")])
    for labels, expected in (([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 0), (4, 0)], 0.0), ([], 0.5), ([(9, 1), (1, None)], 0.5)):
        ranking = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.score for r in quality.score(docs, ranking).collect()} == {expected}


def test_language_against_plain_compression(spark, sf_dir):
    """Each text against each dictionary, one by one."""
    import regex
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where("doc_id % 3 <> 0"))
    expected = {}
    for r in docs.collect():
        if not r.text or not regex.search(r"\p{L}", r.text):
            expected[r.doc_id] = ("und", 0.0)
            continue
        words = " " + " ".join(dict.fromkeys(r.text.lower().split())) + " "
        sizes = {}
        for lang, content in model.items():
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(packer.compress(words[k : k + langid.PIECE].encode())) for k in range(0, len(words), langid.PIECE))
        best, second = sorted(sizes.values())[:2]
        expected[r.doc_id] = (next(k for k in model if sizes[k] == best), 1 - best / second)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    close = [abs(got[i][1] - s) < 0.02 and (got[i][0] == lang or s < 0.02) for i, (lang, s) in expected.items()]
    assert got.keys() == expected.keys() and sum(close) >= 0.99 * len(close)


def test_token_count_query(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op9_token_counts(spark, sf_dir).collect()}
    counts = {i: len(library.encode(t)) for i, t in texts.items()}
    assert got == {i: (len(t.encode()), counts[i], counts[i] > 4096) for i, t in texts.items()}


def test_pairwise_ranking_orders_documents():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    good = x @ [2, -1, 0] + 0.1 * rng.normal(size=400) > 0
    ranking = quality.fit(x, good)
    s = ranking.score(x)
    assert np.mean((s >= quality.CUT) == good) > 0.95 and s[good].mean() > s[~good].mean()
    assert (quality.fit(x, np.ones(400, bool)).score(x) == 1).all()


def all_pairs(x, good, penalty=1e-3):
    """Newton's method over every pair, written out."""
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w)), d.T @ (1 - p) / len(d) - penalty * w)
    return w, np.quantile(z @ w, np.mean(~good))


def test_ranking_counts_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    good = x @ [1, -1, 0.5, 0] + 1.5 * rng.normal(size=500) > 0.8
    ranking, (w, threshold) = quality.fit(x, good), all_pairs(x, good)
    assert ranking.weights == pytest.approx(w, abs=2e-3) and ranking.threshold == pytest.approx(threshold, abs=5e-3)
    assert ranking.threshold == pytest.approx(np.quantile(ranking.raw(x), np.mean(~good)), abs=1e-6)


def test_training_reads_all_labels(spark):
    """More labelled documents than the 8000 of old, over several partitions: the model is that of all of them."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["word", "Text", "a1", "x;", "other"], weights=[3, 2, 1 + i % 4, 1 + i % 3, 1], k=3 + i % 17))) for i in range(9000)]
    marked = [(i, int((i % 4) + rng.random() * 2 < 2)) for i, _ in rows]
    ranking = quality.train(odd(spark, rows).repartition(5), spark.createDataFrame(marked, "doc_id long, quality int"))
    x = quality.features(pa.array([t for _, t in rows], pa.large_string()))
    expected = quality.fit(x, np.array([m == 1 for _, m in marked]))
    assert ranking.mean == pytest.approx(x.mean(0), rel=1e-9, abs=1e-12)
    assert ranking.weights == pytest.approx(expected.weights, abs=1e-4) and ranking.threshold == pytest.approx(expected.threshold, abs=1e-4)
