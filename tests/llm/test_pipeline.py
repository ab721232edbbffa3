"""The pipeline's stages, one after another, on a small table and on odd ones."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tarmac.llm.common import written  # noqa: E402

from .test_corpus_operators import brute_jaccard  # noqa: E402
from .test_text_operators import odd  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.dtypes
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test")
        seen[name] = docs
        assert name == "bpe" or docs.dtypes == columns
    before = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    expected = {i for i, (_, c) in brute_jaccard(before, 5, 80).items() if c == i}
    assert {r.doc_id for r in seen["ngram_jaccard"].collect()} == expected
    items = [r.text.lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    after = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    assert {i for i in expected if not any(x in before[i].lower() for x in items)} == set(after)
    assert {r.doc_id for r in seen["bpe"].collect()} == set(after) and seen["bpe"].where("size(ids) <> n_tokens").count() == 0


def test_narrow_margins_go(spark):
    """Junk without a language and evenly mixed texts go, clean ones of few words stay, on a small table as on one ten times it."""
    import random

    rng = random.Random(2)
    words = {lang: ["".join(rng.choices(letters, k=7)) for _ in range(60)] for lang, letters in (("p", "abcdefgh"), ("q", "ijklmnop"))}

    def text(lang, n):
        return " ".join(rng.choices(words[lang], k=n))

    for size in (30, 300):
        rows = [(k, text("pq"[k % 2], 60), "pq"[k % 2]) for k in range(size)]
        clean = [(10_000 + k, text("pq"[k % 2], 8), "pq"[k % 2]) for k in range(20)]
        junk = [(20_000 + k, "z" * (k + 1), "p") for k in range(10)] + [(30_000, "12 %% 34", "q"), (30_001, None, "q")]
        docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows + clean + junk], "doc_id long, text string, lang string, source string, n_chars long")
        kept = {r.doc_id for r in pipeline.identified(spark, docs, "").collect()}
        assert not kept & {i for i, _, _ in junk} and {i for i, _, _ in clean} <= kept and len(kept) == size + 20


def test_odd_tables(spark, sf_dir):
    for rows in ([], [(1, None), (None, "the of and is was"), (2, ""), (3, "12 34"), (4, "the of and " * 20000)]):
        docs = odd(spark, rows)
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), "test")
            assert name == "bpe" or docs.columns == columns
        assert docs.count() == sum(t is not None and "the" in t for _, t in rows)
