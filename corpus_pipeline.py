"""From documents to token ids: identify language, drop repeated lines, keep one of near copies, decontaminate, encode.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and gives the table that, written as Parquet and
read again, is the next one's docs. All but the last keep the columns of documents. Null texts and texts without letters go
in the first stage; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from tarmac.llm.common import dropped, in_fold, table, written
from tarmac.llm.queries import tokenizer

#: What the winning language must save of the runner-up's compressed size, as a share and in bytes; below, a document is
#: rejected. Junk and mixed texts save up to two bytes; of clean ones only some of a few words save fewer than three.
LEAST_MARGIN, LEAST_BYTES = 0.005, 3


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a margin, by the dictionaries of the other half of the documents: none is judged
    by itself. A language that only its own half has is judged by that."""
    first = F.coalesce(in_fold("doc_id", 2, 0), F.lit(True))
    halves = [docs.where(first), docs.where(~first)]
    models = [langid.train(half) for half in halves]
    kept = [langid.accepted(half, own | other, LEAST_MARGIN, LEAST_BYTES) for half, own, other in zip(halves, models, models[::-1], strict=True)]
    return kept[0].union(kept[1])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the multi-line chunks that earlier ones hold; those of which nothing stays go."""
    kept = line_dedup.dedup_lines(docs).where("n_removed_lines = 0 or text <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word 5-grams reach a Jaccard similarity of 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: SQL cannot express compression, alignment or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            if before is not None:
                dropped(before)
            before = docs
    return docs
