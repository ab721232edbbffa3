"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    return scores(table(spark, sf_dir, "documents"), ~in_fold("doc_id", 7, 2))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict, train

    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 4, 2)
    return predict(docs, train(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import CUT, score, train

    docs, held_out = table(spark, sf_dir, "documents"), in_fold("doc_id", 5, 0)
    ranking = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, ranking).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_links

    return near_links(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .line_dedup import ORACLE

    return {"op7_line_dedup": ORACLE}
