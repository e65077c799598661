"""The registered queries opN_*, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, compression_quality, html_extract, katz, mixing, ngram_join, quality_rules, toxicity, vafile
from .common import fold, table

#: Labelled texts of each class that reach the driver, at most.
QUALITY_PER_CLASS = 1500
TOXIC_PER_CLASS = 3000


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, path, pattern, without=("text",))
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"), shingle=3, threshold=(90, 100))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = fold("doc_id", 3) == 1
    sample = compression_quality.labelled_sample(docs, labels.filter(~held_out), "toxic", TOXIC_PER_CLASS)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(sample))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.train_and_score(docs, held_out=fold("doc_id", 7) == 2)


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = fold("doc_id", 5) == 0
    sample = compression_quality.labelled_sample(docs, labels.filter(~held_out), "quality", QUALITY_PER_CLASS)
    scored = compression_quality.score(docs.select("doc_id", "text"), compression_quality.fit(sample))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, epochs=1.0, flatten=0.5, seed=11)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{chat.END}{chat.START}assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*[F.col(f.name).cast(f.dataType) for f in added.schema.fields]).unionByName(added)
    return chat.read_back(chat.render(chat.events_of(turns)))


def op10_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mine = (op1_byte_bpe, op2_quality_rules, op3_html_extraction, op4_ngram_jaccard, op5_toxicity, op6_katz_lm, op7_compression_quality, op8_mixing, op9_chat_format, op10_vafile_topk)
    return {f.__name__: f for f in mine}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.sql(),
        "op4_ngram_jaccard": ngram_join.SQL,
        "op8_mixing": mixing.SQL,
        "op9_chat_format": chat.SQL,
        "op10_vafile_topk": vafile.SQL,
    }
