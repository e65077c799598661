"""A training corpus from documents: rules, classifier, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, compression_quality, mixing, ngram_join, quality_rules
from strandline.llm.common import checkpointed, fold, named, table
from strandline.llm.queries import QUALITY_PER_CLASS, vocabulary

#: Documents go whose score is below this; lower than where the classifier is indifferent,
#: as the rules before it have taken what is plainly bad.
LEAST_QUALITY = 0.1


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rules keep, every column as it is; a null or empty text has no words and
    goes, equal rows stay or go together, and an empty table stays empty."""
    return quality_rules.keep(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores LEAST_QUALITY or more, every column as it is. The classifier learns from
    the labelled rows of the whole documents table, as the rules have left few bad ones among
    ``docs``; without labels all rows score alike. Null and empty texts are scored as such."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    sample = compression_quality.labelled_sample(table(spark, sf_dir, "documents"), labels, "quality", QUALITY_PER_CLASS)
    scored = compression_quality.score(docs, compression_quality.fit(sample), out="__score")
    return scored.filter(F.col("__score") >= LEAST_QUALITY).select(*map(named, docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 0.8): that of the
    least doc_id. Repeats of an id and text leave one row; texts without words are copies of
    nothing. Rows without an id come after all others, one for each text."""
    far = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), far))
    found = ngram_join.components_of(keyed.select(F.col("__key").alias("doc_id"), "text"), shingle=5, threshold=(80, 100))
    heads = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(heads, "__key", "left_semi").dropDuplicates(["__key", "text"]).select(*map(named, docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch over sources with shares as the square roots of their sizes: each row as often
    as its Poisson count says, in an order of its own. Null sources are a source; rows without
    an id share a count; an empty table stays empty."""
    made = mixing.mix(docs, epochs=1.0, flatten=0.5, seed=11, copy="__copy", position="__position")
    return made.select(*map(named, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to
    the text, one row a row. A null text is empty and has no tokens."""
    path, pattern = vocabulary()
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), path, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", by_rules),
    ("quality classifier", by_classifier),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing to target weights", mixed),
    ("byte-level BPE", tokens),
]

#: The classifier's compressed sizes have no SQL form; tests hold each stage, and all together,
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
