"""Corpus pipeline: five stages over ``documents``, each one operator of ``terramosaic.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last returns token ids and digests.
Between stages the rows are written as Parquet and read again, so a stage's work
is never repeated by the next and lost executors cost one stage at most. A
stage's folder is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terramosaic.llm import byte_bpe, decontamination, language_id, near_copies, pii
from terramosaic.llm.common import remove_dir, ship, shared_path, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or two languages about equally near.

    Trained on the documents themselves, without held-out ids and rows without
    id, text or label. Null, empty and blank texts go; nulls in other columns
    stay as they are, repeated rows are judged alike, and other columns, of any
    name, are passed on.
    """
    ship(spark)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    named = dict(zip(docs.columns, names, strict=True))
    model = language_id.train(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
    found = language_id.identify(plain, model, text_col=named["text"], keep=names)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select(*(F.col(n).alias(c) for c, n in named.items()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard of 0.8 or more) stays, the one with the smallest id.

    Golay keys of SimHash fingerprints and an exact filter propose pairs, all
    are verified. Rows of one id are told apart by their texts; of equal rows one
    stays. Rows with a null id stay; texts without a word are copies of each other.
    """
    ship(spark)
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike.
    """
    ship(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kind; n_chars follows.

    Texts without any, null and empty ones included, are left exactly as they are.
    """
    ship(spark)
    return pii.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, with counts and digests, and whether decoding gives the text back.

    Null text counts as empty; a null id stays null; a repeated row is encoded again.
    """
    ship(spark)
    return byte_bpe.encode_documents(docs, keep_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL has no trained classifier, tagger or tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return docs
