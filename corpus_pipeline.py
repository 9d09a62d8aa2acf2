"""A training-corpus pipeline of five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strail.llm import bpe, decontam, quality, simhash, suffix_dedup
from strail.llm.common import materialize, own_names

KEEP_QUALITY = 0.3
#: Bytes of the strings that stage 5 removes where they repeat. A passage of over 50 words of prose has more (340 at the median, about 245 for the
#: shortest); the 400 bytes of op5's contract are over 60 words.
PASSAGE_BYTES = 240


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more, as query op10 scores them.

    Null, empty and blank texts score 0 and go. Equal rows are scored alike; an empty table stays empty.
    """
    (score,) = own_names(docs.columns, "quality_score")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, keep_text=True, out_col=score)
    return scored.where(F.col(score) >= KEEP_QUALITY).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints that four bits or fewer link: that of the smallest doc_id.

    Null and empty texts have fingerprint zero and are one group. Of rows that share the smallest doc_id the one of the
    smallest text stays, nulls first; groups of null ids only stay whole. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of PASSAGE_BYTES bytes that start twice; n_chars follows. All rows stay.

    Null texts stay null, and so does their n_chars; equal rows repeat each other and lose all of such a text. A
    character goes if any of its bytes does. An empty table stays empty.
    """
    return suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark within its edit budget.

    Null and empty texts hold none and stay, as do equal rows of clean documents. An empty table stays empty.
    """
    (items,) = own_names(docs.columns, "items")
    rows = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True, items_col=items)
    return rows.where(F.size(items) == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with their number and the digests of ids and of the bytes that they decode to.

    Null texts are encoded as empty ones. A row for each row; an empty table gives an empty one.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", simhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: A trained network, a fingerprint and an edit distance can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
