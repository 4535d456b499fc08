"""From raw documents to training tokens: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cattedra.llm import bpe, line_dedup, mixing, simhash, toxicity
from cattedra.llm.common import temporary, write_shared
from cattedra.llm.queries import bpe_digests


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores at 0.7 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; a document without any line left stays, with an empty text."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_key=1)
    text = F.coalesce("kept_text", F.lit(""))
    return kept.withColumns({"text": text, "n_chars": F.char_length(text).cast("long")}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, shingle=3, max_bits=2))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the cube method takes it: 0, 1 or 2 times."""
    return mixing.take(docs, mixing.mix(docs, weights=[3, 1, 2], share=1.5, most=2.0))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the text they decode to."""
    tokens = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return bpe_digests(tokens)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("bpe", encode_bpe)]

#: Training, hashing and sampling are not SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary(spark, keep=f"pipeline-{name}"):  # what a stage wrote on the way goes, its rows stay
            docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
