"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame.  All but
the last return the columns of ``docs``:

language   documents whose language is undetermined or below the calibrated
           threshold go (operator 6)
quality    documents whose calibrated quality is below ``QUALITY`` go (operator 5)
copies     of each component of near copies one document stays, the one with the
           smallest doc_id (operator 10)
personal   spans of personal data in the text give way to their kind in square
           brackets; n_chars follows (operator 4)
packing    ids of the documents, cut and packed into sequences of 1024 (operator 9);
           one row a piece

Null texts are rejected by the first stage; an empty table stays empty through all
five.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.llm import compress_quality, histogram_packing, pii_bootstrap, subword_langid, trie_join
from railpulse.llm.common import held_out
from railpulse.session import scratch_path

#: Documents of a lower probability of label 1 are rejected.
QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = subword_langid.fit(docs, ~held_out())
    return subword_langid.predict(docs, model).where("NOT rejected").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = compress_quality.fit(docs, labels, ~held_out())
    return compress_quality.predict(docs, model, threshold=QUALITY).where("predicted = 1").select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return trie_join.one_of_each(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii_bootstrap.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def derive(cut_up: DataFrame) -> DataFrame:
        return cut_up.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")

    return histogram_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), derive=derive)


STAGES = [("language", language), ("quality", quality), ("copies", copies), ("personal", personal), ("packing", packing)]

#: Trained models and a tokenizer's ids have no SQL; tests compare with a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = uuid.uuid4().hex
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{own}-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
