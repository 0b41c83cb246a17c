"""Documents to packed training sequences: language, toxicity, near duplicates, personal data, packing.

Every stage takes what its predecessor kept and returns a DataFrame; stages are written as
Parquet in the shared folder and read again by the next. All but the last return the columns
of `documents`. ORACLE_SQL is None: models, SimHash and tokenizers are beyond SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm import common, langid, packing, pii, simhash, toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs))


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, size=5, similarity=0.8, distance=2)


def sanitise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("toxicity", clean_of_toxicity),
    ("near_dedup", near_dedup),
    ("pii", sanitise_pii),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences; what stages save on the way is dropped once the next one has been written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.steps() as saved:
            done = common.Saved(stage(spark, docs, sf_dir), name)
            saved.remove(done)
        if before:
            before.drop()
        docs, before = done.df, done
    return docs
