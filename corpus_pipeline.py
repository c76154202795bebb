"""A training-corpus pipeline over ``documents``: toxicity, quality rules, near-dedup, PII, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet in the shared
folder and reads back as the next one's ``docs``. All but the last return the columns of ``documents``; rows
that a stage rejects are gone, and texts that it changes stay changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkeel.llm import nearcopies, packing, pii, quality, toxicity
from lexkeel.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under 0.5; the model learns from this stage's own documents.

    Null and empty texts score as the bias says; texts are read whole; rows repeat as often as they came; an empty table stays empty; further columns end here.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=list(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the current policy keeps.

    Null, empty and blank texts have too few words and go; texts are read whole; repeated rows share their fate; an empty table stays empty; further columns end here.
    """
    return quality.apply_policy(quality.ledger(docs)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: 5-word Jaccard similarity of 0.8 or more, or SimHash within its radius.

    The smallest id stays, of rows that repeat it one; rows without an id all stay; null and empty texts are one group; an empty table stays empty; further columns end here.
    """
    return nearcopies.one_of_each(docs).select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows the text.

    A null text stays null, with a null ``n_chars``; texts are read whole; repeated rows stay as often as they came; an empty table stays empty; further columns end here.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each a sequence of a power of two of tokens.

    A null or empty text is the end token alone; long ones are as many pieces as they need; repeated rows each give their pieces; an empty table gives none; further columns end here.
    """
    return packing.pack(docs, keep=["doc_id"]).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_pii),
    ("packing", pack),
]

#: Learnt weights and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
