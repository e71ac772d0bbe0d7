"""A training corpus from `documents`: toxic and poor documents go, near duplicates are thinned, sources mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm import bpe, mixing, near_dedup, quality, toxicity
from arborq.llm.common import checkpointed, fresh_name, table

REJECT_TOXIC, ACCEPT_QUALITY = 0.5, quality.ACCEPT


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below REJECT_TOXIC. Null and empty texts hold no entry and stay; repeated rows are judged alike; an empty table stays empty."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    at = fresh_name(docs, "score")
    scored = toxicity.score(docs, model, out=at)
    return scored.where(scored[at] < REJECT_TOXIC).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored ACCEPT_QUALITY or more. A null text is judged as an empty one; repeated rows are judged alike; an empty table stays empty."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    at = fresh_name(docs, "score")
    scored = quality.score(docs, model, out=at)
    return scored.where(scored[at] >= ACCEPT_QUALITY).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies. Null and blank texts and rows without an id stay; rows that repeat an id are one document."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once, in the order of the mix: part files of consecutive slots. Rows without a source share a pool; an empty table stays empty."""
    return mixing.in_order(mixing.mix(docs, mixing.tempered_weights(docs)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every row's whole text; a null text has no ids. Repeated rows and ids stay; an empty table gives no rows."""
    return bpe.digests(docs, bpe.vocabulary())


def scheduled(docs: DataFrame) -> DataFrame:
    """(doc_id, text, pool, slot) of every document: its place in the mix as columns, which outlive any reordering of rows."""
    return mixing.mix(docs, mixing.tempered_weights(docs)).select("row.doc_id", "row.text", "pool", "slot")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Learned models and alignments are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' corpus, each row with its pool and slot. Slots are unique, so encoded texts are joined by them.

    What each stage leaves is written to the checkpoint folder: the next one's passes read it, and no document is judged again.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-2]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    schedule = checkpointed(scheduled(docs))
    coded = bpe.digests(schedule.select(F.col("slot").alias("doc_id"), "text"), bpe.vocabulary()).withColumnRenamed("doc_id", "slot")
    return schedule.select("doc_id", "pool", "slot").join(coded, "slot").select("doc_id", "pool", "slot", "n_tokens", "ids_sha256", "decoded_sha256")
