"""A pipeline over documents: quality classifier, toxicity, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.bagminhash import one_of_each
from sparkloom.llm.common import discard, staged, table
from sparkloom.llm.packing import packed_documents
from sparkloom.llm.quality import good_documents
from sparkloom.llm.toxicity import harmless_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged like others, null sources and languages are sites of their own, and null doc_ids are not learnt
    from. Repeated rows stay or go together; a posterior of exactly one half stays. Texts are read whole. Columns of any name stay; an
    empty table gives none.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null, empty and blank texts stay, as do null doc_ids of harmless texts. Repeated rows stay or go together; a score of exactly one
    half goes. Texts are scored whole. Columns of any name stay; an empty table gives none, and without usable labels all stay.
    """
    return harmless_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest doc_id.

    Blank texts (null, empty) are classes of their own, and rows without a doc_id all stay. Of rows that repeat a doc_id one stays,
    with the smallest text. Texts are compared whole. Columns of any name stay; an empty table gives none.
    """
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    Null and empty texts are one piece, the end's id. Null doc_ids and repeated rows are packed like others; a long text is cut in
    several pieces. Pieces of one length take their places in any order. Other columns are left out; an empty table gives none.
    """
    return packed_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]
ORACLE_SQL = None  # models and signatures are beyond SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage kept is removed from the shared folder once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # it has staged the pieces
    discard(before)
    return out
