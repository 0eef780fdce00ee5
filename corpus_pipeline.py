"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of documents. A stage is lazy or writes its own intermediate tables to the
shared folder; ``run`` also writes each stage's result there, so that no stage is computed twice and
a lost executor costs one stage at most.

A null or empty text has no words, so the first stage rejects it; very long texts are worked on whole.
A null id stays null and is as good as others, but of a group of near-duplicates a row with an id stays
before one without. Of fully equal rows one stays. Columns that documents have besides their own go
through the first four stages unchanged, whatever their names. Empty tables give no rows. Surrogates
are made with the session's ``spark.lodestar.pii.secret``, or a key that only this application has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, packing, pii, quality, simhash
from lodestar.llm._common import Workspace, read
from lodestar.llm.tokens import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep; trained on the labelled rows among docs."""
    return quality.keep(spark, docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the smallest doc_id."""
    return simhash.dedup(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    return decontaminate.clean(spark, docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced in their texts."""
    return pii.rewritten(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return packing.pack(spark, docs, default_tokenizer())


STAGES = [("quality", quality_rules), ("simhash", near_dedup), ("decontaminate", decontaminated), ("pii", personal_data), ("packing", packed)]

#: Trained trees, keyed surrogates and a tokenizer are not SQL; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the whole documents table."""
    ws = Workspace(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
