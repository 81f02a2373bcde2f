"""A corpus pipeline: documents through five stages, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns the shard and slot of each copy that the mix takes: a placement, not
the texts. A null or empty text fails the quality rules and so goes no further; rows without a doc_id
are no copies of others; rows that repeat a doc_id are one document; an empty table gives no
rows; columns beyond those of ``documents`` are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontamination, mixing, near_dedup, rules, sharding
from strandline.llm.common import can_checkpoint, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the rule ledger. Null and empty texts fail it; rows are judged one by one."""
    return rules.keep_documents(docs.select(*COLUMNS), "v1")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8.

    Null and empty texts and rows without a doc_id are copies of nothing and stay; of rows that repeat a doc_id one stays.
    """
    return near_dedup.keep_first(docs.select(*COLUMNS), width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. Null and empty texts, of documents or items, match nothing."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it: texts without words never, a null source as one of its own."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each copy; a null text has size 1, repeated rows have slots of their own."""
    return sharding.shard_by_bytes(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Splitters are drawn with xxhash64, which DuckDB has not, so the rows are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each kept is written to the shared checkpoint folder."""
    can_checkpoint(spark)
    docs, run_id = table(spark, sf_dir, "documents"), uuid.uuid4()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{run_id}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
