"""A corpus pipeline over ``documents``: toxicity, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet
and read again as the next stage's documents. All but the last return the columns of documents.

Defined results, of every stage but where said otherwise: rows are judged one by one, so null and
repeated ids are kept or dropped as rows; null text is the empty text; further columns are carried
whatever their names; an empty table gives an empty table. Toxicity: without labels of both kinds
every text has the share of label 1 as its score, and goes if that is 0.5 or more. Exact and near
dedup: the row with the smallest doc_id stays, null ids come last, and of equal ids the row that
comes first in its file; a text without words has no near copies. Decontamination: texts without
words stay; an empty benchmark drops nothing. Mixing: a null source is a source; mix_block, mix_slot
and mix_position take the place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm.common import drop_scratch, scratch_so_far, stored, table
from sluiceway.llm.decontaminate import drop_contaminated
from sluiceway.llm.exact_dedup import drop_copies
from sluiceway.llm.mixing import mixed_documents
from sluiceway.llm.near_dup import drop_near_copies
from sluiceway.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage fits boosted trees, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_so_far()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(spark, mark, keep=1)  # nothing reads the stage's own tables and input any more
    return docs
