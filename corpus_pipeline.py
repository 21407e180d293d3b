"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
reads it from Parquet. All but the last return the columns of ``documents`` for
the rows that stay. A missing or empty table, NULL texts, repeated rows and
extra columns go through as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwater.llm.decontaminate import without_contaminated
from fieldwater.llm.exact_dedup import without_copies
from fieldwater.llm.near_dedup import without_near_copies
from fieldwater.llm.packing import digest_columns, pack
from fieldwater.llm.queries import TOKENIZER, table
from fieldwater.llm.store import stored
from fieldwater.llm.toxicity import without_toxic

# Word-shingle similarity, in hundredths, from which the stage takes documents for near copies; its bands and rows miss a pair there
# with probability 6e-7.
NEAR_PERCENT = 80
NEAR_BANDS = (36, 5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, doesn't reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of equal texts."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies: similarity 0.8 or more, where op7 asks for 0.85."""
    return without_near_copies(docs, NEAR_PERCENT, *NEAR_BANDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences."""
    return digest_columns(pack(docs, TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# A trained classifier and a tokenizer decide rows, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
