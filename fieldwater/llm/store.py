"""Stage tables in the shared folder, Arrow batch bounds and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwater.session import checkpoint_dir

# Rows of one Arrow batch handed to Python, and its size where Spark knows that setting.
BATCH_ROWS = 512
BATCH_BYTES = "16m"

# A side is broadcast only after it was written and found to have no more rows than this.
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast when it was counted and is within the bound; else leave the choice to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


# A key with more rows than this is joined apart from the others.
HOT_ROWS = 1_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Join ``facts``, one row a key, to ``rows``, whose keys may be shared by many of them.

    Keys with more than ``HOT_ROWS`` rows, of which there are few by that, get
    their facts by a counted broadcast, so no task is dealt all rows of one key.
    """
    hot = stored(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select(key), "hot")
    few = hot.count()
    if not few:
        return rows.join(facts, key)
    known = small(stored(facts.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, key, "left_semi"), "hot-facts"))
    names = [*rows.columns, *[c for c in facts.columns if c != key]]
    rest = rows.join(F.broadcast(hot) if few <= BROADCAST_ROWS else hot, key, "left_anti").join(facts, key)
    return rows.join(known, key).select(*names).unionByName(rest.select(*names))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless they find it where the driver does."""
    package = Path(__file__).resolve().parents[1]
    known = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if app not in _shipped and str(package.parent) not in known:
        archive = f"{tempfile.mkdtemp()}/{package.name}"
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
    _shipped.add(app)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that tasks hold, since one batch of long texts could fill a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows kept out of training: crc32 of the id as text, modulo the folds, is 0. A missing id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(id, y) of the labelled documents that are not held out.

    Repeated labels of one document count once, by their largest value; labels
    other than 0 and 1 and missing ids are left out.
    """
    usable = labels.filter(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
    return usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(target).cast("int").alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of at most ``rows`` training documents of each class, first by hash of the id.

    The sampled ids are few by that bound, so they are broadcast, and no text is moved to find its label.
    """
    known = training_labels(labels, target)
    first = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
    wanted = first(0).unionByName(first(1)).withColumnRenamed("id", "_label_id")
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A document repeated under one id counts once.
    return texts.join(F.broadcast(wanted), F.col("id") == F.col("_label_id")).groupBy("id", "y").agg(F.min("text").alias("text"))
