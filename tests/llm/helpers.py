"""Small tables with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import re
import string

from pyspark.sql import types as T

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits int, kept string, key string, `end` int, score string"


def make_docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, None, "s", None, 1, "x", None, 2, "y") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def labels_table(spark, rows):
    return spark.createDataFrame(rows, T.StructType.fromDDL("doc_id long, quality int, toxic int, text string"))


def rows_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]
