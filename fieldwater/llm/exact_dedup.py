"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are compared after every run of ASCII white space became one space. Rows
are grouped by length, then rows of shared lengths by a hash of their first
characters, then only rows that still have company by the hash of the whole
text. The first two groupings count, and counts are summed before they are
shuffled, so a length or prefix that a third of all rows share costs no more
than any other.

Defined cases: a NULL text counts as empty, and all empty texts are equal. Of
equal texts the smallest id stays; NULL ids come last. Rows that repeat both id
and text are one document: each counts in ``group_size``, and all of them are
kept or none. Other columns are ignored by ``exact_groups`` and kept by
``without_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import small, stored

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; runs that are one space already are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _sized(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("body"))
    return rows.select("doc_id", "body", F.length("body").alias("size"), F.xxhash64(F.substring("body", 1, PREFIX_CHARS)).alias("prefix"))


def exact_groups(docs: DataFrame, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    ``text_sha256`` is the hash of the whole text. It is NULL for rows that an
    earlier grouping already found to be alone, unless ``digest`` asks for all.
    """
    sized = stored(_sized(docs, doc_id, text).groupBy("size", "prefix").agg(F.count("*").alias("n")), "sizes")
    lengths = sized.groupBy("size").agg(F.sum("n").alias("rows")).filter("rows > 1").select("size")
    alike = stored(sized.filter("n > 1").join(lengths, "size", "left_semi").select("size", "prefix", F.lit(True).alias("alike")), "alike")
    rows = _sized(docs, doc_id, text).join(small(alike), ["size", "prefix"], "left")
    full = F.sha2("body", 256)
    shared = F.coalesce("alike", F.lit(False))
    hashed = stored(
        rows.select("doc_id", shared.alias("shared"), (full if digest else F.when(shared, full)).alias("text_sha256")), "hashed"
    )
    groups = stored(
        hashed.filter("shared").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    alone = hashed.filter("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    together = hashed.filter("shared").join(small(groups), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(together).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    copies = stored(exact_groups(docs, doc_id=doc_id, text=text).filter("group_size > 1"), "copies")
    dropped = stored(copies.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "dropped")
    body = F.sha2(normalised(docs[text]), 256)
    rest = docs.join(small(dropped), docs[doc_id].eqNullSafe(F.col("_id")) & (body == F.col("_sha")), "left_anti")
    # A document repeated whole, id and text, still has all its rows here.
    twice = copies.filter("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).count().filter("count > 1")
    if twice.isEmpty():
        return rest
    again = docs[doc_id].eqNullSafe(F.col("_id")) & (body == F.col("_sha"))
    return rest.join(twice, again, "left_anti").unionByName(rest.join(twice, again, "left_semi").dropDuplicates([doc_id, text]))
