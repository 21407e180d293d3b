"""Benchmark decontamination with a positional inverted index.

The postings of a training document, term by term with its word positions, are
stored with that document, so the index is partitioned by document and a search
needs no shuffle. Only terms that the test windows use are stored. A window is
searched from its rarest term (rarest in the whole training set): the position
lists, shifted by each term's offset in the window, are intersected one after
another and most windows end at the first or second list.

Defined cases: a NULL or empty text has no words and no hits; an item of fewer
words than a window is one window; an item without words has none. Repeated
documents are each answered; repeated items count once by id, items of NULL id
are left out. Other columns of either table are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwater.llm.store import bounded_batches, small, stored
from fieldwater.llm.words import word_array, words

WINDOW = 10
# Windows that one pass holds in memory; a larger test set takes several passes.
WINDOWS_PER_PASS = 50_000

POSTINGS = "doc_id long, digest string, n_words long, terms array<int>, counts array<int>, positions binary"
FOUND = "doc_id long, digest string, n_words long, hits array<int>, found array<long>, near array<long>"


def item_windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): every run of ``size`` consecutive words, or all words of a shorter item."""
    # Exploded out of an array of one, so that the words are taken once and not again for every window.
    listed = items.select(F.col(item_id).alias("item"), F.explode(F.array(word_array(F.col(text)))).alias("w")).filter(
        F.col("item").isNotNull() & (F.size("w") > 0)
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    runs = F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(size)))
    return listed.select("item", F.explode(runs).alias("window")).distinct()


def _index(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """One row a document: its terms, how often each occurs, and the positions grouped by term."""
    get, schema = vocabulary.get, None
    for batch in batches:
        n_words, sizes, terms, counts, places = [], [0], [], [], []
        for raw in batch.column(2).to_pylist():
            own = words(raw or b"")
            ids = np.fromiter(map(get, own, repeat(-1)), np.int32, len(own))
            at = np.flatnonzero(ids >= 0).astype(np.int32)
            order = np.argsort(ids[at], kind="stable")
            kinds, times = np.unique(ids[at], return_counts=True)
            n_words.append(len(own))
            sizes.append(sizes[-1] + len(kinds))
            terms.append(kinds)
            counts.append(times.astype(np.int32))
            places.append(at[order].tobytes())
        offsets = pa.array(sizes, pa.int32())
        arrays = [
            batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms) if terms else [], pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts) if counts else [], pa.int32())),
            pa.array(places, pa.binary()),
        ]
        names = ["doc_id", "digest", "n_words", "terms", "counts", "positions"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the postings of the given terms for every document."""
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(body).alias("digest"), body.cast("binary").alias("raw"))
    return stored(rows.mapInArrow(lambda it: _index(it, vocabulary), POSTINGS), "postings")


def term_counts(index: DataFrame) -> dict[int, int]:
    """How often each stored term occurs in all documents."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    summed = pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))
    return {r["term"]: r["n"] for r in summed.toLocalIterator()}


class Windows:
    """Test windows ordered for searching: (id, ((term, offset), ...) from the rarest term on, terms)."""

    def __init__(self, windows: list[tuple[int, list[int]]], counts: dict[int, int]) -> None:
        self.by_anchor: dict[int, list] = defaultdict(list)
        for key, terms in windows:
            plan = sorted(((t, o) for o, t in enumerate(terms)), key=lambda x: (counts.get(x[0], 0), x))
            self.by_anchor[plan[0][0]].append((key, plan, frozenset(terms)))


def phrase_starts(lists: dict[int, np.ndarray], plan: list[tuple[int, int]]) -> np.ndarray:
    """Start positions at which all terms stand at their offsets."""
    term, offset = plan[0]
    starts = lists[term] - offset
    starts = starts[starts >= 0]
    for term, offset in plan[1:]:
        if not len(starts):
            break
        other = lists[term]
        at = np.searchsorted(other, starts + offset)
        starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == starts + offset)]
    return starts


def stands_near(lists: dict[int, np.ndarray], plan: list[tuple[int, int]], span: int) -> bool:
    """Whether all distinct terms occur, in any order, within ``span`` consecutive words."""
    terms = list(dict.fromkeys(t for t, _ in plan))
    anchors = lists[terms[0]]
    # A span that holds every term holds an anchor; drop anchors that have no next rarest term around.
    for term in terms[1:]:
        other = lists[term]
        at = np.searchsorted(other, anchors - span + 1)
        anchors = anchors[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] < anchors + span)]
        if not len(anchors):
            return False
    lefts = np.unique(np.concatenate([x[_close(x, anchors, span)] for x in (lists[t] for t in terms)]))
    last = lefts
    for term in terms:
        other = lists[term]
        at = np.searchsorted(other, lefts)
        last = np.maximum(last, np.where(at < len(other), other[np.minimum(at, len(other) - 1)], np.iinfo(np.int32).max))
    return bool((last - lefts < span).any())


def _close(places: np.ndarray, anchors: np.ndarray, span: int) -> np.ndarray:
    """Which places have an anchor less than ``span`` words away."""
    at = np.searchsorted(anchors, places - span + 1)
    return (at < len(anchors)) & (anchors[np.minimum(at, len(anchors) - 1)] < places + span)


def _search(batches: Iterator[pa.RecordBatch], windows: Windows, span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_hits, all_found, all_near = [], [], []
        rows = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
        for terms, counts, raw in rows:
            places, bounds = np.frombuffer(raw, np.int32), np.cumsum([0, *counts])
            lists = {t: places[bounds[i] : bounds[i + 1]] for i, t in enumerate(terms)}
            hits, found, near = [], [], []
            for anchor in terms:
                for key, plan, needed in windows.by_anchor.get(anchor, ()):
                    if not needed <= lists.keys():
                        continue
                    starts = phrase_starts(lists, plan)
                    if len(starts):
                        found.append(key)
                        hits.append((starts[:, None] + np.arange(len(plan))).ravel())
                    if len(starts) or stands_near(lists, plan, span):
                        near.append(key)
            all_hits.append(np.unique(np.concatenate(hits)) if hits else [])
            all_found.append(found)
            all_near.append(near)
        arrays = [
            batch.column(0), batch.column(1), batch.column(2), pa.array(all_hits, pa.list_(pa.int32())),
            pa.array(all_found, pa.list_(pa.int64())), pa.array(all_near, pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_words", "hits", "found", "near"])


def search(index: DataFrame, windows: Windows, span: int) -> DataFrame:
    """Exact and near windows of every indexed document."""
    bounded_batches(index.sparkSession)
    return index.mapInArrow(lambda it: _search(it, windows, span), FOUND)


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, span: int = 2 * WINDOW, windows_per_pass: int = WINDOWS_PER_PASS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """Match every document against every test window.

    Returns doc_id, digest (of the text), n_words, hits (positions inside any
    exact window), items (ids with an exact window, sorted as strings) and
    near_items (ids with a window whose words all stand within ``span`` words).
    """
    pairs = stored(
        item_windows(items, size, item_id).withColumn("key", F.xxhash64("window")).select("key", "window", "item"), "windows"
    )
    passes = max(1, math.ceil(pairs.select("key").distinct().count() / windows_per_pass))
    results = []
    for k in range(passes):
        part = pairs.filter(F.pmod("key", F.lit(passes)) == k).select("key", "window").distinct()
        listed = [(r["key"], [w.encode() for w in r["window"]]) for r in part.toLocalIterator()]
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
        index = build_index(docs, vocabulary, doc_id, text)
        ordered = Windows([(key, [vocabulary[w] for w in ws]) for key, ws in listed], term_counts(index))
        results.append(search(index, ordered, span))
    found = results[0]
    if passes > 1:
        # One row a document and pass: bring them together, then give repeated documents their rows again.
        for other in results[1:]:
            found = found.unionByName(other)
        gather = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = (
            found.groupBy("doc_id", "digest", "n_words")
            .agg(gather("hits"), gather("found"), gather("near"), (F.count("*") / passes).cast("int").alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .drop("copies", "copy")
        )
    found = stored(found, "found")
    # The answer holds few documents, so only those are joined with the items of their windows.
    touched = found.filter(F.size("near") > 0).select("doc_id", "digest", "found", "near").distinct()
    places = F.transform("near", lambda k: F.struct(k.alias("key"), F.array_contains("found", k).alias("exact")))
    item = F.col("item").cast("string")
    named = stored(
        touched.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.inline(places))
        .join(pairs.select("key", "item"), "key")
        .groupBy("_doc", "_digest")
        .agg(F.array_sort(F.collect_set(F.when(F.col("exact"), item))).alias("items"), F.array_sort(F.collect_set(item)).alias("near_items")),
        "contaminated",
    )
    joined = found.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    none = F.array().cast(T.ArrayType(T.StringType()))
    return joined.select(
        "doc_id", "digest", "n_words", "hits", F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """The report row of each document."""
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def contaminated(row_hits: Column) -> Column:
    return F.size(row_hits) > 0


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents no test window occurs in, with all their columns."""
    found = contamination(docs, items, text=text).filter(contaminated(F.col("hits")))
    bad = small(stored(found.select(F.col("digest").alias("_bad")).distinct(), "bad"))
    return docs.join(bad, F.md5(F.coalesce(docs[text], F.lit(""))) == F.col("_bad"), "left_anti")
