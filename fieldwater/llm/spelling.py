"""Spelling variants of corpus words, paired by blocked Gram matrices of letter counts.

One inserted or deleted letter changes a word's letter counts by a squared
distance of 1, one replaced letter by 2. Words are therefore compared through
products of letter-count matrices, block against block: |x|² + |y|² - 2xy gives
all squared distances of two blocks at once, pairs at most two apart are kept,
and their letters decide.

Blocks are kept small without losing a pair. Letters fall into a few classes and a
word's cell is its sorted classes, whose number is its length. A word is placed
in its own cell and in each cell that it reaches by giving up one letter: there
the words of one length meet those of the next length, and words that differ in
one letter meet where both gave that letter up. Every near pair is found in
exactly one cell. A cell with more words than a block holds is dealt into
blocks, and each pair of blocks is one unit of work, so no cell has to fit
a task. A unit returns one row per word, its near words counted and the best of them.

A word's form is its most frequent near word where that is frequent enough;
a form's count is at least ``ratio`` times its word's, so following forms ends
after a number of steps that grows with the logarithm of the largest count.

Defined cases: a NULL or empty text has no words; a missing id counts as an
empty one; repeated rows count each time; words tie by code points. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches, stored
from fieldwater.llm.words import lower_ascii

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
MISSPELL = 199

# The letters of lower-cased runs, each in one of the classes that make up a cell.
LETTERS = "".join(chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)])
CLASSES = 8
CLASS_OF = "".join(chr(0x61 + ord(c) % CLASSES) for c in LETTERS)

# Words of one block; a unit of work holds two at most.
BLOCK = 4096
# Rows of one product, which bounds the memory of its result.
TILE = 1024

FOUND = "word string, near long, best string, best_n long"


def misspelt(run: Column, doc_id: Column, every: int = MISSPELL) -> Column:
    """The run, or the run without one letter where ``every`` divides the checksum of the document's id and the run."""
    key = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    cut = F.pmod(key, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))
    return F.when(key % every == 0, shorter).otherwise(run)


def corpus_words(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n) of the words long and frequent enough, counted over all texts."""
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({RUN})"), 1)
    # A word never has more letters than its run.
    found = docs.select(F.col(doc_id).alias("_id"), F.explode(runs).alias("run")).filter(F.length("run") >= least_letters)
    words = found.select(misspelt(F.col("run"), F.col("_id")).alias("word"))
    counted = words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def placed(words: DataFrame) -> DataFrame:
    """(cell, given, word, n): each word in its own cell, with ``given`` empty, and in those it reaches by giving up a letter of a class."""
    cell = F.array_join(F.array_sort(F.split(F.translate("word", LETTERS, CLASS_OF), "")), "")
    own = words.select("word", "n", cell.alias("whole"))
    given = F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.split("whole", ""))))
    out = own.select("word", "n", "whole", given.alias("given")).withColumn("at", F.expr("locate(given, whole)"))
    left = F.concat(F.expr("substring(whole, 1, at - 1)"), F.expr("substring(whole, at + 1)"))
    return out.select(F.when(F.col("given") == "", F.col("whole")).otherwise(left).alias("cell"), "given", "word", "n")


def units(cells: DataFrame, block: int) -> DataFrame:
    """(cell, i, j, given, b, word, n): the words of one pair of blocks, or of a whole cell that is one block."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("words"), F.count_if(F.col("given") != "").alias("longer"))
    # A cell without a second word, or with shorter words only, holds no pair.
    useful = sizes.filter("words > 1 and longer > 0").select("cell", F.ceil(F.col("words") / block).cast("int").alias("blocks"))
    met = cells.join(useful, "cell").withColumn("b", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    return met.select("*", other).select("cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "given", "b", "word", "n")


def letter_counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of letter counts; ``codes`` holds the letters of all words, one word after another."""
    column = np.where(codes < 0x80, codes - 0x61, codes - 0xC0 + 26)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    made = np.bincount(rows * len(LETTERS) + column, minlength=len(sizes) * len(LETTERS))
    return made.reshape(len(sizes), len(LETTERS)).astype(np.float32)


def close_pairs(x: np.ndarray, y: np.ndarray, apart: int = 2, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of ``x`` and ``y`` whose squared distance is at most ``apart``, by Gram products."""
    xs, ys = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left, right = [], []
    for k in range(0, len(x), tile):
        distance = x[k : k + tile] @ y.T
        distance *= -2
        distance += xs[k : k + tile, None]
        distance += ys
        a, b = np.nonzero(distance <= apart + 0.5)
        left.append(a + k)
        right.append(b)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long`` are the row of ``short`` with one letter put in."""
    size = short.shape[1]
    head = np.cumprod(short == long[:, :size], axis=1).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def near_pairs(words: list[str], given: np.ndarray, block: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of one unit, as numbers of its words.

    ``given`` holds the class number of the letter a word gave up, -1 for a word
    in its own cell; pairs are taken between two blocks (``across``), or within the only one.
    """
    kinds = []
    for longer in (False, True):
        at = np.flatnonzero((given >= 0) == longer)
        letters = np.frombuffer("".join([words[k] for k in at]).encode("utf-32-le"), "<u4").astype(np.int64)
        size = len(words[at[0]]) if len(at) else 0
        kinds.append((at, letters.reshape(len(at), size), letter_counts(letters, np.full(len(at), size))))
    (short, short_letters, short_counts), (long, long_letters, long_counts) = kinds
    left, right = [], []
    if len(short) and len(long):
        a, b = close_pairs(short_counts, long_counts)
        ok = one_inserted(short_letters[a], long_letters[b])
        if across:
            ok &= block[short[a]] != block[long[b]]
        left.append(short[a[ok]])
        right.append(long[b[ok]])
    if len(long) > 1:
        a, b = close_pairs(long_counts, long_counts)
        ok = a < b
        if across:
            ok &= block[long[a]] != block[long[b]]
        a, b = a[ok], b[ok]
        differ = long_letters[a] != long_letters[b]
        one = differ.sum(axis=1) == 1
        a, b, place = a[one], b[one], differ[one].argmax(axis=1) if one.any() else np.zeros(0, int)
        # The pair belongs to the cell where both gave up the letter in which they differ.
        ok = (long_letters[a, place] % CLASSES == given[long[a]]) & (long_letters[b, place] % CLASSES == given[long[b]])
        left.append(long[a[ok]])
        right.append(long[b[ok]])
    none = np.zeros(0, int)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _best(words: list[str], counts: np.ndarray, given: np.ndarray, block: np.ndarray, across: bool) -> tuple[list, list, list, list]:
    """Per word with near words in the unit: how many, and the most frequent."""
    a, b = near_pairs(words, given, block, across)
    if not len(a):
        return [], [], [], []
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = sorted(set(other.tolist()), key=lambda k: (-counts[k], words[k]))
    rank = np.full(len(words), len(order))
    rank[order] = np.arange(len(order))
    near = np.bincount(one, minlength=len(words))
    first = np.full(len(words), len(order))
    np.minimum.at(first, one, rank[other])
    has = np.flatnonzero(near)
    best = [order[k] for k in first[has]]
    return [words[k] for k in has], near[has].tolist(), [words[k] for k in best], [int(counts[k]) for k in best]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit come in; a unit's rows are held until the next unit begins."""
    held: list[tuple] = []
    unit = None

    def done() -> tuple[list, list, list, list]:
        given = np.array([ord(r[3]) - 0x61 if r[3] else -1 for r in held])
        block = np.array([r[4] for r in held])
        return _best([r[5] for r in held], np.array([r[6] for r in held], np.int64), given, block, unit[1] != unit[2])

    def batch(found: list[tuple[list, list, list, list]]) -> pa.RecordBatch:
        columns = [[v for f in found for v in f[k]] for k in range(4)]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "near", "best", "best_n"])

    for rows in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if row[:3] != unit:
                if len(held) > 1:
                    found.append(done())
                held, unit = [], row[:3]
            held.append(row)
        if found:
            yield batch(found)
    if len(held) > 1:
        yield batch([done()])


def near_words(words: DataFrame, block: int | None = None) -> DataFrame:
    """(word, n_near, best, best_n) of the words with a near word; ``best`` is the most frequent, smallest on a tie."""
    bounded_batches(words.sparkSession)
    dealt = units(stored(placed(words), "cells"), block or BLOCK).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "word")
    found = dealt.mapInArrow(_units, FOUND)
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")
    )


def roots(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) of every word with a form; each round doubles the steps taken, so a few rounds reach the end."""
    steps = max(1, math.ceil(math.log(max(largest, 2), ratio)) + 1)
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) + 1):
        further = reached.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        ahead = reached.join(further, F.col("root") == F.col("_word"), "left")
        reached = stored(ahead.select("word", F.coalesce("_root", "root").alias("root")), "roots")
    return reached


def spelling_variants(docs: DataFrame, ratio: int = RATIO, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every corpus word."""
    words = stored(corpus_words(docs, doc_id=doc_id, text=text), "words")
    largest = words.agg(F.max("n")).first()[0] or 1
    joined = words.join(near_words(words), "word", "left")
    frequent = F.col("best_n") >= ratio * F.col("n")
    formed = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.filter("form is not null"), largest, ratio).withColumnRenamed("word", "_word")
    return formed.join(ends, F.col("word") == F.col("_word"), "left").drop("_word").withColumn("root", F.coalesce("root", "word"))
