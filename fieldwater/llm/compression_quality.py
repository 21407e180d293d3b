"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A
text is compressed with both in blocks of fixed size, each block on its own, so
that the dictionaries matter as much at the end of a long text as at its start.
The difference of the two compressed sizes, as a share of the text's bytes, is
turned into a probability by a logistic curve fitted on all training rows.

Defined cases: a NULL or empty text has difference 0 and gets the curve's value
there; repeated rows score alike; with training rows of one class only, or
none, the score is the share of good rows (0.5 with none). Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches, held_out, stored, training_labels, training_sample

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit, all documented choices."""

    sample_rows: int = 2000  # training rows of each class the dictionaries are built from, first by hash of the id
    sample_chars: int = 1000  # of each such row, from a place its hash chooses
    dictionary_bytes: int = 112_640
    block_bytes: int = 2048
    level: int = 3
    bins: int = 2000  # differences are counted in so many steps before the curve is fitted


@dataclass(frozen=True)
class Dictionaries:
    bad: bytes
    good: bytes
    settings: Settings


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data:
        data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(raw: bytes, dictionaries: Dictionaries) -> float:
    """Compressed size with the bad dictionary less that with the good one, as a share of the bytes."""
    s = dictionaries.settings
    bad, good = (_compressor(d, s.level).compress for d in (dictionaries.bad, dictionaries.good))
    total = 0
    for i in range(0, len(raw), s.block_bytes):
        block = raw[i : i + s.block_bytes]
        total += len(bad(block)) - len(good(block))
    return total / max(1, len(raw))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def build_dictionaries(train: DataFrame, settings: Settings = Settings()) -> Dictionaries:
    """Dictionaries from a sample of (id, text, y), of which a bounded piece of each text is used."""
    span = F.greatest(F.length("text") - settings.sample_chars, F.lit(0)) + 1
    piece = F.substr("text", F.pmod(F.xxhash64("id", F.lit("place")), span).cast("int") + 1, F.lit(settings.sample_chars))
    made = []
    for y in (0, 1):
        rows = train.filter(F.col("y") == y).select(F.xxhash64("id").alias("h"), piece.alias("piece"))
        made.append(_dictionary([r["piece"].encode() for r in rows.orderBy("h", "piece").collect()], settings.dictionary_bytes))
    return Dictionaries(made[0], made[1], settings)


def _differences(batches: Iterator[pa.RecordBatch], dictionaries: Dictionaries) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [difference(raw or b"", dictionaries) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "difference"])


def differences(docs: DataFrame, dictionaries: Dictionaries, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, difference) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(partial(_differences, dictionaries=dictionaries), "doc_id long, difference double")


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve by Newton steps; a weak penalty keeps the slope finite."""
    good, bad = weight[y == 1].sum(), weight[y == 0].sum()
    if not good or not bad:
        return (math.log((good + 0.5) / (bad + 0.5)) if good + bad else 0.0), 0.0
    scale = max(1e-9, float(np.sqrt((weight * x**2).sum() / weight.sum())))
    design = np.stack([np.ones(len(x)), x / scale])
    b = np.array([math.log(good / bad), 0.0])
    penalty = np.diag([1e-6, 0.01])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b @ design, -30, 30)))
        slope = design @ (weight * (y - p)) - penalty @ b
        curve = (design * (weight * p * (1 - p))) @ design.T + penalty
        step = np.linalg.solve(curve, slope)
        b = b + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1] / scale)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, difference) for every row."""
    train = training_sample(docs, labels, "quality", settings.sample_rows, doc_id, text)
    found = stored(differences(docs, build_dictionaries(train, settings), doc_id, text), "differences")
    # Every training row counts in the curve, by the step its difference falls into.
    step = F.round(F.col("difference") * settings.bins / 2) * 2 / settings.bins
    counts = found.join(training_labels(labels, "quality"), F.col("doc_id") == F.col("id")).groupBy(step.alias("x"), "y").agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([r[k] for r in counts], float) for k in ("x", "y", "n"))
    offset, slope = fit_curve(x, y, n)
    score = 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col("difference"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), "difference").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
