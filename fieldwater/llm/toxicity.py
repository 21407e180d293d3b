"""Toxicity classifier with a counterfactual penalty.

A text is described by which words, and beginnings of words, of a vocabulary
occur in it, so long texts weigh no more than short ones. The model is fitted on a bounded sample of
training rows. The vocabulary holds the words whose document counts differ most
between the two classes, and the identity terms; their weights are those of a
logistic model, on the scale of log odds. Two kinds of counterfactual copies are penalised by
their squared change of log odds: a sampled sentence with an identity term is
copied with each other term of that group in its place, and a fixed share of
all sampled sentences, with or without such a term, is copied with a term put in, for each term.
The first pulls the terms of a group together, the second pulls a mention
toward no effect, also where the sample happens to hold few mentions.

The fit gives both classes the same weight. Its log odds are then calibrated on
the sampled rows, weighted back to the class counts of all training rows, so a
text without evidence scores like the share of toxic rows and not one half.

Defined cases: a NULL or empty text has no words and gets the model's base
score; repeated rows score alike; without telling words every text scores the share of toxic rows;
with no training rows, or one class only, the score is that class (0 with none). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches, held_out, stored, training_labels, training_sample
from fieldwater.llm.words import words

THRESHOLD = 0.5

# Identity terms by group in the languages of the documents, fixed values: within a group any term may stand for any other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african"),
    ("american", "mexican", "chinese", "indian", "european"),
    ("blind", "deaf", "disabled"),
    ("young", "old", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("schwul", "lesbisch", "bisexuell", "hetero"),
    ("christ", "moslem", "jude", "hindu", "buddhist", "atheist"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("türken", "polen", "russen", "deutsche", "chinesen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("gai", "lesbienne", "bisexuel", "hétéro"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("arabes", "africains", "chinois", "européens", "français"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("lesbiana", "homosexual", "bisexual", "heterosexual"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mexicanos", "africanos", "chinos", "europeos", "españoles"),
)


@dataclass(frozen=True)
class Settings:
    """Bounds and weights of the fit, all documented choices."""

    vocabulary: int = 4096  # most telling words kept
    least_docs: int = 3  # a word must occur in so many training rows
    least_z: float = 4.0  # and its two class rates must differ by so many standard errors
    sample_rows: int = 20_000  # training rows of each class that the fit sees at most, first by hash of the id
    penalty: float = 1.0  # squared weights
    counterfactual: float = 50.0  # squared change of log odds by a swapped identity term
    placed: float = 0.05  # share of the sampled sentences that are copied with a term put in, for each term
    steps: int = 300
    groups: tuple = field(default=IDENTITY_TERMS)


PREFIXES = (4, 5)


def text_features(raw: bytes) -> set[str]:
    """The distinct words, all letters lower-cased, and the first letters of longer ones, marked as such.

    Prefixes let the forms and compounds of a word speak for each other.
    """
    own = set(words(raw.decode("utf-8", "replace").lower().encode()))
    found = set(b" ".join(own).decode().split(" ")) if own else set()
    return found | {f"{w[:n]}~" for n in PREFIXES for w in found if len(w) > n}


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [list(text_features(raw)) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string())), batch.column(2)], ["id", "words", "y"])


def _numbered(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The numbers of a row's known features, as 32-bit integers."""
    for batch in batches:
        ids = [np.array(sorted(index[w] for w in index.keys() & own), np.int32).tobytes() for own in map(set, batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary())], ["y", "ids"])


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, raw: bytes | None) -> float:
        known = self.weights.keys() & text_features(raw or b"")
        z = self.bias + math.fsum(self.weights[w] for w in known)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _logistic(
    rows: list[np.ndarray], y: np.ndarray, size: int, pairs: dict[tuple[int, int], float], mentions: np.ndarray, s: Settings
) -> tuple[float, np.ndarray]:
    """Balanced logistic fit by accelerated gradient steps.

    ``pairs`` holds swapped terms and how many sentences swap them, ``mentions`` for each feature how many copies put it in.
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    left, right = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    times = np.array(list(pairs.values()), float) * s.counterfactual
    # Diagonal bounds of the curvature keep every step safe without a line search.
    pull = s.penalty + s.counterfactual * mentions
    curve = np.bincount(flat, 0.25 * share[owner] * lengths.clip(1)[owner], size) + pull
    curve += 4 * (np.bincount(left, times, size) + np.bincount(right, times, size))
    bias_curve = 0.25 * (share * (lengths + 1)).sum()
    w, bias = np.zeros(size), 0.0
    ahead, bias_ahead, pace = w.copy(), bias, 1.0
    for _ in range(s.steps):
        z = bias_ahead + np.bincount(owner, ahead[flat], len(rows))
        gap = share * (1 / (1 + np.exp(-z.clip(-30, 30))) - y)
        change = times * (ahead[left] - ahead[right])
        slope = np.bincount(flat, gap[owner], size) + pull * ahead
        slope += 2 * (np.bincount(left, change, size) - np.bincount(right, change, size))
        new, new_bias = ahead - slope / curve, bias_ahead - gap.sum() / bias_curve
        new_pace = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        keep = (pace - 1) / new_pace
        ahead, bias_ahead = new + keep * (new - w), new_bias + keep * (new_bias - bias)
        w, bias, pace = new, new_bias, new_pace
    return bias, w


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from log odds ``z`` to the weighted rows' labels.

    Targets are drawn in by half a row of each class, so separable rows have a finite curve; the slope is at least 0.
    """
    bad, good = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    center, spread = float(np.average(z, weights=weight)), max(float(z.std()), 1e-9)
    u = (z - center) / spread if z.std() > 1e-9 else np.zeros(len(z))
    slope, shift = 0.0, math.log((bad + 1) / (good + 1))

    def loss(a: float, b: float) -> float:
        t = a * u + b
        return float((weight * (np.logaddexp(0, t) - target * t)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-(slope * u + shift).clip(-30, 30)))
        gap, curve = weight * (p - target), weight * p * (1 - p)
        h = np.array([[(curve * u * u).sum() + 1e-6, (curve * u).sum()], [(curve * u).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(h, [(gap * u).sum(), gap.sum()])
        size, now = 1.0, loss(slope, shift)
        while size > 1e-6 and loss(slope - size * step[0], shift - size * step[1]) > now:
            size /= 2
        slope, shift = slope - size * step[0], shift - size * step[1]
        if size * np.abs(step).max() < 1e-9:
            break
    slope = max(float(slope), 0.0) / spread
    return slope, float(shift) - slope * center


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from the labelled rows that are not held out."""
    bounded_batches(docs.sparkSession)
    rows = training_sample(docs, labels, "toxic", settings.sample_rows, doc_id, text).select("id", F.col("text").cast("binary").alias("text"), "y")
    train = stored(rows.mapInArrow(_distinct, "id long, words array<string>, y int"), "toxicity")
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    every = {r["y"]: r["n"] for r in training_labels(labels, "toxic").groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        share = bad / max(1, bad + good)
        return Model(30.0 if share else -30.0, {})
    counted = train.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.sum("y").alias("b"), F.count("*").alias("n"))
    pooled = F.col("n") / (bad + good)
    rate = F.col("b") / bad - (F.col("n") - F.col("b")) / good
    z = F.abs(rate) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / bad + 1 / good))
    telling = counted.filter(F.col("n") >= settings.least_docs).withColumn("z", z).filter(F.col("z") >= settings.least_z)
    picked = [r["word"] for r in telling.orderBy(F.desc("z"), "word").limit(settings.vocabulary).collect()]
    terms = [t for group in settings.groups for t in group]
    # A swap changes a term and nothing else: what a term begins with is no feature of its own.
    begins = {f"{t[:n]}~" for t in terms for n in PREFIXES}
    names = list(dict.fromkeys([w for w in picked if w not in begins] + terms))
    index = {w: i for i, w in enumerate(names)}
    known = train.select("words", "y").mapInArrow(partial(_numbered, index=index), "y int, ids binary").collect()
    x = [np.frombuffer(r["ids"], np.int32) for r in known]
    pairs: dict[tuple[int, int], float] = {}
    group_of = {index[t]: [index[o] for o in group if o != t] for group in settings.groups for t in group}
    for ids in x:
        for term in group_of.keys() & ids.tolist():
            for other in group_of[term]:
                pairs[term, other] = pairs.get((term, other), 0.0) + 1.0
    mentions = np.zeros(len(names))
    mentions[list(group_of)] = settings.placed * len(x)
    y = np.array([r["y"] for r in known])
    bias, w = _logistic(x, y, len(names), pairs, mentions, settings)
    z = bias + np.array([w[ids].sum() for ids in x])
    slope, shift = calibrated(z, y, np.where(y == 1, every[1] / bad, every[0] / good))
    return Model(slope * bias + shift, {n: slope * float(v) for n, v in zip(names, w, strict=True) if v})


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.score(raw) for raw in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])


def _clean(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [model.score(raw) < THRESHOLD for raw in batch.column(at).cast(pa.binary()).to_pylist()]
        yield batch.filter(pa.array(kept, pa.bool_()))


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("binary").alias("raw"))
    scored = rows.mapInArrow(partial(_scored, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents the model does not reject, with all their columns in order."""
    model = fit(docs, labels, doc_id=doc_id, text=text)
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_clean, model=model, at=docs.columns.index(text)), docs.schema)
