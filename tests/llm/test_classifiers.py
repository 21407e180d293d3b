import random
import zlib

import pytest

from fieldwater.llm import compression_quality as Q
from fieldwater.llm import toxicity as X
from fieldwater.llm.queries import table
from tests.llm.helpers import empty_docs, labels_table, make_docs

CLEAN = "the river runs past an old mill and people walk there on sunday with their dogs when it is warm".split()
RUDE = "moron scum idiot".split()
SF = "/root/testdata/sf0.1"


def corpus(count=600, seed=1):
    draw = random.Random(seed)
    docs, labels = [], []
    for k in range(count):
        words, toxic = [draw.choice(CLEAN) for _ in range(draw.randrange(5, 60))], k % 5 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(RUDE)
            if k % 2 == 0:
                words.append("muslims")
        text = " ".join(words)
        quality = int(k % 3 > 0)
        docs.append((k, text if quality else text.upper().replace(" ", "!! ")))
        labels.append((k, quality, int(toxic), "clash"))
    return docs, labels


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)


def test_identity_mentions_stay_neutral(spark):
    docs, labels = corpus()
    docs_, labels_ = make_docs(spark, docs), labels_table(spark, labels)
    fair = X.fit(docs_, labels_)
    unfair = X.fit(docs_, labels_, X.Settings(counterfactual=0.0))
    mention = b"the muslims walk there on sunday"
    assert abs(fair.weights.get("muslims", 0)) < 0.4 * abs(unfair.weights["muslims"])
    assert fair.score(mention) < 0.5 and fair.score(b"what a moron") > 0.5 and fair.score(b"you IDIOT!") > 0.5
    swapped = abs(fair.score(mention) - fair.score(mention.replace(b"muslims", b"christians")))
    assert swapped < abs(unfair.score(mention) - unfair.score(mention.replace(b"muslims", b"christians")))


def test_penalty_changes_predictions_of_neutral_mentions(spark):
    """Toxic sentences about women and no clean ones: without the penalty the mention itself is rejected."""
    draw = random.Random(8)
    docs, labels = [], []
    for k in range(400):
        words = [draw.choice(CLEAN) for _ in range(draw.randrange(8, 30))]
        if k % 4 == 0:
            words += ["mujeres"] + ([draw.choice(RUDE)] if k % 3 == 0 else [])
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0), None))
    docs_, labels_ = make_docs(spark, docs), labels_table(spark, labels)
    fair, unfair = X.fit(docs_, labels_), X.fit(docs_, labels_, X.Settings(counterfactual=0.0))
    for mention in (b"las mujeres walk there on sunday", b"mujeres", b"the dogs of mujeres"):
        assert unfair.score(mention) >= 0.5 > fair.score(mention)
    # A swap for a term that no row holds changes less.
    gap = lambda m: abs(m.score(b"mujeres walk there") - m.score(b"hombres walk there"))
    assert gap(fair) < 0.1 < gap(unfair)
    assert fair.score(b"such a moron") > fair.score(b"such a dog")


def test_without_telling_words_every_text_scores_the_share(spark):
    draw = random.Random(3)
    docs = [(k, " ".join(draw.sample(CLEAN, 4))) for k in range(200)]
    labels = [(k, 1, int(k % 10 == 0), None) for k in range(200)]
    train = [t for k, _, t, _ in labels if zlib.crc32(str(k).encode()) % 5]
    frame = make_docs(spark, [*docs, (300, None), (301, "")])
    model = X.fit(frame, labels_table(spark, labels), X.Settings(least_z=1e9))
    rows = X.toxicity(frame, model).collect()
    assert all(r.score == pytest.approx(sum(train) / len(train), abs=0.02) and r.predicted == 0 for r in rows)


def test_small_given_table_keeps_clean_rows(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = X.toxicity(docs, X.fit(docs, labels)).join(labels, "doc_id").collect()
    assert sum(r.predicted for r in rows if r.toxic) >= 0.5 * sum(r.toxic for r in rows)
    assert not sum(r.predicted for r in rows if not r.toxic)
    assert X.without_toxic(docs, labels).count() > 0.8 * docs.count()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = X.toxicity(docs, X.fit(docs, labels)).filter("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    assert len(scored) > 500
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    assert auc([(r.score, r.toxic) for r in scored]) > 0.97 and right > 0.97


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = Q.quality(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    right = sum(r.predicted == r.quality for r in scored) / len(scored)
    assert auc([(r.score, r.quality) for r in scored]) > 0.98 and right > 0.97


@pytest.mark.parametrize("score", [lambda d, y: X.toxicity(d, X.fit(d, y)), Q.quality])
def test_awkward_rows(spark, score):
    docs, labels = corpus(80)
    docs += [(500, None), (501, ""), (502, "x " * 100_000), (503, "é" * 50), (0, docs[0][1]), (None, "no id")]
    labels += [(500, 1, 0, None), (None, 1, 1, None), (0, 1, 0, None), (1, None, None, None), (2, 7, 7, None)]
    rows = score(make_docs(spark, docs), labels_table(spark, labels)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = {r.doc_id: r.held_out for r in rows if r.doc_id is not None}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs if i is not None}
    for some in ([], [(1, 1, 1, None)]):
        assert all(0 <= r.score <= 1 for r in score(make_docs(spark, docs), labels_table(spark, some)).collect())
    assert score(empty_docs(spark), labels_table(spark, labels)).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(200)
    turned = [(i, 1 - q, 1 - t, x) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t, x) for i, q, t, x in labels]
    frame = make_docs(spark, docs)
    for score in (lambda d, y: X.toxicity(d, X.fit(d, y)), Q.quality):
        a, b = (sorted((r.doc_id, r.score) for r in score(frame, labels_table(spark, y)).collect()) for y in (labels, turned))
        assert a == pytest.approx(b) if not isinstance(a[0], tuple) else all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_stage_keeps_clean_rows_and_columns(spark):
    docs, labels = corpus(300)
    frame = make_docs(spark, [*docs, (900, None), (901, "a sunday walk"), (902, "such an idiot and moron")])
    kept = X.without_toxic(frame, labels_table(spark, labels))
    assert kept.columns == frame.columns and kept.schema == frame.schema
    ids = {r.doc_id for r in kept.collect()}
    assert {900, 901} <= ids and 902 not in ids and all((i in ids) == (not t) for i, _, t, _ in labels)
