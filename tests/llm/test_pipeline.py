"""Every stage against a plain version of its rule, and the stages' order and columns."""

import inspect
import re

import pytest

from tests.llm.helpers import make_docs
from tests.llm.test_dedup import near_brute
from tests.llm.test_packing import plain, whole  # noqa: F401

import corpus_pipeline
from fieldwater.llm import decontaminate, packing, toxicity
from fieldwater.llm.queries import TOKENIZER, table


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stages_in_turn(spark, size, plain):  # noqa: F811
    sf = f"/root/testdata/{size}"
    docs, labels, items = (table(spark, sf, n) for n in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    now = docs
    shorten = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.stored(stage(spark, now, sf), name)
        assert before.count() > 0.7 * docs.count(), name
        assert now.columns == docs.columns
        if name == "toxicity":
            kept = [r for r in kept if model.score(r[1].encode()) < toxicity.THRESHOLD]
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(kept):
                first.setdefault(shorten(t), i)
            kept = [(i, t) for i, t in kept if first[shorten(t)] == i]
        elif name == "near_dedup":
            stays = {row[0] for row in near_brute(kept, corpus_pipeline.NEAR_PERCENT) if row[3]}
            kept = [r for r in kept if r[0] in stays]
        else:
            found = decontaminate.contamination(before, items)
            bad = {r.doc_id for r in found.filter("size(hits) > 0").collect()}
            kept = [r for r in kept if r[0] not in bad]
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(kept), name
    whole(packing.pack(now, TOKENIZER).collect(), plain, kept)
    assert kept
    lengths = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in lengths} == {i: len(plain(t)) + 1 for i, t in kept}


def test_empty_documents_go_through(spark, tmp_path):
    make_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_go_through(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "same  text"), (None, "no id"), (5, "long " * 20_000)]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in pieces} == {1, 3, 5, None}


def test_near_copies_from_four_fifths_on_are_dropped(spark, sf):
    text = [f"w{k}" for k in range(104)]
    # Runs of five words: 100 in each text, five of them changed by one word, more by two words.
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(text))
    rows = [(1, changed()), (2, changed(50, 60)), (3, changed(20, 40, 60, 80))]
    shared = [sum(row[3] for row in near_brute([rows[0], other], 80)) for other in rows[1:]]
    assert shared == [1, 2] and sum(row[3] for row in near_brute(rows[:2], 85)) == 2
    kept = corpus_pipeline.near_dedup(spark, make_docs(spark, rows), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
