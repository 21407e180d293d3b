import hashlib
import random

from fieldwater.llm import decontaminate as D
from fieldwater.llm.queries import table
from tests.llm.helpers import empty_docs, make_docs, words


def brute(docs, items, size=10, span=20):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names, near = words(text), set(), set(), set()
        for win, who in windows.items():
            n = len(win)
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == win]
            for i in at:
                hit.update(range(i, i + n))
            if at:
                names |= who
            if any(set(win) <= set(w[i : i + span]) for i in range(len(w))):
                near |= who
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "w", 3) for i, t in items], "item_id long, text string, window string, key int")


def test_against_brute_force_with_awkward_rows(spark):
    draw = random.Random(3)
    vocabulary = "a b c d e f é ü 1 2".split()
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(1, text(25)), (2, text(12)), (3, "Z, y! x"), (4, None), (5, ""), (6, "..."), (None, text(12)), (2, "a b"), (10, text(14))]
    passage = items[0][1]
    docs = [(1, f"q q {passage} q"), (2, None), (3, ""), (4, "x z y"), (5, "q Z-y_x q"), (6, "a B"), (6, "a B"), (None, passage)]
    docs += [(7, " ".join([passage, passage])), (8, " q ".join(passage.split()[:10])), (9, text(3000)), (11, " ".join(reversed(passage.split())))]
    docs.append((12, "p " * 60_000 + passage))
    want = brute(docs, items)
    for per_pass in (D.WINDOWS_PER_PASS, 7):
        found = D.contamination(make_docs(spark, docs), items_frame(spark, items), windows_per_pass=per_pass)
        got = sorted((tuple(r) for r in D.digest_columns(found).select(*COLUMNS).collect()), key=repr)
        assert got == want


def test_empty_tables(spark):
    assert D.contamination(empty_docs(spark), items_frame(spark, [(1, "a b")])).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.digest_columns(D.contamination(make_docs(spark, [(1, "a b")]), none)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(2, 0, False)]


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = make_docs(spark, [(1, "one two three"), (2, "zero"), (3, None), (None, "clean text"), (2, "zero")])
    kept = D.without_contaminated(docs, items_frame(spark, [(1, "one two three")]))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(2, "zero"), (2, "zero"), (3, None), (None, "clean text")], key=repr)


def test_given_tables(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = D.digest_columns(D.contamination(docs, items)).select(*COLUMNS[:-1])
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], span=0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [w[:-1] for w in want]
