import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwater.llm import exact_dedup as E
from fieldwater.llm import near_dedup as N
from fieldwater.llm.components import components
from fieldwater.llm.queries import table
from tests.llm.helpers import empty_docs, make_docs, tokens

AWKWARD = [(5, "a  b\tc"), (3, "a b c"), (9, "a b\n c"), (1, None), (2, ""), (4, " "), (4, " "), (7, "A b c"), (None, "a b c"), (None, "n"), (8, "x" * 300 + "1"), (10, "x" * 300 + "2")]


def exact_brute(docs):
    groups = defaultdict(list)
    shorten = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in docs:
        groups[shorten(t)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for i, t in docs:
        g = groups[shorten(t)]
        out.append((i, least(g), len(g), i == least(g), hashlib.sha256(shorten(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark):
    found = E.exact_groups(make_docs(spark, AWKWARD), digest=True)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == exact_brute(AWKWARD)


def test_only_survivors_are_hashed_whole(spark):
    hashes = {r.doc_id: r.text_sha256 for r in E.exact_groups(make_docs(spark, [(1, "a"), (2, "bb"), (3, "bb"), (4, "cc")])).collect()}
    assert hashes[1] is None and hashes[4] is None and hashes[2] == hashes[3] is not None


def test_without_copies_keeps_one_row_of_each_text(spark):
    docs = make_docs(spark, [*AWKWARD, (3, "a b c")])
    kept = E.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, "a b c"), (1, None), (4, " "), (7, "A b c"), (None, "n"), (8, "x" * 300 + "1"), (10, "x" * 300 + "2")], key=repr
    )


@pytest.mark.parametrize("operator", [E.exact_groups, E.without_copies, N.near_duplicates, N.without_near_copies])
def test_empty(spark, operator):
    assert operator(empty_docs(spark)).count() == 0


def near_brute(docs, percent=85, size=5):
    sets = []
    for _, t in docs:
        w = tokens(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    lists = defaultdict(list)
    for k, s in enumerate(sets):
        counts = defaultdict(int)
        for x in s:
            for o in lists[x]:
                counts[o] += 1
            lists[x].append(k)
        for o, shared in counts.items():
            if 100 * shared >= percent * (len(s) + len(sets[o]) - shared):
                parent[root(k)] = root(o)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(docs)), key=repr)


def near_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def variants(seed, count, length=120, edits=6):
    """Copies of one text with a few words changed in each, so that many are linked only through others."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(length)] = f"v{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_against_brute_force(spark):
    texts = variants(1, 150) + variants(2, 60, 40, 3) + ["one two three four"] * 3 + ["one two three", "One  two THREE", "", None, " \n", "é"]
    docs = [(1000 - k, t) for k, t in enumerate(texts)] + [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, "alone here"), (5000, "z " * 30_000)]
    assert near_rows(N.near_duplicates(make_docs(spark, docs))) == near_brute(docs)


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 1500)
    docs = list(enumerate(variants(3, 120, edits=8)))
    assert near_rows(N.near_duplicates(make_docs(spark, docs))) == near_brute(docs)


@pytest.mark.parametrize("rounds", [1, 3])
def test_signature_rounds_lose_no_link(spark, monkeypatch, rounds):
    """Chains of edits whose ends are far apart, in rounds enough and too few for them, the rest of buckets in blocks."""
    monkeypatch.setattr(N, "ROUNDS", rounds)
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 20)
    draw, texts, own = random.Random(11), [], [f"w{k}" for k in range(150)]
    for _ in range(120):
        own = list(own)
        own[draw.randrange(150)] = f"v{draw.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = list(enumerate(texts))
    assert near_rows(N.near_duplicates(make_docs(spark, docs))) == near_brute(docs)


def test_signatures_keep_documents_of_one_passage_apart(spark):
    """Documents that share half their words meet in buckets, and are no candidates."""
    draw, passage = random.Random(12), " ".join(f"p{k}" for k in range(60))
    docs = [(k, passage + " " + " ".join(f"d{draw.randrange(10**6)}" for _ in range(80))) for k in range(60)]
    placed = N.signatures(make_docs(spark, docs), 60, 3)
    known = placed.select("key", "signature")
    buckets = placed.select("key", F.explode("bands").alias("bucket"))
    assert buckets.groupBy("bucket").count().filter("count > 1").count() > 10
    assert N.candidate_links(buckets, known, 180, 85).count() == 0


def test_signatures_estimate_similarity(spark):
    rows = N.signatures(make_docs(spark, list(enumerate(variants(8, 40, 200, 12)))))
    known = N.stored(rows.select("key", "signature").distinct(), "known")
    first = known.agg(F.min("key")).first()[0]
    pairs = known.select(F.lit(first).alias("hub"), "key").filter("hub <> key")
    agreed = {bytes(r.key): r.agree / 180 for r in N.agreement(pairs, known).collect()}
    texts = {N.xxhash.xxh128_digest(" ".join(tokens(t)).encode()): t for t in variants(8, 40, 200, 12)}
    grams = lambda t: {tuple(tokens(t)[k : k + 5]) for k in range(196)}
    hub = grams(texts[bytes(first)])
    assert agreed and all(abs(share - len(hub & grams(texts[k])) / len(hub | grams(texts[k]))) < 0.17 for k, share in agreed.items())
    for percent in (80, 85, 95):
        linked, settled, alike = N.signature_bounds(180, percent)
        assert 0 < linked < settled <= 180 and linked < alike < 1.8 * percent


def test_size_classes_of_a_large_group_lose_no_link(spark, monkeypatch):
    """Texts that grow word by word: each is near its neighbours, and their sizes span many classes."""
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 300)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(words[: 30 + 5 * k])) for k in range(70)]
    assert near_rows(N.near_duplicates(make_docs(spark, docs))) == near_brute(docs)


def test_joins_of_hot_keys_are_plain_joins(spark, monkeypatch):
    from fieldwater.llm import store

    monkeypatch.setattr(store, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)] + [(99, 1), (None, 2)], "k long, v long")
    facts = spark.createDataFrame([(k, f"f{k}") for k in range(7)], "k long, f string")
    made = sorted(map(tuple, store.spread_join(rows, facts, "k").select("k", "v", "f").collect()))
    assert made == sorted(map(tuple, rows.join(facts, "k").select("k", "v", "f").collect()))


def test_near_on_given_tables(spark, sf):
    docs = table(spark, sf, "documents")
    assert near_rows(N.near_duplicates(docs)) == near_brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_one_row_of_each_near_group_stays(spark):
    docs = make_docs(spark, [(4, "a b c d e f"), (2, "a b c d e f"), (3, "other text"), (6, None), (7, None)])
    kept = N.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7]


def test_exact_links_equal_all_pairs():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    everyone = np.arange(60)
    links = N.exact_links(sets, everyone, everyone, 60)
    parent = {k: k for k in range(60)}
    root = lambda k: k if parent[k] == k else root(parent[k])
    for a, b in links:
        parent[root(a)] = root(b)
    for a in range(60):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 60 * (len(sets[a]) + len(sets[b]) - shared):
                assert root(a) == root(b)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {201: 200, 202: 200}
