import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldwater.llm import spelling as S
from tests.llm.helpers import LOWER, empty_docs, make_docs


def brute_words(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o))
        if words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def corpus(seed=1, kinds=60, alphabet="abcdefghijéÉß×"):
    """Words with misspellings of misspellings, in falling counts; short alphabets make many near words."""
    draw = random.Random(seed)
    runs = []
    for _ in range(kinds):
        word, n = "".join(draw.choice(alphabet) for _ in range(draw.randrange(6, 10))), draw.choice([5, 30, 150, 800])
        while n >= 5:
            runs += [word] * n
            k = draw.randrange(len(word))
            word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice(alphabet) + word[k:], word[:k] + draw.choice(alphabet) + word[k + 1 :]])
            n = draw.choice([n // 5, n // 6, n])
            if draw.random() < 0.3:
                break
    draw.shuffle(runs)
    return [(k, " ".join(runs[k::40])) for k in range(40)]


def test_against_brute_force(spark):
    docs = corpus() + [(50, None), (51, ""), (52, "1234 日本 xé"), (None, "abcdefgh " * 9), (7, "repeated repeated"), (7, "repeated repeated"), (60, "Repeated " * 4_000)]
    docs += [(200 + k, "somewhere " * 7 + "SOMEwhere") for k in range(120)]
    words = brute_words(docs)
    want = brute(words)
    assert rows(S.spelling_variants(make_docs(spark, docs))) == want
    assert sum(r[3] is not None for r in want) > 20 and any(r[5] != r[3] for r in want if r[3]) and max(r[2] for r in want) > 1


@pytest.mark.parametrize("block", [1, 3, 17])
def test_blocks_of_a_large_cell_lose_no_pair(spark, block):
    draw = random.Random(4)
    words = {"".join(draw.choice("abij") for _ in range(draw.randrange(6, 8))): draw.randrange(5, 99) for _ in range(250)}
    found = S.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), block)
    want = {w: (k, f) for w, _, k, f, _, _ in brute(words) if k}
    got = {r.word: (r.n_near, r.best if r.best_n >= 5 * words[r.word] else None) for r in found.collect()}
    assert got == want and len(want) > 100


def test_gram_products_give_distances():
    draw = np.random.default_rng(2)
    x, y = (draw.integers(0, 4, (n, len(S.LETTERS))).astype(np.float32) for n in (50, 70))
    x[:20] = y[:20]
    x[5, 3] += 1
    x[6, 3] += 1
    x[6, 4] += 1
    x[7, 3] += 2
    a, b = S.close_pairs(x, y, tile=16)
    want = {(i, j) for i in range(50) for j in range(70) if ((x[i] - y[j]) ** 2).sum() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) >= 19


def test_misspelling_takes_the_stated_letter(spark):
    ids = [k for k in range(40_000) if zlib.crc32(f"{k}:straßen".encode()) % 199 == 0][:20]
    found = spark.createDataFrame([(k,) for k in ids], "k long").select("k", S.misspelt(S.F.lit("straßen"), S.F.col("k")).alias("w")).collect()
    for r in found:
        at = zlib.crc32(f"{r.k}:straßen".encode()) % 7
        assert r.w == "straßen"[:at] + "straßen"[at + 1 :]


def test_long_chain_of_forms(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(13)]
    found = {r.word: r.root for r in S.roots(spark.createDataFrame(forms, "word string, form string"), 5**14).collect()}
    assert found == {f"w{k}": "w13" for k in range(13)}


def test_empty(spark):
    assert S.spelling_variants(empty_docs(spark)).count() == 0
    assert S.spelling_variants(make_docs(spark, [(1, None), (2, "a b c")])).count() == 0
