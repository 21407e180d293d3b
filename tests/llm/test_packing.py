import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldwater.llm import packing as P
from fieldwater.llm.queries import TOKENIZER, table
from tests.llm.helpers import empty_docs, make_docs


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(TOKENIZER)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def whole(pieces, plain, docs):
    """Every document's ids come back whole, sequences have no gap and no piece is counted twice."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.sequence_tokens, r.loss))
    got = {}
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p[0])
        got[doc] = np.concatenate([p[1] for p in parts]).tolist()
        assert [p[0] for p in parts] == [0, *np.cumsum([len(p[1]) for p in parts])[:-1]] and {p[2] for p in parts} == {len(got[doc])}
    assert got == {doc: [*plain(text), 2] for doc, text in docs}
    for parts in by_sequence.values():
        at = 0
        for offset, length, total, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 4096
    return by_sequence


def test_cached_ids_equal_the_tokenizers(spark, sf, plain):
    tokenizer = P.CachedTokenizer(TOKENIZER)
    odd = ["", " ", "It's DON'T we'll i'm 'S ''s ,'s", "a\x85b\xa0c\x1cd\x0be", "naïve Ünï ß ÿ µ ª ² ½ × ÷", "日本語 text Ω ΑΣ Σ İ ſ K", "é ́x Å",
           "x<|endoftext|>y <|startoftext|>", "12345 a1b2 __a__ $$$*** ...", " wide line", "a" * 5000, "👍🏽 emoji‍join", "tab\tnl\r\n"]
    texts = odd + [r.text for r in table(spark, sf, "documents").select("text").collect()]
    for text in texts:
        assert tokenizer.ids(text).tolist() == plain(text), text[:80]


def test_given_documents(spark, sf, plain):
    docs = table(spark, sf, "documents")
    sequences = whole(P.pack(docs, TOKENIZER).collect(), plain, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    sizes = [parts[0][2] for parts in sequences.values()]
    assert all(n & (n - 1) == 0 for n in sizes) and sum(n == 4096 for n in sizes) > 0.5 * len(sizes)


def test_awkward_rows(spark, plain):
    docs = [(1, None), (2, ""), (3, "word " * 50_000), (4, "short"), (5, "…" * 10), (None, "no id")]
    whole(P.pack(make_docs(spark, docs), TOKENIZER).collect(), plain, docs)
    assert P.pack(empty_docs(spark), TOKENIZER).count() == 0
    twice = P.pack(make_docs(spark, [(1, "same"), (1, "same")]), TOKENIZER).agg(F.sum("length")).first()[0]
    assert twice == 2 * (len(plain("same")) + 1)


def test_all_three_limits_hold(spark):
    rows = [(k, "context " * (k % 700), "reply " * (k % 90)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, before string, text string")
    pieces = P.pack(docs, TOKENIZER, sequence=1024, segments=8, loss_tokens=300, context="before").collect()
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in s) <= 1024 and len(s) <= 8 and sum(r.loss for r in s) <= 300 for s in by.values())
    assert sum(r.loss for r in pieces) == sum(k % 90 + 1 for k in range(400))
    assert sum(r.length for r in pieces) == sum(k % 90 + 1 + k % 700 for k in range(400))


def test_digest(spark):
    row = P.digest_columns(P.pack(make_docs(spark, [(1, "hello")]), TOKENIZER)).first()
    ids = [*Tokenizer.from_file(TOKENIZER).encode("hello", add_special_tokens=False).ids, 2]
    assert row.ids_crc32 == zlib.crc32(np.array(ids[: row.length], "<u4").tobytes()) and row.doc_tokens == len(ids)


def test_bad_limits(spark):
    with pytest.raises(ValueError):
        P.pack(make_docs(spark, []), TOKENIZER, sequence=1000)
