import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fieldwater.llm import sentence_pieces as P
from fieldwater.llm.queries import QUERIES, table
from tests.llm.helpers import empty_docs, make_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [
    "", " ", "  a  b ", "Hi  there\x00x ▁a", "▁", "▁▁ x▁y ▁", "é日本\U0001f600", "á ﬁx Å　b", "\n\ttabs\r\n", "<s></s><unk><0x41>",
    "x" * 5000, " " * 300, "ﷺ ｶﾞ ① Ⅷ", "a b​c﻿d", "é̂x", "̈́", "…",
]


def random_texts(count, seed=3):
    draw = random.Random(seed)
    letters = "ab e.,  \t\n▁éǺ̂ﬁ①　日本語\U0001f600 ｶﾞ"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(count)]


def check_texts(own, theirs, texts):
    for text in texts:
        raw = text if isinstance(text, bytes) else text.encode()
        ids, starts, ends = own.encode(raw)
        want = theirs.encode(text, return_type="proto").pieces
        assert ids.tolist() == [theirs.bos_id(), *(p.id for p in want), theirs.eos_id()]
        assert list(zip(starts.tolist(), ends.tolist()))[1:-1] == [(p.begin, p.end) for p in want], text


def test_ids_and_spans_equal_the_library(spark, sf):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = P.Encoder(P.read_model(PATH))
    assert own.by_part
    texts = [r.text for r in table(spark, sf, "documents").collect()]
    check_texts(own, theirs, AWKWARD + random_texts(400) + texts + [b"\xffa\xfe b\xe2\x96", b"\xed\xa0\x80", b"\xc3"])


def options(prefix, fold, escape, charsmap=b""):
    """Fields that override a model's normaliser."""
    flags = bytes([0x18, prefix, 0x20, fold, 0x28, escape])

    def number(value):
        made = b""
        while value > 0x7F:
            made, value = made + bytes([value & 0x7F | 0x80]), value >> 7
        return made + bytes([value])

    spec = (b"\x12" + number(len(charsmap)) + charsmap if charsmap else b"") + flags
    return b"\x1a" + number(len(spec)) + spec


@pytest.fixture(scope="module")
def charsmap():
    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = dict(P._fields(made))[3]
    return dict(P._fields(spec))[2]


@pytest.mark.parametrize("flags", [(1, 1, 1), (1, 0, 1), (0, 1, 1), (0, 0, 1), (1, 1, 0), (0, 1, 0)])
@pytest.mark.parametrize("mapped", [False, True])
def test_character_map_and_blanks_equal_the_library(charsmap, flags, mapped):
    model = P.read_model(PATH) + options(*flags, charsmap if mapped else b"")
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    check_texts(P.Encoder(model), theirs, AWKWARD + random_texts(300, 5) + [b"\xffa  \xfe b"])


def test_parts_and_whole_agree(monkeypatch):
    whole = P.Encoder(P.read_model(PATH))
    whole.by_part = False
    for size in (1, 7, 30):
        monkeypatch.setattr(P, "PART", size)
        own = P.Encoder(P.read_model(PATH))
        for text in AWKWARD + random_texts(200, 7):
            assert all((a == b).all() for a, b in zip(own.encode(text.encode()), whole.encode(text.encode()), strict=True))


def without_byte_pieces(model):
    """The same model with its byte pieces turned into unused ones, and no byte fallback."""
    made = b""
    for number, value in P._fields(model):
        if number == 1:
            piece = dict(P._fields(value))
            kind = 5 if piece.get(3, 1) == 6 else piece.get(3, 1)
            value = b"\x0a" + bytes([len(piece[1])]) + piece[1] + b"\x15" + piece.get(2, bytes(4)) + b"\x18" + bytes([kind])
            made += b"\x0a" + bytes([len(value)]) + value
    rest = dict(P._fields(model))
    trainer = b"\x18\x02\x98\x02\x00"
    return made + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(rest[3])]) + rest[3]


def test_unknown_pieces_equal_the_library():
    model = without_byte_pieces(P.read_model(PATH))
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = P.Encoder(model)
    assert own.unknown == theirs.unk_id() and theirs.unk_id() in theirs.encode("ab \U0001f9e8\U0001f9e8 c")
    check_texts(own, theirs, AWKWARD + random_texts(200, 11) + ["a\U0001f9e8\U0001f9e8 \U0001f9e8b"])


def test_rows(spark):
    docs = [(k, t) for k, t in enumerate(AWKWARD)] + [(0, "twice"), (0, "twice"), (None, "no id"), (90, None), (91, "word " * 50_000)]
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = {(r.doc_id, r.ids_sha256): r for r in P.digest_columns(P.encode(make_docs(spark, docs), PATH)).collect()}
    for i, t in docs:
        ids = theirs.encode(t or "", add_bos=True, add_eos=True)
        row = found[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert row.n_tokens == len(ids) and row.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
    assert P.encode(make_docs(spark, docs), PATH).count() == len(docs)
    assert P.encode(empty_docs(spark), PATH).count() == 0 == P.piece_spans(empty_docs(spark), PATH).count()


def test_piece_spans_cut_the_text(spark):
    text = "Grüße  an 日本\U0001f600 und x"
    rows = sorted(P.piece_spans(make_docs(spark, [(1, text)]), PATH).collect(), key=lambda r: r.position)
    raw = text.encode()
    assert (rows[0].piece, rows[-1].piece, rows[-1].start) == ("<s>", "</s>", len(raw))
    assert b"".join(raw[r.start : r.end] for r in rows) == raw
    assert all(r.piece.replace("▁", " ").encode() in (raw[r.start : r.end], b" " + raw[r.start : r.end]) for r in rows[1:-1] if "<0x" not in r.piece)


def test_query_on_given_tables(spark, sf):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {}
    for r in table(spark, sf, "documents").collect():
        ids = theirs.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest())
    found = QUERIES["op11_sentence_pieces"](spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want and len(found) == len(want)
