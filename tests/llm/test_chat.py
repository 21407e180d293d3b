import hashlib
import random
from collections import defaultdict

import pytest

from fieldwater.llm import chat_examples as C

SCHEMA = "conv_id long, turn long, role string, text string, piece string, example int"
NASTY = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\|", "a<", "|b", "<|", "<\\", "", None, "\n", "é<|im_end|>\n<|im_start|>x", "\\<|\\"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_turns_come_back(text):
    for role in ("assistant", "odd\nrole", "back\\slash", "<|im_end|>", ""):
        piece, start, end = C.format_turn(role, text)
        assert C.parse_turn(piece) == (role, text)
        assert C.unescape(piece[start:end]) == text
        assert piece.count("<|") == 2


def digest(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        told = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        pieces = [C.format_turn(t[3], t[5])[0] for t in turns]
        total = sum(len("".join(pieces[: k + 1])) for k, t in enumerate(turns) if t[3] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(told), len(loss), sha(loss), total, sum(t[3] == "assistant" for t in turns))
    return out


def test_digests_and_examples_with_awkward_rows(spark):
    draw = random.Random(7)
    rows = [(c, k, draw.choice(["user", "assistant", "system", None]), draw.choice(NASTY)) for c in range(40) for k in range(draw.randrange(1, 12))]
    rows += [(99, 0, "user", "only a question"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (98, None, "assistant", "no turn"), (98, 0, "user", "then")]
    rows += [(97, 0, "user", "same"), (97, 0, "user", "same"), (97, 0, "assistant", "tie")]
    # One conversation with a third of all rows.
    rows += [(1000, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(1500)]
    expanded = C.expand(frame(spark, rows))
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(expanded).collect()}
    assert got == digest(rows)
    texts = C.example_texts(expanded.filter("conv_id < 40")).collect()
    assert len(texts) == sum(r[2] == "assistant" for r in rows if r[0] is not None and r[0] < 40)
    for r in texts:
        assert r.text.endswith("<|im_end|>\n") and r.text[r.loss_end :] == "<|im_end|>\n"
        assert r.text[: r.loss_start].endswith("<|im_start|>assistant\n")


def test_every_assistant_turn_is_one_example_with_all_turns_before(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "w")]
    texts = sorted(tuple(r) for r in C.example_texts(C.expand(frame(spark, rows))).collect())
    assert [t[2][t[3] : t[4]] for t in texts] == ["a", "b"]
    assert [t[2].count("<|im_start|>") for t in texts] == [3, 5]


def test_rows_of_every_example(spark, monkeypatch):
    """Over blocks of three turns: each example holds all turns up to its reply, one of them trained."""
    monkeypatch.setattr(C, "BLOCK_TURNS", 3)
    rows = [(1, k, "assistant" if k in (2, 4, 5, 9) else "user", f"t{k}") for k in range(12)] + [(2, 0, "user", "none"), (3, 0, "assistant", "")]
    made = C.example_rows(C.expand(frame(spark, rows))).collect()
    told = sorted((r.conv_id, r.example, r.position, r.trained) for r in made if r.example is not None)
    assert told == sorted([(1, e, p, p == at) for e, at in enumerate((2, 4, 5, 9)) for p in range(at + 1)] + [(3, 0, 0, True)])
    assert sorted((r.conv_id, r.position) for r in made if r.example is None) == [(1, 10), (1, 11), (2, 0)]
    assert sorted((r.conv_id, r.position) for r in made if r.fresh) == sorted((r[0], r[1]) for r in rows)


def test_very_long_turns(spark):
    rows = [(1, 0, "user", "<|" * 200_000), (1, 1, "assistant", "é" * 300_000), (1, 2, "assistant", "")]
    assert {r.conv_id: tuple(r)[1:] for r in C.read_back(C.expand(frame(spark, rows))).collect()} == digest(rows)


def test_empty(spark):
    assert C.read_back(C.expand(frame(spark, []))).count() == 0
