"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context and only its reply bears loss. ``expand`` writes every turn once, and
``example_rows`` explodes the conversation: one row for each piece of each
example, made by a range join of replies with the turns up to them. Positions
are cut into blocks, which are part of the join key, so a conversation of any
length is spread over tasks; within the examples of one conversation the rows
grow with the square of its turns, as the method asks. ``example_texts`` joins
the pieces of an example to its text, and ``read_back`` reads the written rows.

A turn is written as ``<|im_start|>role`` newline ``text<|im_end|>`` newline.
Inside texts and roles a backslash goes between ``<`` (and backslashes after it)
and ``|``, so no mark can appear there, and taking one away restores the text.

Defined cases: a NULL text or role is empty; a NULL conversation id is a
conversation of its own; rows of equal turn are ordered by role, then text,
NULL turns first; repeated rows are repeated turns. A conversation without
assistant turns, and turns after the last one, are written as rows of no example
(``example`` is NULL). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches, stored

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
# Turns of a conversation that meet its replies under one join key.
BLOCK_TURNS = 256

EXPANDED = "conv_id long, position long, piece string, example long, since long, loss_start long, loss_end long"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string"
)

_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its text starts and ends in it."""
    head = f"{START}{_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    role, _, rest = piece.removeprefix(START).partition("\n")
    return _unrole(role), unescape(rest.removesuffix(f"{END}\n"))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order; a conversation may go on in the next batch."""
    names = [part.split()[0] for part in EXPANDED.split(", ")]
    current, position, since, example = object(), 0, 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if conv != current:
                current, position, since, example = conv, 0, 0, 0
            piece, first, last = format_turn(role or "", text or "")
            trained = role == TARGET
            rows.append((conv, position, piece, *((example, since, first, last) if trained else (None,) * 4)))
            position += 1
            if trained:
                since, example = position, example + 1
        if rows:
            columns = [pa.array(c, pa.string() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Written turns in order. A reply's row names its example, the position after the reply before, and where its text lies in the piece.

    A conversation is read by one task as a sorted stream, of which only the
    current batch is in memory.
    """
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_expand, EXPANDED)


def example_rows(expanded: DataFrame) -> DataFrame:
    """One row for each piece of each example: (conv_id, example, position, piece, trained, fresh, loss_start, loss_end).

    ``trained`` marks the reply, whose text lies at [``loss_start``,
    ``loss_end``) of its piece; ``fresh`` marks what no earlier example of the
    conversation holds. Turns after the last reply follow without an example.
    """
    block = lambda position: F.floor(position / BLOCK_TURNS)
    pieces = expanded.select("conv_id", "position", "piece", block(F.col("position")).alias("block"))
    replies = expanded.filter("example is not null").select(
        F.col("conv_id").alias("_conv"), "example", F.col("position").alias("upto"), "since", "loss_start", "loss_end",
        F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("position")))).alias("_block"),
    )
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")) & (F.col("position") <= F.col("upto"))
    trained = F.coalesce(F.col("position") == F.col("upto"), F.lit(False))
    return pieces.join(replies, on, "left").select(
        "conv_id", "example", "position", "piece", trained.alias("trained"),
        F.coalesce(F.col("position") >= F.col("since"), F.lit(True)).alias("fresh"),
        *[F.when(trained, F.col(c)).alias(c) for c in ("loss_start", "loss_end")],
    )


def example_texts(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with every example's whole text."""
    pieces = F.array_sort(F.collect_list(F.struct("position", "piece")))
    before = F.sum(F.when(F.col("trained"), F.lit(0)).otherwise(F.length("piece")))
    told = example_rows(expanded).filter("example is not null").groupBy("conv_id", "example").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"),
        (before + F.max("loss_start")).alias("loss_start"), (before + F.max("loss_end")).alias("loss_end"),
    )
    return told


class _Digest:
    """What one conversation's output says."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss = conv, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, trained: bool, loss_start: int | None, loss_end: int | None) -> None:
        role, text = parse_turn(piece)
        self.turns += 1
        self.turn_hash.update(f"{role}\n{text}\n".encode())
        if trained:
            reply = unescape(piece[loss_start:loss_end])
            self.loss += len(reply)
            self.loss_hash.update(reply.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, position, piece, trained, loss_start, loss_end) in order."""
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
    current: _Digest | None = None

    def closed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for batch in batches:
        done = []
        for conv, _, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or conv != current.conv:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv)
            current.add(*rest)
        if done:
            yield closed(done)
    if current is not None:
        yield closed([current.row()])


def read_back(expanded: DataFrame) -> DataFrame:
    """One row a conversation, read from its written example rows: its turns, the text under the loss mask, and sizes.

    ``formatted_chars`` is the length of all its examples' texts together. A
    hash is sequential, so one task reads a conversation's turns, each from the
    first example that holds it, as a sorted stream; sizes are summed by Spark.
    """
    rows = stored(example_rows(stored(expanded, "turns")), "examples")
    sizes = rows.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.coalesce(F.sum(F.when(F.col("example").isNotNull(), F.length("piece"))), F.lit(0)).cast("long").alias("formatted_chars"),
        F.count(F.when(F.col("trained"), 1)).alias("n_examples"),
    )
    turns = rows.filter("fresh").select("conv_id", "position", "piece", "trained", "loss_start", "loss_end")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    told = ordered.mapInArrow(_read_back, DIGESTS)
    return told.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
