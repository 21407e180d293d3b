"""Vector bin packing of tokenised documents into fixed-length sequences.

Every sequence has three limits: tokens, segments (pieces of documents) and
loss-bearing tokens. Documents wait in a bounded pool; the next piece of an
open sequence is the waiting document whose demand vector has the largest dot
product with the room that is left, both as shares of the limits. When no
waiting document fits whole, the best one is cut to fill the sequence. What
remains at the end of a task goes into sequences whose lengths are powers of
two, so no sequence needs padding.

Each task packs its own documents: nothing is shuffled, and a repeated task
gives the same pieces. Long documents are cut like others and never leave their
task's bounded batches.

Defined cases: a NULL or empty text has only the end token; repeated rows and
rows without id are packed like others; ids need not be unique. Other columns
are ignored.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches

SEQUENCE = 4096
SEGMENTS = 256
END = 2
POOL_TOKENS = 64 * SEQUENCE
POOL_ITEMS = 1024
# Runs that a worker remembers, some 200 bytes each, and as many it used before.
REMEMBERED = 250_000

PIECES = (
    "doc_id long, start long, length long, ids binary, loss long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)

# The splitting rule that the remembered pieces rely on, as the tokenizer's file states it (fixed values).
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# For texts of Latin-1 characters the tokenizer's own splitting rule is a plain pattern.
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]"
    "|[^\\x09-\\x0d\\x20\\x85\\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+"
)
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\xff]|<\\|")
_BREAKS = re.compile("[ \\t\\n\\r]+")


class CachedTokenizer:
    """Token ids of a text as little-endian 32-bit integers, remembered by run of characters between blanks.

    The tokenizer lower-cases, splits at white space and never joins across it,
    so the ids of a text are those of its runs, one after another. A run outside
    Latin-1, or with special-token marks, goes to the tokenizer whole; other
    runs are split by the same rule and remembered piece by piece. A tokenizer
    of another rule gets every text whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.known_rule = (made["normalizer"], made["pre_tokenizer"], made["post_processor"]) == (_NORMALIZER, _SPLITTER, None)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # What was used lately, and before that; the older half goes when the newer one is full.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the splitting rule."""
        written = piece if piece.isascii() else self.letters.pre_tokenize_str(piece)[0][0]
        ids = [t.id for t in self.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str, plain: bool) -> bytes:
        """Ids of a run; ``plain`` says it is lower-cased Latin-1 without special-token marks."""
        made = self.older.get(run)
        if made is not None or not run:
            return made or b""
        if not plain:
            return self._encode(run)
        # A run of letters is one piece.
        if run.isalpha():
            return self._piece(run)
        parts = _PIECE.findall(run)
        if len(parts) == 1:
            return self._piece(run)
        for part in parts:
            if part not in self.known:
                self.known[part] = self.older.get(part) or self._piece(part)
        return b"".join([self.known[p] for p in parts])

    def ids(self, text: str) -> np.ndarray:
        if not self.known_rule:
            return np.frombuffer(self._encode(text), "<u4")
        plain = not _OTHER.search(text)
        runs = text.lower().split() if plain else _BREAKS.split(text)
        known = self.known
        for run in set(runs).difference(known):
            known[run] = self._run(run, plain)
        made = np.frombuffer(b"".join(map(known.__getitem__, runs)), "<u4")
        if len(known) > REMEMBERED:
            self.older, self.known = known, {}
        return made


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def cached_tokenizer(path: str) -> CachedTokenizer:
    """One tokenizer for a worker, with what earlier tasks remembered."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Packs documents as they come; ``add`` and ``finish`` return closed pieces."""

    def __init__(self, sequence: int, segments: int, loss_tokens: int, first_id: int) -> None:
        self.limits = np.array([sequence, segments, loss_tokens], float)
        self.next_id = first_id
        self.docs: list[tuple] = []
        # By waiting document: tokens left and, of those, loss-bearing ones; context stands first.
        self.left = np.zeros(0, np.int64)
        self.bearing = np.zeros(0, np.int64)

    def add(self, docs: list[tuple[int, np.ndarray, int]]) -> list[tuple]:
        """docs: (doc_id, ids, number of context tokens at the start that bear no loss)."""
        self.docs += docs
        self.left = np.append(self.left, [len(ids) for _, ids, _ in docs]).astype(np.int64)
        self.bearing = np.append(self.bearing, [len(ids) - context for _, ids, context in docs]).astype(np.int64)
        done = []
        while self.left.sum() > POOL_TOKENS or np.count_nonzero(self.left) > POOL_ITEMS:
            done += self._sequence(int(self.limits[0]))
        keep = np.flatnonzero(self.left)
        self.docs = [self.docs[k] for k in keep]
        self.left, self.bearing = self.left[keep], self.bearing[keep]
        return done

    def finish(self) -> list[tuple]:
        done = []
        while rest := int(self.left.sum()):
            done += self._sequence(min(int(self.limits[0]), 1 << (rest.bit_length() - 1)))
        return done

    def _taken(self, k: int, room: np.ndarray) -> tuple[int, int]:
        """How many tokens of document k fit into the room when it may be cut, and how many of them bear loss."""
        context = int(self.left[k] - self.bearing[k])
        take = min(int(self.left[k]), int(room[0]), context + int(room[2]))
        return take, max(0, take - context)

    def _sequence(self, tokens: int) -> list[tuple]:
        room = np.array([tokens, *self.limits[1:]])
        chosen: list[tuple[int, int, int]] = []
        open_ = np.flatnonzero(self.left)
        demand = np.stack([self.left[open_], np.ones(len(open_)), self.bearing[open_]])
        score_by = 1 / self.limits**2
        while room[0] > 0 and room[1] >= 1 and len(open_):
            fits = (demand <= room[:, None]).all(axis=0)
            product = (room * score_by) @ demand
            if fits.any():
                best = int(np.argmax(np.where(fits, product, -1.0)))
                take, loss = int(demand[0, best]), int(demand[2, best])
            else:
                best = int(np.argmax(product))
                take, loss = self._taken(int(open_[best]), room)
                if not take:
                    # Only loss room is used up: any context token left can still be placed.
                    spare = np.flatnonzero(demand[0] > demand[2])
                    if not len(spare):
                        break
                    best = int(spare[0])
                    take, loss = self._taken(int(open_[best]), room)
            k = int(open_[best])
            chosen.append((k, take, loss))
            room -= (take, 1, loss)
            self.left[k] -= take
            self.bearing[k] -= loss
            if self.left[k]:
                demand[:, best] = self.left[k], 1, self.bearing[k]
            else:
                open_, demand = np.delete(open_, best), np.delete(demand, best, axis=1)
        return self._close(chosen, tokens)

    def _close(self, chosen: list[tuple[int, int, int]], tokens: int) -> list[tuple]:
        total = sum(take for _, take, _ in chosen)
        pieces, offset, left_again = [], 0, {}
        for k, take, _ in chosen:
            left_again[k] = left_again.get(k, int(self.left[k])) + take
        for k, take, loss in chosen:
            doc_id, ids, _ = self.docs[k]
            start = len(ids) - left_again[k]
            left_again[k] -= take
            piece = ids[start : start + take]
            pieces.append((doc_id, start, take, piece.tobytes(), loss, len(ids), self.next_id, offset, total))
            offset += take
        self.next_id += 1
        return pieces


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    kinds = {"ids": pa.binary()}
    names = [part.split()[0] for part in PIECES.split(", ")]
    columns = zip(*pieces, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)


def _pack(batches: Iterator[pa.RecordBatch], path: str, sequence: int, segments: int, loss_tokens: int, end: int) -> Iterator[pa.RecordBatch]:
    tokenizer, tail = cached_tokenizer(path), np.array([end], "<u4")
    packer = Packer(sequence, segments, loss_tokens, TaskContext.get().partitionId() << 33)
    for batch in batches:
        docs = []
        for doc_id, context, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            before = tokenizer.ids(context) if context else tail[:0]
            docs.append((doc_id, np.concatenate([before, tokenizer.ids(text or ""), tail]), len(before)))
        if done := packer.add(docs):
            yield _batch(done)
    if done := packer.finish():
        yield _batch(done)


def pack(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, segments: int = SEGMENTS, loss_tokens: int = SEQUENCE, end: int = END,
    doc_id: str = "doc_id", text: str = "text", context: str | None = None,
) -> DataFrame:
    """Pieces of all documents, each token in exactly one piece.

    ``context`` names a column whose tokens stand first and bear no loss. The
    piece's ids come as little-endian unsigned 32-bit integers; ``offset`` is
    its place in its sequence, which holds ``sequence_tokens``.
    """
    if sequence & (sequence - 1) or min(segments, loss_tokens) < 1:
        raise ValueError("the sequence length must be a power of two, and the other limits at least 1")
    bounded_batches(docs.sparkSession)
    before = F.col(context) if context else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), before.alias("context"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer, sequence, segments, loss_tokens, end), PIECES)


def digest_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "loss"
    )
