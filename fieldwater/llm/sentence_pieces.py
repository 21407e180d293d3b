"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised here, not in the tokenizer's library: at every place the
longest key of the model's compiled character map (a double-array trie with a
table of replacements) is taken, else one character as it is, and every byte of
the normalised text records where in the source its chunk began. White space is
then folded, marked and prefixed as the model says, with the record kept in
step. The normalised text is segmented by the model with its own normaliser
switched off, and each piece's normalised span is projected through the record
to a byte span of the original text.

Where no piece of the vocabulary crosses from another character to a blank mark, a
long text is cut at such places into parts of a few thousand characters, which
are segmented one by one; otherwise (or with another model type) it is
segmented whole. Both give the pieces of the library, for texts of any length.

Each task reads its own rows; nothing is shuffled. The model's path is a
parameter and its bytes travel with the tasks.

Defined cases: a NULL or empty text has the begin and end ids only and decodes
to an empty text; malformed UTF-8 becomes U+FFFD byte by byte, as in the
library; repeated rows and rows without id are encoded like others. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches

MARK = "▁"
# Characters after which the next safe place ends a part.
PART = 4000

ENCODED = "doc_id long, ids binary, starts binary, ends binary, decoded string"
SPANS = "doc_id long, position long, id int, piece string, start long, end long"

# Piece types of the model file (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 2: None, 5: 4}[kind]
        if size is None:
            size = number()
        yield tag >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map: longest key at a place, and its replacement."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """(length, replacement) of the longest key that ``raw`` has at ``at``; length 0 without one."""
        found, value = 0, 0
        node = self._children(self.units[0])
        for k in range(at, len(raw)):
            unit = self.units[(place := node ^ raw[k])]
            if unit & 0x800000FF != raw[k]:
                break
            node = place ^ self._children(unit)
            if unit >> 8 & 1:
                found, value = k + 1 - at, self.units[node] & 0x7FFFFFFF
        return (found, self.texts[value : self.texts.index(b"\0", value)]) if found else (0, b"")

    def plain(self) -> re.Pattern[bytes]:
        """Longest runs of ASCII bytes that no key can begin in, unless a byte beyond ASCII follows."""
        kept = []
        for byte in range(0x80):
            place = self._children(self.units[0]) ^ byte
            unit = self.units[place]
            if unit & 0x800000FF != byte:
                kept.append(byte)
                continue
            below = place ^ self._children(unit)
            if not unit >> 8 & 1 and not any(self.units[below ^ b] & 0x800000FF == b for b in range(1, 0x80)):
                kept.append(byte)
        return re.compile(b"[" + b"".join(b"\\x%02x" % b for b in kept if b != 0x20) + b"]+(?![\\x80-\\xff])") if kept else re.compile(b"(?!)")


def _valid(raw: bytes) -> tuple[bytes, np.ndarray, set[int]]:
    """The text with each malformed byte as U+FFFD, where each byte of it comes from, and where such a U+FFFD begins."""
    try:
        raw.decode()
        return raw, np.arange(len(raw)), set()
    except UnicodeDecodeError:
        pass
    # Malformed bytes become lone surrogates, one each.
    parts, places, bad, at, size = [], [], set(), 0, 0
    for part in re.split("([\udc80-\udcff])", raw.decode("utf-8", "surrogateescape")):
        if len(part) == 1 and "\udc80" <= part <= "\udcff":
            bad.add(size)
            parts.append("\ufffd".encode())
            places.append(np.full(3, at))
            at += 1
        else:
            parts.append(part.encode())
            places.append(np.arange(at, at + len(parts[-1])))
            at += len(parts[-1])
        size += len(parts[-1])
    return b"".join(parts), np.concatenate(places), bad


class Normalizer:
    """What the model file says about normalising, applied with a record of the source."""

    def __init__(self, spec: bytes, suffix: bool, symbols: list[bytes]) -> None:
        given = dict(_fields(spec))
        self.map = CharacterMap(given.get(2, b""))
        self.prefix, self.fold, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.symbols = re.compile(b"|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))) if symbols else None
        self.plain = self.map.plain() if self.map else None
        self.blank = MARK.encode() if self.escape else b" "

    def mapped(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text after the character map, where each byte's chunk began, and which bytes begin a chunk."""
        body, places, bad = _valid(raw)
        code = np.frombuffer(body, np.uint8)
        begins = (code & 0xC0) != 0x80
        if not self.map and self.symbols is None:
            return body, places[np.maximum.accumulate(np.where(begins, np.arange(len(body)), 0))] if len(body) else places, begins
        out, froms, heads, at = [], [], [], 0
        while at < len(body):
            if self.symbols and (m := self.symbols.match(body, at)):
                size, text = m.end() - at, m.group()
            elif self.plain and (m := self.plain.match(body, at)) and not self.symbols:
                run = m.end() - at
                out.append(m.group())
                froms.append(np.arange(at, at + run))
                heads.append(np.ones(run, bool))
                at += run
                continue
            else:
                size, text = self.map.longest(body, at) if self.map and at not in bad else (0, b"")
                if not size:
                    size = 1
                    while at + size < len(body) and body[at + size] & 0xC0 == 0x80:
                        size += 1
                    text = body[at : at + size]
            out.append(text)
            froms.append(np.full(len(text), at))
            heads.append(np.arange(len(text)) == 0)
            at += size
        made = b"".join(out)
        return made, places[np.concatenate(froms)] if made else np.zeros(0, np.int64), np.concatenate(heads) if made else np.zeros(0, bool)

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it comes from."""
        body, places, heads = self.mapped(raw)
        code = np.frombuffer(body, np.uint8)
        blank = code == 0x20
        if self.fold and blank.any():
            # Blanks that lead a chunk go when the text before that chunk ends with one, or there is none.
            first = np.maximum.accumulate(np.where(heads, np.arange(len(code)), 0))
            solid = np.cumsum(~blank) - ~blank
            keep = ~(blank & (solid == solid[first]) & np.concatenate([[True], blank])[first])
            body, places, blank = code[keep].tobytes(), places[keep], blank[keep]
        if not body:
            return b"", np.zeros(1, np.int64)
        size, end = len(self.blank), len(raw)
        if size > 1:
            places = np.repeat(places, np.where(blank, size, 1))
            body = body.replace(b" ", self.blank)
        if self.prefix and not self.suffix:
            body, places = self.blank + body, np.concatenate([np.full(size, places[0]), places])
        while self.fold and body.endswith(self.blank):
            body, end, places = body[:-size], int(places[-size]), places[:-size]
        if self.prefix and self.suffix:
            body, places = body + self.blank, np.concatenate([places, np.full(size, end)])
        return body, np.append(places, end)


class Encoder:
    """Ids and source spans of a text under one model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        spec, trainer, symbols, crossing, kinds = b"", {}, [], False, []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                kinds.append((piece[1], piece.get(3, _NORMAL)))
                if piece.get(3, _NORMAL) == _USER:
                    symbols.append(piece[1])
                crossing |= MARK in piece[1].decode().lstrip(MARK)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec += value
        self.normalize = Normalizer(spec, bool(trainer.get(24, 0)), symbols)
        self.whole = SentencePieceProcessor(model_proto=model)
        # Later fields of a message replace earlier ones: no character map, prefix, folding or marks.
        off = bytes([0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0])
        self.segment = SentencePieceProcessor(model_proto=model + bytes([0x1A, len(off)]) + off)
        self.by_part = trainer.get(3, 1) == _BPE and not crossing and not symbols and not bool(trainer.get(24, 0)) and any(p == MARK.encode() for p, _ in kinds)
        self.cut = re.compile(f"(?s).{{{PART}}}[^{MARK}]*[^{MARK}](?={MARK})|.+")
        # Bytes of normalised text that an id covers: those of its piece, or one of a character without a piece.
        self.covers = np.array([1 if k == _BYTE else len(p) for p, k in kinds], np.int64)
        self.unknown = self.whole.unk_id() if _BYTE not in {k for _, k in kinds} else -1

    def _pieces(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised part, and how many of its bytes each covers."""
        ids = np.asarray(self.segment.encode(part, return_type="numpy"), np.int64)
        if self.unknown in ids:
            # Without byte pieces an unknown piece has no length of its own.
            made = self.segment.encode(part, return_type="proto").pieces
            return np.array([p.id for p in made], np.int64), np.array([len(p.surface.encode()) for p in made], np.int64)
        return ids, self.covers[ids]

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the begin and end ids, and the source span of each."""
        body, places = self.normalize(raw)
        text = body.decode()
        parts = [text] if len(text) <= PART or not self.by_part else self.cut.findall(text)
        found = [self._pieces(p) for p in parts if p]
        ids = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        upto = np.cumsum(np.concatenate([f[1] for f in found])) if found else ids
        edges = places[np.concatenate([[0], upto])].astype(np.int64)
        first, last = self.whole.bos_id(), self.whole.eos_id()
        # The begin and end ids stand for no text.
        return (
            np.concatenate([[first], ids, [last]]).astype("<u4"),
            np.concatenate([[0], edges[:-1], [len(raw)]]).astype("<i8"),
            np.concatenate([[0], edges[1:], [len(raw)]]).astype("<i8"),
        )

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder for a worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    own = encoder(model)
    for batch in batches:
        ids, starts, ends, decoded = [], [], [], []
        for raw in batch.column(1).to_pylist():
            i, s, e = own.encode(raw or b"")
            ids.append(i.tobytes())
            starts.append(s.tobytes())
            ends.append(e.tobytes())
            decoded.append(own.decode(i.tolist()))
        columns = [batch.column(0), *(pa.array(c, pa.binary()) for c in (ids, starts, ends)), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends", "decoded"])


def _spans(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    own = encoder(model)
    names = ["doc_id", "position", "id", "piece", "start", "end"]
    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, starts, ends = own.encode(raw or b"")
            pieces = own.whole.id_to_piece(ids.tolist())
            columns = [pa.array([doc] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), pa.array(ids.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.string()), pa.array(starts), pa.array(ends)], names)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for every row.

    ``ids`` are little-endian unsigned 32-bit integers, ``starts`` and ``ends``
    the byte span of each id in the text as 64-bit ones; ``decoded`` is what the ids decode to.
    """
    return _rows(docs, doc_id, text).mapInArrow(partial(_encoded, model=read_model(path)), ENCODED)


def piece_spans(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, id, piece, start, end): one row per id, in order."""
    return _rows(docs, doc_id, text).mapInArrow(partial(_spans, model=read_model(path)), SPANS)


def digest_columns(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of encoded rows; the last is of the starts and ends."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )
