"""Words of a text, on UTF-8 bytes inside tasks and as Spark columns.

A word here is a longest run of characters other than ASCII control
characters, blanks, punctuation and capitals, after A-Z became a-z. Every byte
of a character beyond ASCII is above 0x7F, so the byte rule equals the rule on
characters.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[\x20\x09-\x0D]+"

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_WORDS = bytes(c if c in _KEEP else 0x20 for c in _LOWER)


def words(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return raw.translate(_WORDS).split()


def tokens(raw: bytes) -> list[bytes]:
    """The runs of other than ASCII white space, with A-Z lower-cased."""
    return raw.translate(_LOWER).split()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    """The same words as a Spark array; no words for NULL."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)
