"""License scanning with marked-up templates compiled to token automata.

A template is a license text in which ``[[ ... ]]`` encloses an optional region
and ``{name:words}`` a replaceable one: ``{name:0-12}`` takes that many words,
whatever they are, and ``{name:a|b}`` one of the listed words. It compiles to an
automaton over words that accepts a text exactly when the mandatory wording
stands there word for word, from the first word of the template to the last. Its longest
mandatory run of words is searched first, and the automaton runs only over
texts that hold it. Whole licences, their standard headers and sentences that merely
name a licence are templates of different kinds with different scores: words
say nothing of what the rest of a sentence does with the name.

The base phrases are found by themselves, at every place.

Defined cases: a NULL text counts as empty: no words, no labels, no places,
score 0. Repeated rows are each answered; the id may be NULL. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwater.llm.store import bounded_batches
from fieldwater.llm.words import words

# Phrases and their labels, fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# How sure a matched template of a kind makes us, from 0 to 1: the whole licence or its whole standard header, or a sentence that names one.
SCORES = {"text": 1.0, "header": 0.9, "notice": 0.75}

_AS_IS = "{open:as|“as} {close:is|is”}"
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files [[the {open:software|“software|software”|“software”}]] to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so "
)
_MIT_DISCLAIMER = (
    f"the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall [[the]] {who:1-8} be liable for any claim "
    "damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software"
)
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
_ISC_DISCLAIMER = (
    f"the software is provided {_AS_IS} and {{who:1-8}} disclaims all warranties with regard to this software including all implied warranties "
    "of merchantability and fitness in no event shall {who:1-8} be liable for any special direct indirect or consequential damages or any "
    "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
    "arising out of or in connection with the use or performance of this software"
)
_BSD_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met [[{mark:1|a}]] redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer [[{mark:2|b}]] redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "[[{mark:3|c}]] neither the name of {holder:1-12} nor the names of {whose:its|their|his|her} contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission "
)
_BSD_DISCLAIMER = (
    f"this software is provided by {{who:1-12}} {_AS_IS} and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {who:1-14} be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of "
    "the possibility of such damage"
)
_GPL_HEADER = (
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version {number} of the license or at your option any later version {what:1-6} is distributed in the "
    "hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
    "particular purpose see the gnu general public license for more details"
)
_NAMED = "{verb:released|licensed|distributed|available} under the [[terms of the]]"

# Templates (label, kind, words), fixed values: public licence texts from their grant to the end of their disclaimer, standard headers,
# and sentences that name a licence. Markup as described above.
TEMPLATES = (
    (
        "mit",
        "text",
        _MIT_GRANT + "subject to the following conditions the above copyright notice and this permission notice "
        "[[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _MIT_DISCLAIMER,
    ),
    ("mit-0", "text", _MIT_GRANT + _MIT_DISCLAIMER),
    (
        "isc",
        "text",
        _ISC_GRANT + "provided that the above copyright notice and this permission notice appear in all copies " + _ISC_DISCLAIMER,
    ),
    ("0bsd", "text", _ISC_GRANT + _ISC_DISCLAIMER),
    ("bsd-2-clause", "text", _BSD_GRANT + _BSD_DISCLAIMER),
    ("bsd-3-clause", "text", _BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER),
    (
        "zlib",
        "text",
        f"this software is provided {_AS_IS} without any express or implied warranty in no event will [[the]] {{who:1-8}} be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of "
        "this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
        "product an {ack:acknowledgment|acknowledgement} in the product documentation would be appreciated but is not required [[2]] altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or "
        "altered from any source distribution",
    ),
    (
        "unlicense",
        "text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
        "any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment "
        "of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law " + _MIT_DISCLAIMER,
    ),
    (
        "apache-2.0",
        "header",
        "licensed under the apache license version 2 0 [[the {open:license|“license|license”|“license”}]] you may not use this "
        "{what:1-3} except in compliance with the license you may obtain a copy of the license at {scheme:http|https} www apache org licenses "
        "license 2 0 [[{ending:txt|html}]] unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an {open:as|“as} {close:is|is”} basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    ("gpl-2.0", "header", _GPL_HEADER.replace("{number}", "2")),
    ("gpl-3.0", "header", _GPL_HEADER.replace("{number}", "3")),
    ("mit", "notice", f"{_NAMED} mit license"),
    ("apache-2.0", "notice", f"{_NAMED} apache license version 2 0"),
    (
        "gpl-3.0",
        "notice",
        f"[[this {{what:1-3}} is]] {_NAMED} [[gnu]] general public license [[as published by the free software foundation either]] version 3",
    ),
    ("cc-by-nc-4.0", "notice", "{verb:released|licensed|distributed|available} under [[a]] [[creative commons]] cc by nc 4 0"),
    ("copyright-notice", "notice", "copyright [[c]] {year:0-3} {holder:1-8} all rights reserved"),
)

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,kind:string,start:long,end:long>>"

_PART = re.compile(r"\[\[|\]\]|\{\w+:[^}]*\}|[^\s\[\]{}]+")


def parse(template: str) -> list:
    """Nested parts: a word, (least, most) free words, a set of words, or a list for an optional region."""
    stack: list[list] = [[]]
    for part in _PART.findall(template):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            region = stack.pop()
            if not stack:
                raise ValueError("an optional region ends that never began")
            stack[-1].append(region)
        elif part.startswith("{"):
            allowed = part[1:-1].split(":", 1)[1]
            span = re.fullmatch(r"(\d+)-(\d+)", allowed)
            stack[-1].append((int(span[1]), int(span[2])) if span else frozenset(w.encode() for w in allowed.split("|")))
        else:
            stack[-1].append(part.encode())
    if len(stack) > 1:
        raise ValueError("an optional region never ends")
    return stack[0]


class Automaton:
    """States 0..n; ``steps`` by state: (word, set of words, or None for any word, next state); ``free`` moves take no word."""

    def __init__(self, template: str) -> None:
        parts = parse(template)
        self.steps: list[list[tuple]] = [[]]
        self.free: list[set[int]] = [set()]
        self.last = self._add(parts, 0)
        self.closed = [self._closure(s) for s in range(len(self.steps))]
        self.anchor = self._longest_run(parts)
        if not self.anchor:
            raise ValueError("a template needs mandatory words")

    def _state(self) -> int:
        self.steps.append([])
        self.free.append(set())
        return len(self.steps) - 1

    def _add(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                end = self._add(part, at)
                after = self._state()
                self.free[end].add(after)
                self.free[at].add(after)
                at = after
            elif isinstance(part, tuple):
                for k in range(part[1]):
                    after = self._state()
                    self.steps[at].append((None, after))
                    if k >= part[0]:
                        self.free[at].add(after)
                    at = after
            else:
                after = self._state()
                self.steps[at].append((part, after))
                at = after
        return at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    @staticmethod
    def _longest_run(parts: list) -> bytes:
        runs, run = [], []
        for part in [*parts, None]:
            if isinstance(part, bytes):
                run.append(part)
            else:
                runs.append(run)
                run = []
        return b" ".join(max(runs, key=lambda r: len(b" ".join(r))))

    def match(self, own: list[bytes]) -> list[tuple[int, int]]:
        """Spans of accepted word runs: from each start, the longest; overlapping later starts are skipped."""
        begun: dict[int, int] = {}  # state: earliest start that has reached it
        found: dict[int, int] = {}
        for i in range(len(own) + 1):
            for s in self.closed[0]:
                begun.setdefault(s, i)
            if self.last in begun and begun[self.last] < i:
                found[begun[self.last]] = i
            if i == len(own):
                break
            word, moved = own[i], {}
            for state, start in begun.items():
                for accepts, after in self.steps[state]:
                    if accepts is None or word == accepts or (isinstance(accepts, frozenset) and word in accepts):
                        for s in self.closed[after]:
                            moved[s] = min(start, moved.get(s, start))
            begun = moved
        spans: list[tuple[int, int]] = []
        for start in sorted(found):
            if not spans or start >= spans[-1][1]:
                spans.append((start, found[start]))
        return spans


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str, str], ...]) -> tuple[tuple[str, str, Automaton], ...]:
    return tuple((label, kind, Automaton(text)) for label, kind, text in templates)


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand in a text of words with one blank around each."""
    found, at, seen, number = [], joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        found.append(number)
        at = joined.find(phrase, at + len(phrase) - 1)
    return found


def _scan(batches: Iterator[pa.RecordBatch], phrases: tuple, templates: tuple) -> Iterator[pa.RecordBatch]:
    automata = compiled(templates)
    wanted = [(f" {phrase} ".encode(), label) for phrase, label in phrases]
    for batch in batches:
        rows = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words(raw or b"")
            joined = b" " + b" ".join(own) + b" "
            base = {label: found for phrase, label in wanted if (found := places(joined, phrase))}
            spans = [
                {"label": label, "kind": kind, "start": start, "end": end}
                for label, kind, automaton in automata
                if b" " + automaton.anchor + b" " in joined
                for start, end in automaton.match(own)
            ]
            starts = sorted(s for found in base.values() for s in found)
            labels = sorted(base.keys() | {s["label"] for s in spans})
            rows.append((doc_id, len(own), len(starts), starts[0] if starts else None, starts[-1] if starts else None, sorted(base), labels, spans))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans"]
        span = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.string())] * 2 + [span]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: words, places of the base phrases, labels, and the spans (in words) of matched templates."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(lambda it: _scan(it, phrases, templates), RESULT)


def digest_columns(found: DataFrame) -> DataFrame:
    """The report row; the score is that of the surest matched template's kind, 0.5 where only a phrase stands, else 0."""
    sure = [F.when(F.array_contains("spans.kind", kind), value) for kind, value in SCORES.items()]
    score = F.greatest(*sure, F.when(F.col("n_base") > 0, 0.5), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), score.alias("score"),
    )
