import pytest

from fieldwater.llm import licenses as L
from tests.llm.helpers import empty_docs, make_docs, words

TEXTS = [
    None, "", "CC BY", "cc-by cc by cc by", "cc byte", "All rights reserved, all RIGHTS  reserved", "GNU General Public License!", "general public licenses",
    "Released under the MIT License.", "released under the terms of the MIT license", "under the mit license", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
    "Copyright (c) 2020 2021 Some Holder. All rights reserved.", "é " * 40_000 + "all rights reserved", "licensed licensed under the the mit license",
]


def places(text):
    w, out = words(text), {}
    for phrase, label in L.PHRASES:
        p = phrase.split()
        if at := [i for i in range(len(w)) if w[i : i + len(p)] == p]:
            out[label] = at
    return len(w), out


def test_base_places(spark):
    docs = [*enumerate(TEXTS), (None, "cc by"), (2, "CC BY")]
    got = sorted((tuple(r)[:6] for r in L.digest_columns(L.licenses(make_docs(spark, docs))).collect()), key=repr)
    want = []
    for i, text in docs:
        n, at = places(text)
        every = sorted(s for v in at.values() for s in v)
        want.append((i, n, len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(at))))
    assert got == sorted(want, key=repr)


def test_labels(spark):
    got = {r.doc_id: r.labels for r in L.licenses(make_docs(spark, list(enumerate(TEXTS)))).collect()}
    assert got[8] == got[9] == ["mit"] and got[10] == [] and got[11] == ["cc-by", "cc-by-nc-4.0"] and got[12] == ["gpl", "gpl-3.0"]
    assert got[13] == ["apache-2.0"] and got[14] == ["copyright-notice", "reserved"] and got[16] == []
    assert L.licenses(empty_docs(spark)).count() == 0


@pytest.mark.parametrize(
    ("template", "text", "spans"),
    [
        ("a [[b c]] d", "x a d a b c d a b d", [(1, 3), (3, 7)]),
        ("[[x]] a {n:1-2} b", "x a q b a b a 1 2 b a 1 2 3 b", [(0, 4), (6, 10)]),
        ("{v:p|q} a [[b [[c]]]]", "p a b c q a r a", [(0, 4), (4, 6)]),
        ("a {n:0-3} a", "a a a", [(0, 3)]),
    ],
)
def test_automata(template, text, spans):
    assert L.Automaton(template).match(text.encode().split()) == spans


MIT = """Copyright (c) 2021 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def found(spark, texts):
    rows = L.digest_columns(L.licenses(make_docs(spark, list(enumerate(texts))))).collect()
    return [(r.labels, r.score) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_whole_texts_and_altered_ones(spark):
    zero = ISC.replace(", provided that the above copyright\nnotice and this permission notice appear in all copies", "")
    two = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE IS PROVIDED BY") :]
    json = MIT.replace("of the Software.\n\nTHE", "of the Software.\n\nThe Software shall be used for Good, not Evil.\n\nTHE")
    assert json != MIT and zero != ISC
    texts = [
        MIT, ISC, zero, BSD3, two, "before " + MIT.replace('"AS IS"', "“AS IS”") + " after",
        # Altered, or cut short: not the licence.
        json, MIT[: MIT.index("subject to")], ISC[: ISC.index("THE SOFTWARE")], MIT.replace("sublicense, ", ""), ISC.replace("AND THE AUTHOR", "BUT THE AUTHOR"),
        BSD3[: BSD3.index("THIS SOFTWARE IS PROVIDED BY")], BSD3.replace("without\nspecific", "with\nspecific"), MIT.replace("IN THE SOFTWARE.", "IN IT."),
    ]
    assert found(spark, texts) == [
        ("mit", 1.0), ("isc", 1.0), ("0bsd", 1.0), ("bsd-3-clause", 1.0), ("bsd-2-clause", 1.0), ("mit", 1.0), *[("", 0.0)] * 8
    ]


def test_naming_a_licence_is_less_sure_than_its_text(spark):
    header = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        "governing permissions and limitations under the License."
    )
    texts = [header, "Licensed under the Apache License, Version 2.0 is what we do not use", "Released under the MIT License. " + MIT, "see cc by", "none"]
    assert found(spark, texts) == [("apache-2.0", 0.9), ("apache-2.0", 0.75), ("mit", 1.0), ("cc-by", 0.5), ("", 0.0)]


@pytest.mark.parametrize("bad", ["a [[ b", "a ]] b", "[[a]]", "{n:0-3}"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        L.Automaton(bad)
