"""License scans by template-markup matching.

A template is the wording of a license or notice with marked regions:

    <<beginOptional>> ... <<endOptional>>     wording that may be left out; may be nested
    <<var;name=N;match=lo-hi>>                a replaceable region of lo to hi words
    <<var;name=N;match=a b|c>>                a replaceable region that is one of the phrases

Wording is taken word by word, as texts are: A-Z lower-cased, words of letters, digits and
non-ASCII characters, all else between words ignored. Each template is compiled to a
nondeterministic automaton over words; a text holds the license where the automaton accepts
some run of consecutive words, so that all mandatory words stand there exactly and in order.
Automata run only where a template's opening words stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, lean, slices

#: Lower-cases A-Z and turns every ASCII byte that no word holds into a blank.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

#: Phrases looked for as they stand, and the label each gives.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_LICENSED = "<<var;name=opening;match=licensed|is licensed|are licensed|released|distributed|available|provided>> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> "
_HOLDER = "<<beginOptional>>copyright <<var;name=holder;match=0-24>><<endOptional>> "
_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list
    of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name=by;match=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    <<var;name=who;match=1-14>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
    NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
    ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
    THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_NOTICE = """<<var;name=what;match=This program|This library|This file>> is free software: you can redistribute it and/or modify it under the
    terms of the GNU %s License as published by the Free Software Foundation, either version %s of the License, or (at your
    option) any later version. <<var;name=what;match=This program|This library|This file>> is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s License for more
    details."""

#: (label, markup); several templates may share a label. The first are whole license texts up to the end of their mandatory wording, then
#: come whole notices that stand in files' heads, then one-line statements.
TEMPLATES = (
    ("mit", _HOLDER + """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=who;match=1-14>> BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND <<var;name=who;match=1-6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=whom;match=1-6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE
        IS PROVIDED "AS IS" AND <<var;name=who;match=1-6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=whom;match=1-6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", _BSD_OPENING + _BSD_DISCLAIMER),
    ("bsd-3-clause", _BSD_OPENING + """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=holder;match=1-12>> nor the names of
        <<var;name=whose;match=its|any|the|other>> contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. """ + _BSD_DISCLAIMER),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;name=who;match=authors|author>>
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
        DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
        heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;name=what;match=file|software|work>>
        except in compliance with the License. You may obtain a copy of the License at <<var;name=scheme;match=http|https>>
        www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0-notice", _GNU_NOTICE % ("General Public", "2", "General Public")),
    ("gpl-3.0-notice", _GNU_NOTICE % ("General Public", "3", "General Public")),
    ("lgpl-2.1-notice", _GNU_NOTICE % ("Lesser General Public", "2.1", "Lesser General Public")),
    ("lgpl-3.0-notice", _GNU_NOTICE % ("Lesser General Public", "3", "Lesser General Public")),
    ("agpl-3.0-notice", _GNU_NOTICE % ("Affero General Public", "3", "Affero General Public")),
    ("mpl-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at <<var;name=scheme;match=http|https>> mozilla.org/MPL/2.0"""),
    ("mit", _LICENSED + "mit license"),
    ("isc", _LICENSED + "isc license"),
    ("bsd", _LICENSED + "<<beginOptional>><<var;name=kind;match=2 clause|3 clause|new|simplified|revised|modified>><<endOptional>> bsd license"),
    ("apache-2.0", _LICENSED + "apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("gpl-2.0", _LICENSED + "gnu general public license <<var;name=version;match=version 2|v2|version 2 0>>"),
    ("gpl-3.0", _LICENSED + "gnu general public license <<var;name=version;match=version 3|v3|version 3 0>>"),
    ("lgpl", _LICENSED + "gnu <<var;name=kind;match=lesser|library>> general public license"),
    ("agpl", _LICENSED + "gnu affero general public license"),
    ("mpl-2.0", _LICENSED + "mozilla public license <<beginOptional>>version<<endOptional>> 2 0"),
    ("cc-by-4.0", _LICENSED + "cc by 4 0"),
    ("cc-by-nc-4.0", _LICENSED + "cc by nc 4 0"),
    ("cc-by-sa-4.0", _LICENSED + "cc by sa 4 0"),
    ("cc-by-nd-4.0", _LICENSED + "cc by nd 4 0"),
    ("cc-by-4.0", _LICENSED + "creative commons attribution 4 0 international license"),
    ("cc0-1.0", _LICENSED + "cc0 1 0"),
    ("spdx", "spdx license identifier <<var;name=id;match=1-1>>"),
    ("copyright-notice", "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;match=1-16>> all rights reserved"),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, as both texts and templates are split."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """A nondeterministic automaton over words. steps[s]: next states by word; any_word[s]: next states by any word."""

    label: str
    steps: list[dict[bytes, set[int]]] = field(default_factory=list)
    any_word: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    start: int = 0
    final: int = 0

    def state(self) -> int:
        self.steps.append({})
        self.any_word.append(set())
        self.free.append(set())
        return len(self.steps) - 1

    def phrase(self, at: int, words: list[bytes]) -> int:
        for word in words:
            to = self.state()
            self.steps[at].setdefault(word, set()).add(to)
            at = to
        return at

    def close(self) -> None:
        """Replace free moves by their closure."""
        for s in range(len(self.free)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.free[todo.pop()] - seen:
                    seen.add(t)
                    todo.append(t)
            self.free[s] = seen

    def openings(self) -> set[tuple[bytes, ...]]:
        """The first two words, or the first alone where the second is open, of every way to begin."""
        found = set()
        for s in self.free[self.start]:
            if self.any_word[s]:
                raise ValueError(f"{self.label}: a template can't begin with an open region")
            for word, to in self.steps[s].items():
                after = set().union(*(self.free[t] for t in to))
                if self.final in after or any(self.any_word[t] for t in after):
                    found.add((word,))
                else:
                    found |= {(word, second) for t in after for second in self.steps[t]}
        return found

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from at, -1 if there is none."""
        states, end = self.free[self.start], -1
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            word, reached = words[at], set()
            for s in states:
                reached |= self.any_word[s]
                reached |= self.steps[s].get(word, set())
            states = set().union(*(self.free[s] for s in reached)) if reached else set()
            at += 1
        return end


_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template; raises ValueError on markup that doesn't nest."""
    auto = Automaton(label)
    at = auto.start = auto.state()
    opened: list[int] = []
    for k, part in enumerate(_MARK.split(markup)):
        if k % 2 == 0:
            at = auto.phrase(at, words_of(part))
        elif part == "beginOptional":
            opened.append(at)
            inside = auto.state()
            auto.free[at].add(inside)
            at = inside
        elif part == "endOptional":
            if not opened:
                raise ValueError(f"{label}: endOptional without beginOptional")
            after = auto.state()
            auto.free[at].add(after)
            auto.free[opened.pop()].add(after)
            at = after
        else:
            match = dict(x.split("=", 1) for x in part.split(";")[1:])["match"]
            after = auto.state()
            if bounds := re.fullmatch(r"(\d+)-(\d+)", match):
                lo, hi = map(int, bounds.groups())
                for n in range(hi + 1):
                    if n >= lo:
                        auto.free[at].add(after)
                    if n < hi:
                        to = auto.state()
                        auto.any_word[at].add(to)
                        at = to
            else:
                for choice in match.split("|"):
                    auto.free[auto.phrase(at, words_of(choice))].add(after)
            at = after
    if opened:
        raise ValueError(f"{label}: beginOptional without endOptional")
    auto.final = at
    auto.close()
    return auto


class Scanner:
    """All templates and phrases together. scan() gives every place found in a text."""

    def __init__(self, templates=TEMPLATES, phrases=None):
        self.automata = [compile_template(*t) for t in templates]
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", len(words_of(p)), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.openings: dict[bytes, list[Automaton]] = {}
        for auto in self.automata:
            for words in auto.openings():
                self.openings.setdefault(b" " + b" ".join(words) + b" ", []).append(auto)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """(number of words, [(first word, label) of each phrase place], [(first word, end, label) of each template place])."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "

        def places(phrase: bytes) -> Iterator[int]:
            at = joined.find(phrase)
            upto = word = 0
            while at >= 0:
                word += joined.count(b" ", upto, at)
                upto = at
                yield word
                at = joined.find(phrase, at + 1)

        base = [(word, label) for phrase, _, label in self.phrases for word in places(phrase)]
        found = set()
        for opening, automata in self.openings.items():
            for word in places(opening):
                for auto in automata:
                    end = auto.match(words, word)
                    if end > word:
                        found.add((word, end, auto.label))
        return len(words), sorted(base), sorted(found)


_SCANNER: list[Scanner] = []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, base (array of word and label), found (array of first word, end, label).

    Null and empty texts have no words and no places. Rows that repeat an id are scanned once each. Other columns
    are not read. An empty table gives an empty table.
    """
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct([("word", pa.int64()), ("end", pa.int64()), ("label", pa.string())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in slices(batches, "text"):
            scans = [_SCANNER[0].scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([s[0] for s in scans], pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in s[1]] for s in scans], pa.list_(place)),
                    pa.array([[{"word": w, "end": e, "label": x} for w, e, x in s[2]] for s in scans], pa.list_(span)),
                ],
                ["doc_id", "n_words", "base", "found"],
            )

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(picked).mapInArrow(run, "doc_id bigint, n_words bigint, base array<struct<word:bigint,label:string>>, found array<struct<word:bigint,end:bigint,label:string>>")


def license_digest(scanned: DataFrame) -> DataFrame:
    """n_base, first and last base place, labels and score: 1 where a template's whole wording stands, 0.5 for phrases only, else 0."""
    base, found = F.col("base"), F.col("found")
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[c["label"] for c in cols]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, found).alias("labels"),
        F.when(F.size(found) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
        F.size(found).cast("bigint").alias("n_found"),
    )
