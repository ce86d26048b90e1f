"""License scan: phrases, and template markup compiled to token automata.

Templates hold the full wording of short licenses and of the notices that long ones
ask for; headings, copyright lines, names and list numbers are optional or replaceable.
A template is plain wording with two kinds of markup: ``<<optional>> ... <<end>>``
may be absent, and ``<<any n>>`` stands for up to n words. Wording is compared as
lower-cased words, so case, punctuation and layout don't matter, and a place is
accepted only if all mandatory wording stands there exactly. Each template becomes a
non-deterministic automaton over words, run from the places of its first word in
texts that hold its anchor, the longest run of mandatory words.

Whole texts are read, one at a time, however long. Null texts count as empty; repeated
rows are scanned alike; places that several templates match count for each of them;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_COPY = "<<optional>>Copyright <<end>><<optional>>(c) <<end>><<any 12>>"

#: Fixed wording of licenses and of the notices they ask for.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next
paragraph)<<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAME = """<<optional>>3<<end>> Neither the name of <<any 15>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 12>> BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ISC = """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND <<any 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL <<any 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any 4>> except in compliance with the
License. You may obtain a copy of the License at <<any 12>> Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License"""
_GNU = """<<any 6>> is free software<<optional>>: you<<end>><<optional>>; you<<end>> can redistribute it and/or modify it under the
terms of the {name} as published by the Free Software Foundation<<optional>>;<<end>> <<optional>>either <<end>>version {v}
<<optional>>of the License<<end>>"""
_GNU_TAIL = """ <<optional>>, or (at your option) any later version<<end>>. <<any 6>> is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for
more details"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<optional>>1<<end>> The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<optional>>2<<end>> Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<optional>>3<<end>>
This notice may not be removed or altered from any source distribution"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at"""
_NAMES = {"gpl": ("GNU General Public License", ("2", "3")), "lgpl": ("GNU <<optional>>Lesser <<end>><<optional>>Library <<end>>General Public License", ("2.1", "3")), "agpl": ("GNU Affero General Public License", ("3",))}

#: Templates: label and wording. Headings and copyright lines, where they stand, belong to the match.
TEMPLATES = (
    ("mit", f"<<optional>>The <<end>><<optional>>MIT License <<end>><<optional>>(MIT) <<end>>{_COPY} {_MIT}"),
    ("mit", "released under the <<optional>>terms of the<<end>> MIT License"),
    ("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause", f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}"),
    ("isc", f"<<optional>>ISC License <<end>>{_COPY} {_ISC}"),
    ("apache-2.0", _APACHE),
    ("apache-2.0", "licensed under the <<optional>>terms of the<<end>> Apache License, Version 2.0"),
    ("unlicense", _UNLICENSE),
    ("zlib", _ZLIB),
    ("bsl-1.0", _BOOST),
    ("mpl-2.0", _MPL),
    *[(f"{k}-{v if '.' in v else v + '.0'}", (_GNU + tail).format(name=name, v=v)) for k, (name, versions) in _NAMES.items() for v in versions for tail in (_GNU_TAIL,)],
    *[(f"gpl-{v}.0", f"licensed under the <<optional>>terms of the<<end>> GNU General Public License<<optional>>, as published by the Free Software Foundation<<end>>, <<optional>>either<<end>> version {v}") for v in ("2", "3")],
    *[(f"cc-{k.lower()}-4.0", f"licensed under <<optional>>a<<end>><<optional>>the<<end>> <<optional>>Creative Commons<<end>> {n} 4.0 International <<optional>>Public<<end>> License") for k, n in _CC.items()],
    *[(f"cc-{k.lower()}-4.0", f"licensed under <<optional>>a<<end>><<optional>>the<<end>> CC {k} 4.0") for k in _CC],
    ("cc0-1.0", "<<optional>>dedicated<<end>> <<optional>>released<<end>> <<optional>>to the public domain<<end>> under <<optional>>the<<end>> <<optional>>Creative Commons<<end>> CC0 1.0 Universal"),
)

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_TABLE).split()


class Automaton:
    """States are numbers; ``step[s]`` maps a word to the next state, ``free[s]`` leads on any word or none."""

    def __init__(self, wording: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.any_word: list[int] = [-1]
        self.skip: list[list[int]] = [[]]
        self.anchor: list[bytes] = []
        opened: list[int] = []
        run: list[bytes] = []
        at = 0
        for part in re.split(r"(<<[^>]*>>)", wording):
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.skip[opened.pop()].append(at)
            elif part.startswith("<<any"):
                for _ in range(int(part[5:-2])):
                    nxt = self._new()
                    self.any_word[at] = nxt
                    self.skip[at].append(nxt)
                    at = nxt
            else:
                for w in words_of(part):
                    nxt = self._new()
                    self.step[at][w] = nxt
                    at = nxt
                    if not opened:
                        run.append(w)
                        self.anchor = max(self.anchor, run, key=len)[:]
                if opened:
                    run = []
                continue
            run = []
        self.final = at
        self.first = {w for s in self._closed({0}) for w in self.step[s]}

    def _new(self) -> int:
        self.step.append({})
        self.any_word.append(-1)
        self.skip.append([])
        return len(self.step) - 1

    def _closed(self, states: Iterable[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def matches(self, words: list[bytes], start: int) -> int:
        """End of the shortest match from start, or -1."""
        states, i = self._closed({0}), start
        while states:
            if self.final in states:
                return i
            if i == len(words):
                return -1
            w = words[i]
            nxt = {self.step[s][w] for s in states if w in self.step[s]}
            nxt |= {self.any_word[s] for s in states if self.any_word[s] >= 0}
            states, i = self._closed(nxt), i + 1
        return -1


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where the phrase stands; joined: words between single blanks, with one at each end."""
    out, at, count, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = joined.find(phrase, at + 1)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (array of label, start) and found (array of label, start, end) of (doc_id, text)."""
    base_t = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    found_t = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", base_t), ("found", found_t)])

    def run(batches):
        phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]
        machines = [(label, a, b" " + b" ".join(a.anchor) + b" ") for label, a in ((k, Automaton(t)) for k, t in TEMPLATES)]
        for batch in batches:
            texts, rows = batch.column(1), []
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py() or "")
                joined = b" " + b" ".join(words) + b" "
                base = [{"label": label, "start": s} for p, label in phrases if p in joined for s in places(joined, p)]
                found = []
                for label, a, anchor in machines:
                    if anchor in joined:
                        for s, w in enumerate(words):
                            if w in a.first and (end := a.matches(words, s)) >= 0:
                                found.append({"label": label, "start": s, "end": end})
                rows.append((len(words), base, found))
            n, base, found = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(base, base_t), pa.array(found, found_t)], schema=schema
            )

    kind = "array<struct<label:string,start:long>>", "array<struct<label:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, base {kind[0]}, found {kind[1]}")


def query(docs: DataFrame) -> DataFrame:
    """Score: 1 where wording of a template stands whole, 0.5 where only a phrase does, else 0."""
    from pyspark.sql import functions as F

    starts = F.transform("base", lambda x: x["start"])
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("found"))).alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("score"),
    )
