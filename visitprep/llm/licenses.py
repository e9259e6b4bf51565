"""License scans by template-markup matching.

A template is license wording with markup for regions that may differ: ``<<optional>> ... <<end>>``
may be left out as a whole, and may hold further such regions; ``<<any:N>>`` stands for up to N arbitrary words and ``<<one:a|b|c>>`` for
one of the listed phrases.  A template compiles to an automaton over words; a text carries its label
when the automaton accepts a run of the text's words, so all mandatory wording has to match exactly.
Runs are tried only where the template's longest mandatory phrase stands, found by a byte search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels (fixed by the contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label: short notices as they stand in files, with the usual variations marked up.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<optional>>version<<end>> 2 0 <<optional>>the license<<end>>",
    "mit": "<<one:released|licensed|distributed|available>> under the <<optional>>terms of the<<end>> mit <<one:license|licence>>",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3.0": "<<one:licensed|distributed|released>> under the <<optional>>terms of the<<end>> gnu <<one:general public license|gpl>> <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3 <<optional>>0<<end>>",
    "gpl-2.0": "<<one:licensed|distributed|released>> under the <<optional>>terms of the<<end>> gnu <<one:general public license|gpl>> <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2 <<optional>>0<<end>>",
    "cc-by-nc-4.0": "<<one:licensed|released>> under <<optional>>a<<end>> <<one:cc|creative commons>> <<one:by nc|attribution noncommercial>> 4 0 <<optional>>international<<end>>",
    "cc-by-sa-4.0": "<<one:licensed|released>> under <<optional>>a<<end>> <<one:cc|creative commons>> <<one:by sa|attribution sharealike>> 4 0 <<optional>>international<<end>>",
    "cc-by-4.0": "<<one:licensed|released>> under <<optional>>a<<end>> <<one:cc|creative commons>> <<one:by|attribution>> 4 0 <<optional>>international<<end>>",
    "cc0": "<<one:released|dedicated|licensed>> under <<optional>>the<<end>> cc0 <<optional>>1 0 universal<<end>>",
    "copyright": "copyright <<optional>>c<<end>> <<any:8>> all rights reserved",
}

# Whole license bodies, in which names of holders and list numbers are replaceable.
_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
_CLAUSES = "<<any:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<any:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
_NAMES = "<<any:1>> neither the name of <<any:12>> nor the names of <<one:its|the>> contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_AS_IS = (
    "this software is provided by <<any:8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any:10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
BODIES = {
    "mit-body": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<one:the authors or copyright holders|the copyright holders|the authors>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-2-clause": _GRANT + _CLAUSES + _AS_IS,
    "bsd-3-clause": _GRANT + _CLAUSES + _NAMES + _AS_IS,
    "isc": (
        "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<any:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    ),
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and <<any:4>> disclaims all warranties with regard to this software",
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "<<any:1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "<<any:1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "<<any:1>> this notice may not be removed or altered from any source distribution"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "bsl-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license <<optional>>you may obtain a copy of the license at "
        "<<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses license 2 0<<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied"
    ),
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}
TEMPLATES |= BODIES

# Letters, digits and everything outside ASCII make words; A-Z fall to a-z, the rest to spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Automaton:
    """A nondeterministic automaton over words; state 0 starts, ``final`` accepts."""

    label: str
    moves: dict[int, dict[bytes, set[int]]] = field(default_factory=dict)
    wild: dict[int, set[int]] = field(default_factory=dict)
    empty: dict[int, set[int]] = field(default_factory=dict)
    states: int = 1
    final: int = 0
    anchor: bytes = b""
    lead: int = 0

    def _new(self) -> int:
        self.states += 1
        return self.states - 1

    def _phrase(self, at: int, phrase: list[bytes]) -> int:
        for word in phrase:
            to = self._new()
            self.moves.setdefault(at, {}).setdefault(word, set()).add(to)
            at = to
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.empty.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run from ``start``, or -1."""
        now, end, i = self.closure({0}), -1, start
        while now:
            if self.final in now:
                end = i
            if i == len(words):
                break
            to = set()
            for s in now:
                to |= self.moves.get(s, {}).get(words[i], set()) | self.wild.get(s, set())
            now, i = self.closure(to), i + 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template; its anchor is the longest phrase that every match holds.

    Optional regions nest.  A template without mandatory wording is an error: it would accept anything.
    """
    a, at, anchors, most, optional = Automaton(label), 0, [], 0, []
    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            optional.append(at)
        elif part == "<<end>>":
            a.empty.setdefault(optional.pop(), set()).add(at)
        elif part.startswith("<<any:"):
            n, first = int(part[6:-2]), at
            for _ in range(n):
                to = a._new()
                a.wild.setdefault(at, set()).add(to)
                a.empty.setdefault(first, set()).add(to)
                at = to
            most += n
        elif part.startswith("<<one:"):
            choices, end = [words_of(c.encode()) for c in part[6:-2].split("|")], a._new()
            for choice in choices:
                a.empty.setdefault(a._phrase(at, choice), set()).add(end)
            at, most = end, most + max(map(len, choices))
        else:
            phrase = words_of(part.encode())
            if phrase and not optional:
                anchors.append((len(phrase), b" ".join(phrase), most))
            at, most = a._phrase(at, phrase), most + len(phrase)
    if not anchors or optional:
        raise ValueError(f"template {label!r} needs mandatory wording outside optional regions, each of them closed")
    _, a.anchor, a.lead = max(anchors, key=lambda x: (len(x[1]), -x[2]))
    a.final = at
    return a


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word places of a phrase in words that are joined and framed by single spaces."""
    target, at, seen, n = b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(target, at + 1)) >= 0:
        n += joined.count(b" ", seen, at)
        seen = at
        yield n


def scan_text(text: bytes, automata: list[Automaton]) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Number of words, places of base phrases, and spans that templates accept."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = sorted((at, label) for phrase, label in PHRASES.items() for at in places(joined, phrase.encode()))
    found = set()
    for a in automata:
        for at in places(joined, a.anchor):
            for start in range(max(0, at - a.lead), at + 1):
                end = a.match(words, start)
                if end > at:
                    found.add((start, end, a.label))
                    break
    return len(words), base, sorted(found)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """License labels of every document, with the accepted spans of words.

    ``labels`` are the base labels and the labels of the templates that accept a run of words.
    ``score`` says how much of the text is license wording: 1 - (1 - share) / 2 for a text with any
    label, where share is the part of its words inside accepted spans or base phrases, else 0.
    Null and empty texts have no words and no labels; repeated rows give equal rows; an empty table
    gives no rows; further columns are ignored.
    """
    automata = [compile_template(k, v) for k, v in sorted((templates or TEMPLATES).items())]
    length = {label: len(phrase.split()) for phrase, label in PHRASES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), kind]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text"), strict=True):
                n, base, spans = scan_text(text, automata)
                labels = {label for _, label in base}
                every = labels | {label for *_, label in spans}
                covered, upto = 0, 0
                for first, end in sorted([(s, e) for s, e, _ in spans] + [(at, at + length[label]) for at, label in base]):
                    covered += max(0, end - max(first, upto))
                    upto = max(upto, end)
                score = 1 - (1 - covered / n) / 2 if every else 0.0
                rows.append((doc_id, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(every)), score, [{"first": s, "end": e, "label": x} for s, e, x in spans]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
