"""License scans by template-markup matching.

A template is wording with two kinds of markup: ``[[ ... ]]`` is an optional
region and ``{{n}}`` a replaceable region of at most ``n`` words.  Everything
else is mandatory and must match word by word.  Each template is compiled into
a nondeterministic automaton over words (states are positions in the wording,
optional regions add skip edges, replaceable regions add counted wildcard
states).  A text is scanned from every place where a template can begin.

Defined results: a null or empty text has no words, no places and no labels;
repeated phrases count every time; several templates at one place all count;
only doc_id and text are read, so extra columns may have any name.
Only the words near a possible beginning run through the automata, whole texts
are always scanned, and memory is one batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: phrase -> label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Template wording: (label, template).  Words are compared after lower-casing A-Z.
TEMPLATES = (
    ("mit", "released under [[the terms of]] the mit license"),
    ("mit", "licensed under [[the terms of]] the mit license"),
    ("mit", "spdx license identifier mit"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the {{6}} to deal in the {{6}} without restriction",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("apache-2.0", "{{4}} licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-3.0", "licensed under the gnu general public license version 3 [[of the license]]"),
    ("gpl-2.0", "licensed under the gnu general public license version 2 [[of the license]]"),
    ("gpl-3.0", "spdx license identifier gpl 3 0 [[or later]]"),
    (
        "gpl",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation [[either]] version {{3}} [[of the license]]",
    ),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[creative commons]] cc by nc sa 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0"),
    ("cc0-1.0", "[[released]] under [[the]] [[creative commons]] cc0 1 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # Whole texts of licences and notices.  Regions in [[ ]] may be missing, also one within another.
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the {{6}} to deal in the {{6}} without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the {{6}} and to permit persons to whom the {{6}} is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] "
        "shall be included in all copies or substantial portions of the {{6}} [[the software is provided as is without warranty of any "
        "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the {{6}} be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]]",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies [[the software is provided as is and {{6}} "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness [[in no "
        "event shall {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever]]]]",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution this software is provided "
        "by {{12}} as is",
    ),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of "
        "{{12}} nor the names of {{4}} contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied [[see the license "
        "for the specific language governing permissions and limitations under the license]]",
    ),
    (
        "lgpl",
        "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation [[either]] version {{3}} [[of the license]]",
    ),
    (
        "agpl",
        "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
        "foundation [[either]] version {{3}} [[of the license]]",
    ),
    (
        "gpl-3.0-or-later",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or [[at your option]] any later version",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at {{5}}",
    ),
    ("proprietary", "copyright [[c]] {{8}} all rights reserved"),
)

#: "All rights reserved" opens many open licences too: it stands for itself only if none of their wordings begins this near.
REFUTED_BY_WORDS = 60

# Every byte that is not part of a word becomes a space; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

RESULT = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,"
    "labels:array<string>,score:double,spans:array<struct<label:string,first:bigint,words:bigint>>>"
)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n: state i waits for the i-th symbol of the wording; n accepts.

    ``symbols[i]`` is a word, or None for one word of a replaceable region.
    ``skips[i]`` lists the states that are reached from i without a word.
    """

    label: str
    symbols: tuple[bytes | None, ...]
    skips: tuple[tuple[int, ...], ...]
    mandatory: int
    starts: frozenset[bytes] | None  # None: a replaceable region may come first

    def closure(self, states: Iterable[int]) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.skips[s])
        return seen

    def run(self, text: list[bytes], at: int) -> tuple[int, float]:
        """(words of the longest accepted run from ``at`` or 0, share of the wording reached: 1 if accepted, else 0 below a half)."""
        end, states, best, reached = len(self.symbols), self.closure([0]), 0, 0
        for i in range(at, len(text)):
            w = text[i]
            states = self.closure(s + 1 for s in states if s < end and (self.symbols[s] is None or self.symbols[s] == w))
            if not states:
                break
            reached = max(reached, *states)
            if end in states:
                best = i + 1 - at
        share = reached / end
        return best, 1.0 if best else share if 0.5 <= share < 1 else 0.0


def compile_template(label: str, template: str) -> Automaton:
    symbols: list[bytes | None] = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    mandatory = 0
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            opened.append(len(symbols))
        elif part == "]]":
            jumps.append((opened.pop(), len(symbols)))
        elif part.startswith("{{"):
            n, first = int(part[2:-2]), len(symbols)
            jumps += [(first + i, first + n) for i in range(n)]
            symbols += [None] * n
        else:
            symbols.append(part.encode())
            mandatory += not opened
    if opened or not mandatory:
        raise ValueError(f"template of {label!r}: unclosed region or no mandatory word")
    skips = tuple(tuple(to for at, to in jumps if at == i) for i in range(len(symbols) + 1))
    a = Automaton(label, tuple(symbols), skips, mandatory, frozenset())
    first = a.closure([0])
    starts = None if any(symbols[s] is None for s in first) else frozenset(symbols[s] for s in first)
    return Automaton(label, a.symbols, skips, mandatory, starts)


class Scanner:
    """All templates, indexed by a mandatory word and by the words they can begin with."""

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES):
        self.automata = [compile_template(*t) for t in templates]
        # A replaceable region at the beginning is anchored at the first fixed word instead.
        self.by_start: dict[bytes, list[tuple[Automaton, int]]] = {}
        for a in self.automata:
            if a.starts is not None:
                for w in a.starts:
                    self.by_start.setdefault(w, []).append((a, 0))
            else:
                lead = next(i for i, s in enumerate(a.symbols) if s is not None)
                self.by_start.setdefault(a.symbols[lead], []).append((a, lead))
        self.keys = frozenset(self.by_start)
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.phrase_ends = frozenset(p[-1] for p, _ in self.phrases)

    def scan(self, text: str | None) -> dict:
        ws = words(text)
        have = set(ws)
        base: list[tuple[int, str]] = []
        if not self.phrase_ends.isdisjoint(have):
            for i, w in enumerate(ws):
                if w in self.phrase_ends:
                    for p, label in self.phrases:
                        first = i + 1 - len(p)
                        if first >= 0 and tuple(ws[first : i + 1]) == p:
                            base.append((first, label))
        spans, score = [], 0.0
        keys = self.keys & have
        if keys:
            for i, w in enumerate(ws):
                if w in keys:
                    for a, lead in self.by_start[w]:
                        for at in range(max(0, i - lead), i + 1):
                            n, share = a.run(ws, at)
                            score = max(score, share if not n else 0.0)
                            if n:
                                spans.append((a.label, at, n))
                                break
        grants = [at for la, at, _ in spans if la != "proprietary"] + [at for at, _ in base]
        spans = [s for s in spans if s[0] != "proprietary" or not any(abs(at - s[1]) <= REFUTED_BY_WORDS for at in grants)]
        base_labels = sorted({label for _, label in base})
        return {
            "n_words": len(ws),
            "n_base": len(base),
            "first_word": min((i for i, _ in base), default=None),
            "last_word": max((i for i, _ in base), default=None),
            "base_labels": base_labels,
            "labels": sorted({*base_labels, *(s[0] for s in spans)}),
            "score": 1.0 if spans else max(score, 0.5 if base else 0.0),
            "spans": [{"label": la, "first": at, "words": n} for la, at, n in spans],
        }


def scan(text: Column, templates=TEMPLATES, phrases=BASE_PHRASES) -> Column:
    """Struct of ``RESULT`` for each text: counts, labels, score and the accepted spans."""
    scanner = Scanner(templates, phrases)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scanner.scan(t) for t in texts], columns=_FIELDS).astype(_TYPES)

    return run(text)


_FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_TYPES = {"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"}


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fields of ``RESULT`` for every row of ``docs`` (doc_id, text; other columns are ignored)."""
    return docs.select("doc_id", scan(F.col("text")).alias("r")).select("doc_id", "r.*")
