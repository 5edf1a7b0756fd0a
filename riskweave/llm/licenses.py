"""License scans by template-markup matching.

A template is a licence's wording with markup for the regions that may differ: `<<beginOptional>> ... <<endOptional>>` may be left
out, `<<var;name="x";original="y";words="0-9">>` stands for so many words of any kind, and `<<var;name="x";original="y";match="a b|c">>`
for one of the given wordings. All other words are mandatory. A template compiles into an automaton over words, all templates share one
machine whose states are made deterministic as texts need them, and a run is accepted if every mandatory word is there in order.
Base phrases are templates without markup.

Words are compared after lower-casing A-Z; a word is a run of characters other than the ASCII ones that are no letter or digit.

Runs start only at words that can open a template and end as soon as no template fits. Matches of one template do not overlap each
other, base phrases are reported at every place; the longest reading from a start counts.

Defined cases: a null or empty text has no words and no matches and score 0; very long texts are scanned whole, in a block of their own;
of readings of one template from one start the longest counts, and labels that tie stand side by side; repeated rows are scanned one by one;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.pretokens import blocks

_BLOCK = 8 << 20

#: Base phrases and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = '<<var;name="act";original="Licensed";match="licensed|released|distributed|available|published|provided">> under '
_THE = "<<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> "
_GNU = _GRANT + "<<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> "
_LATER = " <<beginOptional>>or <<beginOptional>>(at your option)<<endOptional>> any later version<<endOptional>>"
_CC = _GRANT + "<<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
_AS_IS = (
    'the software is provided "as is" <<beginOptional>>without warranty of any kind express or implied including but not limited to '
    "the warranties of merchantability fitness for a particular purpose and noninfringement<<endOptional>>"
)

_FREE = "free software; you can redistribute it and/or modify it under the terms of the GNU "
_FSF = " as published by the Free Software Foundation<<beginOptional>>; <<beginOptional>>either<<endOptional>> version "
_OF = " of the License<<beginOptional>>, or (at your option) any later version<<endOptional>><<endOptional>>"


def _version(n: str) -> str:
    """A number after `version`, `v.` or `v`, or by itself."""
    spaced = n.replace(".", " ")
    return f'<<var;name="version";original="{n}";match="{spaced}|v {spaced}|v{spaced}|version {spaced}">>'



#: Wordings of public licences, of their titles and of the notices that name them, by label. Fixed values.
TEMPLATES = {
    "mit": [
        _GRANT + _THE + '<<var;name="name";original="MIT";match="mit|expat">> License',
        "MIT License <<beginOptional>>(MIT)<<endOptional>> Copyright",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the <<var;name="what";original="Software";words="1-3">>), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or "
        "substantial portions of the Software. <<beginOptional>>" + _AS_IS + "<<endOptional>>",
    ],
    "isc": [
        _GRANT + _THE + "ISC License",
        "ISC License Copyright",
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, '
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "bsd": [
        _GRANT + _THE + '<<var;name="clauses";original="3-Clause";match="2 clause|3 clause|simplified|revised|new|modified">> BSD License',
        _GRANT + _THE + 'BSD <<var;name="clauses";original="3-Clause";match="2 clause|3 clause">> License',
        'BSD <<var;name="clauses";original="3-Clause";match="2 clause|3 clause">> License Copyright',
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        'conditions are met: <<var;name="bullet";original="1";words="0-2">> Redistributions of source code must retain the above copyright notice, this list of '
        'conditions and the following disclaimer. <<var;name="bullet";original="2";words="0-2">> Redistributions in binary form must reproduce the above copyright notice, '
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. <<beginOptional>><<var;name="bullet";original="3";words="0-2">> Neither the name of <<var;name="holder";original="the copyright holder";words="1-12">> nor the names of its '
        "contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.<<endOptional>>",
    ],
    "apache-2.0": [
        _GRANT + "<<beginOptional>>the<<endOptional>> Apache <<beginOptional>>Software<<endOptional>> License, <<beginOptional>>Version<<endOptional>> 2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "gpl-2.0": [
        _GNU + "General Public License, <<beginOptional>>either<<endOptional>> version 2<<beginOptional>>.0<<endOptional>>" + _LATER,
        _FREE + "General Public License as published by the Free Software Foundation; <<beginOptional>>either<<endOptional>> version 2 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>",
        "GNU General Public License Version 2, June 1991",
    ],
    "gpl-3.0": [
        _GNU + "General Public License, <<beginOptional>>either<<endOptional>> version 3<<beginOptional>>.0<<endOptional>>" + _LATER,
        _FREE + "General Public License as published by the Free Software Foundation; <<beginOptional>>either<<endOptional>> version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>",
        "GNU General Public License Version 3, 29 June 2007",
    ],
    "lgpl": [
        _GNU + '<<var;name="kind";original="Lesser";match="lesser|library">> General Public License '
        '<<beginOptional>>version <<var;name="version";original="2.1";match="2|2 0|2 1|3|3 0">><<endOptional>>' + _LATER,
        _FREE + '<<var;name="kind";original="Lesser";match="lesser|library">> General Public License' + _FSF + '<<var;name="version";original="2.1";match="2|2 1|3">>' + _OF,
        "GNU Lesser General Public License Version 2.1, February 1999",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "GNU Library General Public License Version 2, June 1991",
    ],
    "agpl": [
        _GNU + "Affero General Public License <<beginOptional>>version 3<<beginOptional>>.0<<endOptional>><<endOptional>>" + _LATER,
        _FREE + "Affero General Public License" + _FSF + "3" + _OF,
        "GNU Affero General Public License Version 3, 19 November 2007",
    ],
    "mpl-2.0": [
        _GRANT + _THE + "Mozilla Public License, " + _version("2.0"),
        "Subject to the terms of the Mozilla Public License, " + _version("2.0"),
        "Mozilla Public License Version 2.0",
    ],
    "epl-1.0": [_GRANT + _THE + "Eclipse Public License " + _version("1.0"), "available under the terms of the Eclipse Public License " + _version("1.0"), "Eclipse Public License - v 1.0"],
    "epl-2.0": [_GRANT + _THE + "Eclipse Public License " + _version("2.0"), "available under the terms of the Eclipse Public License " + _version("2.0"), "Eclipse Public License - v 2.0"],
    "bsl-1.0": [
        _GRANT + _THE + "Boost Software License, <<beginOptional>>Version<<endOptional>> 1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ],
    "artistic-2.0": [_GRANT + _THE + "Artistic License " + _version("2.0"), "The Artistic License 2.0 Copyright"],
    "wtfpl": [_GRANT + _THE + "WTFPL", "Do what the fuck you want to public license"],
    "zlib": [
        _GRANT + _THE + "zlib License",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ],
    "unlicense": [
        _GRANT + _THE + "Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ],
    "cc0": [
        _CC + "<<beginOptional>>Creative Commons<<endOptional>> CC0 <<beginOptional>>1.0<<endOptional>> <<beginOptional>>Universal<<endOptional>>",
        "CC0 1.0 Universal",
    ],
    **{
        "-".join(("cc-by", *kinds)): [
            _CC + " ".join(("CC BY", *kinds)) + ' <<var;name="version";original="4.0";match="1 0|2 0|2 5|3 0|4 0">>',
            _CC + "Creative Commons Attribution " + " ".join(named) + ' <<var;name="version";original="4.0";match="1 0|2 0|2 5|3 0|4 0">>',
        ]
        for kinds, named in (
            ((), ()),
            (("nc",), ("NonCommercial",)),
            (("sa",), ("ShareAlike",)),
            (("nd",), ("NoDerivatives",)),
            (("nc", "sa"), ("NonCommercial", "ShareAlike")),
            (("nc", "nd"), ("NonCommercial", "NoDerivatives")),
        )
    },
}
#: Short identifiers of licences, by label. Fixed values.
IDENTIFIERS = {
    "mit": ["MIT"],
    "isc": ["ISC"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "apache-2.0": ["Apache-2.0"],
    "gpl-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "gpl-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "mpl-2.0": ["MPL-2.0"],
    "epl-1.0": ["EPL-1.0"],
    "epl-2.0": ["EPL-2.0"],
    "bsl-1.0": ["BSL-1.0"],
    "artistic-2.0": ["Artistic-2.0"],
    "wtfpl": ["WTFPL"],
    "zlib": ["Zlib"],
    "unlicense": ["Unlicense"],
    "cc0": ["CC0-1.0"],
    "cc-by": ["CC-BY-4.0", "CC-BY-3.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-nd": ["CC-BY-ND-4.0"],
    "cc-by-nc-sa": ["CC-BY-NC-SA-4.0"],
    "cc-by-nc-nd": ["CC-BY-NC-ND-4.0"],
}


def templates() -> dict[str, list[str]]:
    """TEMPLATES, and a line that names each identifier."""
    return {label: [*wordings, *(f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(label, ()))] for label, wordings in TEMPLATES.items()}


_MARK = re.compile(r"<<(.*?)>>", re.S)
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWERED))


class Automaton:
    """One machine for all templates: an automaton with empty moves, made deterministic state by state as words come in."""

    def __init__(self, templates: list[tuple[str, bool, str]]):
        """templates: (label, whether it is a base phrase, wording with markup)."""
        self.moves: list[dict[bytes, list[int]]] = []  # by word
        self.any: list[list[int]] = []  # by whatever word
        self.empty: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.kinds = sorted({(label, base) for label, base, _ in templates})
        start = self._state()
        for label, base, wording in templates:
            begin = self._state()
            self.empty[start].append(begin)
            end = self._compile(wording, begin)
            if end in self._closure({begin}):
                raise ValueError(f"template {label} has no mandatory words")
            self.accepts[end] = self.kinds.index((label, base))
        self.vocabulary = {w for m in self.moves for w in m}
        self.start = self._closure({start})
        if any(self.any[s] for s in self.start):
            raise ValueError("a template must begin with a known word")
        self.openers = {w for s in self.start for w in self.moves[s]}
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.table: list[dict[bytes | None, int]] = []
        self.ends: list[tuple[int, ...]] = []
        self.begin = self._numbered(self.start)

    def _state(self) -> int:
        self.moves.append({})
        self.any.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _chain(self, words: list[bytes], at: int) -> int:
        for w in words:
            new = self._state()
            self.moves[at].setdefault(w, []).append(new)
            at = new
        return at

    def _compile(self, wording: str, at: int) -> int:
        """Adds the wording from state `at` on; the state where it ends."""
        opened, done = [], 0
        for m in [*_MARK.finditer(wording), None]:
            at = self._chain(words_of(wording[done : m.start() if m else len(wording)]), at)
            if m is None:
                break
            done, mark = m.end(), m[1]
            if mark == "beginOptional":
                opened.append(at)
                at, before = self._state(), at
                self.empty[before].append(at)
            elif mark == "endOptional":
                new = self._state()
                self.empty[at].append(new)
                self.empty[opened.pop()].append(new)
                at = new
            elif mark.startswith("var;"):
                fields = dict(re.findall(r'(\w+)="([^"]*)"', mark))
                new = self._state()
                if "words" in fields:
                    low, high = map(int, fields["words"].split("-"))
                    for k in range(high + 1):
                        if k >= low:
                            self.empty[at].append(new)
                        if k < high:
                            step = self._state()
                            self.any[at].append(step)
                            at = step
                else:
                    for one in fields["match"].split("|"):
                        self.empty[self._chain(words_of(one), at)].append(new)
                at = new
            else:
                raise ValueError(f"unknown markup <<{mark}>>")
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, found = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _numbered(self, states: frozenset) -> int:
        k = self.number.get(states)
        if k is None:
            k = self.number[states] = len(self.states)
            self.states.append(states)
            self.table.append({})
            self.ends.append(tuple(sorted({self.accepts[s] for s in states if s in self.accepts})))
        return k

    def step(self, state: int, word: bytes) -> int:
        """The next state; -1 if no template goes on."""
        key = word if word in self.vocabulary else None
        table = self.table[state]
        to = table.get(key)
        if to is None:
            found: set[int] = set()
            for s in self.states[state]:
                found.update(self.moves[s].get(word, ()), self.any[s])
            to = table[key] = self._numbered(self._closure(found)) if found else -1
        return to

    def longest(self, word, at: int, stop: int) -> dict[int, int]:
        """One past the last word of the longest reading from word number `at` on, by kind. word: gives a word by its number."""
        found, state, i = {}, self.begin, at
        while i < stop:
            state = self.step(state, word(i))
            if state < 0:
                break
            i += 1
            for kind in self.ends[state]:
                found[kind] = i
        return found


@lru_cache(maxsize=4)
def compiled(phrases: tuple, templates: tuple) -> Automaton:
    return Automaton([(label, True, p) for p, label in phrases] + [(label, False, t) for label, t in templates])


def _keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Numbers for words of bytes from their first five bytes and their lengths; data ends with five more bytes."""
    sizes = stops - starts
    key = np.minimum(sizes, 0xFFFFFF) << 40
    for j in range(5):
        key |= np.where(sizes > j, data[starts + j].astype(np.int64) << 8 * j, 0)
    return key


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """id, n_words, matches and covered of every row: matches holds label, base, first and last (words from 0), by place; covered counts
    the words that some match takes in."""
    own = (tuple((PHRASES if phrases is None else phrases).items()), tuple((k, t) for k, v in (templates() if wordings is None else wordings).items() for t in v))
    compiled(*own)  # bad markup fails here

    def run(batches):
        import pyarrow as pa

        machine = compiled(*own)
        openers = sorted(machine.openers)
        opening = np.frombuffer(b"".join(openers) + bytes(8), np.uint8)
        to = np.cumsum([len(w) for w in openers])
        wanted = np.unique(_keys(opening, np.append(0, to[:-1]), to))
        is_word = np.zeros(256, bool)
        is_word[[b for b in range(256) if _WORD.match(bytes([b]))]] = True
        for part, texts in blocks(batches, 1, _BLOCK):
            raw = [t.encode().translate(_LOWERED) for t in texts.to_pylist()]
            data = b"\n".join(raw) + b"\n" + bytes(8)  # a text ends with a sign that is no word
            points = np.frombuffer(data, np.uint8)
            inside = np.empty(len(points) + 1, bool)
            inside[0] = False
            np.take(is_word, points, out=inside[1:])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, stops = edges[::2], edges[1::2]
            at = np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))
            places = np.searchsorted(starts, at)
            keys = _keys(points, starts, stops)
            near = np.searchsorted(wanted, keys)
            near[near == len(wanted)] = 0
            candidates = np.flatnonzero(wanted[near] == keys)
            word = lambda i: data[starts[i] : stops[i]]
            rows: list[list] = [[] for _ in raw]
            covered = np.zeros(len(raw), np.int64)
            free: dict[int, int] = {}
            doc_of, reached, last_doc = np.searchsorted(places, candidates, side="right") - 1, 0, -1
            for i, d in zip(candidates.tolist(), doc_of.tolist(), strict=True):
                first = int(places[d])
                if d != last_doc:
                    free.clear()
                    last_doc, reached = d, first
                for kind, end in machine.longest(word, i, int(places[d + 1])).items():
                    label, base = machine.kinds[kind]
                    if not base and free.get(kind, 0) > i:
                        continue
                    free[kind] = end
                    rows[d].append({"label": label, "base": base, "first": i - first, "last": end - 1 - first})
                    covered[d] += max(0, end - max(reached, i))
                    reached = max(reached, end)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(places)), pa.array(rows, pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())]))), pa.array(covered)],
                names=["id", "n_words", "matches", "covered"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, matches array<struct<label:string,base:boolean,first:long,last:long>>, covered long")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels from scan's rows. score is the share of a text's words that matches take in."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first"])
    joined = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        (F.col("covered") / F.greatest("n_words", F.lit(1))).alias("score"),
    )
