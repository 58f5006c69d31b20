"""License scans by template markup.

A template is a license's or notice's wording in words, with markup for what may differ:
    ((...))     an optional region
    [[a|b|c]]   one of several wordings (a replaceable region with known fillings)
    <<n>>       a replaceable region of at most n arbitrary words, such as names and years
A template is compiled into an automaton over words; it accepts a run of words if the mandatory wording stands there
exactly, with any filling of the rest. Every template has wording that needs one of a few rare words, so texts without
these are passed over after one set test.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_column, map_batches, words

#: The base phrases and their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Fixed values: (label, weight, template); weight 1 for a license's whole text, less for a part of it or a notice that
#: names one. Apache, GNU, Mozilla and Creative Commons licenses are known by their notices; whole texts may be given.
TEMPLATES = [
    ("mit", 0.8, "((this [[work|software|text|document|code|project|file]] is)) [[released|licensed|distributed|published|available|made available]] under the ((terms of the)) mit [[license|licence]]"),
    ("mit", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice ((including the next paragraph)) shall be included in all copies or substantial portions of the software"),
    ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice ((including the next paragraph)) shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the [[authors or copyright holders|copyright holders or authors|authors|copyright holders]] be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", 0.8, "((this [[work|software|text|document|code|project|file]] is)) [[released|licensed|distributed|published|available|made available]] under the ((terms of the)) apache [[license|licence]] ((version)) [[2|2 0]]"),
    ("apache-2", 1.0, "licensed under the apache license version 2 0 the license you may not use this <<3>> except in compliance with the license you may obtain a copy of the license at <<8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc-by-nc", 0.8, "((this [[work|text|document|article|page|file]] is)) [[released|licensed|distributed|published|available|made available]] under ((a|the)) ((creative commons)) cc by nc ((4 0|3 0|2 0))"),
    ("cc-by-nc", 0.9, "[[released|licensed|distributed|published|available|made available]] under [[a|the]] creative commons attribution [[noncommercial|non commercial]] ((4 0|3 0|2 0)) ((international)) [[license|licence]]"),
    ("cc-by", 0.8, "[[released|licensed|distributed|published|available|made available]] under [[a|the]] creative commons attribution ((4 0|3 0|2 0)) ((international)) [[license|licence]]"),
    ("cc-by-sa", 0.8, "[[released|licensed|distributed|published|available|made available]] under ((a|the)) ((creative commons)) cc by sa ((4 0|3 0|2 0))"),
    ("cc0", 0.8, "[[released|dedicated|published|available|made available]] [[under|to the public domain under]] ((the|creative commons)) cc0"),
    ("gpl-3", 0.8, "((this [[work|software|text|document|code|project|file]] is)) [[released|licensed|distributed|published|available|made available]] under the ((terms of the)) gnu general public [[license|licence]] ((as published by the free software foundation either)) version 3"),
    ("gpl-2", 0.8, "((this [[work|software|text|document|code|project|file]] is)) [[released|licensed|distributed|published|available|made available]] under the ((terms of the)) gnu general public [[license|licence]] ((as published by the free software foundation either)) version 2"),
    ("lgpl", 0.8, "[[released|licensed|distributed|published|available|made available]] under the ((terms of the)) gnu lesser general public [[license|licence]]"),
    ("agpl-3", 0.8, "[[released|licensed|distributed|published|available|made available]] under the ((terms of the)) gnu affero general public [[license|licence]]"),
    ("mpl-2", 0.8, "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", 0.8, "[[released|licensed|distributed|published|available|made available]] under the ((terms of the)) ((2 clause|3 clause|new|simplified|modified)) bsd ((2 clause|3 clause)) [[license|licence]]"),
    ("bsd", 0.9, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ((1)) redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer ((2)) redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", 1.0, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ((1)) redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer ((2)) redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution ((3)) ((neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission)) this software is provided by the copyright [[holders|holder]] and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright [[holder|holders|owner]] or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", 0.9, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and [[the author disclaims|<<6>> disclaims]] all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall [[the author|<<6>>]] be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("proprietary", 0.6, "copyright ((c)) <<6>> all rights reserved"),
]

#: Each template and phrase needs at least one of these words.
RARE = {"mit", "apache", "cc", "cc0", "creative", "gnu", "mozilla", "bsd", "permission", "redistribution", "copyright"}

_TOKEN = re.compile(r"\(\(|\)\)|\[\[|\]\]|\||<<\d+>>|[^\s|()\[\]<>]+")
_ANY = None


class TemplateAutomaton:
    """A nondeterministic automaton over words, run as sets of states that are remembered once met."""

    def __init__(self, template: str) -> None:
        self.edges: list[list[tuple[str | None, int]]] = []
        self.free: list[list[int]] = []
        tokens = _TOKEN.findall(template)
        start = self._state()
        end, at = self._alternatives(tokens, 0, start, ())
        if at != len(tokens):
            raise ValueError(f"unbalanced markup in {template!r}")
        self.final = end
        self.start = self._closed({start})
        self.known: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        self.alphabet = {w for e in self.edges for w, _ in e if w is not _ANY}
        first = {w for s in self.start for w, _ in self.edges[s]}
        if _ANY in first or self.final in self.start:
            raise ValueError(f"{template!r} must begin with mandatory or optional wording")
        self.first = first

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _alternatives(self, tokens: list[str], at: int, start: int, closing: tuple[str, ...]) -> tuple[int, int]:
        """Wordings divided by | up to a closing mark; returns the state after them and the place of that mark."""
        end, here = self._state(), start
        while at < len(tokens) and tokens[at] not in closing:
            t = tokens[at]
            if t == "|":
                self.free[here].append(end)
                here = start
            elif t in ("((", "[["):
                close = "))" if t == "((" else "]]"
                after, at = self._alternatives(tokens, at + 1, here, ("))", "]]"))
                if at >= len(tokens) or tokens[at] != close:
                    raise ValueError("a region is not closed by its own mark")
                if t == "((":
                    self.free[here].append(after)
                here = after
            elif t.startswith("<<"):
                stop = self._state()
                for _ in range(int(t[2:-2])):
                    self.free[here].append(stop)
                    step = self._state()
                    self.edges[here].append((_ANY, step))
                    here = step
                self.free[here].append(stop)
                here = stop
            else:
                step = self._state()
                self.edges[here].append((t.encode(), step))
                here = step
            at += 1
        self.free[here].append(end)
        return end, at

    def _closed(self, states: set[int]) -> frozenset[int]:
        stack, out = list(states), set(states)
        while stack:
            for s in self.free[stack.pop()]:
                if s not in out:
                    out.add(s)
                    stack.append(s)
        return frozenset(out)

    def _step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.alphabet else b"")
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._closed({to for s in states for w, to in self.edges[s] if w is _ANY or w == word})
        return found

    def accepts(self, tokens: list[bytes], at: int) -> int:
        """Where the longest accepted run of words from `at` ends; 0 if none does."""
        states, end = self.start, 0
        while at < len(tokens) and (states := self._step(states, tokens[at])):
            at += 1
            if self.final in states:
                end = at
        return end


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, float, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> None:
        self.phrases = [(p.encode().split(), label) for p, label in (BASE_PHRASES if phrases is None else phrases)]
        self.templates = [(label, weight, TemplateAutomaton(t)) for label, weight, t in (TEMPLATES if templates is None else templates)]
        self.starts: dict[bytes, list[int]] = {}
        for k, (_, _, a) in enumerate(self.templates):
            for w in a.first:
                self.starts.setdefault(w, []).append(k)
        self.rare = {w.encode() for w in RARE}
        own = {w for p, _ in self.phrases for w in p} | {w for _, _, a in self.templates for w in a.alphabet}
        if templates is not None or phrases is not None:  # other wording: any of its words may be the rare one
            self.rare = own

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """(start, label) of every base phrase; (start, end, label, weight) of every accepted template."""
        if self.rare.isdisjoint(tokens):
            return [], []
        base, accepted = [], []
        for phrase, label in self.phrases:
            at, n = -1, len(phrase)
            try:
                while True:
                    at = tokens.index(phrase[0], at + 1)
                    if tokens[at : at + n] == phrase:
                        base.append((at, label))
            except ValueError:
                pass
        for at, word in enumerate(tokens):
            for k in self.starts.get(word, ()):
                label, weight, automaton = self.templates[k]
                if end := automaton.accepts(tokens, at):
                    accepted.append((at, end, label, weight))
        return sorted(base), accepted


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, float, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, accepted.

    Null and empty texts have no words, places or labels; repeated rows are answered each; other columns are ignored.
    score: the largest weight of an accepted template, 0.5 for base phrases alone, else 0. accepted: the places that
    templates accept, as structs of start and end word, label and weight.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))

    def make():
        scanner = LicenseScanner(templates, phrases)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "accepted")}
            for text in binary_column(batch, "text"):
                tokens = words(text)
                base, accepted = scanner.scan(tokens)
                labels = {label for _, label in base}
                row = (
                    len(tokens),
                    len(base),
                    base[0][0] if base else None,
                    base[-1][0] if base else None,
                    ",".join(sorted(labels)),
                    ",".join(sorted(labels | {label for _, _, label, _ in accepted})),
                    max([0.5 * bool(base), *(weight for *_, weight in accepted)]),
                    [dict(zip(("start", "end", "label", "weight"), a, strict=True)) for a in accepted],
                )
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = dict.fromkeys(out, pa.int64()) | {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "accepted": kind}
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

        return each

    return map_batches(
        docs.select("doc_id", "text"),
        make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, accepted array<struct<start:long,end:long,label:string,weight:double>>",
    )
