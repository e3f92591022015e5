"""Licence scans: template markup compiled into token automata.

A template is wording in a small markup.  Plain words are mandatory and must
match exactly; ``[...]`` is an optional region; ``{2-12}`` is a replaceable
region of 2 to 12 words of any kind; ``(a|b)`` offers wordings.  Templates
compile into one nondeterministic automaton over words, and the automaton's
state sets are made deterministic as texts meet them.  A template accepts a
stretch of words if the automaton reads it from the stretch's first word to an
end state; of the stretches with one first word the longest counts.

Texts become vocabulary numbers with array operations (``words.WordTable``,
decided on the words' bytes), and only places whose first two words can open a
template are walked.  No walk is longer than the longest template, so a text of
any length takes some four bytes a word beside the text itself.

Nothing is shuffled and only the templates are shipped.

Defined cases: null and empty texts have no words and no match; rows that
repeat an id are scanned each; an empty table gives no row; overlapping
stretches of several templates all count; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import flat
from casepipe.llm.words import WordTable


class Template(NamedTuple):
    label: str
    markup: str
    base: bool = False


# --- fixed values: phrases of the contract and public licence wording ------
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "released under the [terms of the] (mit|expat) (license|licence)"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this {1-3} and associated documentation files "
        "[the {1-3}] to deal in the {1-3} without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the {1-3} and to permit persons to whom the {1-3} is furnished to do so subject to the "
        "following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all "
        "copies or substantial portions of the {1-3}",
    ),
    Template(
        "warranty-disclaimer",
        "(the|this) {1-4} is provided [by {1-10}] as is (without warranty of any kind|and any express or implied warranties)",
    ),
    Template(
        "isc-text",
        "permission to use copy modify and [or] distribute this software [and its documentation] for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "bsd-3-clause",
        "[3] neither the (name|names) of {1-15} nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
    ),
    Template("bsd", "(bsd|berkeley) [{1-1} clause] (license|licence)"),
    Template("apache-2.0", "apache (license|licence) [(version|v)] 2 [0]"),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use {1-4} except in compliance with the license you may "
        "obtain a copy of the license at {1-12} unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template("gpl-2.0", "gnu general public (license|licence) [as published by the free software foundation] (version|v) 2 [0]"),
    Template("gpl-3.0", "gnu general public (license|licence) [as published by the free software foundation] (version|v) 3 [0]"),
    Template("lgpl", "gnu (lesser|library) general public (license|licence)"),
    Template("agpl", "gnu affero general public (license|licence)"),
    Template(
        "gpl-notice",
        "is free software you can redistribute it and or modify it under the terms of the gnu [(lesser|affero|library)] general public "
        "license as published by the free software foundation [(either|only)] version {1-2} [of the license] [or at your option any later version]",
    ),
    Template("mpl-2.0", "mozilla public (license|licence) [(version|v)] 2 0"),
    Template("epl-2.0", "eclipse public (license|licence) [(version|v)] 2 0"),
    Template("cc-by-4.0", "(cc by|creative commons attribution) 4 0 [international]"),
    Template("cc-by-sa-4.0", "(cc by sa|creative commons attribution (sharealike|share alike)) 4 0 [international]"),
    Template("cc-by-nc-4.0", "(cc by nc|creative commons attribution (noncommercial|non commercial)) 4 0 [international]"),
    Template("cc-by-nc-sa-4.0", "(cc by nc sa|creative commons attribution (noncommercial|non commercial) (sharealike|share alike)) 4 0 [international]"),
    Template("cc0-1.0", "(cc0 1 0|creative commons zero v1 0) [universal]"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("spdx-tag", "spdx license identifier {1-1}"),
)
# ---------------------------------------------------------------------------

#: Deterministic states kept at once; beyond it the table starts afresh.
STATES = 50_000
_TOKEN = re.compile(r"\{(\d+)-(\d+)\}|[\[\]()|]|[^\s\[\](){}|]+")


class Region(NamedTuple):
    """A node of a parsed template: ``word``, ``any`` (``low`` to ``high``
    words), ``all`` (parts in a row), ``one`` (one of the parts)."""

    kind: str
    parts: tuple = ()
    word: str = ""
    low: int = 0
    high: int = 0


def parse(markup: str) -> Region:
    """The markup's regions; ``ValueError`` for unbalanced or empty ones."""
    tokens = [m.group(0) for m in _TOKEN.finditer(markup)]
    at = 0

    def sequence(closing: str) -> Region:
        nonlocal at
        options, row = [], []
        while True:
            t = tokens[at] if at < len(tokens) else ""
            at += 1
            if t == closing:
                options.append(Region("all", tuple(row)))
                return options[0] if len(options) == 1 else Region("one", tuple(options))
            if t == "|" and closing == ")":
                options.append(Region("all", tuple(row)))
                row = []
            elif t == "(":
                row.append(sequence(")"))
            elif t == "[":
                row.append(Region("one", (sequence("]"), Region("all"))))
            elif t.startswith("{"):
                low, high = map(int, t[1:-1].split("-"))
                row.append(Region("any", low=low, high=high))
            elif t in ("", "]", ")", "|"):
                raise ValueError(f"unbalanced template markup: {markup!r}")
            else:
                row.append(Region("word", word=t))

    return sequence("")


def mandatory_words(r: Region) -> int:
    """The fewest words of fixed wording in an accepted text."""
    if r.kind == "one":
        return min(map(mandatory_words, r.parts))
    return sum(map(mandatory_words, r.parts)) + (r.kind == "word")


def longest(r: Region) -> int:
    """The most words of an accepted text."""
    if r.kind == "one":
        return max(map(longest, r.parts))
    return sum(map(longest, r.parts)) + (r.kind == "word") + r.high


class TemplateAutomaton:
    """All templates as one automaton over word numbers (-1: any other word)."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES):
        self.templates = tuple(templates)
        self.regions = [parse(t.markup) for t in self.templates]
        self.words = WordTable(w.encode() for r in self.regions for w in _literals(r))
        self.on: list[dict[int, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]  # next states by any word
        self.skip: list[list[int]] = [[]]  # next states by no word
        self.ends: dict[int, int] = {}
        for k, r in enumerate(self.regions):
            if mandatory_words(r) == 0:
                raise ValueError(f"template without mandatory wording: {self.templates[k].markup!r}")
            self.ends[self._add(0, r)] = k
        self._afresh()
        if any(self.free[s] for s in self.sets[self.start]):
            raise ValueError("a template must not open with a replaceable region")
        self.pairs = self._openings()

    def _state(self) -> int:
        self.on.append({})
        self.free.append([])
        self.skip.append([])
        return len(self.on) - 1

    def _add(self, state: int, r: Region) -> int:
        """Add a region after ``state``; the state after it."""
        if r.kind == "word":
            new = self._state()
            self.on[state].setdefault(self.words.number[r.word.encode()], []).append(new)
            return new
        if r.kind == "all":
            for p in r.parts:
                state = self._add(state, p)
            if not r.parts:
                new = self._state()
                self.skip[state].append(new)
                return new
            return state
        end = self._state()
        if r.kind == "one":
            for p in r.parts:
                begin = self._state()
                self.skip[state].append(begin)
                self.skip[self._add(begin, p)].append(end)
            return end
        for n in range(r.high + 1):
            if n >= r.low:
                self.skip[state].append(end)
            if n < r.high:
                new = self._state()
                self.free[state].append(new)
                state = new
        return end

    def _afresh(self) -> None:
        self.numbers: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.next: list[dict[int, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.start = self._number([0])

    def _number(self, states: list[int]) -> int:
        """The deterministic state of these states and all that follow by no word."""
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        key = frozenset(seen)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.accepts.append(tuple(sorted(self.ends[s] for s in key if s in self.ends)))
        return self.numbers[key]

    def step(self, state: int, word: int) -> int:
        """The state after one more word; a state without members ends a walk."""
        to = self.next[state].get(word)
        if to is None:
            states = [n for s in self.sets[state] for n in (*self.on[s].get(word, ()), *self.free[s])]
            to = self.next[state][word] = self._number(states)
        return to

    def _openings(self) -> np.ndarray:
        """Whether two words (the last row and column: other words) can open a template."""
        n = len(self.words)
        pairs = np.zeros((n + 1, n + 1), bool)
        for w in {w for s in self.sets[self.start] for w in self.on[s]}:
            then = self.step(self.start, w)
            if self.accepts[then] or any(self.free[s] for s in self.sets[then]):
                pairs[w] = True
            for s in self.sets[then]:
                pairs[w, list(self.on[s])] = True
        return pairs

    def walk(self, words: np.ndarray) -> dict[int, int]:
        """``{template: words of its longest stretch}`` from the first of ``words``."""
        if len(self.sets) > STATES:
            self._afresh()
        state, found = self.start, {}
        for n, w in enumerate(words.tolist(), 1):
            state = self.step(state, w)
            if not self.sets[state]:
                break
            for k in self.accepts[state]:
                found[k] = n
        return found

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, dict[int, int]]]:
        """``(text, first word, {template: words})`` of texts whose words start at ``first``."""
        if not len(words):
            return
        reach = max(map(longest, self.regions))
        after = np.append(words[1:], -1)
        after[first[1:][first[1:] > 0] - 1] = -1  # a text's last word has none after it
        for i in np.flatnonzero(self.pairs[words, after]).tolist():
            text = int(np.searchsorted(first, i, "right")) - 1
            found = self.walk(words[i : min(i + reach, int(first[text + 1]))])
            if found:
                yield text, i - int(first[text]), found


def _literals(r: Region) -> Iterator[str]:
    if r.kind == "word":
        yield r.word
    for p in r.parts:
        yield from _literals(p)


MATCHES = "array<struct<label:string,base:boolean,template:int,mandatory:int,first_word:bigint,n_words:bigint>>"


def scan_licences(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``(doc_id, n_words, matches)`` of every row; ``matches`` holds each
    accepted stretch in order of its first word."""
    templates = tuple(templates)
    TemplateAutomaton(templates)  # reports faulty markup before any task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = TemplateAutomaton(templates)
        about = [{"label": t.label, "base": t.base, "template": k, "mandatory": mandatory_words(auto.regions[k])} for k, t in enumerate(templates)]
        kind = pa.list_(
            pa.struct([("label", pa.string()), ("base", pa.bool_()), ("template", pa.int32()), ("mandatory", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())])
        )
        for b in batches:
            words, first = auto.words.numbers(*flat(b.column(1)))
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for text, at, ends in auto.matches(words, first):
                found[text] += [about[k] | {"first_word": at, "n_words": n} for k, n in sorted(ends.items())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), pa.array(found, kind)], names=["doc_id", "n_words", "matches"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, matches {MATCHES}")


def certainty(matches: Column) -> Column:
    """0 without a match, else ``m / (m + 4)`` of the most mandatory words ``m`` of a template found."""
    m = F.array_max(F.transform(matches, lambda x: x["mandatory"])).cast("double")
    return F.coalesce(m / (m + 4.0), F.lit(0.0))
