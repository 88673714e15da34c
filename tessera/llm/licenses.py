"""Operator 2, license scans: template-markup matching.

Templates are license wordings with markup: ``[...]`` is an optional region, ``{a..b}``
a replaceable region of a to b words, everything else is mandatory and must match word
by word.  All templates and the base phrases are compiled into one token automaton
without empty moves; a text is accepted by a template if a run of its words leads to the
template's end, that is, if the mandatory wording matches exactly.

Cases: null and empty texts have no words and no labels; repeated rows give repeated
results; an empty table gives none; other columns are ignored; texts of any length are
scanned whole.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from tessera.llm.common import map_lists
from tessera.llm.words import WORD

# Base phrases and their labels
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

# Wordings of widespread license notices and texts
TEMPLATES = {
    "apache-notice": "licensed under the apache license [version {1..2}]",
    "apache-header": "you may not use this {1..2} except in compliance with the license [you may obtain a copy of the license at {0..8}] unless required by applicable law or agreed to in writing [software]",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-notice": "licensed under [a] [the] [creative commons] [attribution] cc by [{0..2}] 4 0",
    "gpl-notice": "[this {1..2} is] licensed under the gnu general public license [version {1..1}]",
    "gpl-free-software": "free software you can redistribute it and or modify it under the terms of the gnu [lesser] [affero] general public license as published by the free software foundation",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this {1..2} and associated documentation files [the software] to deal in the software without restriction",
}

_MARKUP = re.compile(r"\[|\]|\{(\d+)\.\.(\d+)\}|[^\s\[\]{}]+")
_ANY = None


class TokenAutomaton:
    """Templates compiled into states with word moves and any-word moves."""

    def __init__(self, templates: dict[str, str]):
        self.moves: list[dict[bytes | None, set[int]]] = []
        self.empty: list[set[int]] = []
        self.accepts: dict[int, str] = {}
        self.start = self._state()
        for label, markup in templates.items():
            self.accepts[self._compile(markup)] = label
        self._close()

    def _state(self) -> int:
        self.moves.append(defaultdict(set))
        self.empty.append(set())
        return len(self.moves) - 1

    def _compile(self, markup: str) -> int:
        at, opened = self._state(), []
        self.empty[self.start].add(at)
        for m in _MARKUP.finditer(markup):
            if m[0] == "[":
                opened.append(at)
            elif m[0] == "]":
                end = self._state()
                self.empty[opened.pop()].add(end)
                self.empty[at].add(end)
                at = end
            elif m[1]:
                least, most, ends = int(m[1]), int(m[2]), []
                for k in range(most):
                    if k >= least:
                        ends.append(at)
                    new = self._state()
                    self.moves[at][_ANY].add(new)
                    at = new
                for s in ends:
                    self.empty[s].add(at)
            else:
                new = self._state()
                self.moves[at][m[0].encode()].add(new)
                at = new
        return at

    def _reach(self, s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.empty[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    def _close(self) -> None:
        """Empty moves go: each state takes over the moves and labels it reaches."""
        reach = [self._reach(s) for s in range(len(self.moves))]
        self.labels = [frozenset(self.accepts[t] for t in r if t in self.accepts) for r in reach]
        self.step: list[dict[bytes | None, frozenset[int]]] = []
        for r in reach:
            joined = defaultdict(set)
            for t in r:
                for w, to in self.moves[t].items():
                    joined[w] |= to
            self.step.append({w: frozenset(to) for w, to in joined.items()})
        self.first = frozenset(self.step[self.start])

    def matches(self, words: list[bytes]) -> set[tuple[str, int]]:
        """All (label, start word) of accepted runs."""
        found, active = set(), {}  # state -> starts
        for i, w in enumerate(words):
            if w in self.first:
                active.setdefault(self.start, set()).add(i)
            elif not active:
                continue
            following: dict[int, set[int]] = {}
            for s, starts in active.items():
                step = self.step[s]
                for t in (*step.get(w, ()), *step.get(_ANY, ())):
                    following.setdefault(t, set()).update(starts)
            for s, starts in following.items():
                for label in self.labels[s]:
                    found.update((label, b) for b in starts)
            active = following
        return found


@functools.cache
def _automaton(base: tuple, templates: tuple) -> tuple[TokenAutomaton, re.Pattern]:
    both = {f"base:{k}": v for k, v in base} | dict(templates)
    # every template has a mandatory word of five letters or more, or the pair "cc by"
    needed = set()
    for markup in both.values():
        plain = re.sub(r"\[[^\]]*\]|\{[^}]*\}", " ", markup).split()
        needed.add(max(plain, key=len))
    return TokenAutomaton(both), re.compile(b"|".join(re.escape(w.encode()) for w in sorted(needed)))


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.  The score is
    0 without a match, 0.5 if only base phrases occur, 1 if a template accepts the text."""
    base, templates = tuple(base.items()), tuple(templates.items())

    def make():
        automaton, needed = _automaton(base, templates)

        def scan(text: str | None) -> tuple:
            low = (text or "").encode().lower()
            words = WORD.findall(low)
            found = automaton.matches(words) if needed.search(low) else ()
            places = sorted((at, label[5:]) for label, at in found if label.startswith("base:"))
            full = sorted({label for label, _ in found if not label.startswith("base:")})
            plain = sorted({label for _, label in places})
            return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(plain), ",".join(sorted({*plain, *full})), 1.0 if full else 0.5 if plain else 0.0)

        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

        def step(cols):
            rows = [scan(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}
        return step

    return map_lists(docs.select("doc_id", "text"), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)
