"""License scans: short phrases, and license templates with optional and replaceable regions.

Template-markup matching. A template is a line of words with markup: `[ ... ]` may be absent (and may nest), `{n}` stands for up to
n words of any kind (a name, a year, a link), `a|b` is one word or the other. A template is compiled into an automaton over words:
states are places between its words, with jumps over optional regions. A text matches where the automaton accepts a run of
consecutive words, so its mandatory wording must be there exactly. All templates run as one set of states; a run can
only begin at the first word of a template, and only texts with a phrase or a template's rarest word are walked.

Base labels come from phrases: the places where the words of a phrase stand consecutively.

Scale: one narrow pass; the automata are fixed and small. A worker holds a few hundred texts at a time.

Nulls, empty and odd input: a null text is empty and has no words, no labels and score 0. A null id is kept; repeated rows give
repeated results; other columns are never read; an empty table gives no rows. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitefit.llm.base import map_texts

#: Base phrases (words) and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Templates: label, words with markup.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license"
                   " you may obtain a copy of the license at {8} [unless required by applicable law or agreed to in writing software distributed under the"
                   " license is distributed on an as is basis without warranties or conditions of any kind either express or implied]"),
    ("mit", "released|licensed|distributed|available under the [terms of the] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software]"
            " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or"
            " sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above"
            " copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2.0", "under the [terms of the] gnu general public license [gpl] [as published by the free software foundation] [either] [version] 2|v2"
                " [of the license] [or at your option any later version]"),
    ("gpl-3.0", "under the [terms of the] gnu general public license [gpl] [as published by the free software foundation] [either] [version] 3|v3"
                " [of the license] [or at your option any later version]"),
    ("lgpl", "gnu lesser|library general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "mozilla public license [version|v] 2 0"),
    ("cc-by-sa", "under [the] [a] [terms of the] cc by sa [license] [{1} 0]"),
    ("cc-by-nc", "under [the] [a] [terms of the] cc by nc [license] [{1} 0]"),
    ("cc-by-nd", "under [the] [a] [terms of the] cc by nd [license] [{1} 0]"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution [{1} 0] international|unported license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Upper-case ASCII to lower case, every other ASCII byte that isn't a letter or a digit to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """One template. `moves[state]`: what a word leads to; `free[state]`: the states reached without a word."""

    def __init__(self, label: str, template: str) -> None:
        self.label = label
        self.moves: list[tuple[frozenset, int] | None] = []
        self.free: list[list[int]] = []
        parts = template.replace("[", " [ ").replace("]", " ] ").split()
        state, opened = self._state(), []
        for part in parts:
            if part == "[":
                opened.append(state)
            elif part == "]":
                self.free[opened.pop()].append(state)
            elif part.startswith("{"):
                ends = [state]
                for _ in range(int(part[1:-1])):
                    ends.append(self._step(ends[-1], None))
                for end in ends[:-1]:
                    self.free[end].append(ends[-1])
                state = ends[-1]
            else:
                state = self._step(state, frozenset(word.encode() for word in part.split("|")))
        self.last = state
        self.begin = self.closed({0})
        self.first = frozenset(word for s in self.begin if self.moves[s] for word in (self.moves[s][0] or ()))

    def _state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def _step(self, state: int, words: frozenset | None) -> int:
        self.moves[state] = (words, self._state())
        return self.moves[state][1]

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)

    def end_from(self, words: list[bytes], start: int) -> int | None:
        """The place after the longest run of words from `start` that the template accepts."""
        states, found = self.begin, None
        for at in range(start, len(words)):
            moved = {m[1] for s in states if (m := self.moves[s]) and (m[0] is None or words[at] in m[0])}
            if not moved:
                break
            states = self.closed(moved)
            if self.last in states:
                found = at + 1
        return found


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and the matched places.

    `n_base` counts all places of all phrases, `first_word` and `last_word` are the smallest and largest of their starts.
    `labels` adds the templates' labels to the phrases'. `score` is 1 for a matched template, 0.5 for phrases alone, else 0.
    `starts`, `ends` and `matched` list each template match: words from, words up to (not included), label.
    """
    phrases = PHRASES if phrases is None else phrases

    def step():
        wanted = [(f" {' '.join(words.split())} ".encode(), label) for words, label in phrases.items()]
        automata = [Automaton(label, template) for label, template in templates]
        by_first: dict[bytes, list[Automaton]] = {}
        for automaton in automata:
            for word in automaton.first:
                by_first.setdefault(word, []).append(automaton)
        # every template has a word of four letters or more that it can't do without
        sure = {max((w for w in plain.split() if "|" not in w and "{" not in w), key=len).encode() for _, template in templates for plain in [_mandatory(template)]}

        def work(ids: list, texts: list) -> dict:
            out: dict = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "starts", "ends", "matched")}
            for doc_id, text in zip(ids, texts, strict=True):
                words = words_of(text)
                flat = b" " + b" ".join(words) + b" "
                places, base, matches = [], set(), []
                for phrase, label in wanted:
                    at, counted, before = flat.find(phrase), 0, 0
                    while at >= 0:
                        before, counted = before + flat.count(b" ", counted, at), at
                        places.append(before)
                        base.add(label)
                        at = flat.find(phrase, at + 1)
                if any(word in flat for word in sure):
                    for at, word in enumerate(words):
                        for automaton in by_first.get(word, ()):
                            if (end := automaton.end_from(words, at)) is not None:
                                matches.append((at, end, automaton.label))
                values = (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                          ",".join(sorted(base | {m[2] for m in matches})), 1.0 if matches else 0.5 if base else 0.0,
                          [m[0] for m in matches], [m[1] for m in matches], [m[2] for m in matches])
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            return out

        return work

    return map_texts(docs, step, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
                                 " starts array<long>, ends array<long>, matched array<string>")


def _mandatory(template: str) -> str:
    """A template without its optional regions."""
    depth, kept = 0, []
    for part in template.replace("[", " [ ").replace("]", " ] ").split():
        depth += (part == "[") - (part == "]")
        if depth == 0 and part not in "[]":
            kept.append(part)
    return " ".join(kept)
