"""License notices by template markup, matched word by word.

A template is license wording with two kinds of markup: ``<<opt>> ... <</opt>>`` may be
absent, ``<<var max=N>>`` stands for up to N words of any kind. Everything else is
mandatory and must match word by word after normalisation. Templates are compiled into one
automaton over words; a run begins at any word that can start a template and follows all
ways at once, and every place at which a run accepts is a match. Short phrases are templates
without markup, so phrases and notices come from the same automaton.

Work grows with the words of the text and, at candidate starts alone, with the length of the
templates, so whole texts of any length are scanned in one pass.

Defined results: a null or empty text has 0 words, no labels (empty strings), null
first and last word and score 0; a repeated row repeats its result; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import ALNUM_WORD, empty_if_null, lowered_bytes

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wording of public license notices, with markup, and their labels.
NOTICES = {
    "licensed under the apache license <<opt>>version 2 0<</opt>> <<opt>>the license<</opt>> "
    "<<opt>>you may not use this file except in compliance with the license<</opt>>":
        "apache-notice",
    "licensed under <<var max=4>> apache license version 2 0": "apache-2.0-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "<<var max=3>> and associated documentation files <<opt>>the software<</opt>> to deal in "
    "<<var max=3>> without restriction": "mit-notice",
    "released under the mit license": "mit-notice",
    "program is free software you can redistribute it and or modify it under the "
    "terms of the gnu general public license as published by the free software foundation "
    "<<opt>>either<</opt>> <<opt>>version<</opt>>": "gpl-notice",
    "under the terms of the gnu general public license <<opt>>version<</opt>> "
    "<<opt>>v2<</opt>> <<opt>>v3<</opt>>": "gpl-notice",
    "licensed under <<opt>>a creative commons<</opt>> <<opt>>the<</opt>> cc by <<opt>>sa<</opt>> "
    "<<opt>>4 0<</opt>>": "cc-by-notice",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd-notice",
}
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var max=(\d+)>>|[^\s<>]+")


@dataclass
class _State:
    """``step`` by word, ``any_word`` by any word, ``free`` without a word."""

    step: dict[bytes, list[int]] = field(default_factory=dict)
    any_word: list[int] = field(default_factory=list)
    free: list[int] = field(default_factory=list)
    accepts: str | None = None


class TokenAutomaton:
    """All templates in one automaton; ``run`` gives matches as (start, end, label)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.states = [_State()]
        for template, label in templates.items():
            self._add(template, label)
        self.starts = self._close({0})
        self.first = {w for s in self.starts for w in self.states[s].step}

    def _new(self) -> int:
        self.states.append(_State())
        return len(self.states) - 1

    def _add(self, template: str, label: str) -> None:
        at = self._new()
        self.states[0].free.append(at)
        opened: list[int] = []
        for mark in _MARK.finditer(template):
            text, after = mark.group(), self._new()
            if text == "<<opt>>":
                opened.append(at)
                self.states[at].free.append(after)
            elif text == "<</opt>>":
                self.states[at].free.append(after)
                self.states[opened.pop()].free.append(after)
            elif mark.group(1):
                self.states[at].free.append(after)
                for _ in range(int(mark.group(1))):
                    more = self._new()
                    self.states[at].any_word.append(more)
                    self.states[more].free.append(after)
                    at = more
            else:
                self.states[at].step.setdefault(text.encode(), []).append(after)
            at = after
        self.states[at].accepts = label

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for more in self.states[todo.pop()].free:
                if more not in seen:
                    seen.add(more)
                    todo.append(more)
        return frozenset(seen)

    def run(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """The longest match of every label at every start."""
        found = []
        first, states = self.first, self.states
        for start in [i for i, w in enumerate(words) if w in first]:
            live, at, best = self.starts, start, {}
            while live and at < len(words):
                reached = set()
                for s in live:
                    reached.update(states[s].step.get(words[at], ()))
                    if at > start:  # a match begins with a word of the template
                        reached.update(states[s].any_word)
                at += 1
                live = self._close(reached)
                for s in live:
                    if states[s].accepts:
                        best[states[s].accepts] = at
            found += [(start, end, label) for label, end in best.items()]
        return found


_SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double")


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Per document: doc_id, n_words, n_base (places of phrases), first_word and last_word
    (their smallest and largest start), base_labels, labels (the notices' too), score (the
    share of words within any match)."""
    base = set(phrases.values())
    templates = phrases | notices
    if base & set(notices.values()):
        raise ValueError("phrases and notices have labels of their own")

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = TokenAutomaton(templates)
        for frame in frames:
            rows = []
            for body in frame["text"]:
                words = ALNUM_WORD.findall(lowered_bytes(body))
                found = automaton.run(words)
                places = [m for m in found if m[2] in base]
                labels = sorted({m[2] for m in found})
                covered, upto = 0, 0
                for start, end, _ in sorted(found):
                    covered += max(0, end - max(start, upto))
                    upto = max(upto, end)
                rows.append((
                    len(words), len(places),
                    min((m[0] for m in places), default=None),
                    max((m[0] for m in places), default=None),
                    ",".join(x for x in labels if x in base), ",".join(labels),
                    covered / len(words) if words else 0.0,
                ))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
            for name in ("first_word", "last_word"):
                made[name] = made[name].astype("Int64")
            made.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text"))
    return rows.mapInPandas(match, f"doc_id long, {_SCHEMA}")
