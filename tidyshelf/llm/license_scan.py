"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is written as licence texts are published: plain words are mandatory, ``[[ ... ]]`` is
optional, ``<<1,4>>`` stands for one to four arbitrary words. ``compile_template`` turns it into a
non-deterministic automaton over words; ``matches`` accepts exactly the word sequences whose mandatory
wording is the template's. An automaton is only started where its rarest fixed phrase occurs, so the
many texts without one are passed over by a byte search.

Beside it stand base phrases: each place where their words follow one another counts.

Defined cases: a null or empty text has no words and no labels; words are what is left between the
ASCII separators, so other scripts count as words; repeated rows and labels are reported once a row;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm import frames, license_texts

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, template, anchor): the anchor is a run of mandatory words.
TEMPLATES = (
    ("gpl-3.0", "[[this work is]] [[<<1,4>> is]] [[distributed or]] licensed under [[the terms of]] "
                "[[the]] gnu general public license [[as published by the free software foundation]] "
                "version 3 [[or any later version]]", "gnu general public license"),
    ("gpl-2.0", "[[this work is]] [[<<1,4>> is]] [[distributed or]] licensed under [[the terms of]] "
                "[[the]] gnu general public license [[as published by the free software foundation]] "
                "version 2 [[or any later version]]", "gnu general public license"),
    ("apache-2.0", "[[this work is]] licensed under [[the terms of]] the apache license version 2 0 "
                   "[[the license]]", "apache license"),
    ("mit-notice", "[[this work is]] [[copyright <<1,8>>]] released under [[the terms of]] the mit "
                   "license", "mit license"),
    ("cc-by-4.0", "[[this <<1,2>> is]] licensed under [[a]] [[creative commons]] cc by [[version]] 4 0 "
                  "[[international]] [[license]]", "cc by"),
    *license_texts.TEXTS,
)

COLUMNS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
           "base_labels string, labels string, score double")

#: Separators become blanks, A-Z become a-z, all else stays.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
              else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n; a step is (state, word or None for any word, next state); free steps cost no word."""

    steps: tuple[tuple[int, bytes | None, int], ...]
    free: tuple[tuple[int, int], ...]
    last: int

    @cached_property
    def after(self) -> tuple[dict[int, list[tuple[bytes | None, int]]], dict[int, list[int]]]:
        """Steps and free steps by the state they leave."""
        steps, free = {}, {}
        for a, word, b in self.steps:
            steps.setdefault(a, []).append((word, b))
        for a, b in self.free:
            free.setdefault(a, []).append(b)
        return steps, free

    def close(self, states: set[int]) -> set[int]:
        free, open_states = self.after[1], list(states)
        while open_states:
            for b in free.get(open_states.pop(), ()):
                if b not in states:
                    states.add(b)
                    open_states.append(b)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from ``start``, or -1."""
        states, end = self.close({0}), -1
        at = start
        while states:
            if self.last in states:
                end = at
            if at == len(words):
                break
            states = self.close({b for a in states for word, b in self.after[0].get(a, ())
                                 if word in (None, words[at])})
            at += 1
        return end


def compile_template(template: str) -> Automaton:
    steps, free, opened, state, top = [], [], [], 0, 0
    for token in re.findall(r"\[\[|\]\]|<<\d+,\d+>>|[^\s\[\]<>]+", template):
        if token == "[[":
            opened.append(state)
        elif token == "]]":
            free.append((opened.pop(), state))
        elif token.startswith("<<"):
            least, most = map(int, token[2:-2].split(","))
            entries = []
            for k in range(most):
                top += 1
                steps.append((state, None, top))
                state = top
                if k + 1 >= least:
                    entries.append(state)
            free += [(entry, state) for entry in entries[:-1]]
        else:
            for word in words_of(token.encode()):
                top += 1
                steps.append((state, word, top))
                state = top
    return Automaton(tuple(steps), tuple(free), state)


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands; ``joined`` and ``phrase`` have a blank on each side."""
    out, at, seen, count = [], joined.find(phrase), 0, 0
    while at >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = joined.find(phrase, at + 1)
    return out


class Scanner:
    """Base phrases and compiled templates."""

    def __init__(self, phrases: dict[str, str], templates):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.templates = []
        for label, template, anchor in templates:
            automaton = compile_template(template)
            reach = len(automaton.steps)
            self.templates.append((label, automaton, b" " + anchor.encode() + b" ", reach))

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        joined = b" " + b" ".join(words) + b" "
        starts, base, covered, own = [], set(), set(), set()
        for phrase, label in self.phrases:
            if found := places(joined, phrase):
                base.add(label)
                starts += found
                width = phrase.count(b" ") - 1
                covered.update(i for at in found for i in range(at, at + width))
        for label, automaton, anchor, reach in self.templates:
            done = -1
            for at in places(joined, anchor):
                if at < done:
                    continue
                for start in range(max(0, done, at - reach), at + 1):
                    if (end := automaton.longest(words, start)) > at:
                        own.add(label)
                        covered.update(range(start, end))
                        done = end
                        break
        share = len(covered) / len(words) if words else 0.0
        score = (0.5 + 0.5 * share if own else 0.5 * share) if covered else 0.0
        return (len(starts), min(starts, default=None), max(starts, default=None), base, base | own,
                score)


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """Words, base places, labels and score of every document. Score: up to 0.5 for the share of words
    that phrases cover, 0.5 more where a template's wording is accepted."""
    def rows(batches):
        scanner = Scanner(phrases, templates)
        for part in frames.slices(batches):
            out = []
            for text in frames.encoded(part.column("text")):
                words = words_of(text)
                n, first, last, base, labels, score = scanner.scan(words)
                out.append((len(words), n, first, last, ",".join(sorted(base)),
                            ",".join(sorted(labels)), score))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                 "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, COLUMNS)
