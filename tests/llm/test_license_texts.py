"""Templates against regular expressions, and whole licence texts as they are published."""

import random
import re

import pytest

from tidyshelf.llm import license_scan, license_texts

MIT = """MIT License

Copyright (c) 2021 Some Person, and Others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

APACHE = """/* Copyright 2019 The Makers
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     https://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License. */"""

GPL = """This tool is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""


def labels(text):
    return license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES).scan(
        license_scan.words_of(text.encode()))[4]


def filled(template, rnd, keep):
    """A text of the template: optional parts by chance, holders made up."""
    text = re.sub(r"<<(\d+),(\d+)>>", lambda m: " ".join(
        f"name{rnd.randint(0, 9)}" for _ in range(rnd.randint(int(m[1]), int(m[2])))), template)
    return re.sub(r"\[\[|\]\]", " ", text) if keep else re.sub(r"\[\[[^\[\]]*\]\]", " ", text)


def test_published_texts():
    assert {"mit-text", "mit"} == labels(MIT) and "mit-text" in labels("some words\n" + MIT + "\nmore words")
    assert "apache-2.0-header" in labels(APACHE) and "gpl-3.0-notice" in labels(GPL)
    assert "gpl-2.0-notice" not in labels(GPL)
    # one mandatory word left out, or another in its place
    assert "mit-text" not in labels(MIT.replace("without restriction", "without"))
    assert "apache-2.0-header" not in labels(APACHE.replace("writing", "speech"))
    assert "gpl-3.0-notice" not in labels(GPL.replace("either version", "version"))


@pytest.mark.parametrize("label,template,anchor", license_texts.TEXTS)
@pytest.mark.parametrize("keep", [True, False])
def test_each_text_is_its_own(label, template, anchor, keep):
    rnd = random.Random(label)
    got = labels("before " + filled(template, rnd, keep) + " after") & {t[0] for t in license_texts.TEXTS}
    assert got == {label}


def as_regex(template):
    out = ""
    for token in re.findall(r"\[\[|\]\]|<<\d+,\d+>>|[^\s\[\]<>]+", template):
        if token == "[[":
            out += "(?:"
        elif token == "]]":
            out += ")?"
        elif token.startswith("<<"):
            out += f"(?:\\S+ ){{{token[2:-2]}}}"
        else:
            out += "".join(re.escape(w.decode()) + " " for w in license_scan.words_of(token.encode()))
    return re.compile(out)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_regular_expression(seed):
    rnd = random.Random(seed)

    def part(depth):
        kind = rnd.random()
        if kind < 0.25 and depth:
            return "[[" + " ".join(part(depth - 1) for _ in range(rnd.randint(1, 3))) + "]]"
        return "<<%d,%d>>" % (lo := rnd.randint(1, 2), lo + rnd.randint(0, 2)) if kind < 0.4 else rnd.choice("abc")

    template = " ".join(part(2) for _ in range(rnd.randint(1, 6)))
    automaton, wanted = license_scan.compile_template(template), as_regex(template)
    for _ in range(60):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 9))]
        start = rnd.randint(0, len(words))
        ends = [end for end in range(start, len(words) + 1)
                if wanted.fullmatch("".join(w.decode() + " " for w in words[start:end]))]
        assert automaton.longest(words, start) == max(ends, default=-1), template
