"""Whole licence notices: wrapped sentences, headers, licence files and SPDX tags.

Texts are compared as in ``licenses.py`` (count * idf, cosine), but not line by line:

* an ``SPDX-License-Identifier`` tag names its licences itself, with score 1;
* lines of a paragraph are joined without their comment marks, so that a notice may
  be wrapped anywhere; its sentences are compared with the one-line templates;
* paragraphs and runs of comment lines are compared with the usual headers;
* runs of comment lines and the whole text are compared with full licence texts, from a
  cosine of ``LEAST_TEXT``.

Each family of templates has its own idf.  There is no word filter: a family is left
out only where the terms of a text cannot reach its least cosine with any template.
(By Cauchy-Schwarz a cosine is at most the norm of the template's weights on those terms.)
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import sqrt
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_TEXT = 0.9

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by "
        "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_LIBRARY = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License "
            "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
_APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
           "You may obtain a copy of the License at")
_APACHE_REST = (' http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed '
                'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
                "See the License for the specific language governing permissions and limitations under the License.")
_GNU_REST = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
             "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. You should have received a copy "
             "of the GNU {0} License along with this program. If not, see <https://www.gnu.org/licenses/>.")
_COMMONS = "Creative Commons Attribution{} 4.0 International Public License"

#: Usual headers by licence, in one paragraph and as wholes: fixed values.
HEADERS = (
    ("AGPL-3.0", _GNU.format("Affero General Public", 3)),
    ("AGPL-3.0", _GNU.format("Affero General Public", 3) + _GNU_REST.format("Affero General Public")),
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *((f"CC-BY{short}-4.0", _COMMONS.format(long)) for short, long in (
        ("", ""), ("-NC", "-NonCommercial"), ("-NC-ND", "-NonCommercial-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"),
        ("-ND", "-NoDerivatives"), ("-SA", "-ShareAlike"))),
    *((f"GPL-{v}.0", t) for v in (1, 2, 3) for t in (_GNU.format("General Public", v), _GNU.format("General Public", v) + _GNU_REST.format("General Public"))),
    ("LGPL-2.0", _LIBRARY.format("Library", 2)), ("LGPL-2.1", _LIBRARY.format("Lesser", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public", 3)),
    ("LGPL-3.0", _GNU.format("Lesser General Public", 3) + _GNU_REST.format("Lesser General Public")),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

MARK = re.compile(r"^[ \t]*(?://+!?|/\*+!?|\*+/?|#+!?|--+|;+|%+|<!--)[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$")
BEGIN = re.compile(r"^[ \t]*(?://|/\*|\*|#|--|;|%|<!--)")
END = re.compile(r"(?<=[.!?;])\s+")
ID = r"[( \t]*[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?\b\+?[) \t]*"
TAG = re.compile(rf"SPDX-License-Identifier:({ID}(?:(?<=[) \t])(?:AND|OR|WITH)(?=[( \t]){ID})*)", re.I)


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full texts kept beside this module."""
    return [(p.name[:-4], p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def bag(text: str) -> Counter:
    """Counted terms: runs of ``[a-z0-9.]`` without outer dots."""
    counts = Counter(raw.strip(".") for raw in re.findall("[a-z0-9.]+", text.lower()))
    del counts[""]
    return counts


class Family:
    """Templates with a common idf and a least cosine."""

    def __init__(self, rows: list[tuple[int, str, str, float]], idf: dict[str, float], other: float, least: float):
        self.names = dict((i, name) for i, name, _, _ in rows)
        self.index: dict[str, list[tuple[int, float]]] = {}
        for i, _, term, weight in rows:
            self.index.setdefault(term, []).append((i, weight))
        self.idf, self.other, self.least = idf, other, least

    def reachable(self, counts: Counter) -> bool:
        """Whether a part of a text with these terms can come to the least cosine."""
        held = Counter()
        for t in counts.keys() & self.index.keys():
            for i, weight in self.index[t]:
                held[i] += weight * weight
        return any(h >= self.least * self.least - 1e-6 for h in held.values())

    def scores(self, counts: Counter) -> Iterator[tuple[float, str]]:
        """(score, licence) of the templates that come to the least cosine."""
        norm = sqrt(sum((n * self.idf.get(t, self.other)) ** 2 for t, n in counts.items()))
        dots: dict[int, float] = {}
        for t in counts.keys() & self.index.keys():
            for i, weight in self.index[t]:
                dots[i] = dots.get(i, 0.0) + counts[t] * self.idf[t] * weight
        for i, dot in dots.items():
            if (score := round(dot / norm, 6)) >= self.least:
                yield score, self.names[i]


def tagged(text: str, known: dict[str, str]) -> set[str]:
    """Licences of the tags of a text; one that is not known keeps its spelling."""
    out = set()
    for tag in TAG.finditer(text):
        for said in re.split(r"(?i)(?<=[) \t])(?:and|or)(?=[( \t])", re.sub(r"(?i)(?<=[) \t])with[( \t]+[^) \t]+", "", tag[1])):
            name = said.strip("() \t")
            if name.upper() not in ("NONE", "NOASSERTION"):
                out.add(known.get(re.sub(r"(?i)(-only|-or-later|\+)$", "", name).lower(), name))
    return out


def parts(text: str) -> tuple[list[str], list[str]]:
    """Paragraphs and runs of comment lines, each joined without comment marks."""
    paragraphs, runs, paragraph, run = [], [], [], []
    for line in [*text.split("\n"), None]:
        plain = "" if line is None else MARK.sub("", line)
        commented = line is not None and BEGIN.match(line) is not None
        if plain:
            paragraph.append(plain)
        elif paragraph:
            paragraphs.append(" ".join(paragraph))
            paragraph = []
        if commented:
            run.append(plain)
        elif run:
            runs.append(" ".join(run))
            run = []
    return paragraphs, runs


CLOSING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
OPENING = re.compile("(?=(" + "|".join(map(re.escape, CLOSING)) + "))")  # looking ahead, so that marks may overlap


def block_comments(text: str) -> list[str]:
    """Bodies of block comments and of strings in triple quotes."""
    found, at, unclosed = [], 0, set()
    for m in OPENING.finditer(text):
        mark = m.group(1)
        if m.start() < at or mark in unclosed:
            continue
        begin = m.start() + len(mark)
        end = text.find(CLOSING[mark], begin)
        if end < 0:
            unclosed.add(mark)  # nor can a later one be closed: each closing mark is looked for past the end only once
        else:
            found.append(text[begin:end])
            at = end + len(CLOSING[mark])
    return [" ".join(MARK.sub("", line) for line in body.split("\n")) for body in found]


def best_notice(text: str | None, sentences: Family, headers: Family, texts: Family, known: dict[str, str]) -> tuple[str | None, float | None]:
    """The licence with the largest score, then the first name."""
    if not text:
        return None, None
    found = {(1.0, name) for name in tagged(text, known)}
    counts = bag(text)
    found.update(texts.scores(counts))
    reach = [f.reachable(counts) for f in (sentences, headers, texts)]
    if any(reach):
        paragraphs, runs = parts(text)
        runs += block_comments(text)
        if reach[0]:
            lines = [MARK.sub("", line) for line in text.split("\n")]
            for s in {s for p in (*paragraphs, *lines) for s in END.split(p)}:
                found.update(sentences.scores(bag(s)))
        for part in {*paragraphs, *runs} if reach[1] else ():
            found.update(headers.scores(bag(part)))
        for part in set(runs) if reach[2] else ():
            found.update(texts.scores(bag(part)))
    if not found:
        return None, None
    score, name = min(found, key=lambda f: (-f[0], f[1]))
    return name, score


def whole_notices(files: DataFrame, weigh: Callable, templates: Iterable[tuple[str, str]], least: float) -> DataFrame:
    """(path, license, score) of files (path, text) with a notice that is a tag, wrapped, a header or a licence text."""
    texts = full_texts()
    families = (Family(*weigh(templates), least), Family(*weigh(HEADERS), least), Family(*weigh(texts), LEAST_TEXT))
    known = {name.lower(): name for name, _ in (*templates, *HEADERS, *texts)}

    def build(batches):
        for batch in batches:
            paths, found = [], []
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                for path, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    name, score = best_notice(text, *families, known)
                    if name is not None:
                        paths.append(path)
                        found.append((name, score))
            yield pa.RecordBatch.from_arrays([
                pa.array(paths, pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["path", "license", "score"])

    return files.select("path", "text").mapInArrow(build, "path string, license string, score double")
