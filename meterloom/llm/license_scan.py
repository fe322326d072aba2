"""Licences of files: notices by cosine to templates, then what the nearest directory above grants."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import mapped, written

#: Short notices by which licences are usually granted.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def _gnu_header(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, "
        f"or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        f"FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


def _gnu_file(name: str, version: str, then: str) -> str:
    return f"{name} Version {version} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. {then}"


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GPL, _LGPL, _AGPL = (f"GNU {kind}General Public License" for kind in ("", "Lesser ", "Affero "))
#: Headers of source files and beginnings of licence files.
PASSAGES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
    including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and
    conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."""),
    ("GPL-3.0", _gnu_header(_GPL, "3")),
    ("GPL-2.0", _gnu_header(_GPL, "2")),
    ("LGPL-3.0", _gnu_header(_LGPL, "3")),
    ("LGPL-2.1", _gnu_header(_LGPL, "2.1")),
    ("AGPL-3.0", _gnu_header(_AGPL, "3")),
    ("GPL-3.0", _gnu_file(_GPL, "3, 29 June 2007 Copyright (C) 2007", f"Preamble The {_GPL} is a free, copyleft license for software and other kinds of works.")),
    ("GPL-2.0", _gnu_file(_GPL, "2, June 1991 Copyright (C) 1989, 1991", "Preamble The licenses for most software are designed to take away your freedom to share and change it.")),
    ("LGPL-3.0", _gnu_file(_LGPL, "3, 29 June 2007 Copyright (C) 2007", f"This version of the {_LGPL} incorporates the terms and conditions of version 3 of the {_GPL}, supplemented by the additional permissions listed below.")),
    ("LGPL-2.1", _gnu_file(_LGPL, "2.1, February 1999 Copyright (C) 1991, 1999", "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.")),
    ("AGPL-3.0", _gnu_file(_AGPL, "3, 19 November 2007 Copyright (C) 2007", f"Preamble The {_AGPL} is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.")),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: A line that is a title and nothing else.
_TITLE = re.compile(r"^[\W_]*(?:the )?(MIT|ISC|Apache|Mozilla Public) licen[cs]e(?: ?\(MIT\)|,? (?:v|version )?2\.0)?[\W_]*$", re.IGNORECASE)
_TITLED = {"mit": "MIT", "isc": "ISC", "apache": "Apache-2.0", "mozilla public": "MPL-2.0"}
#: The expression as it stands, to the end of its line or comment.
_SPDX = re.compile(r"SPDX-Licen[cs]e-Identifier:[ \t]*([\w.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[\w.+-]+)*)", re.IGNORECASE)
_GNU = re.compile(r"\b((?:A|L)?GPL-\d\.\d)(?:-only|-or-later|\+)", re.IGNORECASE)
_TERM = re.compile(r"[a-z]+|\d+")
_LINE = re.compile(r"[^\n\r]+")
#: What tags and titles hold, whatever the templates.
_NAMED = re.compile(r"licen[cs]e", re.IGNORECASE)
#: Words that say little about a text; any choice keeps all matches.
_EVERYDAY = frozenset("a all and any are as at be but by can change code condition conditions copy copies following for form forms free from in is it its most not of on or out program subject that the this to under use with without work works you".split())
_LICENCE_FILE = re.compile(r"(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$", re.IGNORECASE)


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


class Matcher:
    """Sparse TF-IDF vectors of the templates; words that no template has count for length alone."""

    def __init__(self, templates=TEMPLATES):
        held = [terms(text) for _, text in templates]
        documents = Counter(t for x in held for t in x)
        self._idf = {t: math.log((1 + len(held)) / (1 + n)) + 1 for t, n in documents.items()}
        self._other = math.log(1 + len(held)) + 1
        self._vectors = [(name, self._weigh(x)) for (name, _), x in zip(templates, held)]

    def _weigh(self, found: Counter) -> dict[str, float]:
        weighed = {t: n * self._idf.get(t, self._other) for t, n in found.items()}
        norm = math.sqrt(sum(w * w for w in weighed.values())) or 1.0
        return {t: w / norm for t, w in weighed.items()}

    def reachable(self, held: set[str], least: float) -> list[int]:
        """The templates to which some part of a text of these terms may have a cosine of `least`: no
        cosine is above the norm of what of a template the text holds."""
        return [i for i, (_, vector) in enumerate(self._vectors) if sum(w * w for t, w in vector.items() if t in held) >= least**2 - 1e-9]

    def best(self, text: str) -> tuple[str | None, float]:
        own = self._weigh(terms(text))
        scored = [(sum(w * own.get(t, 0.0) for t, w in vector.items()), name) for name, vector in self._vectors]
        score, name = max(scored, key=lambda x: (x[0], x[1]), default=(0.0, None))
        return name, score


def needed(templates, least: float) -> re.Pattern:
    """A pattern that every text has whose cosine to one of the templates is `least` or more.

    A cosine is at most the norm of the template's part that both share. Of each template terms are left
    out, those that any text may hold first and light ones before heavy ones, while what is left out
    together stays below that: a text without any of the others can't reach it."""
    found = set()
    for _, vector in Matcher(templates)._vectors:
        out = 0.0
        for term, weight in sorted(vector.items(), key=lambda x: (x[0] not in _EVERYDAY and x[0].isalpha(), x[1], x[0])):
            out += weight**2
            if out >= least**2 - 1e-9:
                found.add(term)
    return re.compile("|".join([rf"(?<![a-z])(?:{'|'.join(sorted(t for t in found if t.isalpha()))})(?![a-z])", *[rf"(?<!\d){t}(?!\d)" for t in sorted(found) if t.isdigit()]]))


class Spans:
    """The templates against the spans of a text that are as long as each, wherever lines end. A span's
    product with a template is a difference of running sums, so the best one is found in one pass; the
    cosine is that of the span with the largest product."""

    def __init__(self, templates):
        self._matcher = Matcher(templates)
        self._words: dict[str, int] = {}
        for _, text in templates:
            for t in terms(text):
                self._words.setdefault(t, len(self._words))
        idf, held = self._matcher._idf, self._matcher._vectors
        self._sizes = [sum(terms(text).values()) for _, text in templates]
        self._gains = np.array([[idf[t] * vector.get(t, 0.0) for t in self._words] + [0.0] for _, vector in held])

    def best(self, found: list[str], least: float) -> tuple[str | None, float]:
        """The best template and its cosine; those that can't reach `least` are not tried."""
        tried = self._matcher.reachable(set(found), least)
        if not tried:
            return None, 0.0
        codes = np.array([self._words.get(t, -1) for t in found])
        scores: dict[str, float] = {}
        for (name, vector), gains, size in ((self._matcher._vectors[i], self._gains[i], self._sizes[i]) for i in tried):
            sums = np.concatenate([[0.0], np.cumsum(gains[codes])])
            size = min(size, len(found))
            at = int(np.argmax(sums[size:] - sums[:-size]))
            own = self._matcher._weigh(Counter(found[at : at + size]))
            scores[name] = max(scores.get(name, 0.0), sum(w * own.get(t, 0.0) for t, w in vector.items()))
        name = max(scores, key=lambda x: (scores[x], x))
        if name == "BSD-2-Clause" and scores.get("BSD-3-Clause", 0.0) >= 0.95:  # which holds all of the former
            name = "BSD-3-Clause"
        return name, scores[name]


def scan(df: DataFrame, templates=TEMPLATES, passages=PASSAGES, *, least: float = 0.7, span: float = 0.85, whole: float = 0.5) -> DataFrame:
    """doc_id, dir, own_licence, cosine and grants of each row of df (doc_id, path, text).

    A row's own licence is what an SPDX tag says; or else the best of `passages`, headers and beginnings
    of licence files, that a span of the text matches from `span` on, however it is wrapped; or else the
    best template that a line matches from `least` on or a span within a line or over several from `span`
    on; or else a line that is a title alone. The row grants it to its directory where its name is that of
    a licence file, or where the cosine of the whole text is at least `whole`: it is little more than the
    notice. A null text is empty; a null path is the root's. Lines and texts without any of the words that a
    match needs are not compared further, and cosine is the best of what was."""

    def start() -> Callable:
        matcher, kept = Matcher(templates), {}
        long, short, texts_of = Spans(passages), Spans(templates), Matcher(passages)
        in_line = needed(templates, least)

        def by_lines(text: str) -> tuple:
            best: tuple[str | None, float] = (None, 0.0)
            for line in _LINE.findall(text):
                if in_line.search(line.lower()) or _NAMED.search(line):
                    if line not in kept:
                        if len(kept) > 50_000:
                            kept.clear()
                        kept[line] = (_TITLED[found[1].lower()], 1.0) if (found := _TITLE.match(line)) else matcher.best(line)
                    best = max(best, kept[line], key=lambda x: x[1])
            return best

        def one(path: str | None, text: str | None) -> tuple:
            name, score = None, 0.0
            if text:
                if tag := _SPDX.search(text):
                    name, score = _GNU.sub(r"\1", tag[1]), 1.0
                else:
                    found = _TERM.findall(text.lower())
                    name, score = long.best(found, span)
                    if score < span:
                        if matcher.reachable(set(found), least) or _NAMED.search(text):
                            name, score = by_lines(text)
                        if score < least:
                            within = short.best(found, span)
                            name, score = within if within[1] >= span else (None, max(score, within[1]))
            grants = name is not None and (_LICENCE_FILE.search(path or "") is not None or max(matcher.best(text)[1], texts_of.best(text)[1]) >= whole)
            return (path or "").rpartition("/")[0], name, score, grants

        return lambda paths, texts: zip(*map(one, paths, texts))

    return mapped(df, ["doc_id"], ["path", "text"], start, "dir string, own_licence string, cosine double, grants boolean")


def inherit(scanned: DataFrame) -> DataFrame:
    """The rows of scan() with licence (their own, or else what the nearest directory above that has a
    licence file grants) and granted_by (that directory; null for their own).

    Of several licence files in a directory the smallest doc_id's holds. Ancestors are sought once for
    each directory, so a directory with very many files costs no more than others until the last join,
    in which its rows can be split. What was scanned is written first: it is small and read three times."""
    scanned = written(scanned, "scanned")
    grants = scanned.where("grants").groupBy("dir").agg(F.min_by("own_licence", F.struct("doc_id", "own_licence")).alias("granted")).withColumnRenamed("dir", "above")
    parts = F.split("dir", "/")
    up_to = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    chains = scanned.select("dir").distinct().select("dir", F.explode(F.array_union(up_to, F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))))).alias("at")).select("dir", "at.*")
    nearest = chains.join(grants, "above").groupBy("dir").agg(F.max_by(F.struct("granted", "above"), "depth").alias("found"))
    return scanned.join(nearest, "dir", "left").select(
        "doc_id",
        "dir",
        "own_licence",
        "cosine",
        "grants",
        F.coalesce("own_licence", "found.granted").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("found.above")).alias("granted_by"),
    )


def document_path() -> Column:
    """Documents have no paths of their own: their source, and folders of ten thousand and a hundred ids."""
    level = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return F.concat_ws("/", F.coalesce("source", F.lit("")), level(10_000), level(100), F.col("doc_id").cast("string"))
