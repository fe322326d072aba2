"""Licences as they stand in files: wrapped headers, licence files, tags, titles, and notices inside a paragraph."""

import textwrap

import pytest

from meterloom.llm import license_scan

GPL3_HEADER = """\
# foo.py - does things
# Copyright (C) 2020 Jo Doe
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.

import os
"""
GPL3_FILE = """\
                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.
"""
BSD2 = "Copyright (c) 2020, Jo Doe\nAll rights reserved.\n\n" + textwrap.fill(license_scan._BSD, 72) + "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
CLAUSE = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
TALK = "the mill stands by a river that nobody has named and people walk there on long evenings "
CASES = [
    ("src/a/foo.py", GPL3_HEADER, "GPL-3.0"),
    ("src/b/foo.py", GPL3_HEADER.replace("version 3", "version 2"), "GPL-2.0"),
    ("src/c/foo.py", GPL3_HEADER.replace("General", "Lesser General"), "LGPL-3.0"),
    ("lib/LICENSE", GPL3_FILE + TALK * 300, "GPL-3.0"),
    ("two/LICENSE", BSD2, "BSD-2-Clause"),
    ("three/LICENSE", BSD2.replace("\n\nTHIS", CLAUSE + "\nTHIS"), "BSD-3-Clause"),
    ("t/x.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", "GPL-2.0"),
    ("t/y.c", "// SPDX-License-Identifier: MIT OR Apache-2.0\nint y;", "MIT OR Apache-2.0"),
    ("m/COPYING", "MIT License\n\nCopyright (c) 2020 Jo Doe\n", "MIT"),
    ("p/page", TALK * 4 + "Released under the MIT License. " + TALK * 4, "MIT"),
    ("q/page", TALK * 4 + "the licence to fish was copyright of the town and permission was rare " + TALK, None),
    ("r/page", "A licence is granted by the council under version 3 of the rules of the general public library.", None),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, path, text) for i, (path, text, _) in enumerate(CASES)] + [(100, "lib/deep/z.c", "int z;"), (101, "src/a/z.c", "int z;")]
    found = license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string"))).collect()
    return {r.doc_id: r for r in found}


def test_own_licence_of_each_form(scanned):
    assert {CASES[i][0]: scanned[i].own_licence for i in range(len(CASES))} == {path: name for path, _, name in CASES}


def test_licence_files_in_full_grant_to_their_directory(scanned):
    assert (scanned[100].licence, scanned[100].granted_by) == ("GPL-3.0", "lib")


def test_no_match_is_missed_by_the_words_that_matches_need():
    lines = ["Released under MIT", "under CC BY-SA 4.0", "Licensed under CC BY 4.0", "licensed under apache 2.0", "GNU General Public License version 3"]
    lines += [text for _, text in license_scan.TEMPLATES]
    lines += [" ".join(words[at : at + n]) for _, text in license_scan.TEMPLATES for words in [text.split()] for n in (3, 5, 8) for at in range(0, len(words), 2)]
    matcher, pattern = license_scan.Matcher(license_scan.TEMPLATES), license_scan.needed(license_scan.TEMPLATES, 0.7)
    reached = [line for line in lines if matcher.best(line)[1] >= 0.7]
    assert len(reached) > 20 and all(pattern.search(line.lower()) for line in reached)


def test_short_notices_without_a_licence_word_count(spark):
    rows = [(1, "a/b", "x\nReleased under MIT\ny"), (2, "a/c", "under CC BY-SA 4.0"), (3, "d/LICENSE", "MIT License\n"), (4, "d/LICENSE.old", "Licensed under CC BY 4.0.\n"), (5, "d/e/f", "nothing here")]
    found = {r.doc_id: r for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string"))).collect()}
    assert (found[1].own_licence, found[2].own_licence) == ("MIT", "CC-BY-SA-4.0")
    assert (found[5].licence, found[5].granted_by) == ("MIT", "d")  # of two licence files the smaller doc_id's holds
