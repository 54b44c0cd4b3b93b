"""Licence recognition on the published texts, wrapped and on one line; gate, gaps and the SQL."""

import textwrap

import duckdb
import pytest

from lectern.llm import license_scan as licenses

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL21 = GPL2.replace("General", "Lesser General").replace("his program", "his library").replace("version 2 ", "version 2.1 ")
AGPL = GPL3.replace("General", "Affero General")
BSD3 = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD2 = "\n\n".join(p for p in BSD3.split("\n\n") if not p.startswith("3."))
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "LGPL-2.1": LGPL21, "AGPL-3.0": AGPL, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "ISC": ISC, "MPL-2.0": MPL}


def wrapped(text, width, prefix=""):
    return "\n\n".join("\n".join(textwrap.wrap(p, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


def forms(text):
    yield text
    yield wrapped(text, 72)
    yield wrapped(text, 34)
    yield wrapped(text, 60, "# ")
    yield wrapped(text, 70, " * ").replace("\n\n", "\n *\n")
    yield " ".join(text.split())
    yield wrapped(text, 72).replace("\n", "\r\n")
    yield f"Some words before.\n{text}\nand some words after it"


def oracle_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.sql(licenses.oracle())
    return found.columns, sorted(map(repr, found.fetchall()))


def test_published_texts_are_recognised(spark):
    cases = [(name, form) for name, text in TEXTS.items() for form in forms(text)]
    rows = [(i, text) for i, (_, text) in enumerate(cases)]
    found = sorted(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for r, (name, text) in zip(found, cases):
        # the BSD texts also reserve all rights
        assert r.licenses.split(",")[0] == name and set(r.licenses.split(",")) <= {name, "Proprietary"}, (name, r, text)
    columns, expected = oracle_rows(rows)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found) == expected


def test_gate_lets_every_known_sentence_through():
    for sentence in licenses.KNOWN.values():
        assert any(key in word for key in licenses.KEYS for word in sentence.split()), sentence
    assert len(set(licenses.KNOWN.values())) == len(licenses.KNOWN) and {i for _, _, ids in licenses.RULES for i in ids} <= licenses.KNOWN.keys()


def test_spacing_does_not_hide_a_sentence(spark):
    rows = [(i, f"All{a}rights{b}reserved.") for i, (a, b) in enumerate([(" ", " "), (" ", "  "), ("\t", "\t"), ("\u00a0", "\u00a0"), (" ", "-"), (", ", "\n")])]
    rows += [(10 + i, s.replace(" ", "  ")) for i, s in enumerate(licenses.KNOWN.values())]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_sentences == 1 for r in found) and all(r.licenses == "Proprietary" for r in found if r.doc_id < 10)
    columns, expected = oracle_rows(rows)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found) == expected


CASES = [
    # other text between two sentences keeps a rule from joining them
    ("Licensed under the Apache License, Version 2.0. Other words stand here. You may not use this file except in compliance with the License.", "apache-notice", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "apache-header", "Apache-2.0"),
    # what a rule used up leaves a mark: its neighbours do not become adjacent
    ("Licensed under the Apache License, Version 2.0. Released under the MIT License. You may not use this file except in compliance with the License.", "released-mit-license,apache-notice", "MIT,Apache-2.0"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "spdx-gpl-3.0-or-later", "GPL-3.0-or-later"),
    ("Text above\nReleased under the MIT License\ntext below, released under the MIT license of old", "released-mit-license", "MIT"),
    ("Released under the MIT License. Released under the MIT License.", "released-mit-license", "MIT"),
    ("We love the MIT License and licensed software is provided here", "", ""),
    ("* - # All rights reserved", "reserved", "Proprietary"),
    ("All rights | reserved ~ All rights reserved", "", ""),
    ("\n\n \n", "", ""),
    ("", "", ""),
    (None, "", ""),
    ("- " * 50_000 + "all rights reserved " * 3, "", ""),
    ("x " * 200_000 + ".\nAll rights reserved", "reserved", "Proprietary"),
]


def test_gaps_rules_and_odd_texts(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES)] + [(None, "All rights reserved"), (3, CASES[3][0])]
    found = licenses.license_scan(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, s string")).collect()
    for r in found:
        assert (r.rules, r.licenses) == (CASES[r.doc_id][1:] if r.doc_id is not None else ("reserved", "Proprietary")), CASES[r.doc_id or 0][0] and CASES[r.doc_id or 0][0][:80]
    columns, expected = oracle_rows(rows)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found) == expected


@pytest.mark.parametrize("name", [*licenses.NAMES])
def test_names_have_rules(name):
    assert any(ids == (key,) for key, s in licenses.KNOWN.items() if s.endswith(name) for _, licence, ids in licenses.RULES if licence == licenses.NAMES[name])
