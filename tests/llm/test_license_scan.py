import pytest

from plumbline.llm import license_scan as ls


@pytest.mark.parametrize(
    ("text", "licences"),
    [
        ("Intro.\nLicensed under the Apache License, Version 2.0.\nMore", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3"),
        ("# Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("/* Released under the MIT License. */", "MIT"),
        ("Some text. All rights reserved.", "Proprietary"),
        ("SPDX-License-Identifier: BSD-3-Clause", "SPDX-BSD-3-CLAUSE"),
        ("the license of the poet; permission granted by no one", ""),
        ("licensed under the apache license version 2.0 and others", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_one_licence(documents, text, licences):
    row = ls.scan(documents([(1, text)])).first()
    assert (row.licences, row.licensed) == (licences, bool(licences))


def test_longer_rules_come_first():
    found = [(name, {}) for name in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-redistribution", "bsd-source", "gpl-received", "mit-released")]
    assert ls.licences(found) == ["BSD-3-Clause", "BSD", "Unknown", "MIT"]


def test_full_text_of_a_licence(documents):
    text = (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on.\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
    )
    row = ls.scan(documents([(1, text)], clashing=True)).first()
    assert (row.sentence_ids, row.licences) == ("mit-permission,mit-include,mit-as-is", "MIT")


def test_every_rule_uses_known_sentences():
    known = {name for name, _ in ls.SENTENCES}
    assert all(step in known for _, steps in ls.RULES for step in steps)


def test_odd_rows(odd_documents):
    out = ls.scan(odd_documents).collect()
    assert len(out) == odd_documents.count() and not any(r.licensed for r in out)


def test_long_text_is_read_to_its_end(documents):
    row = ls.scan(documents([(1, "word license " * 20_000 + "\nReleased under the MIT License.")])).first()
    assert row.licences == "MIT"


def test_given_documents(table):
    docs = table("documents", "sf0.01")
    found = {r.doc_id: r.licences for r in ls.scan(docs).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    for row in docs.collect():
        for line, name in lines.items():
            assert (line in row.text.split("\n")) <= (name in found[row.doc_id].split(","))


def test_empty_table(documents):
    assert ls.scan(documents([])).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Copyright (c) 2020, The Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{semi} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize(
    ("text", "licence"),
    [
        (APACHE, "Apache-2.0"),
        (MIT, "MIT"),
        (BSD, "BSD-3-Clause"),
        (GPL.format(mark=":", kind="", semi=",", v=3), "GPL-3"),
        (GPL.format(mark=";", kind="", semi=";", v=2), "GPL-2"),
        (GPL.format(mark=":", kind="Lesser ", semi=",", v="2.1"), "LGPL-2.1"),
        (GPL.format(mark=":", kind="Affero ", semi=",", v=3), "AGPL-3"),
        (MPL, "MPL-2.0"),
        (ISC, "ISC"),
        ("Some code. All rights\nreserved.", "Proprietary"),
        ("no stop before\nReleased under the\nMIT License\nno stop after", "MIT"),
    ],
)
def test_verbatim_wrapped_texts(text, licence, mark):
    lines = [mark + line for line in text.split("\n")]
    for end in ("\n", "\r\n"):
        assert ls.licences(ls.sentences(end.join(["int x = 1", "", *lines, "", "return x"]))) == [licence]


@pytest.mark.parametrize(("text", "licence"), [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-3-Clause"), (MPL, "MPL-2.0"), (ISC, "ISC")])
def test_verbatim_texts_on_one_line(text, licence):
    assert ls.licences(ls.sentences("intro\n" + " ".join(text.split()))) == [licence]
