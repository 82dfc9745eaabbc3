import duckdb
import pytest

from vecprep.llm import licenses as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
ROWS = [
    (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "Apache-2.0"),
    (2, "Released under the MIT License.", "MIT"),
    (3, "x\nThis work is licensed under the GNU General Public License, version 3.0.\ny", "GPL-3.0"),
    (4, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    (5, MIT, "MIT"),
    (6, "\n\n".join(reversed(MIT.split("\n\n"))), ""),
    (7, "// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"),
    (8, "mit", ""),
    (9, "A licence is a fine thing. Mit Software.", ""),
    (10, None, ""),
    (11, "", ""),
    (12, "Released under the MIT License. Licensed under CC BY-SA 4.0! Released under the MIT License.", "CC-BY-SA-4.0 MIT"),
    (13, "prose " * 50_000 + ".\nLicensed under CC BY 4.0.", "CC-BY-4.0"),
    (14, "The MIT license is one of many.", ""),
    (15, "This work is licensed under CC BY 4.0.", "CC-BY-4.0"),
    (16, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    (17, "MIT.\nplain", ""),
    (18, "MIT.\nplain software", ""),
]


def test_rules(documents):
    found = {r["doc_id"]: r for r in L.scan_licenses(documents([r[:2] for r in ROWS])).collect()}
    assert {d: r["licenses"] for d, r in found.items()} == {d: want for d, _, want in ROWS}
    assert found[5]["sentence_ids"] == "mit.grant mit.notice mit.warranty" and found[12]["n_sentences"] == 3 and found[10]["n_sentences"] == 0


def test_equals_sql(documents):
    df = documents([r[:2] for r in ROWS] + [(2, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")])
    ours = sorted(map(tuple, L.scan_licenses(df).collect()), key=str)
    table = df.toArrow()
    theirs = duckdb.connect()
    theirs.register("documents", table)
    assert ours == sorted(theirs.sql(L.ORACLE_SQL).fetchall(), key=str)


def test_empty_table(documents):
    assert L.scan_licenses(documents([])).collect() == []


def test_every_rule_has_an_anchor():
    for name, rule in L.RULES:
        assert all(i.removeprefix("+") in L.SENTENCES for i in rule), name
    # A word of every sentence holds an anchor, so texts without one have no sentence.
    assert all(any(a in word for word in s.split() for a in L.ANCHORS) for s in L.SENTENCES.values())


@pytest.mark.parametrize("name", sorted(L.SENTENCES))
def test_sentences_are_normalised(name):
    import re

    s = L.SENTENCES[name]
    assert re.sub("[^a-z0-9]+", " ", s.lower()).strip() == s


HEADED = "MIT License\n\nCopyright (c) 2020 X\n\n" + MIT
ISC = """ISC License

Copyright (c) 2020, X

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
BSD2 = """Copyright (c) 2020, X
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD = "BSD 3-Clause License\n\n" + BSD2.replace("THIS SOFTWARE", NAMES + "THIS SOFTWARE")
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def commented(text):
    return "".join(f" * {line}\n" for line in text.split("\n"))


@pytest.mark.parametrize("dress", [str, commented, lambda t: t.replace("\n\n", "\n")])
def test_published_files_with_headings(documents, dress):
    files = [
        (1, HEADED, "MIT"), (2, ISC, "ISC"), (3, BSD, "BSD-3-Clause BSD-style"), (4, MPL, "MPL-2.0"), (5, "See part v. Released under the MIT License.", "MIT"),
        (6, BSD2, "BSD-2-Clause BSD-style"), (7, GPL2, "GPL-2.0"), (8, GPL3, "GPL-3.0"), (9, LGPL21, "LGPL-2.1"), (10, APACHE, "Apache-2.0"),
        (11, LGPL21.replace("Lesser", "Affero").replace("library", "program").replace("2.1", "3").replace("Foundation; either", "Foundation, either"), "AGPL-3.0"),
    ]
    found = {r["doc_id"]: r for r in L.scan_licenses(documents([(d, dress(t)) for d, t, _ in files])).collect()}
    assert {d: r["licenses"] for d, r in found.items()} == {d: want for d, _, want in files}
    assert found[1]["sentence_ids"] == "mit.title2 mit.grant mit.notice mit.warranty"


def test_grant_in_a_wide_comment_box(documents):
    boxed = "".join("#" + " " * 60 + f"{line:<90}" + "#\n" for line in MIT.split("\n"))
    r = L.scan_licenses(documents([(1, boxed)])).collect()[0]
    assert (r["licenses"], r["sentence_ids"]) == ("MIT", "mit.grant mit.notice mit.warranty")
    r = L.scan_licenses(documents([(1, "\n".join(" " * 300 + line for line in MIT.split("\n")))])).collect()[0]
    assert r["sentence_ids"] == "mit.grant mit.notice mit.warranty"


def test_published_files_in_sql(documents):
    texts = [HEADED, ISC, BSD, BSD2, MPL, GPL2, GPL3, LGPL21, APACHE]
    df = documents([(i, t) for i, t in enumerate(texts + [commented(t) for t in texts] + [t.replace("\n", "\r\n") for t in texts])])
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert sorted(map(tuple, L.scan_licenses(df).collect())) == sorted(con.sql(L.ORACLE_SQL).fetchall())


def test_other_columns_are_ignored(documents):
    df = documents([(1, "Released under the MIT License.")]).withColumnsRenamed({"lang": "ids", "source": "sentence_ids", "n_chars": "licenses"})
    r = L.scan_licenses(df).collect()
    assert [tuple(x) for x in r] == [(1, 1, "mit.released", "MIT")]
