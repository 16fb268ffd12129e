"""Licence texts as they stand in files: wrapped, with list marks, comment marks and colons."""

from meridia.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Somebody

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def rules(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["rule"]) for r in licenses.license_matches(rows).collect()}


def test_wrapped_licenses(spark):
    texts = [MIT, APACHE, GPL, BSD.format("1.", "2."), BSD.format("(a)", "(b)"), BSD.format("*", "*"), MIT.replace("\n", "\r\n"), " ".join(MIT[MIT.index("Permission") :].split())]
    want = {(k, rule) for k in (0, 6, 7) for rule in ("mit-text", "mit-full")} | {(k, "bsd2-text") for k in (3, 4, 5)}
    want |= {(1, "apache2-notice"), (1, "apache2-full"), (2, "gpl-3.0-notice"), (2, "gpl-3.0-full")}
    assert {x for x in rules(spark, texts) if x[1] != "apache-2.0-named"} == want


def test_long_runs_and_later_places(spark):
    known = dict((i, t) for i, t in licenses.SENTENCES)
    far = "\n".join(["filler"] * 3)
    late = f"{known['apache2-header']}\n{known['apache2-copy']}\n{far}\n{known['apache2-copy']}\nx\n{known['apache2-warranty']}"
    texts = ["Released under the MIT" + " " * 100_000 + "License.", late, "Not released under\nthe MIT license today.", "Not\nwholly under the MIT license"]
    assert {x for x in rules(spark, texts) if x[0] != 1} == {(0, "mit-named")}
    assert (1, "apache2-full") in rules(spark, texts)


def test_marks_before_a_sentence_and_shared_ids(spark):
    rows = [(1, "=" * 5000 + "\nReleased under the MIT License."), (None, "Permission to use.\n" + licenses.TEXTS[2][1]), (None, licenses.TEXTS[3][1]), (2, licenses.TEXTS[2][1]), (2, licenses.TEXTS[3][1]), (3, "MIT-named: Released under the MIT License."), (3, "MIT-named: Released under the MIT License.")]
    got = sorted((r["doc_id"], r["rule"], r["first_place"]) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "mit-named", 1), (3, "mit-named", 0), (3, "mit-named", 0)]


def test_all_sentences_hold_an_anchor_and_are_found(spark):
    assert len(licenses.SENTENCES) > 1000 and len(licenses.RULES) > 100
    assert all(any(a in t for a in licenses.ANCHORS) for _, t in licenses.SENTENCES)
    rows = spark.createDataFrame([(k, f"Some words.\n{t.capitalize()}.") for k, (_, t) in enumerate(licenses.SENTENCES)], "doc_id long, text string")
    found = {(r["doc_id"], r["sentence_id"]) for r in licenses.known_sentences(rows).collect()}
    assert found == {(k, i) for k, (_, t) in enumerate(licenses.SENTENCES) for i, u in licenses.SENTENCES if u == t}


MORE = {
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.",
    "mpl2-notice": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "unlicense-text": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "cc-by-sa-4.0-named": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "gpl-2.0-or-later-spdx": "// SPDX-License-Identifier: GPL-2.0-or-later",
    "bsd3-text": BSD.format("1.", "2.") + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "lgpl-2.1-full": GPL.replace("program", "library").replace("General", "Lesser General").replace("version 3", "version 2.1"),
}


def test_other_licenses(spark):
    found = rules(spark, MORE.values())
    assert {(k, rule) for k, rule in enumerate(MORE)} <= found


def named(spark, text):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r["license"] for r in licenses.license_matches(rows).collect()}


def test_longer_sentences_and_rules_take_what_they_hold(spark):
    """One licence each: three clauses aren't two, a whole grant isn't its beginning, later versions are said."""
    isc = MORE["isc-full"]
    assert named(spark, MORE["bsd3-text"]) == {"BSD-3-Clause"} and named(spark, BSD.format("1.", "2.")) == {"BSD-2-Clause"}
    assert named(spark, isc) == {"ISC"} and named(spark, isc.replace("hereby granted, provided", "hereby granted,\nprovided")) == {"ISC"}
    assert named(spark, "SPDX-License-Identifier: GPL-2.0-or-later") == {"GPL-2.0-or-later"}
    assert named(spark, "SPDX-License-Identifier: GPL-2.0-only") == {"GPL-2.0-only"} and named(spark, GPL) == {"GPL-3.0-or-later"}
    both = MORE["bsd3-text"] + "\n\nPart two.\n" + "filler.\n" * 9 + BSD.format("1.", "2.")
    assert named(spark, both) == {"BSD-3-Clause", "BSD-2-Clause"}
    assert licenses.WIDER == [("bsd3-text", "bsd2-text")]
