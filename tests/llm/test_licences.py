"""Licence rules on real and hostile texts."""

import re
import textwrap

import pytest

from keepsight.llm.licences import GUARD, HIDDEN, RULES, SENTENCES, gnu_notices, known, pieces, references, scan_licences

one = {k: v[0] for k, v in SENTENCES.items()}
MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(textwrap.fill(one[k], 70) for k in ("MIT-GRANT", "MIT-KEEP", "AS-IS"))
BSD2 = "\n".join(["Copyright (c) 1999, X Corp. All rights held.", "", textwrap.fill(one["BSD-GRANT"], 60), "", "1. " + textwrap.fill(one["BSD-SOURCE"], 66), "2. " + textwrap.fill(one["BSD-BINARY"], 50)])
ACME = one["BSD-NAME"].replace("the copyright holder", "Acme & Sons, Ltd")
APACHE = """Copyright 2019 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL2 = """This file is part of Frob.

Frob is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
ZLIB = "Copyright (C) 1995-2017 J and M\n\n" + textwrap.fill(one["ZLIB-AS-IS"] + " In no event will the authors be held liable.", 60) + "\n\n" + textwrap.fill(one["ZLIB-GRANT"], 60) + "\n\n1. The origin must not be misrepresented."


def commented(text, start="/*", lead=" * ", end=" */"):
    return "\n".join([start, *[lead + x for x in text.split("\n")], end, "", "int main(void) { return 0; }"])


HEADERS = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD2 + "\n3. " + ACME, "Apache-2.0": APACHE, "GPL-2.0-or-later": GPL2, "GPL-3.0-or-later": GPL2.replace("; either version 2", ", either version 3").replace("software; you", "software: you"), "LGPL-2.1-or-later": GPL2.replace("General", "Lesser General").replace("version 2", "version 2.1"), "AGPL-3.0-or-later": GPL2.replace("General", "Affero General").replace("version 2", "version 3"), "GPL-2.0-only": GPL2.replace("either version 2 of the License, or\n(at your option) any later version.", "version 2 of the\nLicense."), "Zlib": ZLIB, "ISC": "ISC License\n\nCopyright (c) 2004 Y\n\n" + textwrap.fill(one["ISC-GRANT"], 72), "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "BSL-1.0": textwrap.fill(one["BSL-GRANT"], 68), "Unlicense": one["UNLICENSE"] + "\n\nAnyone is free to copy.", "MIT-0": "MIT No Attribution\n\nCopyright 2020 Z\n\n" + textwrap.fill(one["MIT0-GRANT"] + "\n\n" + one["AS-IS"], 77), "0BSD": textwrap.fill(one["0BSD-GRANT"], 60), "BSD-4-Clause": BSD2 + "\n3. " + one["BSD-ADVERTS"] + " This product includes software of X.\n4. " + ACME}
FORMS = [lambda t: t, commented, lambda t: commented(t, "#!/bin/sh", "# ", ""), lambda t: commented(t, "//", "// ", "//"), lambda t: commented(t, "<!--", "  ", "-->"), lambda t: commented(t, "/*" + "*" * 70, " * ", " " + "*" * 70 + "/"), lambda t: commented(t, ";;", ";; ", ""), lambda t: commented(t, "--", "-- ", ""), lambda t: re.sub(r"\n\n+", "\n", t), lambda t: re.sub(r"\s+", " ", t), lambda t: t.replace("\n", "\r\n"), lambda t: t.upper(), lambda t: "   " + t.replace("\n", "\n      "), lambda t: "unfinished line\n" + re.sub(r"\n\n+", "\n", t) + "\nand a tail"]
CASES = {
    "Some prose of it.\nReleased under the MIT License.\nMore.": "MIT", "unfinished line\nReleased under the MIT License.": "MIT", "Finished.\nLicensed under the Apache\nLicense, Version 2.0. More text": "Apache-2.0",
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT", "Distributed under the terms of the MIT licence (see LICENCE).": "MIT", "It is available under the BSD 3-Clause License.": "BSD-3-Clause",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the GPLv2 or later.": "GPL-2.0-or-later", "Licensed under the GNU LGPL, version 2.1.": "LGPL-2.1", "licensed under the AGPL-3.0": "AGPL-3.0",
    "x\n# SPDX-License-Identifier: MIT\ny": "MIT", "x\nSPDX-License-Identifier: CC0-1.0\ny": "CC0-1.0", "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0-only", "// SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0",
    "SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) and LicenseRef-Own-1 ": "GPL-2.0-or-later WITH Classpath-exception-2.0,LicenseRef-Own-1", "<!-- SPDX-License-Identifier: mpl-2.0 -->": "MPL-2.0", "SPDX-License-Identifier: see the file": "", "SPDX-License-Identifier: Made-Up-9.9": "",
    "SPDX-License-Identifier: MIT\nReleased under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.\nAll rights reserved.": "all-rights-reserved,CC-BY-NC-4.0", "licensed UNDER cc by-nc 4.0!": "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0", "Mozilla Public License Version 2.0\n====\n1. Definitions": "MPL-2.0", "This mentions the MIT License. in passing": "", "\n\n".join([one["MIT-KEEP"], one["MIT-GRANT"]]): "", "the king granted permission to use the road": "", "": "", " \n ": "",
}


def test_rules(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(CASES)] + [(None, None, "x", 1), (99, "word " * 100_000 + "\nAll rights reserved.", "x", 1), (99, "word " * 100_000 + "\nAll rights reserved.", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string, a long")
    got = scan_licences(df).collect()
    want = {i: v for i, v in enumerate(CASES.values())} | {None: "", 99: "all-rights-reserved"}
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["licences"] for r in got} == want
    assert all((r["n_sentences"] == 0) == (r["sentence_ids"] == "") for r in got)
    assert scan_licences(df.limit(0)).collect() == []


def test_headers_of_files(spark):
    """Whole licence headers in comments of many languages, without empty lines, on one line, wrapped otherwise."""
    rows = [(k * 1000 + j, form(text)) for k, text in enumerate(HEADERS.values()) for j, form in enumerate(FORMS)]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(name, j, got[k * 1000 + j]["licences"], got[k * 1000 + j]["sentence_ids"]) for k, name in enumerate(HEADERS) for j in range(len(FORMS)) if got[k * 1000 + j]["licences"] != name]
    assert not wrong, "\n".join(map(str, [len(wrong), *wrong[:40]]))


@pytest.mark.parametrize("gap", ["\n", "\r\n", "  ", "\t", " ", "\n# ", "\n * ", "-"])
def test_words_may_be_apart_in_any_way(spark, gap):
    df = spark.createDataFrame([(1, f"Some prose.\nAll rights{gap}reserved.\nMore."), (2, f"All{gap}rights reserved."), (3, "reserved rights")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licences"]) for r in scan_licences(df).collect()}
    assert got == {1: (1, "RESERVED", "all-rights-reserved"), 2: (1, "RESERVED", "all-rights-reserved"), 3: (0, "", "")}


def test_guard_has_single_words():
    assert re.fullmatch("[a-z|]+", GUARD) and all(re.search(GUARD, s) for s in known())


def test_every_sentence_is_known_by_itself():
    for name, sentences in {**SENTENCES, **gnu_notices()}.items():
        for s in sentences:
            assert name in [known().get(p) for p in pieces(s)], s
    for licence, names in references().items():
        assert all(f"{licence}-REF" in [known().get(p) for p in pieces(f"Frob is released under the terms of the {n}.")] for n in names), licence
    assert {i for _, ids in RULES for i in ids} <= set(known().values()) and set(HIDDEN) <= {x for x, _ in RULES}


def test_main_path_has_no_python(spark):
    plan = scan_licences(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("(Python|Arrow|Pandas)(UDF|Eval|Map)|(Eval|Map|Groups)(In)?(Python|Arrow|Pandas)", plan)


def test_names_of_holders_stop_no_sentence(spark):
    """Real holders of three-clause texts: an abbreviated name ends in a stop, and the author may stand for the holder."""
    start = HEADERS["BSD-3-Clause"][: HEADERS["BSD-3-Clause"].lower().index("neither the name")]
    thirds = [f"Neither the name of {h} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for h in ("Google Inc.", "Example Corp.", "the Foo Bar Co., Ltd.", "the University", "The Regents of the Univ. of Somewhere", "copyright holder", "A.B.C. e.g. others")]
    thirds.append("The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.")
    got = {r["doc_id"]: r["licences"] for r in scan_licences(spark.createDataFrame(list(enumerate(start + x for x in thirds)), "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(len(thirds)), "BSD-3-Clause")
