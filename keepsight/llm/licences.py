"""Licence scans by sentence rules (operator 2), in DataFrame functions only.

A text is split into sentences, each is normalised and looked up among known
licence sentences. The identifiers found, in order, form a sequence that is
matched against ordered licence rules: a rule names identifiers that must
follow each other in this order, and what else a text says between them does
not matter. A rule that holds hides the rules it contains. SPDX tags are read
as expressions, and give every licence that they name.

Sentences survive what files do to them: comment leaders at the start of lines
go first; a sentence may be wrapped anywhere; it ends at a stop, at an empty
line, at an aside that points elsewhere, and before the words that known
sentences begin with, as a heading or a copyright line above has no stop.
Normalising leaves lower-case letters and digits, drops words that references
to a licence use or leave out at will, and the names of holders.

Texts without any word that all known sentences have one of skip the work; the
guard has single words only, as the space between two may be anything in the
text, so it can't miss a sentence.

Defined cases: null and empty texts have no licence; a null doc_id stays null;
repeated rows each get an output row; an empty table gives no rows; further
columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.llm.tables import own_columns

# Sentences of well-known licences and notices, by identifier. They are normalised when used.
SENTENCES = {
    "MIT-NAME": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MIT0-GRANT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'],
    "MIT-KEEP": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "AS-IS": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "ISC-GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD-GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "BSD-GRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSD-BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-ADVERTS": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "BSD-NAME": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", "The names of the authors may not be used to endorse or promote products derived from this software without specific prior written permission."],
    "APACHE-COPY": ["You may obtain a copy of the License at"],
    "APACHE-TERMS": ["See the License for the specific language governing permissions and limitations under the License."],
    "APACHE-TEXT": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "GPL-TEXT": ["GNU GENERAL PUBLIC LICENSE"], "LGPL-TEXT": ["GNU LESSER GENERAL PUBLIC LICENSE"], "AGPL-TEXT": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "GNU-2": ["Version 2, June 1991"], "GNU-2.1": ["Version 2.1, February 1999"], "GNU-3": ["Version 3, 29 June 2007"], "AGNU-3": ["Version 3, 19 November 2007"],
    "GPL-WARRANTY": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "MPL2-NOTICE": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "MPL2-TEXT": ["Mozilla Public License Version 2.0"],
    "EPL2-NOTICE": ["available under the terms of the Eclipse Public License 2.0 which is available at", "available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at"],
    "EPL1-NOTICE": ["available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"],
    "BSL-GRANT": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain."],
    "ZLIB-AS-IS": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZLIB-GRANT": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "WTFPL-TEXT": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "CC0-DEDICATION": ["This work is dedicated to the public domain under the CC0 license."],
    "RESERVED": ["All rights reserved."],
}
# Names that references use, by licence.
NAMES = {
    "MIT": ["MIT", "MIT License", "Expat License", "MIT/Expat License"], "MIT-0": ["MIT-0", "MIT No Attribution License"], "ISC": ["ISC", "ISC License"], "0BSD": ["0BSD", "Zero-Clause BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD-2-Clause License", "2-clause BSD License", "BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD-3-Clause License", "3-clause BSD License", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "Apache-2.0": ["Apache-2.0", "Apache-2.0 License", "Apache License 2.0", "Apache 2.0 License", "Apache 2 License", "Apache Software License 2.0", "ASL 2.0"],
    "GPL-2.0": ["GPL-2.0", "GPLv2", "GPL version 2", "GNU GPL version 2", "GNU GPLv2", "GNU General Public License version 2", "GNU General Public License version 2.0", "GNU General Public License (GPL) version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GPL-3.0", "GPLv3", "GPL version 3", "GNU GPL version 3", "GNU GPLv3", "GNU General Public License version 3", "GNU General Public License version 3.0", "GNU General Public License (GPL) version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["LGPL-2.1", "LGPLv2.1", "GNU LGPL version 2.1", "GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["LGPL-3.0", "LGPLv3", "GNU LGPL version 3", "GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["AGPL-3.0", "AGPLv3", "GNU AGPL version 3", "GNU AGPLv3", "GNU Affero General Public License version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License version 2.0", "Mozilla Public License v2.0"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License version 2.0"], "EPL-1.0": ["EPL-1.0", "Eclipse Public License 1.0"], "BSL-1.0": ["BSL-1.0", "Boost Software License", "Boost Software License 1.0", "Boost License"],
    "Zlib": ["Zlib", "zlib License", "zlib/libpng License"], "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "Artistic-2.0": ["Artistic License 2.0"], "PSF-2.0": ["PSF License", "Python Software Foundation License version 2"], "MS-PL": ["Microsoft Public License"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"],
}
# Creative Commons licences, by their parts.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
# GNU families and the versions of each.
GNU = {"GPL": ("", ("2", "3")), "LGPL": ("Lesser ", ("2.1", "3")), "AGPL": ("Affero ", ("3",))}
# SPDX identifiers that tags are checked against, besides LicenseRef-* ones. Deprecated ones stand for those they were replaced by.
SPDX_IDS = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0
BlueOak-1.0.0 CAL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NTP OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
REPLACED = {f"{f}-{v}.0{plus}" if v != "2.1" else f"{f}-{v}{plus}": f"{f}-{v if v == '2.1' else v + '.0'}-{'or-later' if plus else 'only'}" for f, (_, vs) in GNU.items() for v in vs for plus in ("", "+")}
# Ordered rules: a licence and the identifiers that must follow each other. Rules of one licence are alternatives.
RULES = [
    ("MIT", ["MIT-GRANT", "MIT-KEEP", "AS-IS"]), ("MIT", ["MIT-NAME", "MIT-GRANT"]), ("MIT-0", ["MIT0-GRANT", "AS-IS"]), ("ISC", ["ISC-GRANT"]), ("0BSD", ["0BSD-GRANT"]),
    ("BSD-4-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERTS", "BSD-NAME"]), ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAME"]), ("BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("Apache-2.0", ["Apache-2.0-REF", "APACHE-COPY", "APACHE-TERMS"]), ("Apache-2.0", ["APACHE-TEXT"]),
    ("GPL-2.0", ["GPL-TEXT", "GNU-2"]), ("GPL-3.0", ["GPL-TEXT", "GNU-3"]), ("LGPL-2.1", ["LGPL-TEXT", "GNU-2.1"]), ("LGPL-3.0", ["LGPL-TEXT", "GNU-3"]), ("AGPL-3.0", ["AGPL-TEXT", "AGNU-3"]),
    ("MPL-2.0", ["MPL2-NOTICE"]), ("MPL-2.0", ["MPL2-TEXT"]), ("EPL-2.0", ["EPL2-NOTICE"]), ("EPL-1.0", ["EPL1-NOTICE"]), ("BSL-1.0", ["BSL-GRANT"]), ("Unlicense", ["UNLICENSE"]), ("Zlib", ["ZLIB-AS-IS", "ZLIB-GRANT"]), ("WTFPL", ["WTFPL-TEXT"]), ("CC0-1.0", ["CC0-DEDICATION"]), ("all-rights-reserved", ["RESERVED"]),
]
#: Licences that a longer one contains.
HIDDEN = {"BSD-2-Clause": ["BSD-3-Clause", "BSD-4-Clause"], "BSD-3-Clause": ["BSD-4-Clause"], "0BSD": ["ISC"]}
#: Every known sentence has one of these words, or parts of words, when normalised.
GUARD = "licen|permission|redistribut|warrant|reserved|unencumbered|public|advertising|reproduction|june|february|november|under|obtain|derivative|spdx"
# Patterns, alike in Spark and DuckDB.
LEADERS = r"(^|[\r\n])[ \t]*(?:[-/*#;%>|!<]+|dnl[ \t])?[ \t]*"
STOPS = r"([.!?:][\"')\]]*)[ \t\r\n]+"
#: Stops that end a word, not a sentence, as it goes on in lower case.
ABBREVIATIONS = r"\b((?i:inc|ltd|corp|co|llc|gmbh|univ|dept|e\.g|i\.e|u\.s|a\.k\.a|et al|etc|jr|dr)|[A-Z])\.(?=[ \t\r\n]+[a-z])"
EMPTY_LINES, LINE_ENDS = r"[\r\n][ \t]*[\r\n][ \t\r\n]*", r"[\r\n]+"
#: Asides after a reference: "(the "License")", "- see LICENSE", ", see there".
ASIDES = r"(?i)[ \t\r\n]*[-–—,(]+[ \t\r\n]*(the[ \t\r\n]+[\"']|see[ \t\r\n])"
SHORT_VERSION = r"\b[vV]\.[ \t\r\n]*([0-9])"
#: What normalising does, in order: pattern and replacement ($1 in Spark, \1 in DuckDB).
NORMAL = [
    (r"[^a-z0-9]+", " "),
    (r"\blicence", "license"),
    (r"\bv([0-9])", "{1}"),
    (r"\b(?:the|a|an|version|terms|conditions|of|and)\b", ""),
    (r"\b(gpl|lgpl|agpl)([0-9])", "{1} {2}"),
    (r" +", " "),
    (r"^ | $", ""),
    (r"^(?:licensed|released|distributed|available|provided|published|offered) under ", "under "),
    (r"^neither name .* nor names?( its)? contributors", "neither name nor contributors"),
]
#: Known headings, which stand on a line of their own.
TITLES = "MIT-NAME GPL-TEXT LGPL-TEXT AGPL-TEXT GNU-2 GNU-2.1 GNU-3 AGNU-3 MPL2-TEXT WTFPL-TEXT APACHE-TEXT".split()
SPDX_TAG, OPERAND = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)", r"^\(*[A-Za-z0-9.+-]+(?: +(?i:with) +[A-Za-z0-9.+-]+)?\)*$"
BREAK = "\u0001"


def gnu_notices() -> dict[str, list[str]]:
    """Notices by which GNU licences are applied, by identifier."""
    out: dict[str, list[str]] = {}
    for family, (kind, versions) in GNU.items():
        for v in versions:
            start = f"you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License"
            full = v if "." in v else f"{v}.0"
            out[f"{family}-{full}-or-later"] = [f"{start} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.", f"{start} as published by the Free Software Foundation, either version {v} of the License, or any later version."]
            out[f"{family}-{full}-only"] = [f"{start} as published by the Free Software Foundation, version {v} of the License.", f"{start} as published by the Free Software Foundation, version {v}.", f"{start} version {v} as published by the Free Software Foundation.", f"{start}, version {v}, as published by the Free Software Foundation."]
    return out


def references() -> dict[str, list[str]]:
    """Licence by name, as "licensed under ..." goes on, by licence."""
    out = {licence: list(names) for licence, names in NAMES.items()}
    for parts, words in CC_PARTS.items():
        for version, place in CC_VERSIONS.items():
            short = [f"CC {parts} {version}", f"CC-{parts}-{version}"]
            long = [f"Creative Commons {words} {version}", f"Creative Commons {words} {version} {place}"]
            out[f"CC-{parts}-{version}"] = [x + end for x in (*short, *long) for end in ("", " License")]
    for family in GNU:
        for licence in [x for x in out if x.startswith(f"{family}-")]:
            out[f"{licence}-or-later"] = [f"{x}{end}" for x in out[licence] for end in (" or later", " or any later version", " or (at your option) any later version", ", or later")]
    return out


def starters() -> str:
    """Words before which a sentence begins, whatever comes before them."""
    verbs = r"(?:licensed|released|distributed|available|provided|published|offered)\s+under"
    firsts = ["permission is hereby", "permission to use", "permission is granted", "the above copyright notice and", "the software is provided", "this software is provided", "redistribution and use", "redistributions of", "redistributions in", "all advertising", "neither the name", "the names? of the authors?", "you may obtain", "see the license", "you can redistribute it", "this program is distributed", "this source code form", "this is free and", "this work is dedicated", "all rights reserved"]
    return r"(?i)\b((?:" + "|".join([verbs, r"copyright\s+(?:\(c\)|©|[0-9]{4})", *[re.sub(" ", r"\\s+", x) for x in firsts]]) + r")\b|https?://)"


def title_lines() -> str:
    names = sorted({re.sub(r"[^A-Za-z0-9]+", r"[^A-Za-z0-9\\r\\n]+", x.strip(".:()")) for t in TITLES for x in SENTENCES[t]}, key=len, reverse=True)
    return r"(?i)(^|[\r\n])[ \t]*(" + "|".join(names) + r")[ \t.):]*([\r\n]|$)"


#: Cuts in order: pattern and replacement.
CUTS = [(r"\r\n?", "\n"), (SHORT_VERSION, "v{1}"), (LEADERS, "{1}"), (title_lines(), "{1}" + BREAK + "{2}" + BREAK + "{3}"), (EMPTY_LINES, BREAK), (ABBREVIATIONS, "{1}"), (STOPS, "{1}" + BREAK), (starters(), BREAK + "{1}"), (ASIDES, BREAK + "{1}"), (LINE_ENDS, " ")]


def normal(sentence: str) -> str:
    s = sentence.lower()
    for pattern, to in NORMAL:
        s = re.sub(pattern, to.replace("{1}", r"\1").replace("{2}", r"\2"), s)
    return s


def pieces(text: str) -> list[str]:
    """The sentences of a text, as the columns cut them."""
    for pattern, to in CUTS:
        text = re.sub(pattern, lambda m, to=to: re.sub(r"\{(\d)\}", lambda k: m[int(k[1])] or "", to), text)
    return [x for x in map(normal, text.split(BREAK)) if x]


def known() -> dict[str, str]:
    """Identifier of each normalised sentence. A sentence that is cut itself is known by its longest part."""
    out: dict[str, str] = {}
    for name, sentences in {**SENTENCES, **gnu_notices()}.items():
        for s in sentences:
            out[max(pieces(s), key=len)] = name
    for licence, names in references().items():
        for name in names:
            out[normal(f"licensed under {name}")] = f"{licence}-REF"
    return out


def rules() -> list[tuple[str, list[str]]]:
    """All ordered rules: those of texts, then GNU notices (with or without the warranty after them) and references."""
    return [*RULES, *((name, [name]) for name in gnu_notices()), *((licence, [f"{licence}-REF"]) for licence in references())]


def rule_patterns() -> list[tuple[str, str]]:
    """(licence, pattern over ',A,,B,'); rules of one licence are alternatives."""
    found: dict[str, list[str]] = {}
    for licence, ids in rules():
        found.setdefault(licence, []).append(".*".join(f",{re.escape(i)}," for i in ids))
    return [(licence, "|".join(p)) for licence, p in found.items()]


def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to.replace("{1}", "$1").replace("{2}", "$2").replace("{3}", "$3"))
    return text


def spdx_names() -> dict[str, str]:
    return {x.lower(): x for x in SPDX_IDS} | {old.lower(): new for old, new in REPLACED.items()}


def spdx_licences(text: Column) -> Column:
    """Every licence that the SPDX tags of a text name, exceptions with it; tags that are no expressions, and unknown licences, give none."""
    names = F.create_map(*[F.lit(x) for pair in spdx_names().items() for x in pair])
    expressions = F.transform(F.regexp_extract_all(text, F.lit(SPDX_TAG), F.lit(1)), lambda x: F.regexp_replace(x, r"[ \t]*(?:\*+/|-+>|[\"'#]+)?[ \t]*$", ""))
    operands = F.transform(expressions, lambda x: F.split(x, r" +(?i:and|or) +"))
    valid = F.flatten(F.filter(operands, lambda xs: F.forall(xs, lambda x: x.rlike(OPERAND))))

    def licence(x):
        bare = F.translate(x, "()", "")
        first, exception = F.regexp_extract(bare, "^([^ ]+)", 1), F.regexp_extract(bare, r" +(?i:with) +(.+)$", 1)
        name = F.when(first.rlike("^(?i:LicenseRef|DocumentRef)-"), first).otherwise(F.try_element_at(names, F.lower(first)))
        return F.when(exception == "", name).otherwise(F.concat_ws(" WITH ", name, exception))

    return F.array_distinct(F.filter(F.transform(valid, licence), lambda x: x.isNotNull() & ~x.startswith("WITH")))


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_sentences (known ones), sentence_ids, licences; lists are comma-separated, licences in order of the rules, then of the tags."""
    text = F.coalesce("text", F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    found = (
        own_columns(docs, ["doc_id", "text"])
        .withColumn("guarded", F.when(F.lower(text).rlike(GUARD), text).otherwise(""))
        .withColumn("ids", F.transform(F.split(replaced(F.col("guarded"), CUTS), BREAK), lambda s: F.try_element_at(table, replaced(F.lower(s), NORMAL))))
        .withColumn("ids", F.filter("ids", lambda i: i.isNotNull()))
        .withColumn("line", F.array_join(F.transform("ids", lambda i: F.concat(F.lit(","), i, F.lit(","))), ""))
    )
    holds = {licence: F.col("line").rlike(p) for licence, p in rule_patterns()}

    def shown(licence):
        for longer in HIDDEN.get(licence, []):
            holds[licence] = holds[licence] & ~F.col("line").rlike(dict(rule_patterns())[longer])
        return F.when(holds[licence], licence)

    by_rule = F.filter(F.array(*map(shown, list(holds))), lambda x: x.isNotNull())
    listed = F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(by_rule)
    tagged = F.when(F.col("guarded") == "", F.array().cast("array<string>")).otherwise(spdx_licences(F.col("guarded")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct(F.concat(listed, tagged)), ",").alias("licences"))


def oracle() -> str:
    """DuckDB's SQL in another way: known sentences are looked for in the whole normalised text, wherever sentences end, and rules walk over what is found."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = sorted(known().items(), key=lambda x: -len(x[0]))
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in sentences) + "}"
    t = "lower(coalesce(text, ''))"
    for pattern, to in NORMAL:
        pattern = pattern.replace("^(?:licensed", r"\b(?:licensed").replace("^neither", r"\bneither")
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    patterns = dict(rule_patterns())
    names = []
    for licence, p in patterns.items():
        hidden = "".join(f" AND NOT regexp_matches(line, {quoted(patterns[x])})" for x in HIDDEN.get(licence, []))
        names.append(f"CASE WHEN regexp_matches(line, {quoted(p)}){hidden} THEN {quoted(licence)} END")
    spdx = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in spdx_names().items()) + "}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
n AS (SELECT rid, doc_id, {table} AS known, {spdx} AS names, text, {t} AS t FROM d),
f AS (SELECT doc_id, names, text, list_transform(regexp_extract_all(t, {quoted(chr(92) + "b(?:" + "|".join(k for k, _ in sentences) + ")" + chr(92) + "b")}), lambda s: known[s]) AS ids FROM n),
o AS (SELECT *, coalesce(list_aggregate(list_transform(ids, lambda i: ',' || i || ','), 'string_agg', ''), '') AS line,
             list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)SPDX-License-Identifier: *([A-Za-z0-9.+-]+)', 1), lambda x: names[lower(x)]), lambda x: x IS NOT NULL) AS tagged FROM f)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_concat(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL), list_filter(tagged, lambda x: NOT list_contains([{", ".join(names)}], x))), ',') AS licences
FROM o
"""
