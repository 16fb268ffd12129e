"""License scans by sentence rules, in DataFrame operations alone.

Texts are cut into places (at line ends and after . ! ? followed by white space), and these into parts (after : ; and the
brackets of list marks). Parts are normalised: lower case, marks to spaces. Known licence sentences have identifiers; one
is found where a run of parts, one after the other, holds just its words. So a wrapped sentence is found over its lines,
and one that ends in a colon before the next on its line. It has the place where it begins. Rules are ordered sequences of
identifiers: a rule matches where its sentences follow each other in the text, each beginning within ``gap`` places after
the end of the one before (other known or unknown sentences may stand in between). Longer ones come first: where several known
sentences begin at one part, the one of the most characters is taken, and a rule takes its sentences from shorter rules of other
licences that begin with it and want nothing more, so that three clauses aren't two as well.

Every known sentence holds one of a few words, so texts without any of these are passed over after one search of the whole
text. The others are cut and normalised once; all rules work on the sentences found.

Nulls and empty texts match nothing. Rows are scanned one by one: those that share a doc_id, or have none, are texts of
their own, and repeated rows repeat their matches. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

# SPDX identifiers of licences and the names they go by.
NAMES = [
    ("MIT", "MIT License", "Expat License"),
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0 License"),
    ("GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0 License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    ("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    ("0BSD", "BSD Zero Clause License", "Zero-Clause BSD License"),
    ("ISC", "ISC License"),
    ("MPL-1.1", "Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    ("EPL-1.0", "Eclipse Public License, version 1.0", "Eclipse Public License 1.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    ("CDDL-1.0", "Common Development and Distribution License, version 1.0", "Common Development and Distribution License 1.0"),
    ("EUPL-1.2", "European Union Public License, version 1.2", "European Union Public Licence v1.2", "EUPL 1.2"),
    ("BSL-1.0", "Boost Software License, version 1.0", "Boost Software License 1.0"),
    ("Zlib", "zlib License", "zlib/libpng License"),
    ("Unlicense", "Unlicense"),
    ("WTFPL", "Do What The Fuck You Want To Public License", "WTFPL"),
    ("Artistic-2.0", "Artistic License 2.0", "Artistic License, version 2.0"),
    ("PSF-2.0", "Python Software Foundation License, version 2", "PSF License"),
    ("OFL-1.1", "SIL Open Font License, version 1.1", "SIL Open Font License 1.1"),
    ("ODbL-1.0", "Open Database License", "Open Database License v1.0", "ODC Open Database License v1.0"),
    ("ODC-By-1.0", "Open Data Commons Attribution License", "ODC Attribution License"),
    ("PDDL-1.0", "Open Data Commons Public Domain Dedication and License"),
    ("PostgreSQL", "PostgreSQL License"),
    ("MS-PL", "Microsoft Public License"),
    ("OpenRAIL-M", "CreativeML Open RAIL-M License", "CreativeML OpenRAIL-M License"),
]
#: sentences that name a licence, from the names above
NAMING = [
    "licensed under the {}", "released under the {}", "distributed under the {}", "available under the {}", "published under the {}",
    "licensed under the terms of the {}", "distributed under the terms of the {}", "released under the terms of the {}",
    "this work is licensed under the {}", "this project is licensed under the {}", "this software is licensed under the {}",
    "this project is released under the {}", "this software is released under the {}", "this file is licensed under the {}", "this code is licensed under the {}",
    "this program is licensed under the {}", "this library is licensed under the {}", "this dataset is licensed under the {}", "this package is licensed under the {}",
]
# The elements of Creative Commons licences, their names and versions.
COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
COMMONS_VERSIONS = [("3.0", "Unported"), ("4.0", "International")]
COMMONS_NAMING = [
    "licensed under CC {id} {v}", "released under CC {id} {v}", "this work is licensed under CC {id} {v}", "licensed under the CC {id} {v} license", "available under CC {id} {v}",
    "this work is licensed under a Creative Commons {name} {v} {place} License", "licensed under a Creative Commons {name} {v} {place} License", "licensed under the Creative Commons {name} {v} {place} License",
    "this work is licensed under the Creative Commons {name} {v} {place} License", "licensed under the Creative Commons {name} {v} License", "this article is licensed under a Creative Commons {name} {v} {place} License",
]
# Sentences of licence texts and notices under their identifiers.
TEXTS = [
    ("mit-title", "the MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("apache2-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl2-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense-release", "This is free and unencumbered software released into the public domain"),
    ("unlicense-free", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("zlib-warranty", "This software is provided as-is, without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("wtfpl-grant", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("cc0-waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-waiver", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law"),
    ("gpl-details", "See the GNU General Public License for more details"),
    ("lgpl-details", "See the GNU Lesser General Public License for more details"),
    ("agpl-details", "See the GNU Affero General Public License for more details"),
]
# The notices of the GNU licences, by identifier, what they cover, name and versions.
GNU = [
    ("gpl", "program", "GNU General Public License", [("GPL-2.0", "2"), ("GPL-3.0", "3")]),
    ("lgpl", "library", "GNU Lesser General Public License", [("LGPL-2.1", "2.1"), ("LGPL-3.0", "3")]),
    ("agpl", "program", "GNU Affero General Public License", [("AGPL-3.0", "3")]),
]
# Licences and the ordered sentence identifiers of their texts.
TEXT_RULES = [
    ("MIT", "mit-text", ["mit-grant", "mit-notice"]),
    ("MIT", "mit-full", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("Apache-2.0", "apache2-notice", ["apache2-header", "apache2-copy"]),
    ("Apache-2.0", "apache2-full", ["apache2-header", "apache2-copy", "apache2-warranty"]),
    ("BSD-2-Clause", "bsd2-text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", "bsd3-text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("ISC", "isc-text", ["isc-grant"]),
    ("ISC", "isc-full", ["isc-grant", "isc-warranty"]),
    ("0BSD", "0bsd-full", ["0bsd-grant", "isc-warranty"]),
    ("MPL-2.0", "mpl2-notice", ["mpl2-header", "mpl2-copy"]),
    ("Unlicense", "unlicense-text", ["unlicense-release", "unlicense-free"]),
    ("BSL-1.0", "boost-text", ["boost-grant"]),
    ("Zlib", "zlib-text", ["zlib-warranty", "zlib-grant"]),
    ("WTFPL", "wtfpl-text", ["wtfpl-grant"]),
    ("CC0-1.0", "cc0-text", ["cc0-waiver"]),
]
#: Java patterns between places, between parts of a place, and of what normalisation turns into one space
SENTENCE_END = r"(?:\r?\n)+|(?<=[.!?])\s+"
PART_END = r"(?<=[:;])\s+|(?<=\))(?=\s)(?<=^\s{0,40}[^\p{L}\p{N}\s]{0,4}\s{0,4}\(?[0-9A-Za-z]{1,4}\))\s+"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: every known sentence holds one of these words
ANCHORS = ["license", "licence", "licensed", "permission", "redistribution", "redistributions", "warranty", "warranties", "copyright", "unencumbered", "mpl", "anyone", "released", "distributed", "available", "published", "permitted"]


def _plain(text: str) -> str:
    """An ASCII text normalised as the scanned ones are."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def _tables() -> tuple[list[tuple[str, str]], list[tuple[str, str, list[str]]]]:
    """Known sentences as (identifier, normalised text), and rules as (licence, rule, identifiers in order)."""
    sentences, rules = list(TEXTS), list(TEXT_RULES)
    names = {spdx: [form.format(name) for name in found for form in NAMING] for spdx, *found in NAMES}
    for version, place in COMMONS_VERSIONS:
        for short, name in COMMONS:
            names[f"CC-{short}-{version}"] = [form.format(id=short, name=name, v=version, place=place) for form in COMMONS_NAMING]
    names["CC0-1.0"] = [f"{verb} under {the}" for verb in ("licensed", "released", "this work is licensed") for the in ("CC0 1.0", "the CC0 1.0 Universal License", "CC0 1.0 Universal")]
    for spdx, forms in names.items():
        key = spdx.lower()
        sentences += [(f"{key}-name", form) for form in forms]
        rules.append((spdx, f"{key}-named", [f"{key}-name"]))
        for more in ("", "-only", "-or-later"):
            sentences.append((f"{key}{more}-spdx", f"SPDX-License-Identifier: {spdx}{more}"))
            rules.append((f"{spdx}{more}", f"{key}{more}-spdx", [f"{key}{more}-spdx"]))
    for kind, thing, name, versions in GNU:
        sentences.append((f"{kind}-warranty", f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"))
        for spdx, version in versions:
            key = spdx.lower()
            sentences += [(f"{key}-grant", f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version") for mark in ":;"]
            rules += [(f"{spdx}-or-later", f"{key}-notice", [f"{key}-grant", f"{kind}-warranty"]), (f"{spdx}-or-later", f"{key}-full", [f"{key}-grant", f"{kind}-warranty", f"{kind}-details"])]
    # one wording may serve several identifiers: the warranty of two GNU notices is the same
    return sorted({(k, _plain(t)) for k, t in sentences}), rules


SENTENCES, RULES = _tables()


def _wider() -> list[tuple[str, str]]:
    """(longer, shorter): rules of different licences where the longer holds all the shorter's sentences in order, from the first on."""
    within = lambda short, long: all(i in rest for rest in [iter(long)] for i in short)
    by_first: dict[str, list] = {}
    for name, rule, ids in RULES:
        by_first.setdefault(ids[0], []).append((name, rule, ids))
    return sorted((b[1], a[1]) for found in by_first.values() for a in found for b in found if a[0] != b[0] and len(b[2]) > len(a[2]) and within(a[2], b[2]))


#: a match of the first takes the sentences of a match of the second that begins with it
WIDER = _wider()


def _fixed(spark: SparkSession, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """A fixed table of at most some thousand rows, made of literals, so that it may be broadcast."""
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS fixed({', '.join(names)})"))


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def known_sentences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, part, last_part, place, last_place, sentence_id): the known licence sentences of each row.

    Parts count those of the text that hold words, places all pieces between sentence and line ends.
    """
    known = _fixed(docs.sparkSession, SENTENCES, ["sentence_id", "sentence"]).withColumn("opening", F.substring_index("sentence", " ", 1))
    longest = max(len(t.split(" ")) for _, t in SENTENCES)
    # what a run of parts may begin with: the words of a known sentence up to one of its spaces, or all of it
    begins = sorted({" ".join(words[: k + 1]) for _, t in SENTENCES for words in [t.split(" ")] for k in range(len(words))})

    def parts(piece: Column, place: Column) -> Column:
        return F.transform(F.split(piece, PART_END), lambda t: F.struct(place.alias("place"), normalised(t).alias("words")))

    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.where(F.lower("text").rlike("|".join(ANCHORS)))
    cut = F.flatten(F.transform(F.split(F.col("text"), SENTENCE_END), parts))
    rows = rows.select("row", "doc_id", F.filter(cut, lambda p: p["words"] != "").alias("parts"))
    rows = rows.withColumn("numbered", F.transform("parts", lambda p, k: F.struct(k.alias("part"), p["words"].alias("words"))))
    begin = F.expr("filter(numbered, p -> p.words IN (" + ", ".join(f"'{b}'" for b in begins) + "))")

    def run(part: Column) -> Column:
        ahead = F.slice("parts", part["part"] + 1, longest)
        return F.struct(part["part"].alias("part"), F.array_join(ahead["words"], "\n").alias("ahead"), ahead["place"].alias("places"))

    rows = rows.select("row", "doc_id", F.inline(F.transform(begin, run)))
    rows = rows.withColumn("flat", F.translate("ahead", "\n", " "))
    end = F.length("sentence")
    same = (F.substring_index("flat", " ", 1) == F.col("opening")) & F.col("flat").startswith(F.col("sentence"))
    rows = rows.join(known, same & F.substring("ahead", end + 1, F.lit(1)).isin("", "\n"))
    over = F.size(F.split(F.substring("ahead", F.lit(1), end), "\n")) - 1
    rows = rows.withColumn("longest", F.max(end).over(Window.partitionBy("row", "part"))).where(end == F.col("longest"))
    return rows.select(
        "row", "doc_id", "part", (F.col("part") + over).alias("last_part"), F.col("places")[0].alias("place"),
        F.col("places")[over].alias("last_place"), "sentence_id",
    ).distinct()


def license_matches(docs: DataFrame, gap: int = 5) -> DataFrame:
    """(doc_id, license, rule, first_place, last_place): every place at which a rule's sentences stand in order.

    From each sentence that opens a rule, each next sentence the rule wants must begin within ``gap`` places of the end of
    the one before. All ways are tried; a rule's sentences are taken from narrower rules (``WIDER``); ``last_place`` is where the last sentence begins in the one that ends first.
    """
    found = materialise(known_sentences(docs), "known-sentences")
    out = None
    for depth in sorted({len(ids) for _, _, ids in RULES}):
        rules = [(name, rule, *ids) for name, rule, ids in RULES if len(ids) == depth]
        names = [f"s{k}" for k in range(depth)]
        table = _fixed(docs.sparkSession, rules, ["license", "rule", *names])
        rows = found.join(table, F.col("sentence_id") == F.col("s0")).withColumn("first_place", F.col("place"))
        for name in names[1:]:
            rows = _followed(rows, found, name, gap)
        rows = rows.groupBy("row", "doc_id", "license", "rule", "first_place").agg(F.min("place").alias("last_place"))
        out = rows if out is None else out.unionByName(rows)
    out = materialise(out, "license-rules")
    wider = _fixed(docs.sparkSession, WIDER, ["longer", "shorter"])
    taken = out.join(wider, F.col("rule") == F.col("longer")).select("row", "first_place", F.col("shorter").alias("rule")).distinct()
    return out.join(taken, ["row", "first_place", "rule"], "left_anti").select("doc_id", "license", "rule", "first_place", "last_place")


def _followed(rows: DataFrame, found: DataFrame, wanted: str, gap: int) -> DataFrame:
    """``rows`` moved on to each sentence of the column ``wanted`` that begins within ``gap`` places after their end."""
    here = ["part", "last_part", "place", "last_place", "sentence_id"]
    kept = [c for c in rows.columns if c not in ("row", *here)]
    ends = rows.select("row", F.col("last_place").alias("at"), F.col("last_part").alias("end"), F.struct(kept).alias("kept"))
    begins = found.select("row", F.col("place").alias("at"), F.struct(here).alias("next"))
    near = Window.partitionBy("row").orderBy("at").rangeBetween(0, gap)
    both = ends.unionByName(begins, allowMissingColumns=True).withColumn("ahead", F.collect_list("next").over(near))
    both = both.where("kept IS NOT NULL").select("row", "end", "kept.*", F.explode("ahead").alias("next"))
    return both.where((F.col("next.part") > F.col("end")) & (F.col("next.sentence_id") == F.col(wanted))).select("row", *kept, "next.*").distinct()


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_matches(docs)
