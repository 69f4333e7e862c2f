"""Licence scans by canonical digests (native: DataFrame functions only)."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import named, row_key

#: Equivalent spellings, replaced as whole words (fixed values: the usual list of varietal words).
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "catalogue": "catalog", "centre": "center",
    "customisation": "customization", "customise": "customize", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts (fixed values): public licence texts, and the one-line notices that name a licence.
KNOWN = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    ),
    (
        "BSL-1.0",
        """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    *((f"CC-{kind}-{version}", f"{verb} CC {kind} {version}.") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0") for verb in ("Licensed under", "This work is licensed under", "Released under")),
    *(
        (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.")
        for kind, name in (("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    ),
    *((name, f"Licensed under the {title}.") for name, title in (("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"))),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
]
#: Whole licence texts, a file per licence, and the line that ends the terms of some; an appendix follows it.
TEXTS, END = Path(__file__).with_name("license_texts"), "END OF TERMS AND CONDITIONS"
#: A copyright line names a year, (c), a holder or that rights are reserved; lines of licence texts that merely begin with
#: "copyright notice ..." or with the list mark "(c)" are none.
_NAMED = r"(?=[^\n]*(?:\b\d{4}\b|©|all rights reserved))"
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}©(\n]*(?:copyright\b(?:" + _NAMED + r"|(?=[^\n]*\(c\))|(?![ \t]*(?:(?:notices?|holders?|owners?|licen[sc]es?|laws?|statements?|and|or|in|to|on|is|interests?|protection|permissions?|disclaimers?|treaty)\b|[^\p{L}\p{N}\n]*$)))"
    r"|\(c\)(?:" + _NAMED + r"|(?=(?:[ \t]+(?!(?:you|the|an?|if|in|any|to|for|each|all)\b)[^\s]+){1,5}[ \t]*$))|©|all rights reserved)[^\n]*$"
)


def known_texts() -> list[tuple[str, str]]:
    """KNOWN and the texts of TEXTS, those with an appendix also without it."""
    out = list(KNOWN)
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        out.append((file.stem, text))
        if END in text:
            terms = text[: text.index(END)]
            out += [(file.stem, terms), (file.stem, terms + END)]
    return out


def canonical(text: Column) -> Column:
    """text (null: empty) in lower case, without licence titles' and copyright lines, punctuation and list
    marks, in one spelling, its words joined by one space. Text of copyright lines alone is empty."""
    own = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    own = F.regexp_replace(own, r"(?m)^[ \t]*(?:the )?[\p{L}\p{N}.\- ]{1,40} licen[sc]e[ \t]*(?:\([^)\n]*\))?[ \t]*$", " ")
    own = F.regexp_replace(own, r"(?m)^[ \t]*(?:\d{1,2}|[a-z])[.)][ \t]", " ")
    own = F.concat(F.lit(" "), F.regexp_replace(own, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(own, " "), lambda w: F.coalesce(F.try_element_at(words, w), w)), " ")
    odd = own.rlike(r" (?:" + "|".join(SPELLINGS) + ") ")
    return F.trim(F.when(odd, spelt).otherwise(own))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and _digest of the known texts; a digest of several licences has the first by name."""
    table = spark.createDataFrame(known_texts() if known is None else known, "license_id string, _known string").select("license_id", digest(F.col("_known")).alias("_digest"))
    return table.groupBy("_digest").agg(F.min("license_id").alias("license_id"))


def needed_words(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> list[str] | None:
    """Words of which every text with a known digest holds one, as it stands but for its case: of each known text's canonical form
    (a fixed short list) the longest word that no spelling rule touches. None if a known text has no such word."""
    table = spark.createDataFrame(known_texts() if known is None else known, "license_id string, _known string").select(canonical(F.col("_known")).alias("_own")).distinct()
    odd = set(SPELLINGS) | {w for v in SPELLINGS.values() for w in v.split()}
    out = set()
    for text in (r[0] for r in table.collect()):
        words = [w for w in text.split() if w not in odd and w.isascii()]
        if not words:
            return None
        out.add(max(words, key=lambda w: (len(w), w)))
    return sorted(out)


def _may_hold(text: Column, words: list[str] | None) -> Column:
    if words is None:
        return F.lit(True)
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words], F.lit(False))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of docs: key, text_digest (of the canonical text), license_id (the known text that the
    whole text is, else null), notice_ids (sorted, of its lines that are known texts as a whole) and n_notices.

    Known digests are a fixed short list, so both joins are broadcast. Null and empty texts, and texts of
    copyright lines alone, match nothing. Null keys are kept, repeated rows give repeated results, empty
    input an empty result. Columns other than key and text are not read.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known))
    rows = docs.select(named(key).alias("_key"), named(text).alias("_text"))
    row = row_key("_key", "_text").alias("_row")
    whole = rows.select("_key", "_text", digest(F.col("_text")).alias("text_digest"))
    whole = whole.join(table.withColumnRenamed("_digest", "text_digest"), "text_digest", "left")
    # only lines that hold a word of a known text can be one; others need no canonical form
    words = needed_words(docs.sparkSession, known)
    lines = rows.filter(_may_hold(F.col("_text"), words)).select("_key", row, F.explode(F.split("_text", "\n")).alias("_line"))
    lines = lines.filter((F.col("_line") != "") & _may_hold(F.col("_line"), words))
    found = lines.select("_row", digest(F.col("_line")).alias("_digest")).join(table, "_digest")
    # repeated rows share a row hash and have the same notices
    lists = found.groupBy("_row", "license_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("_row").agg(F.sort_array(F.collect_list("license_id")).alias("notice_ids"), F.sum("_n").alias("_all"))
    times = rows.groupBy(row).agg(F.count(F.lit(1)).alias("_times"))
    got = whole.select("*", row).drop("_text").join(lists.join(times, "_row"), "_row", "left")
    n = F.coalesce((F.col("_all") / F.col("_times")).cast("long"), F.lit(0).cast("long"))
    return got.select(F.col("_key").alias(key), "text_digest", "license_id", F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"), n.alias("n_notices"))


#: What makes a line that begins with "copyright" or "(c)" a copyright line, and words behind "copyright" that make it none (COPYRIGHT_LINE in parts).
_YEARS, _TERMS = r"\b\d{4}\b|©|all rights reserved", r"notices?|holders?|owners?|licen[sc]es?|laws?|statements?|and|or|in|to|on|is|interests?|protection|permissions?|disclaimers?|treaty"


def copyright_sql(line: str) -> str:
    """Whether a lower-case line is a copyright line, without lookahead, which the SQL engine's patterns lack."""
    lead = r"^[^\p{L}\p{N}©(]*"
    rest = lambda mark: f"regexp_extract({line}, '{lead}{mark}(.*)$', 1)"
    after, behind = rest(r"copyright\b"), rest(r"\(c\)")
    return f"""(regexp_matches({line}, '{lead}copyright\\b') AND (regexp_matches({after}, '{_YEARS}|\\(c\\)') OR NOT regexp_matches({after}, '^[ \\t]*(?:(?:{_TERMS})\\b|[^\\p{{L}}\\p{{N}}]*$)'))
        OR regexp_matches({line}, '{lead}\\(c\\)') AND (regexp_matches({behind}, '{_YEARS}') OR regexp_full_match({behind}, '(?:[ \\t]+[^\\s]+){{1,5}}[ \\t]*') AND NOT regexp_matches({behind}, '[ \\t](?:you|the|an?|if|in|any|to|for|each|all)\\b'))
        OR regexp_matches({line}, '{lead}(?:©|all rights reserved)'))"""


def canonical_sql(text: str) -> str:
    """canonical() as DuckDB SQL."""
    own = f"array_to_string(list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: CASE WHEN {copyright_sql('l')} THEN ' ' ELSE l END), chr(10))"
    for pattern in (
        r"(?m)^[ \t]*(?:the )?[\p{L}\p{N}.\- ]{1,40} licen[sc]e[ \t]*(?:\([^)\n]*\))?[ \t]*$",
        r"(?m)^[ \t]*(?:\d{1,2}|[a-z])[.)][ \t]",
        r"[^\p{L}\p{N}]+",
    ):
        own = f"regexp_replace({own}, '{pattern}', ' ', 'g')"
    words = ", ".join(f"'{k}': '{v}'" for k, v in SPELLINGS.items())
    return f"trim(array_to_string(list_transform(string_split({own}, ' '), lambda w: coalesce(MAP {{{words}}}[w], w)), ' '), ' ')"


def scan_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """scan_licenses() as DuckDB SQL, for keys that do not repeat: the same texts and rules."""
    known = ", ".join("('{}', '{}')".format(name, own.replace("'", "''")) for name, own in known_texts())
    return f"""
        WITH known AS (SELECT sha256({canonical_sql("own")}) AS digest, min(name) AS license_id FROM (VALUES {known}) AS t(name, own) GROUP BY 1),
        whole AS (SELECT {key}, sha256({canonical_sql(text)}) AS text_digest FROM {table}),
        lines AS (SELECT {key}, sha256({canonical_sql("line")}) AS digest FROM (SELECT {key}, unnest(string_split({text}, chr(10))) AS line FROM {table}) WHERE line <> ''),
        found AS (SELECT {key}, list_sort(list(DISTINCT license_id)) AS notice_ids, count(*) AS n_notices FROM lines JOIN known USING (digest) GROUP BY {key})
        SELECT w.{key}, text_digest, k.license_id, coalesce(notice_ids, []) AS notice_ids, coalesce(n_notices, 0) AS n_notices
        FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN found f ON f.{key} = w.{key}"""
