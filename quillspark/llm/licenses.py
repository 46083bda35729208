"""License scans by canonical digest: whole texts and whole lines against known license texts and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that count as the same word, after lower-casing.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "authorise": "authorize",
    "authorised": "authorized", "organisation": "organization", "organisations": "organizations", "recognised": "recognized", "favour": "favor",
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "fulfilment": "fulfillment", "judgement": "judgment", "labour": "labor",
    "centre": "center", "programme": "program", "behaviour": "behavior", "whilst": "while", "analogue": "analog", "initialise": "initialize",
}
# What a copyright statement begins with, past punctuation, in lower case: copyright with a sign, a year or a holder, a sign with a year, ©, or the reservation alone.
COPYRIGHT = r"^[^\p{L}\p{N}©(]*(?:copyright\b|\(c\)[^\p{L}\p{N}]*(?:19|20)[0-9][0-9]|©|all rights reserved[^\p{L}\p{N}]*$)"
# Words after "copyright" with which a wrapped line of a license's body begins, not a statement.
BODY = (
    r"^[^\p{L}\p{N}©(]*copyright[^\p{L}\p{N}(©]*(?:(?:notices?|holders?|owners?|laws?|licen[sc]es?|statements?|and|or|to|in|is|of|on|as|interests?|claims?|disclaimers?|permissions?|protection|"
    r"infringement|registration|management|treat(?:y|ies)|works?|status|information|rights?|terms?|act|may|shall|under|which|that|line|lines|patent|trademark|year|this|these|those|the|also|like|are|if|doctrines?|ownership)\b|$)"
)
#: A name for the statement that has one, though its first word is among the above.
MARKED = r"^[^\p{L}\p{N}©(]*copyright[^\p{L}\p{N}]*(?:\(c\)|©|(?:19|20)[0-9][0-9])"
NOT_WORD = r"[^\p{L}\p{N}]+"

# Notices of one line, by SPDX identifier.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
}
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_1 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{}\n\n"
)
_ISC = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
# Short license texts without titles and copyright lines, by SPDX identifier; {} stands for a variant.
TEXTS = {
    "MIT": [_MIT.format(", subject to the following conditions:") + f"The above copyright notice and this permission notice {x}shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY
            for x in ("", "(including the next paragraph) ")],
    "MIT-0": [_MIT.format(".") + _WARRANTY],
    "ISC": [_ISC.format(x) + _ISC_WARRANTY for x in ("and/or", "and")],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY],
    "BSD-2-Clause": [_BSD_1 + _BSD_END.format(x) for x in ("HOLDER", "OWNER", "HOLDERS")],
    "BSD-3-Clause": [_BSD_1 + _BSD_3 + _BSD_END.format(x) for x in ("HOLDER", "OWNER", "HOLDERS")],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
             "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
             "it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
             "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
             "not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
             "3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
                'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
                "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the "
                "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, "
                "in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated "
                'by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
                "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY "
                "DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
                  "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or "
                  "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
                  "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
                  'copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
                  "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
                  f"ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.{x}" for x in ("", "\n\nFor more information, please refer to <https://unlicense.org>", "\n\nFor more information, please refer to <http://unlicense.org/>")],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
                   f"http{x}://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.' for x in ("", "s")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
                f"http{x}://mozilla.org/MPL/2.0/." for x in ("", "s")],
}
# Titles that may stand above a text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT"], "MIT-0": ["MIT No Attribution", "MIT-0"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "BSD-0-Clause"], "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"], "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"], "Unlicense": ["The Unlicense", "Unlicense"],
}
#: What may be missing after a long text: its instructions for use.
APPENDIX = "END OF TERMS AND CONDITIONS"


def library() -> list[tuple[str, str, bool]]:
    """(license, text, whether it is a license text and not a notice) of all built-in texts, with and without titles and appendices."""
    from importlib.resources import files

    out = [(k, x, False) for k, v in NOTICES.items() for x in v]
    for k, bodies in TEXTS.items():
        out += [(k, f"{t}\n\n{x}", True) for x in bodies for t in ("", *TITLES.get(k, ()))]
    for f in sorted(files("quillspark.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            text = f.read_text("utf-8")
            head, ends, _ = text.partition(APPENDIX)
            out += [(f.name[:-4], x, True) for x in dict.fromkeys((text, head + ends, head))]
    return out


def plain(line: Column) -> Column:
    """A line in lower case, every run of other characters than letters and digits one space; '' for a copyright statement."""
    low = F.lower(line)
    statement = low.rlike(COPYRIGHT) & (low.rlike(MARKED) | ~low.rlike(BODY))
    return F.when(statement, "").otherwise(F.trim(F.regexp_replace(low, NOT_WORD, " ")))


def spelled(line: Column) -> Column:
    """A plain line with one spelling of equivalent words."""
    same = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    words = F.transform(F.split(line, " "), lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.when(line.rlike(r"\b(?:" + "|".join(EQUIVALENT) + r")\b"), F.array_join(words, " ")).otherwise(line)


def canonical_parts(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and parts: the canonical form of the whole text, then, if it has several lines, of each line.

    Every rule looks at one line only, so the whole text's form is that of its lines put together, however
    they were wrapped. The steps are projections of their own: an expression used twice is then evaluated once.
    """
    lines = rows.select(*keep, F.transform(F.split(F.col(text), "\n"), plain).alias("lines"))
    lines = lines.select(*keep, F.transform("lines", spelled).alias("lines"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    return lines.select(*keep, F.when(F.size("lines") > 1, F.concat(F.array(whole), F.col("lines"))).otherwise(F.col("lines")).alias("parts"))


def known(spark: SparkSession, texts: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """(license, digest, is_text) of license texts and notices (license, text, whether it is a text), the built-in library by default."""
    given = spark.createDataFrame(library() if texts is None else texts, "license string, text string, is_text boolean").coalesce(1)
    whole = canonical_parts(given, "text", "license", "is_text").select("license", "is_text", F.get("parts", F.lit(0)).alias("c")).where("c <> ''")
    return whole.groupBy("license", F.sha2("c", 256).alias("digest")).agg(F.bool_or("is_text").alias("is_text"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses, n_hits, whole_text), one row for each row of ``docs``.

    The whole text and each of its lines are brought to canonical form and looked up by SHA-256 in
    ``licenses`` (license, digest, is_text), a library that fits a broadcast; Spark checks its size and shuffles
    instead if it does not. licenses: those found, sorted, separated by commas, or null; n_hits: lines that match (the whole text
    counts too, unless it is a single line); whole_text: whether the entire text is a known license text, not a notice.

    Lines that state a copyright count as absent, wherever they stand; a line of a license's body that happens to begin
    with the word does not. Null and empty texts have no hits. Null and repeated ids each get their rows. An empty table gives no
    rows. Other columns are ignored. A digest under several licenses counts for each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    units = canonical_parts(rows.withColumn("h", F.xxhash64("text")), "text", "doc_id", "h").select("doc_id", "h", F.posexplode("parts").alias("unit", "part"))
    hits = units.where("part <> ''").select("doc_id", "h", "unit", F.sha2("part", 256).alias("digest")).join(licenses, "digest")
    found = hits.groupBy("doc_id", "h").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.countDistinct("unit").alias("n_hits"), F.bool_or((F.col("unit") == 0) & F.col("is_text")).alias("whole_text"))
    found = found.withColumnsRenamed({"doc_id": "i", "h": "k"})
    held = rows.select("doc_id", F.xxhash64("text").alias("h")).join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left")
    return held.select("doc_id", "licenses", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"))


def _sql_line(x: str) -> str:
    """Canonical form of one line in SQL."""
    statement = f"regexp_matches(lower({x}), '{COPYRIGHT}') AND (regexp_matches(lower({x}), '{MARKED}') OR NOT regexp_matches(lower({x}), '{BODY}'))"
    same = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EQUIVALENT.items())
    words = f"list_transform(string_split(trim(regexp_replace(lower({x}), '{NOT_WORD}', ' ', 'g')), ' '), lambda w: CASE w {same} ELSE w END)"
    return f"CASE WHEN {statement} THEN '' ELSE array_to_string({words}, ' ') END"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    values = ", ".join(f"({_sql_text(k)}, {_sql_text(x)}, {str(whole).lower()})" for k, x, whole in library())
    lines = lambda t: f"list_transform(string_split({t}, chr(10)), lambda l: {_sql_line('l')})"
    return f"""
WITH given(license, t, is_text) AS (VALUES {values}),
known AS (SELECT license, c, bool_or(is_text) AS is_text FROM (SELECT license, is_text, array_to_string(list_filter({lines("t")}, lambda x: x <> ''), ' ') AS c FROM given) GROUP BY 1, 2),
docs AS (SELECT doc_id, {lines("text")} AS parts FROM documents),
units AS (
  SELECT doc_id, 0 AS unit, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') AS c FROM docs
  UNION ALL
  SELECT doc_id, unit, parts[unit] AS c FROM docs, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS unit) WHERE len(parts) > 1
),
hits AS (SELECT doc_id, unit, license, is_text FROM units JOIN known USING (c) WHERE c <> ''),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT unit) AS n_hits, bool_or(unit = 0 AND is_text) AS whole_text FROM hits GROUP BY doc_id
)
SELECT d.doc_id, f.licenses, coalesce(f.n_hits, 0) AS n_hits, coalesce(f.whole_text, false) AS whole_text FROM documents d LEFT JOIN found f USING (doc_id)
"""
