"""Licence scan by canonical digests: normalise, digest, hash-join with the digests of known licences.

A unit is a whole text, one line of it, or as many of its words as a known text has, from where the text's words are those that the
known one begins with. Its canonical form is in lower case, without copyright lines, with one spelling for words that have
several, and one blank for each run of other characters than a-z and 0-9. Units with equal SHA-256 digests of that form are the
same licence. Whole texts are joined with the known digests; lines and embedded texts are looked up in the row that has them.

Defined cases: a null text has no digest and no licence; each row is judged on its own, so repeated rows, equal doc_ids and null
doc_ids give a row each; very long texts are whole; of several licences with one canonical form that which sorts first is named; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words with several spellings, and the one that stands for them.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("fulfil ", "fulfill "), ("copyright owner", "copyright holder")]
COPYRIGHT = r"(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|\(c\)|©)"
COPYRIGHT_LINE = rf"(?m)^[ \t]*{COPYRIGHT}[^\n]*$"
#: Known texts of so many words are looked for inside longer texts, by the hash of their first HEAD words.
LONG, HEAD = 20, 8
#: Known licences a scan takes at most: their digests go to every task.
MOST_KNOWN = 100_000

_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, either version {version}, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n'
    "For more information, please refer to "
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
#: Known licence texts and notices.
KNOWN = [
    ("MIT", f"MIT License\n\nCopyright (c) holders\n\n{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_DISCLAIMER}"),
    ("MIT", f"{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_DISCLAIMER}"),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies") + "\n\n" + _ISC_TAIL),
    ("0BSD", _ISC.format("") + "\n\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD.format("") + _BSD_TAIL),
    ("BSD-3-Clause", _BSD.format(_BSD_NAME) + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    *(("Unlicense", _UNLICENSE + address) for address in ("<https://unlicense.org>", "<http://unlicense.org/>", "<https://unlicense.org/>")),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, _GNU.format(kind=kind, version=version)) for name, kind, version in [("GPL-2.0-or-later", "GNU General Public License", "2 of the License"), ("GPL-3.0-or-later", "GNU General Public License", "3 of the License"), ("LGPL-3.0-or-later", "GNU Lesser General Public License", "3 of the License"), ("AGPL-3.0-or-later", "GNU Affero General Public License", "3 of the License")]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]


def canonical(text: Column) -> Column:
    """The form that is digested, in expressions that DuckDB has alike."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(known_digest, license, n_words, head), one row per digest; as small as the list."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences")
    rows = spark.createDataFrame(known, "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    words = F.split("form", " ")
    rows = rows.withColumn("head", _hash_of(F.transform(F.slice(words, 1, HEAD), lambda w: F.xxhash64(w))))
    return rows.groupBy(F.sha2("form", 256).alias("known_digest")).agg(F.min("license").alias("license"), F.first(F.size(words)).alias("n_words"), F.first("head").alias("head"))


def _hash_of(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(doc_id, text_digest, license, n_notices, notices, n_embedded, embedded), a row per row of `docs`(doc_id, text).

    `license` is that of the whole text; notices are lines, and embedded are known texts of LONG words or more inside it, of other licences
    where the whole text is one.
    """
    listed = known_digests(docs.sparkSession, known)
    rows = listed.collect()  # MOST_KNOWN at most
    licenses = F.create_map(*(F.lit(x) for r in rows for x in (r.known_digest, r.license)))
    digests, long = [r.known_digest for r in rows], [r for r in rows if r.n_words >= LONG]
    none = F.array().cast("array<string>")
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    form = form.withColumn("words", F.split(F.coalesce("form", F.lit("")), " "))
    form = form.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Named twice, so that the optimizer computes the hashes once and not for each start.
    starts = F.when(F.size("hashes") >= LONG, F.sequence(F.lit(1), F.size("hashes") - (HEAD - 1))).otherwise(F.array().cast("array<int>"))
    at = F.filter(starts, lambda i: _hash_of(F.slice("hashes", i, HEAD)).isin([r.head for r in long])) if long else F.array().cast("array<int>")
    form = form.withColumn("at", at)
    parts = F.flatten(F.transform("at", lambda i: F.transform(F.array(*(F.lit(n) for n in sorted({r.n_words for r in long}))), lambda n: F.when(i + n <= F.size("words") + 1, F.sha2(F.array_join(F.slice("words", i, n), " "), 256))))) if long else none
    form = form.select(
        "doc_id",
        F.sha2("form", 256).alias("text_digest"),
        F.filter(F.transform("lines", digest), lambda d: d.isin(digests)).alias("line_digests"),
        F.filter(parts, lambda d: d.isin(digests)).alias("part_digests"),
    )
    names = lambda c: F.transform(c, lambda d: F.element_at(licenses, d))
    listed_names = lambda c: F.array_join(F.array_sort(F.array_distinct(names(c))), " ")
    # As many rows as MOST_KNOWN at most.
    found = form.join(F.broadcast(listed.select("known_digest", "license")), F.col("text_digest") == F.col("known_digest"), "left")
    # Variants of the licence that the whole text is are not inside it.
    inside = F.when(F.col("license").isNotNull(), F.filter("part_digests", lambda d: F.element_at(licenses, d) != F.col("license"))).otherwise(F.col("part_digests"))
    found = found.withColumn("inside", inside)
    return found.select(
        "doc_id", "text_digest", "license",
        F.size("line_digests").cast("long").alias("n_notices"), listed_names("line_digests").alias("notices"),
        F.size("inside").cast("long").alias("n_embedded"), listed_names("inside").alias("embedded"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _canonical_sql(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '(^|\\n)[ \\t]*{COPYRIGHT}[^\\n]*', '\\1 ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for other, one in SPELLINGS:
        out = f"replace({out}, '{other}', '{one}')"
    return f"trim({out})"


def op7_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
    WITH forms AS (SELECT l, {_canonical_sql('t')} AS f FROM (VALUES {values}) AS k(l, t)),
    known AS (SELECT sha256(f) AS d, min(l) AS license, any_value(len(string_split(f, ' '))) AS n, any_value(string_split(f, ' ')[1:{HEAD}]) AS head FROM forms GROUP BY 1),
    whole AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS d, string_split({_canonical_sql("coalesce(text, '')")}, ' ') AS w FROM documents),
    notices AS (SELECT doc_id, license FROM (SELECT doc_id, sha256({_canonical_sql('line')}) AS d FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) JOIN known USING (d)),
    starts AS (SELECT doc_id, i, w[i:i + {HEAD - 1}] AS head FROM (SELECT doc_id, w, unnest(range(1, len(w) - {HEAD - 2})) AS i FROM whole WHERE len(w) >= {LONG})),
    parts AS (SELECT s.doc_id, k.license FROM starts s JOIN known k ON s.head = k.head AND k.n >= {LONG} JOIN whole x ON x.doc_id = s.doc_id LEFT JOIN known o ON o.d = x.d
      WHERE sha256(array_to_string(x.w[s.i:s.i + k.n - 1], ' ')) = k.d AND k.license IS DISTINCT FROM o.license)
    SELECT doc_id, whole.d AS text_digest, known.license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices, coalesce(n_embedded, 0) AS n_embedded, coalesce(embedded, '') AS embedded
    FROM whole LEFT JOIN known ON whole.d = known.d
    LEFT JOIN (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ' ') AS notices FROM notices GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_embedded, array_to_string(list_sort(list_distinct(list(license))), ' ') AS embedded FROM parts GROUP BY doc_id) USING (doc_id)
    """
