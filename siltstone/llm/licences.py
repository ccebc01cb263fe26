"""Licence scan by canonical digest lookup.

Texts are brought to a canonical form (case, copyright lines, punctuation, equivalent spellings, white
space) and digested; the digests are hash-joined with those of known licences. Two kinds of whole units
are looked up: the entire document, and every entire line (a notice such as "Released under the MIT
License."). Nothing is matched by parts of a unit.

Nulls: a null or empty text has the digest of the empty text and matches nothing. A null id is kept.
Repeated rows give repeated results; an empty table gives none. Extra columns are ignored, whatever their names. The
known digests are fixed lists of a few dozen rows; a caller's own texts are broadcast only below `BROADCAST_ROWS`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table

# Spellings that count as the same word (after lower-casing and removing punctuation).
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("licencee", "licensee"),
    ("licencees", "licensees"),
    ("licencor", "licensor"),
    ("licencors", "licensors"),
    ("sublicence", "sublicense"),
    ("sublicences", "sublicenses"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("artefacts", "artifacts"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("colour", "color"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("recognised", "recognized"),
    ("utilisation", "utilization"),
    ("utilise", "utilize"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("http", "https"),
]
VERSION = "version"  # before a digit: v

# A line of its own: optional comment signs, then a copyright statement with a year, sign or "all rights reserved", or with
# nothing but names (words that begin with a capital).
COPYRIGHT_LINE = r"^[ \t#*/;%-]*(?:[Cc]opyright[ \t]*(?:\([Cc]\)|©|[0-9])|COPYRIGHT[ \t]*(?:\([Cc]\)|©|[0-9])|\([Cc]\)[ \t]*[0-9]|©|[Aa]ll [Rr]ights [Rr]eserved|ALL RIGHTS RESERVED|Copyright[ \t]+(?:by[ \t]+)?\p{Lu}[\p{L}.'&-]*(?:[ \t,]+(?:\p{Lu}[\p{L}.'&-]*|and|of|the))*[ \t,.]*$)[^\n]*$"
# Comment signs at the start of a line and every other mark; letters, digits and line breaks stay.
BROADCAST_ROWS = 200_000
MARKS = r"[^\p{L}\p{N}\n]+"
BREAKS = r"\r\n?"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Whole licence texts.
TEXTS = {
    "MIT": _MIT,
    "MIT ": "MIT License\n" + _MIT,
    "ISC": f"{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AS_IS}",
    "0BSD": f"{_PERMIT}.\n{_AS_IS}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n{_BSD_THREE}\n{_BSD_TAIL}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 ": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
# SHA-256 of the canonical form of whole texts that are too long to stand here.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "eb41c243f4e78de2294633eb28804fd51be8a6c3ac48e0471016d5d685258f69",
    "Artistic-1.0-Perl": "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "53cf1660220ce2d9e60c564ca7603e1fe84a2db1624e924e38d0c32e4c9ebaf2",
    "GFDL-1.3": "eeaf72572b2c08eea3f7b2510722187867c75515512aef79985829344f258398",
    "GPL-1.0": "90264a6595e084d6e4eb4e17da8dab599a12ed482c6618699fb3a31462017d64",
    "GPL-2.0": "48bda7e5f5bdbfe181897d27791ffdc2fe7a3600ba295b469d0be381c2561929",
    "GPL-3.0": "48367625382652285d8d675d8140fdc5496bb05b2b4a02f61b18184503eb83fa",
    "LGPL-2.0": "eb5825ab9395a7a4f736328f69a03f7eee07b1aa26ba4c4d3f5702de86eb8baa",
    "LGPL-2.1": "87ea21198dea6ba68eadf05c431e957dcf25eb311be3189e8e71bf921e60905c",
    "LGPL-3.0": "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6",
    "MPL-1.1": "bfb865a8271e34a1a03790d269cd6abd4ba4af074ef5a0857332faae1ec04715",
    "MPL-2.0": "43f7582f942b6617ed7133e5fd1e16f4cb8cdd34587d9a02bc4579e55808ae40",
}
# Names under which one-line notices refer to a licence.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU GPL v3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
LEADS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This file is licensed under", "This project is licensed under", "License:"]


def notices() -> list[tuple[str, str]]:
    """(licence, notice line): each lead with each name, with and without "the"; and SPDX tags."""
    out = [(key, f"{lead} {the}{name}.") for key, names in NAMES.items() for name in names for lead in LEADS for the in ("", "the ")]
    return out + [(key, f"SPDX-License-Identifier: {key}") for key in NAMES]


def _spellings() -> list[tuple[str, str]]:
    """Replacements on canonical lines, where every word has a space of its own on both sides."""
    wide = lambda x: " " + x.replace(" ", "  ") + " "
    return [(wide(a), wide(b)) for a, b in SPELLINGS] + [(f" {VERSION}  {d}", f" v{d}") for d in range(10)]


def canonical_lines(text: Column) -> Column:
    """Canonical form with line breaks kept: the lines of the text, each brought to canonical words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), BREAKS, "\n")
    t = F.lower(F.regexp_replace(t, "(?dm)" + COPYRIGHT_LINE, ""))
    t = F.concat(F.lit(" "), F.replace(F.regexp_replace(t, MARKS, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in _spellings():
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(words: Column) -> Column:
    return F.sha2(words, 256)


def known_digests(spark, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, licence) of whole texts and of notice lines; fixed lists, and the texts of `more` (licence, text)."""
    own = lambda df: df.select(digest(whole(canonical_lines(F.col("text").cast("string")))).alias("known"), F.trim("licence").alias("licence"))
    make = lambda rows: own(spark.createDataFrame(rows, "licence string, text string"))
    texts = make(list(TEXTS.items()))
    if DIGESTS:
        texts = texts.unionByName(spark.createDataFrame([(d, name) for name, d in DIGESTS.items()], "known string, licence string"))
    if more is not None:
        texts = texts.unionByName(own(pick(more, licence="licence", text="text")))
    first = lambda df: df.groupBy("known").agg(F.min("licence").alias("licence"))
    return first(texts), first(make(notices()))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: id, text_digest, licence (of the whole text, null if none), notices.

    `notices` are the distinct licences of whole lines, sorted. `more` (licence, text) adds known whole texts.
    """
    spark = docs.sparkSession
    texts, lines = known_digests(spark, more)
    held = {r["known"]: r["licence"] for r in lines.collect()}  # a fixed list
    table_ = F.create_map(*[F.lit(x) for kv in held.items() for x in kv])
    # every known notice holds one of these words
    canon = pick(docs, id=id_col, text=text_col).select("id", canonical_lines(F.col("text").cast("string")).alias("canon"))
    hits = F.transform(F.filter(F.split("canon", "\n"), lambda x: x.rlike("license|under")), lambda x: F.element_at(table_, digest(whole(x))))
    out = canon.select("id", digest(whole(F.col("canon"))).alias("text_digest"), F.array_sort(F.array_distinct(F.array_compact(hits))).alias("notices"))
    small = more is None or texts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return out.join(F.broadcast(texts) if small else texts, out.text_digest == texts.known, "left").select("id", "text_digest", "licence", "notices")


def op4_licences(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "text_digest", "licence", F.array_join("notices", ",").alias("notices"), (F.col("licence").isNotNull() | (F.size("notices") > 0)).alias("licensed")
    )


def _canonical(text: str) -> str:
    """The canonical form in plain Python, for the digests that the SQL oracle is given."""
    import regex

    t = regex.sub("(?m)" + COPYRIGHT_LINE, "", regex.sub(BREAKS, "\n", text)).lower()
    t = " " + regex.sub(MARKS, "  ", t).replace("\n", " \n ") + " "
    for old, new in _spellings():
        t = t.replace(old, new)
    return regex.sub("[ \n]+", " ", t).strip(" ")


def _sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    canon = f"regexp_replace(coalesce(text, ''), '{BREAKS}', chr(10), 'g')"
    canon = f"lower(regexp_replace({canon}, '(?m){quoted(COPYRIGHT_LINE)}', '', 'g'))"
    canon = f"' ' || replace(regexp_replace({canon}, '{MARKS}', '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for old, new in _spellings():
        canon = f"replace({canon}, '{old}', '{new}')"
    values = lambda rows: ", ".join(sorted({f"('{d}', '{k.strip()}')" for k, d in rows}))
    hashed = lambda rows: [(k, hashlib.sha256(_canonical(t).encode()).hexdigest()) for k, t in rows]
    words = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"""
WITH texts(known, licence) AS (VALUES {values([*hashed(TEXTS.items()), *DIGESTS.items()])}), lines(known, licence) AS (VALUES {values(hashed(notices()))}),
c AS (SELECT doc_id, row_number() OVER () AS uid, {canon} AS canon FROM documents),
n AS (SELECT uid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
      FROM (SELECT uid, sha256({words('line')}) AS known FROM (SELECT uid, unnest(string_split(canon, chr(10))) AS line FROM c)) JOIN lines USING (known) GROUP BY uid)
SELECT doc_id, sha256({words('canon')}) AS text_digest, licence, coalesce(notices, '') AS notices, licence IS NOT NULL OR notices IS NOT NULL AS licensed
FROM c LEFT JOIN n USING (uid) LEFT JOIN texts ON texts.known = sha256({words('canon')})
"""


OP4_SQL = _sql()
