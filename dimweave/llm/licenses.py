"""License scans: canonical digest lookup. [native]

A unit of text is brought to a canonical form (case, punctuation, copyright
lines, equivalent spellings), its SHA-256 is taken over the whole unit and
hash-joined to the digests of known licences.  Units are whole documents, and
each of their lines, as corpora carry notices as lines.  Built-in functions
only.

Defined results: null and empty texts, and units of punctuation only, match
nothing; repeated rows give repeated findings; a licence that is known under
two names with the same canonical text gives one finding for each; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Known texts beyond this many bytes of digests are joined by a shuffle.
BROADCAST_LICENSES = 100_000

#: Equivalent spellings (fixed values): left becomes right.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("cataloguing", "cataloging"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("unauthorised", "unauthorized"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("copyright holder", "copyright owner"),
    ("https", "http"),
)

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so"
)
_MIT_NOTICE = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a "
    'copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
    "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
    "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
    "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
    "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
    "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
    "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to "
)

#: Licences whose whole texts are known, with the titles that they come under, and without.
_WHOLE = (
    ("MIT", "MIT License", _MIT + _MIT_NOTICE + _NO_WARRANTY),
    ("MIT-0", "MIT No Attribution", _MIT + ". " + _NO_WARRANTY),
    ("ISC", "ISC License", _ISC + _ISC_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD + _BSD_NAMES + _BSD_WARRANTY),
    ("Zlib", "zlib License", _ZLIB),
)

#: Known licences: whole texts of short licences, and the usual one-line notices.
LICENSES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    *((x, text) for x, _, text in _WHOLE),
    *((x, f"{title}\nCopyright (c) <year> <owner>\n{text}") for x, title, text in _WHOLE),
    *((x, f"The {title}\nCopyright (c) <year> <owner>\n{text}") for x, title, text in _WHOLE if x in ("MIT", "ISC")),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE + "<http://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "<https://unlicense.org>"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense")),
)

#: A line that names a copyright's holder: after comment marks, the word or the sign, and a year, sign or placeholder.
_COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]{4}|<year>|\[yyyy\])|\(c\) *[0-9]{4}|©)[^\n]*$"
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def _words_of(line: Column) -> Column:
    """A line in lower case with single blanks for what is no letter or digit; a copyright line becomes nothing."""
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_lower(line), _COPYRIGHT_LINE, " "), _PUNCTUATION, " "))


def _spelled(words: Column) -> Column:
    # two blanks between words, so that neighbours don't share one
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {_wide(old)} "), F.lit(f" {_wide(new)} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _wide(words: str) -> str:
    return words.replace(" ", "  ")


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    """Canonical form of a whole unit: words in lower case, single blanks, no copyright lines, one spelling."""
    return _spelled(_whole(F.transform(F.split(text, "\n"), _words_of)))


def known_digests(spark: SparkSession, licenses: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """(license_id, digest, n_chars) of known licence texts, by the same canonical form; n_chars is the form's length."""
    rows = spark.createDataFrame(list(licenses), "license_id string, text string").withColumn("form", canonical(F.col("text")))
    return rows.select("license_id", F.sha2("form", 256).alias("digest"), F.char_length("form").alias("n_chars")).distinct()


def scan_licenses(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text", lines: bool = True, size: int | None = None) -> DataFrame:
    """(key, unit, line_no, digest, license_id) for each unit whose canonical text is a known licence.

    unit: 'text' (line_no 0) or, with `lines`, 'line' (line_no from 1).
    `licenses` are (license_id, digest, n_chars) rows; they are broadcast while
    `size`, their number if known, is at most BROADCAST_LICENSES.  Units that
    are longer than every known form, whatever their spelling, are not hashed.
    """
    longest = licenses.agg(F.max("n_chars")).first()[0] or 0
    # one spelling for another changes a form's length by less than this factor
    stretch = max(max(len(a), len(b)) / min(len(a), len(b)) for a, b in SPELLINGS)
    worded = docs.select(F.col(key).alias("key_"), F.transform(F.split(F.col(text), "\n"), _words_of).alias("lines_"))
    units = F.concat(F.array(_whole(F.col("lines_"))), F.col("lines_")) if lines else F.array(_whole(F.col("lines_")))
    each = worded.select("key_", F.posexplode(units).alias("line_no", "body")).where((F.col("body") != "") & (F.char_length("body") <= F.lit(int(longest * stretch) + 1)))
    digested = each.select("key_", "line_no", F.sha2(_spelled(F.col("body")), 256).alias("digest"))
    known = licenses.select("license_id", "digest")
    known = F.broadcast(known) if size is not None and size <= BROADCAST_LICENSES else known
    return digested.join(known, "digest").select(F.col("key_").alias(key), F.when(F.col("line_no") == 0, "text").otherwise("line").alias("unit"), "line_no", "digest", "license_id")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark), size=len(LICENSES))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_COPYRIGHT_LINE}', ' ', 'g')"
    out = f"' ' || replace(trim(regexp_replace({out}, '{_PUNCTUATION}', ' ', 'g')), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {_wide(old)} ', ' {_wide(new)} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in LICENSES)
    return f"""
WITH known AS (SELECT DISTINCT license_id, sha256({_canonical_sql("t")}) AS digest FROM (VALUES {quoted}) AS x(license_id, t)),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
units AS (SELECT doc_id, 0 AS line_no, text AS body FROM documents
  UNION ALL SELECT doc_id, unnest(range(1, len(parts) + 1))::INTEGER, unnest(parts) FROM lines),
digested AS (SELECT doc_id, line_no, {_canonical_sql("body")} AS body FROM units)
SELECT doc_id, CASE WHEN line_no = 0 THEN 'text' ELSE 'line' END AS unit, line_no, digest, license_id
FROM (SELECT doc_id, line_no, sha256(body) AS digest FROM digested WHERE body <> '') JOIN known USING (digest)"""


QUERIES = {"op1_license_scans": op1_license_scans}
ORACLE = {"op1_license_scans": _sql()}
