"""License scans: canonical digests of whole texts and of their lines, hash-joined to known licences.

Canonical form: lower case, without copyright statements, equivalent spellings unified, every run of
characters that are no letter or digit one space. The digest of the whole canonical text finds
documents that are a licence; the digests of canonical lines find notices inside other documents.

Defined cases: null and empty texts match nothing; every row is scanned on its own, those of a
repeated or null ``doc_id`` too; an empty table gives no rows; further columns are ignored; a text
that equals several known licences (they are equal in canonical form) takes the smallest name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("organisation", "organization"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("per cent", "percent"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"),
)

_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."

# Licence names and the texts or notices that stand for them.
LICENSES = (
    ("0BSD", _PERMISSION + ". " + _ISC_END), ("ISC", _PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("MIT", _MIT), ("MIT", "MIT License " + _MIT), ("MIT", "The MIT License (MIT) " + _MIT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_END), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

# Canonical digests of entire published texts; Apache with and without its appendix, by http and https.
FULL_TEXTS = (
    ("Apache-2.0", "4225605d4c3647ef2075217a0d52c9ca"), ("Apache-2.0", "2f973fce6821968caa77d834b80cee7c"), ("Apache-2.0", "ba7fbc7298a5e5d558bcf8d99a3a0694"), ("Apache-2.0", "71b2bd815104b9a01c3f714eb505d24b"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"), ("GPL-2.0", "e0b7635c5df0abca544f6e8bbe326fde"), ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"), ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"), ("MPL-2.0", "7d4b8b0889da3c01eff3fe431102e6d6"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"), ("CC-BY-SA-4.0", "523e1ae67034d876937bf1d3b440b9ea"),
)

_COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"

# Statements of who holds the rights: a mark, year or placeholder of a year follows the word. "copyright notice, ..."
# and list items "(c) ..." belong to the text. The SQL keeps the wider form above.
_YEAR = r"[\[<({]?(?:\d{4}|yyyy|year)"
_STATEMENT = rf"(?m)^[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|{_YEAR})|\(c\)[ \t]*(?:copyright\b|{_YEAR})|©|all rights reserved[.!]?[ \t\r]*$)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """Canonical text that still has its line ends."""
    c = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _STATEMENT, "")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark, licenses=LICENSES, full_texts=FULL_TEXTS) -> DataFrame:
    """``digest, name`` of the known licences: as many rows as ``licenses`` and ``full_texts`` have entries at most."""
    rows = spark.createDataFrame([(n, t) for n, t in licenses], "name string, known string")
    digests = rows.select(F.md5(canonical(canonical_lines(F.col("known")))).alias("digest"), "name")
    return digests.unionByName(spark.createDataFrame([*full_texts], "name string, digest string")).groupBy("digest").agg(F.min("name").alias("name"))


def scan(docs: DataFrame, licenses=LICENSES, most_broadcast: int = 100_000) -> DataFrame:
    """``doc_id, text_license, line_licenses, n_license_lines`` for every row."""
    known = known_digests(docs.sparkSession, licenses)
    hint = F.broadcast if len(licenses) <= most_broadcast else (lambda df: df)
    canon = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), canonical_lines(F.col("text")).alias("c"))
    texts = canon.select("row", "doc_id", F.md5(canonical(F.col("c"))).alias("digest"), F.posexplode(F.split("c", "\n")).alias("pos", "line"))
    lines = texts.select("row", "doc_id", "digest", "pos", F.trim("line").alias("line")).where("pos = 0 or line <> ''")
    lines = lines.join(hint(known.select(F.col("digest").alias("line_digest"), F.col("name").alias("line_name"))), F.md5("line") == F.col("line_digest"), "left").where("pos = 0 or line_name is not null")
    rows = lines.groupBy("row", "doc_id", "digest").agg(F.count("line_name").alias("hits"), F.array_sort(F.collect_set("line_name")).alias("names"))
    return rows.join(hint(known), "digest", "left").select("doc_id", F.col("name").alias("text_license"), F.array_join("names", ",").alias("line_licenses"), F.col("hits").alias("n_license_lines"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    c = rf"regexp_replace(lower(coalesce({x}, '')), '{_COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


OP1_SQL = rf"""
WITH known AS (
  SELECT md5(trim(regexp_replace(c, '[ \n]+', ' ', 'g'))) AS digest, min(name) AS name
  FROM (SELECT name, {_sql_canonical('t')} AS c FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in LICENSES)}) AS v(name, t)) GROUP BY 1),
canon AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_canonical('text')} AS c FROM documents),
lines AS (SELECT rid, unnest(string_split(c, chr(10))) AS line FROM canon),
hits AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(*) AS n FROM lines JOIN known ON md5(trim(line)) = digest WHERE trim(line) <> '' GROUP BY rid)
SELECT canon.doc_id, known.name AS text_license, coalesce(hits.names, '') AS line_licenses, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_license_lines
FROM canon LEFT JOIN known ON md5(trim(regexp_replace(c, '[ \n]+', ' ', 'g'))) = known.digest LEFT JOIN hits ON canon.rid = hits.rid
"""
