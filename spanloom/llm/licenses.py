"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, white space, copyright
lines, equivalent spellings) and digested; the digests of whole texts, and of
each line, are hash-joined to those of known licence texts, which go through the
same form.  No pattern is searched for, so the cost does not depend on the
number of known texts.

Edge cases: null and empty texts, and those that are all punctuation, have no
digest and match nothing.  Repeated rows are reported each.  Of several licences with one
digest the first by name is reported.  An empty table gives an empty one; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same word.
EQUIVALENT = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"), ("noncommercial", "non commercial"), ("whilst", "while"), ("merchantability", "merchantibility"), ("sub license", "sublicense"), ("cc by nc", "creative commons attribution non commercial")]

#: Notices and short licence texts by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]


def canonical(text: Column) -> Column:
    """The form that is digested; empty if nothing is left."""
    out = F.lower(text)
    out = F.regexp_replace(out, r"(^|\n)[ \t]*((copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*)", "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^a-z0-9\u0080-￿]+", " "), F.lit(" "))
    for said, meant in EQUIVALENT:
        out = F.replace(out, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.md5(form))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license), one row for each digest."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in known])))
    return rows.select(digest(F.col("text")).alias("digest"), "license").where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, whole_license, line_licenses) for each row.

    whole_license: the licence that the entire text is, or null; line_licenses: the
    distinct licences that lines of the text are, sorted and joined by commas.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    lines = F.transform(F.coalesce(F.array_distinct(F.split("text", "\n", -1)), F.array().cast("array<string>")), lambda x: F.struct(digest(x).alias("digest"), F.lit(False).alias("whole")))
    whole = F.array(F.struct(digest(F.col("text")).alias("digest"), F.lit(True).alias("whole")))
    rows = docs.select("doc_id", F.concat(whole, lines).alias("units"), F.monotonically_increasing_id().alias("row"))
    units = rows.select("row", "doc_id", F.explode("units").alias("unit"))
    units = units.select("row", "doc_id", "unit.digest", "unit.whole").where("whole or digest is not null")
    joined = units.join(F.broadcast(known) if _bounded(known) else known, "digest", "left")
    # a row's lines come from one task, so nearly all of this happens before the shuffle
    return joined.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"),
    ).drop("row")


def _bounded(known: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of known digests is small enough to be sent to every executor."""
    return known.limit(most + 1).count() <= most


ORACLE = """
WITH known(license, text) AS (VALUES {values}),
units AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
),
form AS (
  SELECT r, doc_id, NULL AS line, text FROM units
  UNION ALL
  SELECT DISTINCT r, doc_id, 1, unnest(string_split(text, chr(10))) FROM units
  UNION ALL
  SELECT -1, NULL, NULL, NULL WHERE false
),
canon AS (SELECT r, doc_id, line, {form} AS c FROM form),
kc AS (SELECT {form} AS c, min(license) AS license FROM known GROUP BY 1),
whole AS (SELECT r, doc_id, CASE WHEN c <> '' THEN md5(c) END AS digest, license AS whole_license FROM canon LEFT JOIN kc USING (c) WHERE line IS NULL),
hits AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM canon JOIN kc USING (c) WHERE line = 1 AND c <> '' GROUP BY r)
SELECT doc_id, digest, whole_license, coalesce(line_licenses, '') AS line_licenses FROM whole LEFT JOIN hits USING (r)
"""


def oracle_sql() -> str:
    form = r"regexp_replace(lower(text), '(^|\n)[ \t]*((copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*)', '\1', 'g')"
    form = f"concat(' ', regexp_replace({form}, '[^a-z0-9\\x{{80}}-\\x{{ffff}}]+', ' ', 'g'), ' ')"
    for said, meant in EQUIVALENT:
        form = f"replace({form}, ' {said} ', ' {meant} ')"
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return ORACLE.format(values=values, form=f"trim({form})")
