"""License scans by canonical digest lookup.

A text is lowered, copyright lines go, equivalent spellings become one, everything but letters and digits
becomes single blanks, and the SHA-256 of what is left is joined with digests of known license texts.  Known
texts are rows of a table that the caller gives; without one, the short permissive texts below are known.

Defined results: null text counts as empty; an empty canonical text has a digest and no license; equal texts
get equal rows; two known names of one canonical text are listed by name order, the first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, from -> to.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("non commercial", "noncommercial"), ("optimise", "optimize"), ("organisation", "organization"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "wilfull"),
]

#: Public license texts and notices.
KNOWN = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}

_COPYRIGHT_LINE = r"(?:^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form that is digested."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
        out = F.replace(out, F.lit(f" {old}s "), F.lit(f" {new}s "))
    return F.trim(out)


def known_digests(texts: DataFrame) -> DataFrame:
    """``canonical_sha256, license`` of a table ``license, text``."""
    return texts.select("license", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256")).groupBy("canonical_sha256").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row a document: ``doc_id, canonical_sha256, license`` (null where the whole text is no known license).

    The known side is a caller's table of any size: an equi-join, broadcast only if Spark measures it as small.
    """
    spark: SparkSession = docs.sparkSession
    texts = texts if texts is not None else spark.createDataFrame(sorted(KNOWN.items()), "license string, text string")
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return rows.join(known_digests(texts), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")


def _sql(text: str) -> str:
    out = f"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT_LINE}', chr(10), 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace(replace({out}, ' {old} ', ' {new} '), ' {old}s ', ' {new}s ')"
    return f"sha256(trim({out}))"


_VALUES = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in kv) + ")" for kv in KNOWN.items())

#: DuckDB twin of ``scan`` with the texts above.
SCAN_SQL = f"""
WITH known AS (SELECT {_sql("t")} AS canonical_sha256, min(l) AS license FROM (VALUES {_VALUES}) k(l, t) GROUP BY 1),
d AS (SELECT doc_id, {_sql("text")} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license FROM d LEFT JOIN known USING (canonical_sha256)
"""
