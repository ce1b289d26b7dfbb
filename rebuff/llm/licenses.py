"""Licence scan by canonical digests, native expressions only.

A text is normalised (case, equivalent spellings, copyright lines, punctuation, white space) and its digest
is joined to the digests of known licences. Whole documents are looked up, and each of their lines as a
text of its own, against full texts and one-line notices alike. The known table is written and counted first, and broadcast if it is small.

Defined cases: null and empty texts match nothing; a text of copyright lines only is empty; of known
licences with equal digests the least name counts; rows that repeat an id are told apart by their text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rebuff.llm.common import broadcast_if_small, materialize, text_key
from rebuff.llm.license_digests import DIGESTS

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Fixed values, with the texts above: (licence, text). Public licence texts and the notices by which files refer to them.
KNOWN = [
    ("MIT", _MIT), ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")), ("0BSD", _ISC.format("")),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("ISC", "SPDX-License-Identifier: ISC"),
]
#: The usual title lines of the short licences; each may also begin with "The".
TITLES = {
    "MIT": ["MIT License", "MIT License (MIT)", "MIT/X11 License", "Expat License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"],
    "ISC": ["ISC License", "ISC License (ISC)"], "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
}
KNOWN += [(name, f"{the}{title}\n\n{text}") for name, text in KNOWN[:5] for title in TITLES[name] for the in ("", "The ")]
#: Of a normalised text, a line that tells whose work it is: a mark twice, or a short line that ends with the name of a body. A line of a
#: licence that happens to begin with the word goes on with what the second alternative excludes.
_OWNER_LINE = (r"(?m)^copyright copyright\b.*$|^copyright (?!(?:holder|owner|notice|license|law|and|or|interest|statement)s?\b)(?:[^ \n]+ ){0,6}?"
               r"(?:authors?|contributors?|developers?|maintainers?|team|project|foundation|inc|ltd|llc|gmbh|corp|corporation|affiliates)$")
#: Equivalent spellings, as regular expressions over lower-case text.
SPELLINGS = [("©|\\(c\\)", "copyright"), ("licence", "license"), ("organisation", "organization"), ("authorise", "authorize"), ("noninfringement|non infringement", "non-infringement"),
             ("copyright holders?|copyright owners?", "copyright holder"), ("https:", "http:"), ("per cent", "percent"), ("favour", "favor")]


def normalised(text: Column) -> Column:
    """Lines of canonical words; copyright lines are empty, as are lines without letters or digits."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        t = F.regexp_replace(t, a, b)
    t = F.regexp_replace(t, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\s+)+(?:\d{4}|by\b)[^\n]*$|(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\n]+", " ")
    return F.regexp_replace(t, r"(?m)^ +| +$", "")


def digest(lines: Column, wide: bool = False) -> Column:
    """Digest of a normalised text; line breaks count as any white space. Null for an empty text. ``wide``: without
    further owner lines, and with the spellings that a line break had taken apart. A whole text is looked up by both."""
    joined = F.trim(F.regexp_replace(F.regexp_replace(lines, _OWNER_LINE, "") if wide else lines, r"\s+", " "))
    if wide:
        joined = F.regexp_replace(F.regexp_replace(joined, r"\bcopyright (?:holder|owner)s?\b", "copyright holder"), r"\bnon ?infringement\b", "non infringement")
    return F.when(joined != "", F.md5(F.encode(joined, "UTF-8")))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the given texts, or of ``KNOWN`` and ``DIGESTS``."""
    form = normalised(F.col("text"))
    rows = spark.createDataFrame(texts or KNOWN, "license string, text string").select("license", F.explode(F.array(digest(form), digest(form, True))).alias("digest"))
    if not texts:
        rows = rows.unionByName(spark.createDataFrame([(n, d) for n, ds in DIGESTS.items() for d in ds], "license string, digest string"))
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_key, digest, license, notices): per distinct (key, text) the licence whose entire text it
    is, and the sorted licences named by any of its lines."""
    k = broadcast_if_small(materialize(known.select(F.col("digest").alias("k_digest"), F.col("license")), "known"), 500_000)
    d = docs.select(F.col(key).alias("k"), text_key(F.col(text)).alias("text_key"), normalised(F.col(text)).alias("t"))
    d = d.withColumn("digest", digest(F.col("t"))).withColumn("lines", F.split("t", "\n", -1))
    whole = F.transform(F.array("digest", digest(F.col("t"), True)), lambda x: F.struct(F.lit(True).alias("whole"), x.alias("d")))
    rows = d.select("k", "text_key", "digest", F.explode(F.concat(whole, F.transform(
        F.filter("lines", lambda x: x != ""), lambda x: F.struct(F.lit(False).alias("whole"), F.md5(F.encode(x, "UTF-8")).alias("d"))))).alias("x"))
    rows = rows.select("k", "text_key", "digest", "x.whole", "x.d").join(k, F.col("d") == F.col("k_digest"), "left").where("whole or license is not null")
    out = rows.groupBy("k", "text_key").agg(F.first("digest", ignorenulls=True).alias("digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
                                            F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("notices"))
    return out.withColumnRenamed("k", key)
