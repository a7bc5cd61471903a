"""License scans by digests of canonical texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.llm.rules import let
from leadloom.llm.shared import sent_if_small

# Public license texts and standard notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
LICENSES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC + "\n" + _ISC_END),
    ("ISC", "ISC License\n" + _ISC + "\n" + _ISC_END),
    ("0BSD", _ZERO + "\n" + _ISC_END),
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, "1. " + _BSD_1, "2. " + _BSD_2, _BSD_END])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, "1. " + _BSD_1, "2. " + _BSD_2, "3. " + _BSD_3, _BSD_END])),
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, "* " + _BSD_1, "* " + _BSD_2, _BSD_END])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, "* " + _BSD_1, "* " + _BSD_2, "* " + _BSD_3, _BSD_END])),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Spellings that license matching guidelines treat as equal; the right one is canonical.
SPELLINGS = [
    ("licence", "license"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"), ("judgement", "judgment"),
    ("non infringement", "noninfringement"), ("per cent", "percent"), ("programme", "program"),
    ("whilst", "while"), ("wilful", "willful"), ("labour", "labor"), ("copyright owner", "copyright holder"), ("https", "http"),
]
#: A line that only states who holds the copyright.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|copr\.|©|\(c\))[^\n]*(19|20)[0-9][0-9][^\n]*"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
NOT_WORD_IN_LINE = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
#: What stands in every text with a copyright line.
COPYRIGHT_MARKS = ("copyright", "copr.", "©", "(c)")


def _changed(text: Column, marks: Iterable[str], then: Callable[[Column], Column]) -> Column:
    """``then`` of a text that has one of the marks, which are cheap to look for; other texts as they are."""
    return let(text, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(m)) for m in marks]), then(t)).otherwise(t))


def _spelt(text: Column, spellings: list[tuple[str, str]] = SPELLINGS) -> Column:
    """Equal spellings made one."""
    replaced = lambda t: reduce(lambda x, s: F.regexp_replace(x, rf"(?<![^ \n]){s[0]}(?![^ \n])", s[1]), spellings, t)
    return _changed(text, [a for a, _ in spellings], replaced)


def canonical_lines(text: Column) -> Column:
    """Array of the lines of a text: lower case, words joined by one space, equal spellings made one, copyright lines and
    punctuation gone. Lines without words are empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = _changed(t, COPYRIGHT_MARKS, lambda x: F.regexp_replace(x, COPYRIGHT_LINE, "$1"))
    t = _spelt(F.regexp_replace(t, NOT_WORD_IN_LINE, " "))
    return F.transform(F.split(t, "\n", -1), lambda x: F.trim(x))


def joined_lines(lines: Column) -> Column:
    """Canonical text from its canonical lines; spellings of two words may stand across a line end."""
    return _spelt(F.array_join(F.array_remove(lines, ""), " "), [s for s in SPELLINGS if " " in s[0]])


def canonical(text: Column) -> Column:
    """A whole text in canonical form: one line."""
    return joined_lines(canonical_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENSES, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notices, n_notices) per row of ``docs``.

    license_id is the licence whose canonical text the whole document is, null if none; notices are the licences whose
    whole text stands as one line of it, sorted and comma-joined ('' if none), n_notices their number. A text without
    words has the digest of the empty text and matches nothing. If several known licences share a canonical text, the
    smallest id counts. Rows that share an id, or have none, are judged apart. Repeated rows come out as often as they go
    in; other columns are not read.
    """
    table = known.select(digest(F.col("text")).alias("digest"), F.col("license_id"), canonical(F.col("text")).alias("c"))
    table = sent_if_small(table.filter("license_id IS NOT NULL AND c <> ''").groupBy("digest").agg(F.min("license_id").alias("license_id")))
    # the number stands for the row: ids may repeat or be missing
    d = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"), F.monotonically_increasing_id().alias("row"))
    lines = d.select("row", F.explode(F.array_remove(F.array_distinct("lines"), "")).alias("line"))
    lines = lines.select("row", F.sha2("line", 256).alias("digest")).join(table, "digest")
    notices = lines.groupBy("row").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))
    out = d.select("row", "doc_id", F.sha2(joined_lines(F.col("lines")), 256).alias("digest")).join(table, "digest", "left").join(notices, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "digest", "license_id", F.array_join(ids, ",").alias("notices"), F.size(ids).alias("n_notices"))
