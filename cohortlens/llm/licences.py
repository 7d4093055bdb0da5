"""Licence scan by canonical digests: whole texts, and runs of lines of a known text's length, are brought to one
spelling and looked up by digest among known licences.  Native DataFrame code only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, take, text_key
from .vectors import parts

#: Known notices of one line (fixed values): (licence id, text).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released under CC0 1.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"),
)
#: Known texts (fixed values): (licence id, text).  Line breaks don't count.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _AS_IS),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so.

""" + _AS_IS),
    ("BSD-2-Clause", _BSD_BEGIN + _BSD_END),
    ("BSD-3-Clause", _BSD_BEGIN + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
""" + _BSD_END),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
)
KNOWN = NOTICES + TEXTS
#: Words of the opening by which a longer text is found where only its beginning stands.
OPENING = 20
#: Known entries that rows are compared with at a time.
BLOCK_ENTRIES = 1_000
#: Equivalent spellings (fixed values), applied to canonical text as whole words.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("ver", "version"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)


#: Words after ``copyright`` that make no copyright clause (fixed values): a wrapped licence text may begin a line so.
NO_CLAUSE = "holder holders notice notices law laws interest interests owner owners permission statement"
#: Beginnings of words that what follows a copyright clause must hold, from some sentence on (fixed values).
GRANTS = "licen permi redistrib spdx public\\s+domain"
_CLAUSE = rf"copyright\b(?!\W*(?:{NO_CLAUSE.replace(' ', '|')})\b)"


def canonical_lines(text: Column) -> Column:
    """Lines in canonical spelling, without empty lines and copyright clauses.

    Lower case; every run of characters other than letters and digits is one blank; equivalent spellings are
    replaced.  A line that begins with ``copyright`` (but none of ``NO_CLAUSE``), ``(c)`` or the copyright sign is a copyright
    clause up to its first full stop or semicolon before a blank; what follows, from the first sentence that speaks of a
    grant (see ``GRANTS``), sentence by sentence, are lines of their own."""
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^[ \t]*(\(c\)|©)", "copyright ")

    def grant(parts_: Column) -> Column:
        first = F.array_position(F.transform(parts_, lambda s: s.rlike(rf"\b(?:{GRANTS.replace(' ', '|')})")), True)
        return F.when(first > 0, F.slice(parts_, first.cast("int"), F.size(parts_))).otherwise(F.array().cast("array<string>"))

    clauses = F.transform(F.split(marked, "\n"), lambda s: F.when(s.rlike(rf"^[ \t]*{_CLAUSE}"), grant(F.split(s, r"[.;][ \t]+"))).otherwise(F.array(s)))
    marked = F.when(F.contains(marked, F.lit("copyright")), F.array_join(F.flatten(clauses), "\n")).otherwise(marked)
    plain = F.regexp_replace(marked, r"[^\p{L}\p{N}\n]+", " ")
    # blanks around each line end let every word be replaced as " word "
    plain = F.concat(F.lit(" "), F.replace(plain, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in EQUIVALENT:
        plain = F.replace(plain, F.lit(f" {old} "), F.lit(f" {new} "))
    lines = F.transform(F.split(plain, "\n"), lambda s: F.trim(s))
    return F.filter(lines, lambda s: (s != "") & ~(s.startswith("copyright") & s.rlike(f"^{_CLAUSE}")))


def known_digests(spark: SparkSession, known=KNOWN, opening: int = OPENING) -> DataFrame:
    """(begin, n, digest, open, licence) of known texts: their number of words, the digest of these, and the first
    three to look for.  A text of more than ``opening`` words also has an entry for its opening.  One row per entry: the
    first licence by name for equal texts, all of them, joined by ``|``, for equal openings."""
    table = spark.createDataFrame(list(known), "licence string, text string")
    table = table.select("licence", F.array_join(canonical_lines(F.col("text")), " ").alias("canon")).where(F.col("canon") != "")
    table = table.withColumn("n", F.size(F.split("canon", " ")))
    openings = table.where(F.col("n") > opening).select("licence", F.substring_index("canon", " ", opening).alias("canon"), F.lit(opening).alias("n"), F.lit(True).alias("open"))
    every = table.select("licence", "canon", "n", F.lit(False).alias("open")).unionByName(openings)
    named = F.when(F.col("open"), F.array_join(F.array_sort(F.collect_set("licence")), "|")).otherwise(F.min("licence"))
    return (every.groupBy("n", "open", F.substring_index("canon", " ", 3).alias("begin"), F.sha2("canon", 256).alias("digest"))
            .agg(named.alias("licence")))


def _hits(lines: Column, known: Column) -> Column:
    """(at, licence, open, whole) for every line at which a known text begins.

    ``known`` maps a first word to the entries that begin with it.  A line's first three words are compared, then the
    digest of as many words as the entry has; a run must end with a line, an opening need not."""
    size = F.length(F.array_join(lines, " "))

    def of_line(i: Column) -> Column:
        def entry(e: Column) -> Column:
            text = F.array_join(F.slice(lines, i + 1, e["n"]), "\n")
            words = F.call_function("substring_index", F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(" "), e["n"])
            ends = F.substring(text, F.length(words) + 1, F.lit(1)).isin("", "\n")
            begins = F.replace(F.array_join(F.slice(lines, i + 1, F.lit(3)), "\n"), F.lit("\n"), F.lit(" ")).startswith(e["begin"])
            found = begins & (e["open"] | ends) & (F.sha2(words, 256) == e["digest"])
            return F.when(found, F.struct(i.alias("at"), e["licence"].alias("licence"), e["open"].alias("open"),
                                          ((i == 0) & ~e["open"] & (F.length(words) == size)).alias("whole")))

        entries = F.try_element_at(known, F.substring_index(F.get(lines, i), " ", 1))
        return F.filter(F.transform(entries, entry), lambda x: x.isNotNull())

    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    places = F.filter(places, lambda i: F.map_contains_key(known, F.substring_index(F.get(lines, i), " ", 1)))
    return F.flatten(F.transform(places, of_line))


def scan_licences(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Look every whole text, and every run of lines of it, up among known licences by canonical digest.

    One row per input row: ``text_licence`` (the whole text is that licence; else null), ``line_licences`` (licences whose
    texts begin and end with a line, or whose openings begin with one, sorted and comma-joined; empty if none;
    an opening doesn't count where a whole known text begins) and ``n_licence_lines``, the lines where any begins.

    Null, empty and punctuation-only texts match nothing.  Rows that repeat id and text each get the same result; rows of
    one id with other texts are kept apart; ids may be null; other columns are not read.  The known entries travel with the
    plan in blocks of ``block_entries``: one block is a projection of the rows without a shuffle; of several blocks, each passes the
    rows, and only hits are shuffled.
    """
    wanted = ["begin", "n", "digest", "open", "licence"]
    entries = take(known, **{c: c for c in wanted}).dropna()
    rows = take(docs, id=id_col, text=text_col)
    blocks = parts(entries.count(), block_entries)

    def against(source: DataFrame, block: int, *columns: str) -> DataFrame:
        own = entries.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == block)
        own = own.groupBy(F.substring_index("begin", " ", 1).alias("first")).agg(F.collect_list(F.struct(*wanted)).alias("entries"))
        one = own.agg(F.map_from_entries(F.collect_list(F.struct("first", "entries")))).scalar()
        found = source.select(*columns, "text", one.alias("known"))
        # lines are computed once for all that looks at them
        both = F.array(F.struct(canonical_lines(F.col("text")).alias("lines"), "known"))
        return found.select(*columns, F.flatten(F.transform(both, lambda x: _hits(x["lines"], x["known"]))).alias("hits"))

    if blocks == 1:
        marked = against(rows, 0, "id")
    else:
        keyed = rows.select("id", "text", text_key(F.col("text")).alias("key"))
        with Scratch(docs.sparkSession) as scratch:
            for block in range(blocks):
                part = against(keyed, block, "id", "key").where(F.size("hits") > 0)
                # rows that repeat id and text are one
                part.groupBy("id", "key").agg(F.first("hits").alias("hits")).write.mode("append").parquet(f"{scratch.path}/hits")
            found = docs.sparkSession.read.schema(part.schema).parquet(f"{scratch.path}/hits")
            found = found.groupBy("id", "key").agg(F.flatten(F.collect_list("hits")).alias("hits"))
            joined = keyed.select("id", "key").alias("b").join(found.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.key") == F.col("f.key")), "left")
            marked = cut(joined.select("b.id", F.coalesce("f.hits", F.array().cast(part.schema["hits"].dataType)).alias("hits")))
    full = F.transform(F.filter("hits", lambda h: ~h["open"]), lambda h: h["at"])
    counted = F.filter("hits", lambda h: ~h["open"] | ~F.array_contains(full, h["at"]))
    return marked.select(
        F.col("id").alias(id_col), F.array_min(F.transform(F.filter("hits", lambda h: h["whole"]), lambda h: h["licence"])).alias("text_licence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(counted, lambda h: h["licence"]))), ",").alias("line_licences"),
        F.size(F.array_distinct(F.transform("hits", lambda h: h["at"]))).cast("long").alias("n_licence_lines"))
