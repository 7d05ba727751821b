"""Licence scan: lines, whole texts and runs of words against templates by Dice coefficient over word bigrams.

Words are runs of letters and digits in lower case.  A segment and a template are bags of word bigrams; Dice
is twice the common count over the sum of sizes.  Segments are every line, a text of several lines as a whole,
and, wherever line ends and marks of comments fall, every run of exactly the template's size that begins with
one of its bigrams: notices that are wrapped, or stand inside a paragraph, are found so.  Of runs that overlap by
half or more, the best one is reported (the first of equals), and none that begins in a line which matches by itself.

A score of `threshold` bounds the sizes' ratio, so a segment's word count alone tells which templates it can
match; lines and texts that fit none are dropped.  A segment that matches has a least number of the template's
different bigrams, so a text with fewer of them is dropped before any segment is looked at.
Bigrams of the rest meet the templates' bigrams in a broadcast join (the templates are a fixed list), and only shared
ones are counted.  Runs are scored all at once: the n-th occurrence of a bigram counts for the runs that begin
after the one which makes it surplus, so a running sum over where occurrences begin and cease to count is the score.

All of it is DataFrame code.  Defined cases: null and empty texts, and segments of under two words, match
nothing; all templates at or over the threshold are reported, for every row that holds the segment (repeated rows
each); a text of any length counts whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence notices and texts, by SPDX name where there is one.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-2-Clause-text": f"{_BSD}: {_BSD_1_2}{_BSD_END}",
    "BSD-3-Clause": _BSD,
    "BSD-3-Clause-text": f"{_BSD}: {_BSD_1_2}{_BSD_3}{_BSD_END}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    + _AS_IS,
    "MIT": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved": "All rights reserved.",
}


def template_bigrams(templates: dict[str, str]) -> list[tuple[str, int, str, int]]:
    """(name, size, bigram, count)"""
    out = []
    for name, text in sorted(templates.items()):
        w = re.findall(r"[^\W_]+", text.lower())
        pairs = Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
        out += [(name, len(w) - 1, g, n) for g, n in sorted(pairs.items())]
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a segment that can reach the threshold with a template of this size."""
    fits = [n for n in range(1, int(2 * size / threshold) + 2) if 2 * min(n, size) >= threshold * (n + size)]
    return min(fits), max(fits)


def least_different(size: int, different: int, threshold: float) -> int:
    """How many of a template's different bigrams a segment has at least if it matches."""
    low, _ = bounds(size, threshold)
    return max(1, ceil(threshold * (low + size) / 2 - 1e-9) - (size - different))


def _can_match(w: Column, rows: list[tuple[str, int, str, int]], threshold: float) -> Column:
    """Whether the words have enough of some template's bigrams, compared by hashes."""
    of: dict[tuple[str, int], list[Column]] = {}
    for name, size, gram, _ in rows:
        of.setdefault((name, size), []).append(F.xxhash64(*[F.lit(x) for x in gram.split(" ")]))
    every = F.array_distinct(F.array(*[h for hashes in of.values() for h in hashes]))
    own = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    enough = lambda hits: F.array(*[F.size(F.array_intersect(hits, F.array(*hashes))) >= least_different(size, len(hashes), threshold) for (_, size), hashes in of.items()])
    # the common bigrams are an array of one element, so that they are computed once
    return F.exists(F.flatten(F.transform(F.array(F.array_intersect(own, every)), enough)), lambda x: x)


def _parts(docs: DataFrame, rows: list[tuple[str, int, str, int]], threshold: float, doc_id: str, text: str) -> DataFrame:
    """Of texts that may match: lines and whole texts whose sizes fit a template, and, as kind run, all their words."""
    ranges = sorted({bounds(size, threshold) for _, size, _, _ in rows})

    def fits(n: Column) -> Column:
        found = F.lit(False)
        for low, high in ranges:
            found = found | n.between(low, high)
        return found

    none = F.lit(None).cast("array<int>")
    part = lambda kind, line, w, at=none: F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), (F.size(w) - 1).alias("n"), w.alias("w"), at.alias("at"))
    lined = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.transform(F.split(F.col(text), "\n"), _words).alias("lines"))
    # the row's number keeps the filter above the words: below, it would flatten the lines anew for every word
    whole = lined.select("doc_id", F.monotonically_increasing_id().alias("row"), "lines", F.flatten("lines").alias("w")).where(_can_match(F.col("w"), rows, threshold))
    numbers = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, F.size(x))))
    runs = F.array(part("run", F.lit(0), F.col("w"), numbers))
    text_part = F.when((F.size("lines") > 1) & fits(F.size("w") - 1), F.array(part("text", F.lit(0), F.col("w"))))
    line_parts = F.filter(F.transform("lines", lambda x, i: part("line", i + 1, x)), lambda x: fits(x["n"]))
    nothing = F.array().cast("array<struct<kind: string, line: int, n: int, w: array<string>, at: array<int>>>")
    every = F.concat(line_parts, F.coalesce(text_part, nothing), runs)
    return whole.select("doc_id", "row", F.explode(every).alias("p")).select("doc_id", "row", "p.*")


def _runs(parts: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """The best run of each place: doc_id, row, line, license, shared, dice."""
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("gram"), F.get("at", i).alias("line"), i.alias("pos")))
    held = parts.where("kind = 'run'").select("doc_id", "row", F.col("n").alias("all"), F.explode(grams).alias("g")).select("doc_id", "row", "all", "g.*").join(table, "gram")
    own = ["doc_id", "row", "all", "license", "size"]
    places = held.groupBy(*own, "gram", "t").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("places"))
    surplus = F.coalesce(F.get(F.col("places.pos"), F.col("k") - F.col("t")) + 1, F.lit(0))
    each = places.select(*own, "t", "places", F.posexplode("places").alias("k", "p")).select(*own, "p.pos", "p.line", F.greatest(surplus, F.col("p.pos") - F.col("size") + 1, F.lit(0)).alias("begins"))
    event = lambda at, d, asks, line: F.struct(at.alias("at"), F.lit(d).alias("d"), F.lit(asks).alias("asks"), line.alias("line"))
    no_line = F.lit(None).cast("int")
    events = each.select(*own, F.explode(F.array(event(F.col("begins"), 1, False, no_line), event(F.col("pos") + 1, -1, False, no_line), event(F.col("pos"), 0, True, F.col("line")))).alias("e")).select(*own, "e.*")
    order = Window.partitionBy("row", "license").orderBy("at")
    scored = events.withColumn("shared", F.sum("d").over(order.rangeBetween(Window.unboundedPreceding, 0))).where("asks")
    n = F.least(F.col("size"), F.col("all") - F.col("at"))
    good = scored.withColumn("dice", 2 * F.col("shared") / (n + F.col("size"))).where(F.col("dice") >= threshold)
    apart = F.coalesce(2 * (F.col("at") - F.lag("at").over(order)) > F.col("size"), F.lit(True))
    best = good.withColumn("apart", apart).withColumn("place", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = best.groupBy("doc_id", "row", "license", "place").agg(F.max(F.struct("dice", (-F.col("at")).alias("first"), "line", "shared")).alias("b"))
    return found.select("doc_id", "row", "b.line", "license", "b.shared", "b.dice")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind (line, text or run), line (where the segment begins, from 1; 0 for the whole text), license, shared, dice."""
    spark = docs.sparkSession
    rows = template_bigrams(TEMPLATES if templates is None else templates)
    kind = "doc_id long, kind string, line int, license string, shared long, dice double"
    if not rows:
        return spark.createDataFrame([], kind)
    table = F.broadcast(spark.createDataFrame(rows, "license string, size int, gram string, t int"))
    parts = common.stored(_parts(docs, rows, threshold, doc_id, text), common.scratch(spark, "licences"))
    own = parts.where("kind <> 'run'")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    both = own.select("doc_id", "row", "kind", "line", "n", F.explode(pairs).alias("gram")).join(table, "gram").where(2 * F.least("n", "size") >= threshold * (F.col("n") + F.col("size")))
    counted = both.groupBy("doc_id", "row", "kind", "line", "license", "size", "n", "gram", "t").agg(F.count(F.lit(1)).alias("c"))
    shared = counted.groupBy("doc_id", "row", "kind", "line", "license", "size", "n").agg(F.sum(F.least("c", "t")).alias("shared"))
    whole = shared.withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold).select("doc_id", "row", "kind", "line", "license", "shared", "dice")
    known = whole.where("kind = 'line'").select("row", "line", "license")
    runs = _runs(parts, table, threshold).join(known, ["row", "line", "license"], "left_anti")
    return whole.union(runs.select("doc_id", "row", F.lit("run").alias("kind"), "line", "license", "shared", "dice")).select("doc_id", "kind", "line", "license", F.col("shared").cast("long").alias("shared"), "dice")
