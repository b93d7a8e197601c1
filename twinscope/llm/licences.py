"""Licence scans.

The lines of a file, its paragraphs of several lines, and its whole text are compared with licence templates (short
notices and whole licence texts) by the cosine of sparse TF-IDF vectors. A line or paragraph at `header` or more is a
licence header. A file whose name says so and that has a header, or whose whole text is at `whole` or more, is a
licence file: its licence holds for its directory. A file without a header of its own takes the licence of the nearest
directory above it that has one, found by joining directories on their paths.

Document frequencies of all terms are counted over all files, by the terms' 64-bit hashes. Units that share too little
of every template are left out before anything is shuffled: the cosine is at most the length of the part of the
template's vector that the two share, so this loses nothing.

Null texts are empty, null paths have no directory. Each row is a file of its own and gets its own row, also where
file_ids repeat or are null; rows with the same path are files of one directory. Of equally near templates the first by
name counts. An empty table gives no rows; columns besides file_id, path and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import row_key, stored

#: Wordings by licence; each is compared on its own. The licences' public notices and texts.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    "Proprietary": ("All rights reserved.",),
}
NAMES = "(?i)^(licen[cs]e|copying|notice|legal)([.-].*)?$"
_SPLIT = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.split(F.lower(text), _SPLIT)


def _template_terms() -> list[tuple[str, int, dict[str, int]]]:
    out = []
    for name in sorted(TEMPLATES):
        for k, wording in enumerate(TEMPLATES[name]):
            counts: dict[str, int] = {}
            for t in filter(None, re.split(_SPLIT, wording.lower())):
                counts[t] = counts.get(t, 0) + 1
            out.append((name, k, counts))
    return out


def weights(files: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """IDF of the templates' terms (a few hundred at most) over all files, and h and idf of all terms of the files."""
    spark = files.sparkSession
    hashes = F.array_distinct(F.transform(terms(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x)))  # of longs, which needs no comparison of all pairs
    n = files.count()
    idf = lambda df: F.log(F.lit(1.0 + n) / (1 + df)) + 1
    of_all = stored(files.select(F.explode(hashes).alias("h")).groupBy("h").agg(F.count("*").alias("df")).select("h", idf(F.col("df")).alias("idf")), "term-weights")
    vocabulary = sorted({t for _, _, counts in _template_terms() for t in counts})
    known = spark.createDataFrame([(t,) for t in vocabulary], "t string").withColumn("h", F.xxhash64("t"))
    found = {r["t"]: r["idf"] for r in of_all.join(F.broadcast(known), "h").select("t", "idf").collect()}
    return {t: found.get(t, math.log(1 + n) + 1) for t in vocabulary}, of_all


def counted(text: Column) -> Column:
    """h and tf of each term of a text; null if it has none. Runs of the sorted hashes, so nothing is shuffled."""
    hashes = F.sort_array(F.transform(F.filter(terms(text), lambda x: x != ""), lambda x: F.xxhash64(x)))
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("h"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf")))
    of_sorted = lambda s: F.when(F.size(s) > 0, F.transform(F.array(begins(s)), lambda at: runs(s, at))[0])
    return F.transform(F.array(hashes), of_sorted)[0]


def cosines(units: DataFrame, idf: dict[str, float], of_all: DataFrame, keys: list[str]) -> DataFrame:
    """keys, licence and cosine of the template nearest to each unit's text. units: keys and `text`."""
    spark = units.sparkSession
    rows = []
    for name, k, counts in _template_terms():
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        rows += [(name, k, t, c * idf[t] / norm) for t, c in counts.items()]
    templates = spark.createDataFrame(rows, "licence string, k int, t string, share double")
    tf = units.select(*keys, F.inline(counted(F.col("text")))).join(of_all, "h").withColumn("w", F.col("tf") * F.col("idf"))
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(templates.withColumn("h", F.xxhash64("t"))), "h").groupBy(*keys, "licence", "k").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    near = dots.join(norms, keys).select(*keys, "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = near.groupBy(*keys).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
    return best.select(*keys, F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"))


BUCKETS = 512


class Gate:
    """A text's `mass`: the largest squared length of the part of a template's unit vector whose terms the text has. By
    Cauchy-Schwarz its cosine with any template is at most the mass's root, and parts of a text have no more mass."""

    def __init__(self, spark: SparkSession, idf: dict[str, float]):
        squares: dict[str, list[float]] = {}
        templates = _template_terms()
        for i, (_, _, counts) in enumerate(templates):
            total = sum((c * idf[t]) ** 2 for t, c in counts.items())
            for t, c in counts.items():
                squares.setdefault(t, [0.0] * len(templates))[i] = (c * idf[t]) ** 2 / total
        words = spark.createDataFrame([(t,) for t in sorted(squares)], "t string")
        buckets: dict[int, list[str]] = {}
        for t, h in words.select("t", F.xxhash64("t")).collect():  # the templates' terms
            buckets.setdefault(h % BUCKETS, []).append(f"named_struct('h', {h}L, 's', array({', '.join(f'{x!r}D' for x in squares[t])}))")
        # one constant, looked up by a term's lowest bits
        self.table = F.expr(f"array({', '.join(f'array({", ".join(buckets[k])})' if k in buckets else 'null' for k in range(BUCKETS))})")
        self.zeros = F.expr(f"array_repeat(0.0D, {len(templates)})")

    def mass(self, text: Column) -> Column:
        hashes = F.array_distinct(F.transform(terms(text), lambda x: F.xxhash64(x)))
        bucket = lambda x: F.get(self.table, x.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int"))
        of_templates = F.filter(hashes, lambda x: F.exists(bucket(x), lambda e: e["h"] == x))
        parts = F.transform(of_templates, lambda x: F.filter(bucket(x), lambda e: e["h"] == x)[0]["s"])
        return F.array_max(F.aggregate(parts, self.zeros, lambda total, s: F.zip_with(total, s, lambda p, q: p + q)))

    def least(self, limit: float) -> float:
        """No unit of less mass has a cosine of `limit`, which is rounded."""
        return (limit - 1e-4) ** 2


def scan(files: DataFrame, header: float = 0.6, whole: float = 0.5) -> DataFrame:
    """file_id, path, licence, cosine and origin (header, directory, none) of every file. files: file_id, path, text."""
    files = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    first, all_ = row_key("file_id", "path", "text")
    files = files.withColumn("_k", first).withColumn("_r", all_)
    key = ["_k", "_r"]
    idf, of_all = weights(files)
    gate = Gate(files.sparkSession, idf)
    near = stored(files.withColumn("mass", gate.mass(F.col("text"))).where(F.col("mass") >= gate.least(min(header, whole))).select(*key, "text", "mass").dropDuplicates(key), "licence-texts")  # equal rows are read once
    paragraphs = F.filter(F.split("text", r"\n[\x20\x09\x0B-\x0D]*\n"), lambda x: x.contains("\n"))
    units = F.filter(F.concat(F.split("text", "\n"), paragraphs), lambda x: gate.mass(x) >= gate.least(header))
    lines = stored(near.where(F.col("mass") >= gate.least(header)).select(*key, F.posexplode(units).alias("line", "text")), "licence-units")
    of_lines = cosines(lines, idf, of_all, [*key, "line"]).where(F.col("cosine") >= header)
    own = of_lines.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
    own = own.select(*key, F.col("best.licence").alias("own"), (-F.col("best.c")).alias("own_cosine"))
    of_texts = cosines(near.where(F.col("mass") >= gate.least(whole)).select(*key, "text"), idf, of_all, key).where(F.col("cosine") >= whole)
    of_texts = of_texts.select(*key, F.col("licence").alias("whole"), F.col("cosine").alias("whole_cosine"))
    paths = files.select(*key, "file_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    known = paths.join(own, key, "left").join(of_texts, key, "left")
    named = F.col("name").rlike(NAMES) & F.col("own").isNotNull()
    holders = known.where(F.col("whole").isNotNull() | named).select("dir", F.coalesce("whole", "own").alias("licence"), F.coalesce("whole_cosine", "own_cosine").alias("cosine"))
    of_dirs = holders.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best")).select("dir", F.col("best.licence").alias("dir_licence"), (-F.col("best.c")).alias("dir_cosine"))
    return known.join(nearest(paths.select("dir").distinct(), of_dirs), "dir", "left").select(
        "file_id", "path",
        F.coalesce("own", "whole", "dir_licence").alias("licence"),
        F.coalesce("own_cosine", "whole_cosine", "dir_cosine").alias("cosine"),
        F.when(F.col("own").isNotNull() | F.col("whole").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull() & F.col("whole").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def nearest(dirs: DataFrame, of_dirs: DataFrame) -> DataFrame:
    """For each distinct directory, the licence of the deepest directory at or above it that has one."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    rows = dirs.where(F.col("dir").isNotNull()).select("dir", F.inline(above))
    found = rows.join(of_dirs.withColumnRenamed("dir", "up"), "up")
    best = found.groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_licence", "dir_cosine")).alias("b"))
    return best.select("dir", F.col("b.up").alias("from_dir"), F.col("b.dir_licence").alias("dir_licence"), F.col("b.dir_cosine").alias("dir_cosine"))


def oracle(files: str, header: float = 0.6, whole: float = 0.5) -> str:
    """The scan as DuckDB SQL, without the gate. files: a query that gives file_id, path and text."""
    values = ", ".join(f"('{name}', {k}, '{t}', {c})" for name, k, counts in _template_terms() for t, c in counts.items())
    return rf"""
WITH f AS MATERIALIZED (SELECT row_number() OVER () AS rid, file_id, path, coalesce(text, '') AS text FROM ({files})),
template(licence, k, t, c) AS (VALUES {values}),
term AS (SELECT rid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM f),
df AS (SELECT t, count(*) AS n FROM term GROUP BY t),
total AS (SELECT count(*) AS n FROM f),
weighed AS (SELECT licence, k, t, c * (ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1) AS w FROM template LEFT JOIN df USING (t), total),
share AS (SELECT licence, k, t, w / sqrt(sum(w * w) OVER (PARTITION BY licence, k)) AS s FROM weighed),
unit AS (SELECT rid, row_number() OVER () AS u, kind, x FROM (
 SELECT rid, 0 AS kind, unnest(string_split(text, chr(10))) AS x FROM f
 UNION ALL SELECT rid, 0, x FROM (SELECT rid, unnest(regexp_split_to_array(text, '\n[\x20\x09\x0B-\x0D]*\n')) AS x FROM f) WHERE contains(x, chr(10))
 UNION ALL SELECT rid, 1, text FROM f)),
tf AS (SELECT u, t, count(*) AS c FROM (SELECT u, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS t FROM unit) GROUP BY u, t),
v AS (SELECT u, t, c * (ln((1 + total.n) / (1 + df.n)) + 1) AS w FROM tf JOIN df USING (t), total),
norm AS (SELECT u, sqrt(sum(w * w)) AS norm FROM v GROUP BY u),
cosine AS (SELECT u, licence, round(sum(w * s) / any_value(norm), 6) AS cosine FROM v JOIN share USING (t) JOIN norm USING (u) GROUP BY u, licence, k),
best AS (SELECT rid, kind, min((-cosine, licence)) AS b FROM cosine JOIN unit USING (u) WHERE cosine >= CASE kind WHEN 0 THEN {header} ELSE {whole} END GROUP BY rid, kind),
known AS (SELECT f.rid, file_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, o.b AS own, w.b AS whole
 FROM f LEFT JOIN best o ON o.rid = f.rid AND o.kind = 0 LEFT JOIN best w ON w.rid = f.rid AND w.kind = 1),
dirs AS (SELECT dir, min(coalesce(whole, own)) AS d FROM known WHERE whole IS NOT NULL OR (own IS NOT NULL AND regexp_matches(name, '{NAMES}')) GROUP BY dir),
up AS (SELECT dir, i AS depth, array_to_string(parts[1:i], '/') AS up FROM (SELECT dir, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM known WHERE dir IS NOT NULL))),
inherited AS (SELECT up.dir, max((depth, up.up, d)) AS h FROM up JOIN dirs ON dirs.dir = up.up GROUP BY up.dir)
SELECT file_id, path, coalesce(own[2], whole[2], h[3][2]) AS licence, -coalesce(own[1], whole[1], h[3][1]) AS cosine,
 CASE WHEN own IS NOT NULL OR whole IS NOT NULL THEN 'header' WHEN h IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
 CASE WHEN own IS NULL AND whole IS NULL THEN h[2] END AS from_dir
FROM known LEFT JOIN inherited USING (dir)
"""
