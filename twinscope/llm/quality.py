"""Quality rules and cross-document line frequency.

Base rules count words, symbols, repeated lines and repeated three-word windows of each whole text. Then each line is
normalised (lower case, single spaces) and hashed; a line in more than `limit` documents of its host is removed, where
`limit` is `share` of the host's documents, `least` at least. A document that loses more than half of its words so
is depleted and rejected.

Null texts count as empty. Null hosts are one host. Each row is a document of its own, in the line counts and in the
verdict, also where doc_ids repeat or are null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.llm.common import WHITE, row_key

_EDGES = " \t\n\x0b\x0c\r"

#: Words in windows of three that occur twice or more. Window hashes are sorted with their places in the low bits, so
#: equal ones are neighbours; the sorted places then say how many words they cover. `case` picks the bits for places.
_REPEATS = """
element_at(transform(array(w), _w -> case when size(_w) < 4 then 0L else
 element_at(transform(array(transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)))), _g ->
  case when size(array_distinct(_g)) = size(_g) then 0L else
  element_at(transform(array(case when size(_g) < 16384 then 14 when size(_g) < 16777216 then 24 else 31 end), _b ->
   element_at(transform(array(shiftleft(1L, _b) - 1L), _m ->
    element_at(transform(array(sort_array(transform(_g, (x, i) -> shiftleft(x, _b) | cast(i as bigint)))), _s ->
     aggregate(
      sort_array(filter(transform(_s, (x, i) -> if(
        coalesce(shiftright(x, _b) = shiftright(get(_s, i - 1), _b) and get(_g, cast(x & _m as int)) = get(_g, cast(get(_s, i - 1) & _m as int)), false)
        or coalesce(shiftright(x, _b) = shiftright(get(_s, i + 1), _b) and get(_g, cast(x & _m as int)) = get(_g, cast(get(_s, i + 1) & _m as int)), false),
        x & _m, -1L)), p -> p >= 0)),
      named_struct('n', 0L, 'last', -3L),
      (acc, p) -> named_struct('n', acc.n + least(3L, p - acc.last), 'last', p),
      acc -> acc.n)
    ), 1)), 1)), 1) end), 1) end), 1)
"""


def words(text: Column) -> Column:
    """Runs without ASCII white space."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_EDGES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WHITE}]+"))


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{WHITE}]"))


def base_rules(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *more, text.alias("text"), words(F.col("text")).alias("w"))
    counted = rows.select(
        "doc_id", *more,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines(F.col("text"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_rows(docs: DataFrame, host: str, *more: str) -> DataFrame:
    """host, found (array of h, the hash of the normalised line, and the gaps between its words), and more columns."""
    bare = lambda x: F.lower(F.btrim(F.regexp_replace(x, f"[{WHITE}]+", " "), F.lit(" ")))
    found = F.transform(F.transform(lines(F.col("text")), bare), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(" ")).alias("gaps")))
    return docs.select(*more, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), found.alias("found"))


def frequent_lines(docs: DataFrame, host: str, share: float, least: int) -> DataFrame:
    """host and h of the lines above the host's limit."""
    once = line_rows(docs, host).select("host", F.explode(F.array_distinct(F.col("found.h"))).alias("h"))
    counts = once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hosts = docs.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("docs"))
    return counts.join(hosts, "host").where(F.col("n") > F.greatest(F.lit(float(least)), share * F.col("docs"))).select("host", "h")


def judge(docs: DataFrame, host: str = "source", share: float = 0.02, least: int = 10) -> DataFrame:
    """Base rules, what line removal takes, and the verdict, per document."""
    first, all_ = row_key("doc_id", host, "text")
    keyed = docs.withColumn("_k", first).withColumn("_r", all_)
    rows = line_rows(keyed, host, "_k", "_r").select("_k", "_r", "host", F.inline("found"))
    lost = rows.join(frequent_lines(docs, host, share, least), ["host", "h"]).groupBy("_k", "_r").agg(F.count("*").alias("lines"), F.sum(F.col("gaps") + 1).alias("words"))
    # equal rows have one key, whose sums are those of all of them
    repeats = keyed.groupBy("_k", "_r").agg(F.count("*").alias("c")).where("c > 1")
    lost = lost.join(repeats, ["_k", "_r"], "left").select("_k", "_r", *((F.col(x) / F.coalesce("c", F.lit(1))).cast("long").alias(f"n_removed_{x}") for x in ("lines", "words")))
    out = base_rules(keyed, "_k", "_r").join(lost, ["_k", "_r"], "left").drop("_k", "_r").na.fill(0, ["n_removed_lines", "n_removed_words"])
    depleted = 2 * F.col("n_removed_words") > F.col("n_words")
    return out.withColumn("n_removed_words", F.col("n_removed_words").cast("long")).withColumn("kept", ~F.col("base_failed") & ~depleted)


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
k AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM k WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT rid, host, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS bare FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY rid),
f AS (SELECT host, bare FROM lw GROUP BY host, bare HAVING count(DISTINCT rid) > greatest(10.0, 0.02 * (SELECT count(*) FROM d x WHERE x.host = lw.host))),
lost AS (SELECT rid, count(*) AS n_lines, sum(len(string_split(bare, ' '))) AS n_words FROM lw JOIN f USING (host, bare) GROUP BY rid),
b AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(length(array_to_string(w.w, '')), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost.n_lines, 0) AS n_removed_lines, coalesce(lost.n_words, 0) AS n_removed_words
 FROM w LEFT JOIN r USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_removed_lines::BIGINT AS n_removed_lines, n_removed_words::BIGINT AS n_removed_words,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (2 * n_removed_words > n_words) AS kept
FROM b
"""
