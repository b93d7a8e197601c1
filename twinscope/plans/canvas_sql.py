"""The test bed's tables in DuckDB's SQL, for the oracles."""

from __future__ import annotations

from twinscope.functions.canvas import MANIPULATIONS, NEAR, NEGATIVES
from twinscope.functions.fingerprints import COLOUR_BITS, cosines


def _variant(kind: str, k: int, source: str, value: str) -> str:
    value = value.format(D="//").replace("0.5D", "0.5").replace("1.5D", "1.5").replace("0.1D", "0.1").replace("0.3D", "0.3")
    cell = f"v[({source.format(D='//')}) + 1]"
    return f"SELECT image || '__{kind}__{k}' AS image, base, '{kind}' AS kind, list_transform(range(64), lambda i: {value.replace('x', '(' + cell + ')') if 'x' in value else value}) AS v FROM img"


_LOW = "list_sum(list_transform(range(len({b})), lambda i: CASE WHEN {b}[i + 1] THEN CASE WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << i::BIGINT END ELSE 0::BIGINT END))::BIGINT"
_HIGH = "list_sum(list_transform(range(len({b})), lambda i: CASE WHEN {b}[len({b}) - i] THEN CASE WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << i::BIGINT END ELSE 0::BIGINT END))::BIGINT"
_LEVEL = "greatest(0, least(255, floor(128 + 400 * v[(i + {k}) % 64 + 1])))::INT"
_FLIPS = ("i", MANIPULATIONS[1][3], MANIPULATIONS[2][3], "63 - i")

BASE = f"""
WITH img AS (SELECT vec_id AS base, label, 'c' || label || '_' || vec_id AS image, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
images AS (SELECT image, base, NULL AS kind, v FROM img UNION ALL {' UNION ALL '.join(_variant(*m[1:]) for m in MANIPULATIONS)}),
ranked AS (SELECT label, image, base, row_number() OVER (PARTITION BY label ORDER BY base) AS r, count(*) OVER (PARTITION BY label) AS n FROM img),
partners AS (SELECT a.image, b.image AS partner, k.k, a.base FROM ranked a, range(1, {NEGATIVES + 1}) k(k) JOIN ranked b ON b.label = a.label AND b.r = (a.r - 1 + k.k) % a.n + 1 WHERE k.k < a.n),
pairs AS (SELECT string_split(image, '__')[1] AS original, image AS copy, kind AS manipulation_type, true AS is_copy, base FROM images WHERE kind IS NOT NULL
 UNION ALL SELECT image, partner, 'non_duplicate', false, base FROM partners),
bits AS (SELECT image, v, list_transform(v, lambda x: x > list_sum(v) / 64) AS a, list_transform(range(64), lambda i: v[i - i % 8 + (i + 1) % 8 + 1] > v[i + 1]) AS d FROM images),
t AS (SELECT {cosines()!r} AS t),
rows_ AS (SELECT image, t, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda c: t[(k % 8) * 8 + c + 1] * v[(k // 8) * 8 + c + 1]))) AS w FROM images, t),
dct AS (SELECT image, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda r: t[(k // 8) * 8 + r + 1] * w[r * 8 + k % 8 + 1]))) AS f FROM rows_),
pbits AS (SELECT image, list_transform(f, lambda x: x > (list_sort(f)[32] + list_sort(f)[33]) / 2) AS p FROM dct),
px AS (SELECT image, i, {_LEVEL.format(k=0)} AS r, {_LEVEL.format(k=21)} AS g, {_LEVEL.format(k=42)} AS b FROM images, range(64) q(i)),
px2 AS (SELECT image, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS l, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS sp, r, g, b FROM px),
px3 AS (SELECT image, l, CASE WHEN sp = 0 THEN 0 ELSE floor(sp::DOUBLE / hi * 255.0)::INT END AS s, CASE WHEN sp = 0 THEN 0 ELSE floor(((CASE WHEN r = hi THEN (hi - b) / sp::DOUBLE - (hi - g) / sp::DOUBLE WHEN g = hi THEN 2.0::DOUBLE + (hi - r) / sp::DOUBLE - (hi - b) / sp::DOUBLE ELSE 4.0::DOUBLE + (hi - g) / sp::DOUBLE - (hi - r) / sp::DOUBLE END) / 6.0::DOUBLE + 1.0::DOUBLE) % 1.0::DOUBLE * 255.0::DOUBLE)::INT END AS h FROM px2),
px4 AS (SELECT image, CASE WHEN l < 32 THEN 0 WHEN s < 85 THEN 1 WHEN s < 170 THEN 2 + least(5, 2 * h // 85) WHEN s > 170 THEN 8 + least(5, 2 * h // 85) ELSE 14 END AS kind FROM px3),
cv AS (SELECT image, [{', '.join(f'least(7, floor(count(*) FILTER (kind = {j}) / 64.0::DOUBLE * 8.0::DOUBLE)::INT)' for j in range(2))}, {', '.join(f'least(7, floor(count(*) FILTER (kind = {j}) * 8 / greatest(1, count(*) FILTER (kind >= 2))::DOUBLE)::INT)' for j in range(2, 14))}] AS q FROM px4 GROUP BY image),
cbits AS (SELECT image, flatten(list_transform(q, lambda x: list_transform([2, 1, 0], lambda y: (({list(COLOUR_BITS)!r}[x + 1] >> y) & 1) = 1))) AS c FROM cv),
quads AS (SELECT image, v, list_filter([0, 4, 32, 36], lambda o: len(list_filter(range(16), lambda k: v[o + (k // 4) * 8 + k % 4 + 1] > 0.25)) > 0) AS o FROM images),
seg AS (SELECT image, list_transform(o, lambda z: list_sum(list_transform(range(12), lambda k: CASE WHEN v[z + (k // 3) * 8 + k % 3 + 2] > v[z + (k // 3) * 8 + k % 3 + 1] THEN 1::BIGINT << (11 - k)::BIGINT ELSE 0::BIGINT END))::BIGINT) AS s FROM quads),
hashes AS (SELECT image, {_LOW.format(b='a')} AS ahash, {_LOW.format(b='p')} AS phash, {_HIGH.format(b='d')} AS dhash, {_LOW.format(b='c')} AS hsvhash, CASE WHEN len(s) > 0 THEN s ELSE [{_HIGH.format(b='d')}] END AS segments
 FROM bits JOIN pbits USING (image) JOIN cbits USING (image) JOIN seg USING (image)),
scored AS (SELECT p.*, bit_count(xor(o.ahash, c.ahash))::INT AS ahash, bit_count(xor(o.phash, c.phash))::INT AS phash, bit_count(xor(o.dhash, c.dhash))::INT AS dhash, bit_count(xor(o.hsvhash, c.hsvhash))::INT AS hsvhash,
 list_sum(list_transform(o.segments, lambda x: list_min(list_transform(c.segments, lambda y: bit_count(xor(x, y))::INT))))::DOUBLE / len(o.segments) AS shash,
 CASE WHEN left(md5(p.copy), 1) <> '0' THEN greatest({', '.join(f"len(list_filter(range(64), lambda i: abs(ov.v[i + 1] - cv_.v[({f.format(D='//')}) + 1]) < {NEAR}))" for f in _FLIPS)})::INT END AS orb,
 md5(p.original) < 'cccc' AS train
 FROM pairs p LEFT JOIN hashes o ON o.image = p.original LEFT JOIN hashes c ON c.image = p.copy LEFT JOIN images ov ON ov.image = p.original LEFT JOIN images cv_ ON cv_.image = p.copy),
byte_ AS (SELECT copy, {', '.join(f"('0x' || substr(md5(copy), {2 * k + 1}, 2))::INT + 1 AS b{k}" for k in range(8))} FROM (SELECT DISTINCT copy FROM pairs)),
proba AS (SELECT copy, {', '.join(f"b{k} / (b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7)::DOUBLE AS p{k}" for k in range(8))} FROM byte_)
"""


def oracle(select: str, *more: str) -> str:
    """SELECT over the tables above; `more`: further common tables."""
    return BASE.rstrip() + "".join(f",\n{x}" for x in more) + "\n" + select
