"""Fingerprints of 8 x 8 canvases and distances between fingerprints, as Columns.

A canvas is an array of 64 doubles in row order. Hashes are signed 64-bit integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8
CELLS = SIDE * SIDE
#: Fixed values of the colour hash: the three bits of a quantised value 0 to 7.
COLOUR_BITS = (0, 1, 2, 3, 6, 7, 6, 7)
HUE_BINS = 6


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack(bits: Column, first_is_low: bool = True) -> Column:
    """An array of booleans as a long; a null array gives null."""
    n = F.size(bits)
    place = (lambda i: i) if first_is_low else (lambda i: n - 1 - i)
    terms = F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), place(i))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def median_of(v: Column) -> Column:
    s, n = F.sort_array(v), F.size(v)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def average_hash(v: Column) -> Column:
    """A bit per cell, lowest first: the cell is above the mean."""
    bits = lambda x: F.transform(F.array(mean_of(x)), lambda m: pack(F.transform(x, lambda c: c > m)))[0]
    return F.transform(F.array(v), bits)[0]


def difference_hash(v: Column) -> Column:
    """A bit per cell, highest first: its right neighbour is larger; the last column is held against the first."""
    right = lambda x, i: F.get(x, (i - i % SIDE + (i + 1) % SIDE).cast("int"))
    return F.transform(F.array(v), lambda x: pack(F.transform(x, lambda c, i: right(x, i) > c), first_is_low=False))[0]


def cosines() -> list[float]:
    return [2 * math.cos(math.pi * (2 * x + 1) * u / (2 * SIDE)) for u in range(SIDE) for x in range(SIDE)]


def cosine_transform(v: Column) -> Column:
    """The unnormalised two-dimensional DCT-II, rows first."""
    t = F.array(*map(F.lit, cosines()))
    eight, cells = F.sequence(F.lit(0), F.lit(SIDE - 1)), F.sequence(F.lit(0), F.lit(CELLS - 1))
    dot = lambda term: F.aggregate(F.transform(eight, term), F.lit(0.0), lambda a, x: a + x)
    row = lambda k: F.shiftright(k, 3)
    across = lambda x: F.transform(cells, lambda k: dot(lambda c: F.get(t, (k % SIDE) * SIDE + c) * F.get(x, row(k) * SIDE + c)))
    down = lambda x: F.transform(cells, lambda k: dot(lambda r: F.get(t, row(k) * SIDE + r) * F.get(x, r * SIDE + k % SIDE)))
    return F.transform(F.transform(F.array(v), across), down)[0]


def perceptual_hash(v: Column) -> Column:
    """A bit per coefficient, lowest first: it is above the median of all."""
    bits = lambda x: F.transform(F.array(median_of(x)), lambda m: pack(F.transform(x, lambda c: c > m)))[0]
    return F.transform(F.array(cosine_transform(v)), bits)[0]


def luma(r: Column, g: Column, b: Column) -> Column:
    """Fixed-point grey of 8-bit colours."""
    return F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)


def hue_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue and saturation, 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = (top - low).cast("double")
    rc, gc, bc = (((top - x) / spread) for x in (r, g, b))
    h = F.when(r == top, bc - gc).when(g == top, 2.0 + rc - bc).otherwise(4.0 + gc - rc)
    h = (h / 6.0 + 1.0) % 1.0
    grey = top == low
    return F.when(grey, 0).otherwise(F.floor(h * 255.0).cast("int")), F.when(grey, 0).otherwise(F.floor(spread / top * 255.0).cast("int"))


def colours(v: Column) -> Column:
    """An 8-bit colour per cell from cells 0, 21 and 42 places on."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * x))).cast("int")
    at = lambda x, i, k: level(F.get(x, ((i + k) % CELLS).cast("int")))
    return F.transform(F.array(v), lambda x: F.transform(x, lambda c, i: F.struct(at(x, i, 0).alias("r"), at(x, i, 21).alias("g"), at(x, i, 42).alias("b"))))[0]


def colour_values(pixels: Column) -> Column:
    """Quantised shares of black and grey pixels, and of faint and bright ones by hue."""

    def kinds(p: Column) -> Column:
        h, s = hue_saturation(p["r"], p["g"], p["b"])
        bin_ = F.least(F.lit(HUE_BINS - 1), F.floor(2 * h / 85).cast("int"))
        # 0 black, 1 grey, 2 to 7 faint, 8 to 13 bright, 14 coloured but neither
        coloured = F.when(s < 170, 2 + bin_).when(s > 170, 2 + HUE_BINS + bin_).otherwise(2 + 2 * HUE_BINS)
        return F.when(luma(p["r"], p["g"], p["b"]) < 32, 0).when(s < 85, 1).otherwise(coloured)

    def count(k: Column, least: int, most: int) -> Column:
        return F.size(F.filter(k, lambda x: x.between(least, most)))

    few = lambda x: F.least(F.lit(7), F.floor(x).cast("int"))
    last = 2 + 2 * HUE_BINS
    values = lambda k: F.array(
        *(few(count(k, j, j) / F.size(k) * 8.0) for j in range(2)),
        *(few(count(k, j, j) * 8 / F.greatest(F.lit(1), count(k, 2, last))) for j in range(2, last)),
    )
    return F.transform(F.array(F.transform(pixels, kinds)), values)[0]


def colour_hash(pixels: Column) -> Column:
    """42 bits, lowest first; each value gives three, its highest first."""
    table = F.array(*map(F.lit, COLOUR_BITS))
    three = lambda q: F.array(*(F.get(table, q).bitwiseAND(1 << b) != 0 for b in (2, 1, 0)))
    return pack(F.flatten(F.transform(colour_values(pixels), three)))


def segment_hashes(v: Column) -> Column:
    """Difference hashes (12 bits, highest first) of the four quadrants with a cell above 0.25; of the whole canvas if there is none."""
    corners = F.array(*map(F.lit, (0, 4, 32, 36)))
    cell = lambda x, o, k: F.get(x, o + F.shiftright(k, 2) * SIDE + k % 4)
    sixteen, twelve = F.sequence(F.lit(0), F.lit(15)), F.sequence(F.lit(0), F.lit(11))
    # difference k of row k div 3 is between columns k mod 3 and the next
    at = lambda x, o, k, step: F.get(x, o + F.floor(k / 3).cast("int") * SIDE + k % 3 + step)
    kept = lambda x: F.filter(corners, lambda o: F.exists(sixteen, lambda k: cell(x, o, k) > 0.25))
    hashes = lambda x: F.transform(kept(x), lambda o: pack(F.transform(twelve, lambda k: at(x, o, k, 1) > at(x, o, k, 0)), first_is_low=False))
    whole = lambda x: F.when(F.size(hashes(x)) > 0, hashes(x)).otherwise(F.array(difference_hash(x)))
    return F.transform(F.array(v), whole)[0]


def list_minima(a: Column, b: Column) -> Column:
    """For each fingerprint of a, the least distance to one of b."""
    return F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: hamming(x, y))))


def list_distance(a: Column, b: Column) -> Column:
    """The mean of the minima, from a to b; infinite if either is empty."""
    total = F.aggregate(list_minima(a, b), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(float("inf"))).otherwise(total / F.size(a))


def list_matches(a: Column, b: Column, cutoff: int = 16) -> Column:
    """Struct of how many of a have one of b within the cutoff, and the sum of these minima."""
    near = F.filter(list_minima(a, b), lambda x: x <= cutoff)
    return F.struct(F.size(near).alias("n"), F.aggregate(near, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def list_difference(a: Column, b: Column, cutoff: int = 16) -> Column:
    """The number of a's fingerprints less the matched share; all of them if none match."""
    m = list_matches(a, b, cutoff)
    return F.when(m["n"] == 0, F.size(a).cast("double")).otherwise(F.size(a) - (m["n"] - m["total"] / (64.0 * m["n"])))


def list_same(a: Column, b: Column, cutoff: int = 16) -> Column:
    return F.exists(list_minima(a, b), lambda x: x <= cutoff)


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def from_hex_list(text: Column) -> Column:
    """Hex hashes joined by bars; empty text is an empty list."""
    return F.transform(F.filter(F.split(text, r"\|"), lambda x: x != ""), from_hex)
