"""The test bed: canvases from `embeddings`, manipulated copies, pairs, fingerprints and scores.

Each table is made once for a session and input and written to the shared folder, as a fingerprint is of an image and
not of a pair. Everything is deterministic, so that SQL can make the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope.functions import fingerprints as fp
from twinscope.session import materialised

#: name, kind of manipulation, number, source cell of cell i, value from x and i. {D} is integer division.
MANIPULATIONS = (
    ("exact", "exact_copy", 0, "i", "x"),
    ("hflip", "flip_rotate_mirror", 0, "(i {D} 8) * 8 + 7 - i % 8", "x"),
    ("vflip", "flip_rotate_mirror", 1, "(7 - i {D} 8) * 8 + i % 8", "x"),
    ("rotate", "flip_rotate_mirror", 2, "(i % 8) * 8 + 7 - (i {D} 8)", "x"),
    ("blocks", "pixelated", 0, "((i {D} 8) - (i {D} 8) % 2) * 8 + i % 8 - (i % 8) % 2", "x"),
    ("shift", "resize_crop_reposition", 0, "(((i {D} 8) + 1) % 8) * 8 + (i % 8 + 1) % 8", "x"),
    ("overlay", "text_logo_emoji", 0, "i", "CASE WHEN (i {D} 8) < 3 AND i % 8 < 3 THEN 0.5D ELSE x END"),
    ("brighter", "color_swap_modify_saturate", 0, "i", "1.5D * x"),
    ("inverse", "color_swap_modify_saturate", 1, "i", "-x"),
    ("border", "background_color_change", 0, "i", "CASE WHEN ((i {D} 8) IN (0, 7) OR i % 8 IN (0, 7)) AND abs(x) < 0.1D THEN 0.3D ELSE x END"),
)
CLASSES = ("exact_copy", "resize_crop_reposition", "flip_rotate_mirror", "pixelated", "color_swap_modify_saturate", "background_color_change", "text_logo_emoji", "non_duplicate")
NEGATIVES = 4
NEAR = 0.02

_made: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, label: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _made:
        _made[key] = materialised(make(), label)
    return _made[key]


def forget() -> None:
    """The next query makes its tables anew."""
    _made.clear()


def manipulated(v: str, source: str, value: str) -> Column:
    """The canvas whose cell i is `value` with x the source cell."""
    cell = f"{v}[cast({source.format(D='div')} as int)]"
    return F.expr(f"transform(sequence(0, 63), i -> element_at(transform(array({cell}), x -> {value.format(D='div')}), 1))")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    name = F.concat(F.lit("c"), F.col("label"), F.lit("_"), F.col("vec_id"))
    return e.select(F.col("vec_id").alias("base"), "label", name.alias("image"), F.col("embedding").cast("array<double>").alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, base, kind (null for bases) and canvas v."""

    def make() -> DataFrame:
        b = bases(spark, sf_dir)
        made = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), manipulated("v", source, value).alias("w")) for _, kind, k, source, value in MANIPULATIONS))
        variants = b.select("base", "image", F.explode(made).alias("m"))
        named = F.concat_ws("__", "image", "m.kind", F.col("m.k").cast("string"))
        return b.select("image", "base", F.lit(None).cast("string").alias("kind"), "v").union(variants.select(named, "base", "m.kind", "m.w"))

    return once(spark, sf_dir, "images", make)


def partners(items: DataFrame, group: str, key: str, count: int) -> DataFrame:
    """Each item of a group with the `count` items after it in the group's order, never itself."""
    ranked = items.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("base")).alias("r"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    asked = ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(count)))).where("k < n").withColumn("want", (F.col("r") - 1 + F.col("k")) % F.col("n") + 1)
    found = ranked.select(F.col(group).alias("g"), F.col("r").alias("want"), F.col(key).alias("partner"))
    return asked.join(found, (F.col(group) == F.col("g")) & (asked["want"] == found["want"])).select(key, "partner", "k")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """original, copy, manipulation_type, is_copy, base."""

    def make() -> DataFrame:
        all_ = images(spark, sf_dir)
        name = F.substring_index("image", "__", 1)
        positive = all_.where("kind is not null").select(name.alias("original"), F.col("image").alias("copy"), F.col("kind").alias("manipulation_type"), F.lit(True).alias("is_copy"), "base")
        b = bases(spark, sf_dir)
        negative = partners(b, "label", "image", NEGATIVES).join(b.select("image", "base"), "image")
        return positive.union(negative.select("image", "partner", F.lit("non_duplicate"), F.lit(False), "base"))

    return once(spark, sf_dir, "pairs", make)


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image and its ahash, phash, dhash, hsvhash and segments."""

    def make() -> DataFrame:
        v = F.col("v")
        rows = images(spark, sf_dir).withColumn("pixels", fp.colours(v))
        return rows.select("image", fp.average_hash(v).alias("ahash"), fp.perceptual_hash(v).alias("phash"), fp.difference_hash(v).alias("dhash"), fp.colour_hash(F.col("pixels")).alias("hsvhash"), fp.segment_hashes(v).alias("segments"))

    return once(spark, sf_dir, "hashes", make)


def cells_in_place(a: Column, b: Column) -> Column:
    """The largest number of cells of b that lie near a's, over the four mirrorings of b: a count of matches in place."""
    flips = F.array(*(F.expr(f"transform(sequence(0, 63), i -> cast({s.format(D='div')} as int))") for s in ("i", MANIPULATIONS[1][3], MANIPULATIONS[2][3], "63 - i")))
    return F.array_max(F.transform(flips, lambda f: F.size(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.abs(F.get(a, i) - F.get(b, F.get(f, i))) < NEAR))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with ahash, phash, dhash, hsvhash (distances), shash (list distance) and orb (matches in place).

    Scores are null where a fingerprint is missing; every sixteenth copy, by md5, has no orb score."""

    def make() -> DataFrame:
        h, v = hashes(spark, sf_dir), images(spark, sf_dir).select("image", "v")
        both = h.join(v, "image")
        o, c = both.alias("o"), both.alias("c")
        joined = pairs(spark, sf_dir).alias("p").join(o, F.col("p.original") == F.col("o.image"), "left").join(c, F.col("p.copy") == F.col("c.image"), "left")
        d = lambda s: fp.hamming(F.col(f"o.{s}"), F.col(f"c.{s}")).alias(s)
        orb = F.when(~F.md5(F.col("copy").cast("binary")).startswith("0"), cells_in_place(F.col("o.v"), F.col("c.v")))
        return joined.select("p.*", d("ahash"), d("phash"), d("dhash"), d("hsvhash"), fp.list_distance(F.col("o.segments"), F.col("c.segments")).alias("shash"), orb.alias("orb"))

    return once(spark, sf_dir, "scored", make).withColumn("train", F.md5(F.substring_index("original", "__", 1).cast("binary")) < "cccc")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """copy and eight class shares from md5 bytes: a stand-in for a classifier that SQL can make too."""
    copies = pairs(spark, sf_dir).select("copy").distinct().withColumn("m", F.md5(F.col("copy").cast("binary")))
    byte = lambda k: F.conv(F.substring("m", 2 * k + 1, 2), 16, 10).cast("int") + 1
    total = sum((byte(k) for k in range(1, 8)), byte(0))
    return copies.select("copy", *((byte(k) / total).alias(f"p{k}") for k in range(8)))
