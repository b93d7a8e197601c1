"""Queries over the test bed, named by operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope.functions import canvas, fingerprints as fp
from twinscope.functions.canvas import CLASSES
from twinscope.operators import matching, metrics as m, sweeps, votes as v
from twinscope.plans.canvas_sql import oracle
from twinscope.session import new_path
from twinscope.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *more: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql, *more)
        return f

    return put


# ---- pieces of SQL

T = v.THRESHOLDS


def fired(s: str, threshold: object = None) -> str:
    return f"coalesce({s} {'>' if s in v.COUNTS else '<='} {T[s] if threshold is None else threshold}, false)"


def voted(panel: tuple[str, ...], thresholds: dict | None = None) -> str:
    return "(" + " + ".join(f"{fired(s, (thresholds or T)[s])}::INT" for s in panel) + ")"


def conf(hit: str, actual: str = "is_copy") -> str:
    return f"count(*) FILTER (({hit}) AND {actual}) AS tp, count(*) FILTER (({hit}) AND NOT {actual}) AS fp, count(*) FILTER (NOT ({hit}) AND {actual}) AS fn, count(*) FILTER (NOT ({hit}) AND NOT {actual}) AS tn"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


P, R = div("tp", "tp + fp"), div("tp", "tp + fn")
F1 = div(f"2 * {P} * {R}", f"{P} + {R}")
PRF = f"round({P}, 6) AS precision, round({R}, 6) AS recall, round({F1}, 6) AS f1"
ACC = f"round({div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy"
K2 = f"{voted(v.COUNT_PANEL)} >= 2"
K2L = f"{voted(v.LIST_PANEL)} >= 2"
GEO = "('flip_rotate_mirror', 'resize_crop_reposition')"


def static() -> Column:
    """Two votes of the panel with counts of matches."""
    return v.at_least(v.COUNT_PANEL, T, 2)


def policies_sql(hits: dict[str, str], by: str = "", source: str = "scored") -> tuple[str, str]:
    cols = f"policy{', ' + by if by else ''}"
    union = " UNION ALL ".join(f"SELECT '{n}' AS policy{', ' + by if by else ''}, is_copy, {h} AS hit FROM {source}" for n, h in hits.items())
    return f"SELECT {cols}, tp, fp, fn, tn, {PRF} FROM c", f"c AS (SELECT {cols}, {conf('hit')} FROM ({union}) GROUP BY {cols})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.scored(spark, sf_dir)


# ---- sources and sinks


def pair_file(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "pairs-csv")
    rows = canvas.pairs(spark, sf_dir)
    rows.select(F.concat(F.lit(" "), "original").alias("original_image"), F.col("copy").alias("copy_image"), "manipulation_type", F.col("is_copy").cast("int").cast("string").alias("is_copy")).write.csv(path, header=True)
    return path


@query("s1_pair_scan", "SELECT original AS original_image, copy AS copy_image, manipulation_type, is_copy FROM pairs")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.read_pairs(spark, pair_file(spark, sf_dir))


@query("s2_score_scan", "SELECT original AS original_image, copy AS copy_image, round(shash, 4) AS shash_dist FROM scored")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scores-csv")
    s = scored(spark, sf_dir)
    s.select(F.col("original").alias("original_image"), F.col("copy").alias("copy_image"), "manipulation_type", F.col("is_copy").cast("int").alias("is_copy"), F.format_string("%.4f", "shash").alias("shash_dist")).write.csv(path, header=True)
    return t.read_pairs(spark, path, t.LIST_SCORES).select("original_image", "copy_image", "shash_dist")


@query("s3_optional_score_scan", "SELECT original, copy, NULL::DOUBLE AS orb_inliers FROM pairs")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = t.read_if_there(spark, new_path(spark, "absent"), t.COUNT_SCORES)
    p = canvas.pairs(spark, sf_dir)
    return p.join(none, (p["original"] == none["original_image"]) & (p["copy"] == none["copy_image"]), "left").select("original", "copy", F.col("orb_inliers").cast("double").alias("orb_inliers"))


@query("s4_hash_cache", "SELECT image, ahash, phash, hsvhash FROM hashes")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "hashes-csv")
    t.write_hashes(canvas.hashes(spark, sf_dir), path)
    return t.read_hashes(spark, path)


@query("s5_segment_cache", "SELECT image, len(segments) AS n, segments[1] AS first_segment, list_sum(segments)::DOUBLE AS total FROM hashes")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "segments-csv")
    t.write_segments(canvas.hashes(spark, sf_dir), path)
    total = F.aggregate("segments", F.lit(0.0), lambda a, x: a + x)
    return t.read_segments(spark, path).select("image", F.size("segments").cast("long").alias("n"), F.col("segments")[0].alias("first_segment"), total.alias("total"))


@query("s7_author_scan", "SELECT 'all' AS variant, count(*) AS n, sum(ahash)::BIGINT AS ahash FROM scored UNION ALL SELECT 'named', count(*), sum(ahash)::BIGINT FROM scored WHERE base % 7 <> 0")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "author-csv")
    s = scored(spark, sf_dir)
    s.select(F.when(F.col("base") % 7 != 0, F.col("original")).otherwise("").alias("original_image"), F.col("copy").alias("copy_image"), F.col("is_copy").cast("int").alias("is_copy"), "ahash", "phash", "hsvhash", "shash").write.csv(path, header=True)
    rows = t.read_csv(spark, path, t.AUTHOR)
    named = rows.where(F.coalesce(F.trim("original_image"), F.lit("")) != "")
    part = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("aHash_dist").alias("ahash")).select(F.lit(name).alias("variant"), "n", "ahash")
    return part(rows, "all").union(part(named, "named"))


@query("s11_gallery_store", "SELECT image AS filename, base AS image_id, ahash FROM images JOIN hashes USING (image) WHERE kind IS NULL")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "gallery")
    b = canvas.images(spark, sf_dir).where("kind is null").join(canvas.hashes(spark, sf_dir), "image")
    b.select(F.col("image").alias("filename"), F.col("base").alias("image_id"), "ahash").write.parquet(path)
    return spark.read.parquet(path)


@query("s12_score_sink", "SELECT original, copy, orb FROM scored WHERE orb IS NOT NULL")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "orb-csv")
    scored(spark, sf_dir).where("orb is not null").select("original", "copy", "orb").write.csv(path, header=True)
    return spark.read.schema("original string, copy string, orb int").csv(path, header=True)


@query("s13_guarded_sink", "SELECT false AS partial_written, true AS full_written")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, full = spark.range(3), [500, 256, 128]
    return spark.createDataFrame([(t.write_curve(c, new_path(spark, "curve"), [500], full), t.write_curve(c, new_path(spark, "curve"), full, full))], "partial_written boolean, full_written boolean")


@query("s15_json_config", "SELECT 12 AS ahash, 16 AS orb_default, 24 AS orb_set")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = new_path(spark, "json"), new_path(spark, "json")
    t.write_json(spark, {"ahash": T["ahash"]}, a)
    t.write_json(spark, {"ahash": T["ahash"], "orb": T["orb"]}, b)
    x, y = (t.read_json(spark, p, "ahash int, orb int") for p in (a, b))
    return x.select("ahash", F.coalesce("orb", F.lit(v.FROZEN_COUNT[0])).alias("orb_default")).crossJoin(y.select(F.col("orb").alias("orb_set")))


@query("s17_incremental_cache", "SELECT image, ahash FROM hashes")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, images = canvas.hashes(spark, sf_dir).select("image", "ahash"), canvas.images(spark, sf_dir)
    cached = h.where(F.md5(F.col("image").cast("binary")) < "8")
    return t.refreshed(images, cached, "image", lambda new: images.join(new, "image").select("image", fp.average_hash(F.col("v")).alias("ahash")))


@query("s19_limit", "SELECT original, copy FROM pairs ORDER BY original, copy LIMIT 50")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.pairs(spark, sf_dir).select("original", "copy").orderBy("original", "copy").limit(50)


# ---- projections and predicates


@query("p1_collection", "SELECT string_split(original, '_')[1] AS collection, count(*) AS n FROM pairs GROUP BY 1")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.pairs(spark, sf_dir).groupBy(t.collection_of(F.col("original")).alias("collection")).agg(F.count("*").alias("n"))


@query("p2_category_groups", f"SELECT g, count(*) AS n FROM (SELECT CASE WHEN manipulation_type IN {GEO} THEN 'geometric' WHEN manipulation_type = 'exact_copy' THEN 'control' WHEN NOT is_copy THEN 'negatives' ELSE 'non_geometric' END AS g FROM pairs) GROUP BY g")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("manipulation_type")
    g = F.when(kind.isin(*v.GEOMETRY), "geometric").when(kind == "exact_copy", "control").when(~F.col("is_copy"), "negatives").otherwise("non_geometric")
    return canvas.pairs(spark, sf_dir).groupBy(g.alias("g")).agg(F.count("*").alias("n"))


@query("p3_fires", "SELECT original, copy, " + ", ".join(f"{fired(s)} AS {s}" for s in v.SIGNALS) + " FROM scored")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("original", "copy", *(v.fires(s, T[s]).alias(s) for s in v.SIGNALS))


@query("p4_is_duplicate", "SELECT original, copy, orb > 23 AS dup FROM scored WHERE orb IS NOT NULL")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("orb is not null").select("original", "copy", (F.col("orb") > v.FROZEN_COUNT[1]).alias("dup"))


TOKENS = (("pixel", "pixelated"), ("flip", "flip_rotate_mirror"), ("swap", "color_swap_modify_saturate"), ("color", "background_color_change"), ("logo", "text_logo_emoji"))


@query("p5_name_classifier", "SELECT copy, CASE " + " ".join(f"WHEN contains(copy, '{a}') THEN '{b}'" for a, b in TOKENS) + " END AS kind FROM (SELECT DISTINCT copy FROM pairs)")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("copy").contains(a), b) for a, b in TOKENS))
    return canvas.pairs(spark, sf_dir).select("copy").distinct().select("copy", kind.alias("kind"))


@query("p7_truthy_parse", "SELECT word, lower(trim(word)) IN ('true', '1', 'yes', 't', 'y') AS truthy, trim(word) = '1' AS one FROM (VALUES ('0'), ('1'), (' 1 '), ('TRUE'), ('y'), ('no')) w(word)")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ("0", "1", " 1 ", "TRUE", "y", "no")], "word string")
    return words.select("word", t.is_true_word(F.col("word")).alias("truthy"), t.is_one(F.col("word")).alias("one"))


@query("p9_unmanipulated", "SELECT copy FROM (SELECT DISTINCT copy FROM pairs) WHERE NOT contains(copy, '__')")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.pairs(spark, sf_dir).select("copy").distinct().where(~F.col("copy").contains("__"))


@query("p11_variant_names", "SELECT copy || '.png' AS name FROM pairs WHERE is_copy")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = canvas.pairs(spark, sf_dir).where("is_copy")
    number = F.element_at(F.split("copy", "__"), -1)
    return p.select(F.concat(F.concat_ws("__", "original", "manipulation_type", number), F.lit(".png")).alias("name"))


@query("p12_abstentions", "SELECT count(*) FILTER (ahash IS NULL) AS missing_hash, count(*) FILTER (orb IS NULL) AS missing_orb, count(*) FILTER (shash IS NULL) AS missing_shash FROM scored")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: m.count_if(F.col(c).isNull())
    return scored(spark, sf_dir).agg(none("ahash").alias("missing_hash"), none("orb").alias("missing_orb"), none("shash").alias("missing_shash"))


# ---- compositions

_SIX = [c for c in CLASSES if c not in ("exact_copy", "non_duplicate")]
_KINDS = "k6(kind) AS (VALUES " + ", ".join(f"('{c}')" for c in _SIX) + ")"
_COMPOSED = ("comp AS (SELECT a.kind AS manip_first, b.kind AS manip_second FROM k6 a JOIN k6 b ON a.kind <> b.kind)",)
_DET, _COL = f"{v.DETAIL!r}".replace(",)", ")"), f"{v.COLOUR!r}"


def compositions(spark: SparkSession) -> DataFrame:
    six = spark.createDataFrame([(c,) for c in _SIX], "kind string")
    return six.select(F.col("kind").alias("manip_first")).join(six.select(F.col("kind").alias("manip_second")), F.col("manip_first") != F.col("manip_second"))


@query("j11_compositions", "SELECT * FROM comp", _KINDS, *_COMPOSED)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compositions(spark)


_PROFILE = f"CASE WHEN d AND c THEN 'both' WHEN d THEN 'detail' WHEN c THEN 'colour' ELSE 'neither' END"


def profile(label: Column) -> Column:
    parts = F.split(label, "__")
    d, c = F.arrays_overlap(parts, F.array(*map(F.lit, v.DETAIL))), F.arrays_overlap(parts, F.array(*map(F.lit, v.COLOUR)))
    return F.when(d & c, "both").when(d, "detail").when(c, "colour").otherwise("neither")


@query("p6_composite_profile", f"SELECT label, {_PROFILE} AS profile FROM (SELECT manip_first || '__' || manip_second AS label, manip_first IN {_DET} OR manip_second IN {_DET} AS d, manip_first IN {_COL} OR manip_second IN {_COL} AS c FROM comp)", _KINDS, *_COMPOSED)
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws("__", "manip_first", "manip_second")
    return compositions(spark).select(label.alias("label"), profile(label).alias("profile"))


#: A composite of each base and composition: the second manipulation of the first one's canvas.
_FIRST = {kind: (s, val) for _, kind, k, s, val in reversed(canvas.MANIPULATIONS)}


def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """original, copy, manip_first, manip_second, both canvases and their average-hash distance."""

    def make() -> DataFrame:
        b = canvas.bases(spark, sf_dir).select("base", F.col("image").alias("original"), F.col("v").alias("v0"))
        step = lambda name, col: F.coalesce(*(F.when(F.col(name) == k, canvas.manipulated(col, *_FIRST[k])) for k in _SIX))
        rows = b.join(F.broadcast(compositions(spark))).withColumn("v1", step("manip_first", "v0")).withColumn("v", step("manip_second", "v1"))
        ahash = fp.hamming(fp.average_hash(F.col("v0")), fp.average_hash(F.col("v")))
        return rows.select("original", F.concat_ws("__", "original", "manip_first", "manip_second").alias("copy"), "manip_first", "manip_second", ahash.alias("ahash"), "base")

    return canvas.once(spark, sf_dir, "composites", make)


def _compose_sql() -> tuple[str, ...]:
    from twinscope.plans.canvas_sql import _LOW

    def case(name: str, col: str) -> str:
        whens = []
        for k in _SIX:
            s, val = _FIRST[k]
            val = val.format(D="//").replace("0.5D", "0.5").replace("1.5D", "1.5").replace("0.1D", "0.1").replace("0.3D", "0.3")
            cell = f"({col}[({s.format(D='//')}) + 1])"
            whens.append(f"WHEN {name} = '{k}' THEN list_transform(range(64), lambda i: {val.replace('x', cell)})")
        return f"CASE {' '.join(whens)} END"

    bits = lambda c: f"list_transform({c}, lambda x: x > list_sum({c}) / 64)"
    return (
        _KINDS, *_COMPOSED,
        f"c1 AS (SELECT image AS original, base, v AS v0, manip_first, manip_second, {case('manip_first', 'v')} AS v1 FROM img, comp)",
        f"c2 AS (SELECT *, {bits('v0')} AS b0, {case('manip_second', 'v1')} AS v2 FROM c1)",
        f"c3 AS (SELECT *, {bits('v2')} AS b2 FROM c2)",
        f"composites AS (SELECT original, original || '__' || manip_first || '__' || manip_second AS copy, manip_first, manip_second, bit_count(xor({_LOW.format(b='b0')}, {_LOW.format(b='b2')}))::INT AS ahash FROM c3)",
    )


_COMPOSITES = _compose_sql()


@query("m10_composites", "SELECT original, copy, manip_first, manip_second, ahash FROM composites", *_COMPOSITES)
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites(spark, sf_dir).select("original", "copy", "manip_first", "manip_second", "ahash")


@query("p10_composite_positives", "SELECT copy, manip_first, manip_second FROM composites WHERE ahash <= 12", *_COMPOSITES)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites(spark, sf_dir).where("ahash <= 12").select("copy", "manip_first", "manip_second")


@query("a26_order_effect", "SELECT a.manip_first, a.manip_second, a.rate AS rate, b.rate AS swapped, round(a.rate - b.rate, 6) AS effect FROM r a JOIN r b ON a.manip_first = b.manip_second AND a.manip_second = b.manip_first", *_COMPOSITES, "r AS (SELECT manip_first, manip_second, round(avg((ahash <= 12)::INT), 6) AS rate FROM composites GROUP BY ALL)")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round(F.avg((F.col("ahash") <= 12).cast("int")), 6).alias("rate")
    r = composites(spark, sf_dir).groupBy("manip_first", "manip_second").agg(rate)
    other = r.select(F.col("manip_first").alias("manip_second"), F.col("manip_second").alias("manip_first"), F.col("rate").alias("swapped"))
    return r.join(other, ["manip_first", "manip_second"]).withColumn("effect", F.round(F.col("rate") - F.col("swapped"), 6))


def shares() -> dict:
    return {c: F.col(f"p{k}") for k, c in enumerate(CLASSES)}


@query("a25_composition_mass", "SELECT manip_first, manip_second, round(avg(d), 6) AS detail, round(avg((d > 0.125)::INT), 6) AS fires, round(avg((d > 0.125 AND c > 0.25)::INT), 6) AS both_fire FROM x GROUP BY ALL", *_COMPOSITES, "x AS (SELECT q.manip_first, q.manip_second, p3 AS d, p4 + p5 AS c FROM composites q JOIN proba p ON p.copy = q.original || '__' || q.manip_first || '__0')")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = v.masses(shares())
    p = canvas.probabilities(spark, sf_dir).select(F.col("copy").alias("first_copy"), mass["detail"].alias("d"), mass["colour"].alias("c"))
    rows = composites(spark, sf_dir).withColumn("first_copy", F.concat_ws("__", "original", "manip_first", F.lit("0"))).join(p, "first_copy")
    share = lambda test: F.round(F.avg(test.cast("int")), 6)
    return rows.groupBy("manip_first", "manip_second").agg(F.round(F.avg("d"), 6).alias("detail"), share(F.col("d") > 0.125).alias("fires"), share((F.col("d") > 0.125) & (F.col("c") > 0.25)).alias("both_fire"))


@query("a27_composition_detection", "SELECT profile, policy, count(*) AS n, round(avg(hit::INT), 6) AS rate FROM (SELECT *, CASE WHEN policy = 'tight' THEN ahash <= 8 ELSE ahash <= 16 END AS hit FROM x, (VALUES ('tight'), ('loose')) p(policy)) GROUP BY ALL", *_COMPOSITES, f"x AS (SELECT ahash, {_PROFILE} AS profile FROM (SELECT ahash, manip_first IN {_DET} OR manip_second IN {_DET} AS d, manip_first IN {_COL} OR manip_second IN {_COL} AS c FROM composites))")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = composites(spark, sf_dir).withColumn("profile", profile(F.concat_ws("__", "manip_first", "manip_second")))
    hits = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), (F.col("ahash") <= k).alias("hit")) for n, k in (("tight", 8), ("loose", 16)))))
    return rows.select("profile", hits.alias("x")).groupBy("profile", "x.policy").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x.hit").cast("int")), 6).alias("rate"))


# ---- joins


@query("j1_score_join", "SELECT original, copy, ahash, phash, dhash, hsvhash, orb::DOUBLE AS orb, round(shash, 6) AS shash FROM scored")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("original", "copy", "ahash", "phash", "dhash", "hsvhash", F.col("orb").cast("double").alias("orb"), F.round("shash", 6).alias("shash"))


@query("j2_last_wins_join", "SELECT original, copy, orb + 2 AS orb FROM scored WHERE orb IS NOT NULL")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).where("orb is not null").select("original", "copy", "orb")
    rows = s.withColumn("line", F.explode(F.array(*map(F.lit, range(3))))).withColumn("orb", F.col("orb") + F.col("line"))
    return canvas.pairs(spark, sf_dir).select("original", "copy").join(t.last_of(rows, ["original", "copy"], "line"), ["original", "copy"]).select("original", "copy", "orb")


@query("j3_common_keys", "SELECT count(*) FILTER (orb IS NOT NULL AND ahash % 2 = 0) AS common, count(*) FILTER (orb IS NOT NULL) AS in_orb, count(*) FILTER (ahash % 2 = 0) AS in_shash FROM scored")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    orb, lists = s.where("orb is not null").select("original", "copy"), s.where("ahash % 2 = 0").select("original", "copy")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(orb.join(lists, ["original", "copy"]), "common").crossJoin(n(orb, "in_orb")).crossJoin(n(lists, "in_shash"))


@query("j4_total_join", "SELECT original, copy, round(p3, 6) AS detail FROM scored JOIN proba USING (copy)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_rows(spark, sf_dir).select("original", "copy", F.round("detail", 6).alias("detail"))


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs with the masses of their copy; a copy without shares is an error."""
    s, p = scored(spark, sf_dir), canvas.probabilities(spark, sf_dir)
    mass = v.masses(shares())
    joined = s.join(p.withColumn("known", F.lit(True)), "copy", "left")
    sure = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("no shares of "), F.col("copy"))).cast("double"))
    return joined.select(*s.columns, *(F.coalesce(sure, c).alias(n) for n, c in mass.items()))


@query("j6_gallery_membership", "SELECT original, copy, original IN (SELECT image FROM g) AS original_in, copy IN (SELECT image FROM g) AS copy_in FROM pairs", "g AS (SELECT image FROM images WHERE kind IS NULL AND base % 3 = 0)")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = canvas.pairs(spark, sf_dir), gallery(spark, sf_dir)
    there = lambda c: g.select(F.col("image").alias(c), F.lit(True).alias(f"{c}_in"))
    out = p.join(there("original"), "original", "left").join(there("copy"), "copy", "left")
    return out.select("original", "copy", *(F.coalesce(f"{c}_in", F.lit(False)).alias(f"{c}_in") for c in ("original", "copy")))


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.images(spark, sf_dir).where("kind is null and base % 3 = 0").select("image")


@query("j7_not_in_gallery", "SELECT image FROM images WHERE kind IS NULL AND base % 3 <> 0")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.images(spark, sf_dir).where("kind is null").select("image").join(gallery(spark, sf_dir), "image", "left_anti")


@query("j8_cache_misses", "SELECT image FROM images WHERE NOT md5(image) < '8'")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = canvas.images(spark, sf_dir)
    return t.missing(images, images.where(F.md5(F.col("image").cast("binary")) < "8"), "image")


@query("j9_wrong_originals", "SELECT p.copy, n.partner AS wrong_original FROM pairs p JOIN partners n ON n.image = p.original AND n.k = 1 WHERE p.is_copy")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_pairs(spark, sf_dir).select("copy", "wrong_original")


def wrong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manipulated copies with an original that isn't theirs."""
    near = canvas.partners(canvas.bases(spark, sf_dir), "label", "image", 1).select(F.col("image").alias("original"), F.col("partner").alias("wrong_original"))
    return canvas.pairs(spark, sf_dir).where("is_copy").join(near, "original")


@query("j10_negative_partners", "SELECT image, partner, k FROM partners")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.partners(canvas.bases(spark, sf_dir), "label", "image", canvas.NEGATIVES).select("image", "partner", F.col("k").cast("long").alias("k"))


@query("j12_segment_minima", "SELECT original, copy, list_transform(o.segments, lambda x: list_min(list_transform(c.segments, lambda y: bit_count(xor(x, y))::INT))) AS minima FROM pairs JOIN hashes o ON o.image = original JOIN hashes c ON c.image = copy WHERE is_copy")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_segments(spark, sf_dir).select("original", "copy", fp.list_minima(F.col("a"), F.col("b")).alias("minima"))


def with_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = canvas.hashes(spark, sf_dir)
    p = canvas.pairs(spark, sf_dir).where("is_copy")
    p = p.join(h.select(F.col("image").alias("original"), F.col("segments").alias("a")), "original")
    return p.join(h.select(F.col("image").alias("copy"), F.col("segments").alias("b")), "copy")


def sides(spark: SparkSession, sf_dir: str, kind: str, signal: str) -> tuple[DataFrame, DataFrame]:
    """Copies of a kind and bases, as (id, h)."""
    rows = canvas.images(spark, sf_dir).join(canvas.hashes(spark, sf_dir), "image")
    of = lambda test: rows.where(test).select(F.col("image").alias("id"), F.col(signal).alias("h"))
    return of(F.col("kind") == kind), of(F.col("kind").isNull())


def sides_sql(kind: str, signal: str) -> tuple[str, str]:
    return (f"l AS (SELECT image AS a, {signal} AS h FROM images JOIN hashes USING (image) WHERE kind = '{kind}')", f"r AS (SELECT image AS b, {signal} AS h FROM images JOIN hashes USING (image) WHERE kind IS NULL)")


_NN = "SELECT a, b, distance FROM (SELECT a, b, bit_count(xor(l.h, r.h))::INT AS distance, row_number() OVER (PARTITION BY a ORDER BY bit_count(xor(l.h, r.h)), b) AS n FROM l, r) WHERE n = 1"


@query("j13_nearest_neighbour", _NN + " AND distance < 50", *sides_sql("pixelated", "dhash"))
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_neighbour(*sides(spark, sf_dir, "pixelated", "dhash"), most=50)


@query("j14_lsh_neighbour")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.lsh_neighbour(*sides(spark, sf_dir, "background_color_change", "dhash"))


@query("j15_mutual_neighbours", "SELECT a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS f, row_number() OVER (PARTITION BY b ORDER BY distance, a) AS k FROM (SELECT a, b, bit_count(xor(l.h, r.h))::INT AS distance FROM l, r) WHERE distance <= 14) WHERE f = 1 AND k = 1", *sides_sql("text_logo_emoji", "dhash"))
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir, "text_logo_emoji", "dhash")
    return matching.mutual(matching.within_distance(left, right, 14))


@query("j17_hamming_range_join", "SELECT a, b, bit_count(xor(l.h, r.h))::INT AS distance FROM l, r WHERE bit_count(xor(l.h, r.h)) <= 14", *sides_sql("text_logo_emoji", "dhash"))
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.within_distance(*sides(spark, sf_dir, "text_logo_emoji", "dhash"), most=14)


_VOTES = ("w AS (SELECT a.copy, b.image, count(*) AS votes FROM (SELECT copy, unnest(segments) AS s FROM pairs JOIN hashes ON image = copy WHERE manipulation_type = 'text_logo_emoji') a JOIN (SELECT image, unnest(segments) AS s FROM hashes JOIN images USING (image) WHERE kind IS NULL) b USING (s) GROUP BY ALL)",)


@query("a29_vote_argmax", "SELECT copy, image, votes FROM (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY votes DESC, image) AS n FROM w) WHERE n = 1", *_VOTES)
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.voted(attributed(spark, sf_dir), "copy", "image")


@query("j16_vote_attribution", "SELECT copy, image, votes FROM w", *_VOTES)
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir).groupBy("copy", "image").agg(F.count("*").alias("votes"))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each segment of a query that an image of the gallery has too."""
    h = canvas.hashes(spark, sf_dir)
    asked = canvas.pairs(spark, sf_dir).where("manipulation_type = 'text_logo_emoji'").join(h, F.col("copy") == F.col("image")).select("copy", F.explode("segments").alias("s"))
    held = canvas.images(spark, sf_dir).where("kind is null").join(h, "image").select("image", F.explode("segments").alias("s"))
    return asked.join(held, "s").select("copy", "image")


@query("g6_two_stage_verdict", "SELECT q.copy, q.image, q.votes, s.orb::DOUBLE AS orb, coalesce(q.votes > 1 AND s.orb > 15, false) AS verdict FROM (SELECT copy, image, votes FROM (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY votes DESC, image) AS n FROM w) WHERE n = 1) q LEFT JOIN scored s ON s.copy = q.copy AND s.original = q.image AND s.is_copy", *_VOTES)
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = matching.voted(attributed(spark, sf_dir), "copy", "image")
    s = scored(spark, sf_dir).where("is_copy").select("copy", F.col("original").alias("image"), "orb")
    return best.join(s, ["copy", "image"], "left").withColumn("verdict", F.coalesce((F.col("votes") > 1) & (F.col("orb") > 15), F.lit(False))).withColumn("orb", F.col("orb").cast("double"))


# ---- fingerprints


@query("h2_hashes", "SELECT image, ahash, phash, dhash, hsvhash FROM hashes")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.hashes(spark, sf_dir).select("image", "ahash", "phash", "dhash", "hsvhash")


@query("h6_luma", "SELECT i AS level, (19595 * i + 38470 * (255 - i) + 7471 * (i // 2) + 32768) >> 16 AS grey FROM range(256) r(i)")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return spark.range(256).select(i.alias("level"), fp.luma(i, 255 - i, F.floor(i / 2)).alias("grey"))


@query("h13_round_half_even", "SELECT x, round_even(x, 0) + 0.0::DOUBLE AS r FROM (VALUES (0.5::DOUBLE), (1.5), (2.5), (-0.5), (3.2)) q(x)")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, 3.2)], "x double").select("x", (F.bround("x", 0) + 0.0).alias("r"))


@query("h16_hamming", "SELECT original, copy, ahash, phash, dhash, hsvhash FROM scored")
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("original", "copy", "ahash", "phash", "dhash", "hsvhash")


_MIN = "mi AS (SELECT original, copy, len(o.segments) AS n, list_transform(o.segments, lambda x: list_min(list_transform(c.segments, lambda y: bit_count(xor(x, y))::INT))) AS q FROM pairs JOIN hashes o ON o.image = original JOIN hashes c ON c.image = copy WHERE is_copy)"
_NEARS = "ne AS (SELECT original, copy, n, q, list_filter(q, lambda x: x <= 4) AS f FROM mi)"


@query("h17_list_matches", "SELECT original, copy, len(f)::INT AS n, coalesce(list_sum(f), 0)::BIGINT AS total, len(f) > 0 AS same, round(CASE WHEN len(f) = 0 THEN n ELSE n - (len(f) - list_sum(f) / (64.0::DOUBLE * len(f))) END, 6) AS difference, round(list_sum(q) / n::DOUBLE, 6) AS distance FROM ne", _MIN, _NEARS)
def h17(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = with_segments(spark, sf_dir).withColumn("x", fp.list_matches(a, b, 4))
    return rows.select("original", "copy", "x.n", "x.total", fp.list_same(a, b, 4).alias("same"), F.round(fp.list_difference(a, b, 4), 6).alias("difference"), F.round(fp.list_distance(a, b), 6).alias("distance"))


@query("h21_pack_high_first", "SELECT 5::BIGINT AS packed, 0::INT AS same, 64::INT AS opposite")
def h21(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1)
    return one.select(fp.pack(F.array(F.lit(True), F.lit(False), F.lit(True)), first_is_low=False).alias("packed"), fp.hamming(F.lit(9), F.lit(9)).alias("same"), fp.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long")).alias("opposite"))


# ---- metrics


@query("a1_confusion", f"SELECT tp, fp, fn, tn, {PRF}, {ACC} FROM c", f"c AS (SELECT {conf(K2)} FROM scored)")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.evaluate(scored(spark, sf_dir), static(), accuracy=True)


@query("a3_flag_everything", "SELECT pos, neg, round(CASE WHEN pos = 0 THEN 0 ELSE 2 * (pos / (pos + neg)) / (pos / (pos + neg) + 1) END, 6) AS floor FROM (VALUES (3600, 2400), (11400, 2400), (202, 1600), (18000, 2400), (0, 5)) q(pos, neg)")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(3600, 2400), (11400, 2400), (202, 1600), (18000, 2400), (0, 5)], "pos int, neg int")
    return rows.withColumn("floor", m.flag_everything(F.col("pos"), F.col("neg")))


_CAT = f"SELECT c.manipulation_type, n, hits, round(hits / n, 6) AS rate, CASE WHEN is_copy THEN round({div('2 * (CASE WHEN hits + fh = 0 THEN 0 ELSE hits / (hits + fh) END) * (hits / n)', '(CASE WHEN hits + fh = 0 THEN 0 ELSE hits / (hits + fh) END) + hits / n')}, 6) END AS f1 FROM c, fa"


def _cat(hit: str) -> tuple[str, ...]:
    return (f"c AS (SELECT manipulation_type, bool_or(is_copy) AS is_copy, count(*) AS n, count(*) FILTER ({hit}) AS hits FROM scored GROUP BY 1)", f"fa AS (SELECT count(*) FILTER ({hit}) AS fh FROM scored WHERE NOT is_copy)")


@query("a4_by_category", _CAT, *_cat(K2))
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.by_category(scored(spark, sf_dir), static())


@query("a5_by_collection", f"SELECT collection, tp, fp, fn, tn, {PRF} FROM c", f"c AS (SELECT string_split(original, '_')[1] AS collection, {conf(K2)} FROM scored GROUP BY 1)")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.evaluate(scored(spark, sf_dir).withColumn("collection", t.collection_of(F.col("original"))), static(), ["collection"])


@query("a6_quorum_sweep", f"SELECT k, tp, fp, fn, tn, {PRF}, round(2 * s / (s + 1), 6) AS floor, row_number() OVER (ORDER BY round({F1}, 6) DESC, k) = 1 AS selected FROM (SELECT *, (tp + fn) / (tp + fn + fp + tn)::DOUBLE AS s FROM c)", f"c AS (SELECT k::INT AS k, {conf(voted(v.COUNT_PANEL) + ' >= k')} FROM scored, range(1, 5) r(k) GROUP BY k)")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.quorum_sweep(scored(spark, sf_dir), v.votes(v.COUNT_PANEL, T))


def _curve(signal: str, steps: str) -> str:
    return f"c AS (SELECT th::DOUBLE AS threshold, {conf(fired(signal, 'th'))} FROM scored, {steps} GROUP BY th)"


@query("a7_count_curve", f"SELECT threshold, tp, fp, fn, tn, {PRF} FROM c", _curve("orb", "range(0, 65) r(th)"))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.curve(scored(spark, sf_dir), "orb", range(65))


@query("a7_best_threshold", f"SELECT threshold, tp, fp, fn, tn, {PRF} FROM c ORDER BY round({F1}, 6) DESC, threshold LIMIT 1", _curve("orb", "range(0, 65) r(th)"))
def a7b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.best(sweeps.curve(scored(spark, sf_dir), "orb", range(65)), "threshold")


@query("a8_distance_curve", f"SELECT threshold, tp, fp, fn, tn, {PRF} FROM c", _curve("shash", "(SELECT unnest(range(0, 41)) * 0.5::DOUBLE AS th)"))
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.curve(scored(spark, sf_dir), "shash", [k * 0.5 for k in range(41)])


@query("a9_data_dependent_sweep", f"SELECT threshold, tp, fp, fn, tn, {PRF} FROM c", _curve("orb", "(SELECT unnest(range(0, (SELECT max(orb) FROM scored) + 1)) AS th)"))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return sweeps.curve(s, "orb", range(s.agg(F.coalesce(F.max("orb"), F.lit(-1))).head()[0] + 1))


def _budget(s: str, steps: int) -> str:
    pick = f"coalesce(min(th) FILTER (rate <= 0.1), {steps - 1})" if s in v.COUNTS else "coalesce(max(th) FILTER (rate <= 0.1), 0)"
    rates = f"(SELECT th, count(*) FILTER ({fired(s, 'th')}) / count(*)::DOUBLE AS rate FROM scored, range({steps}) r(th) WHERE NOT is_copy AND train GROUP BY th)"
    return f"SELECT '{s}' AS signal, th::DOUBLE AS threshold, round(rate, 6) AS false_rate FROM {rates} WHERE th = (SELECT {pick} FROM {rates})"


@query("a10_budget_thresholds", " UNION ALL ".join(_budget(s, 65) for s in v.SIGNALS))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets(spark, sf_dir)


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = scored(spark, sf_dir).where("train")
    out = [sweeps.within_budget(train, s, range(65)) for s in v.SIGNALS]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


@query("a12_edge_guard", _budget("ahash", 65).replace("SELECT 'ahash' AS signal, th", "SELECT th", 1))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweeps.within_budget(scored(spark, sf_dir).where("train"), "ahash", range(65))
    return sweeps.guarded(found, "threshold", range(65)).select("threshold", "false_rate")


@query("a13_score_quantiles", "SELECT manipulation_type, median(orb) AS median, max(orb) FILTER (i = n // 10) AS p10, max(orb) FILTER (i = n - (n + 9) // 10) AS p90 FROM (SELECT manipulation_type, orb, row_number() OVER (PARTITION BY manipulation_type ORDER BY orb) - 1 AS i, count(*) OVER (PARTITION BY manipulation_type) AS n FROM scored WHERE orb IS NOT NULL) GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("manipulation_type")
    rows = scored(spark, sf_dir).where("orb is not null").select("manipulation_type", "orb", (F.row_number().over(w.orderBy("orb")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda place: F.max(F.when(F.col("i") == place, F.col("orb")))
    return rows.groupBy("manipulation_type").agg(F.expr("percentile(orb, 0.5)").alias("median"), at(F.floor(F.col("n") / 10)).alias("p10"), at(F.col("n") - F.ceil(F.col("n") / 10)).alias("p90"))


# ---- classifier reports, on the stand-in shares

_PRED = ("pr AS (SELECT s.copy, s.manipulation_type AS actual, string_split(s.copy, '_')[1] AS collection, [" + ", ".join(f"'{c}'" for c in CLASSES) + "][list_position([p0, p1, p2, p3, p4, p5, p6, p7], greatest(p0, p1, p2, p3, p4, p5, p6, p7))] AS predicted, greatest(p0, p1, p2, p3, p4, p5, p6, p7) AS top, p3 AS detail, p4 + p5 AS colour FROM pairs s JOIN proba USING (copy) WHERE s.is_copy)",)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = F.array(*(f"p{k}" for k in range(8)))
    p = canvas.probabilities(spark, sf_dir).withColumn("top", F.array_max(cols)).withColumn("predicted", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(cols, F.col("top")).cast("int")))
    mass = v.masses(shares())
    pairs = canvas.pairs(spark, sf_dir).where("is_copy").select("copy", F.col("manipulation_type").alias("actual"), t.collection_of(F.col("copy")).alias("collection"))
    return pairs.join(p, "copy").select("copy", "actual", "collection", "predicted", "top", mass["detail"].alias("detail"), mass["colour"].alias("colour"))


@query("a14_confusion_matrix", "SELECT actual, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in CLASSES) + " FROM pr GROUP BY 1", *_PRED)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).groupBy("actual").pivot("predicted", list(CLASSES)).count().na.fill(0)


@query("a15_class_report", "SELECT k AS class, round(count(*) FILTER (actual = k AND predicted = k) / greatest(1, count(*) FILTER (predicted = k)), 6) AS precision, round(count(*) FILTER (actual = k AND predicted = k) / greatest(1, count(*) FILTER (actual = k)), 6) AS recall, round(avg(top) FILTER (predicted = k), 6) AS confidence FROM pr, (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + ") q(k) GROUP BY k", *_PRED)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweeps.grid(predicted(spark, sf_dir), "class", CLASSES)
    right, said, was = (F.col("actual") == F.col("class")) & (F.col("predicted") == F.col("class")), F.col("predicted") == F.col("class"), F.col("actual") == F.col("class")
    part = lambda test: F.round(m.count_if(right) / F.greatest(F.lit(1), m.count_if(test)), 6)
    return rows.groupBy("class").agg(part(said).alias("precision"), part(was).alias("recall"), F.round(F.avg(F.when(said, F.col("top"))), 6).alias("confidence"))


_SAFE = f"predicted NOT IN {_DET} AND predicted NOT IN {_COL}"


@query("a16_expected_confusion", f"SELECT actual, count(*) FILTER (predicted = 'non_duplicate') AS into_pristine, count(*) FILTER ({_SAFE}) AS safe FROM pr GROUP BY 1", *_PRED)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = ~F.col("predicted").isin(*v.DETAIL, *v.COLOUR)
    return predicted(spark, sf_dir).groupBy("actual").agg(m.count_if(F.col("predicted") == "non_duplicate").alias("into_pristine"), m.count_if(safe).alias("safe"))


@query("p8_reliability_safe", f"SELECT copy, {_SAFE} AS safe FROM pr", *_PRED)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).select("copy", (~F.col("predicted").isin(*v.DETAIL, *v.COLOUR)).alias("safe"))


TAUS = [round(0.05 * k, 2) for k in range(1, 20)]


def _taus(actual: str, share: str) -> tuple[str, str]:
    return (f"SELECT tau, tp, fp, fn, tn, {PRF}, round({div('fn', 'tp + fn')}, 6) AS miss, round({div('fp', 'fp + tn')}, 6) AS false_alarm FROM c", f"c AS (SELECT tau::DOUBLE AS tau, {conf(f'{share} > tau', actual)} FROM pr, (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in TAUS) + ") q(tau) GROUP BY tau)")


@query("a17_decision_sweep", _taus(f"(actual IN {_DET})", "detail")[0], *_PRED, _taus(f"(actual IN {_DET})", "detail")[1])
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.decision_sweep(predicted(spark, sf_dir), F.col("detail"), F.col("actual").isin(*v.DETAIL), TAUS)


@query("z12_decision_pair", "SELECT 'detail' AS decision, * FROM (" + _taus(f"(actual IN {_DET})", "detail")[0] + f" ORDER BY round({F1}, 6) DESC, tau LIMIT 1) UNION ALL SELECT 'colour', * FROM (" + _taus("", "")[0].replace("FROM c", "FROM c2") + f" ORDER BY round({F1}, 6) DESC, tau LIMIT 1)", *_PRED, _taus(f"(actual IN {_DET})", "detail")[1], _taus(f"(actual IN {_COL})", "colour")[1].replace("c AS", "c2 AS", 1))
def z12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir)
    one = lambda n, names: sweeps.best(sweeps.decision_sweep(rows, F.col(n), F.col("actual").isin(*names), TAUS), "tau").select(F.lit(n).alias("decision"), "*")
    return one("detail", v.DETAIL).union(one("colour", v.COLOUR))


@query("a18_collection_report", f"SELECT collection, round(avg((actual = predicted)::INT), 6) AS accuracy, round(avg((predicted IN {_DET})::INT) FILTER (actual IN {_DET}), 6) AS detail_recall, round(avg((predicted IN {_COL})::INT) FILTER (actual IN {_COL}), 6) AS colour_recall FROM pr GROUP BY 1", *_PRED)
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall = lambda names: F.round(F.avg(F.when(F.col("actual").isin(*names), F.col("predicted").isin(*names).cast("int"))), 6)
    right = F.round(F.avg((F.col("actual") == F.col("predicted")).cast("int")), 6)
    return predicted(spark, sf_dir).groupBy("collection").agg(right.alias("accuracy"), recall(v.DETAIL).alias("detail_recall"), recall(v.COLOUR).alias("colour_recall"))


_LONG = "lo AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, manipulation_type, original, copy, is_copy, train, {s}::DOUBLE AS score, {fired(s)} AS hit FROM scored" for s in v.SIGNALS) + ")"


def melted(rows: DataFrame) -> DataFrame:
    """A row for each signal of a pair: score and whether it fires."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("score"), v.fires(s, T[s]).alias("hit")) for s in v.SIGNALS)))
    keep = [c for c in rows.columns if c not in v.SIGNALS]
    return rows.select(*keep, each.alias("x")).select(*keep, "x.*")


@query("a19_gating_map", "SELECT signal, manipulation_type, count(*) AS n, round(avg(hit::INT), 6) AS rate FROM lo GROUP BY ALL", _LONG)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melted(scored(spark, sf_dir)).groupBy("signal", "manipulation_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


@query("a20_manipulated_negatives", f"SELECT p.manipulation_type, count(*) AS n, round(avg((bit_count(xor(a.ahash, b.ahash)) <= {T['ahash']})::INT), 6) AS ahash, round(avg((bit_count(xor(a.phash, b.phash)) <= {T['phash']})::INT), 6) AS phash FROM pairs p JOIN partners n ON n.image = p.original AND n.k = 1 JOIN hashes a ON a.image = n.partner JOIN hashes b ON b.image = p.copy WHERE p.is_copy GROUP BY 1")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = canvas.hashes(spark, sf_dir)
    side = lambda c: h.select(F.col("image").alias(c), F.col("ahash").alias(f"{c}_a"), F.col("phash").alias(f"{c}_p"))
    rows = wrong_pairs(spark, sf_dir).join(side("wrong_original"), "wrong_original").join(side("copy"), "copy")
    rate = lambda s, k: F.round(F.avg(v.fires(s, T[s], fp.hamming(F.col(f"wrong_original_{k}"), F.col(f"copy_{k}"))).cast("int")), 6).alias(s)
    return rows.groupBy("manipulation_type").agg(F.count("*").alias("n"), rate("ahash", "a"), rate("phash", "p"))


@query("a21_detection_map", "SELECT signal, manipulation_type, round(avg(hit::INT) FILTER (score IS NOT NULL), 6) AS detection FROM lo WHERE train GROUP BY ALL", _LONG)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_map(spark, sf_dir).withColumn("detection", F.round("detection", 6))


def detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.avg(F.when(F.col("score").isNotNull(), F.col("hit").cast("int")))
    return melted(scored(spark, sf_dir).where("train")).groupBy("signal", "manipulation_type").agg(known.alias("detection"))


@query("a23_prevalence", f"SELECT pi, policy, f1, f1 = max(f1) OVER (PARTITION BY pi) AS best FROM (SELECT pi, policy, round({div('2 * r * pi', '2 * r * pi + f * (1 - pi) + (1 - r) * pi')}, 6) AS f1 FROM rf, (VALUES (0.02::DOUBLE), (0.05), (0.1), (0.25), (0.5), (0.826)) q(pi))", "rf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS policy, count(*) FILTER (is_copy AND ({h})) / count(*) FILTER (is_copy)::DOUBLE AS r, count(*) FILTER (NOT is_copy AND ({h})) / count(*) FILTER (NOT is_copy)::DOUBLE AS f FROM scored" for n, h in (("counts", K2), ("lists", K2L))) + ")")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.policies(scored(spark, sf_dir), {"counts": static(), "lists": v.at_least(v.LIST_PANEL, T, 2)})
    swept = sweeps.grid(out, "pi", [0.02, 0.05, 0.1, 0.25, 0.5, 0.826])
    f1 = m.at_prevalence(m.ratio(F.col("tp"), F.col("tp") + F.col("fn")), m.ratio(F.col("fp"), F.col("fp") + F.col("tn")), F.col("pi"))
    return swept.select("pi", "policy", f1.alias("f1")).withColumn("best", F.col("f1") == F.max("f1").over(Window.partitionBy("pi")))


@query("a22_recall_false_rate", f"SELECT round(count(*) FILTER (is_copy AND ({K2})) / count(*) FILTER (is_copy)::DOUBLE, 6) AS recall, round(count(*) FILTER (NOT is_copy AND ({K2})) / count(*) FILTER (NOT is_copy)::DOUBLE, 6) AS false_rate FROM scored")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda test: F.round(F.avg(F.when(test, static().cast("int"))), 6)
    return scored(spark, sf_dir).agg(share(F.col("is_copy")).alias("recall"), share(~F.col("is_copy")).alias("false_rate"))


# ---- routed and weighted policies

_ROUTED = "ro AS (SELECT s.*, p3 AS detail, p4 + p5 AS colour, p2 + p1 AS geometry FROM scored s JOIN proba USING (copy))"


def routed_sql(tau: str, multi: bool = False, geo: bool = False, panel: tuple[str, ...] = v.COUNT_PANEL) -> str:
    ok = {"ahash": f"(geometry <= {tau})" if geo else "true", "phash": f"(geometry <= {tau})" if geo else "true", "hsvhash": f"(colour <= {tau})", "shash": f"(detail <= {tau})" if multi else "true", "orb": f"(detail <= {tau})"}
    n = " + ".join(f"({ok[s]})::INT" for s in panel)
    k = " + ".join(f"({ok[s]} AND {fired(s)})::INT" for s in panel)
    return f"(({k}) >= CASE WHEN ({n}) >= 3 THEN 2 ELSE 1 END)"


def routed_verdict(tau, multi: bool = False, geo: bool = False, panel=v.COUNT_PANEL):
    ok = v.healthy_panel(F.col("detail"), F.col("colour"), tau, multi, F.col("geometry") if geo else None)
    return v.routed(panel, T, ok)


_POL = {"static": K2, "routed": routed_sql("0.2"), "shipped": f"({K2} OR {routed_sql('0.2')})", "geometry": routed_sql("0.3", geo=True)}


def three_policies() -> dict:
    return {"static": static(), "routed": routed_verdict(0.2), "shipped": static() | routed_verdict(0.2), "geometry": routed_verdict(0.3, geo=True)}


@query("v5_routed_policies", policies_sql(_POL, source="ro")[0], _ROUTED, policies_sql(_POL, source="ro")[1])
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.policies(routed_rows(spark, sf_dir), three_policies())


@query("u5_static_or_routed", f"SELECT count(*) FILTER ({K2}) AS static, count(*) FILTER ({_POL['shipped']}) AS shipped, count(*) FILTER ({K2} AND NOT {_POL['shipped']}) AS lost FROM ro", _ROUTED)
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = three_policies()
    return routed_rows(spark, sf_dir).agg(m.count_if(p["static"]).alias("static"), m.count_if(p["shipped"]).alias("shipped"), m.count_if(p["static"] & ~p["shipped"]).alias("lost"))


@query("v6_tau_sweep", f"SELECT tau, tp, fp, fn, tn, {PRF} FROM c ORDER BY round({F1}, 6) DESC, tau LIMIT 1", _ROUTED, f"c AS (SELECT tau, {conf(routed_sql('tau'))} FROM ro, (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4), (0.5)) q(tau) WHERE train GROUP BY tau)")
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = sweeps.grid(routed_rows(spark, sf_dir).where("train"), "tau", [0.1, 0.2, 0.3, 0.4, 0.5])
    return sweeps.best(m.evaluate(swept, routed_verdict(F.col("tau")), ["tau"]), "tau")


@query("v8_geometry_counterfactual", "SELECT policy, round(avg(hit::INT) FILTER (manipulation_type = 'flip_rotate_mirror'), 6) AS flip_recall, round(avg(hit::INT) FILTER (manipulation_type = 'resize_crop_reposition'), 6) AS crop_recall, round(avg(hit::INT) FILTER (NOT is_copy), 6) AS false_rate FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS policy, manipulation_type, is_copy, {h} AS hit FROM ro" for n, h in _POL.items()) + ") GROUP BY 1", _ROUTED)
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), h.alias("hit")) for n, h in three_policies().items())))
    rows = routed_rows(spark, sf_dir).select("manipulation_type", "is_copy", each.alias("x")).select("manipulation_type", "is_copy", "x.*")
    rate = lambda test: F.round(F.avg(F.when(test, F.col("hit").cast("int"))), 6)
    kind = F.col("manipulation_type")
    return rows.groupBy("policy").agg(rate(kind == v.GEOMETRY[0]).alias("flip_recall"), rate(kind == v.GEOMETRY[1]).alias("crop_recall"), rate(~F.col("is_copy")).alias("false_rate"))


@query("a24_category_delta", f"SELECT manipulation_type, round(avg(({_POL['routed']})::INT) - avg(({K2})::INT), 6) AS delta, avg(({_POL['routed']})::INT) < avg(({K2})::INT) - 1e-9 AS regressed FROM ro GROUP BY 1", _ROUTED)
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = three_policies()
    rate = lambda n: F.avg(p[n].cast("int"))
    return routed_rows(spark, sf_dir).groupBy("manipulation_type").agg(F.round(rate("routed") - rate("static"), 6).alias("delta"), (rate("routed") < rate("static") - 1e-9).alias("regressed"))


@query("v2_quorum_verdict", f"SELECT original, copy, CASE n WHEN 4 THEN k >= 2 WHEN 3 THEN k >= 2 WHEN 2 THEN k >= 1 ELSE k >= greatest(1, n) END AS verdict FROM (SELECT original, copy, 2 + (colour <= 0.2)::INT + (detail <= 0.2)::INT AS n, {fired('ahash')}::INT + {fired('phash')}::INT + (colour <= 0.2 AND {fired('hsvhash')})::INT + (detail <= 0.2 AND {fired('orb')})::INT AS k FROM ro)", _ROUTED)
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = v.healthy_panel(F.col("detail"), F.col("colour"), 0.2)
    return routed_rows(spark, sf_dir).select("original", "copy", v.quorum_verdict(v.COUNT_PANEL, T, ok, {4: 2, 3: 2, 2: 1}).alias("verdict"))


@query("v1_votes", f"SELECT original, copy, {voted(v.COUNT_PANEL)}::INT AS votes, {K2} AS verdict FROM scored")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("original", "copy", v.votes(v.COUNT_PANEL, T).alias("votes"), static().alias("verdict"))


_SOFT = {"ahash": "1.0::DOUBLE", "phash": "1.0::DOUBLE", "hsvhash": "1.0::DOUBLE - colour", "shash": "1.0::DOUBLE - detail", "orb": "1.0::DOUBLE - detail"}
_WSUM = " + ".join(f"CASE WHEN {fired(s)} THEN {w} ELSE 0.0::DOUBLE END" for s, w in _SOFT.items())
WEIGHT_STEPS = [round(0.5 + 0.1 * k, 1) for k in range(26)]


@query("v11_weighted_vote", f"SELECT d, tp, fp, fn, tn, {PRF} FROM c", _ROUTED, f"c AS (SELECT d, {conf(f'round({_WSUM}, 9) >= d')} FROM ro, (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in WEIGHT_STEPS) + ") q(d) GROUP BY d)")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.round(v.weighted(v.SIGNALS, T, v.soft_weights(F.col("detail"), F.col("colour"))), 9)
    swept = sweeps.grid(routed_rows(spark, sf_dir).withColumn("total", total), "d", WEIGHT_STEPS)
    return m.evaluate(swept, F.col("total") >= F.col("d"), ["d"])


_DETECT = "de AS (SELECT signal, manipulation_type, avg(hit::INT) FILTER (score IS NOT NULL) AS detection FROM lo WHERE train GROUP BY ALL)"


@query("v9_detection_weighted_vote", "SELECT original, copy, round(sum(CASE WHEN hit THEN w ELSE 0 END), 5) AS weight FROM (SELECT lo.original, lo.copy, lo.signal, lo.hit, sum(p.share * coalesce(de.detection, 0)) AS w FROM lo JOIN (" + " UNION ALL ".join(f"SELECT copy, '{c}' AS manipulation_type, p{k} AS share FROM proba" for k, c in enumerate(CLASSES)) + ") p ON p.copy = lo.copy LEFT JOIN de ON de.signal = lo.signal AND de.manipulation_type = p.manipulation_type WHERE lo.is_copy GROUP BY ALL) GROUP BY ALL", _LONG, _DETECT)
def v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("manipulation_type"), F.col(f"p{k}").alias("share")) for k, c in enumerate(CLASSES))))
    p = canvas.probabilities(spark, sf_dir).select("copy", each.alias("x")).select("copy", "x.*").join(F.broadcast(detection_map(spark, sf_dir)), "manipulation_type")
    weights = p.groupBy("copy", "signal").agg(F.sum(F.col("share") * F.coalesce("detection", F.lit(0.0))).alias("w"))
    rows = melted(scored(spark, sf_dir).where("is_copy")).join(weights, ["copy", "signal"])
    return rows.groupBy("original", "copy").agg(F.round(F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)), 5).alias("weight"))


_MULTI = {"A": K2L, "B": routed_sql("0.2", True, panel=v.LIST_PANEL) + f" OR {K2L}", "Bpure": routed_sql("0.2", True, panel=v.LIST_PANEL), "Bprime": K2, "Cstat": f"{voted(v.SIGNALS)} >= 2", "C": routed_sql("0.2", True, panel=v.SIGNALS)}


@query("v12_policy_set", policies_sql(_MULTI, source="ro")[0], _ROUTED, policies_sql(_MULTI, source="ro")[1])
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.policies(routed_rows(spark, sf_dir), policy_set())


def policy_set() -> dict:
    lists, pure = v.at_least(v.LIST_PANEL, T, 2), routed_verdict(0.2, True, panel=v.LIST_PANEL)
    return {"A": lists, "B": pure | lists, "Bpure": pure, "Bprime": static(), "Cstat": v.at_least(v.SIGNALS, T, 2), "C": routed_verdict(0.2, True, panel=v.SIGNALS)}


@query("a28_policy_delta", f"SELECT policy, round({F1}, 6) AS f1, round(round({F1}, 6) - (SELECT round({F1}, 6) FROM c WHERE policy = 'A'), 6) AS delta FROM c", _ROUTED, policies_sql(_MULTI, source="ro")[1])
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.policies(routed_rows(spark, sf_dir), policy_set()).select("policy", "f1")
    return out.crossJoin(F.broadcast(out.where("policy = 'A'").select(F.col("f1").alias("of_a")))).select("policy", "f1", F.round(F.col("f1") - F.col("of_a"), 6).alias("delta"))


_FROZEN = {s: x for s, x in v.FROZEN.items()}
_DEPLOYED = {"published": f"{voted(v.LIST_PANEL, _FROZEN)} >= 2", **{f"orb{k}": f"{voted(v.COUNT_PANEL, _FROZEN | {'orb': k})} >= 2" for k in v.FROZEN_COUNT}}


@query("v13_as_deployed", policies_sql(_DEPLOYED)[0], policies_sql(_DEPLOYED)[1])
def v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.policies(scored(spark, sf_dir), {"published": v.at_least(v.LIST_PANEL, v.FROZEN, 2), **{f"orb{k}": v.at_least(v.COUNT_PANEL, v.FROZEN | {"orb": k}, 2) for k in v.FROZEN_COUNT}})


_CROSS = {"static": K2, "fallback": f"({K2} OR {routed_sql('0.5')})", "pure": routed_sql("0.5")}


@query("v14_cross_generator", policies_sql(_CROSS, source="ro WHERE NOT train")[0], _ROUTED, policies_sql(_CROSS, source="ro WHERE NOT train")[1])
def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    pure = routed_verdict(0.5)
    return m.policies(routed_rows(spark, sf_dir).where("not train"), {"static": static(), "fallback": static() | pure, "pure": pure})


_BY = {"lists": K2L, "counts": K2}


@query("v15_static_report", policies_sql(_BY, "manipulation_type")[0], policies_sql(_BY, "manipulation_type")[1])
def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.policies(scored(spark, sf_dir), {"lists": v.at_least(v.LIST_PANEL, T, 2), "counts": static()}, ["manipulation_type"])


# ---- more aggregates


@query("a30_two_way_grid", f"SELECT v, r, round(100 * {F1}, 2) AS f1, round(100 * {P}, 2) AS precision, round(100 * {R}, 2) AS recall, round(100 * {div('tp + tn', 'tp + fp + fn + tn')}, 2) AS accuracy, tp, tn, fp, fn FROM c", f"c AS (SELECT v::INT AS v, r::INT AS r, {conf('votes > v AND coalesce(orb, 0) > r')} FROM (SELECT *, {voted(v.LIST_PANEL)} AS votes FROM scored), (VALUES (1), (2), (3), (4), (5), (6)) a(v), (VALUES (1), (2), (3), (4), (6), (8), (10)) b(r) GROUP BY ALL)")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("is_copy", v.votes(v.LIST_PANEL, T).alias("votes"), F.coalesce("orb", F.lit(0)).alias("inliers"))
    return sweeps.two_way_grid(rows, "votes", "inliers", [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 6, 8, 10])


@query("t2_sorted_grid", f"SELECT v, r, f1 FROM (SELECT v, r, round(100 * {F1}, 2) AS f1 FROM c) ORDER BY f1 DESC, v, r LIMIT 5", f"c AS (SELECT v::INT AS v, r::INT AS r, {conf('votes > v AND coalesce(orb, 0) > r')} FROM (SELECT *, {voted(v.LIST_PANEL)} AS votes FROM scored), (VALUES (1), (2), (3), (4), (5), (6)) a(v), (VALUES (1), (2), (3), (4), (6), (8), (10)) b(r) GROUP BY ALL)")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a30(spark, sf_dir).select("v", "r", "f1").orderBy(F.desc("f1"), "v", "r").limit(5)


@query("a31_score_summary", "SELECT is_copy, min(orb) AS least, round(avg(orb), 6) AS mean, max(orb) AS most FROM scored GROUP BY 1")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("is_copy").agg(F.min("orb").alias("least"), F.round(F.avg("orb"), 6).alias("mean"), F.max("orb").alias("most"))


@query("a32_descriptor_budget", "SELECT budget::INT AS budget, median(least(orb, budget)) AS median, 32 * median(least(orb, budget)) AS bytes, round(32 * median(least(orb, budget)) / 400, 6) AS transactions FROM scored, (VALUES (64), (32), (16), (8)) b(budget) WHERE orb IS NOT NULL GROUP BY 1")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_rows(spark, sf_dir).groupBy("budget").agg(F.expr("percentile(kept, 0.5)").alias("median")).select("budget", "median", (32 * F.col("median")).alias("bytes"), F.round(32 * F.col("median") / 400, 6).alias("transactions"))


def budget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweeps.grid(scored(spark, sf_dir).where("orb is not null"), "budget", [64, 32, 16, 8])
    return rows.withColumn("kept", F.least("orb", "budget"))


@query("w7_delta_to_largest_budget", "SELECT budget, mean, round(mean - first_value(mean) OVER (ORDER BY budget DESC), 6) AS delta FROM (SELECT budget::INT AS budget, round(avg(least(orb, budget)), 6) AS mean FROM scored, (VALUES (64), (32), (16), (8)) b(budget) WHERE orb IS NOT NULL GROUP BY 1)")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = budget_rows(spark, sf_dir).groupBy("budget").agg(F.round(F.avg("kept"), 6).alias("mean"))
    return means.withColumn("delta", F.round(F.col("mean") - F.first("mean").over(Window.partitionBy().orderBy(F.desc("budget"))), 6))


@query("a33_label_conflicts", "SELECT copy, min(manipulation_type) AS kind FROM pairs WHERE is_copy GROUP BY copy")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canvas.pairs(spark, sf_dir).where("is_copy").groupBy("copy").agg(F.count_distinct("manipulation_type").alias("n"), F.min("manipulation_type").alias("kind"))
    conflict = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two labels of "), F.col("copy"))).cast("string"))
    return found.select("copy", F.coalesce(conflict, F.col("kind")).alias("kind"))


@query("a34_class_balance", "SELECT is_copy, count(*) AS n, round(count(*) / (SELECT count(*) FROM pairs), 6) AS share FROM pairs GROUP BY 1")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = canvas.pairs(spark, sf_dir).groupBy("is_copy").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("a35_trigger_rate", "SELECT manipulation_type, round(avg((detail > 0.2)::INT), 6) AS detail, round(avg((colour > 0.2)::INT), 6) AS colour FROM ro GROUP BY 1", _ROUTED)
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c: F.round(F.avg((F.col(c) > 0.2).cast("int")), 6).alias(c)
    return routed_rows(spark, sf_dir).groupBy("manipulation_type").agg(rate("detail"), rate("colour"))


def _best_sub(where: str, name: str) -> str:
    return f"{name} AS (SELECT th FROM (SELECT th, {conf(fired('orb', 'th'))} FROM scored, range(0, 65) r(th) WHERE {where} GROUP BY th) ORDER BY round({F1}, 6) DESC, th LIMIT 1)"


@query("a36_cost_of_global_tuning", f"SELECT which, tp, fp, fn, tn, {PRF} FROM c", _best_sub("true", "g1"), _best_sub(f"manipulation_type IN {GEO} OR NOT is_copy", "g2"), f"c AS (SELECT which, {conf(fired('orb', 'th'))} FROM scored, (SELECT 'global' AS which, th FROM g1 UNION ALL SELECT 'own', th FROM g2) WHERE manipulation_type IN {GEO} OR NOT is_copy GROUP BY 1)")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    own = s.where(F.col("manipulation_type").isin(*v.GEOMETRY) | ~F.col("is_copy"))
    th = lambda df, name: sweeps.best(sweeps.curve(df, "orb", range(65)), "threshold").select(F.lit(name).alias("which"), F.col("threshold").alias("th"))
    return m.evaluate(own.crossJoin(F.broadcast(th(s, "global").union(th(own, "own")))), v.fires("orb", F.col("th")), ["which"])


@query("a37_recall_at_precision", f"SELECT max(r) FILTER (p >= 0.9) AS recall FROM (SELECT round({P}, 6) AS p, round({R}, 6) AS r FROM c)", _curve("orb", "range(0, 65) r(th)"))
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.curve(scored(spark, sf_dir), "orb", range(65)).agg(F.max(F.when(F.col("precision") >= 0.9, F.col("recall"))).alias("recall"))


@query("a38_membership_confusion", f"SELECT tp, fp, fn, tn, {PRF} FROM c", f"c AS (SELECT {conf('base % 3 = 0')} FROM pairs)")
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = j6(spark, sf_dir).join(canvas.pairs(spark, sf_dir), ["original", "copy"])
    return m.evaluate(rows, F.col("original_in"))


# ---- windows, order and sets


@query("w1_first_seen", "SELECT copy, min(original) AS original FROM pairs GROUP BY copy")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.first_of(canvas.pairs(spark, sf_dir).select("copy", "original"), ["copy"], "original")


@query("w2_last_wins", "SELECT copy, max(original) AS original FROM pairs GROUP BY copy")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.last_of(canvas.pairs(spark, sf_dir).select("copy", "original"), ["copy"], "original")


@query("w3_first_of_collection", "SELECT collection, image FROM (SELECT string_split(image, '_')[1] AS collection, image, row_number() OVER (PARTITION BY string_split(image, '_')[1] ORDER BY image) AS n FROM images WHERE kind IS NULL) WHERE n <= 5")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canvas.images(spark, sf_dir).where("kind is null").select(t.collection_of(F.col("image")).alias("collection"), "image")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("collection").orderBy("image"))).where("n <= 5").drop("n")


@query("w5_false_rate_curve", "SELECT th AS distance, round(sum(count(*) FILTER (ahash = th)) OVER (ORDER BY th) / (SELECT count(*) FROM scored WHERE NOT is_copy), 6) AS rate FROM scored, range(0, 65) r(th) WHERE NOT is_copy GROUP BY th")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sweeps.curve(scored(spark, sf_dir).where("not is_copy"), "ahash", range(65))
    return points.select(F.col("threshold").cast("long").alias("distance"), F.round(F.col("fp") / (F.col("fp") + F.col("tn")), 6).alias("rate"))


@query("w8_chunks", "SELECT chunk, count(*) AS n FROM (SELECT ntile(8) OVER (ORDER BY image) AS chunk FROM images WHERE kind IS NULL) GROUP BY 1")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canvas.images(spark, sf_dir).where("kind is null")
    return rows.select(F.ntile(8).over(Window.partitionBy().orderBy("image")).cast("long").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


@query("t3_top_shares", "SELECT image, list_sum(list_slice(list_reverse_sort(n), 1, 5))::DOUBLE / 64 AS top5, list_max(n)::DOUBLE / 64 AS dominant FROM (SELECT image, list(c) AS n FROM (SELECT image, floor(x * 20) AS bin, count(*) AS c FROM (SELECT image, unnest(v) AS x FROM images WHERE kind IS NULL) GROUP BY ALL) GROUP BY 1)")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = canvas.images(spark, sf_dir).where("kind is null").select("image", F.explode("v").alias("x"))
    counts = cells.groupBy("image", F.floor(F.col("x") * 20).alias("bin")).count().groupBy("image").agg(F.sort_array(F.collect_list("count"), False).alias("n"))
    return counts.select("image", (F.aggregate(F.slice("n", 1, 5), F.lit(0).cast("long"), lambda a, x: a + x) / 64).alias("top5"), (F.col("n")[0] / 64).alias("dominant"))


@query("t4_first_originals", "SELECT DISTINCT original FROM pairs ORDER BY original LIMIT 60")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.pairs(spark, sf_dir).select("original").distinct().orderBy("original").limit(60)


@query("t5_first_failures", f"SELECT original, copy FROM scored WHERE is_copy AND NOT ({K2}) ORDER BY original, copy LIMIT 10")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(F.col("is_copy") & ~static()).select("original", "copy").orderBy("original", "copy").limit(10)


@query("t6_seeded_sample", "SELECT copy FROM (SELECT DISTINCT copy FROM pairs) ORDER BY md5('42' || copy), copy LIMIT 100")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.pairs(spark, sf_dir).select("copy").distinct().orderBy(F.md5(F.concat(F.lit("42"), "copy").cast("binary")), "copy").limit(100)


@query("t7_split", "SELECT image, row_number() OVER (ORDER BY md5('42' || image), image) <= floor((SELECT count(*) FROM img) * 0.8) AS train FROM img")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = canvas.bases(spark, sf_dir).select("image")
    w = Window.partitionBy()
    return b.select("image", (F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("42"), "image").cast("binary")), "image")) <= F.floor(F.count("*").over(w) * 0.8)).alias("train"))


@query("u1_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT original AS x FROM pairs UNION ALL SELECT copy FROM pairs) UNION ALL SELECT 'distinct', count(*) FROM (SELECT original AS x FROM pairs UNION SELECT copy FROM pairs) UNION ALL SELECT 'intersect', count(*) FROM (SELECT original FROM pairs INTERSECT SELECT copy FROM pairs) UNION ALL SELECT 'except', count(*) FROM (SELECT copy FROM pairs EXCEPT SELECT original FROM pairs)")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = canvas.pairs(spark, sf_dir)
    a, b = p.select(F.col("original").alias("x")), p.select(F.col("copy").alias("x"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union", a.union(b)).union(n("distinct", a.union(b).distinct())).union(n("intersect", a.intersect(b))).union(n("except", b.subtract(a)))


# ---- generator and reports


@query("m1_variants", "SELECT image, kind, round(list_sum(v), 6) AS total, round(v[1], 6) AS first_cell, round(v[64], 6) AS last_cell FROM images WHERE kind IS NOT NULL")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return canvas.images(spark, sf_dir).where("kind is not null").select("image", "kind", F.round(total, 6).alias("total"), F.round(F.col("v")[0], 6).alias("first_cell"), F.round(F.col("v")[63], 6).alias("last_cell"))


@query("m9_split_counts", "SELECT original, count(*) FILTER (is_copy) AS positives, count(*) FILTER (NOT is_copy) AS negatives FROM pairs GROUP BY 1")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.pairs(spark, sf_dir).groupBy("original").agg(m.count_if(F.col("is_copy")).alias("positives"), m.count_if(~F.col("is_copy")).alias("negatives"))


@query("g4_mirror_max", "SELECT original, copy, orb::DOUBLE AS orb FROM scored WHERE manipulation_type = 'flip_rotate_mirror'")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("manipulation_type = 'flip_rotate_mirror'").select("original", "copy", F.col("orb").cast("double").alias("orb"))


@query("g7_budget_curve", "SELECT budget::INT AS budget, th::INT AS threshold, count(*) FILTER (is_copy AND least(orb, budget) > th) AS tp, count(*) FILTER (NOT is_copy AND least(orb, budget) > th) AS fp FROM scored, (VALUES (64), (32), (16), (8)) b(budget), (VALUES (4), (7), (15), (31)) q(th) WHERE orb IS NOT NULL GROUP BY ALL")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = sweeps.grid(budget_rows(spark, sf_dir), "threshold", [4, 7, 15, 31])
    hit = F.col("kept") > F.col("threshold")
    return swept.groupBy("budget", "threshold").agg(m.count_if(F.col("is_copy") & hit).alias("tp"), m.count_if(~F.col("is_copy") & hit).alias("fp"))


@query("g8_flip_diagnosis", "SELECT string_split(original, '_')[1] AS collection, " + ", ".join(f"round(avg((orb > 24)::INT) FILTER (ends_with(copy, '__{k}')), 6) AS {n}" for k, n in enumerate(("mirror", "upside", "rotated"))) + " FROM scored WHERE manipulation_type = 'flip_rotate_mirror' AND orb IS NOT NULL GROUP BY 1")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("manipulation_type = 'flip_rotate_mirror' and orb is not null").withColumn("collection", t.collection_of(F.col("original")))
    rate = lambda k: F.round(F.avg(F.when(F.col("copy").endswith(f"__{k}"), (F.col("orb") > 24).cast("int"))), 6)
    return rows.groupBy("collection").agg(*(rate(k).alias(n) for k, n in enumerate(("mirror", "upside", "rotated"))))


_TWO = {"shash": fired("shash"), "orb": fired("orb")}


@query("z5_two_signals", policies_sql(_TWO, "collection", "(SELECT *, string_split(copy, '_')[1] AS collection FROM scored)")[0], policies_sql(_TWO, "collection", "(SELECT *, string_split(copy, '_')[1] AS collection FROM scored)")[1])
def z5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.policies(scored(spark, sf_dir).withColumn("collection", t.collection_of(F.col("copy"))), {s: v.fires(s, T[s]) for s in ("shash", "orb")}, ["collection"])


@query("z6_category_report", "SELECT manipulation_type, count(*) AS n, count(*) FILTER (orb > 24) AS hits, round(count(*) FILTER (orb > 24) / count(*), 6) AS rate, median(orb) AS median FROM scored WHERE orb IS NOT NULL GROUP BY 1")
def z6(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("orb") > 24
    return scored(spark, sf_dir).where("orb is not null").groupBy("manipulation_type").agg(F.count("*").alias("n"), m.count_if(hit).alias("hits"), F.round(m.count_if(hit) / F.count("*"), 6).alias("rate"), F.expr("percentile(orb, 0.5)").alias("median"))


@query("z11_two_directories", "SELECT base, min(image) FILTER (kind IS NULL OR kind = 'exact_copy') AS image FROM images GROUP BY 1")
def z11(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = canvas.images(spark, sf_dir)
    both = images.where("kind is null").select("base", "image", F.lit(0).alias("priority")).union(images.where("kind = 'exact_copy'").select("base", "image", F.lit(1)))
    return t.first_of(both, ["base"], "priority").select("base", "image")


@query("flagship", _CAT.replace("f1 FROM c, fa", "f1, fl.floor FROM c, fa, fl"), *_cat(K2), "fl AS (SELECT round(2 * s / (s + 1), 6) AS floor FROM (SELECT count(*) FILTER (is_copy) / count(*)::DOUBLE AS s FROM scored))")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection of each kind of copy by two votes of four, beside the F1 of calling every pair a copy."""
    s = scored(spark, sf_dir)
    floor = s.agg(m.flag_everything(m.count_if(F.col("is_copy")), m.count_if(~F.col("is_copy"))).alias("floor"))
    return m.by_category(s, static()).crossJoin(F.broadcast(floor))
