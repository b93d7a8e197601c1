"""Each operator on a small table with nulls, empty and long texts, repeated rows and extra columns, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from twinscope.llm import ann, idcodec, jaccard, licences, lines, packing, quality, registry, suffixes, toxicity, viterbi
from twinscope.llm.components import components

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rid int, kept string, line int"
VOCABULARY = "the of and to in is that it was for on are as with be at this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    out = [VOCABULARY[i] + str(rng.integers(0, 40)) for i in rng.integers(0, len(VOCABULARY), n)]
    return "\n".join(" ".join(out[k : k + 12]) + "." for k in range(0, n, 12))


def texts():
    a, b, passage = prose(1, 300), prose(2, 200), prose(9, 70)
    near = a.replace("the", "tha", 2)
    return [
        None, "", " \n\t ", "one two", "one two", "One Two", a, a, near, b, b + " " + passage, prose(3, 150) + "\n" + passage + "\n" + prose(4, 50), passage,
        "Ünï çødé ✓ 日本語 " * 30, "x" * 3000, ("same line that repeats itself here\n" * 40), prose(5, 6000),
        "Licensed under the Apache License, Version 2.0.", prose(6, 60) + "\nReleased under the MIT License.\n" + prose(7, 60), "you idiot, worthless moron! " * 5,
        "same line that repeats itself hera\nanother line of some length to keep", "\n\n", "a\x00b " * 20,
    ]


def thue_morse(n):
    """Two words that sums of powers modulo 2**64 can't tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 2}" if k % 5 else None, len(t) if t else None, "x", k, None, 1) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- 1 licence scans


def test_licences(spark):
    files = [(1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.txt", "some words"), (3, "a/y.txt", "other words"), (4, "a/b/z.txt", "text\nReleased under the MIT License.\nmore"), (5, None, None), (6, "LICENSE", ""), (2, "a/b/c/x.txt", "some words")]
    out = licences.scan(spark.createDataFrame(files, "file_id long, path string, text string").withColumn("extra", F.lit(1))).collect()
    found = {r["file_id"]: (r["licence"], r["origin"], r["from_dir"]) for r in out}
    assert found == {1: ("Apache-2.0", "header", None), 2: ("Apache-2.0", "directory", "a/b"), 3: (None, "none", None), 4: ("MIT", "header", None), 5: (None, "none", None), 6: (None, "none", None)}
    assert licences.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_licence_cosine(spark):
    texts_ = ["Licensed under the Apache License, Version 2.0. Really.", "nothing of that", "the the the"]
    files = spark.createDataFrame([(k, f"d{k}/{k}", t) for k, t in enumerate(texts_)], "file_id long, path string, text string")
    split = lambda t: Counter(x for x in re.split("[^a-z0-9]+", t.lower()) if x)
    idf = lambda w: math.log(4 / (1 + sum(w in split(t) for t in texts_))) + 1
    vec = lambda t: {w: c * idf(w) for w, c in split(t).items()}
    a, b = vec(texts_[0]), vec(licences.TEMPLATES["Apache-2.0"][0])
    dot = sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = {r["file_id"]: r["cosine"] for r in licences.scan(files).collect()}
    assert got[0] == pytest.approx(dot, abs=1e-5) and got[1] is None


def test_licences_equal_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(registry.ORACLES["op1_license_scan"]).df()
    got = registry.QUERIES["op1_license_scan"](spark, "/root/testdata/sf0.01").toPandas()
    same_rows(got, want)
    assert {"header", "directory", "none"} <= set(got["origin"])
    mit = licences.TEMPLATES["MIT"][2]
    wrapped = "// Permission is hereby granted, free of\n// charge, to any person obtaining\n// a copy of this software"
    rows = [(1, "a/x", "Released under the MIT License."), (1, "a/x", "Released under the MIT License."), (1, "a/x", prose(3, 40)), (None, "a/b/y", None), (None, "a/b/z", mit), (None, "a/b/z", "Released under the MIT Licence."), (7, None, prose(4, 30) + "\n\n" + wrapped + "\n \n" + prose(5, 30)), (8, "c/d", prose(6, 900) * 3)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    con.register("files", files.toPandas())
    got = licences.scan(files).toPandas()
    same_rows(got, con.execute(licences.oracle("SELECT file_id, path, text FROM files")).df())
    assert len(got) == len(rows) and (got["licence"] == "MIT").sum() >= 5


def same_rows(got, want):
    key = lambda df: sorted(tuple("" if x is None or x != x else str(round(x, 5) + 0.0 if isinstance(x, float) else x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_licence_weights_of_common_words(spark):
    line = "Licensed under the Apache License, Version 2.0. nich und der ist das."
    found = []
    for n in (100, 3000):
        files = spark.range(1, n).selectExpr("id AS file_id", "concat('d/', id) AS path", "if(id % 20 = 0, 'nich und der ist das apache licensed license version under 2 0 the', 'nich und der ist das the') AS text")
        files = files.union(spark.createDataFrame([(0, "e/0", line)], files.schema))
        found += [(r["licence"], r["origin"]) for r in licences.scan(files).where("file_id = 0").collect()]
    assert found == [("Apache-2.0", "header")] * 2


# ---- 2 quality rules


def test_quality_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(registry.ORACLES["op2_line_quality"]).df()
    got = registry.QUERIES["op2_line_quality"](spark, SMALL).toPandas()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_quality_cases(docs, none):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for k, t in enumerate(texts()):
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen = [x for x in (t or "").split("\n") if words(x)]
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_repeat_words"], got[k]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(at), len(seen) - len(set(seen)))
        assert got[k]["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and not (got[k]["base_failed"] and got[k]["kept"])
    assert quality.judge(none).count() == 0


def test_quality_of_repeated_rows_and_null_ids(spark):
    con = duckdb.connect()
    shared = "\n".join(f"shared line number {k} with some words in it" for k in range(3))
    rows = [(k, shared + "\n" + prose(k + 50, 60), "h") for k in range(14)]
    rows += [rows[0], rows[0], (0, shared + "\n" + prose(99, 60), "h"), (None, shared + "\n" + prose(98, 80), "h"), (None, shared, None), (None, None, "h"), (None, None, "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1))
    con.register("documents", table.toPandas())
    got = quality.judge(table).toPandas()
    same_rows(got, con.execute(registry.ORACLES["op2_line_quality"]).df())
    assert len(got) == len(rows) and (got["n_removed_lines"] == 3).sum() == 18


def test_frequent_lines_deplete(spark):
    body = "\n".join(f"shared line number {k} with some words in it" for k in range(9))
    rows = [(k, body + f"\n{prose(k + 50, 8)}", "h") for k in range(15)] + [(99, prose(77, 90), "h")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(15)) and got[99]


# ---- 3 nearest neighbours


def test_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[600:700] = x[600]
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(1500)] + [(2000, None, 1), (2001, [], 1), (2020, [0.0] * 24, 1), (2040, [float("nan")] * 24, 1), (2060, [1.0] * 3, 1), (2080, [None] + [1.0] * 23, 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), least=50).toPandas()
    assert set(got["query_id"]) == set(range(0, 1500, 20)) and got["vec_id"].max() < 1500
    hit = 0
    for q, part in got.groupby("query_id"):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part["score"], score[part["vec_id"]])
        hit += len(set(order) & set(part["vec_id"]))
    assert hit / (20 * got["query_id"].nunique()) >= 0.9
    ties = got[got["query_id"] == 600].sort_values("rank")["vec_id"].tolist()
    assert ties == list(range(601, 621))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 21, 22, 40])
def test_few_vectors_and_repeated_ids(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 6))
    rows = [(k, [float(v) for v in x[k]]) for k in range(n)] + [(n - 1, [float(v) for v in x[n - 1]]), (None, [1.0] * 6)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit(1))).toPandas()
    ids = np.array([r[0] for r in rows[:-1]])
    y = x[ids]
    for q in range(0, n, 20):
        score = (y * x[q]).sum(1)
        order = [ids[i] for i in np.lexsort((ids, -np.round(score, 9))) if ids[i] != q][:20]
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == order


@pytest.mark.parametrize("kind", ["offset", "copies", "near copies", "wide", "large", "small", "overflow"])
def test_neighbours_are_those_of_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 300 if kind == "wide" else 16))
    x = {"offset": x + 1e4, "large": x * 1e140, "small": x * 1e-90, "overflow": np.abs(x) * 10.0 ** rng.integers(140, 160, (900, 1))}.get(kind, x)
    if "copies" in kind:
        x[300:] = x[300] + (1e-5 * x[300:] if kind == "near copies" else 0)
    ids = rng.permutation(900)
    got = ann.search(spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<double>"), least=50).toPandas()
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.zeros(900)
        with np.errstate(over="ignore"):
            for i in range(x.shape[1]):
                score += x[q, i] * x[:, i]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        part = got[got["query_id"] == ids[q]].sort_values("rank")
        assert part["vec_id"].tolist() == ids[order].tolist() and part["score"].tolist() == score[order].tolist()


def test_blocks_of_the_exact_check_change_nothing(spark):
    rng = np.random.default_rng(12)
    rows = ann.usable(spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(700, 8)).tolist())], "vec_id long, embedding array<double>"))
    quantiser = ann.fit(rows)
    found = ann.index(rows, quantiser)
    asked = found.where("vec_id % 20 = 0").selectExpr("vec_id", "v", "cast(null as double) AS least")
    got = [ann.checked(found, asked, quantiser, 5, size) for size in (64 * 20, 1 << 25)]
    best = [sorted((r["query_id"], -r["score"], r["vec_id"]) for r in g.collect()) for g in got]
    first = [[[r for r in b if r[0] == q][:5] for q in range(0, 700, 20)] for b in best]
    assert first[0] == first[1] and len(best[1]) <= 35 * 5 * ann.PARTS


def test_parts_give_as_many_rows_whatever_the_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 8))
    rows = ann.usable(spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(1200)], "vec_id long, embedding array<double>"))
    quantiser = ann.fit(rows)
    found = ann.index(rows, quantiser)
    queries = found.where("vec_id % 20 = 0").select("vec_id", "v")
    got = [sorted(map(tuple, ann.nearest_by_codes(found, queries, quantiser, 0.45, 10, 100, block).select("query_id", "vec_id").collect())) for block in (7, 5000)]
    assert got[0] == got[1] and 60 * 10 <= len(got[0]) <= 60 * 10 * ann.PARTS


def test_lists_in_blocks():
    first, many = ann.blocks_of(np.array([3, 4, 30, 0, 9, 1, 1]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 4, 5] and many.tolist() == [1, 1, 3, 1, 1, 1, 1]


# ---- 4 line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_band():
    rng = np.random.default_rng(1)
    a = [bytes(rng.integers(97, 100, rng.integers(6, 70)).astype(np.uint8)) for _ in range(400)]
    b = []
    for x in a:
        y = bytearray(x)
        for _ in range(rng.integers(0, 5)):
            p = rng.integers(0, len(y) + 1)
            y[p : p + rng.integers(0, 2)] = bytes([rng.integers(97, 100)] * rng.integers(0, 2))
        b.append(bytes(y))
    raw, ((x, n), (y, m)) = lines._laid(a, b)
    for most in (1, 2, 4):
        assert lines.within(raw, x, n, y, m, most).tolist() == [edits(u, v) <= most for u, v in zip(a, b, strict=True)]


def test_line_dedup(docs, none):
    out = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    takes = lambda x: len(x.encode()) >= 20 and x.strip(WHITE) != ""
    first = {}
    for k, t in enumerate(texts()):
        for n, x in enumerate((t or "").split("\n")):
            if takes(x):
                first.setdefault(x, (k, n))
    names = list(first)
    root = {x: x for x in names}

    def head(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if abs(len(x.encode()) - len(y.encode())) <= 2 and sum((Counter(x.encode()) - Counter(y.encode())).values()) <= 2 and edits(x.encode(), y.encode()) <= 2:
                u, v = head(x), head(y)
                root[max(u, v, key=lambda z: first[z])] = min(u, v, key=lambda z: first[z])
    kept = {first[head(x)] for x in names}
    for k, t in enumerate(texts()):
        rows = (t or "").split("\n")
        want = None if t is None else "\n".join(x for n, x in enumerate(rows) if not takes(x) or (k, n) in kept)
        assert out[k]["text"] == want, k
    assert lines.dedup(none).count() == 0


def test_long_runs_link(spark):
    base = "a common line that many documents vary in one place only: "
    rows = [(k, base + f"{k:04d}") for k in range(200)]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("text <> ''").collect()
    assert [r["doc_id"] for r in out] == [0]


def test_lines_that_rolling_hashes_confuse(spark):
    for n in (1024, 4096):
        rows = list(enumerate(thue_morse(n)))
        assert all(r["n_removed"] == 0 for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_long_runs_of_several_classes(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 40)
    monkeypatch.setattr(lines, "LONG_RUN", 16)
    rng = np.random.default_rng(4)
    base = "the same long beginning of a line that goes on in its own way: "
    tails = ["".join(rng.choice(list("abcdef"), 8)) for _ in range(12)]
    body = []
    for k in range(150):
        t = list(tails[k % 12])
        for _ in range(int(rng.integers(0, 3))):
            t[rng.integers(0, 8)] = "abcdef"[rng.integers(0, 6)]
        body.append(base + "".join(t))
    first = {x: k for k, x in reversed(list(enumerate(body)))}
    names = sorted(first, key=first.get)
    root = {x: x for x in names}

    def head(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for z in names[i + 1 :]:
            if edits(x, z) <= 2:
                u, v = sorted((head(x), head(z)), key=first.get)
                root[v] = u
    out = lines.dedup(spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")).where("text <> ''").collect()
    assert {r["doc_id"] for r in out} == {first[head(x)] for x in names}


# ---- 5 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(d, toxicity.fit(d, known)).join(known, "doc_id").where("held_out").toPandas()
    hit = (scored["predicted"] == 1) & (scored["toxic"] == 1)
    assert hit.sum() / (scored["toxic"] == 1).sum() > 0.75 and hit.sum() / max(1, (scored["predicted"] == 1).sum()) > 0.9
    assert scored["score"].between(0, 1).all()


def test_toxicity_cases(spark, docs, none):
    labels = spark.createDataFrame([(k, int(k == 19)) for k in range(23)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == len(texts()) and toxicity.score(none, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.0}
    known = {r["doc_id"]: r["held_out"] for r in toxicity.score(docs, blank).collect()}
    assert known == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(len(texts()))}


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((toxicity.Trees(depth=3).fit(x, y).raw(x) > 0) == (y > 0)).mean() > 0.95
    knots = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(knots[1]) >= 0).all() and np.interp(2.5, *knots) == 0.5


# ---- 6 packing


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack(docs, path).toPandas()
    total = 0
    for k, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        part = out[out["doc_id"] == k].sort_values("piece")
        assert part["piece"].tolist() == list(range(-(-len(ids) // 1024))) and part["length"].sum() == len(ids) and (part["length"].iloc[1:] == 1024).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 1024
    assert out["sequence_id"].nunique() == -(-total // 1024) or out["sequence_id"].nunique() <= 1.02 * total / 1024 + 2
    assert packing.pack(none, path).count() == 0


def test_fullest_combination():
    rng = np.random.default_rng(2)
    for _ in range(40):
        counts = {int(x): int(rng.integers(1, 3)) for x in rng.integers(1, 30, 5)}
        room, sums = int(rng.integers(1, 60)), {0}
        for x, c in counts.items():
            sums = {s + x * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(x * m for x, m in chosen.items()) == max(s for s in sums if s <= room) and all(m <= counts[x] for x, m in chosen.items())


# ---- 7 Jaccard join


def brute_components(rows):
    sets = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, t in rows:
        w = words((t or "").translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def head(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                u, v = head(i), head(j)
                root[max(u, v)] = min(u, v)
    return {k: (len(s), head(k)) for k, s in sets.items()}


def test_jaccard(docs, none):
    want = brute_components(list(enumerate(texts())))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == want and want[8][1] == 6
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_chains_and_dense_families(spark):
    rng = np.random.default_rng(5)
    base, rows = prose(31, 120).split(), []
    for k in range(90):  # each is a step away from the last, so the ends don't link; all share words
        base = list(base)
        for _ in range(2):
            base[rng.integers(0, len(base))] = f"new{k}_{rng.integers(0, 9)}"
        rows.append((k, " ".join(base)))
    common = prose(32, 40)
    rows += [(200 + k, common + " " + prose(300 + k, 30)) for k in range(80)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 6, (40, 128))
    counts = np.clip(centres[rng.integers(0, 40, 600)] + (rng.random((600, 128)) < 0.02), 0, 254).astype(np.uint16)
    n = counts.sum(1).astype(np.int64)
    low = np.minimum(counts[:, None, :], counts[None, :, :]).sum(-1, dtype=np.int64)
    near = 180 * low >= 80 * (n[:, None] + n[None, :])
    tree = jaccard.CountTree(counts, n)
    got = [tuple(sorted((int(a), int(b)))) for x, y in tree.pairs(tree, 80) for a, b in zip(x, y, strict=True)]
    assert sorted(got) == [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    left, right = jaccard.CountTree(counts[:37], n[:37]), jaccard.CountTree(counts[37:], n[37:])
    got = {(int(a), int(b) + 37) for x, y in left.pairs(right, 80) for a, b in zip(x, y, strict=True)}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near[:37]), strict=True) if b >= 37}


def test_jaccard_blocks_and_hot_shingles(spark):
    """A family above the size of a block, a passage in all documents, and a document of 30,000 shingles with a near copy."""
    rng = np.random.default_rng(8)
    passage, base, rows = prose(33, 60), prose(34, 100).split(), []
    for k in range(120):
        own = list(base)
        for _ in range(int(rng.integers(0, 7))):
            own[rng.integers(0, len(own))] = f"w{rng.integers(0, 99)}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, passage + " " + prose(400 + k, int(rng.integers(8, 60)))) for k in range(150)]
    want = brute_components(rows)
    long = [f"t{k}" for k in rng.integers(0, 10**6, 30_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:1500] + ["other"] + long[1800:]))]
    want |= {900: (29_996, 900), 901: (len({tuple(x) for x in zip(*(rows[-1][1].split()[k:] for k in range(5)), strict=False)}), 900)}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (40_000, jaccard.BLOCK_BYTES):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table, block_bytes=block).collect()}
        assert got == want


def test_groves_leave_out_what_cannot_link(spark):
    """Texts that share a few rare shingles with the next one are in no grove; families below and above MOST_PAIRED are."""
    rng = np.random.default_rng(12)
    rows = [(k, f"chain{k} a b c d e {prose(700 + k, 90)} chain{k + 1} a b c d e") for k in range(60)]
    for f, many in enumerate((2, jaccard.MOST_PAIRED, jaccard.MOST_PAIRED + 1, 40)):
        base = prose(900 + f, 150).split()
        for k in range(many):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[rng.integers(0, len(own))] = f"other{k}"
            rows.append((1000 * (f + 1) + k, " ".join(own[: 150 - int(rng.integers(0, 20))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.profile(docs, 80, *jaccard.sketch(docs))
    assert {r["node"] for r in jaccard.groves(found, docs.select(F.col("doc_id").alias("node")), 80).collect()}.isdisjoint(range(60))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_large_groves_are_split_before_texts_travel(spark, monkeypatch):
    """A sketch too small to tell shingles apart chains all texts with a common passage to one grove; of it only families travel."""
    passage, sent, texts_of = prose(40, 130), [], jaccard.texts_of
    rows = [(k, passage + " " + prose(1200 + k, 150 + k % 40)) for k in range(90)]
    rows += [(200 + k, rows[7 * (k // 3)][1] + f" w{k} x y z") for k in range(30)]
    rows += [(300 + k, prose(50, 3000 + 300 * (k % 2)) + f" v{k} x y z") for k in range(4)]
    monkeypatch.setattr(jaccard, "MOST_BITS", 5)
    monkeypatch.setattr(jaccard, "COUNTS_BLOCK", 20_000)
    monkeypatch.setattr(jaccard, "texts_of", lambda docs, nodes: sent.append({r["node"] for r in nodes.collect()}) or texts_of(docs, nodes))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for block in (20_000, 1 << 20):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, block_bytes=block).collect()}
        assert got == want
    families = {k for k, (_, c) in want.items() if [x[1] for x in want.values()].count(c) > 1}
    assert sent[0] == families and sent[1] > families


def test_pairs_near_by_counts():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 700, 300).tolist() + [9000, 9100, 11000, 9050]
    sets = [np.unique(rng.integers(0, 1 << 53, n).astype(np.uint64)) for n in sizes]
    for k in range(0, 300, 3):
        sets[k + 1] = np.unique(np.append(sets[k][len(sets[k]) // 10 :], sets[k + 1][:2]))
    sets[-1] = np.unique(np.append(sets[-3], sets[-1][:200]))
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    n, counts = np.diff(bounds), jaccard.group_counts(np.concatenate(sets), bounds).to_pylist()
    counts[5] = b""
    i, j = np.triu_indices(len(n), 1)
    low = jaccard.most_shared(n[i], n[j], [counts[k] for k in i], [counts[k] for k in j])
    fits = jaccard.may_link(low, n[i], n[j], 80)
    want = set(zip(i[fits].tolist(), j[fits].tolist(), strict=True))
    side = rng.integers(0, 2, len(n))
    for s in (None, side):
        got = [(min(a, b), max(a, b)) for x, y in jaccard.near_by_counts(n, counts, 80, s) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and {p for p in want if s is None or s[p[0]] != s[p[1]]} == set(got)


def test_folded_counts_bound_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 53, n).astype(np.uint64)) for n in (1, 100, 3000, 4000)] + [np.zeros(0, np.uint64)]
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    counts = [np.frombuffer(c, np.uint8) for c in jaccard.group_counts(np.concatenate(sets), bounds).to_pylist()]
    assert [int(c.sum()) for c in counts] == [len(x) for x in sets] and len(counts[3]) > len(counts[1])
    least = len(counts[1])
    part = jaccard.group_counts(np.sort(np.concatenate([sets[3], sets[1]])), np.array([0, len(sets[3]) + len(sets[1])])).to_pylist()
    assert (np.frombuffer(part[0], np.uint8).reshape(-1, least).sum(0) >= counts[1]).all()


def test_bands_of_sizes_that_link():
    n = np.arange(1, 4000)
    band = jaccard.bands(n, 80)
    assert (band[np.minimum(n * 5 // 4, 3999) - 1] - band <= 1).all() and (np.diff(band) >= 0).all()


def test_jaccard_words_that_rolling_hashes_confuse(spark):
    a, b = thue_morse(2048)
    rows = [(k, " ".join(f"{x}{j}" for j in range(12))) for k, x in enumerate((a, b))]
    assert {r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1}


# ---- 8 token ids


def test_simple8b():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 9000):
        for high in (1, 2, 50_000, 1 << 59, 1 << 63):
            ids = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
            if n > 3:
                ids[:3] = [15 << 60, (15 << 60) + 1, 2**64 - 1]
                ids[n // 2 :: 3] = 0
            run = idcodec.encode(ids)
            assert (idcodec.decode(run) == ids).all()
            if n > 2048:
                assert (idcodec.decode(run, (1, 2)) == ids[1024:2048]).all()
    with pytest.raises(ValueError, match="Simple-8b"):
        idcodec.decode(b"none")


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    idcodec.write_ids(docs, f"file://{tmp_path}/a", path)
    start = 0
    for r in idcodec.read_ids(spark, f"file://{tmp_path}/a").orderBy("doc_id").collect():
        ids = library.encode(texts()[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    idcodec.write_ids(none, f"file://{tmp_path}/b", path)
    assert idcodec.read_ids(spark, f"file://{tmp_path}/b").count() == 0


# ---- 9 suffix arrays


def removed(raws, size=200):
    seen = Counter(x[k : k + size] for x in raws for k in range(len(x) - size + 1))
    out = []
    for x in raws:
        marks = np.zeros(len(x), bool)
        for k in range(len(x) - size + 1):
            if seen[x[k : k + size]] > 1:
                marks[k : k + size] = True
        out.append(marks)
    return out


def test_suffix_dedup(docs, none):
    raws = [(t or "").encode() for t in texts()]
    got = {r["doc_id"]: r for r in suffixes.digest(suffixes.dedup(docs)).collect()}
    for k, (raw, marks) in enumerate(zip(raws, removed(raws), strict=True)):
        kept = bytes(np.frombuffer(raw, np.uint8)[~marks])
        spans = int((np.diff(np.append(False, marks).astype(int)) == 1).sum())
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(raw), int(marks.sum()), spans, hashlib.sha256(kept).hexdigest()), k
    assert suffixes.dedup(none).count() == 0


@pytest.mark.parametrize("meet", [3, 256])
def test_suffix_shards_meet(spark, monkeypatch, meet):
    monkeypatch.setattr(suffixes, "MEET", meet)
    monkeypatch.setattr(suffixes, "SHARD", 4000)
    monkeypatch.setattr(suffixes, "PIECE", 1500)
    passage = prose(90, 60)
    rows = [(k, prose(400 + k, 60) + passage + prose(500 + k, 30)) for k in range(30)] + [(90, prose(91, 900)), (91, prose(91, 900))]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.digest(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    want = removed([t.encode() for _, t in rows])
    assert got == {k: int(m.sum()) for (k, _), m in zip(rows, want, strict=True)}


def test_suffix_repeated_rows_and_a_third(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 4000)
    monkeypatch.setattr(suffixes, "PIECE", 1500)
    rows = []
    for k in range(12):
        passage = prose(700 + k, 50)
        copied = (None if k == 0 else k, prose(720 + k, 150) + passage + prose(740 + k, 150))
        rows += [copied] * (2 + k % 3) + [(100 + k, prose(760 + k, 200) + passage + prose(780 + k, 200))]
    got = suffixes.digest(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = removed([t.encode() for _, t in rows])
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["n_removed"]) for r in got), key=key) == sorted(((i, int(m.sum())) for (i, _), m in zip(rows, want, strict=True)), key=key)


def test_rewritten_text_is_whole(docs):
    for r in suffixes.rewritten(suffixes.dedup(docs)).collect():
        assert (r["text"] is None) == (texts()[r["doc_id"]] is None)


# ---- 10 SentencePiece


def best_score(vocabulary, text):
    best = [0.0] + [-math.inf] * len(text)
    for s in range(len(text)):
        single = bool(vocabulary.known.get(text[s]))
        for e in range(s + 1, min(len(text), s + vocabulary.longest) + 1):
            found = vocabulary.known.get(text[s:e])
            if found:
                best[e] = max(best[e], best[s] + found[0])
        if not single:
            best[s + 1] = max(best[s + 1], best[s] + vocabulary.unknown)
    return best[-1]


def test_viterbi_is_best_and_streams():
    v = viterbi.encoder(registry.tokenizer_path("piece_bpe_32k.model")).vocabulary
    for t in ("the quick brown fox", "  two  spaces ", "日本語 and 😀", "x" * 200, prose(8, 40)[:400]):
        marked = viterbi.MARK + t.replace(" ", viterbi.MARK)
        ids = viterbi.search(v, marked)
        parts = [i for part in viterbi.stream(v, (marked[k : k + 3] for k in range(0, len(marked), 3))) for i in part]
        assert parts == ids
        known = {i: x[0] for x, i in ((x, x[1]) for x in v.known.values() if x)}
        if all(i in known for i in ids):
            assert sum(known[i] for i in ids) == best_score(v, marked)


def test_pieces_equal_a_search_of_whole_texts():
    enc = viterbi.encoder(registry.tokenizer_path("piece_bpe_32k.model"))
    all_ = [t or "" for t in texts()] + list(thue_morse(1024)) + ["donaudampfschifffahrtsgesellschaft " * 3]
    ids, counts = enc.ids(pa.array(all_))
    for t, got in zip(all_, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        marked = viterbi.MARK + t.replace(" ", viterbi.MARK) if t else ""
        assert got.tolist() == [i for part in viterbi.stream(enc.vocabulary, (marked[k : k + 500] for k in range(0, len(marked), 500))) for i in part]


def test_sentencepiece_round_trip(docs, none):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    out = {r["doc_id"]: r for r in viterbi.round_trip(docs, path).collect()}
    assert all(r["same_text"] for r in out.values()) and out[0]["n_ids"] == out[1]["n_ids"] == 0
    back = {r["doc_id"]: r["text"] for r in viterbi.decode(viterbi.encode(docs, path), path).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts())}
    assert viterbi.round_trip(none, path).count() == 0


# ---- what they share


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_at_once_and_by_rounds(spark, monkeypatch, few):
    from twinscope.llm import components as module

    written = []
    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "stored", lambda df, label, stored=module.stored: written.append(label) or stored(df, label))
    edges = [(2 * k, 2 * k + 2) for k in range(40)] + [(5, 3), (3, 5), (7, 7), (-(2**62), 5)]
    got = {r["node"]: r["component"] for r in module.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {2 * k: 0 for k in range(41)} | {5: -(2**62), 3: -(2**62), -(2**62): -(2**62)}
    assert (len(written) == 2) == bool(few)
    assert module.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    root = defaultdict(int, {x: x for e in edges for x in e})

    def head(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = head(a), head(b)
        root[max(u, v)] = min(u, v)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {x: head(x) for a, b in edges if a != b for x in (a, b)}


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    from twinscope.llm.words import WordEncoder

    odd = ["", "  a  b", "a , b", "x\n\ny  z .. ,, q,w", "don't we'll, 's.", "ΑΣ ΣΑ, İstanbul é x", "<|endoftext|> <|startoftext|>a", "a <|endoftext|> b", "x<|ENDOFTEXT|>y <|StartOfText|>", *thue_morse(1024), *thue_morse(4096), "a" * 17 + " " + "a" * 16, "a\tb\r\nc \n d", "1,234.5 a_b_.c", "tr  ", "\x1c a\x85b", "中文 字符。日本語, x", "😀 😀,x", ".,a", "a\x00b, c", "é. É, ×, ÷.", "\n", "\na", " "]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        path = registry.tokenizer_path(name)
        library = Tokenizer.from_file(path)
        all_ = [t or "" for t in texts()] + odd
        ids, counts = WordEncoder(path, kind).ids(pa.array(all_))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in all_]
