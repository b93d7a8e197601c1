"""The corpus pipeline: what each stage does to a small table, and that clean documents stay."""

import pytest
from test_operators import SCHEMA, brute_components, prose, texts

import corpus_pipeline
from conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = [(k, t, "en", "s", len(t) if t else None) for k, t in enumerate(texts())] + [(100 + k, prose(700 + k, 80), "en", "s", 1) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").where("false").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(range(100, 110)) <= set(after), name
        if name == "n-gram Jaccard join":
            of = brute_components(before.items())
            assert set(after) == {k for k, (_, c) in of.items() if c == k}
        assert all(t is None or t == before[k] or t.strip() for k, t in after.items())
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert after[0] is None


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(range(100, 110)) <= set(out["doc_id"]) and (out.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_empty_tables_and_more_columns(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
