"""A training corpus from `documents`: toxic texts go, then repeated lines, near-duplicate documents and repeated
passages; what is left is packed into sequences. Each stage reads what the one before it has written.

Null texts stay to the end and are packed as empty. A document that had words goes when a stage has left it none.
Repeated doc_ids are told apart by their texts, except in the near-duplicate stage, where they are one node. Empty
tables give no rows. Columns besides those of `documents` are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm import jaccard, lines, packing, suffixes, toxicity
from twinscope.llm.common import small_batches, stored, table, without
from twinscope.llm.registry import tokenizer_path

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns in one, so that no name clashes with what an operator adds."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the new text and its length."""
    old = lambda c: F.col(f"row.`{c}`")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(old("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, old(c)).alias(c) for c in docs.columns))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup(_slim(docs)).where(F.col("text").isNull() | (F.col("n_removed") == 0) | F.col("text").rlike(_HAS_WORD))
    return _restored(out, docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = stored(jaccard.near_duplicates(docs), "near-duplicates")
    return without(docs, found.where("component_id <> doc_id")).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(_slim(docs), rewrite=True).where(F.col("text").isNull() | (F.size("spans") == 0) | F.col("text").rlike(_HAS_WORD))
    return _restored(out, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), keeps=False)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express these stages; tests hold them against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
