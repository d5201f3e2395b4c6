"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and hands the reread rows to the next.
Null ids pass the filters that cannot name them; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presence.llm import decontaminate, hyperminhash, packing, paragraphs, pu_quality
from presence.llm.textkit import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    judged = pu_quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = judged.filter("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity 0.8), and of repeated rows (same id and text) one."""
    found = hyperminhash.near_duplicates(docs)
    gone = found.filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    named = left.filter("doc_id is not null").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return named.drop("__text").unionByName(left.filter("doc_id is null"))


def duplicate_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs and passages that another document keeps."""
    return paragraphs.cut_spans(docs, stored(paragraphs.duplicate_spans(docs, clustered=False), "spans"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    leaks = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("duplicate_paragraphs", duplicate_paragraphs),
    ("decontamination", decontamination),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


# The stages hash, fit and pack: SQL cannot say them. tests/llm hold run()
# against a brute-force version.
ORACLE_SQL = None
