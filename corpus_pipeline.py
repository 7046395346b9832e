"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, documents that
hold benchmark items go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the docs of the next. All but the last return the columns of `documents`.

Rows are judged each by its own text: where a doc_id repeats with different texts, a copy or a leak goes and the
other row stays. Rows with a null doc_id have no place among near duplicates and stay there. Null texts count as
empty, which is clean and alone. Rows repeated under one doc_id with one text stay once. Very long texts are read
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import bpe, decontaminate, near_dups, toxicity
from quillmere.llm._spark import saved, sent


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field does not call toxic; it is fitted on the labelled ones among them."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on 5-word shingles: the smallest id."""
    found = near_dups.near_duplicates(docs, words=5, similarity=0.8)
    gone = sent(saved(found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "gone"))
    left = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__text")), "left_anti")
    repeated = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 or more of its 5-word shingles."""
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.leaks(docs.select(row.alias("__row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__row")
    gone = sent(saved(found.select("doc_id").distinct().toDF("__row"), "gone"))
    return docs.join(gone, row == F.col("__row"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    # Ids are written in between, so that workers that encode and workers that decode do not run side by side.
    both = bpe.decode(saved(bpe.encode(docs, path), "ids"), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Neither the field's scores nor the encoding can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
