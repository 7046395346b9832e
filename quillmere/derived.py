"""The knowledge base's tables, derived from tables of orders, parts, texts and vectors (for tests and benchmarks).

documents   texts; every source is ten files, whose versions are its texts in id order
chunks      the lines of the texts that are not blank
entities    regions, nations, customers, suppliers and parts; relationships are the keys between them, and each
            line of an order, from part to supplier, with its quantity as weight and the order as document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import token_estimate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.pmod("doc_id", F.lit(10)).cast("string"))
    versions = Window.partitionBy("path").orderBy("doc_id")
    rows = rows.select(F.col("doc_id").cast("string").alias("id"), path.alias("path"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("doc_type"), F.sha2("text", 256).alias("file_hash"), "doc_id")
    return rows.select(
        "id", "path", "title", "doc_type", "file_hash", F.lit(None).cast("string").alias("structured"), F.row_number().over(versions).alias("version"),
        F.first("id").over(versions).alias("canonical_id"), (F.lead("doc_id").over(versions).isNull()).alias("is_latest"), F.col("doc_id").alias("indexed_mtime"), F.col("doc_id").alias("created_at"), F.col("doc_id").alias("updated_at"),
    )


DOCUMENTS_SQL = """documents_ AS (
    SELECT id, path, title, doc_type, file_hash, CAST(row_number() OVER v AS INTEGER) AS version, first_value(id) OVER v AS canonical_id,
           lead(doc_id) OVER v IS NULL AS is_latest, doc_id AS indexed_mtime, doc_id AS created_at, doc_id AS updated_at
    FROM (SELECT CAST(doc_id AS VARCHAR) AS id, source || '/' || CAST(doc_id % 10 AS VARCHAR) AS path, 'text ' || CAST(doc_id AS VARCHAR) AS title,
                 lang AS doc_type, sha256(text) AS file_hash, doc_id FROM documents)
    WINDOW v AS (PARTITION BY path ORDER BY doc_id)
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    rows = lines.select("doc_id", F.posexplode("lines").alias("chunk_index", "content"))
    return rows.select(F.concat_ws("-", "doc_id", F.col("chunk_index").cast("string")).alias("id"), "doc_id", "chunk_index", "content", token_estimate(F.col("content")).alias("token_count"), F.lit(None).cast("string").alias("metadata"))


CHUNKS_SQL = """chunks_ AS (
    SELECT doc_id || '-' || CAST(i - 1 AS VARCHAR) AS id, doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, lines[i] AS content, CAST(floor(length(lines[i]) / 4) AS INTEGER) AS token_count
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)
)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model"), F.size("embedding").alias("dims"), F.col("embedding").alias("vector"))


def entities(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    def rows(name: str, letter: str, key: str, text: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(letter + "-"), F.col(key).cast("string")).alias("id"), F.col(text).alias("name"), F.lit(kind).alias("type"), F.concat(F.lit(kind + " "), F.col(text)).alias("description"))

    out = rows("region", "r", "r_regionkey", "r_name", "region").unionByName(rows("nation", "n", "n_nationkey", "n_name", "nation")).unionByName(rows("customer", "c", "c_custkey", "c_name", "customer")).unionByName(rows("supplier", "s", "s_suppkey", "s_name", "supplier")).unionByName(rows("part", "p", "p_partkey", "p_name", "part"))
    out = out.withColumns({"rank": F.lit(0), "community_id": F.lit(None).cast("string")})
    if vectors:
        own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s-"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"))
        return out.join(own, "id", "left")
    return out


ENTITIES_SQL = """entities_ AS (
    SELECT 'r-' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n-' || n_nationkey, n_name, 'nation' FROM nation
    UNION ALL SELECT 'c-' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's-' || s_suppkey, s_name, 'supplier' FROM supplier
    UNION ALL SELECT 'p-' || p_partkey, p_name, 'part' FROM part
)"""


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda letter, key: F.concat(F.lit(letter + "-"), F.col(key).cast("string"))

    def rows(name: str, a: tuple[str, str], b: tuple[str, str], predicate: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(predicate + ":"), text(*a)).alias("id"), text(*a).alias("source_id"), text(*b).alias("target_id"), F.lit(predicate).alias("predicate"), F.lit(1.0).alias("weight"), F.lit(name).alias("doc_id"))

    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("l"), *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"), text("p", "l_partkey").alias("source_id"), text("s", "l_suppkey").alias("target_id"), F.lit("supplied by").alias("predicate"), F.col("l_quantity").alias("weight"), text("o", "l_orderkey").alias("doc_id"))
    out = rows("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "lies in").unionByName(rows("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "lives in")).unionByName(rows("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "sits in")).unionByName(lines)
    return out.withColumn("description", F.lit(None).cast("string"))


RELATIONSHIPS_SQL = """relationships_ AS (
    SELECT 'lies in:n-' || n_nationkey AS id, 'n-' || n_nationkey AS source_id, 'r-' || n_regionkey AS target_id, 'lies in' AS predicate, CAST(1 AS DOUBLE) AS weight, 'nation' AS doc_id FROM nation
    UNION ALL SELECT 'lives in:c-' || c_custkey, 'c-' || c_custkey, 'n-' || c_nationkey, 'lives in', 1, 'customer' FROM customer
    UNION ALL SELECT 'sits in:s-' || s_suppkey, 's-' || s_suppkey, 'n-' || s_nationkey, 'sits in', 1, 'supplier' FROM supplier
    UNION ALL SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'p-' || l_partkey, 's-' || l_suppkey, 'supplied by', l_quantity, 'o-' || l_orderkey FROM lineitem
)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each text: links to the text after it, one with an alias, and to another project's note."""
    d = F.col("doc_id")
    body = F.concat(F.col("text"), F.lit("\n[["), F.col("source"), F.lit("/"), (d + 1).cast("string"), F.lit("|next]] [[projects/"), F.col("lang"), F.lit("/"), (d % 7).cast("string"), F.lit("]]"))
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", d.cast("string")).alias("key"), body.alias("content"), F.array("lang", "source").alias("tags"), F.timestamp_seconds(d).alias("updated_at"))


NOTES_SQL = """notes_ AS (
    SELECT source || '/' || doc_id AS key, text || chr(10) || '[[' || source || '/' || (doc_id + 1) || '|next]] [[projects/' || lang || '/' || (doc_id % 7) || ']]' AS content, lang || ' ' || source AS tags, doc_id AS updated_at FROM documents
), links_ AS (
    SELECT DISTINCT key AS source, trim(t) AS target FROM notes_, unnest(regexp_extract_all(content, '\\[\\[([^\\]\\|]+?)(?:\\|[^\\]]*)?\\]\\]', 1)) AS u(t) WHERE trim(t) <> ''
)""".replace("\\\\", "\\")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels say of texts, under the name of a source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "left")
    return rows.select(F.concat(F.lit("k-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("entity_name"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("claim"), F.when(F.col("toxic") > 0, "disputed").otherwise("verified").alias("status"), F.col("doc_id").cast("string").alias("doc_id"))
