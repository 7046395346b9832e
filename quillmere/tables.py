"""Schemas of the knowledge base's tables, and tables in the folder all executors share.

Every table can carry a `project` column; it is the partition column when a catalogue of several projects is
stored, so that a filter on it prunes files.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = "id string, path string, title string, doc_type string, file_hash string, structured string, version int, canonical_id string, is_latest boolean, indexed_mtime long, created_at long, updated_at long"
CHUNKS = "id string, doc_id string, chunk_index int, content string, token_count int, metadata string"
EMBEDDINGS = "chunk_id string, model string, dims int, vector array<float>"
ENTITIES = "id string, name string, type string, description string, rank int, community_id string, vector array<float>"
RELATIONSHIPS = "id string, source_id string, target_id string, predicate string, description string, weight double, doc_id string"
CLAIMS = "id string, entity_id string, claim string, status string, doc_id string"
COMMUNITIES = "id string, level int, parent_id string, title string, summary string, rank int, vector array<float>"
MEMBERS = "community_id string, entity_id string"
PROJECTS = "slug string, name string, remote string, created_at long"
NOTES = "key string, content string, author string, tags array<string>, frontmatter map<string,string>, created_at timestamp, updated_at timestamp"
HISTORY = "commit string, key string, author string, time long, message string"

SCHEMAS = {
    "documents": DOCUMENTS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "entities": ENTITIES, "relationships": RELATIONSHIPS,
    "claims": CLAIMS, "communities": COMMUNITIES, "community_members": MEMBERS, "projects": PROJECTS, "notes": NOTES, "history": HISTORY,
}

def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session of one process (tests)
    gets a folder of its own; on a cluster that is an error, for no local folder would do."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillmere-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/quillmere/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage of a loop, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind tables made by cut(); nothing may read them afterwards."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(file).getParent()
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(spark: SparkSession, df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Written to the shared folder in buckets of a hash of `keys` and read back: joins and groupings on them need not move it."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quillmere_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


#: Tables of so many rows and bytes at most are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes as a row's field."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(column, F.lit(16).cast("long"), lambda total, x: total + _bytes(x, kind.elementType)), F.lit(16))
    if isinstance(kind, T.StructType):
        return reduce(lambda total, f: total + _bytes(column[f.name], f.dataType), kind.fields, F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def sent(table: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows and bytes, which are counted, allow that."""
    size = reduce(lambda total, f: total + _bytes(F.col(f"`{f.name}`"), f.dataType), table.schema.fields, F.lit(16).cast("long"))
    found = table.select(size.alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    return F.broadcast(table) if found["rows"] <= BROADCAST_ROWS and (found["bytes"] or 0) <= BROADCAST_BYTES else table


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
