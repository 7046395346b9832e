"""Lookups, listings, joins and counts over the knowledge base's tables. All orders end in an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_name

#: Default and largest page sizes.
DOCS_LIMIT, CLAIMS_LIMIT, CLAIMS_MAX = 20, 100, 1000


def document_by(documents: DataFrame, *, id: str | None = None, file_hash: str | None = None, path: str | None = None) -> DataFrame:
    """By id, by hash, or the latest version of a path."""
    if id is not None:
        return documents.where(F.col("id") == id)
    if file_hash is not None:
        return documents.where(F.col("file_hash") == file_hash)
    return documents.where((F.col("path") == path) & F.col("is_latest"))


def list_documents(documents: DataFrame, doc_type: str | None = None, limit: int = DOCS_LIMIT, offset: int = 0) -> DataFrame:
    rows = documents.where("is_latest")
    if doc_type:
        rows = rows.where(F.col("doc_type") == doc_type)
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def document_versions(documents: DataFrame, canonical_id: str) -> DataFrame:
    return documents.where((F.col("id") == canonical_id) | (F.col("canonical_id") == canonical_id)).orderBy("version", "id")


def chunk_by_id(chunks: DataFrame, id: str) -> DataFrame:
    return chunks.where(F.col("id") == id)


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index", "id")


def first_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    return chunks.where(F.col("chunk_index") < n)


def chunk_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks with their vectors, of one model; vectors travel no further than a caller asks for them."""
    rows = embeddings if model is None else embeddings.where(F.col("model") == model)
    return chunks.join(rows.select(F.col("chunk_id").alias("id"), "model", "dims", "vector"), "id")


def models_by_count(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model")


def dominant_model(embeddings: DataFrame) -> str | None:
    row = models_by_count(embeddings).limit(1).first()
    return row["model"] if row else None


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    """One entity by name whatever its case; of several the smallest id."""
    return entities.where(F.lower("name") == F.lower(F.lit(name))).orderBy("id").limit(1)


def list_entities(entities: DataFrame, type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = entities if not type else entities.where(F.col("type") == type)
    return rows.orderBy(F.desc("rank"), "id").offset(offset).limit(limit)


def entities_by_names(entities: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Entities whose normalised name is among the normalised given ones."""
    wanted = names.select(normalise_name(F.col(column)).alias("__n")).distinct()
    return entities.withColumn("__n", normalise_name(F.col("name"))).join(wanted, "__n", "left_semi").drop("__n")


def find_relationships(relationships: DataFrame, source: str | None = None, target: str | None = None, predicate: str | None = None) -> DataFrame:
    """Any combination of ends and predicate (exact case); none of them gives all."""
    rows = relationships
    for column, value in (("source_id", source), ("target_id", target), ("predicate", predicate)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows


def claims_of(claims: DataFrame, entity_id: str) -> DataFrame:
    return claims.where(F.col("entity_id") == entity_id).orderBy("id")


def list_claims(claims: DataFrame, status: str | None = None, limit: int = CLAIMS_LIMIT) -> DataFrame:
    rows = claims if not status else claims.where(F.col("status") == status)
    return rows.orderBy("id").limit(min(limit if limit > 0 else CLAIMS_LIMIT, CLAIMS_MAX))


def community_by_id(communities: DataFrame, id: str) -> DataFrame:
    return communities.where(F.col("id") == id)


def list_communities(communities: DataFrame, level: int = -1) -> DataFrame:
    rows = communities if level < 0 else communities.where(F.col("level") == level)
    return rows.orderBy(F.desc("rank"), "id")


def community_entities(entities: DataFrame, members: DataFrame, community_id: str | None = None) -> DataFrame:
    wanted = members if community_id is None else members.where(F.col("community_id") == community_id)
    return wanted.select(F.col("community_id").alias("member_of"), F.col("entity_id").alias("id")).distinct().join(entities, "id")


def entities_for_docs(entities: DataFrame, relationships: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities at either end of a relationship of the given documents (column doc_id). The ends become rows, so
    the join is on equality, not on one column OR another."""
    touched = relationships.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ends = touched.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return entities.join(ends, "id", "left_semi")


def resolve_claims(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id of each extracted claim (entity_name, claim, status, doc_id) by exact name; null if there is none."""
    named = entities.groupBy(F.col("name").alias("entity_name")).agg(F.min("id").alias("entity_id"))
    return claims.join(named, "entity_name", "left")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts, of all versions, each by its own aggregate."""
    names = ["documents", "chunks", "embeddings", "entities", "relationships", "claims", "communities"]
    counts = [tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts).groupBy().pivot("name", names).agg(F.first("n"))


def fingerprint(tables: dict[str, DataFrame]) -> tuple[int, int, int, int]:
    """Counts of entities and relationships, and sums of their rows' hashes: what communities were made from."""
    out: list[int] = []
    for name, columns in (("entities", ["id", "name"]), ("relationships", ["id", "source_id", "target_id", "weight"])):
        row = tables[name].agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(1 << 31))).alias("h")).first()
        out += [row["n"], row["h"] or 0]
    return out[0], out[1], out[2], out[3]


def duplicate_hashes(documents: DataFrame) -> DataFrame:
    """file_hash, n, first_id of contents that several documents share."""
    return documents.groupBy("file_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def activity_feed(notes: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """kind, id, title, happened_at: the latest notes and documents together."""
    one = notes.select(F.lit("note").alias("kind"), F.col("key").alias("id"), F.substring_index("key", "/", -1).alias("title"), F.unix_timestamp("updated_at").alias("happened_at"))
    two = documents.where("is_latest").select(F.lit("document").alias("kind"), "id", "title", F.col("updated_at").alias("happened_at"))
    return one.unionByName(two).orderBy(F.desc("happened_at"), "kind", "id").limit(limit)


def palette(notes: DataFrame, documents: DataFrame, n: int = 5) -> DataFrame:
    """kind, id, title: n hits among notes and n among documents (columns id, title, in order of id)."""
    some = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "id", "title").orderBy("id").limit(n)
    return some(notes, "note").unionByName(some(documents, "document"))


def latency_histogram(events: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts, sum and count of a measure, as a metrics page shows them."""
    buckets = [F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), *buckets)
