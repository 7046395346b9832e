"""Writes: upserts, insert-or-ignore, versions, deletes. Each takes tables and returns the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_or_id
from ..tables import sent


def _one_each(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")


def _same(left: str, right: str, keys: list[str]):
    """Equal keys, null like any other value."""
    return reduce(lambda x, y: x & y, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], sequence: str | None, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows replace those of equal keys; of several incoming ones the last by `sequence` (a column of
    incoming; None: their keys do not repeat), ties to the largest row. Columns in keep_first keep the stored row's value. A null key is a key like
    any other."""
    columns = existing.columns
    new = (_one_each(incoming, keys, F.desc_nulls_last(sequence), F.to_json(F.struct(*columns)).desc()) if sequence else incoming).select(*columns)
    if keep_first:
        joined = new.alias("n").join(existing.alias("o"), _same("n", "o", keys), "left")
        new = joined.select(*(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keep_first else F.col(f"n.{c}").alias(c) for c in columns))
    gone = new.select(*keys) if sequence else sent(incoming.select(*keys))
    rest = existing.alias("o").join(gone.alias("n"), _same("o", "n", keys), "left_anti")
    return rest.select(*columns).unionByName(new)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Incoming rows of new keys only, of several the first by `sequence`, or the smallest row. A null key is a key like any
    other."""
    columns = existing.columns
    fresh = incoming.alias("n").join(existing.select(*keys).alias("o"), _same("n", "o", keys), "left_anti")
    order = [*([F.asc(sequence)] if sequence else []), F.to_json(F.struct(*columns)).asc()]
    return existing.unionByName(_one_each(fresh, keys, *order).select(*columns))


def supersede(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """is_latest becomes false for the given ids (column id)."""
    marked = ids.select("id", F.lit(True).alias("__old")).distinct()
    return documents.join(marked, "id", "left").withColumn("is_latest", F.when(F.col("__old"), F.lit(False)).otherwise(F.col("is_latest"))).select(*documents.columns)


def update_values(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column from (key, column) rows; other rows stay."""
    new = values.select(F.col(key), F.col(column).alias("__new"), F.lit(True).alias("__set"))
    return table.join(new, key, "left").withColumn(column, F.when(F.col("__set"), F.col("__new")).otherwise(F.col(column))).select(*table.columns)


def classify_changes(documents: DataFrame, files: DataFrame, use_mtime: bool = True, force: bool = False) -> DataFrame:
    """files (path, file_hash, mtime) with change: new, changed, touched (same bytes, another time) or unchanged,
    against the latest version of each path; and the version, canonical id and id before."""
    latest = documents.where("is_latest").select("path", F.col("id").alias("old_id"), F.col("file_hash").alias("old_hash"), F.col("indexed_mtime").alias("old_mtime"), F.col("version").alias("old_version"), canonical_or_id(F.col("canonical_id"), F.col("id")).alias("canonical_id"))
    same_time = (F.col("mtime") == F.col("old_mtime")) if use_mtime else F.lit(False)
    change = F.when(F.col("old_id").isNull(), "new").when(F.lit(force), "changed").when(F.coalesce(same_time, F.lit(False)), "unchanged").when(F.col("file_hash") == F.col("old_hash"), F.lit("touched" if use_mtime else "unchanged")).otherwise("changed")
    return files.join(latest, "path", "left").withColumn("change", change).withColumn("version", F.coalesce("old_version", F.lit(0)) + 1)


def new_versions(changes: DataFrame, now: int) -> DataFrame:
    """Document rows for new and changed files. A path's versions share the canonical id of its first."""
    rows = changes.where(F.col("change").isin("new", "changed"))
    id_ = F.sha2(F.concat_ws("\0", "path", "file_hash", F.col("version").cast("string")), 256)
    return rows.select(
        id_.alias("id"), "path", "title", "doc_type", "file_hash", F.lit(None).cast("string").alias("structured"), F.col("version").cast("int").alias("version"),
        F.coalesce("canonical_id", id_).alias("canonical_id"), F.lit(True).alias("is_latest"), F.col("mtime").cast("long").alias("indexed_mtime"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"),
    )


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Without the given documents (column id) and all that hangs on them: chunks and their embeddings,
    relationships and claims."""
    gone = ids.select(F.col("id").alias("doc_id")).distinct()
    out = dict(tables)
    out["documents"] = tables["documents"].join(gone, F.col("id") == F.col("doc_id"), "left_anti")
    if "chunks" in tables:
        out["chunks"] = tables["chunks"].join(gone, "doc_id", "left_anti").select(*tables["chunks"].columns)
        if "embeddings" in tables:
            dead = tables["chunks"].join(gone, "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
            out["embeddings"] = tables["embeddings"].join(dead, "chunk_id", "left_anti").select(*tables["embeddings"].columns)
    for name in ("relationships", "claims"):
        if name in tables:
            out[name] = tables[name].join(gone, "doc_id", "left_anti").select(*tables[name].columns)
    return out


def pruned(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Ids of documents from files that are not in the listing (column path) any more. Web pages and empty
    paths are not files."""
    files = documents.where((F.coalesce("path", F.lit("")) != "") & ~F.col("path").rlike("^https?://"))
    return files.join(listing.select("path"), "path", "left_anti").select("id")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "key", mark: str = "mtime") -> DataFrame:
    """key and change (added, changed, removed) between two listings."""
    both = before.select(key, F.col(mark).alias("__a"), F.lit(True).alias("__had")).join(after.select(key, F.col(mark).alias("__b"), F.lit(True).alias("__has")), key, "full_outer")
    change = F.when(F.col("__had").isNull(), "added").when(F.col("__has").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def clear_communities(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return tables | {"communities": tables["communities"].limit(0), "community_members": tables["community_members"].limit(0), "entities": tables["entities"].withColumn("community_id", F.lit(None).cast("string"))}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def register_project(projects: DataFrame, slug: str, name: str, remote: str | None, created_at: int) -> DataFrame:
    """With one more project; a slug or remote that is there already is an error."""
    taken = projects.where((F.col("slug") == slug) | (F.col("remote") == remote if remote else F.lit(False)))
    if not taken.isEmpty():
        raise ValueError(f"project {slug} or its remote is registered already")
    return projects.unionByName(projects.sparkSession.createDataFrame([(slug, name, remote, created_at)], projects.schema))


def delete_project(projects: DataFrame, slug: str) -> DataFrame:
    if projects.where(F.col("slug") == slug).isEmpty():
        raise KeyError(slug)
    return projects.where(F.col("slug") != slug)
