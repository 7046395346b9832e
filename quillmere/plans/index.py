"""Indexing: files or pages to documents, chunks, embeddings and the graph; communities afterwards."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk
from ..functions.text import community_report
from ..operators import extraction
from ..operators.catalog import fingerprint
from ..operators.communities import community_tables, community_texts, louvain
from ..operators.graph import rank_entities
from ..operators.ledger import Ledger
from ..operators.merge import classify_changes, new_versions, pruned, supersede, update_values
from ..operators.vector_search import embed_rows
from ..sources.files import list_files, load_files
from ..sources.web import MAX_PAGES, Fetch, crawl_site, site_documents
from ..store import Layout, Snapshot, Store, Transaction
from ..tables import CHUNKS, CLAIMS, COMMUNITIES, DOCUMENTS, EMBEDDINGS, ENTITIES, MEMBERS, RELATIONSHIPS, cut, sent

Progress = Callable[[dict], None]


#: How the tables are stored. What hangs on a document lies by its id, so that a document's change touches few buckets.
LAYOUTS = {
    "documents": Layout(DOCUMENTS, ("id",), ("id",)),
    "chunks": Layout(CHUNKS, ("id",), ("doc_id",)),
    "embeddings": Layout(EMBEDDINGS, ("chunk_id",), ("chunk_id",)),
    "entities": Layout(ENTITIES, ("id",), ("id",)),
    "relationships": Layout(RELATIONSHIPS, ("id",), ("doc_id",)),
    "claims": Layout(CLAIMS, ("id",), ("doc_id",)),
    "communities": Layout(COMMUNITIES, ("id",), ("id",)),
    "community_members": Layout(MEMBERS, ("community_id", "entity_id"), ("community_id",)),
}


class Base:
    """A knowledge base in a folder. Readers take all tables of one version; a change of several tables is one commit,
    so nobody sees a chunk without its document, in inserts or deletes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = Store(spark, self.folder, LAYOUTS)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def tables(self) -> dict[str, DataFrame]:
        return _tables(self.store.snapshot())

    def write(self, **tables: DataFrame) -> int:
        """Replace whole tables."""
        change = self.store.begin()
        for name, rows in tables.items():
            change.replace(name, rows)
        return change.commit()


def _tables(version: Snapshot | Transaction) -> dict[str, DataFrame]:
    return {n: version.read(n) for n in LAYOUTS}


def _altered(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of `after` that are not in `before` just so."""
    return cut(after.exceptAll(before.select(*after.columns)), "altered")


def index_documents(base: Base, loaded: DataFrame, provider=None, force: bool = False, use_mtime: bool = True, size: int = 512, overlap: int = 50, extract: bool = True, progress: Progress | None = None, ledger: Ledger | None = None) -> dict[str, int]:
    """Index loaded documents (path, title, doc_type, content, file_hash, mtime): unchanged ones are passed over,
    touched ones get their new time, changed ones a new version. Without a provider there are no embeddings and
    no graph. With a ledger, a run that failed half-way asks the provider only for what is missing. Returns counts of each
    change."""
    tell = progress or (lambda _: None)
    now = int(time.time())
    change = base.store.begin()
    tables = _tables(change)
    changes = cut(classify_changes(tables["documents"], loaded, use_mtime, force), "changes")
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    tell({"phase": "load", "changes": counts})
    versions = cut(new_versions(changes, now), "versions")
    old = changes.where("change = 'changed'").select(F.col("old_id").alias("id"))
    touched = changes.where("change = 'touched'").select(F.col("old_id").alias("id"), F.col("mtime").alias("indexed_mtime"))
    affected = tables["documents"].join(sent(old.unionByName(touched.select("id")).distinct()), "id", "left_semi")
    documents = update_values(supersede(affected, old), touched, "id", "indexed_mtime").unionByName(versions)
    texts = changes.where(F.col("change").isin("new", "changed")).join(versions.select("id", "path"), "path").select("id", "content")
    chunks = cut(chunk(texts, size=size, overlap=overlap), "chunks")
    tell({"phase": "chunk", "chunks": chunks.count()})
    if provider is not None:
        vectors = embed_rows(chunks, "content", provider).select(F.col("id").alias("chunk_id"), F.lit(provider.model_id()).alias("model"), F.size("vector").alias("dims"), "vector")
        change.merge("embeddings", vectors)
        tell({"phase": "embed"})
        if extract:
            found = cut(extraction.extract(chunks, provider, ledger=ledger), "found")
            entities, relationships = extraction.resolve(found, tables["entities"], tables["relationships"])
            entities = cut(entities, "entities")
            change.merge("entities", _altered(entities, tables["entities"])).merge("relationships", _altered(relationships, tables["relationships"]))
            claims = extraction.add_claims(tables["claims"], extraction.extract_claims(chunks, provider, ledger), entities)
            change.merge("claims", _altered(claims, tables["claims"]))
            documents = update_values(documents, extraction.structure(texts, provider, ledger=ledger), "id", "structured")
            tell({"phase": "extract"})
    change.merge("documents", cut(documents, "documents"), sequence="version", keep_first=("created_at",)).merge("chunks", chunks, sequence="chunk_index", insert_only=True)
    change.commit()
    tell({"phase": "done", "done": True})
    return counts


def index_path(base: Base, root: str, provider=None, force: bool = False, prune: bool = False, errors: list[tuple[str, str]] | None = None, **options) -> dict[str, int]:
    """Index a folder or file. Times are compared first, by a listing that reads no contents; only files that
    are new or have another time are loaded. Those that cannot be are counted as `failed`; their paths and what is wrong
    with each are added to `errors`, row by row, if a list is given."""
    listing = list_files(base.spark, root)
    latest = base.table("documents").where("is_latest").select("path", F.col("indexed_mtime").alias("mtime"))
    wanted = listing if force else listing.join(latest, ["path", "mtime"], "left_anti")
    loaded = cut(load_files(base.spark, root, wanted), "loaded")
    counts = index_documents(base, loaded.where("error is null"), provider, force, **options)
    wrong = loaded.where("error is not null").select("path", "error")
    if errors is not None:
        errors += [tuple(r) for r in wrong.orderBy("path").toLocalIterator()]
    if prune:
        counts["pruned"] = prune_documents(base, listing)
    failed = wrong.count()
    return counts | {"failed": failed} if failed else counts


def index_site(base: Base, root: str, fetch: Fetch, provider=None, max_pages: int = MAX_PAGES, max_depth: int = 0, skip_sitemap: bool = False, **options) -> dict[str, int]:
    """Index a site's pages. They have no times, so contents are compared by their hashes alone: a page that says the same is
    unchanged, another text gives a new version."""
    pages = crawl_site(base.spark, root, fetch, max_pages, max_depth, skip_sitemap)
    return index_documents(base, cut(site_documents(pages), "site"), provider, use_mtime=False, **options)


def prune_documents(base: Base, listing: DataFrame) -> int:
    """Delete documents of files that are not listed any more, with all that hangs on them, in one commit."""
    change = base.store.begin()
    gone = cut(pruned(change.read("documents"), listing), "pruned")
    n = gone.count()
    if n:
        docs = gone.select(F.col("id").alias("doc_id"))
        dead = change.read("chunks").join(sent(docs), "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
        change.merge("embeddings", deleted=cut(dead, "dead")).merge("documents", deleted=gone)
        for name in ("chunks", "relationships", "claims"):
            change.merge(name, deleted=docs)
        change.commit()
    return n


def finalize(base: Base, provider=None, force: bool = False, max_levels: int = 3, min_size: int = 2) -> bool:
    """Ranks, communities and their summaries. False if the graph is what the stored communities were made from;
    its fingerprint is kept beside them."""
    change = base.store.begin()
    tables = _tables(change)
    if not force and change.base.facts.get("fingerprint") == list(fingerprint(tables)):
        return False
    ranked = rank_entities(tables["entities"], tables["relationships"])
    communities, members = community_tables(louvain(tables["relationships"], max_levels), min_size)
    members = cut(members, "members")
    texts = community_texts(members, ranked, tables["relationships"])
    rows = communities.join(texts.withColumnRenamed("community_id", "id"), "id", "left")
    if provider is not None:
        report = _report(provider)
        rows = rows.withColumn("r", community_report(report(F.col("entity_text"), F.col("edge_text"))))
        rows = embed_rows(rows.withColumns({"title": F.col("r.title"), "summary": F.col("r.summary")}).drop("r"), "summary", provider)
    else:
        rows = rows.withColumns({"title": F.lit("Community"), "summary": F.col("entity_text"), "vector": F.lit(None).cast("array<float>")})
    finest = members.where(F.col("community_id").startswith("c-0-")).select(F.col("entity_id").alias("id"), "community_id")
    entities = update_values(ranked.withColumn("community_id", F.lit(None).cast("string")), finest, "id", "community_id")
    if provider is not None:
        described = entities.where("coalesce(description, '') <> ''").select("id", "description")
        entities = update_values(entities, embed_rows(described, "description", provider).select("id", "vector"), "id", "vector")
    entities = cut(entities, "entities")
    change.merge("entities", _altered(entities, tables["entities"])).replace("communities", rows).replace("community_members", members)
    change.commit(fingerprint=list(fingerprint(tables | {"entities": entities})))
    return True


def _report(provider):
    @F.pandas_udf("string")
    def report(entities: pd.Series, edges: pd.Series) -> pd.Series:
        return (entities.fillna("") + "\n" + edges.fillna("")).map(lambda t: provider.complete("REPORT\n" + t))

    return report
