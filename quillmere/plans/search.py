"""Composite searches: local (vectors, then the graph around the hits) and global (communities)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import query_similarity
from ..operators.catalog import entities_for_docs
from ..operators.graph import walk
from ..operators.vector_search import brute_force, top_k
from ..tables import cut

TOP_K, DEPTH, TOP_COMMUNITIES, NO_VECTOR_SCORE = 5, 2, 10, 0.5
NOTHING = "No community summaries are available."


def document_search(tables: dict[str, DataFrame], provider, query: str, top: int = TOP_K, doc_type: str | None = None, latest_only: bool = False) -> DataFrame:
    """Chunks nearest to a query, with score; of a type of documents, or of latest versions only, if asked for."""
    chunks, embeddings = tables["chunks"], tables["embeddings"]
    if doc_type or latest_only:
        docs = tables["documents"]
        docs = docs.where(F.col("doc_type") == doc_type) if doc_type else docs
        docs = docs.where("is_latest") if latest_only else docs
        chunks = chunks.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(*chunks.columns)
        embeddings = embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select(*embeddings.columns)
    return brute_force(chunks, embeddings, provider.embed(query), top)


def local_search(tables: dict[str, DataFrame], query: list[float], top: int = TOP_K, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with score; entities: those of the hits' documents nearest to the query (2 * top, of those with a
    vector) and all at an end of a relationship found; relationships within `depth` hops of the nearest
    entities, of the hits' documents only."""
    chunks = cut(brute_force(tables["chunks"], tables["embeddings"], query, top), "hits")
    docs = chunks.select("doc_id").distinct()
    entities = entities_for_docs(tables["entities"], tables["relationships"], docs)
    seeds = cut(top_k(entities.where(F.size("vector") > 0), query, 2 * top), "seeds")
    depth = depth if depth > 0 else DEPTH
    edges = cut(walk(tables["relationships"], seeds, depth, docs), "edges")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    around = tables["entities"].join(ends, "id", "left_semi").join(seeds, "id", "left_anti").withColumn("score", F.lit(None).cast("double"))
    return chunks, seeds.unionByName(around.select(*seeds.columns)), edges


def rank_communities(communities: DataFrame, query: list[float], level: int = 0, top: int = TOP_COMMUNITIES) -> DataFrame:
    """The communities of a level (all, if it has none) by cosine with the query; one with a summary but no vector
    counts as 0.5, one with neither is left out."""
    some = communities.where(F.col("level") == level)
    if some.isEmpty():
        some = communities
    has_vector, has_text = F.coalesce(F.size("vector") > 0, F.lit(False)), F.coalesce(F.trim("summary") != "", F.lit(False))
    score = F.when(has_vector, query_similarity(F.col("vector"), query)).when(has_text, F.lit(NO_VECTOR_SCORE))
    return some.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "id").limit(top)


def global_search(tables: dict[str, DataFrame], provider, query: str, level: int = 0) -> tuple[str, DataFrame]:
    """The provider's answer from the summaries of the nearest communities, and these; one call."""
    ranked = cut(rank_communities(tables["communities"], provider.embed(query), level), "ranked")
    rows = ranked.where(F.trim(F.coalesce("summary", F.lit(""))) != "").orderBy(F.desc("score"), "id").collect()  # 10 at most
    if not rows:
        return NOTHING, ranked
    parts = [f"[{i}] {r['title']}: {r['summary']}" for i, r in enumerate(rows, 1)]
    return provider.complete(f"QUESTION {query}\n" + "\n".join(parts)), ranked
