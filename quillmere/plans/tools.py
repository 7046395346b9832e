"""The knowledge base's functions under the names its users call them by: thirteen on documents and the graph,
seven on notes. Each returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import int_arg, valid_slug
from ..operators import catalog, fulltext, graph, notes
from . import search


class Documents:
    def __init__(self, tables: dict[str, DataFrame], provider=None):
        self.t, self.provider = tables, provider

    def search_documents(self, query: str, top_k: object = None, doc_type: str | None = None) -> DataFrame:
        return search.document_search(self.t, self.provider, query, int_arg(top_k, search.TOP_K), doc_type)

    def local_search(self, query: str, top_k: object = None, graph_depth: object = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return search.local_search(self.t, self.provider.embed(query), int_arg(top_k, search.TOP_K), int_arg(graph_depth, search.DEPTH))

    def global_search(self, query: str, community_level: object = None) -> tuple[str, DataFrame]:
        return search.global_search(self.t, self.provider, query, int_arg(community_level, 0))

    def query_entity(self, name: str, depth: object = None) -> tuple[DataFrame, DataFrame]:
        return graph.query_entity(self.t["entities"], self.t["relationships"], name, int_arg(depth, 1))

    def find_relationships(self, source: str | None = None, target: str | None = None, predicate: str | None = None) -> DataFrame:
        ids = [catalog.entity_by_name(self.t["entities"], n).select("id").first() if n else None for n in (source, target)]
        if (source and not ids[0]) or (target and not ids[1]):
            return self.t["relationships"].limit(0)
        return catalog.find_relationships(self.t["relationships"], *(i["id"] if i else None for i in ids), predicate)

    def get_graph_neighborhood(self, name: str, depth: object = None, max_nodes: object = None) -> tuple[DataFrame, DataFrame]:
        return graph.neighborhood(self.t["entities"], self.t["relationships"], name, int_arg(depth, 2), int_arg(max_nodes, graph.MAX_NODES))

    def get_document_structure(self, doc_id: str) -> DataFrame:
        return catalog.document_by(self.t["documents"], id=doc_id).select("id", "title", "structured")

    def list_entities(self, type: str | None = None, limit: object = None, offset: object = None) -> DataFrame:
        return catalog.list_entities(self.t["entities"], type, int_arg(limit, 50), int_arg(offset, 0))

    def list_documents(self, doc_type: str | None = None, limit: object = None, offset: object = None) -> DataFrame:
        return catalog.list_documents(self.t["documents"], doc_type, int_arg(limit, catalog.DOCS_LIMIT), int_arg(offset, 0))

    def get_community_report(self, community_id: str) -> tuple[DataFrame, DataFrame]:
        return catalog.community_by_id(self.t["communities"], community_id), catalog.community_entities(self.t["entities"], self.t["community_members"], community_id)

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return catalog.chunk_by_id(self.t["chunks"], chunk_id)

    def stats(self) -> DataFrame:
        return catalog.stats(self.t)

    def get_entity_claims(self, name: str) -> DataFrame:
        found = catalog.entity_by_name(self.t["entities"], name).select(F.col("id").alias("entity_id"))
        return self.t["claims"].join(F.broadcast(found), "entity_id", "left_semi").orderBy("id")  # one row


class Notes:
    def __init__(self, projects: DataFrame, all_notes: DataFrame, default: str = "default"):
        """all_notes has a project column besides the notes' own."""
        self.projects, self.all, self.default = projects, all_notes, default

    def _of(self, project: str | None) -> DataFrame:
        slug = project or self.default
        if not self.projects.sparkSession.range(1).where(valid_slug(F.lit(slug))).count():
            raise ValueError(f"bad project {slug!r}")
        if slug != self.default and self.projects.where(F.col("slug") == slug).isEmpty():
            raise KeyError(slug)
        return self.all.where(F.col("project") == slug).drop("project")

    def list_projects(self) -> DataFrame:
        return self.projects.orderBy("created_at", "slug")

    def list_notes(self, project: str | None = None) -> DataFrame:
        return self._of(project).select("key", "author", "tags", "updated_at").orderBy("key")

    def search_notes(self, query: str, project: str | None = None, limit: object = None) -> DataFrame:
        return fulltext.search(fulltext.index_notes(self._of(project)), query, min(int_arg(limit, fulltext.LIMIT), 500))

    def read_note(self, key: str, project: str | None = None) -> DataFrame:
        return self._of(project).where(F.col("key") == key)

    def write_note(self, note: DataFrame, project: str | None = None) -> DataFrame:
        return notes.write_notes(self._of(project), note)

    def delete_note(self, key: str, project: str | None = None) -> DataFrame:
        return notes.delete_note(self._of(project), key)

    def get_notes_graph(self, project: str | None = None) -> tuple[DataFrame, DataFrame]:
        return notes.graph(self._of(project), self.all.select("project", "key"))


def project_by_remote(projects: DataFrame, remote: str) -> DataFrame:
    """The project registered for a remote, else the one of the remote's slug."""
    from ..functions.text import slug

    own = slug(F.lit(remote))
    return projects.where((F.col("remote") == remote) | (F.col("slug") == own)).orderBy(F.desc(F.coalesce(F.col("remote") == remote, F.lit(False))), "slug").limit(1)
