"""Queries of lookups, writes, versions, deletes and the extracted graph, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as d
from .functions.text import content_hash
from .operators import catalog, communities, extraction, graph, merge, notes, vector_search
from .registry import query
from .tables import SCHEMAS, cut, empty


@query(f"WITH {d.DOCUMENTS_SQL} SELECT 'id' AS by, id, version FROM documents_ WHERE id = '7' UNION ALL SELECT 'hash', id, version FROM documents_ WHERE file_hash = (SELECT file_hash FROM documents_ WHERE id = '7') UNION ALL SELECT 'path', id, version FROM documents_ WHERE is_latest AND path = (SELECT path FROM documents_ WHERE id = '7')")
def document_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.documents(spark, sf_dir)
    known = docs.where("id = '7'").select("file_hash", "path").first()
    found = [("id", catalog.document_by(docs, id="7")), ("hash", catalog.document_by(docs, file_hash=known["file_hash"])), ("path", catalog.document_by(docs, path=known["path"]))]
    return merge.union_all([rows.select(F.lit(by).alias("by"), "id", "version") for by, rows in found])


@query(f"WITH {d.CHUNKS_SQL} SELECT 'doc' AS by, id, chunk_index FROM chunks_ WHERE doc_id = '4' UNION ALL SELECT 'id', id, chunk_index FROM chunks_ WHERE id = '5-0' UNION ALL SELECT 'first', id, chunk_index FROM chunks_ WHERE chunk_index < 5")
def chunk_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = d.chunks(spark, sf_dir)
    found = [("doc", catalog.chunks_of(chunks, "4")), ("id", catalog.chunk_by_id(chunks, "5-0")), ("first", catalog.first_chunks(chunks))]
    return merge.union_all([rows.select(F.lit(by).alias("by"), "id", "chunk_index") for by, rows in found])


_DOMINANT = "dominant AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, 'model-' || label LIMIT 1)"


@query(f"WITH {_DOMINANT} SELECT CAST(e.vec_id AS VARCHAR) AS id, 'model-' || e.label AS model, CAST(len(e.embedding) AS INTEGER) AS dims, sha256(o.text) AS content_hash FROM embeddings e JOIN documents o ON o.doc_id = e.vec_id WHERE e.label = (SELECT label FROM dominant)")
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their vectors, of the model that most have."""
    vectors = d.embeddings(spark, sf_dir)
    chunks = d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    found = catalog.chunk_embeddings(chunks, vectors, catalog.dominant_model(vectors))
    return found.select("id", "model", "dims", content_hash(F.col("content")).alias("content_hash"))


@query(f"WITH {_DOMINANT} SELECT CAST(e.vec_id AS VARCHAR) AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e JOIN documents o ON o.doc_id = e.vec_id, embeddings q WHERE q.vec_id = 0 AND e.label = (SELECT label FROM dominant) AND e.vec_id IN (SELECT x.vec_id FROM embeddings x, embeddings z WHERE z.vec_id = 0 AND x.label = (SELECT label FROM dominant) ORDER BY list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])) DESC, CAST(x.vec_id AS VARCHAR) LIMIT 15)")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 nearest vectors of the dominant model, then their texts."""
    vectors = d.embeddings(spark, sf_dir)
    zero = list(d.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])
    chunks = d.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return vector_search.brute_force(chunks, vectors, zero, 15).select("id", F.round("score", 6).alias("score"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 5 = 0")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of vectors with every third removed, then every fifth added or replaced."""
    rows = d.embeddings(spark, sf_dir).select(F.col("chunk_id").alias("id"), "vector")
    left = vector_search.remove(rows, rows.where("CAST(id AS BIGINT) % 3 = 0"))
    ones = rows.where("CAST(id AS BIGINT) % 5 = 0").withColumn("vector", F.transform("vector", lambda v: (v * 0 + 1).cast("float")))
    return vector_search.add(left, ones).select("id", F.element_at("vector", 1).cast("double").alias("first"))


@query("SELECT count(*) AS n, max(len(embedding)) AS dims FROM embeddings")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, dims = vector_search.size_and_dims(d.embeddings(spark, sf_dir))
    return spark.createDataFrame([(n, dims)], "n long, dims long")


@query("WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id < 20), s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM q JOIN embeddings e USING (label)) SELECT query_id, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 3")
def grouped_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest of each of 20 queries among the vectors of its label."""
    rows = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", F.col("embedding").alias("vector"))
    asked = d.table(spark, sf_dir, "embeddings").where("vec_id < 20").select(F.col("vec_id").cast("string").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    return vector_search.grouped_top_k(asked, rows, 3, "label").withColumn("score", F.round("score", 6))


@query("SELECT 'k-' || l.doc_id AS id, 'quality ' || quality AS claim FROM labels l JOIN documents USING (doc_id) WHERE source = 'src3'")
def claims_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = d.table(spark, sf_dir, "documents").select("source").distinct().select(F.concat(F.lit("e-"), "source").alias("id"), F.col("source").alias("name"))
    return catalog.claims_of(catalog.resolve_claims(d.claims(spark, sf_dir), known), "e-src3").select("id", "claim")


_ASSIGNED = "assigned AS (SELECT 'c-' || c_custkey AS entity_id, 0 AS level, 'n' || c_nationkey AS label FROM customer UNION ALL SELECT 'c-' || c_custkey, 1, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's-' || s_suppkey, 0, 's-' || s_suppkey FROM supplier)"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, then by region; suppliers alone."""
    joined = d.table(spark, sf_dir, "customer").join(d.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    id_ = F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("entity_id")
    own = F.concat(F.lit("s-"), F.col("s_suppkey").cast("string"))
    rows = [joined.select(id_, F.lit(0).alias("level"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("label")), joined.select(id_, F.lit(1).alias("level"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("label"))]
    return merge.union_all([*rows, d.table(spark, sf_dir, "supplier").select(own.alias("entity_id"), F.lit(0).alias("level"), own.alias("label"))])


@query("SELECT 'c-0-n' || n_nationkey AS id, 0 AS level, 'c-1-r' || n_regionkey AS parent_id, CAST(count(*) AS INTEGER) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_regionkey HAVING count(*) > 1 UNION ALL SELECT 'c-1-r' || n_regionkey, 1, NULL, CAST(count(*) AS INTEGER) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey HAVING count(*) > 1")
def community_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of two levels with parents and sizes; those of one member are left out."""
    found, _ = communities.community_tables(_assigned(spark, sf_dir))
    return catalog.list_communities(found).select("id", "level", "parent_id", "rank")


@query(f"WITH {_ASSIGNED}, sized AS (SELECT level, label FROM assigned GROUP BY ALL HAVING count(*) > 1) SELECT 'c-' || level || '-' || label AS community_id, entity_id FROM assigned SEMI JOIN sized USING (level, label)")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.community_tables(_assigned(spark, sf_dir))[1]


@query("SELECT 'c-1-r' || n_regionkey AS id, CAST(count(*) AS INTEGER) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey HAVING count(*) > 1")
def communities_of_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_communities(communities.community_tables(_assigned(spark, sf_dir))[0], 1).select("id", "rank")


@query("""WITH l AS (SELECT 'n' || c_nationkey AS community_id, 'lives in:c-' || c_custkey AS id, '- ' || c_name || ' lives in n-' || c_nationkey AS line FROM customer),
    p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY community_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
    SELECT community_id, left(string_agg(line, chr(10) ORDER BY id), 2000) AS edge_text FROM p WHERE pos < 2000 GROUP BY 1""")
def community_edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of the relationships inside each nation: between its customers and itself."""
    customers = d.table(spark, sf_dir, "customer")
    community, person = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c-"), F.col("c_custkey").cast("string"))
    nation = F.concat(F.lit("n-"), F.col("c_nationkey").cast("string"))
    members = customers.select(community.alias("community_id"), person.alias("entity_id")).unionByName(customers.select(community.alias("community_id"), nation.alias("entity_id")).distinct())
    said = customers.select(person.alias("source_id"), F.concat("c_name", F.lit(" lives in "), nation).alias("description"))
    rels = d.relationships(spark, sf_dir).drop("description").join(said, "source_id", "left")
    return communities.community_texts(members, d.entities(spark, sf_dir), rels).select("community_id", "edge_text").where("edge_text is not null")


@query(f"WITH {d.DOCUMENTS_SQL} SELECT id, is_latest AND doc_type <> 'de' AS is_latest FROM documents_")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.documents(spark, sf_dir)
    return merge.supersede(docs, docs.where("doc_type = 'de'").select("id")).select("id", "is_latest")


@query(f"WITH {d.DOCUMENTS_SQL} SELECT id, CASE WHEN version = 1 THEN '{{\"n\": ' || id || '}}' END AS structured FROM documents_")
def updated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.documents(spark, sf_dir)
    values = docs.where("version = 1").select("id", F.concat(F.lit('{"n": '), "id", F.lit("}")).alias("structured"))
    return merge.update_values(docs, values, "id", "structured").select("id", "structured")


@query("SELECT 'c-' || c_custkey AS id, 'n' || c_nationkey AS community_id FROM customer UNION ALL SELECT 's-' || s_suppkey, NULL FROM supplier")
def assigned_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The community of each customer set in the table of entities; suppliers have none."""
    members = _assigned(spark, sf_dir).where("level = 0 AND entity_id LIKE 'c-%'").select(F.col("entity_id").alias("id"), F.col("label").alias("community_id"))
    return merge.update_values(d.entities(spark, sf_dir), members, "id", "community_id").where("type IN ('customer', 'supplier')").select("id", "community_id")


@query(f"WITH {d.DOCUMENTS_SQL}, {d.CHUNKS_SQL}, gone AS (SELECT id AS doc_id FROM documents_ WHERE doc_type = 'fr') SELECT 'documents' AS name, count(*) AS n FROM documents_ WHERE doc_type <> 'fr' UNION ALL SELECT 'chunks', count(*) FROM chunks_ ANTI JOIN gone USING (doc_id) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT 'claims', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All French documents deleted with what hangs on them; the rows that are left. Embeddings hang on first chunks."""
    chunks, docs = d.chunks(spark, sf_dir), d.documents(spark, sf_dir)
    vectors = d.embeddings(spark, sf_dir).withColumn("chunk_id", F.concat("chunk_id", F.lit("-0")))
    # Every document has a first chunk here, so that each embedding hangs on its document.
    hung = chunks.where("chunk_index > 0").unionByName(docs.select(F.concat("id", F.lit("-0")).alias("id"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("").alias("content"), F.lit(0).alias("token_count"), F.lit(None).cast("string").alias("metadata")))
    left = merge.delete_documents({"documents": docs, "chunks": hung, "embeddings": vectors, "claims": d.claims(spark, sf_dir)}, docs.where("doc_type = 'fr'").select("id"))
    real = left["chunks"].join(chunks.select("id"), "id", "left_semi")
    return merge.union_all([rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in (left | {"chunks": real}).items()])


@query("SELECT (SELECT count(*) FROM customer) AS entities, CAST(0 AS BIGINT) AS communities, CAST(0 AS BIGINT) AS members, CAST(0 AS BIGINT) AS assigned")
def cleared_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, members = communities.community_tables(_assigned(spark, sf_dir))
    entities = d.entities(spark, sf_dir).where("type = 'customer'").withColumn("community_id", F.lit("x"))
    after = merge.clear_communities({"entities": entities, "communities": found, "community_members": members})
    n = lambda name, what="*": F.lit(after[name].agg(F.count(what)).first()[0]).cast("long")
    return spark.range(1).select(n("entities").alias("entities"), n("communities").alias("communities"), n("community_members").alias("members"), n("entities", "community_id").alias("assigned"))


@query("SELECT 'n' || n_nationkey AS slug, n_name AS name FROM nation UNION ALL SELECT 'new', 'New one' ORDER BY slug")
def registered_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project registered, another registered and deleted again; slugs and remotes that are taken are errors."""
    rows = d.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"), F.concat(F.lit("git@h:"), "n_name").alias("remote"), F.col("n_nationkey").cast("long").alias("created_at"))
    more = merge.register_project(merge.register_project(rows, "new", "New one", None, 100), "gone", "Gone", "git@h:gone", 101)
    for slug, remote in (("new", None), ("other", "git@h:gone")):
        try:
            merge.register_project(more, slug, "x", remote, 102)
        except ValueError:
            continue
        raise AssertionError("registered twice")
    return merge.delete_project(more, "gone").select("slug", "name")


def _notes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.notes(spark, sf_dir)
    return rows.select("key", "content", F.lit("ann").alias("author"), "tags", F.create_map(F.lit("k"), F.lit("v")).alias("frontmatter"), F.col("updated_at").alias("created_at"), "updated_at")


def _notes_written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = _notes_table(spark, sf_dir)
    later = F.timestamp_seconds(F.unix_timestamp("updated_at") + 1_000_000)
    changed = before.where("array_contains(tags, 'en')").withColumns({"content": F.concat("content", F.lit("!")), "created_at": later, "updated_at": later, "tags": F.array(F.lit(" NEW "), F.lit("new"))})
    added = before.where("array_contains(tags, 'fr')").withColumn("key", F.concat(F.lit("copy/"), "key"))
    return before, notes.write_notes(before, changed.unionByName(added))


@query("SELECT source || '/' || doc_id AS key, CASE WHEN lang = 'en' THEN 'new' ELSE lang || ',' || source END AS tags, doc_id AS created, CASE WHEN lang = 'en' THEN doc_id + 1000000 ELSE doc_id END AS updated FROM documents UNION ALL SELECT 'copy/' || source || '/' || doc_id, lang || ',' || source, doc_id, doc_id FROM documents WHERE lang = 'fr'")
def written_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English notes written over (their creation stays), French ones copied."""
    _, after = _notes_written(spark, sf_dir)
    return after.select("key", F.array_join("tags", ",").alias("tags"), F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("updated_at").alias("updated"))


@query("SELECT source || '/' || doc_id AS key, 'update: ' || source || '/' || doc_id || chr(10) || chr(10) || 'Author: annx' AS message FROM documents WHERE lang = 'en' UNION ALL SELECT 'copy/' || source || '/' || doc_id, 'create: copy/' || source || '/' || doc_id || chr(10) || chr(10) || 'Author: annx' FROM documents WHERE lang = 'fr' UNION ALL SELECT 'gone', 'delete: gone' || chr(10) || chr(10) || 'Author: annx'")
def note_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for each note that was changed, made or deleted; unchanged ones have none."""
    before, after = _notes_written(spark, sf_dir)
    gone = before.limit(1).withColumn("key", F.lit("gone"))
    had = cut(before.unionByName(gone), "had")
    after = notes.delete_note(cut(after.unionByName(gone), "has"), "gone")
    log = cut(notes.append_history(empty(spark, "history"), had, after, "ann\nx", 5), "log")
    again = notes.append_history(log, after, after, "ann", 6)  # nothing changed
    one = notes.history_of(again, "gone").count()
    return again.select("key", "message").where(F.lit(one == 1))


@query("SELECT sha256(CAST(doc_id AS VARCHAR)) AS commit, CAST(row_number() OVER (ORDER BY doc_id % 5 DESC, sha256(CAST(doc_id AS VARCHAR))) - 1 AS BIGINT) AS place FROM documents WHERE lang = 'en' QUALIFY place < 50")
def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 commits of a key, newest first, ties by name; every text is a commit of its language."""
    at = F.col("doc_id")
    log = d.table(spark, sf_dir, "documents").select(F.sha2(at.cast("string"), 256).alias("commit"), F.col("lang").alias("key"), F.lit("ann").alias("author"), (at % 5).alias("time"), F.lit("m").alias("message"))
    return notes.history_of(log, "en").coalesce(1).select("commit", F.monotonically_increasing_id().alias("place"))


@query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM lineitem) AS relationships, (SELECT count(*) FROM documents) AS notes, true AS changes_are_seen")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What communities are made from, by counts and hashes; another weight gives another fingerprint."""
    tables = {"entities": d.entities(spark, sf_dir), "relationships": d.relationships(spark, sf_dir)}
    print_ = catalog.fingerprint(tables)
    other = catalog.fingerprint(tables | {"relationships": tables["relationships"].withColumn("weight", F.col("weight") + (F.col("predicate") == "lies in").cast("double"))})
    return spark.createDataFrame([(print_[0], print_[2], d.notes(spark, sf_dir).count(), print_ != other and print_ == catalog.fingerprint(tables))], "entities long, relationships long, notes long, changes_are_seen boolean")


@query(f"WITH {d.RELATIONSHIPS_SQL} SELECT id, source_id, target_id FROM relationships_ WHERE source_id = 'r-3' OR target_id = 'r-3'")
def query_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity by name, with the relationships at it."""
    entities = d.entities(spark, sf_dir)
    name = entities.where("id = 'r-3'").first()["name"]
    _, edges = graph.query_entity(entities, d.relationships(spark, sf_dir), name.lower())
    return edges.select("id", "source_id", "target_id")


@query(f"WITH {d.RELATIONSHIPS_SQL}, {d.ENTITIES_SQL}, deg AS (SELECT id, count(*) AS rank FROM (SELECT source_id AS id FROM relationships_ UNION ALL SELECT target_id FROM relationships_) GROUP BY id), top AS (SELECT e.id FROM entities_ e LEFT JOIN deg USING (id) ORDER BY coalesce(rank, 0) DESC, e.id LIMIT 1000) SELECT id FROM relationships_ WHERE source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)")
def glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = d.relationships(spark, sf_dir)
    return graph.glance(graph.rank_entities(d.entities(spark, sf_dir), rels), rels, 1000)[1].select("id")


@query(f"WITH {d.NOTES_SQL} SELECT source, target, target LIKE 'projects/%' AS cross_project FROM links_")
def notes_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.graph(d.notes(spark, sf_dir))[1]


@query("(SELECT 'note' AS kind, source || '/' || doc_id AS id FROM documents WHERE lang = 'de' ORDER BY id LIMIT 5) UNION ALL (SELECT 'document', CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'es' ORDER BY id LIMIT 5)")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.notes(spark, sf_dir).where("array_contains(tags, 'de')").select(F.col("key").alias("id"), F.col("key").alias("title"))
    return catalog.palette(rows, d.documents(spark, sf_dir).where("doc_type = 'es'")).select("kind", "id")


@query("SELECT c_nationkey AS nation, lower(c_mktsegment) AS segment, min(c_custkey) AS id FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL UNION ALL SELECT c_nationkey, lower(c_mktsegment), min(c_custkey) FROM customer WHERE c_custkey % 2 = 1 AND (c_nationkey, lower(c_mktsegment)) NOT IN (SELECT c_nationkey, lower(c_mktsegment) FROM customer WHERE c_custkey % 2 = 0) GROUP BY ALL")
def merged_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass adds what the first has not, by keys whatever their case."""
    rows = d.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    least = lambda some: some.groupBy("nation", "segment").agg(F.min("id").alias("id"))
    one, two = least(rows.where("id % 2 = 0")), least(rows.where("id % 2 = 1").withColumn("segment", F.lower("segment")))
    return extraction.merge_passes(one, two, ["nation", "segment"]).select(F.col("nation").cast("int").alias("nation"), F.lower("segment").alias("segment"), "id")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted rows: customers and suppliers as entities of documents named by nation, and a relation from each
    customer to the suppliers of an order; ends are written in other cases, some with blanks, some unknown."""
    columns = ["doc_id", "batch", "ordinal", "kind", "name", "type", "description", "source", "target", "predicate", "weight"]
    fill = lambda rows: rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns))
    people, sellers = d.table(spark, sf_dir, "customer"), d.table(spark, sf_dir, "supplier")
    entities = people.select(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("doc_id"), F.lit(0).alias("batch"), F.col("c_custkey").cast("int").alias("ordinal"), F.lit("entity").alias("kind"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.repeat(F.lit("x"), (F.col("c_custkey") % 5).cast("int")).alias("description"))
    named = sellers.select(F.lit("d0").alias("doc_id"), F.lit(1).alias("batch"), F.col("s_suppkey").cast("int").alias("ordinal"), F.lit("entity").alias("kind"), F.upper("s_name").alias("name"), F.lit("seller").alias("type"), F.lit("a long description of a seller").alias("description"))
    # Orders find their customers before they meet their lines, which are moved once.
    orders = d.table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    bought = d.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    source = F.when(F.col("l_linenumber") == 3, "nobody").otherwise(F.concat(F.lit(" "), F.upper("c_name")))
    target = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit(" "))
    relations = bought.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit(0).alias("batch"), F.col("l_linenumber").alias("ordinal"), F.lit("relation").alias("kind"), source.alias("source"), target.alias("target"), F.lit(" Buys From ").alias("predicate"), F.col("l_quantity").alias("weight"))
    return fill(entities).unionByName(fill(named)).unionByName(fill(relations))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = d.entities(spark, sf_dir).where("type = 'supplier'").withColumn("vector", F.lit(None).cast("array<float>"))
    columns = [c.split()[0] for c in SCHEMAS["entities"].split(", ")]
    return extraction.resolve(_found(spark, sf_dir), known.select(*columns), empty(spark, "relationships"))


@query("SELECT sha256(lower(c_name)) AS id, c_name AS name, 'customer' AS type, repeat('x', CAST(c_custkey % 5 AS INTEGER)) AS description FROM (SELECT c_name, c_custkey FROM customer) UNION ALL SELECT 's-' || s_suppkey, s_name, 'supplier', CASE WHEN length('a long description of a seller') > length('supplier ' || s_name) THEN 'a long description of a seller' ELSE 'supplier ' || s_name END FROM supplier")
def resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted entities resolved against known suppliers: the stored name stays, the longer description too."""
    return _resolved(spark, sf_dir)[0].select("id", "name", "type", F.coalesce("description", F.lit("")).alias("description"))


@query("SELECT DISTINCT 'o' || o_orderkey AS doc_id, sha256(lower(c_name)) AS source_id, 's-' || l_suppkey AS target_id, 'buys from' AS predicate FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey SEMI JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <> 3")
def resolved_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with both ends known, once a document."""
    return _resolved(spark, sf_dir)[1].select("doc_id", "source_id", "target_id", "predicate")


@query("SELECT CAST(l.doc_id AS VARCHAR) AS doc_id, CASE WHEN source < 'src5' THEN 'e-' || source END AS entity_id, 'quality ' || quality AS claim FROM labels l LEFT JOIN documents USING (doc_id)")
def added_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims added to a table that holds a third of them; a second run adds nothing."""
    known = cut(d.table(spark, sf_dir, "documents").select("source").distinct().where("source < 'src5'").select(F.concat(F.lit("e-"), "source").alias("id"), F.col("source").alias("name")), "known")
    found = cut(d.claims(spark, sf_dir).select("doc_id", "entity_name", "claim", "status"), "found")
    some = cut(extraction.add_claims(empty(spark, "claims"), found.where("CAST(doc_id AS BIGINT) % 3 = 0"), known), "claims")
    every = cut(extraction.add_claims(some, found, known), "claims")
    return extraction.add_claims(every, found, known).select("doc_id", "entity_id", "claim")


@query("SELECT id, batch, sha256(content) AS text_hash FROM (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(i // 3 AS INTEGER) AS batch, string_agg(lines[i + 1], chr(10) || '---' || chr(10) ORDER BY i) AS content FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents), unnest(range(0, len(lines))) AS u(i) GROUP BY 1, 2)")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by threes, as prompts hold them."""
    return extraction.batches(d.chunks(spark, sf_dir)).select(F.col("doc_id").alias("id"), "batch", F.sha2("text", 256).alias("text_hash"))
