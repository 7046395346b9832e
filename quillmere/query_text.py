"""Queries of the scalar functions, over whole tables, and their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as d
from .functions import frontmatter, text, vectors
from .functions.html import resolved
from .functions.pieces import by_pieces
from .operators import notes
from .registry import query


@query("SELECT o_orderkey AS id, lower(trim(o_orderpriority)) AS predicate FROM orders")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.normalise_predicate(F.concat(F.lit(" \n"), "o_orderpriority", F.lit("\t "))).alias("predicate"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?]+)', 1) LIKE '%.net' AND url LIKE '%://m.%' AS mobile FROM (SELECT page_id, url FROM pages)")
def same_origin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page belongs to the origin of a mobile .net host: its own host is put in the base."""
    rows = d.table(spark, sf_dir, "pages").select("page_id", "url")
    moved = F.when(F.col("url").rlike(r"^https?://m\.[^/?]*\.net(/|$|\?)"), F.regexp_replace("url", r"^https?://[^/?]+", "https://m.example.net")).otherwise(F.col("url"))
    return rows.select("page_id", text.same_origin(moved, "https://m.example.net").alias("mobile"))


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, CAST(i - 1 AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as little-endian 32-bit floats and read back, component by component."""
    packed = d.table(spark, sf_dir, "embeddings").select("vec_id", vectors.pack_vector(F.col("embedding").cast("array<float>")).alias("b"))
    both = packed.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), F.posexplode(vectors.unpack_vector(F.col("b"))).alias("place", "value"))
    return both.withColumn("value", F.col("value").cast("double"))


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.v AS DOUBLE[])), 6) AS distance FROM embeddings a, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) c UNION ALL SELECT -1, 1")
def cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every vector from vector 0, and that of a zero vector."""
    rows = d.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    zero = rows.where("vec_id = 0").select("embedding").first()[0]
    with_none = rows.unionByName(spark.createDataFrame([(-1, [0.0] * len(zero))], rows.schema))
    return with_none.select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), vectors.literal(zero)), 6).alias("distance"))


@query(f"WITH {d.DOCUMENTS_SQL} SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN canonical_id ELSE id END AS canonical FROM documents_")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("id").cast("long") % 3 == 0, F.col("canonical_id")).when(F.col("id").cast("long") % 3 == 1, F.lit(""))
    return d.documents(spark, sf_dir).select("id", text.canonical_or_id(known, F.col("id")).alias("canonical"))


@query("SELECT doc_id, lang || ',' || source || ',x y' AS tags FROM documents")
def normalised_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" "), F.upper("lang")), F.lit(""), F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.lit(" X y "), F.upper("source"))
    return d.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.normalise_tags(raw), ",").alias("tags"))


@query("SELECT c_custkey AS id, c_custkey % 3 = 1 AS valid FROM customer")
def valid_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a capital, with dashes for signs, and too long ones."""
    name = F.regexp_replace(F.lower("c_name"), "#", "-")
    slug = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, name).otherwise(F.repeat(name, F.lit(20)))
    return d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.valid_slug(slug).alias("valid"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'host-example-org-a-b_-' || page_id WHEN 1 THEN 'git-example-org-team-repo-' || page_id ELSE 'host-example-org-a-' || page_id END AS slug, CASE page_id % 3 WHEN 2 THEN page_id || '%20ü' WHEN 1 THEN 'repo.' || page_id ELSE 'b_-' || page_id END AS name FROM pages")
def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and names of https, scp and ssh remotes."""
    n, case = F.col("page_id").cast("string"), F.col("page_id") % 3
    remote = F.when(case == 0, F.concat(F.lit("https://user:pw@HOST.example.org:8443/a/b_-"), n, F.lit(".git/"))).when(case == 1, F.concat(F.lit(" git@git.example.org:team/repo."), n, F.lit(".git"))).otherwise(F.concat(F.lit("ssh://me@host.example.org:22/a/"), n, F.lit("%20ü")))
    return d.table(spark, sf_dir, "pages").select("page_id", text.slug(remote).alias("slug"), text.project_name(remote).alias("name"))


@query("SELECT doc_id, sha256(trim(text)) AS stripped FROM documents")
def stripped_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in fences, of which every third has none."""
    body = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("```json\n"), "text", F.lit("\n```  ")))
    found = d.table(spark, sf_dir, "documents").select("doc_id", text.strip_fences(body).alias("s"))
    return found.select("doc_id", F.sha2(F.trim(F.regexp_replace("s", r"\n\z", "")), 256).alias("stripped"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || source ELSE 'Community' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'first ' || lang || ' second line' ELSE 'only ' || lang END AS summary FROM documents")
def community_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with both parts, the summary over several lines, and answers with neither."""
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title:  About "), "source", F.lit(" \nSUMMARY: first "), "lang", F.lit("\n\n  second line \n"))).otherwise(F.concat(F.lit(" only "), "lang", F.lit(" ")))
    return d.table(spark, sf_dir, "documents").select("doc_id", text.community_report(answer).alias("r")).select("doc_id", "r.title", "r.summary")


@query(r"""WITH m AS (SELECT doc_id, text || chr(10) || chr(10) || 'Author: ' || lang || source AS full_text FROM documents)
    SELECT doc_id, CASE WHEN octet_length(encode(full_text)) <= 8192 THEN sha256(full_text) ELSE 'cut' END AS message FROM m""")
def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the text as subject; those of more than 8 KiB are told as cut if they are cut as they should."""
    made = text.commit_message(F.col("text"), F.concat("lang", F.lit("\r\n"), "source"))
    rows = d.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", made.alias("m"))
    kept = F.left("m", F.char_length("m") - 1)
    size = F.octet_length(kept)
    right = F.endswith("m", F.lit("…")) & size.between(8189, 8192) & F.startswith(F.concat("text", F.lit("\n\nAuthor: "), "lang", "source"), kept)
    long = F.octet_length(F.concat("text", F.lit("\n\nAuthor: "), "lang", "source")) > 8192
    return rows.select("doc_id", F.when(~long, F.sha2("m", 256)).when(right, "cut").otherwise("wrong").alias("message"))


@query("SELECT o_orderkey AS id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' WHEN a < 2592000 THEN (a // 86400) || 'd ago' ELSE strftime(make_timestamp(1000000 * (1700000000 - a)), '%Y-%m-%d') END AS age FROM (SELECT o_orderkey, o_orderkey * 37 AS a FROM orders)")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(1_700_000_000)
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.relative_time(now - F.col("o_orderkey") * 37, now).alias("age"))


@query("SELECT event_id, CASE WHEN s BETWEEN 100 AND 599 THEN (s // 100) || 'xx' ELSE 'unknown' END AS class FROM (SELECT event_id, event_id % 700 AS s FROM events)")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "events").select("event_id", text.status_class(F.col("event_id") % 700).alias("class"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 7, 8) THEN '/root/notes/' || CASE doc_id % 9 WHEN 0 THEN source || '/' || doc_id WHEN 7 THEN '...' || doc_id ELSE repeat('k', 512) END || '.md' END AS path FROM documents")
def note_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of notes; null for keys that would leave the folder, or are no keys."""
    n = F.col("doc_id").cast("string")
    keys = [F.concat_ws("/", "source", n), F.lit(""), F.concat(F.lit("/"), n), F.concat(F.lit("a/../"), n), F.concat(F.lit("a//"), n), F.concat(F.lit("b\\"), n), F.repeat(F.lit("k"), F.lit(513)), F.concat(F.lit("..."), n), F.repeat(F.lit("k"), F.lit(512))]
    key = F.element_at(F.array(*keys), (F.col("doc_id") % 9 + 1).cast("int"))
    return d.table(spark, sf_dir, "documents").select("doc_id", text.note_path("/root/notes/", key).alias("path"))


@query("SELECT doc_id, CAST((octet_length(encode(text)) + octet_length(encode(lang))) // 4 AS INTEGER) AS tokens FROM documents")
def token_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "documents").select("doc_id", text.token_usage(F.col("text"), F.col("lang")).alias("tokens"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^https?://[^/?]+') || '/x/y' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'http://else.org/z' END AS link FROM pages")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, bare fragment, mail and absolute links against their pages."""
    href = F.element_at(F.array(F.lit("/x/./y?q=1#f"), F.lit("#top"), F.lit("mailto:a@b.c"), F.lit(" http://else.org/z#w ")), (F.col("page_id") % 4 + 1).cast("int"))
    return d.table(spark, sf_dir, "pages").select("page_id", resolved(F.col("url"), href).alias("link"))


@query("""SELECT source || '/' || doc_id AS key, sha256(text) AS body, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Ann ' || lang END AS author, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || ',b c' END AS tags,
    CASE WHEN doc_id % 4 IN (0, 2) THEN doc_id ELSE 1704164645 END AS created FROM documents""")
def read_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files with and without frontmatter, whose time may be missing."""
    rows = d.table(spark, sf_dir, "documents")
    block = F.concat(F.lit("---  \nauthor: Ann "), "lang", F.lit("\ntags: ["), F.upper("lang"), F.lit(", ' B c', "), "lang", F.lit("]\n"), F.when(F.col("doc_id") % 2 == 1, "created_at: '2024-01-02T03:04:05Z'\n").otherwise(""), F.lit("---\n"))
    raw = F.concat(F.when(F.col("doc_id") % 4 == 0, "").otherwise(block), "text")
    read = notes.read_notes(rows.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), raw.alias("raw"), F.col("doc_id").alias("mtime")))
    return read.select("key", F.sha2("content", 256).alias("body"), "author", F.array_join("tags", ",").alias("tags"), F.unix_timestamp("created_at").alias("created"))


@query("SELECT doc_id, sha256(text) AS body, lang AS title FROM documents")
def frontmatter_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written with a block of frontmatter and read back."""

    @F.arrow_udf("string")
    def written(texts: pa.Array, titles: pa.Array) -> pa.Array:
        return by_pieces(lambda body, title: frontmatter.encode({"title": title, "n": 1}, body), pa.string(), texts, titles)

    rows = d.table(spark, sf_dir, "documents").select("doc_id", frontmatter.parsed(written(F.col("text"), F.col("lang"))).alias("p"))
    return rows.select("doc_id", F.sha2("p.body", 256).alias("body"), F.col("p.frontmatter")["title"].alias("title"))
