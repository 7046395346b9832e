"""Notes: reading and writing versions, history, tree, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import parsed
from ..functions.text import commit_message, key_folder, key_title, normalise_tags, parse_wikilink, valid_key, wikilinks
from .merge import insert_or_ignore, upsert

HISTORY_LIMIT, HISTORY_MAX = 50, 500


def read_notes(raw: DataFrame) -> DataFrame:
    """Notes of raw files (key, raw, mtime): frontmatter's author and tags, times if they are RFC 3339, else the
    file's. A malformed block is told in `error` and the whole file is the content."""
    p = raw.select("key", F.timestamp_seconds("mtime").alias("at"), parsed(F.col("raw")).alias("p"))
    time = lambda c: F.coalesce(F.try_to_timestamp(F.col(c)), F.col("at"))
    return p.select("key", F.col("p.body").alias("content"), F.col("p.author").alias("author"), normalise_tags(F.col("p.tags")).alias("tags"), F.col("p.frontmatter").alias("frontmatter"), time("p.created").alias("created_at"), time("p.updated").alias("updated_at"), F.col("p.error").alias("error"))


def normalised(incoming: DataFrame) -> DataFrame:
    """Notes as they are stored, tags normalised. Bad keys are an error."""
    bad = incoming.where(~valid_key(F.col("key"))).select("key").first()
    if bad:
        raise ValueError(f"bad note key {bad['key']!r}")
    return incoming.withColumn("tags", normalise_tags(F.col("tags")))


def write_notes(notes: DataFrame, incoming: DataFrame) -> DataFrame:
    """The notes with incoming ones written over them: created_at stays, tags are normalised. Bad keys are an
    error."""
    return upsert(notes, normalised(incoming), ["key"], "updated_at", keep_first=("created_at",))


def delete_note(notes: DataFrame, key: str) -> DataFrame:
    if notes.where(F.col("key") == key).isEmpty():
        raise KeyError(key)
    return notes.where(F.col("key") != key)


def append_history(history: DataFrame, before: DataFrame, after: DataFrame, author: str, time: int) -> DataFrame:
    """One more row for each note whose content differs between two states; none where nothing changed."""
    had = before.select("key", F.sha2("content", 256).alias("a"))
    has = after.select("key", F.sha2("content", 256).alias("b"))
    changed = had.join(has, "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    verb = F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "delete").otherwise("update")
    rows = changed.select(
        F.sha2(F.concat_ws("\0", "key", F.coalesce("b", F.lit("")), F.lit(str(time))), 256).alias("commit"), "key", F.lit(author.replace("\r", "").replace("\n", "")).alias("author"),
        F.lit(time).cast("long").alias("time"), commit_message(F.concat(verb, F.lit(": "), F.col("key")), F.lit(author)).alias("message"),
    )
    return insert_or_ignore(history, rows, ["commit"])


def history_of(history: DataFrame, key: str, limit: int = HISTORY_LIMIT) -> DataFrame:
    rows = history.where(F.col("key") == key).orderBy(F.desc("time"), "commit")
    return rows.limit(min(limit, HISTORY_MAX)) if limit > 0 else rows


def tree(notes: DataFrame) -> DataFrame:
    """path, parent_path, name, depth, type (folder or note) of all folders and notes, in order."""
    parts = notes.where(~F.col("key").rlike(r"(^|/)\.")).select("key", F.split("key", "/").alias("p"))
    prefixes = parts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("path"), i.alias("depth"), (i == F.size("p")).alias("leaf")))).alias("x"))
    rows = prefixes.select("x.path", "x.depth", F.when(F.col("x.leaf"), "note").otherwise("folder").alias("type")).distinct()
    return rows.select("path", key_folder(F.col("path")).alias("parent_path"), key_title(F.col("path")).alias("name"), "depth", "type").orderBy("path", "type")


def links(notes: DataFrame) -> DataFrame:
    """source, target, project, key, cross_project: distinct links of each note's body."""
    found = notes.select(F.col("key").alias("source"), F.explode(wikilinks(F.col("content"))).alias("t"))
    return found.select("source", parse_wikilink(F.col("t")).alias("l")).select("source", "l.target", "l.project", "l.key", "l.cross_project")


def graph(notes: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, title, folder, tags, project, missing) and edges (source, target, cross_project). Links to notes
    that are not there stay as edges; another project's note becomes a node, missing unless `others`
    (project, key) knows it."""
    edges = links(notes)
    own = notes.select("key", key_title(F.col("key")).alias("title"), key_folder(F.col("key")).alias("folder"), "tags", F.lit(None).cast("string").alias("project"), F.lit(False).alias("missing"))
    stubs = edges.where("cross_project").select(F.col("target"), "project", "key").distinct()
    if others is None:
        known = stubs.withColumn("there", F.lit(None).cast("boolean"))
    else:
        known = stubs.join(others.select("project", "key", F.lit(True).alias("there")).distinct(), ["project", "key"], "left")
    far = known.select(F.col("target").alias("key"), key_title(F.col("key")).alias("title"), key_folder(F.col("key")).alias("folder"), F.array().cast("array<string>").alias("tags"), "project", F.col("there").isNull().alias("missing"))
    return own.unionByName(far).orderBy("key"), edges.select("source", "target", "cross_project").distinct().orderBy("source", "target")


def related(edges: DataFrame, key: str) -> DataFrame:
    """Neighbours in either direction, itself left out."""
    out = edges.where(F.col("source") == key).select(F.col("target").alias("key"))
    back = edges.where(F.col("target") == key).select(F.col("source").alias("key"))
    return out.unionByName(back).where(F.col("key") != key).distinct().orderBy("key")


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target").groupBy(F.col("target").alias("key")).agg(F.count_distinct("source").alias("backlinks"))


def import_notes(notes: DataFrame, raw: DataFrame, now: int) -> DataFrame:
    """Notes with those of an archive (key, raw) written over them."""
    new = read_notes(raw.withColumn("mtime", F.lit(now)))
    return write_notes(notes, new.select(*notes.columns))
