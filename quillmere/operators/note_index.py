"""A stored inverted index of notes: searches read the postings of their words and the notes that they hit, no others.

Tables (`store.Store`, one commit a batch):

notes      by key
postings   term, key, part (title, content or tags), places, dl (the note's length in words), stamp; by term
lengths    key, dl, stamp: each note's present batch; by key
dead       key, stamp: notes of earlier batches that were written over or deleted; by key

A batch appends its postings beside those of others, so that it rewrites no bucket of words; what it replaces or deletes
becomes a row in `dead`, by which searches pass over old postings, until `compact` writes them anew without. How many
notes there are and how many words they have are numbers kept with the commit.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pieces import by_pieces
from ..store import Layout, Store
from ..tables import NOTES, cut, sent
from .fulltext import LIMIT, NO_HITS, frequencies, index_notes, phrases_of, ranked, shown
from .notes import normalised

PARTS = ("title", "content", "tags")
LAYOUTS = {
    "notes": Layout(NOTES, ("key",), ("key",)),
    "postings": Layout("term string, key string, part string, places array<int>, dl long, stamp string", ("term", "key", "part", "stamp"), ("term",), 64),
    "lengths": Layout("key string, dl long, stamp string", ("key",), ("key",)),
    "dead": Layout("key string, stamp string", ("key", "stamp"), ("key",)),
}


def _places(words: str | None) -> list[dict]:
    found: dict[str, list[int]] = {}
    for at, word in enumerate(words.split(" ") if words else []):
        found.setdefault(word, []).append(at)
    return [{"term": term, "places": places} for term, places in found.items()]


def _length() -> Column:
    return (F.size("w_title") + F.size("w_content") + F.size("w_tags")).cast("long")


def postings(notes: DataFrame, stamp: str) -> DataFrame:
    """A row for each word of each part of each note, with its places in that part. A note's words are told apart where the
    note is; none is moved."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.int32()))]))

    @F.arrow_udf("array<struct<term:string,places:array<int>>>")
    def places_of(words: pa.Array) -> pa.Array:
        return by_pieces(_places, kind, words)

    # Words hold no blanks.
    each = index_notes(notes).select("key", _length().alias("dl"), F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"w_{p}").alias("words")) for p in PARTS))).alias("p"))
    found = each.select("key", "dl", "p.part", F.explode(places_of(F.array_join("p.words", " "))).alias("w"))
    return found.select("w.term", "key", "part", "w.places", "dl", F.lit(stamp).alias("stamp"))


def one_a_key(incoming: DataFrame) -> DataFrame:
    """Of several notes of a key the last by updated_at, ties to the largest. Only keys that repeat are gathered."""
    rows = normalised(incoming)
    again = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    if again.isEmpty():
        return rows
    again = sent(again)
    many = rows.join(again, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct(*incoming.columns), F.struct("updated_at", F.to_json(F.struct(*incoming.columns)))).alias("n")).select("n.*")
    return rows.join(again, "key", "left_anti").select(*incoming.columns).unionByName(many)


class NoteIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder, LAYOUTS)

    def notes(self) -> DataFrame:
        return self.store.read("notes")

    def write(self, incoming: DataFrame) -> int:
        """Notes written over those of equal keys (of several the last by updated_at; created_at stays), and indexed, in
        one commit; return its version. Bad keys are an error."""
        change, stamp = self.store.begin(), uuid.uuid4().hex
        # Of several notes of a key one is indexed, so one is chosen before.
        new = cut(one_a_key(incoming), "notes")
        lengths = cut(index_notes(new).select("key", _length().alias("dl"), F.lit(stamp).alias("stamp")), "lengths")
        had, words = self._bury(change, new.select("key"))
        facts = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        change.merge("notes", new, keep_first=("created_at",), single=True).merge("lengths", lengths, single=True).append("postings", postings(new, stamp))
        return change.add_facts(notes=facts["n"] - had, words=facts["dl"] - words).commit()

    def delete(self, keys: DataFrame) -> int:
        """Notes of these keys (column key) deleted, those that are not there passed over; return the version."""
        change, keys = self.store.begin(), cut(keys.select("key").distinct(), "keys")
        had, words = self._bury(change, keys)
        change.merge("notes", deleted=keys).merge("lengths", deleted=keys)
        return change.add_facts(notes=-had, words=-words).commit()

    def _bury(self, change, keys: DataFrame) -> tuple[int, int]:
        """Mark the present postings of notes as dead; how many notes these are and how many words they have."""
        old = cut(change.read("lengths", change.buckets("lengths", keys)).join(sent(keys), "key", "left_semi"), "old")
        change.append("dead", old.select("key", "stamp"))
        row = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        return row["n"], row["dl"]

    def compact(self) -> int:
        """Postings of dead notes go, and buckets become single files again."""
        change = self.store.begin()
        dead = change.read("dead").distinct()
        live = change.read("postings").join(dead, ["key", "stamp"], "left_anti")
        change.replace("postings", live).replace("dead", dead.limit(0))
        return change.commit()

    def search(self, query: str, limit: int = LIMIT) -> DataFrame:
        """What fulltext.search gives over all notes, from one version of the index."""
        phrases, now = phrases_of(query), self.store.snapshot()
        n = now.facts.get("notes", 0)
        if not phrases or not n:
            return self.spark.createDataFrame([], NO_HITS)
        terms = sorted({w for p in phrases for w in p})
        held = now.read("postings", LAYOUTS["postings"].bucket_of(self.spark, [(t,) for t in terms])).where(F.col("term").isin(terms))
        live = held.join(now.read("dead").distinct(), ["key", "stamp"], "left_anti")
        # A row for each word of the query at most meets here.
        parts = live.groupBy("key", "part", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        none = F.array().cast("array<int>")

        def begin(i: int, word: str) -> Column:
            return F.transform(F.coalesce(F.try_element_at(F.col("at"), F.lit(word)), none), lambda x: x - i)

        def times(phrase: list[str]) -> Column:
            begins = [begin(i, w) for i, w in enumerate(phrase)]
            both = begins[0]
            for more in begins[1:]:
                both = F.array_intersect(both, more)
            return F.size(both).cast("long")

        counted = parts.groupBy("key", "dl").agg(*(F.sum(times(p)).alias(f"tf{i}") for i, p in enumerate(phrases)))
        counted = cut(counted, "counts")
        best = ranked(counted, frequencies(counted, len(phrases)), n, now.facts["words"] / n, limit)
        keys = [r["key"] for r in best.select("key").collect()]  # `limit` at most
        texts = now.read("notes", LAYOUTS["notes"].bucket_of(self.spark, [(k,) for k in keys]) if keys else []).where(F.col("key").isin(keys))
        return shown(index_notes(texts).join(F.broadcast(best), "key"), phrases, limit)  # `limit` rows
