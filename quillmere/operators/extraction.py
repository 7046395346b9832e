"""Entities, relationships and claims from chunks by a provider, and their resolution into the graph."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_name, normalise_predicate
from ..tables import cut, sent
from .catalog import resolve_claims
from .ledger import Ledger
from .merge import insert_or_ignore, upsert

#: Chunks a call, characters a prompt, further passes, chunks read for claims.
BATCH, ENTITY_CHARS, CLAIM_CHARS, STRUCTURE_CHARS, GLEANINGS, CLAIM_CHUNKS = 3, 8000, 6000, 6000, 1, 5
EXTRACTED = "doc_id string, batch int, ordinal int, kind string, name string, type string, description string, source string, target string, predicate string, weight double"


def _fences(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[1] if "\n" in text else ""
        text = text[: text.rindex("```")] if "```" in text else text
    return text.strip()


def parse_entities(text: str) -> tuple[list[dict], list[dict]]:
    data = json.loads(_fences(text))
    if not isinstance(data, dict):
        raise ValueError("not an object")
    return list(data.get("entities") or []), list(data.get("relationships") or [])


def _prompt(text: str, entities: list[dict] | None = None) -> str:
    """Of a first pass, or of a further one that names what was found before."""
    known = "" if entities is None else "\n" + "\n".join(f"known: {e['name'].lower()}" for e in entities if e.get("name"))
    return "ENTITIES\n" + text[:ENTITY_CHARS] + known


def _with_more(entities: list[dict], relations: list[dict], answer: str) -> tuple[list[dict], list[dict], bool]:
    """With what a further pass has found and was not there; and whether that is anything."""
    more, links = parse_entities(answer)
    ends = lambda r: tuple(str(r.get(k, "")).lower() for k in ("source", "target", "predicate"))
    seen, met = {str(e.get("name", "")).lower() for e in entities}, {ends(r) for r in relations}
    fresh = [e for e in more if str(e.get("name", "")).lower() not in seen]
    tied = [r for r in links if ends(r) not in met]
    return entities + fresh, relations + tied, bool(fresh or tied)


def extract_entities(text: str, provider, gleanings: int = GLEANINGS) -> tuple[list[dict], list[dict]]:
    """One call, and further ones that name what was found before; what a later pass repeats is dropped."""
    told = provider.complete(_prompt(text), json_mode=True)
    entities, relations = parse_entities(told)
    for _ in range(gleanings):
        try:
            answer = provider.complete(_prompt(text, entities), json_mode=True)
            if answer == told:  # nothing new, without reading it
                break
            entities, relations, more = _with_more(entities, relations, answer)
        except ValueError:
            break
        if not more:
            break
    return entities, relations


def batches(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """doc_id, batch, text: chunks joined by threes."""
    grouped = chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / size).cast("int").alias("batch"))
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n---\n").alias("text"))


def _rows(doc: str, batch: int, entities: list[dict], relations: list[dict]) -> list[tuple]:
    out = [(doc, batch, i, "entity", e.get("name"), e.get("type"), e.get("description"), None, None, None, None) for i, e in enumerate(entities)]
    return out + [(doc, batch, i, "relation", None, None, r.get("description"), r.get("source"), r.get("target"), r.get("predicate"), float(r.get("weight") or 1.0)) for i, r in enumerate(relations)]


def extract(chunks: DataFrame, provider, gleanings: int = GLEANINGS, ledger: Ledger | None = None) -> DataFrame:
    """Entity and relation rows (EXTRACTED). A batch whose answer cannot be read is left out. With a ledger no prompt is asked
    twice, over all runs."""
    columns = [c.split()[0] for c in EXTRACTED.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, batch, text in part[["doc_id", "batch", "text"]].itertuples(index=False):
                try:
                    entities, relations = extract_entities(text, provider, gleanings)
                except ValueError:
                    continue
                out += _rows(doc, batch, entities, relations)
            yield pd.DataFrame(out, columns=columns)

    if ledger is None:
        return batches(chunks).mapInPandas(run, EXTRACTED)

    # A pass over all batches at a time; `found` is what a batch's passes have found so far, null if that is nothing yet.
    @F.pandas_udf("string")
    def next_prompt(texts: pd.Series, founds: pd.Series) -> pd.Series:
        return pd.Series([_prompt(t, json.loads(f)[0] if f else None) for t, f in zip(texts, founds, strict=True)], dtype=object)

    @F.pandas_udf("found string, open boolean")
    def after(founds: pd.Series, answers: pd.Series) -> pd.DataFrame:
        out = []
        for held, answer in zip(founds, answers, strict=True):
            try:
                entities, relations, more = _with_more(*json.loads(held), answer) if held else (*parse_entities(answer), True)
                out.append((json.dumps([entities, relations]), more))
            except ValueError:
                out.append((held, False))
        return pd.DataFrame(out, columns=["found", "open"])

    def told(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = part[["doc_id", "batch", "found"]].itertuples(index=False)
            yield pd.DataFrame([x for doc, batch, found in rows for x in _rows(doc, batch, *json.loads(found))], columns=columns)

    open_ = cut(batches(chunks).withColumn("found", F.lit(None).cast("string")), "batches")
    done = []
    for _ in range(1 + gleanings):
        answered = ledger.complete(open_.withColumn("prompt", next_prompt("text", "found")), "prompt", provider, json_mode=True)
        passed = cut(answered.withColumn("a", after("found", "answer")).select("doc_id", "batch", "text", "a.found", "a.open"), "passed")
        done.append(passed.where("not open"))
        open_ = passed.where("open").drop("open")
    every = reduce(DataFrame.unionByName, [x.drop("open") for x in done], open_)
    return every.where("found is not null").mapInPandas(told, EXTRACTED)


def extract_claims(chunks: DataFrame, provider, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, entity_name, claim, status from the first chunks of each document."""

    def read(doc: str, answer: str) -> list[tuple]:
        try:
            found = json.loads(_fences(answer))
        except ValueError:
            return []
        return [(doc, c.get("entity_name"), c.get("claim"), c.get("status")) for c in (found.get("claims", []) if isinstance(found, dict) else found) if c.get("claim")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = part["answer"] if "answer" in part else [provider.complete(p, json_mode=True) for p in part["prompt"]]
            yield pd.DataFrame([x for doc, a in zip(part["doc_id"], answers, strict=True) for x in read(doc, a)], columns=["doc_id", "entity_name", "claim", "status"])

    first = batches(chunks.where(F.col("chunk_index") < CLAIM_CHUNKS), CLAIM_CHUNKS)
    asked = first.select("doc_id", F.concat(F.lit("CLAIMS\n"), F.substring("text", 1, CLAIM_CHARS)).alias("prompt"))
    return (asked if ledger is None else ledger.complete(asked, "prompt", provider, json_mode=True)).mapInPandas(run, "doc_id string, entity_name string, claim string, status string")


def structure(docs: DataFrame, provider, text: str = "content", ledger: Ledger | None = None) -> DataFrame:
    """id, structured: the provider's JSON summary of each document."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else _fences(provider.complete(p, json_mode=True)))

    @F.pandas_udf("string")
    def bare(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: None if a is None else _fences(a))

    asked = docs.select("id", F.concat(F.lit("STRUCTURE\n"), F.substring(F.col(text), 1, STRUCTURE_CHARS)).alias("prompt"))
    if ledger is None:
        return asked.select("id", run("prompt").alias("structured"))
    return ledger.complete(asked, "prompt", provider, json_mode=True).select("id", bare("answer").alias("structured"))


def merge_passes(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both without what `base` has by lower-cased keys; of equal ones the first pass stays."""
    rows = base.withColumn("__pass", F.lit(0)).unionByName(more.withColumn("__pass", F.lit(1)))
    order = Window.partitionBy(*(F.lower(F.coalesce(k, F.lit(""))) for k in keys)).orderBy("__pass", *keys)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__pass")


def resolve(found: DataFrame, entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with extracted rows added. One entity a normalised name: the first name met is shown, the longer
    description kept. Relations whose ends are both known are kept once a document, source, target and
    predicate; ids are hashes, so a second run adds nothing."""
    named = found.where("kind = 'entity'").withColumn("n", normalise_name(F.coalesce("name", F.lit("")))).where("n <> ''")
    place = F.struct("doc_id", "batch", "ordinal")
    one = named.groupBy("n").agg(F.min_by("name", place).alias("name"), F.min_by("type", place).alias("type"), F.max(F.struct(F.char_length(F.coalesce("description", F.lit(""))).alias("l"), F.coalesce("description", F.lit("")).alias("d"))).alias("x"))
    known = entities.groupBy(normalise_name(F.col("name")).alias("n")).agg(F.min_by(F.struct(*entities.columns), "id").alias("o"))
    merged = one.join(known, "n", "left").select(
        F.coalesce("o.id", F.sha2("n", 256)).alias("id"), F.coalesce("o.name", "name").alias("name"), F.coalesce("o.type", "type").alias("type"),
        F.when(F.col("x.l") > F.coalesce(F.char_length("o.description"), F.lit(0)), F.col("x.d")).otherwise(F.col("o.description")).alias("description"),
        F.coalesce("o.rank", F.lit(0)).cast("int").alias("rank"), F.col("o.community_id").alias("community_id"), F.col("o.vector").alias("vector"),
    )
    all_entities = upsert(entities, merged, ["id"], "id")  # a row an id
    ids = all_entities.groupBy(normalise_name(F.col("name")).alias("n")).agg(F.min("id").alias("id"))
    rows = found.where("kind = 'relation'").select("doc_id", normalise_name(F.col("source")).alias("s"), normalise_name(F.col("target")).alias("t"), normalise_predicate(F.coalesce("predicate", F.lit(""))).alias("predicate"), "description", "weight", "batch", "ordinal")
    # An id has one name, so a row for each document, names and predicate is one for its ids, which are longer and moved no more.
    once = rows.groupBy("doc_id", "s", "t", "predicate").agg(F.min_by(F.struct("description", "weight"), F.struct("batch", "ordinal")).alias("v"))
    ended = once.join(ids.select(F.col("n").alias("t"), F.col("id").alias("target_id")), "t").join(ids.select(F.col("n").alias("s"), F.col("id").alias("source_id")), "s")
    new = ended.select(F.sha2(F.concat_ws("\0", "doc_id", "source_id", "target_id", "predicate"), 256).alias("id"), "source_id", "target_id", "predicate", F.col("v.description").alias("description"), F.coalesce("v.weight", F.lit(1.0)).alias("weight"), "doc_id")
    # A row an id already.
    fresh = new.join(sent(relationships.select("id").distinct()), "id", "left_anti")
    return all_entities, relationships.unionByName(fresh.select(*relationships.columns))


def add_claims(claims: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """With extracted claims; those about no known entity have a null entity_id."""
    rows = resolve_claims(found, entities)
    new = rows.select(F.sha2(F.concat_ws("\0", "doc_id", F.coalesce("entity_name", F.lit("")), "claim"), 256).alias("id"), "entity_id", "claim", "status", "doc_id")
    return insert_or_ignore(claims, new, ["id"])
