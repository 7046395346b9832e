"""Ranked full-text search over notes (BM25)."""

from __future__ import annotations

import math
import unicodedata

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_phrases
from ..tables import cut

#: Fixed values of the ranking.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
LIMIT, SNIPPET = 20, 10
WORD = r"[\p{L}\p{N}]+"
#: Blocks of letters that may carry marks: Latin, Greek, Cyrillic and their extensions.
_BLOCKS = (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000))


def _unmarked() -> dict[str, str]:
    """Lower-case letters that are one letter and its marks, and that letter."""
    split = {chr(c): unicodedata.normalize("NFD", chr(c)) for block in _BLOCKS for c in block}
    return {c: d[0] for c, d in split.items() if len(d) > 1 and c == c.lower() and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:])}


_LETTERS = _unmarked()
MARKED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
MARKS = r"\p{Mn}+"


def folded(text: Column) -> Column:
    """Lower-cased, letters without their marks, whether composed or combining."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, ""), MARKED, PLAIN)


def words(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), 0)


def phrases_of(query: str) -> list[list[str]]:
    """The words of each phrase of a query, folded like the texts."""
    plain = regex.sub(MARKS, "", query.lower()).translate(str.maketrans(MARKED, PLAIN))
    return [p for p in (regex.findall(WORD, x) for x in query_phrases(plain)) if p]


def index_notes(notes: DataFrame) -> DataFrame:
    """key, title, content, tags and the words of each of these: what a search reads. The title is the last part
    of the key."""
    title = F.substring_index("key", "/", -1)
    tags = F.array_join(F.col("tags"), " ") if dict(notes.dtypes).get("tags", "").startswith("array") else F.coalesce(F.col("tags"), F.lit("")) if "tags" in notes.columns else F.lit("")
    rows = notes.select("key", title.alias("title"), "content", tags.alias("tags"))
    return rows.withColumns({"w_title": words(F.col("title")), "w_content": words(F.col("content")), "w_tags": words(F.col("tags"))})


def _occurrences(column: str, phrase: list[str]) -> str:
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in phrase)
    if len(phrase) == 1:
        return f"size(filter({column}, w -> w = {quoted}))"
    n = len(phrase)
    return f"CASE WHEN size({column}) >= {n} THEN size(filter(sequence(1, size({column}) - {n - 1}), i -> slice({column}, i, {n}) = array({quoted}))) ELSE 0 END"


def ranked(counted: DataFrame, dfs: list[int], n: int, mean: float, limit: int) -> DataFrame:
    """key, rank: the best of notes given by (key, dl, tf0, tf1, ...); dfs tells how many of the n notes have each
    phrase, mean their length."""
    score, every = F.lit(0.0), F.lit(True)
    for i, df in enumerate(dfs):
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), IDF_FLOOR)
        tf = F.col(f"tf{i}").cast("double")
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / mean))
        every = every & (F.col(f"tf{i}") > 0)
    return cut(counted.where(every).select("key", (-score).alias("rank")).orderBy("rank", "key").limit(limit), "best")


def frequencies(counted: DataFrame, phrases: int) -> list[int]:
    """How many of the notes have each phrase."""
    row = counted.agg(*(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(phrases))).first()
    return [row[f"df{i}"] for i in range(phrases)]


NO_HITS = "key string, title string, snippet string, tags string, rank double"


def search(index: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """key, title, snippet, tags, rank of notes that have every phrase of the query in some column; rank is minus
    BM25, ascending, ties by key. A blank query has no hits. One pass over the notes keeps each note's counts of
    phrases and its length, a few numbers; statistics, scores and the top-k come from these, and only the hits'
    texts are read again. (`note_index` answers the same from stored postings.)"""
    phrases = phrases_of(query)
    if not phrases:
        return index.sparkSession.createDataFrame([], NO_HITS)
    counts = {f"tf{i}": F.expr(" + ".join(_occurrences(c, p) for c in ("w_title", "w_content", "w_tags"))) for i, p in enumerate(phrases)}
    length = F.size("w_title") + F.size("w_content") + F.size("w_tags")
    counted = cut(index.select("key", length.alias("dl"), *(c.cast("long").alias(name) for name, c in counts.items())), "counts")
    facts = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    if not facts["n"]:
        return index.sparkSession.createDataFrame([], NO_HITS)
    best = ranked(counted, frequencies(counted, len(phrases)), facts["n"], facts["mean"], limit)
    return shown(index.join(F.broadcast(best), "key"), phrases, limit)  # `limit` rows


def shown(hits: DataFrame, phrases: list[list[str]], limit: int) -> DataFrame:
    """The hits' rows (key, title, content, tags, rank) as they are told."""
    return hits.orderBy("rank", "key").limit(limit).select("key", "title", snippet(F.col("content"), phrases).alias("snippet"), "tags", "rank")


def snippet(content: Column, phrases: list[list[str]], width: int = SNIPPET) -> Column:
    """The window of `width` words that has most different phrases, of such the one with most matches, of such the
    first; matches within <mark> tags, an ellipsis where text is left out."""
    parts = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"[\p{L}\p{N}\p{Mn}]+|[^\p{L}\p{N}\p{Mn}]+"), 0)
    # Parts are words and what lies between them in turn; word j of the text is part 2 * j or 2 * j + 1.
    plain = F.filter(F.transform(parts, folded), lambda w: w.rlike(r"^[\p{L}\p{N}]"))
    places = F.sequence(F.lit(1), F.greatest(F.size(plain), F.lit(1)))

    def matches(n: int, phrase: list[str]) -> Column:
        begins = F.filter(places, lambda i: F.slice(plain, i, F.lit(len(phrase))) == F.array(*map(F.lit, phrase)))
        return F.transform(begins, lambda i: F.struct(i.alias("at"), F.lit(n).alias("phrase"), F.lit(len(phrase)).alias("words")))

    found = F.flatten(F.array(*(matches(n, p) for n, p in enumerate(phrases))))

    def rated(start: Column) -> Column:
        inside = F.filter(found, lambda m: (m["at"] >= start["at"]) & (m["at"] + m["words"] <= start["at"] + width))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda m: m["phrase"]))).alias("kinds"), F.size(inside).alias("all"), (-start["at"]).alias("early"), start["at"].alias("at"))

    first = F.coalesce(F.array_max(F.transform(found, rated))["at"], F.lit(1))
    # Some words before the first match, as far as the text's end lets the window reach.
    begin = F.greatest(F.lit(1), F.least(first, F.size(plain) - width + 1))
    marked = F.array_distinct(F.flatten(F.transform(found, lambda m: F.sequence(m["at"], m["at"] + m["words"] - 1))))
    led = F.when(F.element_at(parts, 1).rlike(r"^[\p{L}\p{N}\p{Mn}]"), F.lit(0)).otherwise(F.lit(1))
    texts = F.filter(F.transform(parts, lambda w, i: F.when((i - led) % 2 == 0, F.when(F.array_contains(marked, (F.floor((i - led) / 2) + 1).cast("int")), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)).otherwise(w)), lambda w: w.isNotNull())
    shown_ = F.array_join(F.slice(texts, (begin - 1) * 2 + led + 1, F.lit(2 * width - 1)), "")
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.concat(F.when(begin > 1, "…").otherwise(""), shown_, F.when(F.size(plain) >= begin + width, "…").otherwise("")))
