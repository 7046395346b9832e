"""Full-text search: folding, snippets, and the stored index against the scan."""

import pytest
from pyspark.sql import functions as F

from quillmere.operators import fulltext
from quillmere.operators.note_index import LAYOUTS, NoteIndex
from quillmere.tables import NOTES


def note(spark, *rows):
    """(key, content) or (key, content, tags), written at the row's number."""
    return spark.createDataFrame([(r[0], r[1], "ann", list(r[2]) if len(r) > 2 else [], {"k": "v"}, n, n) for n, r in enumerate(rows)], NOTES.replace("timestamp", "long")).withColumns({c: F.timestamp_seconds(c) for c in ("created_at", "updated_at")})


def hits(frame):
    return [(r.key, round(r["rank"], 9)) for r in frame.collect()]


@pytest.fixture
def index(spark, tmp_path):
    return NoteIndex(spark, f"file://{tmp_path}/notes")


def test_folding(spark):
    texts = ["Ärger ÉCOLE naïve", "ärger école", "Ἀθήνα ΆΝΘΡΩΠΟΣ", "Йод ёлка", "ǅ ß œ 日本語", "Ǟ ō ṩ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fulltext.words(F.col("t")).alias("w")).collect()
    assert rows[0].w == ["arger", "ecole", "naive"] and rows[1].w == ["arger", "ecole"]
    assert rows[2].w[0] == "αθηνα" and rows[2].w[1].startswith("ανθρωπο") and rows[3].w == ["иод", "елка"]
    assert rows[5].w == ["a", "o", "s"] and "日本語" in rows[4].w
    assert fulltext.phrases_of("École  ärger-X  \"\" Йод") == [["ecole"], ["arger", "x"], ["иод"]]


def test_snippets(spark):
    def of(content, query):
        return spark.createDataFrame([(content,)], "c string").select(fulltext.snippet(F.col("c"), fulltext.phrases_of(query)).alias("s")).first().s

    assert of("prefix words before oauth target word after", "oauth") == "prefix words before <mark>oauth</mark> target word after"
    long = " ".join(f"w{i}" for i in range(30)) + " red. " + " ".join(f"v{i}" for i in range(30)) + " red, Blue! " + " ".join(f"u{i}" for i in range(30))
    # The window with both, though the first match is elsewhere.
    assert of(long, "red blue") == "…<mark>red</mark>, <mark>Blue</mark>! " + " ".join(f"u{i}" for i in range(8)) + "…"
    assert of("one red-blue two red", "red-blue") == "one <mark>red</mark>-<mark>blue</mark> two red"
    assert of("école!", "ecole") == "<mark>école</mark>!" and of(None, "x") == "" and of("nothing here", "x") == "nothing here"


def test_a_search_reads_its_words_and_hits_only(spark, index):
    index.write(note(spark, *((f"n{i}", f"word{i} common text") for i in range(300))))
    found = index.search("word7")
    assert [r.key for r in found.collect()] == ["n7"]
    read = {f.split("/data/")[1] for f in found.inputFiles() if "/data/" in f}
    assert read == set(f.removeprefix("data/") for f in index.store.snapshot().files("notes", LAYOUTS["notes"].bucket_of(spark, [("n7",)])))
    assert len(LAYOUTS["postings"].bucket_of(spark, [("word7",)])) == 1


def test_limits_ties_and_bad_keys(spark, index):
    index.write(note(spark, *((k, "shared-token") for k in "edcba")))
    assert [r.key for r in index.search("shared-token", 3).collect()] == ["a", "b", "c"]
    assert index.search("", 3).count() == index.search("shared-tok*", 3).count() == 0
    with pytest.raises(ValueError):
        index.write(note(spark, ("../x", "t")))
    index.write(note(spark, ("k", "body", ["Security"])))
    assert [r.key for r in index.search("security").collect()] == ["k"] and index.search("k").count() == 1
    index.delete(index.notes().select("key"))
    assert index.search("security").count() == 0 and index.store.snapshot().facts["notes"] == 0
