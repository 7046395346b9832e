"""Operators on small fixtures whose results are known."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere import queries, tables
from quillmere.functions import chunking, text, vectors
from quillmere.operators import communities, extraction, graph, vector_search
from quillmere.providers import OfflineProvider

EDGES = "id string, source_id string, target_id string, weight double, doc_id string"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_wikilinks(spark):
    assert one(spark, "see [[b]] and [[c|the c]], [[b]] again, [[unclosed", text.wikilinks) == ["b", "c"]
    assert one(spark, "none", text.wikilinks) == []


def test_keys(spark):
    bad = ["", ".", "up/../down", "a//b", "/from/root", "w\\in", "nul\0", "end/", "é" * 257, None]
    good = ["n", "deep/er/note", "größe", "...", "é" * 256]
    rows = spark.createDataFrame([(k, k in good) for k in bad + good], "k string, ok boolean")
    assert rows.where(F.coalesce(text.valid_key(F.col("k")), F.lit(False)) != F.col("ok")).count() == 0


def test_split_text():
    assert chunking.split_text("short") == ["short"]
    parts = chunking.split_text("word " * 400, size=100, overlap=20)
    assert len(parts) > 10 and all(0 < len(p) <= 100 for p in parts)
    assert chunking.split_text("x" * 250, size=100, overlap=0) == ["x" * 100, "x" * 100, "x" * 50]


def plain_chunks(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """A second splitter, written from the rule: a text is cut at the coarsest separator that it has; what is too long goes on
    to the finer ones; the others are packed greedily, each chunk beginning with as many of the last pieces as the overlap holds."""
    separator = next((s for s in separators if s in text), "")
    rest = separators[separators.index(separator) + 1 :]
    out, pack = [], []

    def length(parts):
        return len(separator.join(parts))

    def close():
        if pack and separator.join(pack).strip():
            out.append(separator.join(pack).strip())

    for piece in list(text) if separator == "" else text.split(separator):
        if len(piece) >= size:
            close()
            pack = []
            out += plain_chunks(piece, size, overlap, rest) if rest else [piece]
        else:
            if pack and length([*pack, piece]) > size:
                close()
                while pack and (length(pack) > overlap or length([*pack, piece]) > size):
                    pack = pack[1:]
            pack.append(piece)
    close()
    return out


def test_chunks_against_a_second_splitter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(str(r.doc_id), i, c) for r in docs for i, c in enumerate(plain_chunks(r.text or "", 512, 50))}
    found = chunking.chunk(spark.createDataFrame(docs), "doc_id", "text").collect()
    assert {(r.doc_id, r.chunk_index, r.content) for r in found} == want and len(found) == len(want)
    rows = queries.QUERIES["recursive_chunks"](spark, sf_dir).collect()
    assert {(str(r.doc_id), r.chunk_index, r.chars) for r in rows} == {(d, i, len(c)) for d, i, c in want}


def test_chunk_nulls_and_order(spark):
    docs = spark.createDataFrame([("a", None), ("b", "  "), ("c", "one. two. " * 100)], "id string, content string")
    rows = chunking.chunk(docs).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in rows} == {"c"}
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_scoped_walk(spark):
    edges = spark.createDataFrame([("near", "me", "you", 1.0, "here"), ("far", "you", "them", 1.0, "here"), ("aside", "me", "it", 1.0, "there")], EDGES)
    start = spark.createDataFrame([("me",)], "id string")
    scope = spark.createDataFrame([("here",)], "doc_id string")
    ids = lambda frame: {r["id"] for r in frame.collect()}
    assert ids(graph.walk(edges, start, 2)) == {"near", "far", "aside"}
    assert ids(graph.walk(edges, start, 2, scope)) == {"near", "far"}
    assert ids(graph.walk(edges, start, 1, scope)) == {"near"}
    assert ids(graph.walk(edges, start, 2, scope.limit(0))) == set()


def test_walks_of_many_starts(spark, monkeypatch):
    """Against walks one by one, with hubs dealt over slices."""
    monkeypatch.setattr(graph, "HUB", 5)
    rng = np.random.default_rng(2)
    ends = rng.integers(0, 30, (120, 2)) % rng.integers(2, 31, (120, 2))
    rows = [(f"r{i}", f"n{a}", f"n{b}", 1.0, f"d{i % 4}") for i, (a, b) in enumerate(ends.tolist())]
    edges = spark.createDataFrame(rows, EDGES)
    starts = [("w1", "n0"), ("w2", "n7"), ("w2", "n9"), ("w3", "nowhere"), ("w4", "n0")]
    scopes = [("w1", "d0"), ("w1", "d1"), ("w2", "d2"), ("w2", "d0"), ("w3", "d0")]

    def reach(walk, depth, docs):
        seen, now, out = set(), {n for w, n in starts if w == walk}, {}
        for hop in range(1, depth + 1):
            seen |= now
            met = [(r, a, b) for r, a, b, _, d in rows if (docs is None or d in docs) and (a in now or b in now)]
            for r, _, _ in met:
                out.setdefault(r, hop)
            now = {x for _, a, b in met for x, y in ((a, b), (b, a)) if y in now} - seen
        return {(walk, r, h) for r, h in out.items()}

    frame = spark.createDataFrame(starts, "walk string, id string")
    got = lambda *scope: {tuple(r) for r in graph.walks(edges, frame, 3, *scope).collect()}
    walks = {w for w, _ in starts}
    assert got() == set().union(*(reach(w, 3, None) for w in walks))
    docs = {w: {d for v, d in scopes if v == w} for w in walks}
    assert got(spark.createDataFrame(scopes, "walk string, doc_id string")) == set().union(*(reach(w, 3, docs[w]) for w in walks))


def test_arguments_and_hash_vectors():
    assert [text.int_arg(v, 7) for v in (None, "", "12", 3.9, "x", "1e3")] == [7, 7, 12, 3, 7, 1000]
    v = vectors.hash_vector("some text", 64)
    assert len(v) == 64 and v == vectors.hash_vector("some text", 64) != vectors.hash_vector("other", 64)
    assert abs(sum(x * x for x in v) - 1) < 1e-6


def test_two_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    edges = spark.createDataFrame([(f"r{i}", a, b, 1.0, "d") for i, (a, b) in enumerate(pairs)], EDGES)
    found = communities.louvain(edges)
    finest = {r["entity_id"]: r["label"] for r in found.where("level = 0").collect()}
    assert finest == dict.fromkeys("abc", "a") | dict.fromkeys("xyz", "x")
    tables, members = communities.community_tables(found)
    assert tables.where("level = 0").count() == 2
    assert members.count() >= 6


def test_community_detection_tells_every_level(spark, monkeypatch):
    """A ring of 16 triangles: neighbouring triangles together have the higher modularity."""
    pairs = [(f"{i:02}{a}", f"{i:02}{b}") for i in range(16) for a, b in ("ab", "bc", "ac")] + [(f"{i:02}c", f"{(i + 1) % 16:02}a") for i in range(16)]
    edges = spark.createDataFrame([(f"r{i}", a, b, 1.0, "d") for i, (a, b) in enumerate(pairs)], EDGES)
    monkeypatch.setattr(queries.d, "relationships", lambda *_: edges)
    rows = queries.community_detection(spark, "").collect()
    labels = {level: {r["entity_id"]: r["label"] for r in rows if r["level"] == level} for level in {r["level"] for r in rows}}
    assert len(labels) > 1 and all(len(v) == 48 for v in labels.values())
    assert all(labels[0][f"{i:02}a"] == labels[0][f"{i:02}b"] == labels[0][f"{i:02}c"] for i in range(16))
    assert len(set(labels[1].values())) < len(set(labels[0].values()))
    assert all(labels[1][e] == labels[1][label] for e, label in labels[0].items())


def test_extracted_graph_against_brute_force(spark, monkeypatch):
    """All documents, of one batch of chunks and of many, resolved by plain Python."""
    texts = ["Ada Lovelace met Charles Babbage. Then ADA LOVELACE wrote.", None, "", "nothing here", "Only Grace. And Grace."]
    texts += [" ".join(f"Name{(i * k) % 23} saw Town{i % 7} and more words." for i in range(200)) for k in (1, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(77, "Other Item met Benchmark.")], "item_id long, text string")
    monkeypatch.setattr(queries.d, "table", lambda spark, sf_dir, name: {"documents": docs, "benchmark": items}[name])
    key = lambda name: hashlib.sha256(name.lower().encode()).hexdigest()
    known, links = set(), set()
    for n, held in enumerate(texts):
        parts = chunking.split_text(held) if held else []
        for i in range(0, len(parts), extraction.BATCH):
            entities, relations = extraction.extract_entities("\n---\n".join(parts[i : i + extraction.BATCH]), OfflineProvider())
            known |= {key(e["name"]) for e in entities}
            links |= {(key(r["source"]), key(r["target"]), str(n)) for r in relations}
    want = {x for x in links if x[0] in known and x[1] in known}
    rows = queries.extracted_graph(spark, "").collect()
    assert len(rows) == len(want) and len({r["predicate"] for r in rows}) == 1
    assert {(r["source_id"], r["target_id"], r["doc_id"]) for r in rows} == want
    assert {r["doc_id"] for r in rows} >= {"0", "5", "6"}


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    rows = spark.range(100).selectExpr("id", "array('x', repeat('y', 1000)) AS words", "struct(id AS n, 'z' AS t) AS s")
    hinted = lambda frame: "hint" in frame._jdf.queryExecution().logical().toString().lower()
    assert hinted(tables.sent(rows))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 50_000)
    assert not hinted(tables.sent(rows)) and hinted(tables.sent(rows.limit(10)))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 5)
    assert not hinted(tables.sent(rows.limit(10)))


def test_cell_index_recall(spark):
    """Against brute force: clustered vectors, of whose 32 cells 8 are read; opened again from its folder."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 4000)] + 0.7 * rng.normal(size=(4000, 32))
    rows = spark.createDataFrame([(f"{i:05}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    built = vector_search.CellIndex.build(rows, 32)
    index = vector_search.CellIndex.open(spark, built.store.folder)
    assert index.rows().count() == 4000
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {q: np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist() for q in range(0, 4000, 200)}
    hits = sum(len({int(r["id"]) for r in index.search(x[q].tolist(), 10, 8).collect()} & set(want)) for q, want in exact.items())
    assert hits >= 0.95 * 20 * 10
    found = index.search(x[0].tolist(), 10, 8)
    read = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "/rows/" in f}
    assert read == {str(c) for c in index._probed(x[:1], 8)[0]}  # files of other cells are not read


@pytest.mark.parametrize("probes", [16, 32])
def test_cell_index_of_many_queries(spark, sf_dir, monkeypatch, probes):
    """All vectors as queries at once: with all cells the result is exact, with half of them near it; groups are split."""
    monkeypatch.setattr(vector_search, "SLICE", 7)
    monkeypatch.setattr(vector_search, "QUERIES", 50)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    x = np.array([r.vector for r in rows.orderBy("id").collect()], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = vector_search.CellIndex.build(rows, 32)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).unionByName(spark.createDataFrame([(-1, None), (-2, [1.0])], "query_id long, query_vector array<float>"))
    found = {}
    for r in index.search_many(asked, 10, probes).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    assert set(found) == set(range(len(x))) and all(sorted(v) == list(range(1, 11)) for v in found.values())
    scores = unit @ unit.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    recall = np.mean([len({i for i, _ in found[q].values()} & set(near[q].tolist())) / 10 for q in found])
    assert recall >= (0.999 if probes == 32 else 0.75)
    assert all(abs(s - scores[q, i]) < 1e-9 for q in found for i, s in found[q].values())


def test_cell_index_changes(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    frame = lambda ids, shift=0.0: spark.createDataFrame([(i, (x[i] + shift).tolist()) for i in ids], "id long, vector array<double>")
    index = vector_search.CellIndex.build(frame(range(200)), 8, folder=f"file://{tmp_path}/cells", source_version=3)
    before = set(index.now.files("rows"))
    other = vector_search.CellIndex.open(spark, f"file://{tmp_path}/cells", source_version=3)
    index.add(frame([5, 250], 0.5), source_version=4).remove(spark.createDataFrame([(7,), (999,)], "id long"), source_version=5)
    assert before < set(index.now.files("rows"))  # what was there is not written again
    ids = lambda some, n=300: {r.id for r in some.search(x[7].tolist(), n, 8).collect()}
    assert ids(index) == set(range(200)) - {7} | {250} and ids(other) == set(range(200))
    assert index.search((x[5] + 0.5).tolist(), 1, 8).first().id == 5 and other.search(x[7].tolist(), 1, 8).first().id == 7
    assert index.rows().count() == 200 and index.compact().rows().count() == 200 and ids(index) == ids(other.refresh())
    with pytest.raises(vector_search.StaleIndex):
        vector_search.CellIndex.open(spark, f"file://{tmp_path}/cells", source_version=6)
    with pytest.raises(vector_search.DimensionError):
        index.add(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"))


def test_modularity_of_communities(spark):
    """Six cliques of six in a ring: Louvain finds them, and its modularity is that of plain arithmetic."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abcdef" for i in range(6) for j in range(i)] + [(f"{c}0", f"{e}1") for c, e in zip("abcdef", "bcdefa")]
    edges = spark.createDataFrame([(f"r{i}", a, b, 1.0, "d") for i, (a, b) in enumerate(pairs)], EDGES)
    labels = {r["entity_id"]: r["label"] for r in communities.louvain(edges).where("level = 0").collect()}
    assert all(labels[f"{c}{i}"] == f"{c}0" for c in "abcdef" for i in range(6))
    total = len(pairs)
    want = sum(labels[a] == labels[b] for a, b in pairs) / total - sum((sum((labels[a] == c) + (labels[b] == c) for a, b in pairs) / (2 * total)) ** 2 for c in set(labels.values()))
    named = spark.createDataFrame(list(labels.items()), "node string, label string")
    got = communities.modularity(graph.edge_weights(edges), named, float(total))
    assert abs(got - want) < 1e-9 and got > 0.7


def test_commit_messages_at_the_limit(spark):
    for filler in ("x", "é", "漢", "😀"):
        for shift in range(4):
            full = "a" * shift + filler * 9000
            made = spark.createDataFrame([(full,)], "v string").select(text.commit_message(F.col("v"), F.lit(None).cast("string")).alias("m")).first()["m"]
            assert made.endswith("…") and full.startswith(made[:-1]) and 8189 <= len(made[:-1].encode()) <= 8192
    assert one(spark, "x" * 8192, lambda c: text.commit_message(c, F.lit(""))) == "x" * 8192
