"""What operators move and hold over tables made to grow the wrong way."""

import pytest
from pyspark.sql import functions as F

from quillmere.operators import graph


@pytest.fixture
def moved(spark):
    """MB that an action writes to shuffles; joins are not sent on Spark's own guess."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        rows = store.executorList(False)
        return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size())) / 1e6

    def measure(action):
        before = written()
        result = action()
        return result, written() - before

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield measure
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def edges(spark, n, source, target, doc):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), source.alias("source_id"), target.alias("target_id"), doc.alias("doc_id"))


def test_walks_that_meet_at_a_node(spark, moved):
    """Each of 1,500 walks has its own document with a relationship to one shared node, and a wide document with all."""
    own = F.col("id").cast("string")
    rows = edges(spark, 1500, F.concat(F.lit("w"), own), F.lit("hub"), F.concat(F.lit("d"), own))
    starts = rows.select(F.col("source_id").alias("walk"), F.col("source_id").alias("id"))
    scopes = rows.select(F.col("source_id").alias("walk"), "doc_id")
    found, mb = moved(lambda: graph.walks(rows, starts, 2, scopes).groupBy("hop").count().collect())
    assert [tuple(r) for r in found] == [(1, 1500)]
    assert mb < 2  # 2,250,000 rows of (walk, document) before
    # 1,100 relationships of one document, which one walk may use.
    wide = edges(spark, 1100, F.concat(F.lit("a"), own), F.lit("hub"), F.lit("wide")).withColumn("id", F.concat(F.lit("x"), "id"))
    both = rows.unionByName(wide)
    more = scopes.unionByName(spark.createDataFrame([("w7", "wide"), ("w8", "wide"), ("w8", "wide")], "walk string, doc_id string"))
    found = graph.walks(both, starts, 2, more).groupBy("walk").agg(F.count("*").alias("n")).where("n > 1").collect()
    assert sorted(map(tuple, found)) == [("w7", 1101), ("w8", 1101)]


def test_hops_in_scopes_move_new_nodes_only(spark, moved, monkeypatch):
    """20,000 documents of four relationships, each in the scopes of four walks; nodes are too many to be sent."""
    from quillmere import tables

    monkeypatch.setattr(tables, "BROADCAST_ROWS", 100)
    node = lambda k, n, c: F.concat(F.lit(c), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("string"))
    rows = edges(spark, 80_000, node(1, 9000, "p"), node(2, 500, "s"), F.concat(F.lit("d"), F.floor(F.col("id") / 4).cast("string"))).localCheckpoint()
    starts = rows.select(F.col("target_id").alias("walk"), F.col("target_id").alias("id")).distinct()
    scopes = rows.select(F.col("target_id").alias("walk"), "doc_id")
    mb = [moved(lambda n=n: graph.walks(rows, starts, n, scopes).write.format("noop").mode("overwrite").save())[1] for n in (1, 2)]
    assert mb[1] - mb[0] < 4  # 12 before: every relationship of a scope, for each of its walks


def test_a_walk_moves_what_it_meets_only(spark, moved):
    own = F.col("id").cast("string")
    rows = edges(spark, 100_000, F.concat(F.lit("a"), own), F.concat(F.lit("a"), (F.col("id") + 1).cast("string")), F.concat(F.lit("d"), own))
    docs = spark.range(50_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"))
    found, mb = moved(lambda: graph.walk(rows, spark.createDataFrame([("a49999",)], "id string"), 3, docs).select("id", "hop", "doc_id").collect())
    assert sorted(map(tuple, found)) == [("r49996", 3, "d49996"), ("r49997", 2, "d49997"), ("r49998", 1, "d49998"), ("r49999", 1, "d49999")]
    assert mb < 0.5


def test_pieces_of_texts():
    """A task holds one piece as Python objects at a time, not its batch."""
    import pyarrow as pa

    from quillmere.functions.pieces import by_pieces, pieces

    texts = pa.array(["x" * 40, None, "", "y" * 500, "é" * 30, "z", None])
    assert [(p.start, p.stop) for p in pieces(texts, 100)] == [(0, 3), (3, 4), (4, 7)]
    assert list(pieces(texts.slice(7))) == [] and len(by_pieces(len, pa.int32(), texts.slice(7))) == 0
    assert by_pieces(lambda t, n: (t or "-")[:1] + str(n), pa.string(), texts.slice(1), pa.array(range(6))).to_pylist() == ["-0", "-1", "y2", "é3", "z4", "-5"]


def test_jobs_of_a_sweep(spark):
    """A sweep over the nodes is one write; its modularity and what is left to do are not asked for by jobs of their own."""
    from quillmere.operators import communities

    arcs = edges(spark, 600, F.concat(F.lit("a"), (F.col("id") % 60).cast("string")), F.concat(F.lit("b"), (F.col("id") % 37).cast("string")), F.lit("d")).withColumn("weight", F.lit(1.0))
    pairs = graph.edge_weights(arcs).localCheckpoint()
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().localCheckpoint()

    def jobs(sweeps):
        spark.sparkContext.setJobGroup(f"sweeps-{sweeps}", "")
        communities.louvain_level(pairs, nodes, sweeps)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweeps-{sweeps}"))

    try:
        assert jobs(5) - jobs(1) <= 4 * 9
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_relations_are_moved_with_their_names(spark, moved):
    """30,000 relations between 300 names, resolved: neither long ids nor descriptions go with them where these are not asked for."""
    from quillmere.operators import extraction
    from quillmere.tables import empty

    name = lambda k: F.concat(F.lit("n"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(300)).cast("string"))
    own = {"doc_id": F.concat(F.lit("d"), (F.col("id") % 5000).cast("string")), "batch": F.lit(0), "ordinal": F.col("id").cast("int"), "weight": F.lit(1.0), "description": F.repeat(F.xxhash64("id").cast("string"), 10)}
    none = F.lit(None).cast("string")
    links = spark.range(30_000).select("id", *(c.alias(k) for k, c in own.items()), F.lit("relation").alias("kind"), none.alias("name"), none.alias("type"), name(1).alias("source"), name(2).alias("target"), F.lit("p").alias("predicate"))
    told = spark.range(300).select("id", *(c.alias(k) for k, c in own.items()), F.lit("entity").alias("kind"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"), none.alias("type"), none.alias("source"), none.alias("target"), none.alias("predicate"))
    found = links.unionByName(told).drop("id")
    n, mb = moved(lambda: extraction.resolve(found, empty(spark, "entities"), empty(spark, "relationships"))[1].select("source_id", "target_id", "predicate", "doc_id").distinct().count())
    assert n == links.select("doc_id", "source", "target").distinct().count()
    assert mb < 6, mb


def test_nearest_of_a_group_are_found_in_pieces():
    """A task holds some queries' products at a time; equal vectors tie, by the smaller row."""
    import tracemalloc

    import numpy as np

    from quillmere.operators.vector_search import _unit, best_of

    rng = np.random.default_rng(3)
    held, asked = _unit(rng.normal(size=(20_000, 16))), _unit(rng.normal(size=(400, 16)))
    held[7_000:7_050], asked[0] = held[:50], held[7_003]
    tracemalloc.start()
    at, best, scores = best_of(asked, held, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6, most  # 192 MB of products, their negatives and their order before
    want = np.argsort(-np.round(asked @ held.T, 12), axis=1, kind="stable")[:, :5]
    assert best.reshape(400, 5).tolist() == want.tolist() and best[:2].tolist() == [3, 7_003] and scores[0] == scores[1]
    assert at.tolist() == np.repeat(np.arange(400), 5).tolist()
    odd = best_of(np.ones((2, 2)), np.array([[1, np.nan], [1, 1], [1, 1]]), 2)
    assert odd[1].tolist() == [1, 2, 1, 2] and len(best_of(asked, held, 0)[0]) == 0 and len(best_of(np.ones((1, 2)), np.ones((3, 2)), 9)[1]) == 3


def test_words_of_notes_stay_where_the_notes_are(spark, moved, tmp_path):
    """Postings are made without moving a row for each word; of notes of one key the last is indexed, and no other is gathered."""
    from quillmere.operators.note_index import NoteIndex, one_a_key, postings

    word = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000)).cast("string")) for k in range(40)))
    at = F.timestamp_seconds("id")
    rows = spark.range(1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("key"), word.alias("content"), F.lit("ann").alias("author"), F.array(F.lit("t")).alias("tags"), F.create_map(F.lit("k"), F.lit("v")).alias("frontmatter"), at.alias("created_at"), at.alias("updated_at"))
    n, mb = moved(lambda: postings(rows, "s").select(F.size("places").alias("n")).agg(F.sum("n")).first()[0])
    assert n == 1000 * 42 and mb < 0.1, (n, mb)
    twice = rows.unionByName(rows.where("key = 'n7'").withColumns({"content": F.lit("later word word"), "updated_at": F.timestamp_seconds(F.lit(5000))}))
    one, mb = moved(lambda: {r.key: r.content for r in one_a_key(twice).collect()})
    assert len(one) == 1000 and one["n7"] == "later word word" and mb < 0.1, mb
    index = NoteIndex(spark, f"file://{tmp_path}/notes")
    index.write(twice)
    places = {(r.part, r.term): r.places for r in index.store.read("postings").where("key = 'n7'").collect()}
    assert places == {("title", "n7"): [0], ("content", "later"): [0], ("content", "word"): [1, 2], ("tags", "t"): [0]}


def test_aligned_tokens_go_to_blocks_once_and_packed(spark, moved):
    """A segment goes from its blocks to where it is aligned once, with its places, and back as compressed bytes."""
    from quillmere.llm import alignment, queries

    word = lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), 1 + F.pmod(F.xxhash64(i, "id"), F.lit(20_000))).cast("string"))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), word), " ").alias("text"))
    docs = docs.repartition(8, "doc_id").localCheckpoint()
    names = [queries._tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found, mb = moved(lambda: alignment.align(docs, *names)[0].agg(F.count("*").alias("texts"), F.sum("n_a").alias("n_a"), F.sum("n_links").alias("n_links")).first())
    assert tuple(found) == (2000, 1129863, 1129863)
    assert mb < 5  # 6.2 before


def test_sizes_of_buckets_are_not_sent(spark, monkeypatch):
    """Spark sizes a table before an explode; what it yields is no table to send to all tasks on that guess."""
    from quillmere.llm import simhash

    plans, kept = [], simhash.saved

    def saved(df, name):
        if name == "held":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(simhash, "saved", saved)
    nodes = kept(spark.range(600).select(F.col("id").alias("print")), "nodes")
    assert simhash.links(nodes, 4, 64).count()
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


@pytest.fixture
def weighted(spark):
    """5,000 pairs of 300 nodes, most of them within one of ten groups, some loops, and a node with a loop only."""
    a = F.pmod(F.xxhash64("id"), F.lit(300))
    b = F.when(F.col("id") % 5 > 0, F.pmod(a + 10 * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)), F.lit(300))).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(300)))
    text = lambda c: F.concat(F.lit("n"), c.cast("string"))
    rows = spark.range(5000).select(text(a).alias("source_id"), text(b).alias("target_id"), ((F.col("id") % 7) / 3).alias("weight"))
    rows = rows.unionByName(spark.createDataFrame([("alone", "alone", 2.5)], "source_id string, target_id string, weight double"))
    pairs = graph.edge_weights(rows).localCheckpoint()
    return pairs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().localCheckpoint()


def test_a_sweep_over_packed_arcs_moves_nothing(spark, moved, weighted):
    from quillmere.operators import communities

    mb = [moved(lambda n=n: communities.louvain_level(*weighted, n).collect())[1] for n in (1, 7)]
    assert mb[1] - mb[0] < 0.01


def test_packed_arcs_give_the_same_labels(spark, monkeypatch, weighted):
    from quillmere.operators import communities

    labels = lambda: sorted(map(tuple, communities.louvain_level(*weighted).collect()))
    monkeypatch.setattr(communities, "ARCS", 900)
    packed = labels()
    monkeypatch.setattr(communities, "BROADCAST_BYTES", 0)
    assert packed == labels() and len(packed) == weighted[1].count()
    assert dict(packed)["alone"] == "alone" and 5 < len({label for _, label in packed}) < 100


def test_gains_are_rounded_as_spark_does(spark):
    import numpy as np

    from quillmere.operators.communities import _rounded

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=500), np.round(rng.normal(size=500), 9) + 5e-10, rng.normal(size=200) * 1e8, [0.0, -0.0, 1.0000000005, -2.5e-10, 5e-10, 12345678.0000000015, 1e300]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert _rounded(x).tolist() == want
