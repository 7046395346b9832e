"""Neighbours, near duplicates, leaks, toxicity and the pipeline against brute force or planted cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmere.llm import components, decontaminate, near_dups, permutation_index, queries, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = {}
    for i, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(i)
    seen = set()
    for ids in post.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(sets[i]), find(i)) for i in root}


def edited(rng, words, share):
    return [rng.choice(["kappa", "lambda", "mu"]) + str(rng.randrange(50)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(near_dups, "PARTNERS", 3)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, common = [], [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 250))]
        own += common if rng.random() < 0.4 else []
        for _ in range(rng.randrange(1, 7)):
            docs.append(" ".join(edited(rng, own, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))))
    docs += [None, "", "  \n", "two words", "two  WORDS", "one", "a b c", "a b c d", "\x1f odd \x1f blank"]
    docs += [docs[0]] * 30
    rng.shuffle(docs)
    rows = [(i, t, "clash", 1) for i, t in enumerate(docs)]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, band string, n int").repartition(5), words=k)
    want = brute_components([(i, t) for i, t, *_ in rows], k)
    got = found.collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op3_on_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_minhash_near_dups(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, 4)


def test_near_duplicates_nulls_and_none(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dups.near_duplicates(rows).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dups.near_duplicates(rows.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    odd = spark.createDataFrame([(1, long), (3, long + " end"), (5, long), (5, "a text of its own under five"), (7, "a text of its own under five")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(odd).collect())
    assert got == [(1, 149_996, 1, True), (3, 149_997, 1, False), (5, 3, 5, True), (5, 149_996, 1, False), (7, 3, 5, False)]


def test_bayes_bound_keeps_similar_pairs():
    least = near_dups.least_matches(0.8, near_dups.MISS, near_dups.BANDS * near_dups.ROWS, near_dups.BATCH)
    assert near_dups.miss_chance(0.8, least, near_dups.BATCH) < 2e-6 and near_dups.miss_chance(0.85, least, near_dups.BATCH) < 1e-8
    rng = np.random.default_rng(1)
    equal = rng.random((20_000, near_dups.BANDS * near_dups.ROWS)) < 0.8
    lost = np.zeros(len(equal), bool)
    for n, m in least.items():
        lost |= equal[:, :n].sum(axis=1) < m
    assert not lost.any()
    assert (rng.random((1000, 200)) < 0.4).sum(axis=1).max() < least[200]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def recall_of(rows, ids, x, asked):
    """Share of the true 20 nearest among those found; scores, ranks and numbers of rows are checked on the way."""
    got, place = {}, {v: i for i, v in enumerate(ids.tolist())}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        s = x @ x[place[q]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in {m[1] for m in mine}
        assert all(abs(s[place[v]] - score) < 1e-9 for _, v, score in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(ids[order].tolist()))
    return hits / (20 * len(asked))


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.97), ("sf0.1", 0.95)])
def test_nearest_against_brute_force(spark, sf, least):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    recall = recall_of(queries.op2_permutation_index(spark, f"/root/testdata/{sf}").collect(), ids, x, ids[ids % 20 == 0].tolist())
    print(f"recall of op2 at {sf}: {recall:.3f}")
    assert recall >= least


def test_recall_on_100_000_rows(spark):
    """Random directions, seven blocks, a few hundred queries."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    import pyarrow as pa

    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    recall = recall_of(permutation_index.nearest(frame, frame.where("vec_id % 400 = 0")).collect(), np.arange(len(x)), x, list(range(0, len(x), 400)))
    print(f"recall of op2 on 100,000 rows: {recall:.3f}")
    assert recall >= 0.95


def test_nearest_is_exact_with_a_whole_share(spark, monkeypatch):
    """Many blocks of index and queries, vectors of different lengths, copies across blocks, ties to the smaller id."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 6)), 1) * rng.integers(1, 9, (3000, 1))
    x[1500:2000] = x[:500]
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", 400)
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 30)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = permutation_index.nearest(frame, share=1.0).collect()
    place = {q: [] for q in range(0, 3000, 20)}
    for r in sorted(found):
        place[r["query_id"]].append(r["vec_id"])
    for q, mine in place.items():
        s = np.add.accumulate(x * x[q], axis=1)[:, -1]
        assert mine == [j for j in np.lexsort((np.arange(3000), -s)) if j != q][:20]


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "c"), (1, [1.0, 0.0], "c"), (2, [1.0, 0.0], "c"), (3, [0.0, 0.0], "c"), (4, None, "c"), (5, [float("nan"), 1.0], "c"), (6, [None, 1.0], "c"), (7, [0.0, 2.0], "c"), (None, [1.0, 1.0], "c"), (20, [1.0, float("inf")], "c"), (40, [-1.0, 0.0], "c"), (60, [1.0], "c"), (7, [0.0, 2.0], "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in permutation_index.nearest(frame).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.0), (0, 4, 40, -1.0), (40, 1, 7, 0.0), (40, 2, 0, -1.0), (40, 3, 1, -1.0), (40, 4, 2, -1.0)]
    assert permutation_index.nearest(frame.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 9, 12, 25, 60])))) for i in range(40)]
    docs = []
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([10, 200, 5000]))]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items)[1].upper().split()
            at = rng.randrange(len(body))
            body[at:at] = edited(rng, part, rng.choice([0, 0, 0.05]))
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[0][1])]
    items += [(50, None), (51, ""), (None, "x y z")]
    frame = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, item_id string, n int")
    tests = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in decontaminate.leaks(frame, tests).collect()}
    want = set()
    for d, text in docs:
        held = words_of(text)
        for i, item in items:
            own = words_of(item)
            k = min(5, len(own))
            if d is None or i is None or not own:
                continue
            runs = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
            common = len(runs & {tuple(held[j : j + k]) for j in range(len(held) - k + 1)})
            if 100 * common >= 80 * len(runs):
                want.add((d, i, len(runs), common))
    assert got == want and len(want) > 30
    assert decontaminate.leaks(frame, tests.limit(0)).count() == 0
    assert decontaminate.leaks(frame.limit(0), tests).count() == 0


def test_leaks_of_every_size_of_item(spark):
    """Items of 1 to 400 shingles, each with its own load, in documents of all sizes: none may be lost."""
    rng = random.Random(12)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n + 4))) for n in (1, 3, 4, 6, 10, 20, 40, 80, 200, 400)]
    docs = []
    for d in range(400):
        words = []
        for n, text in items:
            w = text.split()
            keep = -(-8 * n // 10)  # just the shingles needed
            at = rng.randrange(n - keep + 1)
            words += [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 50, 300]))] + w[at : at + keep + 4]
        docs.append((d, " ".join(words)))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["item_id"], r["n_common"]): r["count"] for r in found.groupBy("item_id", "n_common").count().collect()} == {(n, -(-8 * n // 10)): 400 for n, _ in items}


def test_leaks_of_short_items_on_many_documents(spark):
    """Every document holds items of one to three shingles; 0.8 % of minima would miss those of one."""
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (2, 5, 6, 7, 30)]
    noise = lambda: [f"v{rng.randrange(10**6)}" for _ in range(40)]
    docs = [(d, " ".join(w for _, t in items for w in [*noise(), t])) for d in range(3000)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["item_id"], r["n_item"], r["n_common"]): r["count"] for r in found.groupBy("item_id", "n_item", "n_common").count().collect()} == {(n, max(1, n - 4), max(1, n - 4)): 3000 for n, _ in items}
    few = decontaminate.leaks(spark.createDataFrame(docs[:50], "doc_id long, text string"), spark.createDataFrame(items[:2], "item_id long, text string"))
    assert few.count() == 100


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in rows and r["toxic"] is not None]
    held = [(rows[d]["score"], t) for d, t in labels if rows[d]["held_out"]]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.93
    assert np.mean([s >= 0.5 for s in pos]) > 0.8 and np.mean([s < 0.5 for s in neg]) > 0.99


def toy(spark):
    rng = random.Random(2)
    clean, bad = [f"w{i}" for i in range(300)], ["vilewort", "nastling", "grubbish"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_spans_and_odd_texts(spark):
    docs, labels = toy(spark)
    model = toxicity.train(docs, labels)
    odd = [(1, None, "c"), (2, "", "c"), (3, "é漢 w5 Vilewort nastling w7", "c"), (4, "w1 " * 50_000, "c"), (5, "w1 " * 50_000 + "vilewort grubbish nastling vilewort", "c"), (5, "!!!", "c")]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got if r["doc_id"] < 5}
    assert by[1]["score"] == by[2]["score"] and not by[1]["predicted"] and not by[4]["predicted"]
    assert by[3]["predicted"] == 1 and [(s["begin"], s["end"]) for s in by[3]["spans"]] == [(6, 23)]
    assert [s["begin"] for s in next(r for r in got if r["doc_id"] == 5 and r["spans"])["spans"]] == [150_000]
    assert toxicity.reject(docs, model).count() == 300
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 9])
    e, t = np.exp(rng.normal(size=9)), rng.normal(size=(2, 2)) * 0.5
    f, b = toxicity.forward_backward(e, first, t, 0.3)
    p = f * b / (1 + f * b)
    for lo, hi in ((0, 4), (4, 9)):
        total, on = 0.0, np.zeros(hi - lo)
        for m in range(1 << (hi - lo)):
            y = [(m >> j) & 1 for j in range(hi - lo)]
            w = np.prod([e[lo + j] if y[j] else 1 for j in range(hi - lo)]) * np.exp(0.3 * y[0] + sum(t[y[j - 1], y[j]] for j in range(1, hi - lo)))
            total += w
            on += w * np.array(y)
        assert np.allclose(p[lo:hi], on / total)


def test_no_labels(spark):
    docs, labels = toy(spark)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        scores = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, some), spans=False).collect()}
        assert len(scores) == 1


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with small documents, labels and benchmark tables, and what should happen to the rows."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels = toy(spark)
    rng = random.Random(9)
    text = lambda n: " ".join(f"u{rng.randrange(2000)}" for _ in range(n))
    base, item = text(300), text(20)
    more = [(1000, base), (1001, base), (1002, base + " one more"), (1003, text(300) + " " + item + " " + text(10)), (1004, text(500) + " vilewort nastling grubbish vilewort"), (1005, text(40)), (1006, ""), (1007, None), (None, text(10)), (1005, None), (1001, text(50)), (1003, text(60)), (None, item + " in a row without an id")]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nowhere at all in here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_catches_planted_cases(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, planted)
        assert after.columns == docs.columns, name
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, planted).collect()]
    # Ids 1001 and 1003 have one row more each, with a text of its own, which stays.
    assert not {1002, 1004} & set(got) and got.count(1001) == got.count(1003) == got.count(None) == 1 and got.count(1005) == 2
    assert {1000, 1005, 1006, 1007, None} <= set(got)
    assert sorted(d for d in got if d is not None and d < 400) == [i for i in range(400) if i % 4]


def test_pipeline_without_rows(spark, planted, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_on_documents(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert 0 < len(rows) < len(docs) and len({r["doc_id"] for r in rows}) == len(rows)
