"""Benchmark decontamination: short test items found inside long documents, on DataFrame functions only.

Items and documents are sets of word shingles (lower-cased A-Z, words between ASCII blanks); an item leaks
into a document that holds at least `containment` of its shingles. The Jaccard similarity of such a pair is
nearly 0 when the document is long, so one MinHash signature size cannot serve all: documents are partitioned
by size (powers of two of their number of shingles), and in each partition the signature has as many bins as
its documents need, about `load` shingles a bin. A bin keeps the smallest hash in it (one-permutation MinHash;
bins are ranges of the hash, so the minima of a sorted set are those whose bin differs from the one before).

A shingle of an item that the document holds is a bin's minimum with chance p = (1 - exp(-load)) / load. Items are
partitioned by size too: each has the largest load (a power of two) at which, asked for the least number of
collisions that its size allows, it is missed at the threshold with chance `miss` at most. Bins of a larger load
are unions of those of a smaller, and so are minima: a document is signed once, at the smallest load asked for, and
a minimum collides with an item only if it is one at the item's own load.

Items too short for that at LEAST_LOAD (three shingles or fewer) are not left to minima: all shingles of the
documents are held against theirs, and none is lost. Colliding pairs are then checked exactly, on the shingles
themselves. So what is lost is at most `miss` of the pairs at the threshold, far less of those above it.

An item of fewer words than a shingle has is one run of all its words, sought as such. Empty items are never
found.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import dropped, saved, sent

MISS = 1e-7
#: The smallest load; items that it would miss more often are sought among all shingles.
LEAST_LOAD = 1 / 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+"), "")


def _hashes(words: str, k: int) -> str:
    """SQL: hashes of all runs of k words, of an array column of word hashes."""
    run = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({k}, {run})) ELSE array() END"


def _runs(words: str, k: int) -> str:
    """SQL: the distinct runs of k words themselves; words hold no blank, so a blank can join them."""
    return f"CASE WHEN size({words}) >= {k} THEN array_distinct(transform(sequence(1, size({words}) - {k} + 1), i -> array_join(slice({words}, i, {k}), ' '))) ELSE array() END"


def match_chance(load: float) -> float:
    return (1 - math.exp(-load)) / load


def choose_load(smallest: int, miss: float) -> float:
    """The largest load, of 4, 2, 1, ... 1/64, at which an item with `smallest` shingles in common is not missed."""
    load = 4.0
    while load > LEAST_LOAD and (1 - match_chance(load)) ** smallest > miss:
        load /= 2
    return load


def least_collisions(common: int, chance: float, miss: float) -> int:
    """The largest m such that fewer than m of `common` shingles collide with chance `miss` at most; 1 at least."""
    below, m = 0.0, 0
    while m < common:
        below += math.comb(common, m) * chance**m * (1 - chance) ** (common - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def item_sets(items: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """item_id, k (words in a run), n and runs of each item with words."""
    split = items.select(F.col(key).cast("long").alias("item_id"), word_list(F.col(text)).alias("w")).where("item_id is not null and size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(words)))
    runs = split.withColumn("runs", F.expr("array_distinct(transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' ')))"))
    return runs.select("item_id", "k", F.size("runs").alias("n"), "runs")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 5, containment: float = 0.8, miss: float = MISS) -> DataFrame:
    """Return doc_id, item_id, n_item (the item's shingles), n_common (those the document holds), containment:
    a row for each item found in each document.

    Null texts count as empty; rows with a null doc_id or item_id take no part. Texts under one doc_id are
    checked each on its own and the best one is told, once, however often it is repeated; so are items under
    one id. Very long texts are read whole. Other columns are not read. No items, or no documents, give no rows.
    """
    spark = docs.sparkSession
    percent = round(100 * containment)
    sets = saved(item_sets(items, item_key, item_text, words), "items")
    sizes = sets.groupBy("k", "n").count().collect()  # a row a size of item
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item int, n_common int, containment double")
    need = {r["n"]: -(-percent * r["n"] // 100) for r in sizes}
    short = [n for n, c in need.items() if (1 - match_chance(LEAST_LOAD)) ** c > miss]
    loads = {n: choose_load(c, miss) for n, c in need.items() if n not in short}
    load = min(loads.values(), default=LEAST_LOAD)
    ks = sorted({r["k"] for r in sizes})
    # A row a size of item: its level (how many times its load is twice the smallest) and least collisions.
    by_size = [(n, round(math.log2(loads[n] / load)), least_collisions(c, match_chance(loads[n]), miss)) if n in loads else (n, 0, c) for n, c in need.items()]
    least = spark.createDataFrame(by_size, "n int, level int, least int")

    # The same hashes from the item's runs: of k, then the k word hashes.
    posted = sets.select("item_id", "k", "n", F.explode("runs").alias("run")).withColumn("w", F.transform(F.split("run", " "), lambda x: F.xxhash64(x)))
    by_k = [posted.where(F.col("k") == k).select("item_id", "n", F.expr(f"xxhash64({k}, {', '.join(f'w[{j}]' for j in range(k))})").alias("hash")) for k in ks]
    posting = by_k[0]
    for more in by_k[1:]:
        posting = posting.unionByName(more)
    posting = saved(posting.distinct(), "postings")

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    hashed = rows.select("doc_id", F.transform(word_list(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    all_hashes = lambda ks: hashed.select("doc_id", F.expr(f"sort_array(array_distinct(concat({', '.join(_hashes('w', k) for k in ks)})))").alias("h"))
    runs = all_hashes(ks)
    # Size partition: bins = 2**bits, the power of two next above shingles / load.
    binned = runs.select("doc_id", "h", F.greatest(F.lit(1), F.least(F.lit(62), F.ceil(F.log2(F.size("h") / F.lit(load))).cast("int"))).alias("bits"))
    # Each hash with the one before it; what begins no bin of its own is no minimum.
    paired = binned.select("doc_id", "bits", F.arrays_zip(F.col("h").alias("hash"), F.expr("concat(array(CAST(NULL AS BIGINT)), slice(h, 1, greatest(size(h) - 1, 0)))").alias("before")).alias("h"))
    first = "({0}before IS NULL OR shiftright({0}hash, 64 - {1}) <> shiftright({0}before, 64 - {1}))"
    signed = paired.select("doc_id", "bits", F.expr(f"filter(h, x -> {first.format('x.', 'bits')})").alias("minima"))
    # The outer form, for the inner one is given a filter on the array, which the optimizer would push below the
    # projections and work out anew for every element.
    flat = signed.select("doc_id", "bits", F.explode_outer("minima").alias("m")).select("doc_id", "bits", "m.hash", "m.before")
    met = []
    if loads:
        own = posting.join(F.broadcast(least.select("n", "level")), "n")
        hits = flat.join(sent(own.where(~F.col("n").isin(short)) if short else own), "hash")
        met.append(hits.where(first.format("", "greatest(1, bits - level)")).select("doc_id", "item_id", "n", "hash"))
    if short:
        short_ks = sorted({r["k"] for r in sizes if r["n"] in short})
        met.append(all_hashes(short_ks).select("doc_id", F.explode_outer("h").alias("hash")).join(sent(posting.where(F.col("n").isin(short))), "hash").select("doc_id", "item_id", "n", "hash"))
    found = reduce(DataFrame.unionByName, met).groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("collisions"))
    pairs = saved(found.join(F.broadcast(least), "n").where("collisions >= least").select("doc_id", "item_id").distinct(), "pairs")
    dropped(posting)

    ids = pairs.select("doc_id").distinct()
    some = rows.join(sent(saved(ids, "ids")), "doc_id", "left_semi").select("doc_id", word_list(F.col("text")).alias("w"))
    whole = saved(some.select("doc_id", F.expr(f"concat({', '.join(_runs('w', k) for k in ks)})").alias("held")), "held")
    checked = pairs.join(whole, "doc_id").join(sent(sets), "item_id").select("doc_id", "item_id", F.col("n").alias("n_item"), F.size(F.array_intersect("held", "runs")).alias("n_common"))
    kept = checked.where(F.col("n_common") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_common") / F.col("n_item"))
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_common")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_common", "b.containment")

