"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each document becomes its set of distinct word shingles (lower-cased A-Z, words between ASCII blanks) and
   a signature of BANDS * ROWS minima. Documents with equal sets are one class from here on, so thousands of
   copies cost one representative.
2. A class falls into one bucket a band. In each bucket members are first held against one representative
   (a star, linear in the bucket): the one with the most company over all bands, which among edited copies
   is the text that they were made from. Components are formed from these links.
   Members of buckets that still hold several components are compared across components, all of them: of
   two sets similar enough, the rarest shingles (as many as the threshold lets them differ by, one more)
   must have one in common, so classes meet by those shingles only. That is exact: no link is lost, and
   no bucket is capped.
3. A candidate pair is compared signature batch by signature batch. With m of n minima equal and a uniform
   prior, the similarity has a Beta(m + 1, n - m + 1) posterior; the pair is dropped once the posterior chance
   of `similarity` or more is below `miss`.
4. Survivors are confirmed on their full sets, by integers: 100 * common >= percent * union.

A band's bucket is missed by a pair at similarity 0.8 with chance 1 - 0.8**ROWS, all BANDS with about 1e-7; the
posterior bound drops such a pair with a chance of about 1e-6 (miss_chance). More similar pairs are lost less often.

A class with very many partners (the centre of a star, a text copied with edits a million times) is joined last:
the partners' sets and signatures travel once each, and the centre's own goes once to each PARTNERS of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bytes_of, dropped, resting, saved, sent, text_slices
from .components import connected_components
from .tokens import trim_caches
from .words import LOWER, NO_BLANK, find_words, hash_words, mix, shingles

BANDS, ROWS = 40, 5
BATCH = 20
MISS = 1e-7
#: A class with more partners than this meets them in several tasks, so many in each.
PARTNERS = 1000

_RNG = np.random.default_rng(8_191)
_FACTORS = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = bytes_of(batch.column("text"))
    data = LOWER[data]
    starts, ends, first = find_words(data, offsets, NO_BLANK)
    runs, at = shingles(hash_words(data, starts, ends), first, words)
    return [np.unique(runs[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets, a row each."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    for begin in range(0, len(sets), 64):  # a few sets at a time stay in the processor's cache
        upto = min(begin + 64, len(sets))
        part = flat[at[begin] : at[upto] if upto < len(sets) else len(flat)]
        for k in range(BANDS * ROWS):
            out[begin:upto, k] = np.minimum.reduceat(part * _FACTORS[k] + _SHIFTS[k], at[begin:upto] - at[begin])
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's 128-bit name (hi, lo) and signature; of (doc_id, text)."""

    @resting
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        for batch in batches:
            for some in text_slices(batch):
                sets = _sets(some, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, minima([sets[i] for i in full]), strict=True):
                        signed[i] = row.astype("<u4").tobytes()
                hi = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                lo = np.array([mix(s ^ _BAND[0, 0]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo), pa.array(signed, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "hi", "lo", "signature"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, hi long, lo long, signature binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, class_id, n): a row for each class and band."""

    @resting
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = mix((rows * _BAND[:, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)
                repeat = np.repeat(np.arange(len(rows)), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("class_id").take(pa.array(repeat)), batch.column("n").take(pa.array(repeat))], names=["band", "class_id", "n"])

    return classes.select("class_id", "n", "signature").mapInArrow(deal, "band long, class_id long, n long")


def least_matches(similarity: float, miss: float, total: int, batch: int) -> dict[int, int]:
    """For each number of compared minima, the fewest equal ones with which a pair goes on."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= similarity
    out = {}
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(logs - logs.max())
            if weight[above].sum() / weight.sum() >= miss:
                out[n] = m
                break
    return out


def miss_chance(similarity: float, least: dict[int, int], batch: int) -> float:
    """The chance that a pair of just this similarity falls below the bound at some batch."""
    step = np.array([math.comb(batch, k) * similarity**k * (1 - similarity) ** (batch - k) for k in range(batch + 1)])
    alive, lost = np.ones(1), 0.0
    for m in least.values():
        alive = np.convolve(alive, step)
        lost += alive[:m].sum()
        alive[:m] = 0
    return float(lost)


def oriented(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the class that has more partners as b."""
    count = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    one, two = count.select(F.col("id").alias("a"), F.col("count").alias("ca")), count.select(F.col("id").alias("b"), F.col("count").alias("cb"))
    swap = F.col("ca") > F.col("cb")
    return pairs.join(one, "a").join(two, "b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def meet(pairs: DataFrame, a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """pairs (a, b) joined with a_rows by a, then with b_rows by b; the rows of a b with very many partners are
    dealt over several tasks."""
    hot = pairs.groupBy("b").count().where(F.col("count") > PARTNERS)  # a row for each PARTNERS pairs at most
    hot = sent(saved(hot.select("b", F.ceil(F.col("count") / PARTNERS).cast("int").alias("deals")), "hot"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"))
    every = b_rows.join(hot, "b", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return dealt.join(a_rows, "a").join(every, ["b", "deal"])


def bayes_filter(pairs: DataFrame, classes: DataFrame, similarity: float, miss: float) -> DataFrame:
    """Pairs (a, b) whose posterior never fell below the bound; b is joined last."""
    least = least_matches(similarity, miss, BANDS * ROWS, BATCH)
    one = classes.select(F.col("class_id").alias("a"), F.col("signature").alias("sa"))
    two = classes.select(F.col("class_id").alias("b"), F.col("signature").alias("sb"))

    @resting
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                some = batch.slice(begin, 2048)
                x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), "<u4").reshape(some.num_rows, -1) for c in ("sa", "sb"))
                alive, equal = np.arange(some.num_rows), np.zeros(some.num_rows, int)
                for n, m in least.items():
                    equal[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                    alive = alive[equal[alive] >= m]
                kept = pa.array(alive)
                yield pa.RecordBatch.from_arrays([some.column("a").take(kept), some.column("b").take(kept)], names=["a", "b"])

    return meet(pairs, one, two).select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and runs (all shingle hashes) of the documents with the given ids."""

    @resting
    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        for batch in batches:
            for rows in text_slices(batch):
                sets = _sets(rows, words)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "runs"])

    return docs.join(sent(ids), "doc_id", "left_semi").mapInArrow(as_sets, "doc_id long, runs array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose full sets are similar enough. `pairs` is read more than once; b is joined
    last."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = saved(full_sets(docs, ids, words).dropDuplicates(["doc_id", "runs"]), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("runs").alias("ra"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("runs").alias("rb"))
    common = F.size(F.array_intersect("ra", "rb")).cast("long")
    union = F.size("ra") + F.size("rb") - common
    found = saved(meet(pairs, one, two).where(100 * common >= percent * union).select("a", "b").distinct(), "links")
    dropped(sets)
    dropped(ids)
    return found


def rare_pairs(open_: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of different parts that can be similar enough, by their rarest shingles;
    open_ has (class_id, part).

    Sets of n and m shingles are similar enough only if they have w = ceil(percent * (n + m) / (100 + percent))
    in common; put in one order, the first n - w + 1 of one and m - w + 1 of the other then share a shingle.
    Rarest first, shingles that no other open class has lead, and need no row.
    """
    sets = full_sets(docs, open_.select(F.col("class_id").alias("doc_id")), words)
    held = sets.join(open_.withColumnRenamed("class_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("class_id"), "part", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    held = saved(held, "held")
    shared = held.groupBy("run").agg(F.count("*").alias("df"), F.min("part").alias("least"), F.max("part").alias("most")).where("df > 1")
    lists = held.join(shared, "run").groupBy("class_id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("df", "run", (F.col("least") < F.col("most")).alias("mixed")))).alias("l"))
    # Whatever the partner's size, at least percent of 100 of a set's own shingles must be in common.
    room = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("l"))
    firsts = lists.withColumn("room", room).where("room > 0").select("class_id", "part", "n", (F.col("n") - F.size("l")).alias("lone"), F.posexplode(F.slice("l", F.lit(1), F.col("room"))).alias("i", "t"))
    posted = saved(firsts.where("t.mixed").select("class_id", "part", "n", (F.col("lone") + F.col("i")).alias("pos"), F.col("t.run").alias("run")), "posted")
    # Parts meet first, by bounds over their members that no similar pair can fail: with c = percent / (100 +
    # percent), n - w + 1 > pos needs n * (1 - c) - pos >= c * m.
    c = percent / (100 + percent)
    heads = posted.groupBy("run", "part").agg(F.max(F.col("n") * (1 - c) - F.col("pos")).alias("most"), (F.min("n") * c - 1e-6).alias("least"))
    one = heads.select("run", F.col("part").alias("p"), F.col("most").alias("most_p"), F.col("least").alias("least_p"))
    two = heads.select(F.col("run").alias("run_q"), F.col("part").alias("q"), F.col("most").alias("most_q"), F.col("least").alias("least_q"))
    apart = one.join(two, (F.col("run") == F.col("run_q")) & (F.col("p") < F.col("q")) & (F.col("most_p") >= F.col("least_q")) & (F.col("most_q") >= F.col("least_p"))).select("run", "p", "q")
    left = posted.select("run", F.col("part").alias("p"), F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"))
    right = posted.select("run", F.col("part").alias("q"), F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("ib"))
    common = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    met = apart.join(left, ["run", "p"]).where(F.col("ia") <= F.col("na") * (1 - c)).join(right, ["run", "q"]).where((F.col("ia") <= F.col("na") - common) & (F.col("ib") <= F.col("nb") - common))
    found = saved(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    dropped(held)
    dropped(posted)
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, miss: float = MISS) -> DataFrame:
    """Return doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id) and text_hash
    (xxhash64 of the text), a row for each row of `docs`.

    A null, empty or blank text has an empty set, which is linked with nothing. A row with a null id is
    linked with nothing either: component_id is null and kept is true. Repeated rows are equal sets, hence
    one component. Where an id repeats with different texts, each row is judged by its own text, and text_hash
    tells which; components whose smallest ids are equal are one. Very long texts are read whole. Other columns
    are not read.
    """
    percent = round(100 * similarity)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = saved(signatures(rows, words), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    name = ["n_shingles", "hi", "lo"]
    classes = saved(named.groupBy(*name).agg(F.min("doc_id").alias("class_id"), F.first("signature").alias("signature")).withColumn("n", F.col("n_shingles")), "classes")
    bands = saved(band_keys(classes), "bands")
    crowded = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = saved(bands.join(crowded, "band"), "members")
    dropped(bands)
    company = members.groupBy("class_id").agg(F.sum("size").alias("company"))
    heads = members.join(company, "class_id").groupBy("band").agg(F.max(F.struct("company", (-F.col("class_id")).alias("low"))).alias("h")).select("band", (-F.col("h.low")).alias("rep"))
    sizes = classes.select(F.col("class_id").alias("rep"), F.col("n").alias("rep_n"))
    fits = (F.col("n") * 100 >= F.col("rep_n") * percent) & (F.col("rep_n") * 100 >= F.col("n") * percent)

    # Each class against the representative with which it shares most bands.
    shared = members.join(heads, "band").where("class_id <> rep").groupBy("class_id", "rep", "n").agg(F.count("*").alias("bands"))
    best = Window.partitionBy("class_id").orderBy(F.desc("bands"), "rep")
    stars = shared.join(sizes, "rep").where(fits).withColumn("place", F.row_number().over(best)).where("place = 1").select(F.col("class_id").alias("a"), F.col("rep").alias("b"))
    stars = saved(stars, "meetings")
    tested = saved(bayes_filter(stars, classes, similarity, miss), "stars")
    links = [confirm(tested, rows, words, percent)]

    # Whatever shares a bucket but no component is compared across components.
    parts = saved(connected_components(links[0]), "parts")
    placed = saved(members.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select("band", "class_id", F.coalesce("component", "class_id").alias("part")), "placed")
    dropped(members)
    split = placed.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("band")
    open_ = saved(placed.join(split, "band").select("class_id", "part").distinct(), "open")
    dropped(placed)
    pairs = rare_pairs(open_, rows, words, percent)
    before = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untested = saved(oriented(pairs.join(before, ["a", "b"], "left_anti")), "untested")
    rest = saved(bayes_filter(untested, classes, similarity, miss), "rest")
    links.append(confirm(rest, rows, words, percent))

    joined = saved(connected_components(reduce(DataFrame.unionByName, links)), "components")
    by_name = saved(classes.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select(*name, F.coalesce("component", "class_id").alias("component")), "named")
    dropped(classes)
    facts = signed.select("doc_id", "text_hash", *name)
    found = facts.where("n_shingles > 0 and doc_id is not null").join(by_name, name).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "text_hash")
    alone = facts.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    both = found.unionByName(alone)
    return both.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
