"""SimHash near-duplicates by covering locality-sensitive hashing: every pair within the radius is found.

1. A text's fingerprint has a bit where more than half of its word shingles' 64-bit hashes (XXH64, seed 42,
   repeats included) have one. Equal fingerprints are one node from here on, so copies cost one node.
2. Masks. Bit i of the fingerprint is given a vector c(i) of radius + 1 bits that is not zero; table v, for each of
   the 2**(radius + 1) - 1 vectors v that are not zero, keeps the bits i for which c(i) and v have an odd number of
   ones in common, about half of them. The at most `radius` bits in which a pair differs have vectors that span no
   more than radius dimensions, so some v is orthogonal to all of them: in that table the pair's masked
   fingerprints are equal. No pair within the radius is missed.
3. A node has a row in each table; rows with equal masked fingerprints form a bucket. Buckets of up to BUCKET nodes
   are compared inside, all against all, and give the links of a spanning forest only, one less than nodes at most.
4. A larger bucket is split by the same masks over the bits that its table left out: a pair within the radius
   differs in those bits alone, so some mask keeps it together again. Splitting goes on until every bucket
   is small; as nodes differ, those equal in all but b bits are 2**b at most, so it ends, and no bucket is capped.
5. Links form components (`components`), each named by the smallest document id in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bytes_of, dropped, resting, saved, text_slices
from .components import connected_components
from .tokens import trim_caches

BITS, SEED = 64, 42
#: Larger buckets are split by further masks.
BUCKET = 512
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 14


def masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bits of a fingerprint, of which one leaves out any `radius` of them."""
    # Single bits first, so that more than `radius` fingerprint bits have vectors of all dimensions: no mask is empty.
    vectors = sorted(range(1, 1 << (radius + 1)), key=lambda v: (v.bit_count(), v))
    given = {b: vectors[i % len(vectors)] for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (given[b] & v).bit_count() & 1) for v in vectors]


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text in blocks; of its whole sequence if it has fewer words."""
    found = text.lower().split()  # of bytes: A-Z only, and between the six ASCII blanks
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(found) - words + 1, 1)
    begins, stops = starts[:n].tolist(), ends[-n:].tolist()
    for i in range(0, n, _BLOCK):
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[i : i + _BLOCK], stops[i : i + _BLOCK], strict=True)], np.uint64)


def fingerprint_of(text: bytes, words: int) -> int:
    """The fingerprint of one text; 0 without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """Return the key as `doc_id` and `print`, the fingerprint's 64 bits as a long, for each row. A null text counts
    as empty, whose fingerprint is 0."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @resting
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        for batch in batches:
            for some in text_slices(batch):
                data, offsets = bytes_of(some.column("text"))
                found = [fingerprint_of(data[a:b].tobytes(), words) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "print"])

    return rows.mapInArrow(sign, "doc_id long, print long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(nodes: DataFrame, tables: list[int]) -> DataFrame:
    """bucket, used (the mask), print: a row for each node and table."""
    each = F.explode(F.array(*(F.lit(_signed(m)) for m in tables))).alias("used")
    return nodes.select("print", each).select(F.xxhash64("used", F.col("print").bitwiseAND(F.col("used"))).alias("bucket"), "used", "print")


def _split(rows: DataFrame, radius: int, known: list[int]) -> DataFrame:
    """Rows of large buckets, dealt to the buckets of masks over the bits that their table left out."""
    wider = [(_signed(u), [_signed(m) for m in masks([b for b in range(BITS) if not u >> b & 1], radius)]) for u in known]
    # As many rows as there are masks, whatever the table's size.
    further = F.broadcast(rows.sparkSession.createDataFrame(wider, "used long, more array<long>"))
    next_ = rows.join(further, "used").select("bucket", "used", "print", F.explode("more").alias("more"))
    # The bucket they come from stays part of the name.
    return next_.select(F.xxhash64("bucket", "more", F.col("print").bitwiseAND(F.col("more"))).alias("bucket"), F.col("used").bitwiseOR(F.col("more")).alias("used"), "print")


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between nodes within the radius that connect all that such pairs connect, without circles."""
    root, links = list(range(len(prints))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints) - 1):
        for j in (np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[y] = x
                links.append((i, j))
    return links


def _compare(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of small buckets, given as sorted lists `prints`."""

    @resting
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        for batch in batches:
            lists = batch.column("prints")
            at, flat = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
            begin, size = at[:-1], np.diff(at)
            two = begin[size == 2]
            near = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= radius]
            a, b = [flat[near]], [flat[near + 1]]
            for i in np.flatnonzero(size > 2).tolist():
                some = flat[at[i] : at[i + 1]]
                links = np.array(forest(some, radius), np.int64).reshape(-1, 2)
                a.append(some[links[:, 0]])
                b.append(some[links[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    return groups.mapInArrow(work, "a long, b long").distinct()


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct longs `print` that differ in at most `radius` bits: of each bucket a
    spanning forest, so that their components are those of all such pairs."""
    if bucket < 1 << radius:
        raise ValueError("a bucket must hold at least 2**radius nodes")
    rows, found = _keys(nodes, masks(list(range(BITS)), radius)), []
    while True:
        size = rows.groupBy("bucket").count().where("count > 1")
        # Spark takes a row and its explode for one row, so it would send the sizes of many more buckets to all tasks than a driver holds.
        held = saved(rows.join(size.hint("merge"), "bucket"), "held")
        small = held.where(F.col("count") <= bucket).groupBy("bucket").agg(F.sort_array(F.collect_set("print")).alias("prints"))
        # The same nodes meet in many tables; they are compared once.
        found.append(saved(_compare(small.select("prints").distinct(), radius), "links"))
        large = held.where(F.col("count") > bucket).select("bucket", "used", "print")
        known = [r["used"] & (1 << 64) - 1 for r in large.select("used").distinct().collect()]  # one of each table's masks
        if not known:
            return reduce(DataFrame.unionByName, found).distinct()
        rows = saved(_split(large, radius, sorted(known)), "tables")
        dropped(held)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Return doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable over links
    between fingerprints of at most `radius` different bits, itself included) for each row.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. A row with a null id is linked with
    nothing: component_id is null. Repeated rows give a row each, in one component. Where an id repeats with
    different texts, each row has its own text's fingerprint and component; components with one smallest id have one
    name. Texts are read whole, of any length; other columns are not read. An empty table gives no rows.
    """
    prints = saved(fingerprints(docs, key, text, words), "prints")
    nodes = saved(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(links(nodes.select("print"), radius)).toDF("print", "part")
    placed = saved(nodes.join(parts, "print", "left").withColumn("part", F.coalesce("part", "print")), "placed")
    names = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "part").select(F.col("print").alias("p"), "component_id")
    found = prints.join(named, (F.col("print") == F.col("p")) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
