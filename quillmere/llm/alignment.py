"""Alignment of the tokens of two tokenizers, worked out once for each distinct segment of the corpus.

A is a byte-level BPE of the tokenizers library, over a space and the text; B is a sentencepiece BPE, over the text, which
puts that space before it. Places where a token of A and one of B both end cut a text into groups; the two tokens
that end there are a link.

1. Texts are split before each run of blanks that begins with a space and follows a character that is no white space.
   Neither tokenizer has a token across such a place: A's rule splits there before it merges, and none of B's
   pieces has its space mark after another character (`cuts` reads that from both files; where it does not hold,
   a text is one segment). The second tokenizer's own space before a text stands for each segment's first one.
2. Texts go in blocks of a bounded size. A block keeps its distinct segments, with how often they occur, and each text as
   a list of numbers of these segments. Blocks are written before they are numbered in any other table.
3. Segments distinct over all blocks are tokenised and aligned once each, and keep the places that they have in blocks.
4. A text with a segment whose bytes a tokenizer does not give back has no tokens. Its segments are taken off the
   counts, so a pair of ids is counted once for each link of the texts that have tokens.
5. Counts, and the highest of each B id, come from segments times their occurrences; so do each segment's sums.
6. Alignments go back to their places, those of a block together and compressed, and each block composes its texts.

What is shuffled grows with the distinct segments of blocks, once on their way out and once back, and, once, with the
lists of numbers, never with the links. The way back and the lists go as compressed bytes, not as rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bytes_of, resting, saved, scratch, sent, text_slices
from .tokens import ByteDecoder, load_tokenizer, trim_caches

#: Characters of text in a block, about; a longer text ends its block.
BLOCK_BYTES = 32 << 20
#: A segment's place is its block's number, then its own in the block; blocks have their task's, then their own.
CODE_BITS, BLOCKS_BITS = 28, 12
#: Places, and bytes, of aligned segments that a task holds before it packs them for their blocks, about.
PACK_PLACES, PACK_BYTES = 1 << 19, 32 << 20
MARK = "▁"
#: A space after anything but white space, as any of the libraries' rules understands that.
_SPLIT = re.compile("(?<=[^\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]) ")


class _Bytes:
    """The bytes of a vocabulary's entries, for many ids at once."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()


class _Pair:
    """Both tokenizers, loaded in a worker."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = load_tokenizer(a)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        decoder = ByteDecoder(a)
        self.a_bytes = _Bytes([decoder.data[i : i + n].tobytes() for i, n in zip(decoder.starts.tolist(), decoder.lengths.tolist(), strict=True)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = _Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])

    def align(self, texts: list[str]) -> dict[str, list]:
        """For each text: whether both give its bytes back, tokens of A and of B, the links' ids, the groups' text; all
        texts at once, for where both do, their bytes one after the other end at the same places."""
        ids_a = [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        # A segment that is a text's last space alone; an empty text by itself would be given no space.
        ids_b = [ids if t else [self.b.piece_to_id(MARK)] for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]
        wholes = [b" " + t.encode() for t in texts]
        flat = lambda lists: np.fromiter(itertools.chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        joined = b"".join(wholes)
        valid = np.ones(len(texts), bool)
        if self.a_bytes.of(flat(ids_a)) != joined or self.b_bytes.of(flat(ids_b)) != joined:
            valid = np.array([self.a_bytes.of(np.array(x, np.int64)) == w == self.b_bytes.of(np.array(y, np.int64)) for x, y, w in zip(ids_a, ids_b, wholes, strict=True)])
            ids_a, ids_b = ([ids if v else [] for ids, v in zip(lists, valid, strict=True)] for lists in (ids_a, ids_b))
        a, b = flat(ids_a), flat(ids_b)
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        ends_a, ends_b = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        meets = np.minimum(np.searchsorted(ends_b, ends_a), max(len(b) - 1, 0))
        at_a = np.flatnonzero(ends_b[meets] == ends_a) if len(b) else np.zeros(0, np.int64)
        at_b = meets[at_a]
        says_a, says_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append((says_a[i] if x == i + 1 else ",".join(says_a[i:x])) + "|" + (says_b[j] if y == j + 1 else ",".join(says_b[j:y])))
            i, j = x, y
        # A text's last tokens end together, so each text has its own groups.
        ends = np.searchsorted(at_a, np.cumsum(n_a)).tolist()
        said = [";".join(groups[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
        lists = lambda ids: pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32)))
        return {"valid": pa.array(valid), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "ids_a": lists(a[at_a]), "ids_b": lists(b[at_b]), "groups": pa.array(said, pa.string())}


@functools.lru_cache(maxsize=1)
def _pair(a: str, b: str) -> _Pair:
    return _Pair(a, b)


def _forget() -> None:
    """Workers are handed on to tasks that need no tokenizer."""
    _pair.cache_clear()
    trim_caches(tokenizers=True)


def cuts(a: str, b: str) -> bool:
    """Whether a text may be split before a space that follows a character that is no white space."""
    import sentencepiece

    with open(a, encoding="utf-8") as f:
        spec = json.load(f)
    rule = spec.get("pre_tokenizer") or {}
    splits = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and spec.get("normalizer") is None
    model = sentencepiece.SentencePieceProcessor(model_file=b)
    pieces = [model.id_to_piece(i) for i in range(len(model))]
    own = not any(MARK in p.lstrip(MARK) for p in pieces) and not any(model.is_unused(i) for i in range(len(model)))
    # A space put before each segment, no spaces lost or changed.
    kept = ["".join(model.id_to_piece(i) for i in model.encode(t)).replace(MARK, " ") for t in ("x", " x", "  x  ")]
    return bool(splits and own and kept == [" x", "  x", "   x  "])


def segments(text: str, split: bool = True) -> list[str]:
    """The text's segments, each without the space before it."""
    return _SPLIT.split(text) if split else [text]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed as all their lowest bytes, then all the next: most of the higher ones are zero."""
    return zstandard.compress(np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _blocks(docs: DataFrame, split: bool, block_bytes: int) -> DataFrame:
    """(block, doc_ids, sizes, codes, words): a row for each slice of texts, with how many segments each has and all of these
    as packed 32-bit numbers in the block's own list; and one for each block with that list, words (segment, n), and
    nothing else. Blocks are numbered as they are written."""

    @resting
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        names = ["block", "doc_ids", "sizes", "codes", "words"]
        block, held, known, counts = TaskContext.get().partitionId() << BLOCKS_BITS, 0, {}, np.zeros(0, np.int64)
        kind = pa.list_(pa.struct([("segment", pa.string()), ("n", pa.int64())]))

        def listed() -> pa.RecordBatch:
            each = pa.StructArray.from_arrays([pa.array(list(known), pa.string()), pa.array(counts)], names=["segment", "n"])
            words = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), each)
            none = [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, words], names=names)

        for batch in batches:
            for some in text_slices(batch, limit=min(block_bytes, 1 << 21)):
                coded = []
                for text in some.column("text").to_pylist():
                    own = segments(text, split) if text else []
                    coded.append(np.array([known.setdefault(s, len(known)) for s in own], "<u4"))
                    held += len(text)
                codes = np.concatenate(coded)
                more = np.bincount(codes, minlength=len(known)).astype(np.int64)
                more[: len(counts)] += counts
                counts = more
                of = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                sizes = pa.array([len(c) for c in coded], pa.int32())
                rows = [pa.array([block], pa.int64()), of(some.column("doc_id")), of(sizes), pa.array([packed(codes)], pa.binary()), pa.nulls(1, kind)]
                yield pa.RecordBatch.from_arrays(rows, names=names)
                if held >= block_bytes:
                    yield listed()
                    block, held, known, counts = block + 1, 0, {}, np.zeros(0, np.int64)
        if held:
            yield listed()

    return docs.mapInArrow(code, "block long, doc_ids array<long>, sizes array<int>, codes binary, words array<struct<segment:string,n:long>>")


def _texts(sizes: pa.ListScalar, codes: pa.BinaryScalar) -> list[np.ndarray]:
    """The texts of a slice, as numbers of segments."""
    return np.split(unpacked(codes.as_py(), "<u4"), np.cumsum(sizes.values.to_numpy())[:-1])


def _align(segments_: DataFrame, a: str, b: str) -> DataFrame:
    @resting
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        for batch in batches:
            for some in text_slices(batch, "segment", 1 << 18):
                found = _pair(a, b).align(some.column("segment").to_pylist())
                given = ["segment", "n", "places"]
                yield pa.RecordBatch.from_arrays([*map(some.column, given), *found.values()], names=[*given, *found])

    return segments_.mapInArrow(work, "segment string, n long, places array<long>, valid boolean, n_a long, n_b long, ids_a array<int>, ids_b array<int>, groups string")


def _block(place: str) -> Column:
    return F.shiftright(place, CODE_BITS)


def _lost(coded: DataFrame, aligned: DataFrame) -> DataFrame:
    """(segment, lost): how often segments occur in texts that hold one whose bytes are not given back."""
    placed = lambda rows: rows.select("segment", F.explode("places").alias("place"))
    code = F.col("place").bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    marked = placed(aligned.where("not valid")).groupBy(_block("place").alias("block")).agg(F.collect_list(code).alias("bad"))

    @resting
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bad = batch.column("bad")[i].values.to_numpy()
                texts = [t for t in _texts(batch.column("sizes")[i], batch.column("codes")[i]) if np.isin(t, bad).any()]
                if texts:
                    found, n = np.unique(np.concatenate(texts), return_counts=True)
                    places = (batch.column("block")[i].as_py() << CODE_BITS) + found.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(n.astype(np.int64))], names=["place", "lost"])

    found = coded.select("block", "sizes", "codes").join(sent(marked), "block").mapInArrow(count, "place long, lost long")
    lost = saved(found.groupBy("place").agg(F.sum("lost").alias("lost")), "lost")
    return placed(aligned).join(sent(lost), "place").groupBy("segment").agg(F.sum("lost").alias("lost"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links have these ids, over all texts with tokens, and whether no A id has more
    links with this B id."""
    links = aligned.where("valid and n > 0").select("n", F.explode(F.arrays_zip("ids_a", "ids_b")).alias("l"))
    counts = saved(links.groupBy(F.col("l.ids_a").alias("a"), F.col("l.ids_b").alias("b")).agg(F.sum("n").alias("count")), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Return a row for each row of `docs` and the table of pairs of ids (a, b, count, best).

    Rows have doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair has its B id's highest count, ties
    included), count_sum (over links, the pair's count) and groups_sha256 (lower-case hexadecimal SHA-256 of
    `a1,a2|b1;a3|b2,b3`).

    A text that is null, empty, or whose bytes a tokenizer does not give back (the mark that B writes for a space,
    for one) has no tokens: zeros, and an empty groups_sha256. Repeated rows, and rows with a null or repeated id, are
    texts of their own and count once each. Texts are read whole, of any length; a text without spaces is one
    segment. An empty table gives no rows and no pairs. Other columns are not read.
    """
    split = cuts(a, b)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    written = _kept(_blocks(rows, split, block_bytes), "coded")
    coded = written.where("codes is not null").select("block", "doc_ids", "sizes", "codes")
    lists = written.where("words is not null").select(F.shiftleft("block", CODE_BITS).alias("first"), F.posexplode("words").alias("code", "w"))
    words = lists.select((F.col("first") + F.col("code")).alias("place"), "w.segment", "w.n").repartition("segment")
    distinct = words.groupBy("segment").agg(F.sum("n").alias("n"), F.collect_list("place").alias("places"))
    aligned = _kept(_align(distinct, a, b), "aligned", by="segment")

    counted = aligned.select("segment", "n", "valid", "ids_a", "ids_b")
    if not aligned.where("not valid").isEmpty():
        less = _lost(coded, aligned)
        counted = counted.join(less, "segment", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0)))
    pairs = saved(pair_counts(counted), "counts")
    links = aligned.where("valid").select("segment", F.explode(F.arrays_zip("ids_a", "ids_b")).alias("l")).select("segment", F.col("l.ids_a").alias("a"), F.col("l.ids_b").alias("b"))
    # By segment, as the aligned segments lie already.
    sums = links.join(sent(pairs), ["a", "b"]).groupBy("segment").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    facts = aligned.select("segment", "groups", "n_a", "places").join(sums, "segment", "left").select("groups", "n_a", "n_best", "count_sum", "places")
    return _compose(coded, _placed(facts)), pairs


def _kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Written and read back, compressed well for its size on disk; in buckets of `by`, by which it is dealt already, so that
    joins on it need not move it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"aligned_{uuid.uuid4().hex}"
    writer.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(table)
    return spark.table(table)


#: What a block is told of a segment, beside its number and the size of its groups' text.
_TOLD = ["n_a", "n_best", "count_sum"]


def _placed(facts: DataFrame) -> DataFrame:
    """(block, numbers, groups): of some of a block's segments, in ascending order, the numbers and the groups' text."""

    @resting
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        held: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists, texts = rows.column("places").combine_chunks(), rows.column("groups").combine_chunks()
            places, parents = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
            told = [rows.column(name).fill_null(0).to_numpy() for name in _TOLD]
            order = np.argsort(places)
            places, parents = places[order], parents[order]
            firsts = np.flatnonzero(np.diff(places >> CODE_BITS, prepend=-1))
            for i, j in itertools.pairwise([*firsts.tolist(), len(places)]):
                own = parents[i:j]
                data, offsets = bytes_of(texts.take(pa.array(own)))
                codes = places[i:j] & ((1 << CODE_BITS) - 1)
                numbers = np.stack([np.diff(codes, prepend=0), np.diff(offsets), *(t[own] for t in told)]).astype("<i8")
                values = [[int(places[i]) >> CODE_BITS], [packed(numbers)], [zstandard.compress(data.tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "numbers", "groups"])

        n = size = 0
        for batch in batches:
            held.append(batch)
            n, size = n + len(batch.column("places").flatten()), size + batch.nbytes
            if n >= PACK_PLACES or size >= PACK_BYTES:
                yield from blocks()
                held, n, size = [], 0, 0
        if n:
            yield from blocks()

    return facts.mapInArrow(pack, "block long, numbers binary, groups binary")


def _compose(coded: DataFrame, placed: DataFrame) -> DataFrame:
    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        _forget()
        parts = [unpacked(p.as_py(), "<i8").reshape(2 + len(_TOLD), -1) for p in right.column("numbers")]
        numbers = np.concatenate([np.zeros((2 + len(_TOLD), 0), np.int64), *parts], axis=1)
        order = np.argsort(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[0]) for p in parts)]))
        data = b"".join([zstandard.decompress(g.as_py()) for g in right.column("groups")])
        ends = pa.py_buffer(np.concatenate([[0], np.cumsum(numbers[1])]).astype(np.int64))
        texts = pa.Array.from_buffers(pa.large_binary(), len(order), [None, ends, pa.py_buffer(data)]).take(pa.array(order))
        del data, ends, parts
        _, sizes, n_a, n_best, count_sum = numbers[:, order]
        valid, groups = sizes > 0, texts.to_pylist()
        n_links = np.where(valid, pc.count_substring(texts, ";").to_numpy() + 1, 0)
        # A group's text has a comma between the ids of each side.
        n_b = np.where(valid, pc.count_substring(texts, ",").to_numpy() + 2 * n_links - n_a, 0)
        del texts
        numbers = np.stack([n_a, n_b, n_links, n_best, count_sum])
        every = [codes for row in zip(left.column("sizes"), left.column("codes"), strict=True) for codes in _texts(*row)]
        sums, digests = np.zeros((len(every), 5), np.int64), []
        for i, codes in enumerate(every):
            if not len(codes) or not valid[codes].all():
                digests.append("")
                continue
            sums[i] = numbers[:, codes].sum(axis=1)
            digest = hashlib.sha256()
            for first in range(0, len(codes), 1 << 16):
                digest.update(b";" * bool(first) + b";".join([groups[c] for c in codes[first : first + (1 << 16)].tolist()]))
            digests.append(digest.hexdigest())
        doc_ids = pa.concat_arrays([pa.array([], pa.int64()), *(row.values for row in left.column("doc_ids"))])
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        columns = dict(zip(names, (sums[:, k] for k in (0, 1, 2, 2, 3, 4)), strict=True))
        return pa.table({"doc_id": doc_ids, **columns, "groups_sha256": pa.array(digests, pa.string())})

    both = coded.groupBy("block").cogroup(placed.groupBy("block"))
    return both.applyInArrow(compose, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
