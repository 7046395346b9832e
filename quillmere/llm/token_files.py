"""Token-id files in a word-aligned code of the Simple-8b family.

Ids are coded in blocks of BLOCK ids. Every 64-bit word has a 4-bit selector on top and 60 bits of ids:

    selector   1   2   3   4   5   6  7  8  9 10 11 12 13
    ids       60  30  20  15  12  10  8  7  6  5  4  3  2     bits each: 60 // ids

Selector 0 is the escape: its 60 bits hold one id of any size. A word that ends a block may stand for
fewer ids than its selector says; the block's count tells. A file is

    8 bytes  b"QMS8B\\x00\\x01\\n"
    4 int64  documents, ids, blocks, words
    int64    key of each document, then int8 1 where the key is null
    int64    first id of each document in this file, one more at the end
    int64    first word of each block, one more at the end
    uint64   the words
    uint32   crc32 of all before

All numbers are little-endian. The table of blocks lets a reader decode all blocks, or any of them, in a
few vector operations. Files are written in ascending key order; their names sort in that order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import make_folder, resting, saved, text_slices
from .files import write_file
from .tokens import word_cache

MAGIC = b"QMS8B\x00\x01\n"
BLOCK = 1024
#: Fixed values of the code: ids in a word for each selector (0: escape).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
WIDTHS = 60 // COUNTS
#: A file is closed once it holds so many ids (about 20 MB).
FILE_IDS = 8_000_000
#: Encoded pieces that a task keeps, twice at most (about 600 bytes each); nothing else runs beside it.
ROOM = 200_000
#: Texts encoded at once hold about so many bytes: the more, the fewer lookups of the same word.
SLICE_BYTES = 1 << 23


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block with one more at the end."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    words, firsts = [], [0]
    step = BLOCK * 256
    for begin in range(0, len(ids), step):
        w, per_block = _pack_blocks(ids[begin : begin + step].astype(np.int64))
        words.append(w)
        firsts += (firsts[-1] + np.cumsum(per_block)).tolist()
    return np.concatenate(words), np.array(firsts, np.int64)


def _pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = -(-len(ids) // BLOCK)
    grid = np.zeros((n, BLOCK + 60), np.int64)
    grid[:, :BLOCK].ravel()  # blocks are rows, with zeros to their right
    padded = np.zeros(n * BLOCK, np.int64)
    padded[: len(ids)] = ids
    grid[:, :BLOCK] = padded.reshape(n, BLOCK)
    size = np.full(n, BLOCK)
    size[-1] = len(ids) - (n - 1) * BLOCK
    best = np.zeros((n, BLOCK), np.int8)
    for s in range(13, 0, -1):  # from few ids to many: the largest count that fits stays
        too_big = np.zeros((n, BLOCK + 61), np.int32)
        np.cumsum(grid >> WIDTHS[s] > 0, axis=1, out=too_big[:, 1:])
        fits = too_big[:, COUNTS[s] : COUNTS[s] + BLOCK] == too_big[:, :BLOCK]
        best[fits] = s
    at = np.zeros(n, np.int64)
    rows, starts, chosen = [], [], []
    live = np.arange(n)
    while len(live):
        s = best[live, at[live]]
        rows.append(live)
        starts.append(at[live])
        chosen.append(s)
        at[live] += COUNTS[s]
        live = live[at[live] < size[live]]
    row, start, sel = map(np.concatenate, (rows, starts, chosen))
    order = np.lexsort((start, row))
    row, start, sel = row[order], start[order], sel[order].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        for k in range(COUNTS[s]):
            words[mine] |= grid[row[mine], start[mine] + k].astype(np.uint64) << np.uint64(WIDTHS[s] * k)
    return words, np.bincount(row, minlength=n)


def unpack(words: np.ndarray, firsts: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of a file."""
    out = np.zeros(n_ids + 60, np.uint32)
    if not n_ids:
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    start = before - before[firsts[:-1]][block] + block * BLOCK
    stop = np.minimum(start + counts, np.minimum((block + 1) * BLOCK, n_ids))
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            inside = mine[start[mine] + k < stop[mine]]
            out[start[inside] + k] = (words[inside] >> np.uint64(WIDTHS[s] * k)) & mask
    return out[:n_ids]


def to_bytes(keys: list[int | None], texts_ids: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(texts_ids), "<u4")
    words, firsts = pack(ids)
    starts = np.cumsum([0, *(len(b) // 4 for b in texts_ids)])
    head = struct.pack("<4q", len(keys), len(ids), len(firsts) - 1, len(words))
    parts = [MAGIC, head, np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], np.int8).tobytes(), starts.astype("<i8").tobytes(), firsts.astype("<i8").tobytes(), words.astype("<u8").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, starts (one more at the end) and ids."""
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("no token file, or a damaged one")
    docs, n_ids, blocks, n_words = struct.unpack_from("<4q", data, 8)
    at = 40
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, np.int8, docs, at + 8 * docs)
    at += 9 * docs
    starts = np.frombuffer(data, "<i8", docs + 1, at)
    at += 8 * (docs + 1)
    firsts = np.frombuffer(data, "<i8", blocks + 1, at)
    at += 8 * (blocks + 1)
    words = np.frombuffer(data, "<u8", n_words, at)
    return [None if z else k for k, z in zip(keys, null, strict=True)], starts, unpack(words, firsts, n_ids)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append end_id to each, write files to `folder`; return the table of files:
    file, part, seq, n_docs, n_ids, n_bytes.

    Documents stand in ascending key order, null keys first; ties by the text's hash and the text. A null
    text counts as empty. Files hold whole documents, so that one long document can make a file longer.
    A task that runs again writes the same files again. Without rows there are no files, and reading gives
    no rows. Other columns are not read.
    """
    make_folder(docs.sparkSession, folder)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seq = word_cache(tokenizer, ROOM), TaskContext.get().partitionId(), 0
        keys, coded, held, made = [], [], 0, []

        def close():
            nonlocal keys, coded, held, seq
            if keys:
                name = f"{folder}/tokens-{part:06d}-{seq:06d}.s8b"
                data = to_bytes(keys, coded)
                write_file(name, data)
                made.append((name, part, seq, len(keys), held, len(data)))
                keys, coded, held, seq = [], [], 0, seq + 1

        for batch in batches:
            for some in text_slices(batch, limit=SLICE_BYTES):
                for k, ids in zip(some.column("doc_id").to_pylist(), cache.encode_array(some.column("text")), strict=True):
                    keys.append(k)
                    coded.append(ids + end)
                    held += len(ids) // 4 + len(end) // 4
                    if held >= file_ids:
                        close()
        close()
        names = ["file", "part", "seq", "n_docs", "n_ids", "n_bytes"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)], names=names)

    return saved(dealt.mapInArrow(write, "file string, part int, seq int, n_docs long, n_ids long, n_bytes long"), "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32-bit). `files` is the table that write_tokens returned. Its running sum is taken by part, then
    over the parts: a row a task that wrote, which one task can add up."""
    before = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("first"))
    within = files.select("part", F.element_at(F.split("file", "/"), -1).alias("name"), before(Window.partitionBy("part").orderBy("seq")).alias("more"))
    bases = within.join(parts, "part").select("name", (F.col("first") + F.col("more")).alias("base"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    @resting
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, starts, ids = from_bytes(batch.column("content")[i].as_py())
                base, data = batch.column("base")[i].as_py(), ids.astype("<u4").tobytes()
                for a in range(0, len(keys), 512):
                    b = min(a + 512, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b], pa.int64()), pa.array(starts[a:b] + base, pa.int64()), pa.array(np.diff(starts[a : b + 1]), pa.int64()), pa.array([data[4 * x : 4 * y] for x, y in zip(starts[a:b], starts[a + 1 : b + 1], strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return raw.join(bases, "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
