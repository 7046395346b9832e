"""BPE encoding and decoding, with tree concatenation of long texts.

A text of up to `piece_chars` characters is encoded in the task that reads it. A longer one is cut into
pieces that are dealt over the cluster and encoded there. Most cuts lie where the vocabulary's own rule
always splits (a character that is no blank, then a blank), so the ids of both sides simply follow each
other. Where a stretch has no such place, the cut goes between characters of different kinds, or through an
unbroken run of letters, digits, signs or blanks; then the sides are joined pairwise, as in a tree: a window of
ids around the join is encoded again and grown until its first ids agree with the left side and its last ids with
the right side. So every text of more than `piece_chars` characters is cut.

Defined results: a null text counts as empty, with no ids; rows repeated under one key give a row each;
only the key and the text are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import resting, saved, text_slices
from .tokens import FEW_PIECES, byte_decoder, trim_caches, word_cache

PIECE_CHARS = 16_384
#: Ids that must agree on each side of a window.
AGREE = 2

_RUN = regex.compile(
    r"(?<=[A-Za-z]{3})(?=[A-Za-z]{3})|(?<=[0-9]{3})(?=[0-9]{3})|(?<=\p{L}{3})(?=\p{L}{3})|(?<=\p{N}{3})(?=\p{N}{3})"
    r"|(?<=[^\s\p{L}\p{N}']{3})(?=[^\s\p{L}\p{N}']{3})|(?<='{3})(?='{3})|(?<=\s{3})(?=\s{3})"
    # Signs and apostrophes in turn: no letter is near, so no contraction is cut.
    r"|(?<=[^\s\p{L}\p{N}]{3})(?=[^\s\p{L}\p{N}]{3})"
)
#: A blank after a sign or letter of ASCII, of any kind; and any other change of kind but those at which the
#: vocabulary's rule may not split (a blank or an apostrophe, then a letter or sign).
_BLANK = regex.compile(r"(?<=[!-~])(?=[ \t\n\r])")
_KIND = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")
_CHANGE = regex.compile(r"(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])")


def cut_text(text: str, size: int, special: list[str]) -> list[tuple[str, bool]]:
    """Pieces of about `size` characters, each with whether its join to the piece before runs through a run."""
    out, begin, fused = [], 0, False
    while len(text) - begin > size:
        at, through = _cut(text, begin + max(1, size // 2), begin + size, special)
        if at is None:
            break
        out.append((text[begin:at], fused))
        begin, fused = at, through
    out.append((text[begin:], fused))
    return out


def _cut(text: str, low: int, high: int, special: list[str]) -> tuple[int | None, bool]:
    while low < len(text):
        at = text.rfind(" ", low, high)
        while at > low:
            if "!" <= text[at - 1] <= "~":
                return at, False
            at = text.rfind(" ", low, at)
        for rule, through in ((_BLANK, False), (_CHANGE, False), (_RUN, True), (_KIND, True)):
            for m in rule.finditer(text, low - 3, min(len(text), high + 3)):
                at = m.start()
                if low <= at < len(text) and not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in special):
                    return at, through
        low, high = high, high + (high - low)
    return None, False


def _char_start(table, i: int) -> bool:
    """Whether the token begins a UTF-8 character."""
    first = table.data[table.starts[i]] if table.lengths[i] else 0
    return not 0x80 <= first < 0xC0


def fuse(left: np.ndarray, right: np.ndarray, encode: Callable[[str], np.ndarray], table) -> np.ndarray:
    """Ids of the joined text, from the ids of two sides cut inside a run."""
    width = 8
    while True:
        i, j = max(0, len(left) - width), min(len(right), width)
        while i > 0 and not _char_start(table, left[i]):
            i -= 1
        while j < len(right) and not _char_start(table, right[j]):
            j += 1
        window = table.decode(np.concatenate([left[i:], right[:j]])).decode()
        found = encode(window)
        same_left = i == 0 or np.array_equal(found[:AGREE], left[i : i + AGREE])
        same_right = j == len(right) or np.array_equal(found[-AGREE:], right[j - AGREE : j])
        if same_left and same_right:
            return np.concatenate([left[:i], found, right[j:]])
        width *= 2


def join_tree(parts: list[np.ndarray], fused: list[bool], encode: Callable[[str], np.ndarray], table) -> np.ndarray:
    """Join neighbours pairwise, level by level."""
    while len(parts) > 1:
        next_parts, next_fused = [], []
        for k in range(0, len(parts) - 1, 2):
            a, b = parts[k], parts[k + 1]
            next_parts.append(fuse(a, b, encode, table) if fused[k + 1] and len(a) and len(b) else np.concatenate([a, b]))
            next_fused.append(fused[k])
        if len(parts) % 2:
            next_parts.append(parts[-1])
            next_fused.append(fused[-1])
        parts, fused = next_parts, next_fused
    return parts[0]


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Return the key as `doc_id` and `ids` (binary: little-endian unsigned 32-bit ids) for each row."""
    # A character has at most 2 UTF-16 units; char_length counts code points, as Python does.
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    @resting
    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer, FEW_PIECES)
        for batch in batches:
            for rows in text_slices(batch):
                at = rows.schema.get_field_index("text")
                ids = pa.array(cache.encode(rows.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(rows.columns) if i != at), ids], names=[*(n for n in rows.schema.names if n != "text"), "ids"])

    short = rows.where(F.char_length("text") <= piece_chars).mapInArrow(encode_rows, f"doc_id {kind}, ids binary")
    long = rows.where(F.char_length("text") > piece_chars).withColumn("row", F.monotonically_increasing_id())

    @resting
    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = word_cache(tokenizer).special
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                pieces = cut_text(one.column("text")[0].as_py(), piece_chars, special)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.column("doc_id").to_pylist() * n, one.column("doc_id").type), pa.array(one.column("row").to_pylist() * n), pa.array(range(n), pa.int32()), pa.array([f for _, f in pieces]), pa.array([t for t, _ in pieces])],
                    names=["doc_id", "row", "piece", "fused", "text"],
                )

    # Written first: a row's number holds good however often a lost executor's tasks run again.
    cut = saved(long.mapInArrow(cut_rows, f"doc_id {kind}, row long, piece int, fused boolean, text string"), "pieces")
    pieces = cut.repartition("row", "piece")
    coded = pieces.mapInArrow(encode_rows, f"doc_id {kind}, row long, piece int, fused boolean, ids binary")

    def join_pieces(table: pa.Table) -> pa.Table:
        cache, bytes_table = word_cache(tokenizer), byte_decoder(tokenizer)
        table = table.sort_by("piece")
        parts = [np.frombuffer(b, "<u4") for b in table.column("ids").to_pylist()]
        ids = join_tree(parts, table.column("fused").to_pylist(), lambda t: np.frombuffer(cache.encode([t])[0], "<u4"), bytes_table)
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    joined = coded.groupBy("row").applyInArrow(join_pieces, f"doc_id {kind}, ids binary")
    return short.unionByName(joined)


def decode(coded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Return the key as `doc_id`, `ids`, and `decoded`: the text, with U+FFFD for bytes that are no UTF-8."""
    rows = coded.select(F.col(key).alias("doc_id"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    @resting
    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches()
        table = byte_decoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "ids"):
                texts = [table.decode(np.frombuffer(b, "<u4")).decode("utf-8", "replace") for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(decode_rows, f"doc_id {kind}, ids binary, decoded string")
