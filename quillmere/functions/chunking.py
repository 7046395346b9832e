"""Recursive splitting of texts into chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import by_pieces
from .text import token_estimate

#: Separators from coarse to fine, and the default sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 512, 50


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs; pieces that are still too long are split by the finer ones.
    Neighbouring short pieces are joined up to `size`, each chunk taking up to `overlap` characters of the one
    before. Chunks are trimmed and never empty."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    chunks: list[str] = []
    short: list[str] = []
    for piece in text.split(separator) if separator else list(text):
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _joined(short, separator, size, overlap)
        short = []
        chunks += split_text(piece, size, overlap, finer) if finer else [piece]
    return chunks + _joined(short, separator, size, overlap)


def _joined(pieces: list[str], separator: str, size: int, overlap: int) -> list[str]:
    out, run, length = [], [], 0
    for piece in pieces:
        more = len(piece) + (len(separator) if run else 0)
        if run and length + more > size:
            out.append(separator.join(run).strip())
            while run and (length > overlap or length + len(piece) + len(separator) > size):
                length -= len(run.pop(0)) + (len(separator) if run else 0)
            more = len(piece) + (len(separator) if run else 0)
        run.append(piece)
        length += more
    out.append(separator.join(run).strip())
    return [c for c in out if c]


def chunk(docs: DataFrame, key: str = "id", text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, doc_id, chunk_index, content, token_count, metadata: a row for each chunk, indices from 0. Null and
    blank texts have no chunks."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return by_pieces(lambda t: split_text(t, size, overlap) if t else [], pa.list_(pa.string()), texts)

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(split(F.col(text))).alias("chunk_index", "content"))
    return rows.select(F.sha2(F.concat_ws("\0", "doc_id", F.col("chunk_index").cast("string"), "content"), 256).alias("id"), "doc_id", "chunk_index", "content", token_estimate(F.col("content")).alias("token_count"), F.lit(None).cast("string").alias("metadata"))
