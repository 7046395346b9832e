"""Vector functions."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _cosine(product: Column, squares: Column) -> Column:
    """From the inner product and the product of both squared lengths, -1 to 1. One root of the product, sums in order: the
    digits that DuckDB gives, so that near ties keep their order."""
    raw = product / F.sqrt(squares)
    return F.when(F.isnan(raw) | raw.between(-1.0, 1.0), raw).otherwise(F.signum(raw))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is null, empty or zero."""
    squares = dot(a, a) * dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (squares > 0), _cosine(dot(a, b), squares)).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity; 1 where a vector is zero."""
    return 1 - cosine_similarity(a, b)


def literal(vector: list[float]) -> Column:
    """A query vector as a constant, so that a search is a scan and not a join."""
    return F.array(*(F.lit(float(v)) for v in vector))


def query_similarity(column: Column, query: list[float]) -> Column:
    """Cosine with a constant vector: its length is worked out once, not for each row."""
    own = 0.0
    for v in query:
        own += float(v) * float(v)
    if not own:
        return F.lit(0.0)
    squares = dot(column, column) * own
    return F.when((F.size(column) == len(query)) & (squares > 0), _cosine(dot(column, literal(query)), squares)).otherwise(0.0)


def encode_vector(vector: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def decode_vector(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))


# Types as objects: a worker that imports this module has no session to parse a type with.
@F.pandas_udf(T.BinaryType())
def pack_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def hash_vector(text: str, dims: int = 128) -> list[float]:
    """A unit vector that depends on the text alone: SHA-256 of the text and a counter, as unsigned numbers."""
    blocks = b"".join(hashlib.sha256(text.encode() + struct.pack("<I", i)).digest() for i in range(-(-dims // 8)))
    raw = np.frombuffer(blocks, "<u4")[:dims].astype(float) / (2**31 - 1) - 1
    return (raw / np.sqrt(np.sum(raw * raw))).tolist()


def hash_embedding(dims: int = 128):
    """hash_vector as a column function, for embedding without a model."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: None if t is None else hash_vector(t, dims))

    return embed
