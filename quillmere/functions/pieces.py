"""Texts of an Arrow batch worked on in pieces, so that a task holds few of them as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task holds as Python objects at a time.
PIECE = 1 << 20


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[slice]:
    """Places of runs of about `limit` bytes; one long text is a run of its own."""
    begin = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and held + size > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if len(texts):
        yield slice(begin, len(texts))


def by_pieces(work: Callable, kind: pa.DataType, texts: pa.Array, *others: pa.Array) -> pa.Array:
    """work(text, *others) of each row as an Arrow array."""
    out = []
    for at in pieces(texts):
        columns = [a.slice(at.start, at.stop - at.start).to_pylist() for a in (texts, *others)]
        out.append(pa.array([work(*row) for row in zip(*columns, strict=True)], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)
