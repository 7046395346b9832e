"""YAML frontmatter of notes."""

from __future__ import annotations

import pyarrow as pa
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import by_pieces


class FrontmatterError(ValueError):
    """The block is there but is no YAML mapping."""


def parse(text: str) -> tuple[dict, str]:
    """Mapping and body. A block runs from a first line `---` to the next such line (blanks at the end of either
    do not matter); without a first or a closing line all is body."""
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].rstrip() != "---":
        return {}, text
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            try:
                found = yaml.safe_load("".join(lines[1:i]))
            except yaml.YAMLError as e:
                raise FrontmatterError(str(e)) from e
            if found is not None and not isinstance(found, dict):
                raise FrontmatterError("not a mapping")
            return found or {}, "".join(lines[i + 1 :])
    return {}, text


def encode(data: dict, body: str) -> str:
    """The inverse: without data, the body alone."""
    return f"---\n{yaml.safe_dump(data, sort_keys=True, allow_unicode=True)}---\n{body}" if data else body


def string_list(value: object) -> list[str]:
    if value is None:
        return []
    return [str(v) for v in value if v is not None] if isinstance(value, list | tuple) else [str(value)]


_TEXT = T.StringType()
#: Types as objects: a worker that imports this module has no session to parse a type with.
_PARSED = T.StructType([T.StructField("frontmatter", T.MapType(_TEXT, _TEXT)), T.StructField("body", _TEXT), T.StructField("author", _TEXT), T.StructField("tags", T.ArrayType(_TEXT)), T.StructField("created", _TEXT), T.StructField("updated", _TEXT), T.StructField("error", _TEXT)])


_STRING = pa.string()
_ARROW = pa.struct([("frontmatter", pa.map_(_STRING, _STRING)), ("body", _STRING), ("author", _STRING), ("tags", pa.list_(_STRING)), ("created", _STRING), ("updated", _STRING), ("error", _STRING)])


def _row(text: str | None) -> dict:
    try:
        data, body = parse(text or "")
    except FrontmatterError as e:
        return {"frontmatter": [], "body": text, "tags": [], "error": str(e)[:200]}
    return {"frontmatter": list({str(k): _plain(v) for k, v in data.items()}.items()), "body": body, "author": _plain(data.get("author")), "tags": string_list(data.get("tags")), "created": _plain(data.get("created_at")), "updated": _plain(data.get("updated_at"))}


@F.arrow_udf(_PARSED)
def parsed(notes: pa.Array) -> pa.Array:
    return by_pieces(_row, _ARROW, notes)


def _plain(value: object) -> str | None:
    if value is None:
        return None
    return value.isoformat() if hasattr(value, "isoformat") else yaml.safe_dump(value, default_flow_style=True).strip() if isinstance(value, dict | list) else str(value)
