"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of a wikilink, slug characters, limits.
WIKILINK = r"\[\[([^\]\|]+?)(?:\|[^\]]*)?\]\]"
SLUG_MAX, KEY_MAX_BYTES, MESSAGE_MAX_BYTES = 200, 512, 8192


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("int")


def token_usage(prompt: Column, response: Column) -> Column:
    """A quarter of the bytes of prompt and response, rounded down."""
    return F.floor((F.octet_length(prompt) + F.octet_length(response)) / 4).cast("int")


def content_hash(content: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(content, 256)


def normalise_name(name: Column) -> Column:
    """Trimmed, lower case, white space runs as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), r"\s+", " ")


def normalise_predicate(predicate: Column) -> Column:
    return F.regexp_replace(F.lower(predicate), r"^\s+|\s+$", "")


def normalise_tags(tags: Column) -> Column:
    """Lower case, trimmed, empty ones dropped, first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(F.lower(t))), lambda t: t.isNotNull() & (t != "")))


def canonical_or_id(canonical_id: Column, id_: Column) -> Column:
    return F.coalesce(F.when(canonical_id != "", canonical_id), id_)


def wikilinks(body: Column) -> Column:
    """Distinct link targets in order of first appearance; blank targets dropped."""
    found = F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), 1), lambda t: F.trim(t))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def parse_wikilink(target: Column) -> Column:
    """struct(target, project, key, cross_project): `projects/<slug>/<key>` links to another project's note."""
    pattern = r"^projects/([a-zA-Z0-9_-]+)/(.+)$"
    cross = target.rlike(pattern)
    return F.struct(
        target.alias("target"),
        F.when(cross, F.regexp_extract(target, pattern, 1)).alias("project"),
        F.when(cross, F.regexp_extract(target, pattern, 2)).otherwise(target).alias("key"),
        cross.alias("cross_project"),
    )


def key_title(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def key_folder(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("/")), F.regexp_replace(key, r"/[^/]*$", "")).otherwise("")


def valid_key(key: Column) -> Column:
    """Not empty, 512 bytes at most, no NUL, backslash or leading slash, no empty, `.` or `..` segment."""
    segments = F.forall(F.split(key, "/", -1), lambda s: ~s.isin("", ".", ".."))
    return F.coalesce((F.octet_length(key) <= KEY_MAX_BYTES) & (key != "") & ~F.contains(key, F.lit("\0")) & ~F.contains(key, F.lit("\\")) & ~F.startswith(key, F.lit("/")) & segments, F.lit(False))


def note_path(root: str, key: Column) -> Column:
    """The file of a note, or null where the key would leave the folder."""
    return F.when(valid_key(key), F.concat(F.lit(root.rstrip("/") + "/"), key, F.lit(".md")))


def valid_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike(r"^[a-z0-9_-]+$") & (F.char_length(slug) <= SLUG_MAX), F.lit(False))


def slug(remote: Column) -> Column:
    """A project's slug from its git remote; null where nothing is left.

    https://host/a/b.git, ssh://user@host:22/a/b and user@host:a/b give host-a-b: scheme, user and port go,
    percent-encoding is undone, other characters become dashes, dash runs become one.
    """
    s = F.regexp_replace(F.trim(remote), r"/+$", "")
    s = F.regexp_replace(s, r"\.git$", "")
    has_scheme = s.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
    bare = F.regexp_replace(F.regexp_replace(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^/@]*@", "")
    s = F.when(has_scheme, F.regexp_replace(bare, r"^([^/:]+):[0-9]+(?=/|$)", "$1")).otherwise(F.regexp_replace(bare, r"^([^/:]+):", "$1/"))
    s = F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9_-]+", "-")
    s = F.regexp_replace(s, r"-{2,}", "-")
    s = F.regexp_replace(F.left(F.regexp_replace(s, r"^[-_]+|[-_]+$", ""), F.lit(SLUG_MAX)), r"[-_]+$", "")
    return F.when(s != "", s)


def project_name(remote: Column) -> Column:
    """What follows the last slash or colon, without .git."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(remote), r"/+$", ""), r"\.git$", ""), "[/:]"), -1)


def strip_fences(text: Column) -> Column:
    """Without a leading line of three backquotes and without all from the last three backquotes on."""
    s = F.trim(text)
    opened = F.regexp_replace(s, r"^```[^\n]*\n?", "")
    return F.when(F.startswith(s, F.lit("```")), F.trim(F.regexp_replace(opened, r"(?s)```(?!.*```).*$", ""))).otherwise(s)


def community_report(response: Column) -> Column:
    """struct(title, summary) of a TITLE: / SUMMARY: answer; without them "Community" and the whole answer."""
    title = F.trim(F.regexp_extract(response, r"(?im)^\s*title:[ \t]*(.*)$", 1))
    summary = F.regexp_extract(response, r"(?is)(?:^|\n)\s*summary:\s*(.*)$", 1)
    lines = F.filter(F.transform(F.split(summary, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(lines, " ")
    return F.struct(F.when(title != "", title).otherwise("Community").alias("title"), F.when(joined != "", joined).otherwise(F.trim(response)).alias("summary"))


def commit_message(subject: Column, author: Column) -> Column:
    """Subject and author on one line each, author's line ends dropped. A message of more than 8 KiB is cut to
    the longest run of whole characters that fits, and an ellipsis follows."""
    name = F.regexp_replace(F.coalesce(author, F.lit("")), r"[\r\n]", "")
    full = F.when(name != "", F.concat(subject, F.lit("\n\nAuthor: "), name)).otherwise(subject)
    # The first bytes that fit; one to three of them may begin a character that does not.
    data = F.substring(F.encode(full, "UTF-8"), 1, MESSAGE_MAX_BYTES + 1)
    cuts = F.array(*(F.substring(data, 1, MESSAGE_MAX_BYTES - k) for k in range(4)))
    whole = F.element_at(F.filter(cuts, lambda c: F.is_valid_utf8(c.cast("string"))), 1)
    return F.when(F.octet_length(full) <= MESSAGE_MAX_BYTES, full).otherwise(F.concat(whole.cast("string"), F.lit("…")))


def status_class(status: Column) -> Column:
    """1xx to 5xx; others are unknown."""
    return F.when((status >= 100) & (status < 600), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("unknown")


def same_origin(url: Column, base: str) -> Column:
    """Equal host, and a path that begins with the base's."""
    host, path = F.try_parse_url(F.lit(base), F.lit("HOST")), F.coalesce(F.try_parse_url(F.lit(base), F.lit("PATH")), F.lit(""))
    return F.coalesce((F.try_parse_url(url, F.lit("HOST")) == host) & F.startswith(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), path), F.lit(False))


def relative_time(then: Column, now: Column) -> Column:
    """Age of epoch seconds in words."""
    age = now - then
    part = lambda n, unit: F.concat(F.floor(age / n).cast("string"), F.lit(unit))
    return F.when(age < 60, F.lit("just now")).when(age < 3600, part(60, "m ago")).when(age < 86400, part(3600, "h ago")).when(age < 30 * 86400, part(86400, "d ago")).otherwise(F.date_format(F.timestamp_seconds(then), "yyyy-MM-dd"))


def query_phrases(query: str) -> list[str]:
    """White-space separated phrases of a full-text query; every one must match."""
    return query.split()


def int_arg(value: object, default: int) -> int:
    """A whole number from a caller's argument, or the default."""
    try:
        return int(float(value)) if value is not None and value != "" else default
    except (TypeError, ValueError):
        return default


def string_list_arg(value: object) -> list[str]:
    """A scalar or a list as a list of strings."""
    if value is None:
        return []
    return [str(v) for v in value] if isinstance(value, list | tuple) else [str(value)]
