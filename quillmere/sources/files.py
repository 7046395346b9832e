"""Documents from files: a directory walk, one loader a format, archives of notes."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are loaded, and the limits of an import.
EXTENSIONS = ("pdf", "docx", "txt", "md", "markdown", "text")
IMPORT_ENTRIES, IMPORT_BYTES, NOTE_BYTES = 10_000, 500 << 20, 10 << 20
SNIFFED = 8192
#: Spark SQL's condition on `path`.
WANTED = rf"lower(path) rlike '[.]({'|'.join(EXTENSIONS)})$'"
RAW = "path string, title string, doc_type string, content string, file_hash string, mtime long, error string"


class LoadError(ValueError):
    pass


def is_binary(data: bytes) -> bool:
    """A NUL byte, or over 30 % control bytes, in the first 8 KiB."""
    head = data[:SNIFFED]
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head)
    return b"\0" in head or (bool(head) and control / len(head) > 0.3)


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def load_text(path: str, data: bytes) -> tuple[str, str, str]:
    return _stem(path), "txt", data.decode("utf-8", "replace")


def load_markdown(path: str, data: bytes) -> tuple[str, str, str]:
    lines = data.decode("utf-8", "replace").splitlines()
    title = next((x[2:].strip() for x in lines if x.startswith("# ")), "") or _stem(path)
    return title, "markdown", "".join(f"{x}\n" for x in lines)


def load_docx(path: str, data: bytes) -> tuple[str, str, str]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            tree = ElementTree.fromstring(z.read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise LoadError(f"no word document: {e}") from e
    out = []
    for node in tree.iter():
        name = node.tag.rsplit("}", 1)[-1]
        out.append("\n" if name == "p" else node.text or "" if name == "t" else "")
    text = "".join(out).strip()
    if not text:
        raise LoadError("no text in the document")
    return _stem(path), "docx", text


def load_pdf(path: str, data: bytes) -> tuple[str, str, str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise LoadError("reading PDF needs pypdf") from e
    text = "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages).strip()
    if not text:
        raise LoadError("no text in the PDF")
    return _stem(path), "pdf", text


#: Loader of each extension; others can be registered.
LOADERS: dict[str, Callable[[str, bytes], tuple[str, str, str]]] = {"txt": load_text, "text": load_text, "": load_text, "md": load_markdown, "markdown": load_markdown, "docx": load_docx, "pdf": load_pdf}
PACKED = {"docx", "pdf"}


def register_loader(extension: str, loader: Callable[[str, bytes], tuple[str, str, str]]) -> None:
    LOADERS[extension.lower().lstrip(".")] = loader


def supported_extensions() -> list[str]:
    return sorted(f".{e}" for e in LOADERS if e)


def load_bytes(path: str, data: bytes) -> tuple[str, str, str]:
    """Title, type and text of one file."""
    name = path.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[1].lower() if "." in name else ""
    if not data:
        raise LoadError("empty file")
    if extension not in PACKED and is_binary(data):
        raise LoadError("binary file")
    if extension not in LOADERS:
        raise LoadError(f"no loader for .{extension}")
    title, kind, text = LOADERS[extension](path, data)
    if not text.strip():
        raise LoadError("no content")
    return title, kind, text


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime (epoch seconds), size of all files to index under a folder, or of one file; contents are not read.
    Spark's own reader passes over files without bytes, so these are listed beside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if root.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
        files = files.where(WANTED)
    full = files.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return full.unionByName(_empty_files(spark, root).select("path", "mtime", F.lit(0).cast("long").alias("size")))


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime of files without bytes. The file system is walked as its listing streams, and only these are kept."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    files = fs.listFiles(at, True) if fs.exists(at) else None
    while files is not None and files.hasNext():
        one = files.next()
        path = one.getPath().toString()
        hidden = any(x.startswith((".", "_")) for x in path[len(root) :].split("/"))
        if not one.getLen() and not hidden and path.rsplit(".", 1)[-1].lower() in EXTENSIONS:
            found.append((path, one.getModificationTime() // 1000))
    return spark.createDataFrame(found, "path string, mtime long")


def load_raw(rows: DataFrame) -> DataFrame:
    """Documents of files (path, content, mtime); those that cannot be loaded come with their error and no content."""
    loaders = dict(LOADERS)

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        LOADERS.update(loaders)
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                try:
                    out.append((r.path, *load_bytes(r.path, bytes(r.content)), r.file_hash, r.mtime, None))
                except LoadError as e:
                    out.append((r.path, None, None, None, r.file_hash, r.mtime, str(e)))
            yield pd.DataFrame(out, columns=["path", "title", "doc_type", "content", "file_hash", "mtime", "error"])

    return rows.select("path", "content", F.sha2("content", 256).alias("file_hash"), "mtime").mapInPandas(load, RAW)


def load_files(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """Documents of a folder (or of one file); `only` has the paths to read. Files that cannot be loaded, empty ones
    included, come with their error and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if root.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
        files = files.where(WANTED)
    rows = files.select("path", "content", F.unix_timestamp("modificationTime").alias("mtime"))
    rows = rows.unionByName(_empty_files(spark, root).select("path", F.lit(b"").alias("content"), "mtime"))
    return load_raw(rows if only is None else rows.join(only.select("path"), "path", "left_semi"))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """key and raw text of all *.md files under a folder, by key; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") if root.startswith(("file:", "/")) else root.rstrip("/")
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/*", "/"), f"^{re.escape(base)}/", ""), r"\.md$", "")
    return files.select(key.alias("key"), F.decode("content", "UTF-8").alias("raw"), F.unix_timestamp("modificationTime").alias("mtime")).where(~F.col("key").rlike(r"(^|/)\.")).orderBy("key")


def untar_notes(spark: SparkSession, path: str, entries: int = IMPORT_ENTRIES, total: int = IMPORT_BYTES, each: int = NOTE_BYTES) -> DataFrame:
    """key and raw text of the notes in gzipped tar archives. An archive over a limit, or with a member that
    would leave the folder, fails; members that are no .md files are passed over."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(bytes(data)), mode="r:gz") as tar:
                    for n, member in enumerate(tar):
                        size += member.size
                        if n >= entries or size > total or member.size > each:
                            raise LoadError("the archive is over a limit")
                        if member.name.startswith("/") or ".." in member.name.split("/"):
                            raise LoadError(f"{member.name} leaves the folder")
                        if member.isfile() and member.name.endswith(".md"):
                            rows.append((re.sub(r"^\./", "", member.name)[:-3], tar.extractfile(member).read().decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["key", "raw"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "key string, raw string")


def tar_notes(notes: DataFrame, out: io.BufferedIOBase) -> int:
    """Write notes (key, raw) as one gzipped tar, in key order; rows stream through the driver one by one, for
    an archive is one file. Return their number."""
    count = 0
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w") as tar:
        for row in notes.select("key", "raw").orderBy("key").toLocalIterator():
            data = row["raw"].encode()
            info = tarfile.TarInfo(f"{row['key']}.md")
            info.size, info.mode = len(data), 0o644
            tar.addfile(info, io.BytesIO(data))
            count += 1
    return count
