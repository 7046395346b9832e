"""Indexing of a folder, pruning, communities with a provider, searches and the watcher, end to end on files written here."""

import io
import os
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmere.operators import merge, notes
from quillmere.operators.ledger import Ledger, Unanswered
from quillmere.plans import search
from quillmere.plans.index import Base, finalize, index_path, index_site
from quillmere.plans.tools import Documents, Notes
from quillmere.providers import OfflineProvider
from quillmere.sources import archives, files, web
from quillmere.streaming import watch
from quillmere.tables import PROJECTS


def write(path, content, mtime):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    os.utime(path, (mtime, mtime))


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    write(root / "a.md", "# Engines\nAda Lovelace met Charles Babbage. Then Ada Lovelace wrote notes.", 1000)
    write(root / "deep/b.txt", "Grace Hopper knew Ada Lovelace. Grace Hopper built a compiler.", 1000)
    write(root / "c.docx", docx("Alan Turing met Grace Hopper\nand Alan Turing thought."), 1000)
    write(root / "empty.txt", "", 1000)
    write(root / "blank.md", " \n", 1000)
    write(root / "binary.txt", b"a\0b", 1000)
    write(root / "broken.docx", b"no archive", 1000)
    write(root / "skipped.png", "x", 1000)
    return root


def counts(base):
    return {n: base.table(n).count() for n in ("documents", "chunks", "embeddings", "entities", "relationships", "claims")}


def test_loaders(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.load_files(spark, f"file://{folder}").collect()}
    assert set(rows) == {"a.md", "b.txt", "c.docx", "empty.txt", "blank.md", "binary.txt", "broken.docx"}
    assert (rows["a.md"].title, rows["a.md"].doc_type) == ("Engines", "markdown") and rows["a.md"].mtime == 1000
    assert (rows["b.txt"].title, rows["b.txt"].doc_type) == ("b", "txt")
    assert rows["c.docx"].content == "Alan Turing met Grace Hopper\nand Alan Turing thought."
    assert {n: bool(r.error) for n, r in rows.items()} == {n: n in ("empty.txt", "blank.md", "binary.txt", "broken.docx") for n in rows}
    assert rows["empty.txt"].error == "empty file" and rows["blank.md"].error == "no content" and rows["binary.txt"].error == "binary file"
    listed = {r.path.rsplit("/", 1)[-1]: r.size for r in files.list_files(spark, f"file://{folder}").collect()}
    assert listed["empty.txt"] == 0 and listed["blank.md"] == 2 and set(listed) == set(rows)
    one = files.load_files(spark, f"file://{folder}/a.md").collect()
    assert [r.title for r in one] == ["Engines"]


def test_registered_loader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LOADERS", dict(files.LOADERS))
    files.register_loader(".CSV", lambda path, data: ("table", "csv", data.decode().upper()))
    assert ".csv" in files.supported_extensions()
    assert files.load_bytes("x.csv", b"a,b") == ("table", "csv", "A,B")
    with pytest.raises(files.LoadError):
        files.load_bytes("x.unknown", b"text")


def test_index_again_change_and_prune(spark, folder, tmp_path):
    base, provider = Base(spark, f"file://{tmp_path}/base"), OfflineProvider(16)
    wrong = []
    assert index_path(base, f"file://{folder}", provider, errors=wrong) == {"new": 3, "failed": 4}
    assert [p.rsplit("/", 1)[-1] for p, _ in wrong] == ["binary.txt", "blank.md", "broken.docx", "empty.txt"]
    first = counts(base)
    assert first["documents"] == 3 and first["chunks"] == first["embeddings"] >= 3 and first["entities"] >= 4 and first["claims"] >= 3
    version = base.store.snapshot().version
    assert index_path(base, f"file://{folder}", provider)["failed"] == 4
    assert counts(base) == first

    before = {n: set(base.store.snapshot().files(n)) for n in ("chunks", "documents")}
    write(folder / "a.md", "# Engines\nAda Lovelace met Charles Babbage. A new line about Mary Somerville.", 2000)
    write(folder / "deep/b.txt", (folder / "deep/b.txt").read_text(), 2000)
    found = index_path(base, f"file://{folder}", provider)
    assert found["changed"] == 1 and found["touched"] == 1
    docs = base.table("documents")
    assert {(r.version, r.is_latest) for r in docs.where("title = 'Engines'").collect()} == {(1, False), (2, True)}
    assert docs.where("title = 'Engines'").select("canonical_id").distinct().count() == 1
    assert docs.where("title = 'b'").first().indexed_mtime == 2000
    after = {n: set(base.store.snapshot().files(n)) for n in before}
    assert all(before[n] & after[n] for n in before)  # untouched buckets keep their files

    # A file that has become empty is an error, not a deletion; one that is gone is pruned with all it had.
    write(folder / "deep/b.txt", "", 3000)
    (folder / "c.docx").unlink()
    assert index_path(base, f"file://{folder}", provider, prune=True)["pruned"] == 1
    assert {r.title for r in base.table("documents").collect()} == {"Engines", "b"}
    left = base.table("documents").select(F.col("id").alias("doc_id"))
    for name in ("chunks", "relationships", "claims"):
        assert base.table(name).join(left, "doc_id", "left_anti").isEmpty()
    assert base.table("embeddings").join(base.table("chunks").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").isEmpty()
    # Every version that was ever committed has a document for each chunk.
    for v in range(version, base.store.snapshot().version + 1):
        held = base.store.snapshot(v)
        assert held.read("chunks").join(held.read("documents").select(F.col("id").alias("doc_id")), "doc_id", "left_anti").isEmpty()


def test_finalize_and_searches(spark, folder, tmp_path):
    base, provider = Base(spark, f"file://{tmp_path}/base"), OfflineProvider(32)
    index_path(base, f"file://{folder}", provider)
    assert finalize(base, provider) is True
    communities = base.table("communities").collect()
    assert communities and all(r.summary and len(r.vector) == 32 for r in communities)
    ranked = {r.name: (r.rank, r.community_id) for r in base.table("entities").collect()}
    assert ranked["Ada Lovelace"][0] > 0 and any(c for _, c in ranked.values())
    version = base.store.snapshot().version
    assert finalize(base, provider) is False and base.store.snapshot().version == version
    assert finalize(base, provider, force=True) is True

    tools = Documents(base.tables(), provider)
    answer, used = tools.global_search("who met whom")
    assert answer.startswith("answer ") and used.count() == min(len([r for r in communities if r.level == 0]), search.TOP_COMMUNITIES)
    text = base.table("chunks").where("content LIKE 'Grace%'").first()
    hits = tools.search_documents(text.content, 1).collect()
    assert [h.id for h in hits] == [text.id] and abs(hits[0].score - 1) < 1e-6
    chunks, entities, edges = tools.local_search(text.content, 1, 2)
    docs = {r.doc_id for r in chunks.collect()}
    assert docs == {text.doc_id} and {r.doc_id for r in edges.collect()} <= docs  # the walk stays in the hits' documents
    names = {r.name for r in entities.collect()}
    assert {"Grace Hopper", "Ada Lovelace"} <= names and "Alan Turing" not in names
    assert search.document_search(base.tables(), provider, "x", 9, doc_type="docx").count() == 1
    assert search.document_search(base.tables(), provider, "x", 9, latest_only=True).count() == base.table("chunks").count()
    base.write(communities=base.table("communities").limit(0))
    assert Documents(base.tables(), provider).global_search("x")[0] == search.NOTHING


def test_watched_folder(spark, folder, tmp_path):
    base, wrong = Base(spark, f"file://{tmp_path}/base"), []
    run = lambda: watch.watch_files(spark, f"file://{folder}", base, f"file://{tmp_path}/state", max_files=2, on_error=lambda p, e: wrong.append(p.rsplit("/", 1)[-1])).awaitTermination(120)
    run()
    assert base.table("documents").count() == 3 and sorted(wrong) == ["binary.txt", "blank.md", "broken.docx"]
    write(folder / "new.md", "# New\nsome words", 5000)
    run()
    assert base.table("documents").count() == 4
    told = []
    listing = watch.poll(spark, f"file://{folder}", None, lambda p, c: told.append((p, c)))
    assert not told
    (folder / "new.md").unlink()
    write(folder / "a.md", "# Engines\nother", 9000)
    write(folder / "z.txt", "z", 9000)
    watch.poll(spark, f"file://{folder}", listing, lambda p, c: told.append((p.rsplit("/", 1)[-1], c)))
    assert told == [("a.md", "changed"), ("new.md", "removed"), ("z.txt", "added")]


def test_event_log(spark, tmp_path):
    log = watch.EventLog(spark, f"file://{tmp_path}/log")
    emit = log.writer("j")
    for n in range(3):
        emit({"phase": f"p{n}", "done": n == 2})
    log.writer("other")({"phase": "x"})
    assert [(r.seq, r.phase, r.done) for r in log.replay("j", 1).collect()] == [(1, "p1", False), (2, "p2", True)]


def test_notes_in_archives(spark, tmp_path):
    rows = spark.createDataFrame([("b/two", "text é"), ("a", ""), ("c", "x" * 2000)], "key string, raw string")
    out = io.BytesIO()
    assert files.tar_notes(rows, out) == 3
    (tmp_path / "n.tar.gz").write_bytes(out.getvalue())
    with tarfile.open(fileobj=io.BytesIO(out.getvalue())) as tar:
        assert tar.getnames() == ["a.md", "b/two.md", "c.md"]
    read = lambda **limits: files.untar_notes(spark, f"file://{tmp_path}/n.tar.gz", **limits)
    assert sorted(map(tuple, read(entries=3, total=2008, each=2000).collect())) == sorted(map(tuple, rows.collect()))
    for limits in ({"entries": 2}, {"total": 2000}, {"each": 1999}):
        with pytest.raises(Exception, match="over a limit"):
            read(**limits).collect()


class Site:
    """Answers from files of a folder, and notes each fetch in another, so that those of the workers count too."""

    def __init__(self, root, log):
        self.root, self.log = root, log
        root.mkdir(), log.mkdir()

    def put(self, path, html):
        (self.root / path.replace("/", "_")).write_text(html)

    def __call__(self, url):
        import uuid

        (self.log / uuid.uuid4().hex).write_text(url)
        at = self.root / url.removeprefix("http://h").replace("/", "_")
        if url.endswith("down"):
            raise OSError("no answer")
        return (200, "text/html; charset=utf-8", at.read_bytes()) if at.exists() else (404, "text/html", b"")

    def fetches(self):
        found = sorted(p.read_text() for p in self.log.iterdir())
        for p in self.log.iterdir():
            p.unlink()
        return [u for u in found if not u.endswith(".xml")]


@pytest.fixture
def site(spark, sf_dir, tmp_path):
    """Pages of the table, each linked from the root by sections."""
    site = Site(tmp_path / "site", tmp_path / "log")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(12).collect()
    for r in rows:
        site.put(f"/p{r.page_id}", re.sub(r"(?is)<a[^>]*href[^>]*>", "<a>", r.html) + f'<p>page number {r.page_id}</p><a href="/p{(r.page_id + 1) % 12}">next</a>')
    site.put("/", "<title>Root</title><p>welcome</p>" + "".join(f'<a href="/p{i}">x</a>' for i in range(0, 12, 2)) + '<a href="/down">d</a><a href="/gone">g</a><a href="http://other/x">o</a>')
    return site


def test_a_site_is_indexed_twice(spark, site, tmp_path):
    base = Base(spark, f"file://{tmp_path}/base")
    first = index_site(base, "http://h/", site)
    addresses = sorted({"http://h/", "http://h/down", "http://h/gone", *(f"http://h/p{i}" for i in range(12))})
    assert site.fetches() == addresses  # once each
    documents = base.table("documents").count()
    assert first == {"new": documents} and documents >= 10
    assert base.table("documents").where("path = 'http://h/'").first().title == "Root"
    assert index_site(base, "http://h/", site) == {"unchanged": documents}
    assert site.fetches() == addresses
    site.put("/", (site.root / "_").read_text().replace("welcome", "welcome again"))
    site.put("/p3", (site.root / "_p3").read_text().replace("<p>", '<p class="x">'))  # markup alone
    assert index_site(base, "http://h/", site) == {"changed": 1, "unchanged": documents - 1}
    assert {(r.version, r.is_latest) for r in base.table("documents").where("path = 'http://h/'").collect()} == {(1, False), (2, True)}


def test_bounds_of_a_crawl(spark, site):
    depths = lambda **bounds: {r.url.removeprefix("http://h"): r.depth for r in web.crawl_site(spark, "http://h/", site, **bounds).select("url", "depth").collect()}
    assert depths(max_depth=1) == {"/": 0, "/down": 1, "/gone": 1} | {f"/p{i}": 1 for i in range(0, 12, 2)}
    assert depths(max_pages=3) == {"/": 0, "/down": 1, "/gone": 1}
    site.put("/sitemap.xml", "<urlset><url><loc>http://h/p1</loc></url><url><loc>http://other/p</loc></url><url><loc>http://h/p2</loc></url></urlset>")
    assert depths() == {"/p1": 0, "/p2": 0} and len(depths(skip_sitemap=True)) == 15


class Counted(OfflineProvider):
    """Notes each call in a folder; fails in those of which a file there names the text."""

    def __init__(self, log, dims=8):
        super().__init__(dims)
        self.log = str(log)

    def complete(self, prompt, json_mode=False, max_tokens=2048, temperature=0.0):
        import uuid
        from pathlib import Path

        (Path(self.log) / f"{uuid.uuid4().hex}.call").write_text(prompt)
        fail = Path(self.log) / "fail"
        if fail.exists() and fail.read_text() in prompt:
            raise ConnectionError("lost")
        return super().complete(prompt, json_mode, max_tokens, temperature)

    def calls(self):
        from pathlib import Path

        found = sorted(p.read_text() for p in Path(self.log).glob("*.call"))
        for p in Path(self.log).glob("*.call"):
            p.unlink()
        return found


def test_ledger_asks_once(spark, folder, tmp_path):
    (tmp_path / "log").mkdir()
    provider = Counted(tmp_path / "log")
    plain, kept = Base(spark, f"file://{tmp_path}/plain"), Base(spark, f"file://{tmp_path}/kept")
    index_path(plain, f"file://{folder}", provider)
    every = sorted(set(provider.calls()))
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", calls=1)
    (tmp_path / "log" / "fail").write_text("CLAIMS\nGrace")  # one call in the middle
    with pytest.raises(Unanswered):
        index_path(kept, f"file://{folder}", provider, ledger=ledger)
    first = provider.calls()
    assert kept.table("documents").count() == 0 and ledger.failures(provider.model_id()).count() == 1
    (tmp_path / "log" / "fail").unlink()
    index_path(kept, f"file://{folder}", provider, ledger=ledger)
    second = provider.calls()
    lost = [p for p in first if p.startswith("CLAIMS\nGrace")]
    assert len(lost) == 1 and not set(second) & (set(first) - set(lost))
    assert sorted(first + second) == sorted(every + lost)
    assert ledger.failures(provider.model_id()).count() == 0
    for name in ("entities", "relationships", "claims"):
        assert sorted(map(str, kept.table(name).collect())) == sorted(map(str, plain.table(name).collect()))
    index_path(kept, f"file://{folder}", provider, ledger=ledger, force=True)
    assert provider.calls() == []


def test_keyed_changes_over_restarts(spark, tmp_path):
    """Four sweeps, the stream ended and started again after each: what it tells is what the listings differ by."""
    sweeps = [
        [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")],
        [("a", 1, "x"), ("b", 2, "y"), ("c", 2, "zz"), ("d", 5, None)],
        [("a", 1, "x"), ("d", 5, None)],
        [("b", 9, "y"), ("d", 6, "q")],
    ]
    root, out = f"file://{tmp_path}/sweeps", f"file://{tmp_path}/out"
    told = []
    for n, rows in enumerate([*sweeps, sweeps[-1]]):
        watch.sweep(spark.createDataFrame(rows, "path string, mtime long, hash string"), root, 1_000 * (n + 1))
        stream = watch.changes(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        stream.awaitTermination(120)
        told.append({(r.path, r.change, r.sweep.timestamp()) for r in spark.read.parquet(out).collect()})
    new = [sorted((p, c) for p, c, _ in now - (told[i - 1] if i else set())) for i, now in enumerate(told)]
    assert new[0] == [("a", "new"), ("b", "new"), ("c", "new")]
    assert [x for x in new[1] if x[1] != "removed"] == [("b", "touched"), ("c", "changed"), ("d", "new")]
    # A removal is told with the first sweep that lacks the path.
    assert new[2] == [("b", "removed"), ("c", "removed")]
    assert new[3] == [("a", "removed"), ("b", "new"), ("d", "changed")]
    assert new[4] == []
    diff = merge.snapshot_diff(spark.createDataFrame(sweeps[1], "key string, mtime long, h string"), spark.createDataFrame(sweeps[2], "key string, mtime long, h string"))
    assert sorted(map(tuple, diff.collect())) == [("b", "removed"), ("c", "removed")]


def test_notes_of_a_folder(spark, tmp_path):
    root = tmp_path / "notes"
    write(root / "a.md", "---\nauthor: ann\ntags: [X, y]\n---\nbody [[b/c]]", 1000)
    write(root / "b/c.md", "plain é", 2000)
    write(root / ".hidden/d.md", "x", 1000)
    write(root / "e.txt", "x", 1000)
    raw = files.read_notes(spark, f"file://{root}")
    assert [(r.key, r.raw.splitlines()[-1], r.mtime) for r in raw.collect()] == [("a", "body [[b/c]]", 1000), ("b/c", "plain é", 2000)]
    found = notes.read_notes(raw)
    one = found.where("key = 'a'").first()
    assert (one.content.strip(), one.author, one.tags, one.error) == ("body [[b/c]]", "ann", ["x", "y"], None)
    rows = found.drop("error").withColumn("project", F.lit("default")).unionByName(found.drop("error").withColumn("project", F.lit("other")).where("key = 'a'"))
    tools = Notes(spark.createDataFrame([("other", "Other", "git@h:o", 1)], PROJECTS), rows)
    assert [r.key for r in tools.list_notes().collect()] == ["a", "b/c"] and [r.key for r in tools.list_notes("other").collect()] == ["a"]
    assert [r.key for r in tools.search_notes("PLAIN").collect()] == ["b/c"] and tools.read_note("a").count() == 1
    assert {r.key for r in tools.delete_note("a").collect()} == {"b/c"}
    with pytest.raises(KeyError):
        tools.list_notes("unknown")
    with pytest.raises(ValueError):
        tools.list_notes("Bad Slug!")
    nodes, edges = tools.get_notes_graph()
    assert [(r.source, r.target) for r in edges.collect()] == [("a", "b/c")] and nodes.count() == 2


def test_archives_by_tasks(spark, tmp_path):
    rows = [(f"n{i:03}", "é" * i) for i in range(40)] + [("deep/er/x", ""), ("big", "y" * 3000)]
    notes_ = spark.createDataFrame(rows, "key string, raw string")
    archives.write_archives(notes_, f"file://{tmp_path}/out", 3)
    files_ = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files_) == 3 and all(n.endswith(".tar.gz") for n in files_) and [p.name for p in tmp_path.iterdir()] == ["out"]
    assert sorted(map(tuple, archives.read_archives(spark, f"file://{tmp_path}/out").collect())) == sorted(rows)
    with pytest.raises(Exception, match="out"):
        archives.write_archives(notes_, f"file://{tmp_path}/out", 3)  # never over another
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    # At the limits, and one beyond each.
    archives.write_archives(notes_.where("key LIKE 'n00%'"), f"file://{tmp_path}/ten", 1)
    read = lambda **limits: archives.read_archives(spark, f"file://{tmp_path}/ten", archives.Limits(**limits)).count()
    size = sum(2 * i for i in range(10))
    assert read(entries=10, total=size, each=18) == 10
    for limits in ({"entries": 9}, {"total": size - 1}, {"each": 17}):
        with pytest.raises(Exception, match="over a limit"):
            read(**limits)
    with tarfile.open(tmp_path / "ten" / "evil.tar.gz", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("../up.md"))
    with pytest.raises(Exception, match="leaves the folder"):
        read()
