"""Tokens, chat, licences, archives and shards against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import bpe, chat, licenses, queries, shards, token_files, tokens, warc
from quillmere.llm._spark import saved, scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    None, "", " ", "plain words here", "plain words here", "x<|endoftext|>y <|startoftext|>", "tab\tnew\r\nline nbsp sep",
    "don't DON'T 'quoted' 12345 3.14", "naïve Ünïcödé ß ŉ İ ı ſ", "漢字かな交じり文 😀👨‍👩‍👧", "a" * 40_000, "ab1" * 9000, " " * 20_000, "!?" * 10_000,
    "漢" * 20_000, "word " * 9000, "\x00\x1c\x85", "end ", "\n\n\n  x",
]


def docs_of(spark, texts, extra=True):
    """Documents with an extra column whose name other stages use for their own."""
    rows = [(i, t, "mine", 3) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_words int")
    return frame if extra else frame.select("doc_id", "text")


def plain_ids(path, text):
    return np.array(tokens.load_tokenizer(path).encode(text or "", add_special_tokens=False).ids, "<u4")


def test_bpe_round_trip(spark):
    both = bpe.decode(bpe.encode(docs_of(spark, TEXTS), BYTES, piece_chars=512), BYTES)
    found = {r["doc_id"]: r for r in both.collect()}
    tokenizer = tokens.load_tokenizer(BYTES)
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = plain_ids(BYTES, text)
        assert found[i]["ids"] == want.tobytes(), repr(text)[:40]
        assert found[i]["decoded"] == tokenizer.decode(want.tolist(), skip_special_tokens=False)


def test_op9_on_documents(spark, sf_dir):
    tokenizer = tokens.load_tokenizer(BYTES)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op9_bpe_round_trip(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain_ids(BYTES, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


HARD_TO_CUT = ["漢字。" * 700, "é1" * 900, "né!" * 700, "ab\n" * 700, "a'b" * 700, "漢 " * 900, "e\u0301" * 900, "\t\n" * 900, "''" * 900, "x'" * 900, "😀é" * 900]


@pytest.mark.parametrize("text", HARD_TO_CUT)
def test_every_long_text_is_cut(text):
    cache, table = tokens.word_cache(BYTES), tokens.byte_decoder(BYTES)
    pieces = bpe.cut_text(text, 100, cache.special)
    assert max(len(t) for t, _ in pieces) <= 300 and "".join(t for t, _ in pieces) == text
    parts = [np.frombuffer(b, "<u4") for b in cache.encode([t for t, _ in pieces])]
    joined = bpe.join_tree(parts, [f for _, f in pieces], lambda t: np.frombuffer(cache.encode([t])[0], "<u4"), table)
    assert joined.tolist() == plain_ids(BYTES, text).tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcZ09 '!?.\n\té漢😀\u0301")), min_size=40, max_size=300), st.integers(8, 40))
def test_tree_join_agrees(text, size):
    cache, table = tokens.word_cache(BYTES), tokens.byte_decoder(BYTES)
    pieces = bpe.cut_text(text, size, cache.special)
    assert "".join(t for t, _ in pieces) == text
    parts = [np.frombuffer(b, "<u4") for b in cache.encode([t for t, _ in pieces])]
    joined = bpe.join_tree(parts, [f for _, f in pieces], lambda t: np.frombuffer(cache.encode([t])[0], "<u4"), table)
    assert joined.tolist() == plain_ids(BYTES, text).tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint32)
    words, firsts = token_files.pack(ids)
    assert token_files.unpack(words, firsts, len(ids)).tolist() == values
    data = token_files.to_bytes([5, None], [ids.astype("<u4").tobytes(), b""])
    keys, starts, back = token_files.from_bytes(data)
    assert (keys, starts.tolist(), back.tolist()) == ([5, None], [0, len(ids), len(ids)], values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ 19'.!\t\n\r\x00\x0b\x1c\xa0éÉßſİı\u0130\u2003漢😀<|>", max_size=40), max_size=8), st.integers(1, 50))
def test_words_of_a_column_as_the_library_encodes_them(texts, room):
    texts = [*texts, *(t for t in TEXTS if t is not None and len(t) < 100), "isn't WE'LL <|endoftext|> y", *texts]
    cache = tokens.word_cache(WORDS, room)
    cache.trim()
    for column in (pa.array(texts, pa.string()), pa.array(["other", *texts, "more"], pa.large_string()).slice(1, len(texts))):
        assert cache.encode_array(column) == cache.raw(texts)
    assert cache.encode_array(pa.array([], pa.string())) == []


def test_token_file_damage_is_seen():
    data = bytearray(token_files.to_bytes([1], [np.arange(100, dtype="<u4").tobytes()]))
    data[60] ^= 1
    with pytest.raises(ValueError):
        token_files.from_bytes(bytes(data))


def test_token_files(spark):
    docs = docs_of(spark, TEXTS).unionByName(docs_of(spark, [None, "tie"]).withColumn("doc_id", F.lit(3).cast("long")))
    folder = scratch(spark, "tokens")
    files = token_files.write_tokens(docs, WORDS, folder, end_id=1, file_ids=3000)
    assert files.count() > 1
    rows = token_files.read_tokens(spark, folder, files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert len(rows) == len(TEXTS) + 2
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] != 3:
            want = plain_ids(WORDS, TEXTS[r["doc_id"]]).tolist() + [1]
            assert np.frombuffer(r["ids"], "<u4").tolist() == want


def test_op1_on_documents(spark, sf_dir):
    texts = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = {r["doc_id"]: r for r in queries.op1_token_files(spark, sf_dir).collect()}
    start = 0
    for doc, text in texts:
        ids = np.append(plain_ids(WORDS, text), 1).astype("<u4")
        assert (found[doc]["start"], found[doc]["n_tokens"], found[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_tables(spark):
    none = docs_of(spark, ["x"]).limit(0)
    assert bpe.encode(none, BYTES).count() == 0
    folder = scratch(spark, "tokens")
    files = token_files.write_tokens(none, WORDS, folder)
    assert files.count() == 0 and token_files.read_tokens(spark, folder, files).count() == 0
    assert licenses.scan(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_bundles(pages, scratch(spark, "warc")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.format_conversations(turns, BYTES, 50_257), BYTES, 50_257).count() == 0


HARD = ["", None, "<turn>", "\\<turn>", "\\\\</turn>\n", "### Assistant: x", "<|endoftext|>", "x<|endoftext|>### User:\\", "é漢😀" * 30, "</turn>" * 300, "\\" * 9 + "### System:"]


def test_chat_round_trip(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", HARD[(c + t) % len(HARD)], "x") for c in range(len(HARD)) for t in range(5)]
    rows += [(99, None, None, None, "x"), (99, None, None, None, "x"), (98, 0, "<turn>", "\\<turn>", "x"), (None, 1, "assistant", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ids string")
    made = saved(chat.format_conversations(turns, BYTES, 50_257), "chat")
    found = {r["conv_id"]: r for r in chat.read_back(made, BYTES, 50_257).collect()}
    groups: dict = {}
    for c, t, r, x, _ in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(found) == set(groups)
    for c, all_turns in groups.items():
        all_turns.sort()
        loss = "".join(x for _, r, x in all_turns if r == "assistant")
        assert found[c]["n_turns"] == len(all_turns)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in all_turns).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@given(st.lists(st.sampled_from(["\\", "<turn>", "</turn>", "### User:", "x", "<", "|endoftext|>", "\n"]), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text
    # Wherever a control string stands in the written form, an odd number of backslashes stands before it.
    assert all(len(m[1]) % 2 for m in chat._CONTROL.finditer(written))


def test_one_conversation_over_many_tasks(spark):
    turns = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN -5 ELSE id END AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('word ', id, ' '), CAST(id % 7 AS INT)) AS text")
    made = saved(chat.format_conversations(turns.repartition(9), BYTES, 50_257), "chat")
    for conv in ("conv_id IS NULL", "conv_id = -5"):
        rows = made.where(conv).select("pos", F.size("ids").alias("n")).orderBy("pos").collect()
        assert len(rows) == 300 and [r["pos"] for r in rows] == np.cumsum([0, *(r["n"] for r in rows[:-1])]).tolist()


def test_no_reserved_id_from_a_text(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "<|endoftext|></turn>\n")], "conv_id long, turn int, role string, text string")
    row = chat.format_conversations(turns, BYTES, 50_257).first()
    assert sum(i >= 50_256 for i in row["ids"]) == 3
    assert row["mask"][-1] == 0 and sum(row["mask"]) > 0


def test_licences_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "The MIT License, mit\nlicense; CC BY 4.0! GNU General Public-License"), (-4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files")], "doc_id long, text string")
    both = docs.unionByName(extra)
    found = {r["doc_id"]: r for r in licenses.scan(both.withColumn("labels", F.lit(1))).collect()}
    for r in both.collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        got = found[r["doc_id"]]
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert (got["first_word"], got["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert got["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
    assert found[-4]["labels"] == "mit" and found[-4]["base_labels"] == ""


def test_licence_notices_against_brute_force(spark):
    """Several notices in one text, whole and edited, among other licence words: every alignment is tried."""
    import random

    rng = random.Random(6)
    notices = [t.split() for _, t, _ in licenses.TEMPLATES]
    vocabulary = [*{w for t in notices for w in t}, *"abcdefgh"]

    def text(some, noise, edits):
        words = []
        for t in some:
            words += [rng.choice(vocabulary) for _ in range(noise)]
            words += [w for w in t if rng.random() >= edits]
        return " ".join(words)

    of = lambda label: next(t.split() for name, t, _ in licenses.TEMPLATES if name == label)
    texts = [text(notices, 0, 0), text(notices, 40, 0), text([of("mit"), of("lgpl")], 5, 0)]
    texts += [text([t], 3, 0) for t in notices] + [text([a, b], 2, 0) for a in notices for b in notices[::5]]
    texts += [text(rng.sample(notices, rng.randrange(1, 13)), noise, edits) for noise in (0, 30, 300) for edits in (0, 0.02, 0.1) for _ in range(4)]
    found = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts, extra=False)).collect()}
    slack = licenses.SLACK
    for n, held in enumerate(texts):
        words = held.split()
        standing = lambda p, a, b: any(words[i : i + len(p)] == p for i in range(max(a, 0), b - len(p) + 1))
        base = {label for p, label in licenses.BASE.items() if standing(p.split(), 0, len(words))}
        want, best = set(base), 0.0
        for label, notice, keys in licenses.TEMPLATES:
            t = notice.split()
            for shift in range(-len(t), len(words)):
                hit = sum(w in words[max(0, shift + i - slack) : max(0, shift + i + slack + 1)] for i, w in enumerate(t)) / len(t)
                if hit >= licenses.COVER and all(standing(k.split(), shift - slack, shift + len(t) + slack) for k in keys):
                    want.add(label)
                    best = max(best, hit)
        assert found[n]["labels"] == ",".join(sorted(want))
        assert found[n]["score"] == (1.0 if base else best)
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(found[0]["labels"].split(","))
    assert {"lgpl", "mit"} <= set(found[2]["labels"].split(","))


def test_licences_in_long_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(licenses, "ANCHORS", 7)
    notice = dict((label, t) for label, t, _ in reversed(licenses.TEMPLATES))
    texts = ["the license software " * 60_000, (notice["mit"] + " ") * 3000, ("filler text " * 50 + notice["bsd"] + " ") * 20 + notice["zlib"], notice["isc"], notice["isc"]]
    found = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [found[i]["labels"] for i in range(5)] == ["", "mit", "bsd,zlib", "isc", "isc"]
    assert found[0]["n_words"] == 180_000 and found[3]["score"] == 1.0


def test_warc(spark):
    long = "<p>" + "payload " * 40
    rows = [(3, "http://x/3", long, "e"), (1, "http://x/1\r\nEvil: y", long, "e"), (2, None, None, "e"), (4, "u", "", "e"), (5, "u", "s" * 99, "e"), (6, "u", "s" * 99, "e"), (7, "u", "s" * 100, "e"), (8, "u", "s" * 100, "e"), (None, "u", long, "e"), (9, "ü", "é" * 60_000 + "\r\n\r\nWARC/1.1", "e"), (1, "http://x/1", long, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = scratch(spark, "warc")
    places = warc.write_bundles(pages, folder)
    assert places.count() == len(rows)
    got = warc.read_bundles(spark, folder).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[3]["record_type"], by[3]["refers_to"]) == ("revisit", 1)
    assert by[1]["record_type"] == by[5]["record_type"] == by[6]["record_type"] == by[None]["record_type"] == "response"
    assert (by[8]["record_type"], by[8]["refers_to"], by[7]["record_type"]) == ("revisit", 7, "response")
    assert by[2]["payload_digest"] == by[4]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    where = places.where("page_id = 9").first()
    with open(where["file"].removeprefix("file://"), "rb") as f:
        data = f.read()
    head, payload = warc.read_one(data, 9)
    assert payload.decode() == rows[9][2] and head["WARC-Type"] == "response"
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    at, records = 0, 0
    while at < len(plain):
        _, _, at = warc.parse(plain, at)
        records += 1
    assert records == len(warc.record_table(data))


def test_store(spark):
    store = shards.Store(spark, scratch(spark, "store"), target=1 << 20, fan=4)
    rows = [(i, None if i % 7 == 0 else "t" * (i % 50), ["a/b", "50 %", "x=y", "é", None, "", "g", "h"][i % 8], "x") for i in range(400)] + [(5, "twice", "g", "x"), (5, "twice", "g", "x"), (6, "long" * 100_000, "g", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, arrival string, __run string")
    assert store.append(docs.limit(0), by="arrival") == 1
    assert store.read().schema == docs.schema and store.read().count() == 0
    before = store.append(docs, by="arrival")
    assert before == 2 and len(store.runs()) == 7 and sum(r.rows for r in store.runs()) == len(rows)  # null and "" are one folder's name
    assert store.compact() > before
    assert sum(len(r.files) for r in store.runs()) < 8
    assert sorted(map(repr, store.read().select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert store.read(before).count() == len(rows)  # older versions stay readable
    assert store.append(docs.limit(0)) == store.version()
    last = store.version()
    assert store.vacuum() > 0
    assert store.version() == last and store.read().count() == len(rows)
    with pytest.raises(Exception):  # noqa: B017  a version is committed once
        store._commit(last - 1, [])
    more = spark.createDataFrame([(9, 1.5)], "doc_id long, added double")
    store.append(more)
    assert store.read().where("doc_id = 9 and added = 1.5 and text is null").count() == 1 and store.read().where("added is null").count() == len(rows)


def test_store_without_a_version(spark):
    store = shards.Store(spark, scratch(spark, "store"))
    assert store.version() == 0 and store.compact() == 0
    with pytest.raises(ValueError):
        store.read()


@pytest.fixture(scope="module")
def no_rows(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_without_rows(spark, no_rows, name):
    assert queries.QUERIES[name](spark, no_rows).count() == (1 if name == "op5_chat_format" else 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, compare, name):
    compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name])


def test_runs_of_signs_and_apostrophes_are_cut():
    path = queries._tokenizer("byte_bpe_50k.json")
    cache, table = tokens.word_cache(path), tokens.byte_decoder(path)
    encode = lambda t: np.frombuffer(cache.encode([t])[0], "<u4")
    rng = random.Random(4)
    texts = ["!'" * 30_000, "_'" * 30_000, "'_" * 9000 + "s don't '" + "!''" * 9000]
    texts += ["".join(rng.choice(["'s", "'", "''", "!", "_", "'re", " ", "a", "'ll", "…"]) for _ in range(3000)) for _ in range(20)]
    for text in texts:
        size = 16_384 if len(text) > 20_000 else rng.choice([40, 100, 1000])
        pieces = bpe.cut_text(text, size, cache.special)
        assert "".join(p for p, _ in pieces) == text and max(len(p) for p, _ in pieces) <= 3 * size
        ids = bpe.join_tree([encode(p) for p, _ in pieces], [fused for _, fused in pieces], encode, table)
        assert ids.tobytes() == cache.raw([text])[0]
