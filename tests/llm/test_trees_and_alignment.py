"""SimHash components, Merkle manifests and token alignment against brute force over whole texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmere.llm import alignment, merkle, queries, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(prints, radius=4):
    """prints: {id: fingerprint}; smallest id reachable."""
    ids, part = sorted(prints), {}
    for i in ids:
        if i in part:
            continue
        part[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in part and (prints[x] ^ prints[y]).bit_count() <= radius:
                    part[y] = i
                    todo.append(y)
    return part


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    for size in (64, 31, 12, radius + 1):
        bits = rng.sample(range(64), size)
        every = simhash.masks(bits, radius)
        assert len(every) == 2 ** (radius + 1) - 1 and all(every)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(bits, min(radius, size)))
            assert any(not m & differ for m in every)


def test_simhash_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    parts = brute_parts(prints)
    found = queries.op13_simhash_near_dups(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}
    assert len(found) == len(docs)


@pytest.mark.parametrize("bucket", [16, 64])
def test_simhash_links_of_dense_buckets(spark, bucket):
    """Balls of many fingerprints, chains that leave them, and sparse ones; buckets are split several times."""
    rng = random.Random(bucket)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(400):
            prints.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}))
        for _ in range(12):
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.add(centre)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    low = rng.getrandbits(64) >> 12 << 12
    prints |= {low | x for x in range(0, 4096, 31)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, 4, bucket).collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)
    numbers = {p: i for i, p in enumerate(sorted(prints))}
    root = list(range(len(numbers)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(numbers[a]), find(numbers[b])))
        root[y] = x
    assert {i: find(i) for i in range(len(root))} == brute_parts({i: p for p, i in numbers.items()})


def test_simhash_bucket_too_small(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "print long"), 4, 8)


def test_simhash_of_nulls_repeats_and_other_columns(spark):
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(4, None), (2, ""), (9, " \t\n"), (7, "One two"), (3, "one  TWO"), (None, "one two"), (None, None), (7, "One two"), (5, long_text), (6, long_text + " End"), (8, "É \x1c x y z a")]
    docs = spark.createDataFrame([(i, t, "p", i) for i, t in rows], "doc_id long, text string, print string, component_id long")
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [(i, brute_print(t)) for i, t in rows]
    parts = brute_parts({i: p for i, p in prints if i is not None})
    assert found == Counter((i, f"{p:016x}", parts.get(i)) for i, p in prints)
    assert parts[4] == parts[9] == 2 and parts[7] == 3 and parts[6] == 5


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout=16):
    """rows of (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // fanout * fanout
            yield level[first:i], level[i + 1 : first + fanout]
            i //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in names}
    built = {s: grow([leaf(*r) for r in trees[s]]) for s in names}
    top = grow([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            steps = [*path(built[s], i), *path(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            held = leaf(r[0], r[1] if r[1] is None or not changed else lowered(r[1]), *r[2:])
            for before, after in steps:
                held = H(*before, held, *after)
            root = top[-1][0]
            out.append((r[0], leaf(*r), built[s][-1][0], root, H(*(x for b, a in steps for x in b + a)), held, held == root))
    return out


def manifest_of(docs):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(docs, columns, "source", "doc_id", changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect())


def test_manifest_of_many_heights(spark):
    rng = random.Random(5)
    rows = []
    for name, n in [(None, 17), ("", 1), ("a", 4097), ("b", 16), ("é", 257), ("Z", 2), *((f"s{i}", 1) for i in range(40))]:
        rows += [(rng.choice([rng.randrange(10_000), None]) if n == 17 else len(rows) * 3, rng.choice(["Some Text", "plain", "", None, "É x"]), rng.choice(["en", None, ""]), name, rng.choice([None, 3])) for _ in range(n)]
    rows += [rows[20], rows[20]]
    docs = spark.createDataFrame(rows, DOC).repartition(7)
    assert manifest_of(docs) == Counter(brute_manifest(rows))


def test_manifest_of_few_rows_and_clashing_names(spark):
    one = [(10, "Long " * 200_000, "en", "web", 7)]
    docs = spark.createDataFrame(one, DOC).withColumns({c: F.lit("x") for c in ("tree", "hash", "idx", "at", "name", "n", "root", "leaf")})
    found = manifest_of(docs)
    assert found == Counter(brute_manifest(one))
    assert manifest_of(docs.limit(0)) == Counter()
    two = [(None, None, None, None, None), (None, None, None, None, None)]
    assert manifest_of(spark.createDataFrame(two, DOC)) == Counter(brute_manifest(two))


def test_manifest_against_sql(spark, sf_dir, compare):
    compare(queries.op12_merkle_manifest(spark, sf_dir), queries.ORACLES["op12_merkle_manifest"])


@pytest.fixture(scope="module")
def pair():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries._tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries._tokenizer("piece_bpe_32k.model"))


def byte_characters():
    """The byte for which each character of a byte-level vocabulary stands."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def brute_alignment(pair, rows):
    a_model, b_model = pair
    alphabet = byte_characters()
    found, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        where_a, where_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
        links, groups, i, j = [], [], 0, 0
        for e in sorted(where_a.keys() & where_b.keys()):
            x, y = where_a[e], where_b[e]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        counts.update(links)
        found.append((doc_id, a, b, links, groups))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for doc_id, a, b, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return Counter(rows), {x: (n, n == most[x[1]]) for x, n in counts.items()}


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_on_documents(spark, sf_dir, pair):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_token_alignment(spark, sf_dir)
    assert Counter(tuple(r[n] for n in NAMES) for r in found.collect()) == brute_alignment(pair, [tuple(r) for r in docs])[0]


def test_alignment_of_odd_texts(spark, pair):
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\t", "\xa0", " ", "​", "\x1c", "\x85", "'s", "'re", "don't", "abc", "Äö", "日本語", "12345", "!?", "<|endoftext|>", "</s>", "<0x0A>", "é", "é", "🙂", "\x00", "﻿", "x", "Ġ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += [None, "", " ", "   ", "\n", "▁", "some ▁ mark", "some common words here", "some common words here", "w" * 50_000, "trailing ", " leading", "a  b   c", " ".join(f"w{i % 900}" for i in range(40_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "repeated id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, segment string").repartition(3)
    found, pairs = alignment.align(docs, queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model"), block_bytes=2_000)  # many blocks
    want, counts = brute_alignment(pair, rows)
    assert Counter(tuple(r[n] for n in NAMES) for r in found.collect()) == want
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == counts


def test_alignment_only_splits_where_it_may():
    assert alignment.cuts(queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model"))
    assert alignment.segments("a b  c\n d \xa0e") == ["a", "b", " c\n d", "\xa0e"]
    assert alignment.segments("a b", split=False) == ["a b"]


def test_alignment_packed_several_times_by_a_task(spark, pair, monkeypatch):
    """Segments of a block come in many packs, out of order; one of the texts has no tokens, so its links are taken off."""
    rng = random.Random(8)
    words = [f"{rng.choice(['a', 'Be', 'é', 'x9', '日'])}{rng.randrange(400)}" for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(60)] + [(60, " ".join([*words[:50], "▁"])), (61, ""), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(alignment, "PACK_PLACES", 20)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = alignment.align(docs, queries._tokenizer("byte_bpe_50k.json"), queries._tokenizer("piece_bpe_32k.model"), block_bytes=3_000)[0].collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert Counter(tuple(r[n] for n in NAMES) for r in found) == brute_alignment(pair, rows)[0]


@pytest.mark.parametrize("numbers", [[], [0], [5, 0, 70_000, 2**31]])
def test_packed_numbers(numbers):
    for kind in ("<u4", "<i8"):
        assert alignment.unpacked(alignment.packed(np.array(numbers, kind)), kind).tolist() == numbers
