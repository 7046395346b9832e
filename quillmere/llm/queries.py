"""The registered queries of the operators, opN_<name>, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontaminate, licenses, merkle, near_dups, permutation_index, shards, simhash, token_files, toxicity, warc
from ._spark import saved, scratch


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    folder = scratch(spark, "token-bundle")
    files = token_files.write_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), folder, end_id=1)
    read = token_files.read_tokens(spark, folder, files)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in 16 arrivals, compacted, and read back from the last committed version."""
    store = shards.Store(spark, scratch(spark, "store"))
    store.append(_table(spark, sf_dir, "documents").withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(16)), F.lit(0)).cast("int")), by="arrival")
    store.compact()
    store.vacuum()
    text = F.col("text").cast("binary")
    return store.read().select("doc_id", "arrival", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2(text, 256).alias("text_sha256"), "lang", "source", "n_chars")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, written and read back."""
    path, size = _tokenizer("byte_bpe_50k.json"), 50_257
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.extra_conversation(spark))
    return chat.read_back(saved(chat.format_conversations(turns, path, size), "chat"), path, size)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to seekable archives and read back."""
    folder = scratch(spark, "warc")
    warc.write_bundles(_table(spark, sf_dir, "pages"), folder)
    return warc.read_bundles(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's 5-word shingles."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the texts decoded from them."""
    path = _tokenizer("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20, among all others."""
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), top=20)


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on 4-word shingles at 0.8."""
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), words=4, similarity=0.8).drop("text_hash")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; the field is fitted on labelled rows that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels), spans=False)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned over all documents."""
    return alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))[0]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and their check where a fifth of them is lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], group="source", order="doc_id", changed=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose SimHash fingerprints differ in at most 4 bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_permutation_index": op2_permutation_index,
    "op3_minhash_near_dups": op3_minhash_near_dups,
    "op4_compacted_shards": op4_compacted_shards,
    "op5_chat_format": op5_chat_format,
    "op6_license_scan": op6_license_scan,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash_near_dups": op13_simhash_near_dups,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op12_merkle_manifest": r"""
        WITH RECURSIVE given AS (
            SELECT *, regexp_extract_all(CAST(doc_id AS VARCHAR), '.') AS digits,
                   concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                             coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM documents
        ), summed AS (  -- CRC-32, bit by bit
            SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(digits, lambda d: CAST(ascii(d) AS BIGINT))),
                       lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
            FROM given
        ), leaves AS (
            SELECT doc_id, source, sha256(head || tail) AS h,
                   CASE WHEN crc % 5 = 0 THEN sha256(head || translate(tail, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) ELSE sha256(head || tail) END AS other
            FROM summed
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
                   count(*) OVER (PARTITION BY source) AS n
            FROM leaves
        ), nodes AS (
            SELECT 0 AS level, tree, idx, n, h FROM placed
            UNION ALL
            SELECT level + 1, tree, idx // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, tree, idx // 16
        ), subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
        tops AS (
            SELECT 1000 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, idx // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 16
        ), every AS (SELECT * FROM nodes WHERE n > 1 UNION ALL SELECT level, -1, idx, n, h FROM tops WHERE n > 1),
        sides AS (
            SELECT level, tree, idx, n, coalesce(string_agg(h, '' ORDER BY idx) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '' ORDER BY idx) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM every WINDOW run AS (PARTITION BY level, tree, idx // 16 ORDER BY idx)
        ), inside AS (
            SELECT tree, idx AS doc_idx, 0 AS level, idx, other AS held, '' AS proof FROM placed
            UNION ALL
            SELECT w.tree, doc_idx, w.level + 1, w.idx // 16, sha256(s.l || held || s.r), proof || s.l || s.r FROM inside w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx
        ), outside AS (
            SELECT tree, doc_idx, 1000 AS level, tree AS idx, max_by(held, level) AS held, max_by(proof, level) AS proof FROM inside GROUP BY tree, doc_idx
            UNION ALL
            SELECT w.tree, doc_idx, w.level + 1, w.idx // 16, sha256(s.l || held || s.r), proof || s.l || s.r FROM outside w JOIN sides s ON s.tree = -1 AND s.level = w.level AND s.idx = w.idx
        ), ended AS (SELECT tree, doc_idx, max_by(held, level) AS folded_root, sha256(max_by(proof, level)) AS proof_sha256 FROM outside GROUP BY tree, doc_idx)
        SELECT p.doc_id, p.h AS leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT h FROM tops WHERE n = 1) AS verified
        FROM placed p JOIN subroots USING (tree) JOIN ended ON ended.tree = p.tree AND doc_idx = p.idx
    """,
    "op3_minhash_near_dups": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 3], ' ')) AS run FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(p) WHERE len(w) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        sets AS (SELECT doc_id, n, list_sort(list(run)) AS runs FROM s JOIN n USING (doc_id) GROUP BY ALL),
        named AS (SELECT n, runs, min(doc_id) AS class_id FROM sets GROUP BY ALL),
        member AS (SELECT doc_id, class_id FROM sets JOIN named USING (n, runs)),
        posted AS (SELECT s.doc_id, run, n FROM s JOIN n USING (doc_id) SEMI JOIN named ON named.class_id = s.doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c FROM posted a JOIN posted b ON a.run = b.run AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
        linked AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (total - c)),
        arcs AS (SELECT a AS x, b AS y FROM linked UNION ALL SELECT b, a FROM linked),
        reach AS (SELECT DISTINCT x AS first, x AS met FROM arcs UNION SELECT first, y FROM reach JOIN arcs ON x = met),
        least_of AS (SELECT first AS class_id, min(met) AS component_id FROM reach GROUP BY first)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, m.class_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, m.class_id, d.doc_id) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN member m USING (doc_id) LEFT JOIN least_of l USING (class_id)
    """,
    "op4_compacted_shards": """
        SELECT doc_id, CAST(coalesce(((doc_id % 16) + 16) % 16, 0) AS INTEGER) AS arrival,
               octet_length(encode(text)) AS text_bytes, sha256(text) AS text_sha256, lang, source, n_chars
        FROM documents
    """,
    "op8_benchmark_leaks": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), i AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
        ), ir AS (
            SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS run
            FROM i, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(p) WHERE len(w) > 0
        ), dr AS (
            SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS run
            FROM d, (SELECT DISTINCT k FROM ir) AS ks, unnest(range(1, len(w) - k + 2)) AS u(p)
        ), n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM ir GROUP BY item_id),
        c AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_common FROM ir JOIN dr USING (k, run) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 80 * n_item
    """,
    "op5_chat_format": r"""
        WITH all_turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, regexp_replace(role, '(\\*)(<turn>|</turn>|### System:|### User:|### Assistant:|<\|endoftext\|>)', '\1\1\\\2', 'g') AS r,
                   regexp_replace(text, '(\\*)(<turn>|</turn>|### System:|### User:|### Assistant:|<\|endoftext\|>)', '\1\1\\\2', 'g') AS t
            FROM all_turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(r) + length(t) + 17) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op7_warc_bundles": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM q
    """,
}
