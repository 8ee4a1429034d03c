"""Registered queries of the operators, with the SQL that agrees with them where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import (
    decontaminate,
    exact_dedup,
    hilbert,
    html_text,
    merkle,
    packed_ids,
    prefix_trie,
    quality,
    quality_rules,
    sentence_pieces,
    simhash,
    token_counts,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = packed_ids.new_folder(spark)
    docs = table(spark, sf_dir, "documents")
    return packed_ids.read_ids(packed_ids.write_ids(docs, folder, tokenizer("byte_bpe_50k.json")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.encoded_documents(docs, tokenizer("piece_bpe_32k.model"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.curve_shards(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted_pages(pages, html_text.fit(pages))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_token_binary": op1_token_binary,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
}

#: CTEs of a function that DuckDB lacks: crc(v, crc32) of the texts v in `values_of`.
_CRC = """
        crc_table AS (
            SELECT list(t ORDER BY b) AS t FROM (
                SELECT b, list_reduce(list_prepend(b, range(8)),
                    lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS t
                FROM (SELECT unnest(range(256)) AS b))
        ), crc AS (
            SELECT v, xor(list_reduce(list_prepend(4294967295, list_transform(str_split(v, ''), lambda x: ord(x)::BIGINT)),
                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc32
            FROM (SELECT DISTINCT v FROM values_of), crc_table
        )"""

ORACLE = {
    "op4_decontamination": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), item_grams AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n,
                array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
                  FROM item_words WHERE len(w) > 0)
        ), sizes AS (
            SELECT DISTINCT n FROM item_grams
        ), grams AS (
            SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM words, sizes WHERE len(w) >= n)
        ), hits AS (
            SELECT doc_id, i, n, item_id FROM grams JOIN item_grams USING (n, gram)
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op6_exact_dedup": r"""
        WITH digests AS (
            SELECT doc_id,
                sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM digests WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op11_prefix_trie": rf"""
        WITH turns AS (
            SELECT c, size, tid, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) - 1 AS pos
            FROM (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS size,
                      sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))[:32] AS tid
                  FROM conversations WHERE conv_id IS NOT NULL)
        ), values_of AS (
            SELECT DISTINCT CAST(c AS VARCHAR) AS v FROM turns
        ), {_CRC}, convs AS (
            SELECT DISTINCT c, c - c % 5 AS family, crc32 % 9 AS h
            FROM turns JOIN crc ON v = CAST(c AS VARCHAR)
        ), rebuilt AS (
            SELECT c, 0 AS part, pos, tid, size FROM convs JOIN (SELECT c AS family, pos, tid, size FROM turns) USING (family)
            WHERE pos < h
            UNION ALL
            SELECT c, 1, pos, tid, size FROM convs JOIN turns USING (c) WHERE pos >= h
        ), paths AS (
            SELECT c, coalesce(list(tid ORDER BY part, pos) FILTER (tid IS NOT NULL), []) AS ids,
                coalesce(list(size ORDER BY part, pos) FILTER (tid IS NOT NULL), []) AS sizes
            FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
        ), beginnings AS (
            SELECT c, d, len(ids) = d AS here, array_to_string(ids[1:d], '') AS node,
                CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], '') END AS up, coalesce(sizes[d], 0) AS size
            FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM paths)
        ), nodes AS (
            SELECT node, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
                (count(*) - 1) * any_value(size) AS saved,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (here), '')) AS ends_sha256
            FROM beginnings GROUP BY node
        ), children AS (
            SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), below AS (
            SELECT node[:32 * a] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n IS NULL) AS n_leaves
            FROM (SELECT node, saved, n, unnest(range(depth + 1)) AS a FROM nodes LEFT JOIN children USING (node))
            GROUP BY ALL
        )
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n, 0) AS n_children,
            n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM nodes v JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = v.up
    """,
    "op12_merkle_manifest": rf"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS v, text,
                concat(coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)), '-'),
                    coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
                    coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', CAST(n_chars AS VARCHAR)), '-')) AS head
            FROM documents
        ), values_of AS (
            SELECT v FROM fields WHERE v IS NOT NULL
        ), {_CRC}, leaves AS (
            SELECT doc_id, lang, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
                CASE WHEN crc32 % 3 = 0 THEN sha256(concat(head, coalesce(concat(strlen(text), ':',
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-'))) END AS tampered
            FROM fields LEFT JOIN crc USING (v)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
        ), tree AS (
            SELECT lang, 0 AS level, pos, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM placed
            UNION ALL
            SELECT lang, any_value(level) + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 7) // 8
            FROM tree WHERE n > 1 GROUP BY lang, pos // 8
        ), subroots AS (
            SELECT lang, level AS height, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
            FROM tree WHERE n = 1
        ), upper AS (
            SELECT 0 AS level, place AS pos, subroot AS hash, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 7) // 8
            FROM upper WHERE n > 1 GROUP BY pos // 8
        ), sides AS (
            SELECT p.lang, p.pos AS leaf_pos, t.level, string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos < t.pos) AS l,
                string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos > t.pos) AS r
            FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1
                AND t.pos = p.pos // CAST(pow(8, t.level) AS BIGINT)
            JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.pos // 8 = t.pos // 8
            GROUP BY ALL
        ), upper_sides AS (
            SELECT b.lang, b.height + u.level AS level, string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos < u.pos) AS l,
                string_agg(s.hash, '' ORDER BY s.pos) FILTER (s.pos > u.pos) AS r
            FROM subroots b JOIN upper u ON u.n > 1 AND u.pos = b.place // CAST(pow(8, u.level) AS BIGINT)
            JOIN upper s ON s.level = u.level AND s.pos // 8 = u.pos // 8 GROUP BY ALL
        ), paths AS (
            SELECT lang, leaf_pos, level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM sides
            UNION ALL
            SELECT p.lang, p.pos, level, coalesce(l, ''), coalesce(r, '')
            FROM placed p JOIN upper_sides u ON u.lang IS NOT DISTINCT FROM p.lang
        ), folded AS (
            SELECT lang, pos, 0 AS level, coalesce(tampered, leaf) AS hash FROM placed
            UNION ALL
            SELECT f.lang, f.pos, f.level + 1, sha256(concat(l, hash, r))
            FROM folded f JOIN paths p ON p.lang IS NOT DISTINCT FROM f.lang AND p.leaf_pos = f.pos AND p.level = f.level
        ), ended AS (
            SELECT lang, pos, arg_max(hash, level) AS folded_root FROM folded GROUP BY ALL
        ), proofs AS (
            SELECT lang, leaf_pos AS pos, sha256(string_agg(concat(l, r), '' ORDER BY level)) AS proof_sha256
            FROM paths GROUP BY ALL
        )
        SELECT doc_id, leaf, subroot, hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
            folded_root = hash AS verified
        FROM placed p JOIN subroots b ON b.lang IS NOT DISTINCT FROM p.lang
        JOIN ended e ON e.lang IS NOT DISTINCT FROM p.lang AND e.pos = p.pos
        LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
        CROSS JOIN (SELECT hash FROM upper WHERE n = 1)
    """,
}
