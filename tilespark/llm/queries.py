"""The registered queries of the llm operators, over their whole tables."""

from tilespark.llm import compression, decontaminate, lm, matrix, packing, pii, quality, simhash, tokens, warc
from tilespark.session import table


def op1_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("base_spans")


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_compression(spark, sf_dir):
    return compression.rules(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_tokens(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_cross_entropy(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_matrix(spark, sf_dir):
    return matrix.packed(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_warc, op4_compression, op5_simhash, op6_tokens, op7_quality, op8_packing, op9_cross_entropy, op10_matrix)}

#: DuckDB SQL over the same tables, where SQL can express a query's result.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op2_decontamination": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
        bn AS (SELECT item, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
        bk AS (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM bn),
        bw AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM bk),
        dk AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
        dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM dk),
        hits AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (n, g)),
        places AS (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(h, 1 + 5 * (g // 4), 5))::BIGINT >> (5 * (3 - g % 4)) AS INTEGER) % 32 + 1, 1) FOR g IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM t""",
}
