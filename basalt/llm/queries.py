"""The queries op1 to op10, and what SQL can say of them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, lines, minhash, mixing, pii, quality, search, sharding, toxicity, urls
from .common import bounded_batches

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The key of this data set's surrogates; a production key is a secret.
KEY = b"basalt example key"


def table(spark, sf_dir: str, name: str):
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, RULES))


def op2_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_quality_rules(spark, sf_dir):
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", *quality.MEASURES[:5], "base_failed", "kept", "n_lines")


def op4_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op6_top_k_search(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_pii_surrogates(spark, sf_dir):
    return pii.private_texts(table(spark, sf_dir, "documents"), KEY)


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filters, op2_minhash_dedup, op3_quality_rules, op4_mixing, op5_line_dedup, op6_top_k_search, op7_byte_bpe, op8_pii_surrogates, op9_sharding, op10_toxicity)}


WORD = r"[^\x20\x09-\x0D]+"
#: Strips ASCII white space at both ends.
STRIP = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_url_filters": f"""
        WITH rules(r_verdict, r_host, r_path) AS (VALUES {", ".join(f"('{v}', '{r.split('/')[0]}', '{r[r.index('/'):]}')" for v, r in RULES)}),
        rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, {ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
        fits AS (SELECT n, r_verdict, r_host || r_path AS rule, row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC) AS r
                 FROM numbered JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM numbered LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (n)""",
    "op3_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM t),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        five AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS gram
                 FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM five WHERE gram IS NOT NULL),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
        d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
        m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM w LEFT JOIN d USING (doc_id) LEFT JOIN covered USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 9 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept, CAST(n_lines AS BIGINT) AS n_lines
        FROM m""",
    "op4_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS whole FROM s),
        o AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
                     sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
        f AS (SELECT *, (whole - coalesce(capped, 0)) / rest >= cap / weight AS is_full FROM o),
        t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE CAST(weight AS DOUBLE) * (whole - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM f),
        n AS (SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CASE WHEN source_size > 0 THEN CAST(target AS DOUBLE) / source_size ELSE 0 END AS rate,
                     CAST(CAST('0x' || substr(md5('offset7' || coalesce(d.source, '') || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END), 1, 8) AS UBIGINT) >> 12 AS DOUBLE) / 1048576 AS draw,
                     row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 8 + ((size << 4) >> length(bin(size))), key) AS nth
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(floor(nth * rate + draw) - floor((nth - 1) * rate + draw) AS BIGINT) * size AS taken FROM n""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
        k AS (SELECT *, {ASCII_LOWER.format(STRIP.format("line"))} AS key FROM l),
        shared AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.*, holder IS NOT NULL AND doc_id IS DISTINCT FROM holder AS gone FROM k LEFT JOIN shared USING (key))
        SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM j GROUP BY r""",
    "op6_top_k_search": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
