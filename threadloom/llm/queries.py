"""The queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import align, bpe, dac, exact, html, lexical, lines, minhash, mixing, packing, substrings, topk, toxicity
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, field).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return dac.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(table(spark, sf_dir, "documents")).drop("text", "row")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep=None).drop("kept", "row")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_bpe_round_trip, op3_html_text, op4_exact_topk, op5_minhash_dedup, op6_toxicity, op7_token_files, op8_line_dedup, op9_substring_dedup, op10_best_fit_packing, op11_token_alignment, op12_source_mix, op13_lexical_search)}

ORACLES = {
    "op1_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t""",
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
            FROM documents
        ), k AS (
            SELECT doc_id, line, n, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), c AS (
            SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), m AS (
            SELECT doc_id, line, n, key IN (SELECT key FROM c) AS gone FROM k
        )
        SELECT doc_id, count(*) AS n_lines, sum(CAST(gone AS BIGINT))::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op12_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY source NULLS LAST) AS BIGINT) AS no FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST([5, 2, 1][((no - 1) % 3) + 1] AS BIGINT) AS w, (n + 8191) // 8192 AS shards, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
        ), r AS (
            SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, no) AS k FROM w
        ), c AS (
            SELECT *, total - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS free,
                CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM r
        ), level AS (
            SELECT k AS lk, free AS lfree, open AS lopen FROM c WHERE NOT free * w > 3 * source_size * open ORDER BY k LIMIT 1
        ), t AS (
            SELECT c.*, CASE WHEN lk IS NULL OR k < lk THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(lfree AS DOUBLE) / CAST(lopen AS DOUBLE) * w END AS target
            FROM c LEFT JOIN level ON true
        ), q AS (
            SELECT no, g, target / (2 * g + 1) AS quotient, (total + 8) // 16 AS seats
            FROM (SELECT no, target, total, unnest(range(0, CAST(target / 16 AS BIGINT) + (SELECT count(*) FROM s) + 2)) AS g FROM t WHERE target > 0)
        ), quota AS (
            SELECT no, CAST(count(*) AS BIGINT) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, no, g) AS place FROM q) WHERE place <= seats GROUP BY no
        ), dealt AS (
            SELECT d.*, t.no, t.source_size, t.target, ('0x' || substr(draw, 1, 8))::BIGINT % t.shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), cells AS (
            SELECT no, shard, CAST(sum(size) AS BIGINT) AS words, any_value(source_size) AS source_size, CAST(count(*) OVER (PARTITION BY no) AS BIGINT) AS n FROM dealt GROUP BY no, shard
        ), qs AS (
            SELECT no, shard, g, words / (2 * g + 1) AS quotient, seats
            FROM (SELECT no, shard, CAST(words AS DOUBLE) AS words, seats, unnest(range(0, CAST(words * seats / source_size AS BIGINT) + n + 2)) AS g FROM cells JOIN quota USING (no) WHERE words > 0)
        ), shares AS (
            SELECT no, shard, CAST(count(*) AS BIGINT) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY quotient DESC, shard, g) AS place FROM qs) WHERE place <= seats GROUP BY no, shard
        ), b AS (
            SELECT no, shard, words, (words + 15) // 16 AS blocks, least(coalesce(quota, 0), 3 * ((words + 15) // 16)) AS quota,
                ('0x' || substr(md5('mix:' || CAST(no AS VARCHAR) || '/' || CAST(shard AS VARCHAR)), 1, 8))::BIGINT % ((words + 15) // 16) AS f
            FROM cells LEFT JOIN shares USING (no, shard) WHERE words > 0
        ), e AS (
            SELECT no, shard, words, blocks, quota // blocks AS copies, f AS k1, least(f + quota % blocks, blocks) AS k2, greatest(f + quota % blocks - blocks, 0) AS k3 FROM b
        ), cut AS (
            SELECT no, shard, copies, k1 * (words // blocks) + least(k1, words % blocks) AS a1, k2 * (words // blocks) + least(k2, words % blocks) AS b1, k3 * (words // blocks) + least(k3, words % blocks) AS b2 FROM e
        ), placed AS (
            SELECT *, CAST(sum(size) OVER (PARTITION BY no, shard ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS st FROM dealt
        )
        SELECT doc_id, size, source_size, target, CAST(coalesce(copies * size
            + greatest(0, least(size, b1 - st) - greatest(0, a1 - st)) + greatest(0, least(size, b2 - st)), 0) AS BIGINT) AS taken
        FROM placed LEFT JOIN cut USING (no, shard)""",
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
        ), s AS (
            SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0
        ), q AS (
            SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
        ), p AS (
            SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term), s
        ), c AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nd) // l)))) AS c FROM p JOIN w USING (term), s
        ), r AS (
            SELECT item_id, doc_id, CAST(sum(times * c) AS BIGINT) AS score FROM c JOIN q USING (term) GROUP BY item_id, doc_id
        ), o AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
