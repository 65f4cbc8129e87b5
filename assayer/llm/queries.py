"""One query per operator, each over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, language_id, lexical, line_dedup, minhash, packing, periodic, quality_classifier, quality_rules, token_files, top_k, warc
from ._run import scratch, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = language_id.held_in("doc_id", 4, 2)
    model = quality_classifier.learn(docs, labels.where(learned))
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", (~learned).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.held_in("doc_id", 3, 1)
    profiles = language_id.learn(docs.where(learned))
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", (~learned).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_format.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return found.withColumn("spans", spans)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.dedup(docs.select("doc_id", "text"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read(spark, path))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    repeated = docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digests(periodic.detect(repeated))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_packing": op2_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_top_k": op8_top_k,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_files": op11_token_files,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
        ), b AS (
            SELECT page_id, strlen(body) AS payload_bytes, hex,
                array_to_string([format('{:04b}', strpos('0123456789abcdef', hex[i]) - 1) FOR i IN range(1, 41)], '') AS bits,
                max(page_id) OVER (PARTITION BY body) AS largest
            FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER)
                + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER) AS BIGINT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS NOT DISTINCT FROM largest THEN NULL ELSE largest END AS refers_to
        FROM b
    """,
    "op7_chat_formatting": """
        WITH rows AS (
            SELECT row_number() OVER () AS i, conv_id, CAST(turn AS BIGINT) AS t, replace(coalesce(text, ''), '<|', '< |') AS x,
                CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE regexp_replace(trim(role), '\\s+', '_', 'g') END AS r
            FROM conversations
        ), speakers AS (
            SELECT DISTINCT conv_id AS c, r AS perspective FROM rows WHERE r <> 'system'
        ), parts AS (
            SELECT i, conv_id, perspective, t, r, x, r = perspective AS mine,
                '<|im_start|>' || CASE WHEN r = perspective THEN 'assistant' WHEN r = 'system' THEN 'system' ELSE 'user name=' || r END || chr(10) AS head,
                x || '<|im_end|>' AS content
            FROM rows JOIN speakers ON conv_id IS NOT DISTINCT FROM c
        ), placed AS (
            SELECT *, length(head) + coalesce(sum(length(head) + length(content) + 1) OVER (
                PARTITION BY conv_id, perspective ORDER BY t NULLS FIRST, r, x, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM parts
        )
        SELECT conv_id, perspective, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS part, count(*) AS n_messages, false AS opened,
            string_agg(head || content || chr(10), '' ORDER BY start) AS text,
            coalesce(string_agg(CAST(start AS VARCHAR) || '-' || CAST(start + length(content) AS VARCHAR), ';' ORDER BY start) FILTER (WHERE mine), '') AS spans,
            CAST(coalesce(sum(length(content)) FILTER (WHERE mine), 0) AS BIGINT) AS n_target_chars
        FROM placed GROUP BY conv_id, perspective
    """,
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_lexical_search": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
            FROM documents WHERE text IS NOT NULL
        ), held AS (
            SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0
        ), totals AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM held
        ), items AS (
            SELECT item_id, max(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id
        ), asked AS (
            SELECT item_id, t, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM items
            ) GROUP BY ALL
        ), tf AS (
            SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM held) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
        ), w AS (
            SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY t
        ), scored AS (
            SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
            FROM tf JOIN asked USING (t) JOIN w USING (t), totals GROUP BY item_id, r, doc_id
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0 AND doc_id IS NOT NULL
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
