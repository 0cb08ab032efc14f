"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import bpe, chat, jaccard, licenses, linedup, media, packing, pii, quality, rules, stats
from isohyet.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.col("_base")
    return got.select("doc_id", *map(n, pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.concat(base, F.col("_terms"))).alias("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.families(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.read(media.store(table(spark, sf_dir, "documents")))
    size = F.octet_length("pixels")
    return got.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, octet_length(pixels) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("width").cast("string"), F.col("height").cast("string"), "thumbnail_hash").alias("feature"),
    )


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return got.select("doc_id", *[F.col("counts")[stats.COUNTS.index(c)].alias(c) for c in base], "base_failed", "height", "kept")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    got = chat.format_chats(rows.unionByName(probe))
    loss = chat.masked_text(F.col("formatted"), F.col("mask"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
template(role, extra) AS (VALUES ('user', 18), ('assistant', 6), ('system', 19)),
folded AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(rows.role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, rows.role, text) AS turns,
           coalesce(string_agg(CASE WHEN rows.role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, rows.role, text), '') AS loss,
           sum(length(text) + coalesce(extra, 16 + length(rows.role)) + CASE
               WHEN contains(text, chr(92) || chr(92)) OR contains(text, chr(92) || '[') OR contains(text, chr(92) || '<') OR contains(text, chr(92) || '>')
                 OR (rows.role = 'user' AND contains(text, ' [/INST]')) OR (rows.role = 'assistant' AND contains(text, ' </s>'))
                 OR (rows.role = 'system' AND contains(text, chr(10) || '<</SYS>>' || chr(10) || chr(10)))
               THEN length(regexp_replace(text, '[^\\\\\\[<>]', '', 'g')) ELSE 0 END) AS formatted_chars
    FROM rows LEFT JOIN template USING (role) GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM folded
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = linedup.dedup(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")))
    return got.select(
        "doc_id",
        "n_lines",
        F.size("_lost").cast("long").alias("n_deleted"),
        F.concat_ws(",", F.col("_lost").cast("array<string>")).alias("deleted_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )


OP8_SQL = """
WITH parts AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
),
numbered AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS n FROM parts
),
counted AS (
    SELECT *, least(10, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS words FROM numbered
),
full_lines AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM counted WHERE words > 0
),
ahead AS (
    SELECT a.doc_id, a.i, b.i - a.i + 1 AS size,
           sum(b.words) OVER w AS total, string_agg(b.line, chr(10)) OVER w AS run
    FROM full_lines a JOIN full_lines b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 9
    WINDOW w AS (PARTITION BY a.doc_id, a.i ORDER BY b.i)
),
behind AS (
    SELECT a.doc_id, b.i, a.i - b.i + 1 AS size,
           sum(b.words) OVER (PARTITION BY a.doc_id, a.i ORDER BY b.i DESC) AS total,
           string_agg(b.line, chr(10)) OVER (PARTITION BY a.doc_id, a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run,
           a.i AS last
    FROM full_lines a JOIN full_lines b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - 9 AND a.i
),
runs AS (
    SELECT doc_id, i, size, run FROM ahead WHERE total >= 10
    QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY size) = 1
    UNION
    SELECT doc_id, i, size, run FROM (SELECT * FROM behind WHERE total >= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, last ORDER BY size) = 1)
),
later AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy FROM runs) WHERE copy > 1
),
gone AS (
    SELECT DISTINCT f.doc_id, f.n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS i FROM later) l JOIN full_lines f USING (doc_id, i)
)
SELECT doc_id, len(lines) AS n_lines, coalesce(len(lost), 0)::BIGINT AS n_deleted,
       coalesce(array_to_string(lost, ','), '') AS deleted_lines,
       sha256(CASE WHEN lost IS NULL THEN text ELSE coalesce(kept, '') END) AS text_sha256
FROM parts
LEFT JOIN (SELECT doc_id, list(n ORDER BY n) AS lost FROM gone GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS kept FROM numbered ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id) USING (doc_id)
"""


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_licenses": op2_licenses,
        "op3_quality": op3_quality,
        "op4_pack": op4_pack,
        "op5_media": op5_media,
        "op6_rules": op6_rules,
        "op7_chat": op7_chat,
        "op8_line_dedup": op8_line_dedup,
        "op9_jaccard": op9_jaccard,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL, "op8_line_dedup": OP8_SQL}
