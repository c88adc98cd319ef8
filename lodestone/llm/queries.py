"""The registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import embeddings, langid, licenses, lines, mixing, neardup, packing, quality, templates, toxicity
from lodestone.llm.common import crc_bucket, read


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1 formatted, and what reads back from the output."""
    return templates.digest_conversations(templates.format_conversations(templates.with_probe(read(spark, sf_dir, "conversations"))))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of a label at cosine 0.98."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without the lines that five documents share, but in the last one."""
    out = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every whole text of documents."""
    return licenses.license_report(licenses.scan_licenses(read(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of every whole text of documents under the base rules and policy v1."""
    book = quality.ledger(read(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.apply_policy(book, "base")).alias("base_failed"), quality.apply_policy(book, "v1").alias("kept"), F.col("fail_bits"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at five words and a similarity of 0.8."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents' sources by weights 5, 2, 1 takes of each document."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learned from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.train(docs)).select("doc_id", (crc_bucket(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_lines": op2_lines,
    "op3_licenses": op3_licenses,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}

ORACLE: dict[str, str] = {
    "op1_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT *, label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0 AS ok FROM v
), l AS (
  SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT k, k AS at FROM u UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.at
), c AS (
  SELECT r.k, min(u.vec_id) AS component FROM r JOIN u ON u.k = r.at GROUP BY r.k
)
SELECT u.vec_id, (SELECT count(*) FROM l WHERE l.a = u.k) AS n_links, c.component AS component_id,
       coalesce(u.vec_id = c.component, TRUE) AS kept
FROM u JOIN c ON u.k = c.k
""",
    "op6_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, role = 'assistant' AS own, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))
    + length('<|turn|><|text|></s>') + 1 + CASE WHEN role = 'assistant' THEN length('[INST][/INST]') ELSE 0 END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op2_lines": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT k, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT k, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), c AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT k) >= 5
)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (c.last <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.last IS NULL OR c.last = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN c ON l.key = c.key
GROUP BY l.k
""",
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 3 AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM s
), lv AS (
  SELECT arg_min((total - capped) / opened, capped) AS lvl FROM r WHERE (total - capped) / opened <= cap / weight
), t AS (
  SELECT source, source_size, least(cap, weight * lvl) AS target FROM r, lv
), e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t
), b AS (
  SELECT *, target - epochs * source_size AS budget FROM e
), hs AS (
  SELECT source, h, sum(size) AS n FROM d GROUP BY source, h
), c AS (
  SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM hs
), x AS (
  SELECT c.source, c.h, upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n)) AS extra
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
)
SELECT d.doc_id, d.size, b.source_size, b.target, d.source,
       CAST(least(b.epochs + CASE WHEN x.extra AND b.budget > 0 THEN 1 ELSE 0 END, 3) AS INTEGER) AS copies,
       CAST(d.size * least(b.epochs + CASE WHEN x.extra AND b.budget > 0 THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
""",
    "op8_quality": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), g AS (
  SELECT k, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram, i
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), f AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g
), r AS (
  SELECT k, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT k, i + o AS p FROM f, (VALUES (0), (1), (2)) v(o) WHERE n > 1) GROUP BY k
), l AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), m AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
  FROM d JOIN w ON d.k = w.k LEFT JOIN r ON d.k = r.k LEFT JOIN l ON d.k = l.k
), b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_capitals > 5 * word_chars THEN 64 ELSE 0 END + CASE WHEN 10 * n_exclamations > 5 * n_words THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
""",
}
