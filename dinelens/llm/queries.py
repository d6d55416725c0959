"""Queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinelens.llm import chat, decontaminate, divergence, exact_dedup, html_text, language_id, neighbours, packing, secret_scan, simhash, spelling, token_files, toxicity
from dinelens.llm.common import table
from dinelens.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by four kinds of evidence, all documents by text and source; the other table's id is NULL."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    names, model = language_id.train_text(docs)
    none = F.lit(None).cast("long")
    of_pages = language_id.identify(language_id.page_records(pages), names, model).withColumn("doc_id", none)
    of_docs = language_id.identify(language_id.document_records(docs), names, model)
    of_docs = of_docs.withColumn("page_id", none).withColumn("url", F.lit(None).cast("string"))
    columns = ["doc_id", "page_id", "url", "lang", "probability", "text_lang"]
    return of_pages.select(*columns).unionByName(of_docs.select(*columns))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.span_digests(secret_scan.scan(docs, secret_scan.train(docs)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), path, end_id=2)
    found = token_files.read_token_files(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


PROBE_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE_TEXT).alias("text"))
    formatted = chat.format_conversations(given.unionByName(probe))
    return chat.digests(chat.read_back(formatted))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_chars=6, least_count=5, divisor=199, factor=5)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), top_terms=200)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_language_id": op2_language_id,
        "op3_html_text": op3_html_text,
        "op4_decontaminate": op4_decontaminate,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_toxicity": op8_toxicity,
        "op9_token_files": op9_token_files,
        "op10_chat_format": op10_chat_format,
        "op11_nearest_neighbours": op11_nearest_neighbours,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM dw WHERE len(w) > 0
), its AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM iw WHERE len(w) > 0
), q AS (SELECT item_id, count(*) AS q FROM its GROUP BY item_id
), hit AS (
  SELECT ds.doc_id, its.item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY ALL
), kept AS (
  SELECT doc_id, item_id, shared / q AS containment FROM hit JOIN q USING (item_id) WHERE shared >= ceil(q * 0.8 - 1e-9)
), per AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(containment) AS most
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(items, '') AS item_ids,
       coalesce(most, 0.0) AS max_containment
FROM documents d LEFT JOIN per USING (doc_id)
""",
        "op5_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""",
        "op10_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS first,
         length(regexp_replace(text, '(\\|</turn>|<next>|###)', '\\\1', 'g')) AS n_text,
         length(regexp_replace(role, '(\\|</turn>|<next>|###|:)', '\\\1', 'g')) AS n_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN first THEN n_role + 4 + 3 + 9 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
        "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (SELECT id, lang, source, unnest(terms) AS term FROM d
), kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v.v) AS p
  FROM cells JOIN v USING (lang)
), l AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v.v) AS q FROM l JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  GROUP BY ALL
), terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    }
