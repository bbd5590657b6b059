"""The queries of this subpackage's operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm import bpe, html_extract, langid, line_dedup, minhash, mixing, quality_pu, quality_rules, token_counts, topk
from tabguard.llm.common import held_out, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.bpe(docs, path, ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
    return quality_rules.quality_rules(docs).select(*names.split())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed_lines", "kept", "text")


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality_pu.fit(docs, table(spark, sf_dir, "labels"))
    return quality_pu.classify(docs, network).select("doc_id", "held_out", "score", "predicted")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, carry=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_counts.token_counts(docs, path, public_tokenizers.PATTERN).drop("text")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bpe,
        op2_html_extraction,
        op3_quality_rules,
        op4_line_dedup,
        op5_quality_pu,
        op6_topk,
        op7_minhash,
        op8_mixing,
        op9_token_counts,
        op10_langid,
    )
    return {f.__name__: f for f in found}


OP3_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dups
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid
), stops AS (
  SELECT rid, count(*) AS n FROM (SELECT rid, unnest(w) AS x FROM d)
  WHERE lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}) GROUP BY rid
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclamations,
         coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.dups, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(stops.n, 0)::BIGINT AS n_stop_words
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN stops USING (rid)
), b AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
         OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {quality_rules.rules_sql()} AS kept
FROM b
"""

OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id AS query_id, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM e WHERE vec_id % 100 = 0
), c AS (
  SELECT vec_id, unnest(v) AS b, generate_subscripts(v, 1) AS i FROM e
), s AS (
  SELECT query_id, vec_id, sum(a * b)::BIGINT AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
         coalesce('=' || source, 'null') AS g
  FROM documents
), s AS (
  SELECT g, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS lim,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
  FROM d GROUP BY g, source
), f AS (
  SELECT *, 3 * sum(source_size) OVER ()
            - 2 * coalesce(sum(lim) OVER (ORDER BY lim / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY lim / w, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s
), o AS (
  SELECT *, rest * w <= 2 * lim * open_w AS is_open FROM f
), l AS (
  SELECT max(open_w) AS open_w, max_by(rest, open_w) AS rest FROM o WHERE is_open
), t AS (
  SELECT g, source_size, CASE WHEN is_open THEN (w * l.rest)::DOUBLE / (2 * l.open_w)::DOUBLE ELSE lim::DOUBLE END AS target
  FROM o, l
), p AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY g ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS e
  FROM d JOIN t USING (g)
), c AS (
  SELECT *, coalesce((c * source_size + e)::DOUBLE / nullif(target, 0), 0) AS v FROM p, (VALUES (0), (1)) AS x(c)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY v, g, c, k, e ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS twice FROM c
)
SELECT doc_id, size, source_size, target,
       coalesce(sum(size) FILTER (WHERE run <= 0.75 * twice), 0)::BIGINT AS taken
FROM r GROUP BY doc_id, size, source_size, target, k, e
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op6_topk": OP6_SQL, "op8_mixing": OP8_SQL}
