"""The registered queries of the text operators over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import (
    checks, hostquality, htmltext, langid, lm, merkle, mixing, packing, passages, ranked, rules, simhash, spelling, urlfilter,
)
from tickframe.llm.common import crc_bucket, saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)
    return langid.predict(docs, ["doc_id", "held_out"], langid.train(docs, ~F.col("held_out")))


@query
def op3_mixing(spark, sf_dir):
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op3_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    greatest(0.05, coalesce(length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g'))
      / nullif(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')), 0), 0.0)) AS quality,
    CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS drawn
  FROM documents),
k AS (SELECT *, -ln((drawn + 0.5) / 281474976710656.0::DOUBLE) / quality AS key FROM d),
s AS (
  SELECT source, sum(size) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
f AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
      - coalesce(sum(2 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW r AS (ORDER BY source_size / weight, source IS NULL, source)),
g AS (SELECT *, (SELECT level FROM f WHERE level * weight < 2 * source_size
        ORDER BY source_size / weight, source IS NULL, source LIMIT 1) AS stop FROM f),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
        CAST(least(coalesce(stop, 1e300) * weight, 2 * source_size) AS DOUBLE) AS target FROM g),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0
    AND 2 * ahead + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""


@query
def op4_simhash(spark, sf_dir):
    prints = saved(simhash.fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "prints")
    grouped = simhash.near_groups(prints, "doc_id", bits=4)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, ["page_id", "url"], htmltext.train(htmltext.sample_pages(pages, "page_id", "html")))


@query
def op6_merkle(spark, sf_dir):
    return merkle.fingerprinted(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_substring_dedup(spark, sf_dir):
    clean = passages.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "text", F.col("_llm_removed").alias("removed"), F.col("_llm_n_removed").alias("n_removed_units"))


@query
def op8_lm_scores(spark, sf_dir):
    held_out = crc_bucket(F.col("doc_id"), 10) == 0
    return lm.scored(table(spark, sf_dir, "documents"), held_out, own_vocabulary=True).withColumnRenamed("id", "doc_id")


@query
def op9_host_quality(spark, sf_dir):
    judged = hostquality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *[F.round(c, 6).alias(c) for c in (
        "host_rate", "path_rate", "evidence", "p_quality")], "kept")


@query
def op10_quality_rules(spark, sf_dir):
    verdicts = rules.quality_verdicts(table(spark, sf_dir, "documents"), ["doc_id"])
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


@query
def op11_ranked_search(spark, sf_dir):
    indexed = ranked.index(table(spark, sf_dir, "documents"))
    return ranked.search(indexed, table(spark, sf_dir, "benchmark"))


@query
def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_url_filter(spark, sf_dir):
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), ("page_id",))
    return judged.withColumn("p_block", F.round("p_block", 6))


ORACLES["op13_url_filter"] = checks.URL_FILTER
ORACLES["op12_spelling"] = checks.SPELLING
ORACLES["op11_ranked_search"] = checks.RANKED_SEARCH
ORACLES["op10_quality_rules"] = checks.QUALITY_RULES
ORACLES["op9_host_quality"] = checks.HOST_QUALITY
