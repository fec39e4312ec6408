"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontamination, html_extraction, language_id, media, ngram_jaccard, quality, sharding, toxicity, url_filter

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.ngram_jaccard_join(common.documents(spark, sf_dir), words=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack_into_shards(common.documents(spark, sf_dir), shards=16)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(common.documents(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontamination(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated", "longest_words", "longest_start", "longest_item",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(common.documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "labels"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(common.documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(common.documents(spark, sf_dir)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(common.documents(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_bpe_encoding": op8_bpe_encoding,
    "op9_media_columns": op9_media_columns,
    "op10_url_filter": op10_url_filter,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_ngram_jaccard_join": f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from words),
sizes as (select doc_id, count(*) as n from grams group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as i from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * i >= 90 * (a.n + b.n - i)),
both_ways as (select x, y from links union select y, x from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.y from reach r join both_ways l on l.x = r.other),
degree as (select x as doc_id, count(*) as n_links from both_ways group by 1)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, coalesce(g.n_links, 0) as n_links
from documents d left join sizes s using (doc_id) left join degree g using (doc_id)
join (select doc_id, min(other) as component_id from reach group by 1) r using (doc_id)""",
    "op10_url_filter": url_filter.oracle(),
}
