"""Registered queries of the operators: whole tables in, the digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnspark.llm import (decontamination, embedding_dedup, licenses, mixing, prefix_trie, quality, secrets, simhash, substring_dedup, suffix_dedup,
                         toxicity, url_filters, whitening)
from nnspark.llm.common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.train(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def _key(text: str) -> str:
    """16 bits of a text's md5, as SQL."""
    return f"cast(conv(substr(md5({text}), 1, 4), 16, 10) as int)"


def captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time: a minute of 2024 that follows from page id and url, as the table has none."""
    minute = F.expr("cast(conv(substr(md5(concat('fetch:', page_id, ':', url)), 1, 7), 16, 10) as int) % 525600")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minute)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated host list over the hosts and parent domains of all pages, by rule.

    One name in three is added (one in five of them as allowed), every second of those removed 60 days later, every
    fourth added again after 150 days.
    """
    names = (pages.select(F.explode(url_filters.suffixes(url_filters.host(F.col("url")))).alias("pattern")).distinct()
             .filter("size(split(pattern, '[.]')) >= 3").withColumn("u", F.expr(_key("concat('list:', pattern)"))))
    steps = F.expr("filter(array(struct('add' as action, 0 as days), struct('remove' as action, 60 as days), "
                   "struct('add' as action, 150 as days)), (s, i) -> u % (array(3, 6, 12)[i]) = 0)")
    return names.select("pattern", "u", F.explode(steps).alias("step")).select(
        "pattern", F.expr("if(u % 5 = 0, 'allow', 'block')").alias("kind"), "step.action",
        F.expr("date_add(date'2024-01-01', u % 120 + step.days)").alias("dated"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filters.judge(captures(pages), list_entries(pages)).select("page_id", "host", "n_active", "matched", "blocked")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (op1_toxicity, op2_embedding_near_dedup, op3_license_scan, op4_quality, op5_simhash,
                            op6_url_filter, op7_substring_dedup, op8_decontamination, op9_secret_scan, op10_source_mix,
                            op11_prefix_trie, op12_embedding_whitening, op13_suffix_dedup)
}
