"""The registered queries: each operator with its production parameters over
its whole table, reduced to the digest columns, and the SQL where SQL can
express the result."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundflow.llm import (collocation, conversation, decontaminate, importance, line_dedup, lpf_dedup, mixing, quality_rules, records,
                           seed_extend, simhash, token_count, toxic, url_filter)
from moundflow.llm.base import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.rule_labels(pages))
    return url_filter.filter_urls(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))[2]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, weight (log likelihood ratio of target to raw text), key (with
    Gumbel noise), kept (among the k largest keys, and not toxic)."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratio, least = importance.fit_all(docs, labels)
    got = saved(importance.weigh(docs.select("doc_id", "text"), ratio, toxic=toxic.fit(docs, labels)).drop("text"))
    clean = importance.mark_top_k(got.where(~F.col("__toxic")), importance.sample_size(got, least), "kept")
    marked = clean.unionByName(got.where("__toxic").withColumn("kept", F.lit(False)))
    return marked.select("doc_id", F.col("__weight").alias("weight"), F.col("__key").alias("key"), "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    got = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return got.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.repeated_words(_table(spark, sf_dir, "documents"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.digest(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digest(records.read_records(spark, records.write_records(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontaminate, op3_suffix_dedup, op4_token_counts, op5_mix_sources,
                                   op6_quality_rules, op7_quality_classifier, op8_line_dedup, op9_simhash_dedup, op10_substring_dedup, op11_repair_conversations,
                                   op12_collocations, op13_token_records)}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op12_collocations": collocation.ORACLE}
