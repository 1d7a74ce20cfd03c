"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropwind.llm import cross_entropy, fill_middle, hard_negatives, html_extract, jaccard_join, mixing, pieces, quality_rules, suffix_dedup, tool_calls, url_filter, vantage, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.listed_urls(pages, table(spark, sf_dir, "labels")))


def op6_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % vantage.QUERY_EVERY == 0)


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(tool_calls.exchanges(table(spark, sf_dir, "conversations")), tool_calls.ANSWER)


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return cross_entropy.score(table(spark, sf_dir, "documents"), good)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages, table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % hard_negatives.ANCHOR_EVERY == 0)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_pieces, op4_jaccard_join, op5_url_filter, op6_vantage, op7_tool_calls, op8_cross_entropy, op9_mixing, op10_html_extract, op11_hard_negatives, op12_fill_middle, op13_warc)}
ORACLES: dict[str, str] = {"op5_url_filter": url_filter.SQL, "op6_vantage": vantage.SQL, "op9_mixing": mixing.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_fill_middle": fill_middle.SQL, "op13_warc": warc.SQL}
