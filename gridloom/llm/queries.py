"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.decontaminate import leaks
from gridloom.llm.html_extract import html_extract
from gridloom.llm.line_dedup import line_report
from gridloom.llm.mixing import WEIGHTS, label_domains, mixing_rates
from gridloom.llm.ngram_join import ngram_join
from gridloom.llm.quality_mil import quality_classifier
from gridloom.llm.quality_rules import quality_rules
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.toxicity import toxicity
from gridloom.llm.url_filter import RULES, rule_table, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op8_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing_rates(docs, label_domains(docs, table(spark, sf_dir, "labels")), WEIGHTS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_ngram_join": op2_ngram_join,
        "op3_url_filter": op3_url_filter,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_html_extract": op6_html_extract,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_mixing_rates": op8_mixing_rates,
        "op9_toxicity": op9_toxicity,
        "op10_benchmark_leaks": op10_benchmark_leaks,
        "pipeline": pipeline,
    }


_RULE_ROWS = ", ".join(f"('{e.split('/')[0]}', '/{e.split('/', 1)[1]}', '{e}', '{v}')" for e, v in RULES)
_URL_FILTER_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, rule, verdict) AS (VALUES {_RULE_ROWS}),
m AS (
  SELECT h.page_id, h.host, h.path, r.rule, r.verdict, row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS rn
  FROM h LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _URL_FILTER_SQL}
