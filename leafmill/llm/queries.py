"""The pN_ queries of the text problems and, where SQL can say it, their oracles."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import history, leaks, personal, quality, quantiles, repair, subjects, tokens
from leafmill.tables import table, unique_pages


def _function_words(spark: SparkSession, sf_dir: str) -> dict[str, set[str]]:
    """The fixed function-word lists (common_words does not grow with the data; 10,000 words are the most taken)."""
    rows = table(spark, sf_dir, "common_words", "lang", "word").where("lang is not null and word is not null").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("common_words is meant to be a short list of function words")
    lists: dict[str, set[str]] = {}
    for lang, word in sorted(rows):
        lists.setdefault(lang, set()).add(word.lower())
    return lists


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.structured_pages(table(spark, sf_dir, "pages", "page_id", "text"), _function_words(spark, sf_dir))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "text", "needs_review")
    return quality.text_quality(pages, _function_words(spark, sf_dir), ["page_id", "needs_review"]).dropDuplicates(["page_id"])


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grouping at once: per source, per source and folder, per source and day, and per all three."""
    pages = unique_pages(spark, sf_dir, "folder", "source", "read_at", "confidence", "duration_ms")
    return quantiles.grouping_percentiles(pages)


def p3_percentiles_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = unique_pages(spark, sf_dir, "source", "read_at", "confidence", "duration_ms")
    return quantiles.page_percentiles(pages, ["source"])


def p3_percentiles_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = unique_pages(spark, sf_dir, "folder", "source", "read_at", "confidence", "duration_ms")
    return quantiles.page_percentiles(pages, ["source", "folder"])


def p3_percentiles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = unique_pages(spark, sf_dir, "source", "read_at", "confidence", "duration_ms").withColumn("day", F.to_date("read_at"))
    return quantiles.page_percentiles(pages, ["source", "day"])


def _p4_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "files", "run_id", "work_dir", "relpath", "file_id", "sha256")
    return files, table(spark, sf_dir, "runs", "run_id", "started_at"), table(spark, sf_dir, "pages", "page_id", "file_id", "page_no", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, runs, pages = _p4_tables(spark, sf_dir)
    return history.duplicate_pairs(files, table(spark, sf_dir, "ledger", "work_dir", "relpath", "sha256"), runs, pages)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicate_classes(*_p4_tables(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found_pieces(table(spark, sf_dir, "pages", "page_id", "text"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with placeholders, under the key ``spark.leafmill.pseudonym.key``; where none is set, under one nobody will know, so links hold within this result only."""
    stated = spark.conf.get("spark.leafmill.pseudonym.key", None)
    key = stated.encode() if stated else secrets.token_bytes(32)
    return personal.redacted(unique_pages(spark, sf_dir, "text"), key)


def _page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "file_id", "page_no", "text", "low_confidence_words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.found_noise(_page_text(spark, sf_dir))


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(_page_text(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "bench_items", "item_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in table(spark, sf_dir, "subjects", "subject").where("subject is not null").distinct().orderBy("subject").limit(1_001).collect()]
    if len(names) > 1_000:
        raise ValueError("subjects is meant to be a short list")
    words = frozenset(w for own in _function_words(spark, sf_dir).values() for w in own)
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return subjects.subjects_of(documents, table(spark, sf_dir, "doc_labels", "doc_id", "subject", "labelled_by"), names, words)


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject: the measure of the corpus."""
    return p10_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


def _percentile_sql(groups: str, extra: str = "") -> str:
    return f"""
with u as (select distinct on (page_id) page_id, source, folder, confidence, duration_ms, cast(read_at as date) as day from pages),
v as (
  select 'confidence' as metric, {groups}, confidence as value from u where confidence is not null and not isnan(confidence)
  union all select 'duration_ms', {groups}, cast(duration_ms as double) from u where duration_ms >= 0),
r as (
  select *, row_number() over (partition by metric, {groups} order by value) as rn, count(*) over (partition by metric, {groups}) as n from v),
t as (select unnest([250, 500, 900, 990]) as p)
select metric, {groups}, cast(p as int) as p, n, value, cast(0.0 as double) as error_bound
from r, t where rn = greatest(1, (n * p + 999) // 1000)
"""


QUERIES = {
    "p2_found": p2_found,
    "p2_statistics": p2_statistics,
    "p3_percentiles": p3_percentiles,
    "p3_percentiles_by_source": p3_percentiles_by_source,
    "p3_percentiles_by_folder": p3_percentiles_by_folder,
    "p3_percentiles_by_day": p3_percentiles_by_day,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_paragraphs": p7_paragraphs,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_SETS_SQL = " union all ".join(
    f"select '{name}' as grouping, metric, source, {f} as folder, {d} as day, p, n, value, error_bound from ({_percentile_sql(groups)})"
    for name, groups, f, d in (
        ("source", "source", "cast(null as varchar)", "cast(null as date)"),
        ("source, folder", "source, folder", "folder", "cast(null as date)"),
        ("source, day", "source, day", "cast(null as varchar)", "day"),
        ("source, folder, day", "source, folder, day", "folder", "day"),
    )
)

ORACLE = {
    "p3_percentiles": _SETS_SQL,
    "p3_percentiles_by_source": _percentile_sql("source"),
    "p3_percentiles_by_folder": _percentile_sql("source, folder"),
    "p3_percentiles_by_day": _percentile_sql("source, day"),
}
