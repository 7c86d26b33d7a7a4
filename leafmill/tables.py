"""Readers for the project's tables: only the named columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def unique_pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``pages`` with every repeated row counted once.

    A page_id repeats only in exact copies of the row, so one row per page_id is
    kept; copies meet map-side first.  Where texts or words are wanted they are not
    shuffled for it: the copies are found by page_id and told apart by their place in the
    files, and the few rows to leave out meet the scan, broadcast only where they are
    measured to be small.
    """
    wanted = [c for c in columns if c != "page_id"]
    if not {"text", "words"} & set(wanted):
        return table(spark, sf_dir, "pages", "page_id", *wanted).dropDuplicates(["page_id"])
    raw = table(spark, sf_dir, "pages")
    ids = raw.select("page_id", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    again = raw.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page_id").alias("again"))
    copies = ids.join(again, F.col("page_id").eqNullSafe(F.col("again"))).select("page_id", "at")
    first = copies.groupBy("page_id").agg(F.min("at").alias("first")).withColumnRenamed("page_id", "again")
    extra = copies.join(first, F.col("page_id").eqNullSafe(F.col("again"))).where("at <> first").select(F.col("at.file").alias("_file"), F.col("at.row").alias("_row"))
    rows = raw.select("page_id", *wanted, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(extra, ["_file", "_row"], "left_anti").select("page_id", *wanted)
