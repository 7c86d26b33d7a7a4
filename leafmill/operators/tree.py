"""Folder trees: roll-ups over every ancestor of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ancestors(files: DataFrame, relpath: str = "relpath") -> DataFrame:
    """One row per file and ancestor folder; '' is the root."""
    parts = F.split(F.col(relpath), "/")
    return files.withColumn("folder_path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))


def folder_tree(files: DataFrame, pages: str = "page_count") -> DataFrame:
    """(folder_path, depth, files, pages) of every folder with all that lies below it."""
    return (
        with_ancestors(files.select("relpath", pages))
        .groupBy("folder_path")
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(pages), F.lit(0)).cast("bigint").alias("pages"))
        .withColumn("depth", F.when(F.col("folder_path") == "", 0).otherwise(F.size(F.split("folder_path", "/"))).cast("bigint"))
    )


def tree_state(files: DataFrame, done: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Per folder: files and pages, how many are new or done, and whether any is being read."""
    d = done.select("relpath").distinct().withColumn("_done", F.lit(True))
    rows = files.select("relpath", "page_count").join(d, "relpath", "left")
    if running is not None:
        rows = rows.join(running.select("relpath").distinct().withColumn("_running", F.lit(True)), "relpath", "left")
    else:
        rows = rows.withColumn("_running", F.lit(None).cast("boolean"))
    return (
        with_ancestors(rows)
        .groupBy("folder_path")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("page_count"), F.lit(0)).cast("bigint").alias("pages"),
            F.count_if(F.col("_done").isNull()).alias("new_files"),
            F.count_if(F.col("_done")).alias("done_files"),
            F.coalesce(F.bool_or("_running"), F.lit(False)).alias("running"),
        )
    )
