"""Which documents are the same: identity strings, keys, primaries and their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.names import basename
from leafmill.operators.changed import RECIPE_FIELDS


def identity(mode: str) -> Column:
    """Content hash, with the name or path where the mode asks for it; path, size and time where there is no hash."""
    own = F.concat_ws(":", F.lit("path"), "relpath", F.col("size_bytes").cast("string"), F.format_string("%.3f", "modified"))
    base = F.when(F.coalesce("sha256", F.lit("")) == "", own).otherwise(F.col("sha256"))
    if mode == "name":
        return F.concat_ws("|", base, basename(F.col("relpath")))
    if mode == "off":
        return F.concat_ws("|", base, "relpath")
    return base


def recipe_text(recipe: str = "recipe") -> Column:
    """The settings that decide what a reading looks like, as one string in the order of their names."""
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(f"{recipe}.{n}").cast("string"), F.lit("null"))) for n in sorted(RECIPE_FIELDS)]
    return F.concat_ws(",", *parts)


def document_key(identity_text: Column, recipe: Column) -> Column:
    return F.concat(F.substring(F.sha2(identity_text, 256), 1, 16), F.lit("-"), F.substring(F.sha2(recipe, 256), 1, 8))


def twins(files: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``primary``: the first file of each key in order of discovery.

    The first per group is an aggregate (combined map-side), not a window, so a
    key that holds a third of all files costs no task of that size.
    """
    first = files.groupBy(key).agg(F.min(F.struct(*order, "relpath")).alias("_first")).select(key, F.col("_first.relpath").alias("primary"))
    return files.join(first, key)


def twin_pages(twin_files: DataFrame, pages: DataFrame) -> DataFrame:
    """The primary's pages once per twin, under the twin's name."""
    t = twin_files.where("relpath <> primary").select(F.col("relpath").alias("twin"), "primary")
    return pages.join(t, F.col("relpath") == F.col("primary")).drop("relpath", "primary").withColumnRenamed("twin", "relpath")


def latest_seen(files: DataFrame) -> DataFrame:
    """One row per run and path: the last sighting counts."""
    rest = [c for c in files.columns if c not in ("run_id", "relpath")]
    best = F.max(F.struct("seen_at", *[c for c in rest if c != "seen_at"])).alias("_b")
    return files.groupBy("run_id", "relpath").agg(best).select("run_id", "relpath", *[f"_b.{c}" for c in rest])


def running_number(df: DataFrame, keys: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
