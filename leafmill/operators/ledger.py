"""The ledger: what was read before, under which settings, and what can be taken from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.names import basename
from leafmill.operators.changed import RECIPE_FIELDS
from leafmill.operators.identity import recipe_text

TOLERANCE_S = 1.0


def same_recipe(a: str, b: str) -> Column:
    out = F.lit(True)
    for f in RECIPE_FIELDS:
        out &= F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def wanted_in(outputs: Column, wanted: list[str]) -> Column:
    """Whether every wanted kind of output was recorded."""
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce(F.map_keys(outputs), F.array().cast("array<string>")))) == 0


def newest(ledger: DataFrame) -> DataFrame:
    """The latest entry per work dir and path."""
    rows = ledger.select("work_dir", "relpath", "size", "mtime", "pages", F.map_keys("outputs").alias("kinds"), "recipe", "run_id", "sha256", "recorded_at")
    values = [c for c in rows.columns if c not in ("work_dir", "relpath", "recorded_at")]
    best = F.max(F.struct("recorded_at", *values)).alias("_b")
    return rows.groupBy("work_dir", "relpath").agg(best).select("work_dir", "relpath", *[f"_b.{c}" for c in ["recorded_at", *values]])


def skippable(files: DataFrame, entries: DataFrame, wanted: list[str]) -> DataFrame:
    """Files whose newest entry has their size, time and settings and every wanted output.

    ``files`` carries work_dir, relpath, size_bytes, modified and the run's recipe.
    """
    e = entries.select(
        "work_dir", "relpath", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("recipe").alias("_recipe"), "kinds", F.col("run_id").alias("from_run")
    )
    have = F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), "kinds")) == 0
    ok = (F.col("_size") == F.col("size_bytes")) & ((F.col("_mtime") < 0) | (F.abs(F.col("_mtime") - F.col("modified")) <= TOLERANCE_S)) & same_recipe("recipe", "_recipe") & have
    return files.join(e, ["work_dir", "relpath"]).where(ok).select("run_id", "relpath", "from_run")


def twin_entries(files: DataFrame, entries: DataFrame, wanted: list[str], same_name: bool = False) -> DataFrame:
    """(run_id, relpath, twin): for each file the first entry, by path, of the same content elsewhere.

    The first match is a minimum, so a hash shared by very many entries is folded
    to its two least paths per recipe and name before it meets the files (one of
    the two is not the file's own); no group of entries is ever gathered.
    """
    name = [basename(F.col("relpath"))] if same_name else []
    key = F.concat_ws("|", "sha256", recipe_text("recipe"), *name).alias("_key")
    have = F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), "kinds")) == 0
    known = F.coalesce("sha256", F.lit("")) != ""
    e = entries.where(known & have).select(key, F.col("relpath").alias("_path"))
    one = e.groupBy("_key").agg(F.min("_path").alias("_one"))
    two = e.join(one, "_key").where("_path > _one").groupBy("_key").agg(F.min("_path").alias("_two"))
    f = files.where(known).select("run_id", "relpath", key).join(one, "_key").join(two, "_key", "left")
    twin = F.when(F.col("_one") != F.col("relpath"), F.col("_one")).otherwise(F.col("_two"))
    return f.select("run_id", "relpath", twin.alias("twin")).where("twin is not null").groupBy("run_id", "relpath").agg(F.min("twin").alias("twin"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows over old ones of the same columns; of several new rows the greatest counts."""
    values = [c for c in old.columns if c not in keys]
    rows = old.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
    return rows.groupBy(*keys).agg(F.max(F.struct("_new", *values)).alias("_b")).select(*keys, *[f"_b.{c}" for c in values])


def backfilled(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Entries from the results of ended runs, for a work dir without a ledger: the later run wins, times unknown."""
    ended = runs.where("status in ('done', 'cancelled')").select("run_id", "work_dir", "recipe")
    rows = results.where("status = 'done'").join(ended, "run_id")
    best = F.max(F.struct("run_id", "size_bytes", "page_count")).alias("_b")
    return rows.groupBy("work_dir", "relpath").agg(best).select(
        "work_dir", "relpath", F.col("_b.run_id").alias("run_id"), F.col("_b.size_bytes").alias("size"), F.lit(-1.0).alias("mtime"), F.col("_b.page_count").alias("pages")
    )
