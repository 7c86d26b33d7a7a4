"""Names and paths: natural order, parts, output names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.settings import KINDS


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs count as numbers of any size and come before text."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(
        runs,
        lambda r: F.struct(
            F.when(r.rlike("^[0-9]"), 0).otherwise(1).alias("kind"),
            F.when(r.rlike("^[0-9]"), F.length(F.ltrim(r, F.lit("0")))).otherwise(0).alias("digits"),
            F.when(r.rlike("^[0-9]"), F.ltrim(r, F.lit("0"))).otherwise(r).alias("text"),
        ),
    )


def natural_path_key(path: Column) -> Column:
    return F.transform(F.split(path, "/"), lambda p: natural_key(p))


def tree_key(path: Column) -> Column:
    """Depth-first order with folders before documents at every level."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(parts, lambda p, i: F.struct(F.when(i == n - 1, 1).otherwise(0).alias("leaf"), natural_key(p).alias("name")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Folder part, '' for a document at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_extract(basename(path), r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def output_path(root: str, path: Column, base: Column, kind: str, layout: str) -> Column:
    folder = F.when(parent(path) == "", F.lit(None).cast("string")).otherwise(parent(path))
    name = F.concat(base, F.lit(f".{kind}"))
    if layout == "by-type":
        return F.concat_ws("/", F.lit(root), F.lit(kind), folder, name)
    if layout == "together":
        return F.concat_ws("/", F.lit(root), folder, name)
    return F.concat_ws("/", F.lit(root), folder, F.lit(kind), name)


def output_paths(root: str, path: Column, base: Column, layout: str = "by-folder") -> Column:
    pairs = [x for k in KINDS for x in (F.lit(k), output_path(root, path, base, k, layout))]
    return F.create_map(*pairs)


def output_basenames(files: DataFrame, order: str, relpath: str = "relpath") -> DataFrame:
    """(relpath, base): output names that never clash within a folder, letter case aside.

    Names shared by several documents of a folder take their extension in.  What
    still clashes is numbered in order of discovery.  Only documents whose first
    choice is taken by another enter the ordered fold, family by family of names;
    all others are settled by a window over the name.
    """
    rows = files.select(relpath, order).where(F.col(relpath).isNotNull()).groupBy(relpath).agg(F.min(order).alias("_ord"))
    p = F.col(relpath)
    rows = rows.select(p, "_ord", F.lower(parent(p)).alias("_folder"), stem(p).alias("_stem"), suffix(p).alias("_ext"))
    same = F.count(F.lit(1)).over(Window.partitionBy("_folder", F.lower("_stem")))
    rows = rows.withColumn("_first", F.when((same > 1) & (F.col("_ext") != ""), F.concat("_stem", F.lit("_"), "_ext")).otherwise(F.col("_stem")))
    rows = rows.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("_folder", F.lower("_first"))))
    # Only names that share their beginning with a clashing name can meet in the numbering: the fold takes
    # (folder, name without a trailing number) groups, so a large folder is never gathered as a whole.
    rows = rows.withColumn("_family", F.lower(F.regexp_replace("_first", r"( \([0-9]+\))+$", "")))
    family = ["_folder", "_family"]
    clash = rows.where("_k > 1").select(*family).distinct()
    free = rows.join(clash, family, "left_anti").select(relpath, F.col("_first").alias("base"))
    schema = T.StructType([T.StructField(relpath, T.StringType()), T.StructField("base", T.StringType())])

    def fold(pdf):
        taken: set[str] = set()
        out = []
        for path, first in pdf.sort_values("_ord")[[relpath, "_first"]].itertuples(index=False):
            name, n = first, 2
            while name.lower() in taken:
                name, n = f"{first} ({n})", n + 1
            taken.add(name.lower())
            out.append((path, name))
        import pandas as pd

        return pd.DataFrame(out, columns=[relpath, "base"])

    tied = rows.join(clash, family, "left_semi").groupBy(*family).applyInPandas(fold, schema)
    return free.unionByName(tied)
