"""Readers of a recogniser's output: word rows, orientation reports, page sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import is_blank

TSV_COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser rows from tab-separated files; quotes are ordinary characters."""
    schema = ", ".join(f"`{c}` string" for c in TSV_COLUMNS)
    return spark.read.csv(path, schema=schema, sep="\t", quote="", header=True)


def tsv_words(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Words of recogniser rows: blank, structural (confidence below 0) and malformed rows dropped."""
    n = {c: F.col(c).try_cast("double") for c in ("left", "top", "width", "height", "conf")}
    order = {c: F.col(c).try_cast("int") for c in ("block_num", "par_num", "line_num", "word_num")}
    good = ~is_blank(F.col("text")) & (n["conf"] >= 0)
    for c in (*n.values(), *order.values()):
        good &= c.isNotNull()
    return rows.where(good).select(
        *keys, *[c.alias(k) for k, c in order.items()], F.trim("text").alias("text"),
        n["left"].alias("x0"), n["top"].alias("y0"), (n["left"] + n["width"]).alias("x1"), (n["top"] + n["height"]).alias("y1"), n["conf"].alias("confidence"),
    )


def tsv_pages(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text, confidence): words joined to lines in order, lines to text; the mean to two places."""
    lines = words.groupBy(*keys, "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ").alias("line"),
        F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("k"),
    )
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.bround(F.sum("s") / F.sum("k"), 2).alias("confidence"),
    )


def words_as_rows(pages: DataFrame) -> DataFrame:
    """Page words as recogniser rows, parsed again, per page: text and mean confidence."""
    w = pages.select("page_id", F.posexplode("words").alias("pos", "w"))
    rows = w.select(
        "page_id", F.lit("5").alias("level"), F.lit("1").alias("page_num"), F.lit("1").alias("block_num"), F.lit("1").alias("par_num"),
        F.floor(F.col("w.y0") / 40).cast("string").alias("line_num"), (F.col("pos") + 1).cast("string").alias("word_num"),
        F.col("w.x0").cast("string").alias("left"), F.col("w.y0").cast("string").alias("top"), (F.col("w.x1") - F.col("w.x0")).cast("string").alias("width"),
        (F.col("w.y1") - F.col("w.y0")).cast("string").alias("height"), F.col("w.confidence").cast("string").alias("conf"), F.col("w.text").alias("text"),
    )
    return tsv_pages(tsv_words(rows, ("page_id",)), ("page_id",))


def orientation(report: Column) -> Column:
    """struct(rotate, confidence, script) of a key-value report, null where any of them is missing or invalid."""
    m = F.map_from_entries(
        F.transform(
            F.filter(F.split(report, "\n"), lambda x: F.contains(x, F.lit(":"))),
            lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value")),
        )
    )
    rotate, conf, script = m["rotate"].try_cast("int"), m["orientation confidence"].try_cast("double"), m["script"]
    ok = rotate.isin(0, 90, 180, 270) & conf.isNotNull() & script.isNotNull()
    return F.when(ok, F.struct(rotate.alias("rotate"), conf.alias("confidence"), script.alias("script")))


def fitted_dpi(width_in: Column, height_in: Column, dpi: int, most_px: int = 5000, least: int = 72) -> Column:
    """The wanted resolution, less where the longer side would pass ``most_px``, never below ``least``."""
    longest = F.greatest(width_in, height_in)
    return F.when(longest > 0, F.greatest(F.lit(least), F.least(F.lit(float(dpi)), F.lit(float(most_px)) / longest).cast("int"))).otherwise(F.lit(dpi))
