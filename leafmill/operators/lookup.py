"""Lookups over runs, documents and files: where a run lies, what is going on, what was written, what a page measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a document that is through, and those of one with outputs in place. Fixed values.
ENDED, WRITTEN = ("done", "failed", "skipped", "copied", "cancelled"), ("done", "copied", "skipped")
#: Milliseconds a page is planned to take a worker, and lines of log kept on screen. Fixed values.
PLANNED_MS, LOG_LINES = 1_400, 400


def live(runs: DataFrame) -> DataFrame:
    """Runs that have not ended."""
    return runs.where("finished_at is null").select("run_id", "work_dir").distinct()


def run_folders(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, folder, going): the folder of every asked run, a live run's own first; null where nobody knows it."""
    seen = runs.where("run_id is not null").groupBy("run_id").agg(
        F.max(F.when(F.col("finished_at").isNull(), F.col("work_dir"))).alias("_live"), F.max("work_dir").alias("_stored"), F.bool_or(F.col("finished_at").isNull()).alias("_going")
    )
    return asked.select("run_id").distinct().join(seen, "run_id", "left").select("run_id", F.coalesce("_live", "_stored").alias("folder"), F.coalesce("_going", F.lit(False)).alias("going"))


def document_states(results: DataFrame) -> DataFrame:
    """(run_id, file_id, status, pending): documents as a reader finds them; what has not ended is pending."""
    return results.select("run_id", "file_id", "status", (~F.col("status").isin(*ENDED)).alias("pending")).distinct()


def written_counts(results: DataFrame) -> DataFrame:
    """(run_id, written, total): documents with outputs in place, of all."""
    return results.groupBy("run_id").agg(F.count_if(F.col("status").isin(*WRITTEN)).alias("written"), F.count(F.lit(1)).alias("total"))


def arrivals(files: DataFrame) -> DataFrame:
    """(run_id, files, bytes) of one row per run and file."""
    return files.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes"))


def newest_lines(events: DataFrame, lines: int = LOG_LINES) -> DataFrame:
    """The last ``lines`` events, newest first."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(lines)


def planned_seconds(pages: Column, workers: int) -> Column:
    return F.bround(pages * PLANNED_MS / (1000 * workers), 3)


def scaled_dpi(width: Column, height: Column, dpi: int, most_px: int) -> Column:
    """Resolution of a picture once its longer side is brought down to ``most_px``."""
    return F.floor(F.lit(float(dpi)) * F.least(F.lit(1.0), F.lit(float(most_px)) / F.greatest(width, height))).cast("int")


def flipped(words: Column, height: Column) -> Column:
    """Boxes measured from the bottom as boxes measured from the top, and back; done inside the row."""
    return F.transform(words, lambda w, k: F.struct(k.alias("word_pos"), w["text"].alias("word"), (height - w["y1"]).alias("y0"), (height - w["y0"]).alias("y1")))


def headline(new: Column, done: Column) -> Column:
    """What a preview says first."""
    s = lambda n: F.when(n == 1, " document").otherwise(" documents")
    return F.when((new == 0) & (done == 0), "nothing to read").when(new == 0, "everything here has been read").otherwise(
        F.concat(new.cast("string"), s(new), F.lit(" to read"), F.when(done > 0, F.concat(F.lit(", "), done.cast("string"), F.lit(" done"))).otherwise(""))
    )
