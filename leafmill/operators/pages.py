"""Page and document level: routing, review flags, reports, summaries, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import alnum_count, char_count, is_blank, word_count
from leafmill.settings import LOW_WORD, LOW_WORDS_KEPT, MIN_CHARS, MIN_CONFIDENCE, MIN_TEXT_LAYER


def chars_of(pages: DataFrame) -> Column:
    """A ``chars`` column where there is one (counted before texts were dropped), else the text's length."""
    return F.col("chars") if "chars" in pages.columns else char_count(F.col("text"))


def known(c: Column) -> Column:
    """NaN confidences count as unknown."""
    return F.when(~F.isnan(c), c)


def route(text: Column, force_ocr: bool = False, least: int = MIN_TEXT_LAYER) -> Column:
    return F.when(F.lit(not force_ocr) & (alnum_count(text) >= least), "text-layer").otherwise("ocr")


def review(confidence: Column, chars: Column, minimum: float = MIN_CONFIDENCE) -> Column:
    """struct(needs_review, review_reason); low confidence is named before lack of text."""
    low = F.concat(F.lit("mean confidence "), F.format_string("%.0f", F.bround(confidence, 0)), F.lit(f" below {minimum:.0f}"))
    reason = F.when(confidence < minimum, low).when(chars < MIN_CHARS, "almost no text on the page")
    return F.struct(reason.isNotNull().alias("needs_review"), reason.alias("review_reason"))


def reads_badly(text: Column, confidence: Column, minimum: float = MIN_CONFIDENCE) -> Column:
    return F.when(is_blank(text), True).when(confidence.isNull(), False).otherwise(confidence < minimum)


def improves_on(text: Column, confidence: Column, old_text: Column, old_confidence: Column, gain: float = 5.0) -> Column:
    return (
        F.when(is_blank(text), False).when(is_blank(old_text), True).when(confidence.isNull() | old_confidence.isNull(), False).otherwise(confidence > old_confidence + gain)
    )


def low_words(words: Column, bar: float = LOW_WORD, most: int = LOW_WORDS_KEPT) -> Column:
    return F.slice(F.transform(F.filter(words, lambda w: w["confidence"] < bar), lambda w: w["text"]), 1, most)


def flagged(pages: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    return pages.select("*", review(known(F.col("confidence")), chars_of(pages), minimum).alias("_r")).withColumns(
        {"needs_review": F.col("_r.needs_review"), "review_reason": F.col("_r.review_reason")}
    ).drop("_r")


def page_report(pages: DataFrame, *keys: str) -> DataFrame:
    """The eleven columns of the page report behind the given keys; every column is ready to print."""
    c = known(F.col("confidence"))
    return pages.select(
        *keys,
        F.col("relpath").alias("file"),
        F.col("page_no").alias("page"),
        "source",
        F.when(c.isNull(), "").otherwise(F.format_string("%.1f", F.bround(c, 1))).alias("confidence"),
        char_count(F.col("text")).alias("chars"),
        word_count(F.col("text")).alias("words"),
        F.when(F.col("needs_review"), "yes").otherwise("").alias("needs_review"),
        F.coalesce("review_reason", F.lit("")).alias("review_reason"),
        F.when(F.coalesce("rotation_applied", F.lit(0)) == 0, "").otherwise(F.col("rotation_applied").cast("string")).alias("rotated"),
        F.format_string("%.1f", F.bround(F.greatest(F.coalesce(F.col("duration_ms"), F.lit(0)), F.lit(0)) / 1000.0, 1)).alias("seconds"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def document_summary(pages: DataFrame) -> DataFrame:
    c = known(F.col("confidence"))
    return pages.groupBy("file_id").agg(
        F.count_if(F.col("source") == "ocr").alias("ocr_pages"),
        F.count_if(F.col("source") == "text-layer").alias("text_layer_pages"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.col("page_no")))), ",").alias("flagged"),
        F.bround(F.avg(c), 1).alias("mean_confidence"),
        F.sum(chars_of(pages)).alias("chars"),
        F.count(F.lit(1)).alias("pages_done"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    """Counts per run; pages of skipped, failed and copied files are no work, nor are resumed ones."""
    status = F.col("status")
    working = ~status.isin("skipped", "failed", "copied")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(status == "failed").alias("files_failed"),
        F.count_if(status == "skipped").alias("files_skipped"),
        F.count_if(status == "copied").alias("files_copied"),
        F.coalesce(F.sum(F.when(status == "skipped", F.col("page_count"))), F.lit(0)).cast("bigint").alias("pages_skipped"),
        F.coalesce(F.sum("resumed_pages"), F.lit(0)).cast("bigint").alias("pages_resumed"),
        F.coalesce(F.sum(F.when(working, F.col("page_count") - F.coalesce("resumed_pages", F.lit(0)))), F.lit(0)).cast("bigint").alias("pages_total"),
    )


def all_page_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pages_done"),
        F.count_if(F.col("needs_review")).alias("pages_flagged"),
        F.count_if(F.col("source") == "failed").alias("pages_failed"),
        F.count_if(F.col("source") == "text-layer").alias("pages_from_text_layer"),
        F.sum(chars_of(pages)).alias("chars"),
    )


def expanded(results: DataFrame) -> DataFrame:
    """(file_id, page_no) of every page that documents in work should have."""
    return results.where("page_count > 0 and status not in ('skipped', 'failed', 'copied')").select(
        "file_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no")
    )


def missing_pages(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Expected pages without a stored reading; failed and skipped readings do not count as stored."""
    good = stored.where("source not in ('failed', 'skipped')").select("file_id", "page_no")
    return expected.join(good, ["file_id", "page_no"], "left_anti")


def merged_pages(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and newly read pages of the same columns; the new reading wins."""
    rows = stored.select("*", F.lit(0).alias("_new")).unionByName(fresh.select("*", F.lit(1).alias("_new")))
    values = [c for c in stored.columns if c not in ("file_id", "page_no")]
    return rows.groupBy("file_id", "page_no").agg(F.max_by(F.struct(*values), "_new").alias("_v")).select("file_id", "page_no", *[f"_v.{c}" for c in values])
