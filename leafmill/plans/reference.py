"""Queries re-expressing the reference's own operators, each beside its SQL oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import names, text
from leafmill.operators import identity, layout, ledger, lookup, pages, progress, rescue, search, tree
from leafmill.plans.reference_sql import ORACLE
from leafmill.settings import RESERVED, SUFFIXES
from leafmill.sources import readings
from leafmill.streaming.events import events_stream_totals
from leafmill.tables import table, unique_pages

QUERY_TEXT = "evidence custodian"
WANTED = ["pdf", "txt"]


def _pages(spark, sf_dir, *columns):
    return unique_pages(spark, sf_dir, *columns)


def _measured(spark, sf_dir, *outputs, keep=(), reads=()):
    """Unique pages reduced to the wanted columns and measures *before* repeats are dropped: no text is shuffled."""
    raw = table(spark, sf_dir, "pages", "page_id", *keep, *[r for r in reads if r not in keep])
    return raw.select("page_id", *keep, *outputs).dropDuplicates(["page_id"])


def _chars():
    return text.char_count(F.col("text")).alias("chars")


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("relpath", "page_no", "source", "confidence", "text", "needs_review", "review_reason", "rotation_applied", "duration_ms", "error")
    raw = table(spark, sf_dir, "pages", "page_id", *cols)
    return pages.page_report(raw, "page_id").dropDuplicates(["page_id"]).drop("page_id")


def document_summary(spark, sf_dir):
    return pages.document_summary(_measured(spark, sf_dir, _chars(), keep=("file_id", "page_no", "source", "confidence", "needs_review"), reads=("text",)))


def run_totals(spark, sf_dir):
    return pages.run_totals(table(spark, sf_dir, "file_results", "run_id", "status", "page_count", "resumed_pages"))


def all_page_totals(spark, sf_dir):
    return pages.all_page_totals(_measured(spark, sf_dir, _chars(), keep=("run_id", "needs_review", "source"), reads=("text",)))


def flag_pages(spark, sf_dir):
    return pages.flagged(_measured(spark, sf_dir, _chars(), keep=("confidence",), reads=("text",))).select("page_id", "needs_review", "review_reason")


def route_text_layer(spark, sf_dir):
    return _measured(spark, sf_dir, pages.route(F.col("text")).alias("route"), text.alnum_count(F.col("text")).alias("alnum"), reads=("text",))


def low_confidence_words(spark, sf_dir):
    low = F.when(F.col("words").isNotNull(), F.array_join(pages.low_words(F.col("words")), " ")).alias("low_words")
    return _measured(spark, sf_dir, low, reads=("words",)).where("low_words is not null")


def word_char_counts(spark, sf_dir):
    return _measured(spark, sf_dir, text.word_count(F.col("text")).alias("words"), _chars(), reads=("text",))


def tidy_text(spark, sf_dir):
    return _pages(spark, sf_dir, "text").select("page_id", text.tidy(F.col("text")).alias("tidied"))


def char_width_median(spark, sf_dir):
    w = F.col("words")
    n = F.size(w).alias("n")
    p = _measured(spark, sf_dir, F.bround(layout.char_width(w), 6).alias("char_width"), F.bround(layout.line_height(w), 6).alias("line_height"), n, reads=("words",))
    return p.where("n > 0").drop("n")


def line_gaps(spark, sf_dir):
    g = layout.line_gaps(_pages(spark, sf_dir, "words").where("size(words) > 0"), ["page_id"])
    return g.select("page_id", F.col("line_no").cast("bigint").alias("line_no"), F.bround("centre", 6).alias("centre"), F.bround("gap", 6).alias("gap"))


def laid_out_text(spark, sf_dir):
    return layout.laid_out(_pages(spark, sf_dir, "words", "text")).select("page_id", "laid_out")


def lines_from_words(spark, sf_dir):
    """Words grouped by line box and joined in order, inside the row."""
    p = _pages(spark, sf_dir, "words").where("size(words) > 0")
    return p.select("page_id", F.inline(layout.lines_by_band(F.col("words"), 40.0)))


def words_from_chars(spark, sf_dir):
    """Words of every page from its characters, each in a box ten wide."""
    p = _pages(spark, sf_dir, "text").where("text is not null")
    box = lambda c, k: F.struct(c.alias("c"), (k * 10.0).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (k * 10.0 + 10.0).cast("double").alias("x1"), F.lit(18.0).alias("y1"))
    c = p.select("page_id", F.transform(F.filter(F.split("text", ""), lambda x: x != ""), box).alias("chars"))
    return c.select("page_id", F.inline(layout.words_from_chars(F.col("chars")))).select("page_id", "word", "x0", "x1")


def natural_sort(spark, sf_dir):
    """Rank of every path in natural path order; ranks are per work dir, so no window holds all rows."""
    f = table(spark, sf_dir, "files", "work_dir", "relpath").distinct()
    return f.select("work_dir", "relpath", identity.running_number(f, ["work_dir"], [names.natural_path_key(F.col("relpath")), F.col("relpath")]).cast("bigint").alias("place"))


def tree_order(spark, sf_dir):
    f = table(spark, sf_dir, "files", "work_dir", "relpath").distinct()
    return f.select("work_dir", "relpath", identity.running_number(f, ["work_dir"], [names.tree_key(F.col("relpath")), F.col("relpath")]).cast("bigint").alias("place"))


def path_parts(spark, sf_dir):
    r = F.col("relpath")
    f = table(spark, sf_dir, "files", "relpath").distinct()
    return f.select("relpath", names.basename(r).alias("name"), names.parent(r).alias("folder"), names.stem(r).alias("stem"), names.suffix(r).alias("suffix"))


def output_paths(spark, sf_dir):
    r = F.col("relpath")
    f = table(spark, sf_dir, "files", "relpath").distinct()
    cols = [names.output_path("/out", r, names.stem(r), kind, lay).alias(f"{kind}_{lay.replace('-', '_')}") for kind in ("pdf", "txt") for lay in ("by-folder", "by-type", "together")]
    return f.select("relpath", *cols)


def output_basenames(spark, sf_dir):
    f = table(spark, sf_dir, "files", "file_index", "relpath")
    return names.output_basenames(f, "file_index")


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def _current(spark, sf_dir, *more):
    """Files as last seen per run, with the run's settings."""
    f = identity.latest_seen(table(spark, sf_dir, "files", "run_id", "work_dir", "relpath", "file_index", "size_bytes", "modified", "sha256", "error", "page_count", "seen_at"))
    r = table(spark, sf_dir, "runs", "run_id", "recipe").dropDuplicates(["run_id"])
    return f.join(r, "run_id").where("error is null")


def doc_key(spark, sf_dir):
    c = _current(spark, sf_dir)
    return c.select("run_id", "relpath", identity.document_key(identity.identity("name"), identity.recipe_text()).alias("doc_key"))


def _dups(mode):
    def query(spark, sf_dir):
        c = _current(spark, sf_dir).withColumn("key", F.concat_ws("#", "run_id", identity.identity(mode)))
        return identity.twins(c.select("run_id", "relpath", "file_index", "key"), "key", ["file_index"]).select("run_id", "relpath", "primary")

    return query


def twin_fanout(spark, sf_dir):
    """Page numbers a copied file takes over from its primary, over the newest run of each file's pages."""
    c = _current(spark, sf_dir).where("coalesce(sha256, '') <> ''")
    newest = c.groupBy("relpath").agg(F.max_by("sha256", F.struct("seen_at", "run_id")).alias("sha256"), F.min("file_index").alias("file_index"))
    t = identity.twins(newest, "sha256", ["file_index"])
    p = _pages(spark, sf_dir, "relpath", "page_no").select("relpath", "page_no").distinct()
    return identity.twin_pages(t, p).select("relpath", "page_no")


def _entries(spark, sf_dir):
    return ledger.newest(table(spark, sf_dir, "ledger"))


def ledger_skip(spark, sf_dir):
    return ledger.skippable(_current(spark, sf_dir), _entries(spark, sf_dir), WANTED)


def ledger_twin(spark, sf_dir):
    return ledger.twin_entries(_current(spark, sf_dir), _entries(spark, sf_dir), WANTED)


def ledger_upsert(spark, sf_dir):
    """The ledger as each run's records over all earlier ones leave it."""
    keys, values = ["work_dir", "relpath"], ["recorded_at", "size", "mtime", "pages", "run_id"]
    rows = table(spark, sf_dir, "ledger", *keys, *values)
    last = rows.agg(F.max(F.to_date("recorded_at")).alias("day"))
    dated = rows.join(F.broadcast(last), F.to_date("recorded_at") == F.col("day"), "left").withColumn("new", F.col("day").isNotNull()).drop("day")  # last is one row
    return ledger.upserted(dated.where("not new").drop("new"), dated.where("new").drop("new"), keys).select(*keys, *values[1:])


def ledger_backfill(spark, sf_dir):
    runs = table(spark, sf_dir, "runs", "run_id", "work_dir", "status", "recipe")
    results = table(spark, sf_dir, "file_results", "run_id", "relpath", "size_bytes", "page_count", "status")
    return ledger.backfilled(runs, results)


def page_expand(spark, sf_dir):
    return pages.expanded(table(spark, sf_dir, "file_results", "file_id", "page_count", "status").distinct()).distinct()


def resume_missing(spark, sf_dir):
    return pages.missing_pages(page_expand(spark, sf_dir), _pages(spark, sf_dir, "file_id", "page_no", "source"))


def merge_resumed(spark, sf_dir):
    """Readings stored before a file's last reading day, with those of that day over them."""
    p = _pages(spark, sf_dir, "file_id", "page_no", "source", "confidence", "read_at")
    day = F.to_date("read_at")
    last = p.groupBy("file_id").agg(F.max(day).alias("last_day"))
    both = p.join(last, "file_id")
    keep = ("file_id", "page_no", "source", "page_id")
    return pages.merged_pages(both.where(day < F.col("last_day")).select(*keep), both.where(day == F.col("last_day")).select(*keep))


def folder_tree(spark, sf_dir):
    f = table(spark, sf_dir, "files", "relpath", "page_count").groupBy("relpath").agg(F.max("page_count").alias("page_count"))
    return tree.folder_tree(f)


def tree_new_done(spark, sf_dir):
    f = table(spark, sf_dir, "files", "relpath", "page_count").groupBy("relpath").agg(F.max("page_count").alias("page_count"))
    r = table(spark, sf_dir, "file_results", "relpath", "status")
    return tree.tree_state(f, r.where("status = 'done'"), r.where("status = 'running'"))


def filter_documents(spark, sf_dir):
    """Supported suffix, no reserved folder anywhere, no name with a leading dot."""
    f = table(spark, sf_dir, "files", "relpath").distinct()
    parts = F.split("relpath", "/")
    ok = names.suffix(F.col("relpath")).isin(*SUFFIXES) & ~F.arrays_overlap(parts, F.array(*[F.lit(r) for r in RESERVED])) & ~names.basename(F.col("relpath")).startswith(".")
    return f.where(ok)


def search_hits(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "file_id", "relpath", "page_no", "source", "text")
    return search.hits(p, QUERY_TEXT).dropDuplicates()  # only hits are compared, never the texts


def search_top(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "file_id", "relpath", "page_no", "source", "text")
    return search.top_hits(p, QUERY_TEXT).select("file_id", "page_no", "position", "truncated")


def find_in_document(spark, sf_dir):
    return search.in_documents(table(spark, sf_dir, "pages", "page_id", "file_id", "text"), "the")


def highlight(spark, sf_dir):
    p = _pages(spark, sf_dir, "text").where(F.contains(F.lower("text"), F.lit("policy")))
    return p.select("page_id", text.marked(F.col("text"), "policy").alias("marked"))


def eta_throughput(spark, sf_dir):
    runs = table(spark, sf_dir, "runs", "run_id", "started_at", "finished_at").dropDuplicates(["run_id"]).where("finished_at is not null")
    done = _pages(spark, sf_dir, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
    total = pages.run_totals(table(spark, sf_dir, "file_results", "run_id", "status", "page_count", "resumed_pages")).select("run_id", F.col("pages_total").alias("total"))
    elapsed = F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    r = runs.join(done, "run_id").join(total, "run_id").withColumn("elapsed", elapsed)
    return r.select("run_id", "done", "total", *[c.alias(n) for n, c in progress.rate_columns(F.col("done"), F.col("total"), F.col("elapsed")).items()])


def running_progress(spark, sf_dir):
    p = _pages(spark, sf_dir, "run_id", "read_at", "needs_review")
    return progress.cumulative(p, ["run_id"], ["read_at", "page_id"]).select("run_id", "page_id", "pages_done", "pages_flagged")


def interrupted_status(spark, sf_dir):
    r = table(spark, sf_dir, "runs", "run_id", "status").distinct()
    return r.select("run_id", progress.shown_status(F.col("status")).alias("status"), F.col("status").isin("running", "discovering", "pending").alias("was_live"))


def recents(spark, sf_dir):
    return progress.recents(table(spark, sf_dir, "runs", "run_id", "work_dir", "started_at", "status"))


def duration_text(spark, sf_dir):
    r = table(spark, sf_dir, "file_results", "run_id", "file_id", "duration_ms", "size_bytes").distinct()
    return r.select("run_id", "file_id", text.duration(F.floor(F.col("duration_ms") / 1000)).alias("took"), text.byte_size(F.col("size_bytes")).alias("size"), "duration_ms", "size_bytes")


def artefact_paths(spark, sf_dir):
    p = _pages(spark, sf_dir, "relpath", "page_no")
    n = F.col("page_no")
    return p.select("page_id", F.concat(F.lit("_previews/"), "relpath", F.format_string("/p%04d.jpg", n)).alias("preview_path"), F.format_string("p%05d.json", n).alias("cache_name"))


def safe_paths(spark, sf_dir):
    raw = F.concat(F.lit("../\\"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("/./"))
    return table(spark, sf_dir, "files", "path").distinct().select("path", text.safe_relpath(raw).alias("safe"))


def document_text(spark, sf_dir):
    """The text file of every document: a marker and the stripped text per page, in page order."""
    p = table(spark, sf_dir, "pages", "page_id", "file_id", "page_no", "source", "text")
    body = text.stripped(F.coalesce("text", F.lit("")))
    part = F.concat(F.lit("----- page "), F.col("page_no").cast("string"), F.lit(" ("), "source", F.lit(") -----\n"), body, F.lit("\n"))
    d = p.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("page_no", "page_id", part.alias("part")))), lambda x: x["part"]), "\n").alias("text"))
    return d.select("file_id", F.concat(text.stripped(F.col("text")), F.lit("\n")).alias("text"))


def document_json(spark, sf_dir):
    """Length-checked JSON of every document without word boxes."""
    p = _pages(spark, sf_dir, "file_id", "page_no", "source", "confidence", "needs_review")
    page = F.struct(F.col("page_no").alias("page"), "source", pages.known(F.col("confidence")).alias("confidence"), "needs_review")
    return p.groupBy("file_id").agg(F.to_json(F.array_sort(F.collect_list(page))).alias("pages"))


def events_filter_log(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type in ('purchase', 'signup', 'error')").select("event_id", "user_id", "event_type")


def events_by_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("hour"), "event_type", "n", "total"
    )


def rescue_choice(spark, sf_dir):
    """The turn kept for each page when its file's next three pages stand for its turned readings."""
    # of a text only whether it is blank takes part in the choice
    mark = F.when(text.is_blank(F.col("text")), "").otherwise("x").alias("text")
    p = _pages(spark, sf_dir, "file_id", "page_no", "text", "confidence").select("file_id", "page_no", "page_id", mark, pages.known(F.col("confidence")).alias("confidence"))
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("page_no", "page_id")

    def nth(k, angle):
        return F.struct(F.lit(angle).alias("angle"), F.lead("text", k).over(w).alias("text"), F.lead("confidence", k).over(w).alias("confidence"))

    rows = p.select("page_id", F.struct("text", "confidence").alias("current"), F.array(nth(1, 90), nth(2, 180), nth(3, 270)).alias("tried"))
    return rescue.chosen_turn(rows).select("page_id", "turn")


def tsv_words(spark, sf_dir):
    """The words of every page written as recogniser rows and read back."""
    return readings.words_as_rows(_pages(spark, sf_dir, "words").where("size(words) > 0"))


def osd_parse(spark, sf_dir):
    """Orientation reports made from page rows and parsed back."""
    p = _pages(spark, sf_dir, "rotation_applied", "confidence")
    report = F.concat(F.lit("Page number: 0\nOrientation in degrees: 0\nRotate: "), F.col("rotation_applied").cast("string"), F.lit("\nOrientation confidence: "),
                      F.coalesce(pages.known(F.col("confidence")).cast("string"), F.lit("n/a")), F.lit("\nScript: Latin\nScript confidence: 1.5"))
    return p.select("page_id", readings.orientation(report).alias("o")).select("page_id", F.col("o.rotate").alias("rotate"), F.col("o.confidence").alias("confidence"), F.col("o.script").alias("script"))


def dpi_fit(spark, sf_dir):
    p = _pages(spark, sf_dir, "width_px", "height_px").where("width_px > 0 and height_px > 0")
    return p.select("page_id", readings.fitted_dpi(F.col("width_px") / 72.0, F.col("height_px") / 72.0, 300).cast("bigint").alias("dpi"))


def live_runs(spark, sf_dir):
    return lookup.live(table(spark, sf_dir, "runs", "run_id", "work_dir", "finished_at"))


def run_folders(spark, sf_dir):
    return lookup.run_folders(table(spark, sf_dir, "file_results", "run_id"), table(spark, sf_dir, "runs", "run_id", "work_dir", "finished_at"))


def document_states(spark, sf_dir):
    return lookup.document_states(table(spark, sf_dir, "file_results", "run_id", "file_id", "status"))


def written_counts(spark, sf_dir):
    return lookup.written_counts(table(spark, sf_dir, "file_results", "run_id", "file_id", "status").distinct())


def unreadable_files(spark, sf_dir):
    return table(spark, sf_dir, "files", "run_id", "relpath", "error").where("error is not null").distinct()


def upload_totals(spark, sf_dir):
    return lookup.arrivals(identity.latest_seen(table(spark, sf_dir, "files", "run_id", "relpath", "size_bytes", "seen_at")))


def newest_log(spark, sf_dir):
    return lookup.newest_lines(table(spark, sf_dir, "events", "event_id", "ts", "event_type"))


def run_estimate(spark, sf_dir):
    totals = pages.run_totals(table(spark, sf_dir, "file_results", "run_id", "status", "page_count", "resumed_pages"))
    return totals.select("run_id", lookup.planned_seconds(F.col("pages_total"), 8).alias("seconds"))


def page_dpi(spark, sf_dir):
    p = _pages(spark, sf_dir, "width_px", "height_px").where("width_px > 0 and height_px > 0")
    return p.select("page_id", lookup.scaled_dpi(F.col("width_px"), F.col("height_px"), 300, 2000).alias("dpi"))


def flipped_boxes(spark, sf_dir):
    p = _pages(spark, sf_dir, "words", "height_px").where("size(words) > 0")
    return p.select("page_id", F.inline(lookup.flipped(F.col("words"), F.col("height_px").cast("double"))))


def preview_headline(spark, sf_dir):
    """What the preview of each run's folder says: documents to read and documents done."""
    r = lookup.written_counts(table(spark, sf_dir, "file_results", "run_id", "file_id", "status").distinct())
    return r.select("run_id", lookup.headline(F.col("total") - F.col("written"), F.col("written")).alias("headline"))


def shown_tree(spark, sf_dir):
    """Rows of the tree with its first level open: (path, depth, place) depth first, folders before files, place within the first folder."""
    f = table(spark, sf_dir, "files", "relpath").distinct()
    parts = F.split("relpath", "/")
    up_to = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    rows = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(2))), lambda n: F.struct(up_to(n).alias("path"), n.alias("depth"), (n < F.size(parts)).alias("folder")))).alias("r"))
    rows = rows.select("r.*").distinct().withColumn("top", F.get(F.split("path", "/"), 0))
    order = [F.col("depth"), (~F.col("folder")).cast("int"), names.natural_path_key(F.col("path")), F.col("path")]
    return rows.select("path", "depth", "folder", identity.running_number(rows, ["top"], order).cast("bigint").alias("place"))


def supported_suffix(spark, sf_dir):
    f = table(spark, sf_dir, "files", "relpath").distinct()
    return f.select("relpath", names.suffix(F.col("relpath")).isin(*SUFFIXES).alias("supported"))


def reserved_dirs(spark, sf_dir):
    f = table(spark, sf_dir, "files", "relpath").distinct()
    return f.select("relpath", F.arrays_overlap(F.split("relpath", "/"), F.array(*[F.lit(r) for r in RESERVED])).alias("reserved"))


QUERIES = {
    "page_report": page_report, "document_summary": document_summary, "run_totals": run_totals, "all_page_totals": all_page_totals, "flag_pages": flag_pages,
    "route_text_layer": route_text_layer, "low_confidence_words": low_confidence_words, "word_char_counts": word_char_counts, "tidy_text": tidy_text,
    "char_width_median": char_width_median, "line_gaps": line_gaps, "laid_out_text": laid_out_text, "lines_from_words": lines_from_words,
    "words_from_chars": words_from_chars, "natural_sort": natural_sort, "tree_order": tree_order, "path_parts": path_parts, "output_paths": output_paths, "output_basenames": output_basenames,
    "content_hash": content_hash, "doc_key": doc_key, "dup_name": _dups("name"), "dup_content": _dups("content"), "dup_off": _dups("off"), "twin_fanout": twin_fanout,
    "ledger_skip": ledger_skip, "ledger_twin": ledger_twin, "ledger_upsert": ledger_upsert, "ledger_backfill": ledger_backfill, "page_expand": page_expand,
    "resume_missing": resume_missing, "merge_resumed": merge_resumed, "folder_tree": folder_tree, "tree_new_done": tree_new_done, "filter_documents": filter_documents,
    "search_hits": search_hits, "search_top": search_top, "find_in_document": find_in_document, "highlight": highlight, "eta_throughput": eta_throughput,
    "running_progress": running_progress, "interrupted_status": interrupted_status, "recents": recents, "duration_text": duration_text, "artefact_paths": artefact_paths,
    "safe_paths": safe_paths, "document_text": document_text, "document_json": document_json, "events_filter_log": events_filter_log, "events_by_hour": events_by_hour,
    "events_stream_totals": events_stream_totals, "rescue_choice": rescue_choice, "live_runs": live_runs, "run_folders": run_folders, "document_states": document_states,
    "written_counts": written_counts, "unreadable_files": unreadable_files, "upload_totals": upload_totals, "newest_log": newest_log, "run_estimate": run_estimate, "page_dpi": page_dpi,
    "flipped_boxes": flipped_boxes, "preview_headline": preview_headline, "shown_tree": shown_tree, "supported_suffix": supported_suffix, "reserved_dirs": reserved_dirs,
    "tsv_words": tsv_words, "osd_parse": osd_parse, "dpi_fit": dpi_fit,
}

__all__ = ["ORACLE", "QUERIES"]
