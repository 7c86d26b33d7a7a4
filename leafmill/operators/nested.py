"""Deeply nested records flattened into related tables.

Payloads come in three shapes (one record, a ``document`` envelope, a ``files``
list), as JSON objects or as JSON strings holding such an object, with words
under ``word_boxes`` or ``words``.  Each payload is parsed once, into a variant;
a higher-order projection then attaches ancestor keys and positions inside the
row (nested ``transform``), ``flatten`` joins the arrays and one ``inline`` per
target table emits the rows, so no level costs a shuffle or a join.

Defined results: null, empty, truncated or non-object payloads, those with a key
given twice in one object and those beyond a variant's size give no rows; a
missing, null or empty array gives no rows below it but keeps its siblings'
positions; an element that is null keeps its position with null fields; missing
or malformed boxes and numbers are null; a record received twice counts once, as
first received (an unknown time is after every known one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "array<struct<text:string,box:array<string>,confidence:string>>"
_PAGE = (
    "struct<page:string,source:string,text:string,chars:string,confidence:string,needs_review:string,review_reason:string,"
    "error:string,duration_ms:string,size_px:array<string>,low_confidence_words:array<string>,words:variant,word_boxes:variant>"
)
_FILE = (
    "struct<relpath:string,source_path:string,size_bytes:string,page_count:string,status:string,error:string,"
    f"duplicate_of:string,outputs:map<string,string>,pages:array<{_PAGE}>>"
)
_RECORD = _FILE[:-1] + f",run_id:string,document:{_FILE},files:array<{_FILE}>>"
_FILE_FIELDS = ("relpath", "source_path", "size_bytes", "page_count", "status", "error", "duplicate_of", "outputs", "pages")


def _once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``df`` with new columns that are computed once per row, however often later expressions name them.

    A generator is the one operator expressions are not inlined through.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(raw: DataFrame) -> DataFrame:
    """(record_id, received_at, files): every parseable record once, its files as one array."""
    given = raw.select("record_id", "received_at", "payload").where("record_id is not null and payload is not null")
    # of copies, also in another spelling, the first received counts; the payload crosses the network once
    order = F.struct(F.col("received_at").isNull().alias("unknown"), "received_at", F.md5("payload").alias("h"))
    one = given.groupBy("record_id").agg(F.min_by("payload", order).alias("payload"), F.min("received_at").alias("received_at"))
    keep = ("record_id", "received_at")
    body = _once(one, *keep, v=F.try_parse_json("payload"))
    for _ in range(2):  # a JSON string, or a string of a string, that holds the object
        inner = F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(F.try_variant_get("v", "$", "string"))).otherwise(F.col("v"))
        body = _once(body.where("v is not null"), *keep, v=inner)
    body = body.where(F.schema_of_variant("v").startswith("OBJECT"))
    rec = body.select(*keep, F.inline(F.array(F.try_variant_get("v", "$", _RECORD))))
    own = F.array(F.struct(*_FILE_FIELDS))
    return _once(rec, *keep, files=F.when(F.col("files").isNotNull(), F.col("files")).when(F.col("document").isNotNull(), F.array("document")).otherwise(own))


def _number(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def _words(page: Column) -> Column:
    """The word array of a page: ``word_boxes`` where it is an array, else ``words`` where that is one."""
    return F.coalesce(*[F.try_variant_get(page[c], "$", _WORD) for c in ("word_boxes", "words")], F.expr(f"cast(array() as {_WORD})"))


def flat_files(raw: DataFrame) -> DataFrame:
    f = F.transform(
        "files",
        lambda x, i: F.struct(
            i.alias("file_pos"),
            x["relpath"].alias("relpath"),
            x["source_path"].alias("source_path"),
            _number(x["size_bytes"], "bigint").alias("size_bytes"),
            _number(x["page_count"], "int").alias("page_count"),
            x["status"].alias("status"),
            x["error"].alias("error"),
            x["duplicate_of"].alias("duplicate_of"),
        ),
    )
    return parsed(raw).select("record_id", F.inline(f))


def flat_pages(raw: DataFrame) -> DataFrame:
    pages = F.transform(
        "files",
        lambda x, i: F.transform(
            F.coalesce(x["pages"], F.expr(f"cast(array() as array<{_PAGE}>)")),
            lambda p, j: F.struct(
                i.alias("file_pos"),
                j.alias("page_pos"),
                _number(p["page"], "int").alias("page_no"),
                p["source"].alias("source"),
                _number(p["chars"], "bigint").alias("chars"),
                _number(p["confidence"], "double").alias("confidence"),
                _number(p["needs_review"], "boolean").alias("needs_review"),
                _number(p["duration_ms"], "bigint").alias("duration_ms"),
                _number(F.get(p["size_px"], 0), "int").alias("width_px"),
                _number(F.get(p["size_px"], 1), "int").alias("height_px"),
            ),
        ),
    )
    return parsed(raw).select("record_id", F.inline(F.flatten(pages)))


def flat_words(raw: DataFrame) -> DataFrame:
    # each page's words are parsed where their struct is built, so a word row carries its ancestors' positions
    words = F.flatten(
        F.transform(
            "files",
            lambda x, i: F.flatten(
                F.transform(
                    F.coalesce(x["pages"], F.expr(f"cast(array() as array<{_PAGE}>)")),
                    lambda p, j: F.transform(
                        _words(p),
                        lambda w, k: F.struct(
                            i.alias("file_pos"),
                            j.alias("page_pos"),
                            k.alias("word_pos"),
                            w["text"].alias("word"),
                            _number(F.get(w["box"], 0), "double").alias("x0"),
                            _number(F.get(w["box"], 1), "double").alias("y0"),
                            _number(F.get(w["box"], 2), "double").alias("x1"),
                            _number(F.get(w["box"], 3), "double").alias("y1"),
                            _number(w["confidence"], "double").alias("confidence"),
                        ),
                    ),
                )
            ),
        )
    )
    return parsed(raw).select("record_id", F.inline(words))


def found_words(raw: DataFrame) -> DataFrame:
    return flat_words(raw).select("record_id", "file_pos", "page_pos", "word_pos", "word")
