"""Full-text search over pages, and finding within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import occurrences, snippet
from leafmill.settings import SEARCH_LIMIT


def hits(pages: DataFrame, query: str) -> DataFrame:
    """Every page that holds the literal, case aside, with its first place and a snippet."""
    q = query.strip()
    if len(q) < 2:
        raise ValueError("type at least two characters")
    text = F.col("text")
    before, match, after = snippet(text, q)
    found = pages.where(F.contains(F.lower(text), F.lit(q.lower())))
    return found.select(
        "file_id", "relpath", "page_no", "source", (F.locate(q.lower(), F.lower(text)) - 1).cast("bigint").alias("position"), before.alias("before"), match.alias("match"), after.alias("after")
    )


def top_hits(pages: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first ``limit`` hits by document and page, and whether there are more: one row more is fetched to know."""
    first = hits(pages, query).dropDuplicates().orderBy("file_id", "page_no").limit(limit + 1)
    n = first.groupBy().agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return first.orderBy("file_id", "page_no").limit(limit).crossJoin(F.broadcast(n))  # n is one row


def in_pages(pages: DataFrame, query: str) -> DataFrame:
    """(page_id, file_id, k) of pages that hold the literal; the text goes no further."""
    return pages.select("page_id", "file_id", occurrences(F.col("text"), query.strip()).alias("k")).where("k > 0").dropDuplicates(["page_id"])


def in_documents(pages: DataFrame, query: str) -> DataFrame:
    """(file_id, occurrences, pages) of documents that hold the literal."""
    return in_pages(pages, query).groupBy("file_id").agg(F.sum("k").alias("occurrences"), F.count(F.lit(1)).alias("pages"))
