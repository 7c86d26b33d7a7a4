"""Outputs of a run: one text and one JSON file per document, the page report, the page cache."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.pages import page_report
from leafmill.storage import delete

_WRITTEN = T.StructType([T.StructField("relpath", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])


def _put(path: str, body: str) -> None:
    """Whole or not at all: written beside its place and renamed, so a retried task does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fresh = f"{path}.{os.getpid()}.new"
    with open(fresh, "w", encoding="utf-8", newline="") as f:
        f.write(body)
    os.replace(fresh, path)


def document_text(pages: list[dict]) -> str:
    """Pages under a marker each, laid out as they stood on the page where that is known."""
    bodies = [(p.get("laid_out") or p["text"] or "").strip("\n") if p.get("laid_out") else (p["text"] or "").strip() for p in pages]
    parts = [f"----- page {p['page_no']} ({p['source']}) -----\n{b}\n" for p, b in zip(pages, bodies)]
    return "\n".join(parts).strip() + "\n"


def document_json(relpath: str, pages: list[dict], settings: dict) -> str:
    """The document with its settings; word boxes only where the settings ask for them."""
    boxes = settings.get("include_word_boxes", True)
    kept = [{k: v for k, v in p.items() if v is not None and k not in ("laid_out", "words")} for p in pages]
    for own, p in zip(kept, pages):
        own["words"] = len((p["text"] or "").split())
        if boxes and p.get("words") is not None:
            own["word_boxes"] = [{"text": w["text"], "box": [round(w[c], 1) for c in ("x0", "y0", "x1", "y1")], "confidence": round(w["confidence"], 1)} for w in p["words"]]
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return json.dumps({"tool": "leafmill", "generated_at": now, "settings": settings, "document": {"relpath": relpath, "pages": kept}}, ensure_ascii=False, default=str)


def write_documents(pages: DataFrame, targets: DataFrame, settings: dict) -> DataFrame:
    """Writes the files named by ``targets`` (relpath, kind, path); one row per file with its error, if any.

    Pages of a document meet in one group: an output file is written by one writer.
    """
    paths = targets.groupBy("relpath").agg(F.map_from_entries(F.collect_list(F.struct("kind", "path"))).alias("paths"))
    cols = ["page_no", "source", "text", "confidence", "needs_review", "review_reason", "error", *[c for c in ("words", "laid_out") if c in pages.columns]]
    joined = pages.select("relpath", *cols).join(paths, "relpath")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_no")
        rel = pdf["relpath"].iloc[0]
        rows = [{c: None if not hasattr(v, "__len__") and pd.isna(v) else v for c, v in r.items()} for r in pdf[cols].to_dict("records")]
        out = []
        for kind, path in dict(pdf["paths"].iloc[0]).items():
            try:
                _put(path, document_text(rows) if kind == "txt" else document_json(rel, rows, settings))
                out.append((rel, kind, path, None))
            except OSError as e:
                out.append((rel, kind, path, str(e)))
        return pd.DataFrame(out, columns=[f.name for f in _WRITTEN])

    return joined.groupBy("relpath").applyInPandas(write, _WRITTEN)


def write_report(pages: DataFrame, path: str) -> None:
    """The page report as CSV with a header, sorted by file and page."""
    page_report(pages).orderBy("file", "page").write.mode("overwrite").option("header", True).csv(path)


def write_cache(pages: DataFrame, root: str) -> None:
    """Read pages under their document key; a page that failed is not kept."""
    pages.where("source <> 'failed'").write.mode("append").partitionBy("doc_key").parquet(root)


def read_cache(spark, root: str, keys: DataFrame) -> DataFrame | None:
    """Cached pages of the given keys, the newest reading of each page."""
    try:
        cached = spark.read.parquet(root)
    except Exception:  # noqa: BLE001  no cache yet
        return None
    return cached.join(keys.select("doc_key").distinct(), "doc_key", "left_semi").dropDuplicates(["doc_key", "page_no"])


def clear_cache(spark, root: str, keys: list[str]) -> None:
    """Forget the cached pages of the given keys."""
    for k in keys:
        delete(spark, f"{root}/doc_key={k}")
