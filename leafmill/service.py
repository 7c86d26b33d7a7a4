"""A small HTTP service over finished runs (standard library only): health, runs, one run, search, folders."""

from __future__ import annotations

import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse


def list_runs(work_dir: str) -> list[dict]:
    """Manifests under the work folder, newest first; unfinished ones read as interrupted, unreadable ones left out."""
    out = []
    root = os.path.join(work_dir, "_runs")
    for name in sorted(os.listdir(root) if os.path.isdir(root) else [], reverse=True):
        try:
            with open(os.path.join(root, name, "manifest.json"), encoding="utf-8") as f:
                m = json.load(f)
        except (OSError, ValueError):
            continue
        if m.get("status") in ("running", "discovering", "pending"):
            m["status"] = "interrupted"
        out.append(m)
    return out


def browse(path: str) -> dict:
    """Visible folders and the number of files of a folder; the nearest one that exists."""
    while not os.path.isdir(path) and path not in ("", "/"):
        path = os.path.dirname(path)
    names = sorted((n for n in os.listdir(path or "/") if not n.startswith(".")), key=str.lower)
    folders = [n for n in names if os.path.isdir(os.path.join(path, n))]
    return {"path": path, "folders": folders, "files": len(names) - len(folders)}


def search(work_dir: str, run_id: str, query: str) -> dict:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from leafmill.operators.search import top_hits

    if len(query.strip()) < 2:
        return {"query": query, "hits": [], "error": "type at least two characters"}
    pages = SparkSession.builder.getOrCreate().read.parquet(f"file://{os.path.abspath(work_dir)}/_runs/{os.path.basename(run_id)}/pages")
    rows = top_hits(pages.withColumn("file_id", F.col("file_index")), query).collect()
    return {"query": query, "hits": [r.asDict() for r in rows], "truncated": bool(rows and rows[0]["truncated"])}


def handler(work_dir: str):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlparse(self.path)
            parts, q = [p for p in url.path.split("/") if p], {k: v[0] for k, v in parse_qs(url.query).items()}
            body, code = None, 200
            if parts == ["api", "health"]:
                body = {"ok": True}
            elif parts == ["api", "browse"]:
                body = browse(q.get("path", work_dir))
            elif parts == ["api", "runs"]:
                body = list_runs(work_dir)
            elif len(parts) == 3 and parts[:2] == ["api", "runs"]:
                body = next((m for m in list_runs(work_dir) if m["run_id"] == parts[2]), None)
            elif len(parts) == 4 and parts[:2] == ["api", "runs"] and parts[3] == "search":
                body = search(work_dir, parts[2], q.get("q", ""))
            if body is None:
                body, code = {"error": "not found"}, 404
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return Handler


def serve(host: str, port: int, work_dir: str) -> None:
    with ThreadingHTTPServer((host, port), handler(work_dir)) as server:
        server.serve_forever()
