"""A whole run over a folder: discover, plan against the ledger, read, write, record."""

from __future__ import annotations

import json
import os
import queue
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.names import output_basenames, output_path
from leafmill.kernels.recognise import PAGE_SCHEMA, Recogniser, Stub, read_pages
from leafmill.operators.changed import RECIPE_FIELDS, ChangeState, content_hash
from leafmill.operators.identity import document_key, identity, recipe_text, twin_pages, twins
from leafmill.operators.layout import laid_out
from leafmill.settings import Settings, is_inside
from leafmill.sinks.files import read_cache, write_cache, write_documents, write_report
from leafmill.sources.listing import discover
from leafmill.storage import materialise

#: Events a subscriber may be behind before further ones are dropped. Fixed value.
BEHIND = 2000


def new_run_id() -> str:
    """Second resolution with a suffix, so that two starts in one second stay apart."""
    return datetime.now().strftime("%Y%m%d-%H%M%S") + "-" + uuid.uuid4().hex[:4]


class Cancelled(RuntimeError):
    """The run was asked to stop."""


@dataclass
class Run:
    settings: Settings
    run_id: str = field(default_factory=new_run_id)
    status: str = "pending"
    totals: dict = field(default_factory=dict)
    listeners: list = field(default_factory=list)
    stopped: bool = False
    _spark: SparkSession | None = None
    _thread: threading.Thread | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def publish(self, **event) -> None:
        event |= {"run_id": self.run_id}
        with self._lock:
            listeners = list(self.listeners)
        for f in listeners:
            f(event)

    def phase(self, name: str, **more) -> None:
        if self.stopped:
            raise Cancelled(self.run_id)
        self.publish(type="phase", phase=name, **more)

    def snapshot(self) -> dict:
        return {"type": "snapshot", "run_id": self.run_id, "status": self.status, "totals": dict(self.totals)}

    def subscribe(self) -> queue.Queue:
        """A queue that begins with a snapshot, so a late listener starts from the present; a full queue drops what comes."""
        q: queue.Queue = queue.Queue(BEHIND)
        q.put_nowait(self.snapshot())

        def put(event: dict) -> None:
            try:
                q.put_nowait(event)
            except queue.Full:
                pass

        with self._lock:
            self.listeners.append(put)
        return q

    def cancel(self) -> None:
        """Stops the run's Spark jobs; pages already in the cache are not read again."""
        self.stopped = True
        if self._spark is not None:
            self._spark.sparkContext.cancelJobGroup(self.run_id)

    def start_in_background(self, spark: SparkSession, pixels, make: Callable[[], Recogniser] = Stub) -> "Run":
        def work() -> None:
            try:
                self.start(spark, pixels, make)
            except Exception:  # noqa: BLE001  status and log have it
                pass

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()
        return self

    def join(self, seconds: float | None = None) -> bool:
        """Waits for a run in the background; whether it has ended."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self._thread is None or not self._thread.is_alive()

    def start(self, spark: SparkSession, pixels: Callable[[DataFrame], DataFrame], make: Callable[[], Recogniser] = Stub) -> "Run":
        """``pixels`` turns pending files into page rows for the page stage."""
        s = self.settings
        if is_inside(s.output_dir, s.input_dir) is False and is_inside(s.input_dir, s.output_dir):
            raise ValueError("the input folder lies inside the output folder")
        home = f"{s.work_path}/_runs/{self.run_id}"
        os.makedirs(home, exist_ok=True)
        with open(f"{home}/settings.json", "w", encoding="utf-8") as f:
            json.dump(s.to_dict(), f)
        self.status, self._spark = "running", spark
        self._manifest(home)  # a run that dies is found as one that never ended
        spark.sparkContext.setJobGroup(self.run_id, f"run {self.run_id}", True)
        try:
            self._run(spark, home, pixels, make)
            self.status = "done"
        except Exception as e:
            if self.stopped:
                self.status = "cancelled"
                return self
            self.status = "failed"
            self.publish(type="log", level="error", message=str(e)[:500])
            raise
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self._manifest(home)
            self.publish(type="done", status=self.status)
        return self

    def _manifest(self, home: str) -> None:
        ended = None if self.status == "running" else datetime.now(timezone.utc).isoformat(timespec="seconds")
        fresh = f"{home}/manifest.json.new"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"run_id": self.run_id, "status": self.status, "totals": self.totals, "finished_at": ended}, f)
        os.replace(fresh, f"{home}/manifest.json")

    def _run(self, spark, home, pixels, make) -> None:
        s = self.settings
        self.phase("discovering")
        files = discover(spark, s.input_dir, s.recursive).persist()
        recipe = F.struct(*[F.lit(getattr(s, k)).alias(k) for k in RECIPE_FIELDS])
        current = files.where("error is null and page_count > 0").withColumn("recipe", recipe)
        current = current.withColumns({"content": content_hash(F.col("size_bytes"), recipe_text()), "mtime": F.col("modified")})
        state = ChangeState(spark, f"file://{os.path.abspath(s.work_path)}/_cache/state", ["relpath"])
        pending = state.pending(current) if s.skip_already_done else current
        pending = pending.withColumn("doc_key", document_key(identity("content"), recipe_text())).withColumn("key", identity(s.duplicates))
        pending = twins(pending, "key", ["file_index"]).persist()
        first = pending.where("relpath = primary")

        self.phase("reading")
        wanted = first.select("file_index", "relpath", "doc_key", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
        cache = f"file://{os.path.abspath(s.work_path)}/_cache/pages"
        stored = read_cache(spark, cache, first)
        if stored is None:
            stored = spark.createDataFrame([], PAGE_SCHEMA).withColumn("doc_key", F.lit(""))
        own = [f.name for f in PAGE_SCHEMA if f.name not in ("file_index", "relpath", "page_no")]
        resumed = wanted.join(stored.select("doc_key", "page_no", *own), ["doc_key", "page_no"]).select("file_index", "relpath", "page_no", *own).persist()
        missing = wanted.join(resumed.select("file_index", "page_no"), ["file_index", "page_no"], "left_anti").persist()
        unread = first.join(missing.select("file_index").distinct(), "file_index", "left_semi")
        asked = pixels(unread).join(missing.select("file_index", "page_no"), ["file_index", "page_no"], "left_semi")
        # the cache is the first thing written: what a stopped run has read is not read again
        read = read_pages(asked, s, make).join(first.select("file_index", "doc_key"), "file_index").persist()
        write_cache(read, cache)
        pages = resumed.unionByName(read.select(*resumed.columns)).persist()

        self.phase("writing")
        copied = twin_pages(pending.select("relpath", "primary"), pages.drop("file_index")).join(pending.select("relpath", "file_index"), "relpath")
        pages = pages.unionByName(copied.select(*pages.columns)).persist()
        shown = laid_out(pages) if s.txt_keeps_layout else pages
        base = output_basenames(files, "file_index")
        targets = None
        for kind in (k for k in s.wanted_kinds() if k != "pdf"):
            t = base.select("relpath", F.lit(kind).alias("kind"), output_path(s.output_dir, F.col("relpath"), F.col("base"), kind, s.output_layout).alias("path"))
            targets = t if targets is None else targets.unionByName(t)
        at = f"file://{os.path.abspath(home)}"
        written = materialise(write_documents(shown, targets, s.to_dict()), "written") if targets is not None else None
        write_report(pages, f"{at}/pages.csv")
        pages.write.mode("overwrite").parquet(f"{at}/pages")
        done = read_whole(pending, pages)
        if written is not None:
            done = done.join(written.where("error is not null").select("relpath").distinct(), "relpath", "left_anti")
        state.commit(done)
        t = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("needs_review")).alias("flagged"), F.count_if(F.col("source") == "failed").alias("failed")).head()
        w = written.agg(F.count_if(F.col("error").isNull()).alias("n")).head()["n"] if written is not None else 0
        n = pending.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("relpath") != F.col("primary")).alias("copied")).head()
        self.totals = {"files": files.count(), "files_read": n["all"] - n["copied"], "files_copied": n["copied"], "pages": t["pages"], "pages_resumed": resumed.count(), "flagged": t["flagged"], "failed": t["failed"], "written": w}
        self.phase("written", **self.totals)


def read_whole(pending: DataFrame, pages: DataFrame) -> DataFrame:
    """The pending files of which every page was read; the others are pending again in the next run."""
    read = pages.where("source <> 'failed'").groupBy("relpath").agg(F.countDistinct("page_no").alias("_read"))
    return pending.join(read, "relpath").where("_read >= page_count").drop("_read")


def run_blocking(spark: SparkSession, settings: Settings, pixels, make=Stub, on_event=None) -> Run:
    run = Run(settings)
    if on_event:
        run.listeners.append(on_event)
    return run.start(spark, pixels, make)
