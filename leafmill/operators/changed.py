"""Processing only new or changed records.

State is one row per key holding a content hash, a modification time and the
moment it was recorded.  A run hashes its current rows, joins them with the
state that was recorded before it started and keeps what is new or differs.
A state version is a numbered list of the parts in force; a commit writes its
own rows as one more part and publishes the next number by an atomic rename that
fails where the number is taken, so a run that dies half way neither skips nor
repeats a record and of two committers neither loses its rows.

Defined results:

* rows with a null key are never selected and never recorded;
* of rows with equal order (``seen_at``, ``recorded_at``) the greater content
  hash, then the greater modification time wins, so repeats change nothing;
* a null in a content column equals only null; a null or NaN modification time
  on either side counts as changed unless the recorded one is negative;
* empty tables give empty results; a run without a start sees no state.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.storage import file_system

RECIPE_FIELDS = (
    "dpi",
    "lang",
    "psm",
    "force_ocr",
    "deskew",
    "denoise",
    "orient",
    "pdf_keeps_source_image",
    "txt_keeps_layout",
)

MTIME_TOLERANCE_S = 1.0


def content_hash(*columns: Column) -> Column:
    """128-bit hash of the columns in which null, '' and neighbours stay apart."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.length(s).cast("string"), F.lit(":"), s)))
    return F.md5(F.concat_ws("|", *parts))


def recipe_columns(recipe: str) -> list[Column]:
    return [F.col(f"{recipe}.{f}") for f in RECIPE_FIELDS]


def latest(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; ties fall to the greater values.

    ``max`` of a struct is combined map-side, so a key that holds a third of all
    rows reaches its reducer as one row per map task.
    """
    best = F.max(F.struct(order, *values)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (order, *values)])


def differs(modified: Column, content: Column, state_mtime: Column, state_content: Column) -> Column:
    """Whether a current row must be processed given its (possibly missing) state row."""
    same_time = (state_mtime < 0) | (F.abs(state_mtime - modified) <= MTIME_TOLERANCE_S)
    return ~(F.coalesce(state_content == content, F.lit(False)) & F.coalesce(same_time, F.lit(False)))


def select_changed(current: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` that ``state`` lacks or holds with other content.

    Both sides carry ``content`` and ``mtime`` beside the keys; ``state`` has one row per key.
    """
    s = state.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("content").alias("_s_content"), F.col("mtime").alias("_s_mtime"))
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    joined = current.join(s, on, "left")
    return joined.where(differs(F.col("mtime"), F.col("content"), F.col("_s_mtime"), F.col("_s_content"))).select(*current.columns)


def run_starts(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run_id, started_at, work_dir, recipe_hash) of every run once, and (work_dir, starts): the few starts of each work dir in order."""
    r = runs.select("run_id", "work_dir", "started_at", content_hash(*recipe_columns("recipe")).alias("recipe_hash")).where(F.col("run_id").isNotNull())
    r = r.groupBy("run_id").agg(F.max(F.struct("started_at", "work_dir", "recipe_hash")).alias("_r")).select("run_id", "_r.*")
    return r, r.where("started_at is not null and work_dir is not null").groupBy("work_dir").agg(F.sort_array(F.collect_set("started_at")).alias("starts"))


def changed_per_run(files: DataFrame, ledger: DataFrame, runs: DataFrame, state: ChangeState) -> DataFrame:
    """(run_id, relpath) of every file each run must process, whatever became of other runs.

    The ledger is an append-only history, so each run needs the state *as of* its
    start.  Runs of a work dir are few and ordered by start; every ledger row is
    filed under the first start after it (its slot) and folded to one row per
    key and slot map-side.  Those rows are committed to ``state`` (kept with
    history), and the runs' current rows are held against what it has in force.
    """
    r, starts = run_starts(runs)
    f = files.where("run_id is not null and relpath is not null").select(
        "run_id", "relpath", "size_bytes", F.col("modified").alias("mtime"), F.col("seen_at"), F.col("error").isNull().alias("readable")
    )
    f = latest(f, ["run_id", "relpath"], "seen_at", ["readable", "size_bytes", "mtime"]).where("readable")
    current = f.join(r, "run_id").select(
        "run_id", "relpath", "work_dir", "started_at", "mtime", content_hash(F.col("size_bytes"), F.col("recipe_hash")).alias("content")
    )

    h = ledger.where("work_dir is not null and relpath is not null and recorded_at is not null").select(
        "work_dir",
        "relpath",
        F.col("recorded_at").alias("at"),
        "mtime",
        content_hash(F.col("size"), content_hash(*recipe_columns("recipe"))).alias("content"),
    )
    h = h.join(starts, "work_dir").withColumn("slot", F.get(F.filter("starts", lambda s: s > F.col("at")), 0))
    h = latest(h.where("slot is not null"), ["work_dir", "relpath", "slot"], "at", ["content", "mtime"])
    state.commit(h.select("work_dir", "relpath", "at", "content", "mtime"))
    return state.pending_as_of(current, "started_at").select("run_id", "relpath")


class Conflict(RuntimeError):
    """Another committer has published the version this one was to be."""


class ChangeState:
    """Versioned key and content-hash state under ``root`` with an atomic swap.

    ``root/parts`` holds parts (keys, at, content, mtime, seq), ``root/versions``
    one small file per version that names the parts in force.  ``pending`` compares
    current rows with the newest version; ``commit`` writes only its own rows and
    publishes the next number.  Before that rename nothing has happened, after it
    all of it has: a crash at any point leaves one whole version in force.  Past
    ``COMPACT_AT`` parts a commit folds them into one; ``vacuum`` removes what no
    kept version names.  With ``history`` rows of all times are kept, so that
    ``pending_as_of`` can see the state of any moment.
    """

    COMPACT_AT = 16

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], history: bool = False):
        self.spark, self.root, self.keys, self.history = spark, root.rstrip("/"), list(keys), history

    def _files(self, name: str) -> list:
        fs, path = file_system(self.spark, self.root)
        at = path(f"{self.root}/{name}")
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def version(self) -> int | None:
        """The number of the version in force."""
        numbers = [int(f.getPath().getName()) for f in self._files("versions") if f.getPath().getName().isdigit()]
        return max(numbers, default=None)

    def parts(self, version: int | None) -> list[str]:
        if version is None:
            return []
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:09d}", wholetext=True).head()[0])

    def _rows(self, version: int | None, like: DataFrame) -> DataFrame:
        schema = like.select(*self.keys, F.current_timestamp().alias("at"), "content", "mtime", F.lit(0).cast("long").alias("seq")).schema
        for f in schema:
            f.nullable = True
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/parts/{p}" for p in parts])

    def _folded(self, rows: DataFrame) -> DataFrame:
        """The last row per key: by commit, and within one by time."""
        best = F.max(F.struct("seq", "at", "content", "mtime")).alias("_b")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col(f"_b.{c}").alias(c) for c in ("at", "content", "mtime", "seq")])

    def read(self, like: DataFrame) -> DataFrame:
        """(keys, content, mtime) in force; ``like`` gives the keys' types."""
        return self._folded(self._rows(self.version(), like)).select(*self.keys, "content", "mtime")

    def pending(self, current: DataFrame) -> DataFrame:
        return select_changed(current, self.read(current), self.keys)

    def pending_as_of(self, current: DataFrame, moment: str) -> DataFrame:
        """Rows of ``current`` that the state recorded before their ``moment`` lacks or holds with other content.

        One group per key: at most a row per key and recorded moment on one side and the key's current rows on the other.
        """
        state = self._rows(self.version(), current)
        kept = [c for c in current.columns if c not in self.keys]
        none = F.lit(None)
        on_state = F.struct(F.lit(False).alias("now"), F.struct("at", "seq", "content", "mtime").alias("s"), F.struct(*[none.cast(current.schema[c].dataType).alias(c) for c in kept]).alias("c"))
        empty = F.struct(*[none.cast(state.schema[c].dataType).alias(c) for c in ("at", "seq", "content", "mtime")])
        on_current = F.struct(F.lit(True).alias("now"), empty.alias("s"), F.struct(*kept).alias("c"))
        rows = state.select(*self.keys, on_state.alias("x")).unionByName(current.select(*self.keys, on_current.alias("x")))
        grouped = rows.groupBy(*self.keys).agg(F.collect_list("x").alias("xs"))
        before = lambda c: F.array_max(F.transform(F.filter("xs", lambda x: ~x["now"] & (x["s"]["at"] < c[moment])), lambda x: x["s"]))
        picked = F.transform(F.filter("xs", lambda x: x["now"]), lambda x: F.struct(x["c"].alias("c"), before(x["c"]).alias("s")))
        out = grouped.select(*self.keys, F.inline(picked))
        return out.where(differs(F.col("c.mtime"), F.col("c.content"), F.col("s.mtime"), F.col("s.content"))).select(*self.keys, *[F.col(f"c.{c}").alias(c) for c in kept]).select(*current.columns)

    def commit(self, done: DataFrame) -> int:
        """Record ``done`` (keys, content, mtime and, where known, ``at``) over the present state and swap."""
        at = F.col("at").cast("timestamp") if "at" in done.columns else F.current_timestamp()
        rows = done.select(*self.keys, at.alias("at"), "content", "mtime", F.lit(time.time_ns()).alias("seq") if not self.history else F.lit(0).cast("long").alias("seq"))
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in self.keys))
        if not self.history:
            rows = self._folded(rows)
        part = f"p-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/parts/{part}")
        while True:
            now = self.version()
            parts = [*self.parts(now), part]
            if len(parts) > self.COMPACT_AT:
                both = self._rows(now, done).unionByName(self.spark.read.parquet(f"{self.root}/parts/{part}"))
                whole = f"p-{uuid.uuid4().hex}"
                (both.distinct() if self.history else self._folded(both)).write.parquet(f"{self.root}/parts/{whole}")
                parts = [whole]
            try:
                return self._swap((now or 0) + 1, parts)
            except Conflict:
                continue  # the other one's rows are in force now; ours go on top of them

    def _swap(self, number: int, parts: list[str]) -> int:
        jvm = self.spark.sparkContext._jvm
        fs, path = file_system(self.spark, self.root)
        fresh, target = path(f"{self.root}/versions/.{uuid.uuid4().hex}"), path(f"{self.root}/versions/{number:09d}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fresh, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(fresh, False)
            if fs.exists(target):
                raise Conflict(f"version {number} is taken") from e
            raise
        return number

    def vacuum(self, keep: int = 2, grace_s: float = 86_400.0) -> int:
        """Remove versions but the newest ``keep``, and parts older than ``grace_s`` that none of those names; gives the number of parts removed."""
        fs, path = file_system(self.spark, self.root)
        numbers = sorted(int(f.getPath().getName()) for f in self._files("versions") if f.getPath().getName().isdigit())
        kept = {p for n in numbers[-keep:] for p in self.parts(n)}
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.root}/versions/{n:09d}"), False)
        old = [f.getPath() for f in self._files("parts") if f.getPath().getName() not in kept and f.getModificationTime() <= (time.time() - grace_s) * 1000]
        for p in old:
            fs.delete(p, True)
        return len(old)
