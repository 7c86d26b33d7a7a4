"""Progress of runs: rates, running totals, statuses, recents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.settings import RECENT_SHOWN


def rate_columns(done: Column, total: Column, elapsed_s: Column) -> dict[str, Column]:
    rate = F.when((elapsed_s > 0) & (done > 0), done / elapsed_s).otherwise(F.lit(0.0))
    remaining = F.greatest(F.lit(0), total - done)
    return {
        "elapsed_s": F.bround(elapsed_s, 1),
        "pages_per_second": F.bround(rate, 2),
        "eta_s": F.when(rate > 0, F.bround(remaining / rate, 0).cast("bigint")),
        "percent": F.when(total > 0, F.least(F.lit(100.0), F.bround(done * 100.0 / total, 1))).otherwise(F.lit(0.0)),
    }


def shown_status(status: Column) -> Column:
    """A run read back from disk cannot be going on: unfinished statuses are interrupted ones."""
    return F.when(status.isin("running", "discovering", "pending"), "interrupted").otherwise(status)


def cumulative(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running counters per key over events in order: per-key windows, never one window over all."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select("*", F.count(F.lit(1)).over(w).alias("pages_done"), F.count_if(F.col("needs_review")).over(w).alias("pages_flagged"))


def recents(runs: DataFrame, live: DataFrame | None = None, shown: int = RECENT_SHOWN) -> DataFrame:
    """The newest runs; a run that is live counts with its live row, each run once."""
    rows = runs.select("run_id", "work_dir", "started_at", shown_status(F.col("status")).alias("status"), F.lit(0).alias("_live"))
    if live is not None:
        rows = rows.unionByName(live.select("run_id", "work_dir", "started_at", "status", F.lit(1).alias("_live")))
    one = rows.groupBy("run_id").agg(F.max_by(F.struct("work_dir", "started_at", "status"), "_live").alias("_r")).select("run_id", "_r.*")
    return one.orderBy(F.desc("started_at"), F.desc("run_id")).limit(shown)
