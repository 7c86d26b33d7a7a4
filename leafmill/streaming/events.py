"""The event log as a stream: totals per type kept up to date, and the log of lasting events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.storage import delete, file_system, new_path

LASTING = ("file", "done", "log", "phase")


class Totals:
    """A table of totals that micro-batches are folded into; batch ids make a repeated batch harmless."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], values: list[str]):
        self.spark, self.root, self.keys, self.values = spark, root, keys, values

    def versions(self) -> list[int]:
        fs, path = file_system(self.spark, self.root)
        if not fs.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.root}/v={v[-1]}") if v else None

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        done = self.versions()
        if batch_id in done:
            return
        fresh = batch.select(*self.keys, *self.values)
        earlier = [v for v in done if v < batch_id]
        old = self.spark.read.parquet(f"{self.root}/v={earlier[-1]}") if earlier else None
        rows = fresh if old is None else old.unionByName(fresh)
        merged = rows.groupBy(*self.keys).agg(*[F.sum(v).alias(v) for v in self.values])
        merged.coalesce(8).write.mode("overwrite").parquet(f"{self.root}/v={batch_id}")
        for v in earlier[:-2]:
            delete(self.spark, f"{self.root}/v={v}")


def stream_totals(source: DataFrame, root: str, key: str, value: str, checkpoint: str) -> DataFrame:
    """Runs all that is there now through the stream; (key, n, total) afterwards.  Started again, it goes on where it ended."""
    spark = source.sparkSession
    totals = Totals(spark, root, [key], ["n", "total"])

    def fold(batch: DataFrame, batch_id: int) -> None:
        totals.fold(batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")), batch_id)

    q = source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return totals.read()


def events_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = stream_totals(source, new_path(spark, "totals"), "event_type", "value", new_path(spark, "totals-checkpoint"))
    return out.select("event_type", "n", F.bround("total", 4).alias("total"))


def lasting_log(source: DataFrame, path: str, checkpoint: str):
    """Appends the lasting events of a stream to JSON files; returns the query."""
    kept = source.where(F.col("type").isin(*LASTING))
    return kept.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(events: DataFrame, every: int = 5) -> DataFrame:
    """Progress events at every ``every``-th page and at the last."""
    return events.where((F.col("done") % every == 0) | (F.col("done") == F.col("total")))


__all__ = ["Totals", "events_stream_totals", "lasting_log", "stream_totals", "throttled"]
