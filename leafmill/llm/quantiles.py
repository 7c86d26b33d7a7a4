"""Percentiles per group over very many numbers by distributed multi-select.

Values are first folded into *pieces*: (group, piece, value, n) rows, one per
distinct value of a group and piece (a day, a partition, a load).  Pieces are
plain tables, made independently, stored, and put together by a union; counts
add, so percentiles of any union of pieces are exact (error bound 0).

Selection never sorts a group.  For every (group, percentile) still open, each
batch of rows proposes its local weighted median of the values in the open
range; the weighted median of those proposals becomes the pivot; the rows below
and at the pivot are counted; the range that cannot hold the wanted rank is
discarded; and so on until the pivot is the answer or its range holds one value.
At least a quarter of the open rows goes with every pivot, so the number of
rounds grows with the logarithm of the distinct values.  Each round reads the
pieces twice (for proposals, then for counts) and shuffles only proposals and counts: a few rows per batch and
open target, wherever the rows of a group lie and however large it is.

Defined results: a percentile is the smallest value v with at least p of the
values <= v (nearest rank); nulls, NaN and values below ``least`` take no part;
-0.0 is 0.0; a null group is a group of its own; a group without values has no
row; an empty table gives an empty result; infinite values are ordinary values.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.storage import materialise

#: Open rows below which a round finishes exactly: a target's remaining distinct values are ranked in one pass.
FINISH_AT = 4096
#: Rounds are bounded by this many; 64-bit values cannot need more with a quarter discarded each time.
MOST_ROUNDS = 200


def pieces(df: DataFrame, groups: Sequence[str], piece: Column, value: Column, least: float | None = None) -> DataFrame:
    """(groups, piece, value, n): the mergeable summary of ``value``; counts meet map-side."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    if least is not None:
        ok &= v >= F.lit(float(least))
    rows = df.where(ok).select(*groups, piece.alias("piece"), (v + F.lit(0.0)).alias("value"))
    return rows.groupBy(*groups, "piece", "value").agg(F.count(F.lit(1)).alias("n"))


def combined(*parts: DataFrame) -> DataFrame:
    """Pieces of several days, partitions or loads as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PROPOSAL = T.StructType(
    [
        T.StructField("gid", T.LongType()),
        T.StructField("p", T.IntegerType()),
        T.StructField("pivot", T.DoubleType()),
        T.StructField("w", T.LongType()),
    ]
)


def _local_medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and target the weighted median of its open values, with the batch's weight."""
    for b in batches:
        if not len(b):
            continue
        gid, p, v, n = (b[c].to_numpy() for c in ("gid", "p", "value", "n"))
        order = np.lexsort((v, p, gid))
        gid, p, v, n = gid[order], p[order], v[order], n[order]
        first = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (p[1:] != p[:-1])])
        upto = np.cumsum(n)
        before = np.r_[0, upto[first[1:] - 1]]
        last = np.r_[first[1:], len(v)] - 1
        weight = upto[last] - before
        at = np.searchsorted(upto, before + (weight + 1) // 2)
        yield pd.DataFrame({"gid": gid[first], "p": p[first], "pivot": v[at], "w": weight})


def multi_select(summary: DataFrame, groups: Sequence[str], permille: Sequence[int]) -> DataFrame:
    """(groups, p, n, value, error_bound) for every group and percentile, p in thousandths.

    The state of the search (one row per group and percentile) is a small table
    beside the pieces, joined by key; it is written each round so that lineage
    stays short and a lost executor costs one round at most.
    """
    spark = summary.sparkSession
    values = materialise(summary.groupBy(*groups, "value").agg(F.sum("n").alias("n")), "pieces")
    totals = materialise(values.groupBy(*groups).agg(F.sum("n").alias("total")), "groups")
    # groups are named by a hash in the rounds, under the first salt that keeps them all apart; the true keys come back in the end
    for salt in itertools.count():
        gid = F.xxhash64(F.lit(salt), *[F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in groups]).alias("gid")
        names = totals.select(gid, *groups, "total")
        if names.groupBy("gid").count().where("count > 1").isEmpty():
            break
    pieces_ = values.select(gid, "value", "n")
    targets = F.explode(F.array(*[F.lit(int(p)) for p in permille]))
    state = names.select("gid", targets.alias("p"), "total").select(
        "gid",
        "p",
        F.expr("(total * p + 999) div 1000").alias("rank"),  # wanted rank among the open values
        F.lit(float("-inf")).alias("lo"),
        F.lit(float("inf")).alias("hi"),
        F.col("total").alias("open"),
        F.lit(None).cast("double").alias("value"),
    )
    state = state.withColumn("rank", F.greatest("rank", F.lit(1)))
    rows = pieces_.select("gid", "value", "n")
    for _ in range(MOST_ROUNDS):
        state = materialise(state, "select")
        left = state.where("value is null").agg(F.max("open").alias("open")).head()[0]
        if left is None:
            break
        search = state.where("value is null")
        live = rows.join(search.select("gid", "p", "lo", "hi"), "gid").where("value >= lo and value <= hi").select("gid", "p", "value", "n")
        if left <= FINISH_AT:
            # every open range is small now: rank its distinct values; groups of this window hold FINISH_AT rows at most
            from pyspark.sql import Window

            ranked = live.withColumn("upto", F.sum("n").over(Window.partitionBy("gid", "p").orderBy("value")))
            found = ranked.join(search.select("gid", "p", "rank"), ["gid", "p"]).where("upto >= rank").groupBy("gid", "p").agg(F.min("value").alias("found"))
            state = state.join(found, ["gid", "p"], "left").withColumn("value", F.coalesce("value", "found")).drop("found")
            continue
        proposals = live.mapInPandas(_local_medians, _PROPOSAL)
        pivots = proposals.groupBy("gid", "p").agg(F.expr("percentile(pivot, 0.5, w)").alias("mid"))
        # the interpolated median of the proposals may lie between two of them; counting needs no member of the set
        counted = (
            live.join(pivots, ["gid", "p"])
            .groupBy("gid", "p", "mid")
            .agg(
                F.sum(F.when(F.col("value") < F.col("mid"), F.col("n")).otherwise(0)).alias("below"),
                F.sum(F.when(F.col("value") == F.col("mid"), F.col("n")).otherwise(0)).alias("at"),
                F.max(F.when(F.col("value") < F.col("mid"), F.col("value"))).alias("under"),
                F.min(F.when(F.col("value") > F.col("mid"), F.col("value"))).alias("over"),
            )
        )
        s = state.join(counted, ["gid", "p"], "left")
        settled = F.col("value").isNotNull()
        low = F.col("rank") <= F.col("below")
        here = ~low & (F.col("rank") <= F.col("below") + F.col("at"))
        state = s.select(
            "gid",
            "p",
            F.when(settled | low | here, F.col("rank")).otherwise(F.col("rank") - F.col("below") - F.col("at")).alias("rank"),
            F.when(settled | low | here, F.col("lo")).otherwise(F.col("over")).alias("lo"),
            F.when(~settled & low, F.col("under")).otherwise(F.col("hi")).alias("hi"),
            F.when(settled | here, F.col("open")).when(low, F.col("below")).otherwise(F.col("open") - F.col("below") - F.col("at")).alias("open"),
            F.when(settled, F.col("value")).when(here, F.col("mid")).alias("value"),
        )
    else:
        raise RuntimeError("the selection did not end")
    out = state.join(names, "gid")
    return out.select(*groups, "p", F.col("total").alias("n"), "value", F.lit(0.0).alias("error_bound"))


def page_percentiles(pages: DataFrame, groups: Sequence[str], permille: Sequence[int] = (250, 500, 900, 990)) -> DataFrame:
    """Percentiles of confidence and duration of unique pages per group, from one piece per day of read_at.

    Both columns go through one selection: the metric is part of the group.
    """
    day = F.to_date("read_at")
    keys = ["metric", *groups]
    known = F.when(F.col("duration_ms") >= 0, F.col("duration_ms").cast("double"))
    base = pages.withColumn("_known", known).select(*groups, day.alias("_day"), F.expr("stack(2, 'confidence', confidence, 'duration_ms', _known) as (metric, v)"))
    summary = pieces(base, keys, F.col("_day"), F.col("v"))
    return multi_select(summary, keys, permille)


def grouping_percentiles(pages: DataFrame, permille: Sequence[int] = (250, 500, 900, 990)) -> DataFrame:
    """Percentiles of pages per source, source and folder, source and day, and all three.

    The finest pieces (source, folder and day) are made once; those of the coarser groupings are put together from them.
    """
    known = F.when(F.col("duration_ms") >= 0, F.col("duration_ms").cast("double"))
    base = pages.withColumn("day", F.to_date("read_at")).withColumn("_known", known)
    base = base.select("source", "folder", "day", F.expr("stack(2, 'confidence', confidence, 'duration_ms', _known) as (metric, v)"))
    finest = materialise(pieces(base, ["metric", "source", "folder", "day"], F.col("day"), F.col("v")).drop("piece"), "finest")
    none, no_day = F.lit(None).cast("string"), F.lit(None).cast("date")
    sets = [("source", none, no_day), ("source, folder", F.col("folder"), no_day), ("source, day", none, F.col("day")), ("source, folder, day", F.col("folder"), F.col("day"))]
    all_sets = combined(*[finest.select(F.lit(name).alias("grouping"), "metric", "source", f.alias("folder"), d.alias("day"), "value", "n") for name, f, d in sets])
    return multi_select(all_sets, ["grouping", "metric", "source", "folder", "day"], permille)
