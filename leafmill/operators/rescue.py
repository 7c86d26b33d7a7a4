"""Which of several turned readings of a page to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import is_blank
from leafmill.operators.pages import improves_on, reads_badly
from leafmill.settings import MIN_CONFIDENCE

QUARTERS = (90, 180, 270)


def candidate_angles(hint: Column) -> Column:
    """The hinted quarter turn first, then the others in order; no hint, no change."""
    all_ = F.array(*[F.lit(a) for a in QUARTERS])
    return F.when(hint.isin(*QUARTERS), F.array_prepend(F.array_remove(all_, hint), hint)).otherwise(all_)


def chosen_turn(pages: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Adds ``turn`` to rows with ``current`` and ``tried`` (in order): the angle kept, or null.

    struct(text, confidence) each, ``tried`` with an angle.  The fold stops when the first
    try and the current reading are both blank, and when a kept reading is good enough.
    """
    kind = "struct<angle:int,confidence:double,over:boolean,k:int>"
    start = F.expr(f"cast(named_struct('angle', null, 'confidence', null, 'over', false, 'k', 0) as {kind})")
    cur_text, cur_conf = F.col("current.text"), F.col("current.confidence")

    def step(acc, t):
        hopeless = (acc["k"] == 0) & is_blank(t["text"]) & is_blank(cur_text)
        better = improves_on(t["text"], t["confidence"], cur_text, cur_conf) & (acc["angle"].isNull() | (F.coalesce(t["confidence"], F.lit(0.0)) > F.coalesce(acc["confidence"], F.lit(0.0))))
        take = ~acc["over"] & ~hopeless & better
        return F.struct(
            F.when(take, t["angle"]).otherwise(acc["angle"]).alias("angle"),
            F.when(take, t["confidence"]).otherwise(acc["confidence"]).alias("confidence"),
            (acc["over"] | hopeless | (take & ~reads_badly(t["text"], t["confidence"], minimum))).alias("over"),
            (acc["k"] + 1).alias("k"),
        )

    return pages.withColumn("turn", F.aggregate("tried", start, step, lambda acc: acc["angle"]))
