"""Text laid out as it stood on the page, from word boxes.

The folds run inside the row over one page's words (a bounded array), as
higher-order functions: no page is collected anywhere, none is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import stripped


def _median(values: Column) -> Column:
    """Interpolated median of an array without nulls, null for an empty one."""
    s = F.array_sort(values)
    n = F.size(s)
    lower, upper = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def char_width(words: Column) -> Column:
    """Median width of a character over words with text and width."""
    good = F.filter(words, lambda w: (F.length(w["text"]) > 0) & (w["x1"] > w["x0"]))
    return _median(F.transform(good, lambda w: (w["x1"] - w["x0"]) / F.length(w["text"])))


def line_height(words: Column) -> Column:
    good = F.filter(words, lambda w: w["y1"] > w["y0"])
    return F.coalesce(_median(F.transform(good, lambda w: w["y1"] - w["y0"])), char_width(words) * 2)


def with_lines(pages: DataFrame, words: str = "words") -> DataFrame:
    """Adds ``lines``: array of struct(centre, words) from top to bottom, beside the page's metrics.

    A word joins the line above it while its centre is within half a line height
    of the line's running centre, which then moves half way to the word.
    """
    w = F.coalesce(F.col(words), F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"))
    df = pages.withColumns({"_cw": char_width(w), "_lh": line_height(w)})
    ordered = F.array_sort(F.transform(w, lambda x: F.struct(((x["y0"] + x["y1"]) / 2).alias("c"), x["x0"].alias("x0"), x["text"].alias("text"))))
    df = df.withColumn("_ordered", ordered)
    kind = "struct<done:array<struct<centre:double,words:array<struct<x0:double,text:string>>>>,centre:double,words:array<struct<x0:double,text:string>>>"
    start = F.expr(f"cast(named_struct('done', array(), 'centre', null, 'words', array()) as {kind})")

    def step(acc, x):
        word = F.struct(x["x0"].alias("x0"), x["text"].alias("text"))
        near = acc["centre"].isNotNull() & (F.abs(x["c"] - acc["centre"]) <= F.col("_lh") * 0.5)
        closed = F.when(acc["centre"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["centre"].alias("centre"), acc["words"].alias("words")))))
        return F.struct(
            F.when(near, acc["done"]).otherwise(closed).alias("done"),
            F.when(near, (acc["centre"] + x["c"]) / 2).otherwise(x["c"]).alias("centre"),
            F.when(near, F.concat(acc["words"], F.array(word))).otherwise(F.array(word)).alias("words"),
        )

    def finish(acc):
        return F.when(acc["centre"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["centre"].alias("centre"), acc["words"].alias("words")))))

    return df.withColumn("lines", F.aggregate("_ordered", start, step, finish)).drop("_ordered")


def line_pitch(lines: Column, height: Column) -> Column:
    """Median gap between lines from three gaps on, else one and a half line heights."""
    gaps = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda ln, i: ln["centre"] - F.get(lines, i)["centre"])
    pitch = F.when(F.size(gaps) >= 3, _median(gaps)).otherwise(height * 1.5)
    return F.when(pitch > 0, pitch).otherwise(height * 1.5)


def laid_out(pages: DataFrame, words: str = "words", text: str = "text") -> DataFrame:
    """Adds ``laid_out``: the page's text with its columns and blank lines; plain text where boxes say nothing."""
    df = with_lines(pages, words)
    df = df.withColumn("_pitch", line_pitch(F.col("lines"), F.col("_lh")))
    df = df.withColumn("_left", F.array_min(F.transform(F.coalesce(F.col(words), F.array()), lambda w: w["x0"])))

    def row(ln):
        def place(acc, w):
            col = F.bround((w["x0"] - F.col("_left")) / F.col("_cw"), 0).cast("int")
            col = F.when((F.length(acc) > 0) & (col <= F.length(acc)), F.length(acc) + 1).otherwise(col)
            return F.concat(acc, F.repeat(F.lit(" "), F.greatest(col - F.length(acc), F.lit(0))), w["text"])

        return F.regexp_replace(F.aggregate(F.array_sort(ln["words"]), F.lit(""), place), r"(?U)\s+$", "")

    def blanks(ln, i):
        gap = ln["centre"] - F.get(F.col("lines"), i - 1)["centre"]
        n = F.bround((gap - F.col("_pitch")) / F.col("_pitch"), 0).cast("int")
        return F.when(i == 0, F.lit("")).otherwise(F.repeat(F.lit("\n"), F.least(F.greatest(n, F.lit(0)), F.lit(4))))

    body = F.array_join(F.transform("lines", lambda ln, i: F.concat(blanks(ln, i), row(ln))), "\n")
    usable = F.coalesce(F.col("_cw") > 0, F.lit(False))
    return df.withColumn("laid_out", F.when(usable, stripped(body)).otherwise(stripped(F.coalesce(F.col(text), F.lit(""))))).drop("_cw", "_lh", "_pitch", "_left", "lines")


def line_gaps(pages: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, line_no, centre, gap) of the lines of every page."""
    df = with_lines(pages, words)
    out = F.transform("lines", lambda ln, i: F.struct(i.alias("line_no"), ln["centre"].alias("centre"), (ln["centre"] - F.get(F.col("lines"), i - 1)["centre"]).alias("gap")))
    return df.select(*keys, F.inline(out))


def words_from_chars(chars: Column) -> Column:
    """Words of a page from its characters (array of c and box, in order): runs between white space, boxes united, confidence 100.

    First and last places of the runs are found in one pass each; all of it happens inside the row.
    """
    solid = F.transform(chars, lambda x: x["c"].rlike(r"(?U)\S"))
    places = F.sequence(F.lit(0), F.size(chars) - 1)
    # (the neighbour's flag comes with each place, so no step looks the array up again)
    flags = F.arrays_zip(places.alias("i"), solid.alias("on"), F.concat(F.array(F.lit(False)), solid).alias("was"), F.concat(F.slice(solid, 2, F.size(chars)), F.array(F.lit(False))).alias("goes"))
    flags = F.filter(flags, lambda x: x["on"])
    first = F.transform(F.filter(flags, lambda x: ~x["was"]), lambda x: x["i"])
    last = F.transform(F.filter(flags, lambda x: ~x["goes"]), lambda x: x["i"])

    def word(span):
        # (places are looked up one by one: a slice would copy the whole page for every word)
        part = lambda k: F.transform(F.sequence(span["a"], span["b"]), lambda i: F.get(chars, i)[k])
        box = [f(part(k)).alias(k) for f, k in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
        return F.struct(F.array_join(part("c"), "").alias("word"), *box, F.lit(100.0).alias("confidence"))

    return F.when(F.size(chars) > 0, F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), word))


def lines_by_band(words: Column, band: float) -> Column:
    """Lines of a page from words in bands of equal height: array of (line_key, line, x0, x1), inside the row."""
    key = lambda w: F.floor(w["y0"] / band).cast("bigint")
    keys = F.array_distinct(F.transform(words, key))

    def line(k):
        own = F.filter(words, lambda w: key(w).eqNullSafe(k))
        return F.struct(
            k.alias("line_key"), F.array_join(F.transform(own, lambda w: w["text"]), " ").alias("line"),
            F.array_min(F.transform(own, lambda w: w["x0"])).alias("x0"), F.array_max(F.transform(own, lambda w: w["x1"])).alias("x1"),
        )

    return F.transform(keys, line)
