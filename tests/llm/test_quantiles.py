import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quantiles


def exact(values, p):
    v = np.sort(values)
    return v[max(1, (len(v) * p + 999) // 1000) - 1]


def test_every_percentile_is_a_value_of_its_rank(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_AT", 8)
    rng = np.random.default_rng(2)
    rows = []
    for g, values in {"heavy": np.exp(rng.normal(0, 3, 3000)), "ties": rng.integers(0, 4, 2000).astype(float), "one": [7.0], None: np.round(rng.normal(0, 1, 500), 1), "inf": [float("inf"), 1.0, float("-inf")]}.items():
        rows += [(g, int(k % 3), float(v)) for k, v in enumerate(values)]
    rows += [("heavy", 0, None), ("heavy", 1, float("nan")), ("empty", 1, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(4)
    permille = (1, 250, 500, 900, 999, 1000)
    parts = [quantiles.pieces(df.where(F.col("day") == d), ["g"], F.col("day"), F.col("v")) for d in range(3)]
    got = quantiles.multi_select(quantiles.combined(*parts), ["g"], permille).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "day", "v"]).dropna(subset="v")
    assert len(got) == 5 * len(permille) and (got.error_bound == 0).all()
    for r in got.itertuples():
        own = pdf[pdf.g.isna() if r.g is None or pd.isna(r.g) else pdf.g == r.g].v.to_numpy()
        assert r.value == exact(own, r.p) and r.n == len(own), r


def test_empty(spark):
    df = spark.createDataFrame([], "g string, day int, v double")
    assert quantiles.multi_select(quantiles.pieces(df, ["g"], F.col("day"), F.col("v")), ["g"], [500]).count() == 0


def test_local_medians_weigh_ties():
    b = pd.DataFrame({"gid": [1, 1, 1, 2], "p": [5, 5, 5, 5], "value": [3.0, 1.0, 2.0, 9.0], "n": [10, 1, 1, 4]})
    out = pd.concat(quantiles._local_medians([b]))
    assert out[["gid", "pivot", "w"]].values.tolist() == [[1, 3.0, 12], [2, 9.0, 4]]
    assert list(quantiles._local_medians([b[:0]])) == []


@pytest.mark.parametrize("least", [None, 0.0])
def test_pieces(spark, least):
    df = spark.createDataFrame([(1.0,), (-1.0,), (-0.0,), (0.0,)], "v double")
    got = {r.value: r.n for r in quantiles.pieces(df, [], F.lit(1), F.col("v"), least).collect()}
    assert got == ({1.0: 1, 0.0: 2} if least == 0.0 else {1.0: 1, -1.0: 1, 0.0: 2})
