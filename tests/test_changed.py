from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators.changed import RECIPE_FIELDS, ChangeState, changed_per_run, content_hash
from leafmill.storage import new_path

T0 = datetime(2024, 1, 1)
RECIPE = "struct<dpi:int,lang:string,psm:int,force_ocr:boolean,deskew:boolean,denoise:boolean,orient:boolean,pdf_keeps_source_image:boolean,txt_keeps_layout:boolean>"
BASE = (300, "eng", 3, False, True, True, True, True, True)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def tables(spark, files, ledger, runs):
    f = spark.createDataFrame(files, "run_id string, relpath string, size_bytes bigint, modified double, error string, seen_at timestamp, extra int")
    h = spark.createDataFrame(ledger, f"work_dir string, relpath string, size bigint, mtime double, recipe {RECIPE}, recorded_at timestamp, run_id string, started_at timestamp")
    r = spark.createDataFrame(runs, f"run_id string, work_dir string, started_at timestamp, recipe {RECIPE}, seen_at timestamp")
    return f, h, r


def found(spark, files, ledger, runs):
    state = ChangeState(spark, new_path(spark, "state"), ["work_dir", "relpath"], history=True)
    return sorted(tuple(r) for r in changed_per_run(*tables(spark, files, ledger, runs), state).collect())


def test_new_changed_and_settled(spark):
    runs = [("r1", "w", at(0), BASE, None), ("r2", "w", at(100), BASE, None), ("r3", "w", at(200), (200, *BASE[1:]), None)]
    files = [(r, p, 10, 5.0, None, at(m), 0) for r, m in (("r1", 1), ("r2", 101), ("r3", 201)) for p in ("a", "b")]
    files += [("r2", "c", 7, -1.0, None, at(101), 0), ("r2", "bad", 7, 1.0, "broken", at(101), 0)]
    ledger = [
        ("w", "a", 10, 5.9, BASE, at(50), "r1", None),
        ("w", "b", 11, 5.0, BASE, at(50), "r1", None),  # other size
        ("w", "c", 7, -1.0, BASE, at(100), "r1", None),  # recorded as the run started: too late for it
        ("other", "b", 10, 5.0, BASE, at(50), "r1", None),
    ]
    assert found(spark, files, ledger, runs) == [("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "c"), ("r3", "a"), ("r3", "b")]


def test_latest_row_of_each_side_counts(spark):
    runs = [("r", "w", at(100), BASE, None)]
    files = [("r", "a", 1, 1.0, None, at(1), 0), ("r", "a", 2, 1.0, None, at(2), 0), ("r", "a", 2, 1.0, None, at(2), 0)]
    files += [("r", "e", 1, 1.0, None, at(1), 0), ("r", "e", 1, 1.0, "late error", at(2), 0)]
    ledger = [("w", "a", 2, 1.0, BASE, at(5), "x", None), ("w", "a", 1, 1.0, BASE, at(4), "x", None), ("w", "a", 9, 1.0, BASE, at(101), "x", None)]
    assert found(spark, files, ledger, runs) == []


def test_nulls_nan_and_tolerance(spark):
    none = tuple([None] * len(RECIPE_FIELDS))
    runs = [("r", "w", at(100), none, None), (None, "w", at(100), BASE, None), ("open", "w", None, BASE, None)]
    files = [("r", p, 1, m, None, at(1), 0) for p, m in (("null", None), ("nan", float("nan")), ("edge", 2.0), ("over", 2.01), ("unknown", 9.0))]
    files += [(None, "x", 1, 1.0, None, at(1), 0), ("r", None, 1, 1.0, None, at(1), 0), ("open", "edge", 1, 1.0, None, None, 0)]
    ledger = [("w", p, 1, 1.0, none, at(1), "x", None) for p in ("null", "nan", "edge", "over")] + [("w", "unknown", 1, -1.0, none, at(1), "x", None)]
    ledger += [(None, "edge", 1, 1.0, none, at(1), "x", None), ("w", None, 1, 1.0, none, at(1), "x", None), ("w", "edge", 5, 1.0, none, None, "x", None)]
    assert found(spark, files, ledger, runs) == [("open", "edge"), ("r", "nan"), ("r", "null"), ("r", "over")]


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [("r", "a", 1, 1.0, None, at(1), 0)], [], [("r", "w", at(2), BASE, None)]) == [("r", "a")]


def test_hash_keeps_neighbours_and_nulls_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("abc", None)], "x string, y string")
    assert df.select(content_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 5


def rows(spark, *items):
    return spark.createDataFrame([(k, c, m) for k, c, m in items], "k string, content string, mtime double")


def test_state_survives_a_crash_between_write_and_swap(spark, tmp_path, monkeypatch):
    state = ChangeState(spark, f"file://{tmp_path}/state", ["k"])
    first = rows(spark, ("a", "1", 1.0), ("b", "1", 1.0), (None, "1", 1.0))
    assert {r.k for r in state.pending(first).collect()} == {"a", "b", None}
    state.commit(first)
    again = rows(spark, ("a", "1", 1.5), ("b", "2", 1.0), ("c", "1", 1.0))
    assert {r.k for r in state.pending(again).collect()} == {"b", "c"}
    before = state.version()
    monkeypatch.setattr(state, "_swap", lambda *v: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        state.commit(again)
    monkeypatch.undo()
    assert state.version() == before
    assert {r.k for r in state.pending(again).collect()} == {"b", "c"}
    state.commit(state.pending(again))
    assert state.pending(again).count() == 0
    assert sorted((r.k, r.content) for r in state.read(first).collect()) == [("a", "1"), ("b", "2"), ("c", "1")]


def test_two_committers_keep_both_their_rows(spark, tmp_path, monkeypatch):
    one = ChangeState(spark, f"file://{tmp_path}/state", ["k"])
    two = ChangeState(spark, f"file://{tmp_path}/state", ["k"])
    one.commit(rows(spark, ("a", "1", 1.0)))
    seen = one.version
    stale = iter([1])
    two.commit(rows(spark, ("b", "1", 1.0)))
    # the first still believes version 1 to be the newest: its swap meets version 2 and is made again on top of it
    monkeypatch.setattr(one, "version", lambda: next(stale, None) or seen())
    one.commit(rows(spark, ("c", "1", 1.0)))
    monkeypatch.undo()
    assert one.version() == 3 and {r.k for r in one.read(rows(spark, ("x", "1", 1.0))).collect()} == {"a", "b", "c"}


def test_parts_are_folded_and_old_ones_removed(spark, tmp_path):
    state = ChangeState(spark, f"file://{tmp_path}/state", ["k"])
    state.COMPACT_AT = 2
    for n in range(4):
        state.commit(rows(spark, ("a", str(n), 1.0), (f"k{n}", "1", 1.0)))
    like = rows(spark, ("x", "1", 1.0))
    whole = {(r.k, r.content) for r in state.read(like).collect()}
    assert whole == {("a", "3"), ("k0", "1"), ("k1", "1"), ("k2", "1"), ("k3", "1")}
    assert len(state.parts(state.version())) <= 2
    assert state.vacuum(keep=1, grace_s=0.0) > 0
    assert {(r.k, r.content) for r in state.read(like).collect()} == whole
    assert len(state._files("parts")) == len(state.parts(state.version()))


def test_crash_while_writing_a_part_changes_nothing(spark, tmp_path):
    state = ChangeState(spark, f"file://{tmp_path}/state", ["k"])
    state.commit(rows(spark, ("a", "1", 1.0)))
    bad = rows(spark, ("b", "1", 1.0)).withColumn("content", F.raise_error(F.lit("died")).cast("string"))
    with pytest.raises(Exception, match="died"):
        state.commit(bad)
    assert state.version() == 1 and state.pending(rows(spark, ("a", "1", 1.0), ("b", "1", 1.0))).count() == 1
