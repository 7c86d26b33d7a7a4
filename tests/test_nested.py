import json
from datetime import datetime

from leafmill.operators.nested import flat_files, flat_pages, flat_words, found_words

W = lambda *t: [{"text": x, "box": [1, "2", 3.5, 4], "confidence": 9} for x in t]


def raw(spark, *payloads):
    rows = [(i, datetime(2024, 1, 1), p, "clash") for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "record_id bigint, received_at timestamp, payload string, words string")


def words(spark, *payloads):
    return sorted(tuple(r) for r in found_words(raw(spark, *payloads)).collect())


def test_every_shape(spark):
    single = {"relpath": "a", "pages": [{"page": 1, "words": 2, "word_boxes": W("x", "y")}, {"page": 2, "words": W("z")}]}
    listed = {"run_id": "r", "files": [{"relpath": "a", "pages": None}, single]}
    wrapped = {"document": single, "tool": "t"}
    got = words(spark, json.dumps(single), json.dumps(listed), json.dumps(json.dumps(wrapped)), json.dumps(json.dumps(json.dumps(single))))
    one = [(0, 0, "x"), (0, 1, "y"), (1, 0, "z")]
    assert got == [(r, f, *w) for r, f in ((0, 0), (1, 1), (2, 0), (3, 0)) for w in one]


def test_what_cannot_be_parsed_gives_nothing(spark):
    whole = json.dumps({"pages": [{"word_boxes": W("x")}]})
    assert words(spark, None, "", "null", "[]", "3", '"text"', whole[:-4], "{") == []


def test_nulls_keep_positions(spark):
    p = {"pages": [{"word_boxes": None, "words": 4}, {"word_boxes": []}, {"word_boxes": [None, {"text": None}, {"text": "b", "box": None}]}]}
    got = [tuple(r) for r in found_words(raw(spark, json.dumps(p))).collect()]
    assert sorted(got, key=str) == sorted([(0, 0, 2, 0, None), (0, 0, 2, 1, None), (0, 0, 2, 2, "b")], key=str)


def test_repeated_records_count_once(spark):
    p = json.dumps({"pages": [{"words": W("x")}]})
    df = raw(spark, p)
    assert found_words(df.union(df)).count() == 1
    other = raw(spark, json.dumps({"pages": [{"words": W("x")}]}, indent=1))
    assert found_words(df.union(other)).count() == 1


def test_boxes_and_parents(spark):
    p = {"document": {"relpath": "a", "size_bytes": 5, "pages": [{"page": 3, "size_px": [7], "words": W("x"), "confidence": None, "chars": 1}]}}
    df = raw(spark, json.dumps(p))
    w = flat_words(df).head()
    assert (w.x0, w.y0, w.x1, w.y1, w.confidence) == (1.0, 2.0, 3.5, 4.0, 9.0)
    page = flat_pages(df).head()
    assert (page.file_pos, page.page_pos, page.page_no, page.width_px, page.height_px, page.confidence) == (0, 0, 3, 7, None, None)
    assert flat_files(df).head().relpath == "a"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "record_id bigint, received_at timestamp, payload string")
    assert found_words(empty).count() == 0
