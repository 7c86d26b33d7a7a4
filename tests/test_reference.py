import math
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import names, text
from leafmill.kernels import image
from leafmill.kernels.recognise import Reading, Stub, read_page, turned
from leafmill.operators import identity, layout, pages, progress, rescue, search, tree
from leafmill.plans import reference, training
from leafmill.settings import Settings, is_inside
from leafmill.sources import listing, readings


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).head().x


def test_settings_limits():
    with pytest.warns(UserWarning):
        s = Settings(dpi=5000, psm=99, workers=-4, output_layout="odd")
    assert (s.dpi, s.psm, s.workers >= 1, s.output_layout) == (600, 13, True, "by-folder")
    assert Settings.from_dict({"dpi": 100, "nonsense": 1, "outputs_grouped_by_type": True}).output_layout == "by-type"
    assert is_inside("/a/b", "/a") and not is_inside("/ab", "/a")


def test_natural_order(spark):
    for given, wanted in ((["10.", "2.", "1.", "20.", "11.", "3."], ["1.", "2.", "3.", "10.", "11.", "20."]), (["2a", "2", "10b", "10"], ["2", "2a", "10", "10b"]), (["a", "1", ""], ["", "1", "a"])):
        df = spark.createDataFrame([(x,) for x in given], "n string").orderBy(names.natural_key(F.col("n")))
        assert [r.n for r in df.collect()] == wanted
    assert sorted(["x10", "x9"], key=listing.natural) == ["x9", "x10"]


def test_basenames(spark):
    def run(*paths):
        df = spark.createDataFrame(list(enumerate(paths)), "i int, relpath string")
        return {r.relpath: r.base for r in names.output_basenames(df, "i").collect()}

    assert run("x.pdf", "x.png", "x_pdf.jpg") == {"x.pdf": "x_pdf", "x.png": "x_png", "x_pdf.jpg": "x_pdf (2)"}
    assert run("a/x.pdf", "b/x.png") == {"a/x.pdf": "x", "b/x.png": "x"}
    assert run("X.PDF", "x.png") == {"X.PDF": "X_pdf", "x.png": "x_png"}
    assert run("1. a.b.pdf") == {"1. a.b.pdf": "1. a.b"}


def test_paths(spark):
    r = F.lit("A/1. Plaintiff_Record.pdf")
    assert one(spark, names.output_path("out", r, names.stem(r), "txt", "by-folder")) == "out/A/txt/1. Plaintiff_Record.txt"
    assert one(spark, names.output_path("out", r, names.stem(r), "txt", "by-type")) == "out/txt/A/1. Plaintiff_Record.txt"
    assert one(spark, names.output_path("out", F.lit("a.pdf"), F.lit("a"), "txt", "together")) == "out/a.txt"
    assert one(spark, text.safe_relpath(F.lit("..\\a//./b\0/../c"))) == "a/b/c"


def test_tidy_and_counts(spark):
    assert one(spark, text.tidy(F.lit("A\r\n\r\n\r\n  B  \r\n"))) == "A\n\n  B"
    assert one(spark, text.word_count(F.lit(" a b c \n"))) == 3
    assert one(spark, text.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, text.occurrences(F.lit("Aa aA a"), "aa")) == 2
    assert one(spark, text.duration(F.lit(3725))) == "1h 2m" and one(spark, text.duration(F.lit(None).cast("int"))) == "0s"
    assert one(spark, text.byte_size(F.lit(1536))) == "1.5 KB" and one(spark, text.byte_size(F.lit(10))) == "10 B"


def test_review_and_rescue_predicates(spark):
    def flag(chars, conf):
        r = one(spark, pages.review(F.lit(conf).cast("double"), F.lit(chars)))
        return r.needs_review, r.review_reason

    assert flag(500, 52.0) == (True, "mean confidence 52 below 70")
    assert flag(2, 99.0) == (True, "almost no text on the page")
    assert flag(500, 91.0) == flag(500, None) == (False, None)
    bad = lambda t, c: one(spark, pages.reads_badly(F.lit(t), F.lit(c).cast("double")))
    assert [bad("x", 93.9), bad("x", 38.75), bad(" ", None), bad("x", None)] == [False, True, True, False]
    up = lambda t, c, t0, c0: one(spark, pages.improves_on(F.lit(t), F.lit(c).cast("double"), F.lit(t0), F.lit(c0).cast("double")))
    assert [up("x", 93.9, "x", 38.75), up("x", 41.0, "x", 38.75), up("x", 60.0, "x", 93.9), up("", 0.0, "x", 40.0), up("x", 30.0, " ", None)] == [True, False, False, False, True]


def reading(t, c):
    return (t, c)


def test_rescue_fold_and_kernel_agree(spark):
    cases = [
        (("x", 40.0), [(90, "x", 60.0), (180, "x", 90.0), (270, "x", 95.0)]),
        (("x", 40.0), [(90, "x", 80.0), (180, "x", 99.0), (270, "x", 99.0)]),
        (("", None), [(90, "", None), (180, "x", 99.0), (270, "x", 99.0)]),
        (("x", 60.0), [(90, "x", 63.0), (180, "", None), (270, "x", None)]),
    ]
    kind = "current struct<text:string,confidence:double>, tried array<struct<angle:int,text:string,confidence:double>>, k int"
    got = {r.k: r.turn for r in rescue.chosen_turn(spark.createDataFrame([(c, t, k) for k, (c, t) in enumerate(cases)], kind)).collect()}

    class Fake:
        def __init__(self, tries):
            self.tries = iter(tries)

        def read(self, *a):
            _, t, c = next(self.tries)
            return Reading(t, c)

        def orientation(self, im):
            return None

    page = np.full((1000, 40), 255, np.uint8)
    for k, (current, tries) in enumerate(cases):
        found = turned(page, Reading(*current), Fake(tries), Settings(deskew=False, denoise=False))
        assert got[k] == (found.angle if found else None), k


def test_candidate_angles(spark):
    assert one(spark, rescue.candidate_angles(F.lit(270))) == [270, 90, 180]
    assert one(spark, rescue.candidate_angles(F.lit(None).cast("int"))) == [90, 180, 270]


def place(words, txt=""):
    """The layout by plain loops, to hold the fold against."""
    widths = [(w[3] - w[1]) / len(w[0]) for w in words if w[0] and w[3] > w[1]]
    if not widths or statistics.median(widths) <= 0:
        return txt.strip()
    cw = statistics.median(widths)
    heights = [w[4] - w[2] for w in words if w[4] > w[2]]
    lh = statistics.median(heights) if heights else cw * 2
    lines = []
    for w in sorted(words, key=lambda w: ((w[2] + w[4]) / 2, w[1])):
        c = (w[2] + w[4]) / 2
        if lines and abs(c - lines[-1][0]) <= lh / 2:
            lines[-1][1].append(w)
            lines[-1][0] = (lines[-1][0] + c) / 2
        else:
            lines.append([c, [w]])
    gaps = [b[0] - a[0] for a, b in zip(lines, lines[1:])]
    pitch = statistics.median(gaps) if len(gaps) >= 3 else lh * 1.5
    pitch = pitch if pitch > 0 else lh * 1.5
    left, out = min(w[1] for w in words), []
    for k, (c, ws) in enumerate(lines):
        if k:
            out += [""] * max(0, min(4, round((c - lines[k - 1][0] - pitch) / pitch)))
        row = ""
        for w in sorted(ws, key=lambda w: w[1]):
            col = round((w[1] - left) / cw)
            if row and col <= len(row):
                col = len(row) + 1
            row = row.ljust(col) + w[0]
        out.append(row.rstrip())
    return "\n".join(out).strip()


def test_layout_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    sheets = [[("Name", 0.0, 0.0, 40.0, 10.0, 99.0), ("Value", 400.0, 0.0, 450.0, 10.0, 99.0), ("x", 41.0, 4.0, 51.0, 14.0, 1.0), ("low", 0.0, 90.0, 30.0, 100.0, 9.0)], [], None]
    for _ in range(15):
        sheets.append([(f"w{k}", float(x), float(y), float(x + 10 * rng.integers(1, 6)), float(y + rng.integers(8, 13)), 50.0) for k, (x, y) in enumerate(rng.integers(0, 400, (30, 2)))])
    kind = "page_id int, text string, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"
    df = spark.createDataFrame([(k, " plain ", s) for k, s in enumerate(sheets)], kind)
    for r in layout.laid_out(df).select("page_id", "laid_out").collect():
        words = sheets[r.page_id]
        assert r.laid_out == (place(words) if words else "plain"), r.page_id


def test_tree_and_search(spark):
    df = spark.createDataFrame([("a.pdf", 1), ("Medical/1. Intake.pdf", 2), ("Medical/Imaging/13.pdf", 5)], "relpath string, page_count int")
    got = {r.folder_path: (r.files, r.pages) for r in tree.folder_tree(df).collect()}
    assert got == {"": (3, 8), "Medical": (2, 7), "Medical/Imaging": (1, 5)}
    p = spark.createDataFrame([(1, "f", k, "ocr", "é" * 100 + "Martinez\nend") for k in range(3)] + [(2, "f", 1, "ocr", None)], "file_id bigint, relpath string, page_no int, source string, text string")
    rows = search.top_hits(p, "MARTINEZ", limit=2).collect()
    assert len(rows) == 2 and rows[0].truncated and rows[0].match == "Martinez" and rows[0].before == "…" + "é" * 90 and rows[0].after == " end"
    assert not search.top_hits(p, "MARTINEZ", limit=3).head().truncated
    with pytest.raises(ValueError):
        search.hits(p, " x ")


def test_readings(spark):
    rows = [("5", "1", "1", "1", "1", "1", "0", "0", "10", "10", "96.5", "Case"), ("5", "1", "1", "1", "1", "2", "20", "0", "10", "10", "45", 'N"o.'), ("5", "1", "1", "1", "2", "1", "0", "20", "5", "9", "88", "A-1"), ("4", "1", "1", "1", "2", "0", "0", "0", "9", "9", "-1", ""), ("5", "1", "1", "1", "2", "2", "x", "0", "9", "9", "50", "bad")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in readings.TSV_COLUMNS))
    r = readings.tsv_pages(readings.tsv_words(df, ("page_num",)), ("page_num",)).head()
    assert r.text == 'Case N"o.\nA-1' and abs(r.confidence - (96.5 + 45 + 88) / 3) < 0.01
    report = "Page number: 0\nOrientation in degrees: 90\nRotate: 270\nOrientation confidence: 21.83\nScript: Latin\nScript confidence: 2"
    o = one(spark, readings.orientation(F.lit(report)))
    assert (o.rotate, o.confidence, o.script) == (270, 21.83, "Latin")
    assert one(spark, readings.orientation(F.lit("Rotate: 45\nnothing"))) is None
    assert one(spark, readings.fitted_dpi(F.lit(8.5), F.lit(11.0), 300)) == 300 and one(spark, readings.fitted_dpi(F.lit(23.0), F.lit(30.0), 300)) * 30 <= 5000


def test_identity_and_status(spark):
    df = spark.createDataFrame([("a", "s1", 1), ("b", "s1", 0), ("c", "s2", 2)], "relpath string, k string, i int")
    assert {r.relpath: r.primary for r in identity.twins(df, "k", ["i"]).collect()} == {"a": "b", "b": "b", "c": "c"}
    st = spark.createDataFrame([(x,) for x in ("running", "discovering", "pending", "done", "failed", "cancelled")], "s string")
    assert [r.x for r in st.select(progress.shown_status(F.col("s")).alias("x")).collect()] == ["interrupted"] * 3 + ["done", "failed", "cancelled"]


def test_image_kernels():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (7, 5), dtype=np.uint8)
    assert (image.turn(image.turn(a, 90), 270) == a).all() and (image.turn(a, 180) == a[::-1, ::-1]).all()
    with pytest.raises(ValueError):
        image.turn(a, 45)
    page = np.full((1100, 850), 255, np.uint8)
    for y in range(80, 1000, 40):
        page[y : y + 12, 100:750] = 0
    assert image.skew(page) == 0.0 and image.skew(np.full((200, 200), 255, np.uint8)) == 0.0
    for angle in (3.0, -6.0, 20.0):
        assert abs(image.skew(image.rotate(page, angle)) + angle) <= 0.4
    assert image.prepare(page[:300]).image.shape[0] >= 1000
    row = read_page(page, None, Stub(), Settings())
    assert row["source"] == "ocr" and row["text"].startswith("line 1") and read_page(None, None, Stub(), Settings())["source"] == "failed"
    assert read_page(None, "word " * 60, Stub(), Settings())["source"] == "text-layer"


def test_a_whole_run(spark, tmp_path):
    from leafmill.runner import run_blocking
    from leafmill.sources.pixels import raster

    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "_runs").mkdir()
    page = np.full((1000, 300), 255, np.uint8)
    page[100:120, 20:280] = 0
    body = b"P5\n300 1000\n255\n" + page.tobytes()
    for p in (src / "2. b.png", src / "sub/10. c.png", src / "_runs/x.png", src / ".hidden.png"):
        p.write_bytes(body)
    (src / "broken.pdf").write_bytes(b"no pdf")
    (src / "notes.txt").write_text("ignored")
    s = Settings(input_dir=str(src), output_dir=str(tmp_path / "out"), deskew=False, denoise=False)
    events = []
    run = run_blocking(spark, s, raster, on_event=events.append)
    assert run.status == "done" and run.totals["files"] == 3 and run.totals["files_read"] == 2 and run.totals["pages"] == 2
    assert os.path.exists(tmp_path / "out/sub/txt/10. c.txt") and "line 1" in open(tmp_path / "out/txt/2. b.txt").read()
    again = run_blocking(spark, s, raster)
    assert again.totals["files_read"] == 0
    (src / "2. b.png").write_bytes(body + b" ")
    assert run_blocking(spark, s, raster).totals["files_read"] == 1
    from leafmill.service import browse, list_runs

    assert len(list_runs(str(tmp_path / "out"))) == 3 and browse(str(src))["folders"] == ["_runs", "sub"]


def test_event_stream_goes_on_where_it_ended(spark, tmp_path):
    from leafmill.streaming.events import stream_totals

    def put(name, rows):
        spark.createDataFrame(rows, "kind string, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put("a", [("x", 1.0), ("y", 2.0)])
    run = lambda: {r.kind: (r.n, r.total) for r in stream_totals(spark.readStream.schema("kind string, v double").parquet(f"{tmp_path}/in"), f"{tmp_path}/totals", "kind", "v", f"{tmp_path}/cp").collect()}
    assert run() == {"x": (1, 1.0), "y": (1, 2.0)}
    put("b", [("x", 4.0)])
    assert run() == {"x": (2, 5.0), "y": (1, 2.0)}
    assert run() == {"x": (2, 5.0), "y": (1, 2.0)}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted({**reference.QUERIES, **training.QUERIES}))
def test_queries_against_sql(spark, name):
    import duckdb

    queries, oracle = {**reference.QUERIES, **training.QUERIES}, {**reference.ORACLE, **training.ORACLE}
    df = queries[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert got
    if name not in oracle:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    res = con.execute(oracle[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(row[cols.index(c)] for c in sorted(cols)) for row in res.fetchall()]
    tidy = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    assert sorted(map(repr, (tuple(map(tidy, r)) for r in got))) == sorted(map(repr, (tuple(map(tidy, r)) for r in want)))
