import json
import re
import shutil
import uuid

import numpy as np
from pyspark.sql import functions as F

from leafmill.kernels.program import Program
from leafmill.kernels.recognise import Reading, read_page
from leafmill.runner import Run, run_blocking
from leafmill.settings import Settings
from leafmill.sources.listing import discover
from leafmill.sources.pixels import raster


def test_only_files_read_in_whole_are_done(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    picture = b"P5 8 8 255\n" + bytes(16) + b"\xff" * 48
    for name in ("a.png", "b.png"):
        (inbox / name).write_bytes(picture + name.encode())  # (content apart: no twins)
    (inbox / "c.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Page ")  # two pages, of which one is read

    def pixels(unread):
        def run(files):
            page = F.when(F.col("relpath").isin(*unread) | ((F.col("relpath") == "c.pdf") & (F.col("page_no") == 2)), F.lit(None)).otherwise(F.lit(picture[-64:]))
            return raster(files).withColumns({"pixels": page, "width": F.lit(8), "height": F.lit(8)})

        return run

    s = Settings(input_dir=str(inbox), output_dir=str(tmp_path / "out"), write_pdf=False)
    first = run_blocking(spark, s, pixels(["b.png"])).totals
    assert (first["files_read"], first["failed"]) == (3, 2)
    again = run_blocking(spark, s, pixels(["-"])).totals
    assert (again["files_read"], again["failed"]) == (2, 1)  # b.png and c.pdf once more
    assert run_blocking(spark, s, pixels(["-"])).totals["files_read"] == 1
    none = run_blocking(spark, s, lambda files: raster(files).limit(0)).totals  # no page rows at all
    assert none["files_read"] == 1 and run_blocking(spark, s, pixels(["-"])).totals["files_read"] == 1


def folder(tmp_path, *names, same=()):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in names:
        (inbox / name).write_bytes(b"P5 8 8 255\n" + bytes(16) + b"\xff" * 48 + (b"same" if name in same else name.encode()))
    marks = tmp_path / "marks"
    marks.mkdir()
    where = str(marks)

    class Counting:
        """Reads every page alike and leaves a mark for each."""

        def read(self, image, lang="eng", psm=3, dpi=None):
            with open(f"{where}/{uuid.uuid4().hex}", "w"):
                pass
            words = [{"text": w, "x0": x, "y0": 10.0, "x1": x + 40, "y1": 20.0, "confidence": 90.0} for w, x in (("left", 0.0), ("mid", 60.0), ("right", 320.0))]
            return Reading("left mid right " + "more " * 12, 90.0, words)

        def orientation(self, image):
            return None

    return inbox, marks, Counting


def test_twins_are_copied_and_cached_pages_are_not_read_again(spark, tmp_path):
    inbox, marks, make = folder(tmp_path, "a.png", "b.png", "c.png", same=("a.png", "c.png"))
    s = Settings(input_dir=str(inbox), output_dir=str(tmp_path / "out"), write_pdf=False, duplicates="content")
    t = run_blocking(spark, s, raster, make).totals
    assert (t["files_read"], t["files_copied"], t["pages"], t["written"]) == (2, 1, 3, 6) and len(list(marks.iterdir())) == 2
    doc = json.loads((tmp_path / "out" / "json" / "c.json").read_text())["document"]
    assert doc["relpath"] == "c.png" and [w["text"] for w in doc["pages"][0]["word_boxes"]] == ["left", "mid", "right"]
    assert re.search(r"left   ?mid {20,}right", (tmp_path / "out" / "txt" / "a.txt").read_text())
    # state gone, cache kept: a run begun anew reads no page
    shutil.rmtree(tmp_path / "out" / "_cache" / "state")
    t = run_blocking(spark, s, raster, make).totals
    assert t["pages_resumed"] == 2 and len(list(marks.iterdir())) == 2


def test_files_are_numbered_in_natural_order(spark, tmp_path):
    inbox, _, make = folder(tmp_path, "10. x.png", "2. x.png", "1. x.png")
    assert [r.relpath for r in discover(spark, str(inbox)).orderBy("file_index").collect()] == ["1. x.png", "2. x.png", "10. x.png"]


def test_plain_text_without_boxes(spark, tmp_path):
    inbox, _, make = folder(tmp_path, "a.png")
    s = Settings(input_dir=str(inbox), output_dir=str(tmp_path / "out"), write_pdf=False, txt_keeps_layout=False, include_word_boxes=False)
    run_blocking(spark, s, raster, make)
    assert "left mid right" in (tmp_path / "out" / "txt" / "a.txt").read_text()
    assert '"word_boxes"' not in (tmp_path / "out" / "json" / "a.json").read_text()


def test_cancelled_runs_record_nothing_and_listeners_begin_with_a_snapshot(spark, tmp_path):
    inbox, marks, make = folder(tmp_path, "a.png")
    s = Settings(input_dir=str(inbox), output_dir=str(tmp_path / "out"), write_pdf=False)
    run = Run(s)
    q = run.subscribe()
    run.listeners.append(lambda e: run.cancel() if e.get("phase") == "reading" else None)
    assert run.start_in_background(spark, raster, make).join(120) and run.status == "cancelled"
    events = [q.get_nowait() for _ in range(q.qsize())]
    assert events[0]["type"] == "snapshot" and events[-1] == {"type": "done", "status": "cancelled", "run_id": run.run_id}
    assert json.loads((tmp_path / "out" / "_runs" / run.run_id / "manifest.json").read_text())["status"] == "cancelled"
    assert run_blocking(spark, s, raster, make).totals["pages"] == 1


def test_a_program_as_recogniser(tmp_path):
    fake = tmp_path / "fake"
    fake.write_text(
        "#!/bin/sh\ncat > /dev/null\ncase \"$*\" in *tsv*) printf 'level\\tpage_num\\tblock_num\\tpar_num\\tline_num\\tword_num\\tleft\\ttop\\twidth\\theight\\tconf\\ttext\\n"
        "5\\t1\\t1\\t1\\t2\\t1\\t1\\t30\\t5\\t5\\t80\\tbelow\\n5\\t1\\t1\\t1\\t1\\t1\\t1\\t2\\t30\\t5\\t91.5\\ta\\n5\\t1\\t1\\t1\\t1\\t2\\t40\\t2\\t5\\t5\\tx\\tbad\\n4\\t1\\t1\\t1\\t1\\t0\\t0\\t0\\t9\\t9\\t-1\\t\\n';;"
        " *) printf 'Orientation in degrees: 90\\nRotate: 270\\n';; esac\n"
    )
    fake.chmod(0o755)
    p = Program(str(fake))
    image = np.full((20, 20), 255, np.uint8)
    r = p.read(image)
    assert (r.text, r.confidence) == ("a\nbelow", 85.75) and r.words[1] == {"text": "a", "x0": 1.0, "y0": 2.0, "x1": 31.0, "y1": 7.0, "confidence": 91.5}
    assert p.orientation(image) == 270
    fake.write_text("#!/bin/sh\nexec sleep 5\n")
    assert Program(str(fake), orient_s=0.2).orientation(image) is None
    fake.write_text("#!/bin/sh\ncat > /dev/null\necho broken >&2\nexit 3\n")
    row = read_page(image, None, p, Settings())
    assert row["source"] == "failed" and "broken" in row["error"]
