"""Command line: run, doctor, folders, serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from leafmill.settings import DUPLICATE_MODES, Settings, default_folders, is_inside, save_default_folders


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description="Page-level document analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="read a folder of documents")
    run.add_argument("input")
    run.add_argument("-o", "--output", required=True)
    run.add_argument("--work-dir", default="")
    run.add_argument("--dpi", type=int, default=300)
    run.add_argument("--lang", default="eng")
    run.add_argument("--psm", type=int, default=3)
    run.add_argument("--workers", type=int, default=0)
    run.add_argument("--min-confidence", type=float, default=70.0)
    run.add_argument("--duplicates", choices=DUPLICATE_MODES, default="name")
    for flag in ("force-ocr", "no-deskew", "no-orient", "no-denoise", "no-pdf", "no-txt", "no-json", "no-previews", "redo", "outputs-together", "txt-plain", "pdf-cleaned-image", "no-recursive", "quiet"):
        run.add_argument(f"--{flag}", action="store_true")
    run.add_argument("--outputs", choices=("by-folder", "by-type", "together"), default="by-folder")
    sub.add_parser("doctor", help="what this machine can do")
    f = sub.add_parser("folders", help="show or set the default folders")
    for name in ("input", "output", "work"):
        f.add_argument(f"--{name}")
    ui = sub.add_parser("serve", help="HTTP service over finished runs")
    ui.add_argument("--host", default="127.0.0.1")
    ui.add_argument("--port", type=int, default=8765)
    ui.add_argument("--work-dir", default="")
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    return Settings(
        input_dir=a.input, output_dir=a.output, work_dir=a.work_dir, dpi=a.dpi, lang=a.lang, psm=a.psm, workers=a.workers, min_confidence=a.min_confidence, duplicates=a.duplicates,
        force_ocr=a.force_ocr, deskew=not a.no_deskew, orient=not a.no_orient, denoise=not a.no_denoise, write_pdf=not a.no_pdf, write_txt=not a.no_txt, write_json=not a.no_json,
        write_previews=not a.no_previews, skip_already_done=not a.redo, output_layout="together" if a.outputs_together else a.outputs, txt_keeps_layout=not a.txt_plain,
        pdf_keeps_source_image=not a.pdf_cleaned_image, recursive=not a.no_recursive,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "folders":
        given = {"input_dir": a.input, "output_dir": a.output, "work_dir": a.work}
        if any(v is not None for v in given.values()):
            save_default_folders(**given)
        print(json.dumps(default_folders(), indent=1))
        return 0
    if a.command == "doctor":
        from leafmill.kernels.recognise import engine

        found = engine()
        print(f"recogniser: {found or 'not found (the stub is used)'}")
        return 0 if found else 1
    if a.command == "serve":
        from leafmill.service import serve

        serve(a.host, a.port, a.work_dir or default_folders()["output_dir"])
        return 0
    if not Path(a.input).is_dir():
        print(f"{a.input} is no folder", file=sys.stderr)
        return 2
    if is_inside(a.input, a.output):
        print("the input folder must not lie inside the output folder", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from leafmill.deploy import ship
    from leafmill.runner import run_blocking
    from leafmill.sources.pixels import raster

    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    ship(spark)
    run = run_blocking(spark, settings_of(a), raster, on_event=None if a.quiet else lambda e: print(json.dumps(e)))
    print(json.dumps({"run_id": run.run_id, "status": run.status, **run.totals}))
    return 0 if run.status == "done" else 1


if __name__ == "__main__":
    sys.exit(main())
