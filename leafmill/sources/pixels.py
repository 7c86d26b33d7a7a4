"""Pixels of document pages for the page stage: PGM/PPM pictures natively, other kinds where a decoder is installed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "file_index int, relpath string, page_no int, pixels binary, width int, height int, layer string"


def decode(path: str, frame: int = 0) -> np.ndarray:
    """Grey pixels of a frame of a picture file; ValueError where nothing here can read it, EOFError beyond its last frame."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:2] in (b"P5", b"P6"):
        if frame:
            raise EOFError(f"no frame {frame}")
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, _ = fields
        planes = 3 if data[:2] == b"P6" else 1
        px = np.frombuffer(data, np.uint8, w * h * planes, at + 1).reshape(h, w, planes)
        return px.mean(2).astype(np.uint8)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("no decoder for this kind of picture") from e
    with Image.open(path) as im:
        im.seek(frame)
        return np.asarray(im.convert("L"))


def raster(files: DataFrame) -> DataFrame:
    """Page rows of (file_index, relpath, path, page_count) files; a page that cannot be decoded has no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.itertuples(index=False):
                for page_no in range(1, int(f.page_count) + 1):  # one page at a time: a long document never lies in memory
                    try:
                        px = decode(f.path, page_no - 1)
                        row = (f.file_index, f.relpath, page_no, px.tobytes(), px.shape[1], px.shape[0], None)
                    except (EOFError, OSError, ValueError):
                        row = (f.file_index, f.relpath, page_no, None, 0, 0, None)
                    yield pd.DataFrame([row], columns=["file_index", "relpath", "page_no", "pixels", "width", "height", "layer"])

    return files.select("file_index", "relpath", "path", "page_count").mapInPandas(run, SCHEMA)
