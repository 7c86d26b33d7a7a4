"""A recogniser that is a program of its own: one process per page, pixels in, tab-separated words out, under a time limit."""

from __future__ import annotations

import subprocess

import numpy as np

from leafmill.kernels.turns import Reading

#: Seconds a reading and an orientation report may take, and the height pictures are shrunk to for the latter. Fixed values.
READ_S, ORIENT_S, ORIENT_PX = 180, 60, 2000


def pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def parse_words(table: str) -> Reading:
    """Words of a recogniser's table (columns by name); structural, blank and malformed rows are left out."""
    head, *rows = table.split("\n")
    at = {name: k for k, name in enumerate(head.rstrip("\r").split("\t"))}
    words, lines = [], {}
    for row in rows:
        cells = row.rstrip("\r").split("\t")
        try:
            x, y, w, h, c = (float(cells[at[n]]) for n in ("left", "top", "width", "height", "conf"))
            place = tuple(int(cells[at[n]]) for n in ("block_num", "par_num", "line_num", "word_num"))
            text = cells[at["text"]].strip()
        except (IndexError, KeyError, ValueError):
            continue
        if text and c >= 0:
            words.append({"text": text, "x0": x, "y0": y, "x1": x + w, "y1": y + h, "confidence": c})
            lines.setdefault(place[:3], []).append((place[3], text))
    body = "\n".join(" ".join(t for _, t in sorted(own)) for _, own in sorted(lines.items()))
    return Reading(body, round(sum(w["confidence"] for w in words) / len(words), 2) if words else None, words)


def parse_turn(report: str) -> int | None:
    """Degrees of a key-value orientation report, None where it names no quarter turn."""
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in report.splitlines()))
    turn = fields.get("rotate", "")
    return int(turn) if turn in ("0", "90", "180", "270") else None


class Program:
    """Runs ``binary`` for each page; a time-out or a failure of a reading is an error of the page, of an orientation no answer."""

    def __init__(self, binary: str, read_s: float = READ_S, orient_s: float = ORIENT_S):
        self.binary, self.read_s, self.orient_s = binary, read_s, orient_s

    def _run(self, image: np.ndarray, seconds: float, *options: str) -> str:
        done = subprocess.run([self.binary, "stdin", "stdout", *options], input=pgm(image), capture_output=True, timeout=seconds)
        if done.returncode:
            raise RuntimeError(f"recogniser ended with {done.returncode}: {done.stderr.decode('utf-8', 'replace')[-300:]}")
        return done.stdout.decode("utf-8", "replace")

    def read(self, image: np.ndarray, lang: str = "eng", psm: int = 3, dpi: int | None = None) -> Reading:
        resolution = ["--dpi", str(dpi)] if dpi else []
        return parse_words(self._run(image, self.read_s, "-l", lang, "--psm", str(psm), *resolution, "tsv"))

    def orientation(self, image: np.ndarray) -> int | None:
        step = max(1, -(-image.shape[0] // ORIENT_PX))
        try:
            return parse_turn(self._run(image[::step, ::step], self.orient_s, "--psm", "0"))
        except (OSError, RuntimeError, subprocess.TimeoutExpired):
            return None
