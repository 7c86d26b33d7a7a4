"""Run settings: defaults, limits and where folders come from."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import asdict, dataclass, fields
from pathlib import Path

LAYOUTS = ("by-folder", "by-type", "together")
DUPLICATE_MODES = ("name", "content", "off")
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif")
RESERVED = ("_runs", "_previews", "_uploads", "_cache")
KINDS = ("pdf", "txt", "json")

MIN_TEXT_LAYER = 100
MIN_CHARS = 25
MIN_CONFIDENCE = 70.0
LOW_WORD = 60.0
LOW_WORDS_KEPT = 80
SEARCH_LIMIT = 200
RECENT_STORED, RECENT_SHOWN = 40, 20


def default_workers() -> int:
    return max(1, min(8, (os.cpu_count() or 1) - 2))


@dataclass
class Settings:
    """Numbers outside their limits are moved to the nearest limit, unknown choices to the default with a warning."""

    input_dir: str = ""
    output_dir: str = ""
    work_dir: str = ""
    dpi: int = 300
    lang: str = "eng"
    psm: int = 3
    workers: int = 0
    force_ocr: bool = False
    deskew: bool = True
    denoise: bool = True
    orient: bool = True
    write_pdf: bool = True
    write_txt: bool = True
    write_json: bool = True
    include_word_boxes: bool = True
    write_previews: bool = True
    output_layout: str = "by-folder"
    skip_already_done: bool = True
    duplicates: str = "name"
    pdf_keeps_source_image: bool = True
    txt_keeps_layout: bool = True
    min_confidence: float = MIN_CONFIDENCE
    recursive: bool = True

    def __post_init__(self) -> None:
        self.dpi = min(600, max(72, int(self.dpi)))
        self.psm = min(13, max(0, int(self.psm)))
        self.workers = min(32, max(1, int(self.workers))) if self.workers else default_workers()
        for name, choices, default in (("output_layout", LAYOUTS, "by-folder"), ("duplicates", DUPLICATE_MODES, "name")):
            if getattr(self, name) not in choices:
                warnings.warn(f"unknown {name} {getattr(self, name)!r}: {default} is used", stacklevel=3)
                setattr(self, name, default)

    @classmethod
    def from_dict(cls, data: dict) -> "Settings":
        """Known keys only; the older switch for one folder per kind is read as a layout."""
        data = dict(data)
        if "output_layout" not in data and "outputs_grouped_by_type" in data:
            data["output_layout"] = "by-type" if data["outputs_grouped_by_type"] else "by-folder"
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)

    @property
    def work_path(self) -> str:
        return self.work_dir or self.output_dir

    @property
    def work_is_separate(self) -> bool:
        return bool(self.work_dir) and Path(self.work_dir) != Path(self.output_dir)

    def wanted_kinds(self) -> list[str]:
        return [k for k in KINDS if getattr(self, f"write_{k}")]


def is_inside(inner: str, outer: str) -> bool:
    a, b = Path(inner).resolve(), Path(outer).resolve()
    return a == b or b in a.parents


def state_dir() -> Path:
    return Path(os.environ.get("LEAFMILL_STATE_DIR") or Path.home() / ".leafmill")


def default_folders() -> dict[str, str]:
    """Each folder from the environment, else as saved, else under the home folder."""
    try:
        saved = json.loads((state_dir() / "folders.json").read_text("utf-8"))
    except (OSError, ValueError):
        saved = {}
    home = Path.home() / "leafmill"
    out = {}
    for name, default in (("input_dir", str(home / "in")), ("output_dir", str(home / "out")), ("work_dir", "")):
        out[name] = os.environ.get(f"LEAFMILL_{name.upper()}") or saved.get(name) or default
    return out


def save_default_folders(**folders: str | None) -> dict[str, str]:
    """Store the given folders; an empty work folder means none of its own."""
    path = state_dir() / "folders.json"
    try:
        saved = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError):
        saved = {}
    for k, v in folders.items():
        if v is not None:
            saved[k] = v
    if not saved.get("work_dir"):
        saved.pop("work_dir", None)
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_suffix(".new")
    fresh.write_text(json.dumps(saved, indent=1), "utf-8")
    fresh.replace(path)
    return saved
