"""Which turned reading of a page is kept, as plain functions over readings; ``operators.rescue`` says the same as a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

#: Points of confidence a turned reading must be ahead of the page as it lay.
GAIN = 5.0
QUARTERS = (90, 180, 270)


@dataclass
class Reading:
    text: str = ""
    confidence: float | None = None
    words: list[dict] = field(default_factory=list)

    @property
    def blank(self) -> bool:
        return not self.text.strip()


def doubtful(r: Reading, minimum: float) -> bool:
    """Nothing was read, or it was read with less confidence than asked for; an unknown confidence raises no doubt."""
    return r.blank or (r.confidence is not None and r.confidence < minimum)


def worth(first: Reading, readings: Sequence[Reading]) -> list[float]:
    """What each reading is worth: its confidence where it beats the first reading by GAIN or reads where that was blank, else below zero."""
    bar = None if first.confidence is None else first.confidence + GAIN
    out = []
    for r in readings:
        wins = not r.blank and (first.blank or (bar is not None and r.confidence is not None and r.confidence > bar))
        out.append((r.confidence or 0.0) if wins else -1.0)
    return out


def kept(first: Reading, readings: Sequence[Reading]) -> int | None:
    """The place of the reading to keep, the earliest of the worthiest; None keeps the first."""
    value = worth(first, readings)
    top = max(value, default=-1.0)
    return value.index(top) if top >= 0 else None


def settled(first: Reading, readings: Sequence[Reading], minimum: float) -> bool:
    """Whether more turns are pointless: the likeliest one is as blank as the page, or the latest is the best and leaves no doubt."""
    if len(readings) == 1 and first.blank and readings[0].blank:
        return True
    return bool(readings) and kept(first, readings) == len(readings) - 1 and not doubtful(readings[-1], minimum)


def order_of(hint: int | None) -> tuple[int, ...]:
    """The quarter turns to try, the hinted one first."""
    return tuple(sorted(QUARTERS, key=lambda a: (a != hint, a)))
