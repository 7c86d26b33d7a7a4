"""Text quality statistics per document and the structural profile each page is nearest to.

Every text is reduced to one small distribution: how its characters divide among
marked list items, table cells, symbols, repeated scraps, letters in no
language's proportions, and function words or other words of short and of long
lines.  The Jensen-Shannon divergence from that distribution to each structural
profile decides; the divergence of its letters from the nearest language's prose
tells letters that are no language.

Defined results: null, empty and blank texts have counts of 0, null ratios and a
null kind; a page that says it is left blank has a null kind; a text longer than
any other is read whole; ties go to the profile named first; a page_id that
repeats counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Relative letter frequencies (per cent) of running prose, a to z.
LETTERS = {
    "en": (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074),
    "es": (11.5, 2.2, 4.0, 5.0, 12.2, 0.69, 1.8, 0.7, 6.2, 0.49, 0.01, 5.0, 3.2, 6.7, 8.7, 2.5, 0.88, 6.9, 8.0, 4.6, 2.9, 1.1, 0.017, 0.22, 1.0, 0.47),
    "de": (6.5, 1.9, 2.7, 5.1, 16.4, 1.7, 3.0, 4.6, 6.6, 0.27, 1.4, 3.4, 2.5, 9.8, 2.6, 0.67, 0.018, 7.0, 7.3, 6.2, 4.2, 0.85, 1.9, 0.034, 0.039, 1.1),
}
#: Divergence (bits) of a text's letters from every language's prose beyond which they are in no language.
GARBLE_AT = 0.1

#: A text of this many different words is no repetition of scraps, however long it is.
SCRAP_WORDS = 40

# Parts of the structural distribution.
ITEM, CELL, SYMBOL, SCRAP, GARBLE, SHORT_FUNCTION, SHORT_WORD, LONG_FUNCTION, LONG_WORD = range(9)
PROFILES: tuple[tuple[str, dict[int, float]], ...] = (
    ("prose", {LONG_FUNCTION: 0.32, LONG_WORD: 0.68}),
    ("prose", {SHORT_FUNCTION: 0.4, SHORT_WORD: 0.6}),
    ("list", {ITEM: 1.0}),
    ("list", {SHORT_FUNCTION: 0.14, SHORT_WORD: 0.86}),
    ("table", {CELL: 1.0}),
    ("junk", {SYMBOL: 1.0}),
    ("junk", {SCRAP: 1.0}),
    ("junk", {GARBLE: 1.0}),
    ("junk", {LONG_FUNCTION: 0.07, LONG_WORD: 0.93}),
)

_ITEM = re.compile(r"(?:[*·•▪‣◦+–—-]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\(\w{1,3}\))\s+\S")
_LABEL = re.compile(r"[^\W\d][\w .'/-]{0,24}:\s{2,}\S|[^\W\d][\w'/-]*(?: [\w'/-]+){0,2}: ?\S+(?: \S+){0,3}$")
_BARE_CSV = re.compile(r"[^,\s]+(?:,[^,]*){3,}$")
_BLANK_NOTE = re.compile(r"(?i)^\W*(?:this )?page (?:is )?(?:intentionally )?left blank\W*$")
_PAGE_NO = re.compile(r"(?i)^\W*(?:(?:page|p\.?|pg\.?|seite|página)\s*)?(?:[\dlIO]{1,4}|[ivxl]{1,6})(?:\s*(?:/|of|von|de)\s*\d{1,4})?\W*$")
_FURNITURE = re.compile(r"(?i)\b(?:ref|vol\.?|no\.?|file|p\.?|page|appendix|proceedings)\s*\.?\s*[\dlIO]{1,6}\b")
_NO_WORDS = str.maketrans({c: " " for c in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~|“”„‘’«»…•·▪"})


class _Only(dict):
    """Translation that deletes every character for which ``keep`` is false; learns each character once."""

    def __init__(self, keep):
        self.keep = keep

    def __missing__(self, code: int) -> int | None:
        self[code] = code if self.keep(chr(code)) else None
        return self[code]


_ALNUM = _Only(str.isalnum)
_LATIN = _Only(lambda c: (c.isascii() and c.isalnum()) or c in "äöüßáéíóúñ-'")
_DIGITS = _Only(str.isdigit)
_END = tuple(".!?:;…\"”'’)")


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Divergence in bits between rows of ``p`` and the distribution(s) ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return (left + right) / 2


_LETTER_ROWS = np.array([np.array(v) / sum(v) for v in LETTERS.values()])
_PROFILE_ROWS = np.array([[parts.get(k, 0.0) for k in range(9)] for _, parts in PROFILES])
_ASCII = str.maketrans("áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")


def _body(lines: list[str]) -> list[str]:
    """Lines without page numbers and running lines at the edges; never fewer than two."""
    lo, hi = 0, len(lines)
    for _ in range(3):
        if hi - lo > 2 and (_PAGE_NO.match(lines[lo]) or (len(lines[lo]) < 70 and _FURNITURE.search(lines[lo]))):
            lo += 1
    for _ in range(3):
        if hi - lo > 2 and (_PAGE_NO.match(lines[hi - 1]) or (len(lines[hi - 1]) < 50 and _FURNITURE.search(lines[hi - 1]))):
            hi -= 1
    return lines[lo:hi]


def _is_cells(s: str, weight: int) -> bool:
    """Whether a line divides into cells: tabs, wide gaps, leaders, bars, comma fields or a label with its value."""
    if "\t" in s or "   " in s or "...." in s or s.count(" | ") >= 2:
        return True
    if s.count(",") >= 3 and (_BARE_CSV.match(s) or len(s.translate(_DIGITS)) * 5 > weight):
        return True
    return ":" in s[:27] and bool(_LABEL.match(s))


class Reader:
    """Statistics of one text after another; ``function_words`` maps a language to its words."""

    def __init__(self, function_words: dict[str, set[str]]):
        self.languages = [frozenset(w) for w in function_words.values()] or [frozenset()]

    def stats(self, text: str | None) -> tuple:
        """(words, mean word length, symbol ratio, punctuated lines, common words, parts, letters) of a text."""
        lines = [s for s in map(str.strip, text.split("\n")) if s] if text else []
        if not lines:
            return (0, None, None, None, None, None, None)
        tokens = text.split()
        n_chars = sum(map(len, tokens))
        words = text.lower().translate(_NO_WORDS).split()
        alnum = len(text.translate(_ALNUM))
        counted = Counter(words)
        shares = [sum([counted[w] for w in known if w in counted]) for known in self.languages]
        best = self.languages[shares.index(max(shares))]
        common = max(shares) / max(1, len(words))
        ends = sum(s.endswith(_END) for s in lines) / len(lines)
        head = (len(tokens), n_chars / len(tokens), 1 - alnum / n_chars, ends, common)
        if _BLANK_NOTE.match(" ".join(lines)):
            return (*head, None, None)
        body = _body(lines)
        parts = [0.0] * 9
        seen = Counter(body)
        many = len(body) >= 3 and len(seen) <= 0.4 * len(body)
        plain = text.isascii()
        letters: list[str] = []
        for s in body:
            weight = len(s)
            if many and seen[s] > 1:
                parts[SCRAP] += weight
            elif _ITEM.match(s):
                parts[ITEM] += weight
            elif _is_cells(s, weight):
                parts[CELL] += weight
            else:
                own = s.lower().translate(_NO_WORDS).split()
                solid = sum(map(len, own))
                if solid < 0.55 * (weight - s.count(" ")) or not (plain or len("".join(own).translate(_LATIN)) >= 0.6 * max(1, solid)):
                    parts[SYMBOL] += weight
                    continue
                letters += own
                short = len(own) <= 7 and not s.endswith((".", "!", "?"))
                # a function word weighs by count: its share of words, not of characters
                function = sum(map(best.__contains__, own)) / max(1, len(own))
                parts[SHORT_FUNCTION if short else LONG_FUNCTION] += weight * function
                parts[SHORT_WORD if short else LONG_WORD] += weight * (1 - function)
        counts = Counter("".join(letters).translate(_ASCII)) if letters else None
        if len(letters) >= 8 and (kinds := len(set(letters))) <= 0.15 * len(letters) and kinds < SCRAP_WORDS:
            text_part = sum(parts[SHORT_FUNCTION:])
            parts[SCRAP] += text_part
            parts[SHORT_FUNCTION:] = [0.0] * 4
        return (*head, parts, [counts.get(chr(97 + k), 0) for k in range(26)] if counts else [0] * 26)


def classify(parts: np.ndarray, letters: np.ndarray) -> list[str]:
    """Nearest structural profile of each row of parts, with its letters held against every language."""
    parts, letters = parts.astype(float), letters.astype(float)
    total = letters.sum(1, keepdims=True)
    known = letters / np.where(total > 0, total, 1)
    far = np.min([jensen_shannon(known, row) for row in _LETTER_ROWS], axis=0)
    # few letters stray by chance; the allowance shrinks as they grow
    garbled = (total[:, 0] >= 20) & (far > GARBLE_AT + 4.5 / np.maximum(total[:, 0], 1))
    text = parts[:, SHORT_FUNCTION:].sum(1)
    parts[garbled, GARBLE] += text[garbled]
    parts[garbled, SHORT_FUNCTION:] = 0
    whole = parts.sum(1, keepdims=True)
    share = parts / np.where(whole > 0, whole, 1)
    distance = np.stack([jensen_shannon(share, row) for row in _PROFILE_ROWS], axis=1)
    return [PROFILES[k][0] for k in distance.argmin(1)]


_FIELDS = [
    T.StructField("word_count", T.IntegerType()),
    T.StructField("mean_word_length", T.DoubleType()),
    T.StructField("symbol_ratio", T.DoubleType()),
    T.StructField("punctuated_lines", T.DoubleType()),
    T.StructField("common_words", T.DoubleType()),
    T.StructField("kind", T.StringType()),
]


def text_quality(documents: DataFrame, function_words: dict[str, set[str]], id_columns: Sequence[str], text_column: str = "text") -> DataFrame:
    """Statistics and kind of every document; one Arrow pass over the scan, no shuffle.

    ``function_words`` is a fixed list of a hundred-odd words and travels with the function.
    """
    names = [f"k{i}" for i in range(len(id_columns))]
    fixed = {k: frozenset(v) for k, v in function_words.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(fixed)
        for b in batches:
            rows = [reader.stats(t) for t in b["text"]]
            kind: list[str | None] = [None] * len(rows)
            at = [i for i, r in enumerate(rows) if r[5] is not None]
            if at:
                for i, k in zip(at, classify(np.array([rows[i][5] for i in at]), np.array([rows[i][6] for i in at]))):
                    kind[i] = k
            out = b[names].copy()
            for j, f in enumerate(_FIELDS[:5]):
                out[f.name] = pd.array([r[j] for r in rows], dtype="Int32" if j == 0 else "Float64")
            out["kind"] = kind
            yield out

    rows = documents.select(*[F.col(c).alias(n) for c, n in zip(id_columns, names)], F.col(text_column).alias("text"))
    schema = T.StructType([T.StructField(n, documents.schema[c].dataType) for c, n in zip(id_columns, names)] + _FIELDS)
    return rows.mapInPandas(run, schema).select(*[F.col(n).alias(c) for c, n in zip(id_columns, names)], *[f.name for f in _FIELDS])


def structured_pages(pages: DataFrame, function_words: dict[str, set[str]]) -> DataFrame:
    """(page_id, kind) of pages that are mostly not running prose."""
    kinds = text_quality(pages, function_words, ["page_id"]).where("kind <> 'prose'").select("page_id", "kind")
    # repeated pages give repeated rows; only the few pages of interest are shuffled to drop them
    return kinds.dropDuplicates(["page_id"])
