"""Held-out test items inside training documents: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so
items are partitioned by length and documents are read in overlapping windows
of twice the partition's greatest length.  MinHash signatures are taken over
the shingles that some item holds (no other shingle can be shared with one); the
share of equal minima estimates how much of an item a window holds.  Estimates
that could be a leak are verified exactly: the item's shingles found in order of
place within one stretch of twice its length must cover at least half its words;
where changed words have broken too many shingles, the item is aligned with the
stretch word by word, and passages of it must make up half of its words.

TESTDATA defines a leak by half of the words with some of them changed, so the
shingles here are of three and four words (five would lose noisy passages).
Shingles that several items share (closing questions, stock phrases) take no
part in signatures, yet count in the verification.

Items are a fixed, small list.  Their index is built on the driver, a block of
ITEM_BLOCK items at a time, and goes to the workers with the tasks; every block is
held against all documents in one scan of its own, without a shuffle.  A list that
grows with the corpus would need another way: driver memory and scans grow with it.
Of an item with fewer than ten shingles of its own, all shingles are signed.  Defined
results: null, empty and blank texts and items hold nothing; items of fewer
words than a shingle are never found; repeated rows count once; documents of any
length are read whole.
"""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.arrow import from_rows

#: Shingle length of the search, length of the stricter check beside it, and minima of a signature.
SHINGLE, STRICT, MINIMA = 3, 4, 48
#: A window is verified where at least this many minima agree (about a twelfth of window and item shared).
AGREE = 4
#: Covered share of an item's words, by shingles of both lengths, that makes a leak.
COVER, COVER_STRICT = 0.5, 0.4
#: Changed words in a row within a passage, and matching words a passage has at least.
GAP, PASSAGE = 2, 4
#: Shingles held by at least this many items are stock phrases.
STOCK = 3
#: Items whose signatures travel together.
ITEM_BLOCK = 2_000
#: Ratio of the greatest to the least length in a size partition.
SIZE_RATIO = 1.4

_MARKER = re.compile(r"(?m)^\s*-{3,}.*-{3,}\s*$|^\s*>+ ?")
# (the break comes first in the pattern, so that the search runs from break to break)
_BROKEN = re.compile(r"[-‐¬\xad](?<=[^\W\d_][-‐¬\xad]) ?\n(?:> )?\s*(?=[^\W\d_])")
_CUT = re.compile(r"[^\W\d_][-‐¬\xad]$")
_FOLD = {"0": "o", "1": "l", "5": "s", "@": "a", "6": "b", "|": "l", "$": "s", "ﬁ": "fi", "ﬂ": "fl"}
#: What stands between words, beside blanks, in plain text; and the letters of plain text that are others.
_BETWEEN = [c for c in map(chr, range(128)) if not c.isalnum() and not c.isspace()]
_PLAIN = str.maketrans(dict.fromkeys(_BETWEEN, " "))
_PLAIN_FOLD = _PLAIN | str.maketrans({x: y for x, y in _FOLD.items() if x.isascii()})
_OTHER = re.compile(r"[^\x00-\x7f]")


def _unmarked(text: str) -> str:
    return _MARKER.sub("", text) if "---" in text or ">" in text else text


def _joined(text: str) -> str:
    return _BROKEN.sub("", _unmarked(text))


def _split(text: str, fold: bool) -> list[str]:
    """The runs of letters and digits: what no word holds becomes a blank, a character at a time, which takes less than a pattern."""
    if text.isascii():
        return text.translate(_PLAIN_FOLD if fold else _PLAIN).split()
    if fold:
        for x, y in _FOLD.items():
            text = text.replace(x, y)
    for c in chain(_BETWEEN, set(_OTHER.findall(text))):
        if not c.isalnum():
            text = text.replace(c, " ")
    return text.split()


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, line breaks and the commonest misread characters."""
    if not text or text.isspace():
        return []
    return _split(_joined(text).lower(), True)


def words_as_written(text: str) -> list[str]:
    """Words without case, punctuation and line breaks, their letters as they were read."""
    return _split(_joined(text).lower(), False)


def ends_within_word(text: str) -> bool:
    """Whether the word the text ends with may go on in the text that follows."""
    return bool(_CUT.search(_unmarked(text).rstrip()[-2:]))


def shingles(words: Sequence[str], size: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[k:] for k in range(size))))


def places(item: Sequence[str], size: int) -> dict[tuple[str, ...], list[int]]:
    at = defaultdict(list)
    for a, s in enumerate(shingles(item, size)):
        at[s].append(a)
    return dict(at)


def covered(n: int, at: dict[tuple[str, ...], list[int]], document: Sequence[tuple[str, ...]], size: int) -> float:
    """Greatest share of an item's ``n`` words covered by its shingles (``at``) within a stretch of twice its length."""
    hits = [(b, a) for b, s in enumerate(document) if s in at for a in at[s]]
    best, j = 0, 0
    count = [0] * n
    now = 0
    for b, a in hits:
        for k in range(a, a + size):
            now += not count[k]
            count[k] += 1
        while b - hits[j][0] > 2 * n - size:
            for k in range(hits[j][1], hits[j][1] + size):
                count[k] -= 1
                now -= not count[k]
            j += 1
        best = max(best, now)
    return best / n if n else 0.0


def held(item: Sequence[str], words: Sequence[str], at: dict[tuple[str, ...], list[int]], size: int) -> float:
    """Greatest share of the item's words found in order within a stretch of twice its length, changed words counted where both sides of them match.

    Every shingle in the document (``at``) names a stretch; within it the texts are
    aligned, and matching words that stand equally far apart on both sides, with at
    most GAP changed words between, form one passage of at least PASSAGE words.
    """
    n = len(item)
    hits = [b for b, s in enumerate(shingles(words, size)) if s in at]
    own = Counter(item)
    best, upto = 0, -1
    for b in hits:
        if b < upto:
            continue
        lo = max(0, b - GAP - 1)
        upto = b + max(1, n // 4)
        stretch = words[lo : lo + 2 * n + n // 4]  # twice the item from every hit before the next stretch
        if sum((own & Counter(stretch)).values()) * 3 < n * 2 * COVER:
            continue  # of a passage two thirds match, so these words cannot make up COVER
        passages: list[list[int]] = []  # item position, stretch position, length, matching words
        for m in difflib.SequenceMatcher(None, item, stretch, autojunk=False).get_matching_blocks()[:-1]:
            last = passages[-1] if passages else None
            if last and last[0] - last[1] == m.a - m.b and m.a - last[0] - last[2] <= GAP:
                last[2], last[3] = m.a + m.size - last[0], last[3] + m.size
            else:
                passages.append([m.a, m.b, m.size, m.size])
        best = max(best, sum(p[2] for p in passages if p[3] >= PASSAGE and p[3] * 3 >= p[2] * 2))
    return best / n if n else 0.0


class Index:
    """Signatures of a block of items by size partition."""

    def __init__(self, items: Sequence[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if len(w) >= SHINGLE]
        self.places = [(places(w, SHINGLE), places(w, STRICT)) for _, w in self.items]
        held = [dict.fromkeys(shingles(w, SHINGLE)) for _, w in self.items]
        df = Counter(s for h in held for s in h)
        own = []
        for h in held:
            rare = [s for s in h if df[s] < STOCK]
            own.append(rare if len(rare) >= 10 else list(h))
        self.number = {s: k for k, s in enumerate(dict.fromkeys(s for o in own for s in o))}
        seeds = np.random.default_rng(11).integers(1, 2**61 - 1, (2, MINIMA), dtype=np.uint64)
        texts = [" ".join(s).encode() for s in self.number]
        base = np.array([zlib.crc32(s) | (zlib.adler32(s) << 32) for s in texts], dtype=np.uint64)
        mixed = base[:, None] * (seeds[0] | np.uint64(1)) + seeds[1] if len(base) else np.zeros((0, MINIMA), np.uint64)
        self.hashes = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.classes: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        by_class = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            by_class[int(np.ceil(np.log(len(w)) / np.log(SIZE_RATIO)))].append(k)
        for c, members in by_class.items():
            signatures = np.stack([self.hashes[[self.number[s] for s in own[k]]].min(0) for k in members])
            longest = max(len(self.items[k][1]) for k in members)
            self.classes[c] = (longest, np.array(members), signatures)

    def found(self, words: Sequence[str]) -> list[int]:
        """The item_ids a document of these words holds."""
        number = self.number
        loose = shingles(words, SHINGLE)
        spots = [(p, number[s]) for p, s in enumerate(loose) if s in number]
        if not spots:
            return []
        place = np.array([p for p, _ in spots])
        which = np.array([k for _, k in spots])
        maybe: set[int] = set()
        for longest, members, signatures in self.classes.values():
            seen = None
            for lo in range(max(0, int(place[0]) // longest * longest - longest), int(place[-1]) + 1, longest):
                a, b = np.searchsorted(place, (lo, lo + 2 * longest))
                if a == b or (a, b) == seen:
                    continue
                seen = (a, b)
                minima = self.hashes[which[a:b]].min(0)
                agree = (signatures == minima).sum(1)
                maybe.update(members[agree >= AGREE].tolist())
        out = []
        strict = shingles(words, STRICT) if maybe else []
        for k in sorted(maybe):
            item_id, item = self.items[k]
            at, at_strict = self.places[k]
            if covered(len(item), at, loose, SHINGLE) >= COVER and covered(len(item), at_strict, strict, STRICT) >= COVER_STRICT:
                out.append(item_id)
            elif held(item, words, at, SHINGLE) >= COVER:
                out.append(item_id)
        return out


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for every document and every test item it holds."""
    rows = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    blocks: list[Index] = []
    part: list[tuple[int, list[str]]] = []
    for r in rows.toLocalIterator():
        part.append((r["item_id"], words_of(r["text"])))
        if len(part) == ITEM_BLOCK:
            blocks.append(Index(part))
            part = []
    if part:
        blocks.append(Index(part))
    texts = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    result = documents.sparkSession.createDataFrame([], _FOUND)
    for index in blocks:

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from_rows(_FOUND, [(d, i) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for i in index.found(words_of(t))])

        result = result.unionByName(texts.mapInArrow(search, _FOUND))
    return result.dropDuplicates()
