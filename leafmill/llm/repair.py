"""Noise in text from scanned pages: broken words, misread characters, running lines, page numbers.

Two passes over the texts, none of which is ever shuffled.  The first counts
words (a vocabulary with the share of occurrences that were flagged as doubtful)
and collects the lines at the pages' edges.  Between the passes everything
works on word *types* and edge lines: running lines are edge lines a file
repeats.  The second pass lists per readable page the words nobody trusts and the
broken words.  The types of those words meet their correction candidates in an exact
inverted join on positional character pieces, and a gradient-boosted ranker,
trained on the flags the recogniser left, chooses one or none.

Whether a page is readable is told by the letters of its words: a table of letter
triples (of fixed size, learnt from every good word of the corpus) scores each
word, and a page whose words mostly score below nearly all good words is junk.

Defined results: null, empty and blank pages have no rows; a word is reported
once per page and kind; a page most of whose words are in no language's letters
(junk) has no misread words; the case of a corrected word follows the word it
replaces; of equal candidates the more frequent, then the smaller wins; a page_id
that repeats counts once; words of any length from one letter are looked up.

An edge line that reads like prose (over 120 characters, a lower-case start, a
comma or semicolon at the end, or over 60 characters with a sentence's end) is
carried as a hash: it is a running line where at least four fifths of its file's
pages, and three, have it letter for letter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.arrow import from_rows
from leafmill.llm.boost import Boosted
from leafmill.storage import materialise

#: Lines at each edge of a page that may be running lines or page numbers.
EDGE = 3
#: A word seen this often, and rarely flagged, may stand as a correction.
GOOD_COUNT = 20
#: Trusted words every worker of the second pass leaves out at once, the commonest first. Only a saving: trusted words have no correction, so the results do not depend on it.
KNOWN_WORDS = 20_000
#: Edits between a misread word and the right one.
DISTANCE = 3
#: The letters that are words by themselves; any other single letter marks an item or an initial.
LETTER_WORDS = ("a", "e", "i", "o", "u", "y")
#: Replacements that explain fewer flagged words than this, or a smaller share of them, are no misreadings (the share bounds their number by its inverse).
COMMON_OP, OP_SHARE = 3, 0.0004
#: Standard deviations below the mean score of good words at which a word's letters are no language's.
STRANGE = 1.5
#: Most labelled word types the ranker is fitted on.
TRAINING_ROWS = 20_000

_STRIP = ".,;:!?\"'()[]{}<>“”‘’„«»*·•—–…"
_BREAKS = "-‐¬\xad"
_JOINTS = str.maketrans("", "", "-'’‐")
_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50}
_NUMBER_LINE = re.compile(
    r"(?i)^(?P<pre>page|p\.|pg\.?|seite|página|[-–—]|\[|\()?\s*(?P<n>[\dlIO|]{1,5}|[ivxl]{1,7})\s*(?P<of>(?:/|of|von|de)\s*[\dlIO|]{1,5})?\s*(?P<post>[-–—]|\]|\))?$"
)
_TRAILING = re.compile(r"(?i)\s+(?:page|p\.|pg\.?)?\s*([\dlIO|]{1,5})$")
_DIGIT = str.maketrans("lIO|", "1101")
_ITEM = re.compile(r"(?:[*·•▪‣–—-]|\[.?\]|\(?\w{1,3}[.)])\s")


def _roman(s: str) -> int:
    total = 0
    for a, b in zip(s, s[1:] + " "):
        v = _VALUE[a]
        total += -v if v < _VALUE.get(b, 0) else v
    return total


def page_number_of(line: str) -> tuple[int, bool] | None:
    """(number, explicit) of a line that holds nothing but a page's number; explicit where it says so itself."""
    m = _NUMBER_LINE.match(line)
    if not m:
        return None
    n = m["n"]
    explicit = bool(m["pre"] or m["of"] or m["post"])
    if re.fullmatch(r"(?i)[ivxl]+", n) and not (m["pre"] and m["post"] and set(n) <= set("lI")):
        if n.islower() and n != "l":
            return _roman(n), explicit
        if not n.translate(_DIGIT).isdigit():
            return None
    n = n.translate(_DIGIT)
    return (int(n), explicit) if n.isdigit() else None


def _edges(lines: list[list[str]]) -> list[tuple[int, str, int]]:
    """(line number, side, place from the edge) of the non-blank lines at both edges; a line is the list of its tokens."""
    full = [i for i, own in enumerate(lines) if own]
    top, bottom = full[:EDGE], full[EDGE:][-EDGE:]
    return [(i, "T", k) for k, i in enumerate(top)] + [(i, "B", len(bottom) - 1 - k) for k, i in enumerate(bottom)]


def _prose_line(s: str) -> bool:
    """Whether a line plainly belongs to a sentence that goes on above or below it, or ends a long one."""
    return len(s) > 120 or s[0].islower() and len(s) > 7 or s[-1] in ",;" or (len(s) > 60 and s[-1] in ".!?:")


def _bare(token: str) -> str:
    w = token.strip(_STRIP)
    if token[:1] == "(" and ")" not in token and w and w[0].islower() and token[1:2] == w[0]:
        return "(" + w  # may be a misread letter; the plain word is looked up if it is none
    return w


def _unbroken(lines: list[list[str]]) -> list[list[str]]:
    """The tokens of every line without the halves of broken words, which are no words."""
    out = []
    half = False
    for own in lines:
        if own:
            if half:
                own = own[1:]
            last = own[-1] if own else ""
            half = last[-1:] in _BREAKS and len(last) > 1 and last[-2].isalpha()
            if half:
                own = own[:-1]
        out.append(own)
    return out


def _shape(lines: list[str], i: int) -> str:
    """Shape of the line beside an edge line: end of page, blank, item, cells, text."""
    if not 0 <= i < len(lines):
        return "end"
    s = lines[i].strip()
    if not s:
        return "blank"
    if _ITEM.match(s):
        return "item"
    if "\t" in s or "   " in s or "...." in s or " | " in s or s.count(",") >= 3 and " " not in s.split(",", 1)[0]:
        return "cells"
    return "short" if len(s) < 40 else "text"


def _broken(lines: list[str], skip: set[int]) -> list[tuple[int, str, str, str]]:
    """(line, first part, break, second part) of the words broken at line ends."""
    out = []
    for i in range(len(lines) - 1):
        s = lines[i].rstrip()
        if len(s) < 3 or s[-1] not in _BREAKS or i in skip or not s[-2].isalpha():
            continue
        j = i + 1
        while j < len(lines) and (not lines[j].strip() or j in skip) and j - i <= EDGE:
            j += 1
        if j >= len(lines):
            continue
        after = lines[j].split(None, 1)
        first = s.rsplit(None, 1)[-1][:-1].lstrip(_STRIP)
        second = after[0].strip(_STRIP) if after else ""
        if first and second and second[0].isalpha():
            out.append((i, first, s[-1], second))
    return out


_FIRST = T.StructType(
    [
        T.StructField("what", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("flagged", T.LongType()),
        T.StructField("caps", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("side", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("number", T.BooleanType()),
        T.StructField("beside", T.StringType()),
    ]
)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    words: Counter = Counter()
    flags: Counter = Counter()

    def vocabulary() -> pa.RecordBatch:
        n: Counter = Counter()
        caps: Counter = Counter()
        for token, c in words.items():
            w = _bare(token)
            low = w.lower()
            n[low] += c
            if w[:1].isupper():
                caps[low] += c
        rows = [("w", w, c, flags.get(w, 0), caps.get(w, 0)) for w, c in n.items()]
        words.clear()
        flags.clear()
        return from_rows(_FIRST, rows, ["what", "word", "n", "flagged", "caps"])

    for b in batches:
        edges = []
        for page_id, file_id, page_no, text, low in zip(*(b[c].to_pylist() for c in ("page_id", "file_id", "page_no", "text", "low"))):
            if not text or text.isspace():
                continue
            lines = text.split("\n")
            tokens = [s.split() for s in lines]
            edges.append(("p", file_id, page_id, page_no, None, None, None, None, None, None))
            for i, side, _ in _edges(tokens):
                s = lines[i].strip()
                if _prose_line(s):
                    edges.append(("h", file_id, page_id, page_no, i, side, None, xxhash.xxh64_hexdigest(s), None, None))
                    continue
                number = page_number_of(s)
                is_number = number is not None and (number[1] or number[0] == page_no)
                key = s
                # (the end is looked at first: few lines end in their page's number)
                if not is_number and s[-len(str(page_no)) :].translate(_DIGIT) == str(page_no) and (m := _TRAILING.search(s)) and m[1].translate(_DIGIT) == str(page_no):
                    key = s[: m.start()].rstrip()
                edges.append(("e", file_id, page_id, page_no, i, side, s, key, is_number, _shape(lines, i + 1 if side == "T" else i - 1)))
            words.update(chain.from_iterable(_unbroken(tokens)))
            if low:
                flags.update({_bare(w).lower() for w in low if w})
        if len(words) > 400_000:
            yield vocabulary()
        yield from_rows(_FIRST, edges, ["what", "file_id", "page_id", "page_no", "line_no", "side", "line", "key", "number", "beside"])
    yield vocabulary()


def _ops(w: str, c: str) -> tuple[str, ...] | None:
    """The replacements that turn the word into the candidate: 'read>meant', longest common ends taken off."""
    i, most = 0, min(len(w), len(c))
    while i < most and w[i] == c[i]:
        i += 1
    j = 0
    while j < most - i and w[-1 - j] == c[-1 - j]:
        j += 1
    a, b = w[i : len(w) - j], c[i : len(c) - j]
    if len(a) == len(b):
        return tuple(f"{x}>{y}" for x, y in zip(a, b) if x != y)
    if len(a) <= 2 and len(b) <= 2:
        return (f"{a}>{b}",)
    for k in range(1, min(3, len(a))):  # one replacement of unequal length before or after one of equal length
        m = len(b) - len(a) + k
        if not 1 <= m <= min(2, len(b) - 1):
            continue
        rest = tuple(f"{x}>{y}" for x, y in zip(a[k:], b[m:]) if x != y)
        if len(rest) <= 1:
            return (f"{a[:k]}>{b[:m]}", *rest)
        rest = tuple(f"{x}>{y}" for x, y in zip(a[:-k], b[:-m]) if x != y)
        if len(rest) <= 1:
            return (*rest, f"{a[-k:]}>{b[-m:]}")
    return None


def _pieces(length: str) -> str:
    """SQL: an array of (i, start from 0, size) of the DISTANCE + 1 pieces a word of that length falls in; the last ones are longer by one where needed."""
    k = DISTANCE + 1
    size = f"{length} div {k} + if(i >= {k} - {length} % {k}, 1, 0)"
    return f"transform(sequence(0, {DISTANCE}), i -> struct(i as i, i * ({length} div {k}) + greatest(0, i - ({k} - {length} % {k})) as p, {size} as size))"


def _correctable():
    return F.col("word").rlike(r"\p{L}") & F.col("word").rlike(r"^[\p{L}\p{N}@(|$!'’-]+$")


def _trusted():
    """A misread word is mostly flagged: one seen twenty times and flagged in fewer than a twentieth, or three times and never flagged, is a word."""
    return ((F.col("n") >= 20) & (F.col("flagged") * 20 < F.col("n"))) | ((F.col("n") >= 3) & (F.col("flagged") == 0))


def _good():
    """Words that may stand as a correction."""
    word = F.col("word")
    return (F.col("n") >= GOOD_COUNT) & (F.col("flagged") * 10 < F.col("n")) & word.rlike(r"^[\p{L}][\p{L}'’-]*$") & ((F.length("word") >= 2) | word.isin(*LETTER_WORDS))


def _candidates(vocabulary: DataFrame, doubted: DataFrame | None = None) -> DataFrame:
    """Word types (of ``doubted``, else of the whole vocabulary) with possible corrections: exact join on pieces, then length, count and distance.

    A word within DISTANCE edits of the right one holds one of its DISTANCE + 1
    pieces unchanged, moved no further than the edits on the piece's either side
    allow; so all such pairs meet, wherever the misread letters are.
    """
    length = F.length("word")
    good = vocabulary.where(_good())
    doubt = (vocabulary if doubted is None else doubted).where(_correctable())

    own = F.expr(f"transform({_pieces('length(word)')}, s -> concat_ws(' ', length(word), s.i, substring(word, s.p + 1, s.size)))")
    # d: how much longer the word is than the right one
    at = "greatest(0, s.p - s.i, s.p + d - ({0} - s.i))", "least(length(word) - s.size, s.p + s.i, s.p + d + {0} - s.i)"
    low, high = (x.format(DISTANCE) for x in at)
    looked_up = F.expr(
        f"""array_distinct(flatten(flatten(transform(sequence(-2, least(2, length(word) - 1)), d -> transform({_pieces('(length(word) - d)')}, s -> if({low} <= {high},
        transform(sequence({low}, greatest({low}, {high})), p -> concat_ws(' ', length(word) - d, s.i, substring(word, p + 1, s.size))), cast(array() as array<string>)))))))"""
    )
    # few and narrow rows become many: they are spread before they do, or one task would hold them all
    doubt = doubt.select("word", "n", "flagged").repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    left = doubt.select("word", "n", "flagged", F.explode(looked_up).alias("piece"))
    right = good.select(F.col("word").alias("meant"), F.col("n").alias("meant_n"), F.col("caps").alias("meant_caps"), F.explode(own).alias("piece"))
    # a word of a few letters keeps one of them, or has one that stands for two
    most = F.when(length == F.length("meant"), F.greatest(F.lit(1), F.least(F.lit(DISTANCE), length - 1))).when(length <= 2, 2).otherwise(DISTANCE)
    pairs = left.join(right, "piece").where(
        (F.col("word") != F.col("meant")) & (F.abs(length - F.length("meant")) <= 2) & (F.col("meant_n") >= 8 * F.col("n")) & F.levenshtein("word", "meant", DISTANCE).between(0, most)
    )
    return pairs.drop("piece").dropDuplicates(["word", "meant"])


_PAIR = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("flagged", T.LongType()),
        T.StructField("meant", T.StringType()),
        T.StructField("meant_n", T.LongType()),
        T.StructField("meant_caps", T.LongType()),
        T.StructField("ops", T.ArrayType(T.StringType())),
    ]
)


def _with_ops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ops = [_ops(w, c) for w, c in zip(b["word"], b["meant"])]
        b = b.assign(ops=[list(o) if o else None for o in ops])
        yield b[b["ops"].notna()][[f.name for f in _PAIR]]


def _features(b: pd.DataFrame, seen: dict[str, float]) -> np.ndarray:
    n, m = b["n"].to_numpy(float), b["meant_n"].to_numpy(float)
    least = np.array([min((seen.get(o, 0.0) for o in ops), default=0.0) for ops in b["ops"]])
    sites = np.array([len(ops) for ops in b["ops"]], float)
    size = b["meant"].str.len().to_numpy(float)
    odd = np.array([not w.replace("-", "").replace("'", "").isalpha() for w in b["word"]], float)
    gap = b["word"].str.len().to_numpy(float) - size
    return np.stack([least, sites, np.log1p(m), np.log1p(n), np.log(m / np.maximum(n, 1)), size, odd, gap], axis=1)


def corrections(vocabulary: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(word, meant, meant_caps): the chosen correction of every word type (of ``wanted``, where given) that has one.

    Replacements are weighted by how many different words they explain; the
    ranker learns from at most TRAINING_ROWS types whether the recogniser's own
    doubts (flags) mark them, and its verdict is joined with those doubts.
    """
    doubted = vocabulary
    if wanted is not None:
        # the ranker also learns from words that are surely right; they get no correction, so a bounded share by hash is enough
        right = vocabulary.where(_correctable() & (F.col("n") >= 10) & (F.col("flagged") * 50 < F.col("n"))).orderBy(F.xxhash64("word")).limit(TRAINING_ROWS // 4)
        doubted = vocabulary.where(~_trusted()).join(wanted, "word", "left_semi").unionByName(right).distinct()
    pairs = materialise(_candidates(vocabulary, doubted).mapInPandas(_with_ops, _PAIR), "pairs")
    single = pairs.where("size(ops) = 1 and flagged >= 1 and flagged * 3 >= n").select(F.col("ops")[0].alias("op"), "meant", "meant_n", "word")
    support = single.groupBy("op").agg(F.approx_count_distinct("meant").alias("k"))
    # every candidate of a flagged word meets it, but the word speaks for one replacement only, the commonest
    spoken = single.join(support, "op").groupBy("word").agg(F.max(F.struct("k", "meant_n", "op", "meant")).alias("b")).select("b.op", "b.meant")
    # every word speaks once, so at most 1 / OP_SHARE replacements have their share of them: the list is bounded whatever the corpus
    spoken = materialise(spoken.groupBy("op").agg(F.countDistinct("meant").alias("k")), "replacements")
    least = max(COMMON_OP, OP_SHARE * (spoken.agg(F.sum("k")).head()[0] or 0))
    seen = {r["op"]: float(np.log1p(r["k"])) for r in spoken.where(F.col("k") >= least).collect()}
    sure = pairs.where("(flagged >= 1 and flagged * 3 >= n) or (n >= 10 and flagged * 50 < n)")
    sample = sure.orderBy(F.xxhash64("word", "meant")).limit(TRAINING_ROWS).toPandas()
    model = Boosted()
    if len(sample):
        # of a flagged word's candidates only the one of the commonest replacement and count is the truth
        x = _features(sample, seen)
        marked = (sample["flagged"] * 3 >= sample["n"]).to_numpy()
        weight = x[:, 0] - 0.7 * (x[:, 1] - 1) + 0.1 * x[:, 2]
        best = pd.Series(weight).groupby(sample["word"].to_numpy()).transform("max").to_numpy()
        model.fit(x, (marked & (weight >= best - 1e-9)).astype(float))

    schema = T.StructType([f for f in _PAIR if f.name != "ops"] + [T.StructField("score", T.DoubleType()), T.StructField("least", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _features(b, seen)
            yield b.assign(score=model.probability(x), least=x[:, 0])[[f.name for f in schema]]

    ranked = pairs.mapInPandas(score, schema)
    best = ranked.groupBy("word").agg(
        F.max(F.struct("score", "meant_n", "meant", "meant_caps", "n", "flagged", "least")).alias("b")
    ).select("word", "b.*")
    doubted = (F.col("flagged") >= 1) & (F.col("flagged") * 4 >= F.col("n"))
    usual = F.col("least") > 0
    return best.where(~_trusted() & usual & ((F.col("score") >= 0.5) | doubted)).select("word", "meant", "meant_n", "meant_caps")


_FOLD = str.maketrans("áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")


class _Codes(dict):
    """Character to its code, as a character: 26 letters, one class for all else."""

    def __missing__(self, key: int) -> str:
        return chr(27)


_CODES = _Codes({ord(x): chr(_FOLD.get(ord(x), ord(x)) - 96) for x in "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, _FOLD))})


def _triples(word: str) -> list[int]:
    """Codes of the word's letter triples, ends marked; 26 letters, one class for the end and one for all else."""
    c = b"\0" + word.lower().translate(_CODES).encode("latin-1") + b"\0"
    return [x * 784 + y * 28 + z for x, y, z in zip(c, c[1:], c[2:])]


class Letters:
    """How a corpus' good words are spelt: log probabilities of letter triples and the score below which a word is strange."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(28, 28, 28) + 0.05
        self.log = np.log(table / table.sum(2, keepdims=True)).ravel().tolist()
        self.least = float("-inf")

    def score(self, word: str) -> float:
        codes = _triples(word)
        return sum(map(self.log.__getitem__, codes)) / len(codes)


_TRIPLE = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("n", T.DoubleType())])


def letters_of(vocabulary: DataFrame) -> Letters:
    """Learnt from every good word: a table of 28 cubed counts, then mean and spread of the scores of the words themselves."""
    good = vocabulary.where(_good() & (F.length("word") >= 3)).select("word", F.col("n").cast("double").alias("n"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(28**3)
        for b in batches:
            for w, n in zip(b["word"], np.log1p(b["n"].to_numpy(float))):
                np.add.at(total, _triples(w), n)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at.astype(np.int32), "n": total[at]})

    counts = np.zeros(28**3)
    for code, n in good.mapInPandas(count, _TRIPLE).groupBy("code").agg(F.sum("n")).collect():  # 28 cubed rows at most
        counts[code] = n
    letters = Letters(counts)

    @F.pandas_udf(T.DoubleType())
    def score(words: pd.Series) -> pd.Series:
        return pd.Series([letters.score(w) for w in words], dtype=float)

    s, n = F.col("s"), F.col("n")
    m = good.select(score("word").alias("s"), "n").agg(F.sum("n").alias("n"), F.sum(n * s).alias("a"), F.sum(n * s * s).alias("b")).head()
    if m["n"]:
        mean = m["a"] / m["n"]
        letters.least = mean - STRANGE * max(0.0, m["b"] / m["n"] - mean * mean) ** 0.5
    return letters


_SIDES, _SHAPES = ("T", "B"), ("end", "blank", "item", "cells", "short", "text")


def _line_features(b: pd.DataFrame) -> np.ndarray:
    """Features of an edge line and the line beside it; how often it stands in its file is no part of them."""
    key = b["key"]
    out = [
        key.str.len().to_numpy(float),
        key.str.count(r"\d").to_numpy(float),
        key.str.split().str.len().to_numpy(float),
        (key.str.count(r"[A-ZÁÉÍÓÚÑÄÖÜ]") / key.str.len().clip(lower=1)).to_numpy(float),
        key.str.contains(r"""[.!?,;:"”'’)]$""").to_numpy(float),
        key.str.contains(r"^[^\W\d_A-Z]").to_numpy(float),
        key.str.contains(r"\t|\|.*\||(?:,[^,]*){3,}|\S {3,}\S.* {3,}\S|\.{4,}|^[*·•▪‣–—-]\s|^\[.?\]\s|^\(?\w{1,3}[.)]\s").to_numpy(float),
        (b["side"] == "T").to_numpy(float),
    ]
    out += [(b["beside"] == shape).to_numpy(float) for shape in _SHAPES]
    return np.stack(out, axis=1)


def running_lines(edges: DataFrame, page_rows: DataFrame) -> DataFrame:
    """(page_id, line_no, line): running headers and footers, also where they were misread here and there.

    A classifier of line pairs (an edge line and the line beside it) is fitted on
    lines that nearly every page of a longer file has, against lines that stand
    once in such a file; it judges the shape of the lines a file repeats.
    """
    e = edges.where("not number and key <> '' and length(key) <= 120")
    odd = F.col("page_no") % 2 != 0
    pages = page_rows.distinct().groupBy("file_id").agg(F.count_if(odd).alias("odd"), F.count_if(~odd).alias("even"))
    page_rows_of = F.when(F.col("odd_k") == 0, F.col("even")).when(F.col("even_k") == 0, F.col("odd")).otherwise(F.col("odd") + F.col("even"))
    # left and right pages may have lines of their own: a line of one kind of page is held against those pages
    keyed = (
        e.select("file_id", "side", "key", "page_no", "beside")
        .groupBy("file_id", "side", "key")
        .agg(F.countDistinct("page_no").alias("k"), F.count_if(odd).alias("odd_k"), F.count_if(~odd).alias("even_k"), F.min("beside").alias("beside"))
        .join(pages, "file_id")
        .select("file_id", "side", "key", "k", "beside", page_rows_of.alias("n"))
    )
    keyed = materialise(keyed, "edge-keys")
    k, n = F.col("k"), F.col("n")
    sure = keyed.where("n >= 3").withColumn("label", F.when((k >= 3) & (k * 5 >= n * 4), 1.0).when((k == 1) & (n >= 4), 0.0)).where("label is not null")
    # (a single line that ends in a number may be a misread running line, so it teaches nothing)
    # as many of either kind; a fixed share of each by hash, bounded
    half = TRAINING_ROWS // 2
    sample = (
        sure.where("label = 1").orderBy(F.xxhash64("file_id", "key")).limit(half).unionByName(sure.where("label = 0").orderBy(F.xxhash64("file_id", "key")).limit(half)).toPandas()
    )
    model = Boosted(rounds=30).fit(_line_features(sample), sample["label"].to_numpy()) if len(sample) else None

    @F.pandas_udf(T.DoubleType())
    def furniture(key: pd.Series, side: pd.Series, beside: pd.Series) -> pd.Series:
        b = pd.DataFrame({"key": key, "side": side, "beside": beside})
        return pd.Series(model.probability(_line_features(b)) if model and model.trees else np.full(len(b), 0.5))

    heads = keyed.where("k >= 2").withColumn("p", furniture("key", "side", "beside"))
    digits = F.col("key").rlike(r"\d")
    often = (k * 2 >= n) | ((k >= 4) & (k * 3 >= n)) | (digits & (k >= 2))
    # repetition multiplies the odds the shape gives: most on nearly every page, less for an exact number that comes back
    weight = F.when((k >= 3) & (k * 5 >= n * 4), 20.0).when(k == n, 10.0).when(digits & (k >= 2), 10.0).when(k * 2 >= n, 3.0).otherwise(1.0)
    heads = heads.where(often & (F.col("p") * weight >= 1 - F.col("p"))).select("file_id", "side", "key")
    heads = materialise(heads, "running-keys")
    # a short file may show a running line once: it counts where other files have made its numbered pattern known
    pattern = F.regexp_replace("key", "[0-9]+", "#")
    known = heads.where(digits).groupBy("side", pattern.alias("pattern")).agg(F.approx_count_distinct("file_id").alias("files")).where("files >= 3").select("side", "pattern")
    once = keyed.where(digits & (k == 1) & (n <= 3)).withColumn("pattern", pattern).join(known, ["side", "pattern"], "left_semi").select("file_id", "side", "key")
    heads = heads.unionByName(once)
    # on a page of few lines a footer may be among the first
    exact = e.join(heads.select("file_id", "key").distinct(), ["file_id", "key"], "left_semi").select("page_id", "line_no", "line")
    close = (F.col("key") != F.col("head")) & (F.abs(F.length("key") - F.length("head")) <= 3) & (F.levenshtein("key", "head") * 4 <= F.length("head"))
    heads = heads.join(keyed.groupBy("file_id", "key").agg(F.max(k * 3 >= n).alias("main")), ["file_id", "key"]).withColumnRenamed("key", "head")
    heads = materialise(heads.groupBy("file_id", "head").agg(F.max("main").alias("main")), "running-heads")
    distinct = keyed.select("file_id", "key").distinct()
    # lines on a third of a file's pages: at most 6 * EDGE a kind of page, so each key of the file meets a few
    near = distinct.join(heads.where("main"), "file_id").where(close).select("file_id", "key")
    # the many lines a file merely repeats meet keys that begin or end like them
    ends = F.explode(F.array(F.concat(F.lit("<"), F.substring(F.col("x"), 1, 4)), F.concat(F.lit(">"), F.expr("right(x, 4)")))).alias("end")
    rare = heads.where("not main").withColumn("x", F.col("head")).select("file_id", "head", ends)
    like = distinct.withColumn("x", F.col("key")).select("file_id", "key", ends).join(rare, ["file_id", "end"]).where(close).select("file_id", "key")
    near = e.join(near.unionByName(like).distinct(), ["file_id", "key"], "left_semi").select("page_id", "line_no", "line")
    return exact.unionByName(near).dropDuplicates(["page_id", "line_no"])


def running_prose(first: DataFrame, page_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line): lines that read like prose and stand at the edge of nearly all of their file's pages, letter for letter."""
    h = first.where("what = 'h'")
    pages_of = page_rows.distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    keys = h.groupBy("file_id", "key").agg(F.countDistinct("page_no").alias("k")).where("k >= 3").join(pages_of, "file_id").where("k * 5 >= n * 4").select("file_id", "key")
    at = materialise(h.join(keys, ["file_id", "key"], "left_semi").select("page_id", "line_no").distinct(), "running-prose")
    if at.isEmpty():
        return at.withColumn("line", F.lit(""))
    text = pages.select(F.col("page_id").cast("long"), "text").where("text is not null").join(at, "page_id")
    return text.select("page_id", "line_no", F.trim(F.get(F.split("text", "\n"), F.col("line_no"))).alias("line")).distinct()


def _join_features(plain: np.ndarray, hard: np.ndarray, first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Features of a line pair broken within a word: how often either joint and either half is seen, and the halves' forms."""
    cap = np.array([y[:1].isupper() for y in b], float)
    inner = np.array(["-" in x for x in a], float)
    return np.stack([*(np.log1p(x.astype(float)) for x in (plain, hard, first, second)), cap, inner, np.array([len(x) for x in a], float), np.array([len(y) for y in b], float)], axis=1)


def join_model(words: DataFrame) -> Boosted | None:
    """Classifier of line pairs: whether the hyphen between two halves belongs to the word.

    It teaches itself: words of the vocabulary are broken where a line might break
    them, hyphenated ones at their hyphen; in half of the cases the whole word
    counts as unseen, so that the halves alone must decide.
    """
    rows = words.where(F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*[\p{L}]$") & (F.col("n") >= 3)).orderBy(F.desc("n"), "word").limit(TRAINING_ROWS).select("word", "n").collect()
    count = {r["word"]: r["n"] for r in rows}
    cases = []
    for k, (w, n) in enumerate(count.items()):
        seen = n if k % 2 else 0
        if "-" in w:
            for at in (i for i, c in enumerate(w) if c == "-"):
                x, y = w[:at], w[at + 1 :]
                if x and y:
                    cases.append((count.get(x + y, 0), seen, count.get(x, 0), count.get(y, 0), x, y, 1.0))
        elif len(w) >= 5:
            at = 2 + (k * 7) % (len(w) - 3)
            x, y = w[:at], w[at:]
            cases.append((seen, count.get(f"{x}-{y}", 0), count.get(x, 0), count.get(y, 0), x, y, 0.0))
    if sum(c[-1] for c in cases) < 20:
        return None
    c = list(zip(*cases))
    x = _join_features(*(np.array(v, float) for v in c[:4]), np.array(c[4], object), np.array(c[5], object))
    return Boosted(rounds=40).fit(x, np.array(c[6]))


_SECOND = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("joined", T.StringType()),
        T.StructField("cut", T.IntegerType()),
    ]
)


#: Tokens judged and kept per Python worker; emptied when full.
TOKENS_KEPT = 400_000
_CORRECTABLE = re.compile(r"[\w@(|$!'’-]+")


def _judge(low: str, known: frozenset[str], letters: Letters) -> int:
    """0, or 1 if it counts as a word, or 2 if it is a strange one, and 3 more if it may need a correction; the word is in lower case."""
    plain = low.isalpha()
    if not plain and not any(map(str.isalpha, low)):
        return 0
    counts = len(low) >= 3 and (plain or sum(map(str.isdigit, low)) * 2 < len(low))
    strange = counts and letters.score(low) < letters.least
    wanted = low not in known and (plain or "_" not in low and _CORRECTABLE.fullmatch(low))
    return counts + strange + (3 if wanted else 0)


class _Judged(dict):
    """Token to its code (see ``_judge``); ``wanted`` has word and lower case of those that may need a correction. A word is judged once, whatever stands around it."""

    def __init__(self, known: frozenset[str], letters: Letters):
        self.known, self.letters = known, letters
        self.codes: dict[str, int] = {}
        self.wanted: dict[str, tuple[str, str]] = {}

    def __missing__(self, token: str) -> int:
        w = _bare(token)
        low = w.lower()
        if (code := self.codes.get(low)) is None:
            self.codes[low] = code = _judge(low, self.known, self.letters)
        if code >= 3:
            self.wanted[token] = (w, low)
        self[token] = code
        return code

    def clear(self) -> None:
        super().clear()
        self.codes.clear()
        self.wanted.clear()


_DOUBTED = re.compile(rb"[\x03-\x05]")


def _second_pass(known: frozenset[str], letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _Judged(known, letters)
        for b in batches:
            rows: list[tuple] = []
            if len(judged) > TOKENS_KEPT:
                judged.clear()
            for page_id, text in zip(b["page_id"].to_pylist(), b["text"].to_pylist()):
                if not text or text.isspace():
                    continue
                lines = text.split("\n")
                split = [s.split() for s in lines]
                edge = {i for i, _, _ in _edges(split)}
                skip = {i for i in edge if page_number_of(lines[i].strip())}
                split = _unbroken(split)
                tokens = list(chain.from_iterable(split))
                codes = bytes(map(judged.__getitem__, tokens))
                strange, total = codes.count(2) + codes.count(5), len(codes) - codes.count(0) - codes.count(3)
                if strange * 2 <= total + 2 and (doubted := [m.start() for m in _DOUBTED.finditer(codes)]):
                    ends = list(accumulate(map(len, split)))
                    own = ((bisect_right(ends, k), judged.wanted[tokens[k]]) for k in doubted)
                    rows += dict.fromkeys((page_id, i if i in edge else -1, "misread", *x, None, None) for i, x in own)
                for i, first, mark, second in _broken(lines, skip):
                    plain = first + second
                    if not plain.translate(_JOINTS).isalpha():
                        continue
                    hard = first + "-" + second
                    rows.append((page_id, i if i in edge else -1, "hyphen", mark, plain, hard, len(first)))
            yield from_rows(_SECOND, rows)

    return run


def first_pass(pages: DataFrame) -> DataFrame:
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("file_id").cast("long"), F.col("page_no").cast("int"), "text", F.col("low_confidence_words").alias("low")
    ).where("page_id is not null and text is not null")
    return materialise(rows.mapInArrow(_first_pass, _FIRST), "first-pass")


def vocabulary_of(first: DataFrame) -> DataFrame:
    return first.where("what = 'w' and word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.sum("caps").alias("caps"))


def noise(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, token, found_text): every repair, with the line it is in (-1: any but an edge line)."""
    first = first_pass(pages)
    words = materialise(vocabulary_of(first), "vocabulary")
    edges = first.where("what = 'e'")
    page_rows = first.where("what = 'p'").select("file_id", "page_no")
    running = running_lines(edges, page_rows).unionByName(running_prose(first, page_rows, pages))
    running = materialise(running.dropDuplicates(["page_id", "line_no"]), "running-lines")

    known = frozenset(r[0] for r in words.where(_trusted()).orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("word").collect())
    text = pages.select(F.col("page_id").cast("long"), "text").where("page_id is not null and text is not null")
    second = materialise(text.mapInArrow(_second_pass(known, letters_of(words)), _SECOND), "second-pass")
    # running lines are no part of the body; only lines at the edges can be
    inner = second.where("line_no < 0")
    outer = second.where("line_no >= 0").join(running.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti")
    body = inner.unionByName(outer.select(*inner.columns))

    fixes = materialise(corrections(words, body.where("kind = 'misread'").select("word").distinct()), "corrections")
    upper_first = F.col("token").rlike(r"^\p{Lu}")
    same_first = F.lower(F.substring("token", 1, 1)) == F.lower(F.substring("meant", 1, 1))
    all_upper = (F.upper("token") == F.col("token")) & (F.length("token") > 1)
    capital = F.concat(F.upper(F.substring("meant", 1, 1)), F.expr("substring(meant, 2)"))
    mostly_capital = F.col("meant_caps") * 2 > F.col("meant_n")
    cased = F.when(all_upper & F.col("token").rlike(r"\p{Lu}.*\p{Lu}"), F.upper("meant")).when(upper_first | (~same_first & mostly_capital), capital).otherwise(F.col("meant"))
    misread = body.where("kind = 'misread'").join(fixes, "word").select("page_id", "line_no", "kind", "token", cased.alias("found_text"))

    first_half, second_half = F.expr("substring(word, 1, cut)"), F.expr("substring(word, cut + 1)")
    roles = {"p": F.lower("word"), "h": F.lower("joined"), "f": F.lower(first_half), "s": F.lower(second_half)}
    broken = body.where("kind = 'hyphen'").withColumns({f"_{r}": c for r, c in roles.items()})
    counts = words.select(F.col("word").alias("seen"), "n")
    forms = broken.select(F.explode(F.array(*[f"_{r}" for r in roles])).alias("seen")).distinct().join(counts, "seen")
    forms = materialise(forms, "joined-words")
    b = broken
    for r in roles:
        b = b.join(forms.select(F.col("seen").alias(f"_{r}"), F.col("n").alias(f"_{r}n")), f"_{r}", "left")
    joins = join_model(words)

    @F.pandas_udf(T.DoubleType())
    def hyphen_belongs(pn: pd.Series, hn: pd.Series, fn: pd.Series, sn: pd.Series, a: pd.Series, z: pd.Series) -> pd.Series:
        if joins is None:
            return (hn.fillna(0) > pn.fillna(0)).astype(float)
        x = _join_features(*(v.fillna(0).to_numpy(float) for v in (pn, hn, fn, sn)), a.to_numpy(object), z.to_numpy(object))
        return pd.Series(joins.probability(x))

    keep = hyphen_belongs("_pn", "_hn", "_fn", "_sn", first_half, second_half) >= 0.5
    hyphen = b.select("page_id", "line_no", "kind", F.col("word").alias("token"), F.when(keep, F.col("joined")).otherwise(F.col("word")).alias("found_text"))

    header = running.select("page_id", "line_no", F.lit("header").alias("kind"), F.col("line").alias("token"), F.col("line").alias("found_text"))
    number = edges.where("number").select("page_id", "line_no", F.lit("page_number").alias("kind"), F.col("line").alias("token"), F.col("line").alias("found_text"))
    return misread.unionByName(hyphen).unionByName(header).unionByName(number)


def found_noise(pages: DataFrame) -> DataFrame:
    """(page_id, kind, found_text) for hyphen, misread, header and page_number."""
    return noise(pages).select("page_id", "kind", "found_text").dropDuplicates()


def mended(text: str, repairs: list) -> str:
    """The text as paragraphs: running lines and page numbers dropped, broken words joined, misread words replaced."""
    lines = text.split("\n")
    drop = {r["line_no"] for r in repairs if r["kind"] in ("header", "page_number")}
    whole = {r["token"]: r["found_text"] for r in repairs if r["kind"] == "hyphen"}
    right = {r["token"]: r["found_text"] for r in repairs if r["kind"] == "misread"}
    paragraphs: list[list[str]] = [[]]
    carry = None
    for i, s in enumerate(lines):
        if i in drop:
            continue
        tokens = s.split()
        if not tokens:
            if carry is None:
                paragraphs.append([])
            continue
        if carry is not None:
            second = tokens[0].strip(_STRIP)
            first = carry[:-1].lstrip(_STRIP)
            fixed = whole.get(first + second)
            glued = carry[:-1] + tokens[0]
            tokens[0] = glued.replace(first + second, fixed, 1) if fixed else carry + tokens[0]
            carry = None
        if len(tokens[-1]) > 2 and tokens[-1][-1] in _BREAKS and tokens[-1][-2].isalpha():
            carry = tokens.pop()
        for t in tokens:
            w = _bare(t)
            paragraphs[-1].append(t.replace(w, right[w], 1) if w in right else t)
    if carry is not None:
        paragraphs[-1].append(carry)
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def repaired(pages: DataFrame) -> DataFrame:
    """(page_id, text) with every repair made; the repairs of a page are a list no longer than its text."""
    fixes = noise(pages).dropDuplicates().groupBy("page_id").agg(F.collect_list(F.struct("line_no", "kind", "token", "found_text")).alias("repairs"))
    text = pages.select(F.col("page_id").cast("long"), "text").where("page_id is not null").dropDuplicates(["page_id"])

    @F.pandas_udf(T.StringType())
    def mend(texts: pd.Series, repairs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mended(t, list(r) if r is not None else []) for t, r in zip(texts, repairs)], dtype=object)

    return text.join(fixes, "page_id", "left").select("page_id", mend("text", "repairs").alias("text"))
