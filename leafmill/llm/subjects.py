"""Subject areas of documents by averaged word and subword embeddings with independent logistic outputs.

A text is the mean of its words' vectors, a word the mean of its own vector and
those of its character n-grams (all hashed into one table); each subject has its
own logistic output, which alone decides about it.  The model is fitted on a
bounded sample of labelled documents spread over partitions: every round each
partition computes the gradient of its rows, the partial gradients are summed and
one step is taken, so all partitions keep the same parameters.  A second fit works
on single sentences of the same documents, labelled by the first.  Scoring reads
every document once: each sentence has every subject whose output is sure of it,
and a document the subjects of at least a quarter of its sentences.

Defined results: null, empty and blank texts, and texts without readable
sentences, have no subject; labels that are null or name no subject are left
out; a doc_id that repeats counts once; texts of any length are read whole;
without labels nothing is learnt and the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.arrow import from_rows
from leafmill.storage import materialise

#: Hashed vectors, their width, and the most rows either fit uses (labelled documents, then sentences of them).
SLOTS, WIDTH = 1 << 14, 16
TRAINING_DOCUMENTS = 20_000
TRAINING_SENTENCES = 60_000
ROUNDS = 25
#: A sentence has a subject where that subject's output is at least this, whatever the others are.
SURE = 0.5
#: Partitions a fit's bounded rows are spread over: each sends a gradient of a megabyte a round.
PARTITIONS = 6
#: The first fit labels a sentence where its best output leads the next by this much.
CLEAR = 0.5
#: Output of a whole text's first subject at least (and of its second at most one less this) to stand for all its sentences,
#: unless a sentence's own best output is further than NEAR ahead.
ONLY, NEAR = 0.7, 1.5
#: Words kept with their outputs per Python worker; forgotten when there are more.
WORDS_KEPT = 200_000

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARKER = re.compile(r"(?m)^\s*-{3,}.*-{3,}\s*$|^\s*>+ ?")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐¬\xad] ?\n(?:> )?\s*(?=[^\W\d_])")
_SENTENCE = re.compile(r"(?<=[^\W\d_][.!?])[\"”’')]*\s+(?=[\"“‘'(>]?[A-ZÁÉÍÓÚÑÄÖÜ¿¡])|(?<=[\d)\"”][.!?])\s+(?=[\"“‘'(]?[A-ZÁÉÍÓÚÑÄÖÜ¿¡])|\n\s*\n")
_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "@": "a", "6": "b", "|": "l", "$": "s", "ﬁ": "fi", "ﬂ": "fl"})


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: page marks and quote marks dropped, broken words joined, one white space between words."""
    if not text or text.isspace():
        return []
    body = _BROKEN.sub("", _MARKER.sub("", text))
    return [s for s in (" ".join(x.split()) for x in _SENTENCE.split(body) if x) if s]


def words_of(sentence: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(sentence.translate(_FOLD) if not sentence.isalpha() else sentence)]


def readable(words: Sequence[str], function_words: frozenset[str]) -> bool:
    """Whether a run of words is a sentence of a language: long enough and held together by function words."""
    return len(words) >= 4 and sum(map(function_words.__contains__, words)) >= max(1, 0.14 * len(words))


def slots_of(word: str) -> list[int]:
    """The table slots of a word: its own, then its character n-grams of four and five with the ends marked."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1) if len(marked) > n]
    return [zlib.crc32(g.encode()) & (SLOTS - 1) for g in grams]


#: Rows to a block of features; a block's words share one table of slots.
BLOCK = 2_000


class Block:
    """Texts as counts over the block's own words, and those words as slots: sparse matrices laid end to end."""

    def __init__(self, outputs: int):
        self.outputs = outputs
        self.index: dict[str, int] = {}
        self.slots: list[int] = []
        self.slot_starts: list[int] = []
        self.words: list[int] = []
        self.weights: list[float] = []
        self.starts: list[int] = []
        self.y: list[np.ndarray] = []

    def add(self, words: Sequence[str], subjects: Sequence[int]) -> None:
        self.starts.append(len(self.words))
        for w, n in Counter(words).items():
            k = self.index.get(w)
            if k is None:
                k = self.index[w] = len(self.index)
                self.slot_starts.append(len(self.slots))
                self.slots += slots_of(w)
            self.words.append(k)
            self.weights.append(n / len(words))
        y = np.zeros(self.outputs, np.float32)
        y[list(subjects)] = 1
        self.y.append(y)

    def row(self) -> tuple:
        ints = [np.asarray(x, np.int32).tobytes() for x in (self.slots, self.slot_starts, self.words, self.starts)]
        return (len(self.starts), *ints, np.asarray(self.weights, np.float32).tobytes(), np.stack(self.y).tobytes())


class Model:
    """Vectors, outputs and biases, with the Adam state of the fit."""

    def __init__(self, outputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.parts = [
            rng.normal(0, 0.1, (SLOTS, WIDTH)).astype(np.float32),
            rng.normal(0, 0.3, (WIDTH, outputs)).astype(np.float32),
            np.full(outputs, -2.0, np.float32),
        ]
        self.m = [np.zeros_like(p) for p in self.parts]
        self.v = [np.zeros_like(p) for p in self.parts]
        self.t = 0

    def step(self, gradient: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for p, m, v, g in zip(self.parts, self.m, self.v, gradient):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


#: Mean vectors are small; outputs read them at this scale.
SCALE = 8.0


def gradient(parts: list[np.ndarray], slots, slot_starts, words, starts, weights, y) -> list[np.ndarray]:
    """Summed gradient of the logistic losses of a block: words from their slots, texts from their words, and back."""
    vectors, outputs, bias = parts
    slot_n = np.diff(np.r_[slot_starts, len(slots)]).astype(np.float32)
    of_word = np.add.reduceat(vectors[slots], slot_starts, axis=0) / slot_n[:, None]
    mean = np.add.reduceat(of_word[words] * weights[:, None], starts, axis=0) * SCALE
    p = 1 / (1 + np.exp(-(mean @ outputs + bias)))
    d = (p - y).astype(np.float32)
    back = (d @ outputs.T) * SCALE
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)]))
    each = back[row] * weights[:, None]
    to_word = np.stack([np.bincount(words, each[:, k], len(slot_starts)) for k in range(WIDTH)], axis=1) / slot_n[:, None]
    to_slot = to_word[np.repeat(np.arange(len(slot_starts)), slot_n.astype(int))]
    table = np.stack([np.bincount(slots, to_slot[:, k], SLOTS) for k in range(WIDTH)], axis=1)
    return [table.astype(np.float32), mean.T @ d, d.sum(0)]


_INTS = ("slots", "slot_starts", "words", "starts")
_FEATURES = T.StructType(
    [T.StructField("rows", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in (*_INTS, "weights", "y")]
)
_GRADIENT = T.StructType([T.StructField("rows", T.LongType()), T.StructField("parts", T.ArrayType(T.BinaryType()))])


def fit(rows: DataFrame, outputs: int, rounds: int = ROUNDS, model: Model | None = None, rate: float = 0.08) -> Model:
    """Full-gradient Adam over the feature rows; each partition sends one gradient (a megabyte) a round."""
    model = model or Model(outputs)
    rows = rows.coalesce(PARTITIONS).persist()  # bounded, and read every round; a lost executor's share is read again from its table
    for r in range(rounds):
        parts = [p.copy() for p in model.parts]

        def partial(batches: Iterator[pa.RecordBatch], parts=parts) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for b in batches:
                for block in b.to_pylist():
                    ints = [np.frombuffer(block[c], np.int32) for c in _INTS]
                    y = np.frombuffer(block["y"], np.float32).reshape(block["rows"], -1)
                    g = gradient(parts, *ints, np.frombuffer(block["weights"], np.float32), y)
                    total = g if total is None else [a + c for a, c in zip(total, g)]
                    n += block["rows"]
            if total is not None:
                yield from_rows(_GRADIENT, [(n, [a.astype(np.float32).tobytes() for a in total])])

        sent = rows.mapInArrow(partial, _GRADIENT).collect()
        n = sum(s["rows"] for s in sent)
        if not n:
            break
        total = [sum(np.frombuffer(s["parts"][k], np.float32).astype(np.float64) for s in sent) for k in range(3)]
        model.step([(t / n).reshape(p.shape).astype(np.float32) for t, p in zip(total, model.parts)], rate * (1 - 0.7 * r / rounds))
    rows.unpersist()
    return model


class Scorer:
    """Outputs of words and sentences under a fitted model, many sentences at a time."""

    def __init__(self, parts: list[np.ndarray], function_words: frozenset[str]):
        self.vectors, self.outputs, self.bias = parts
        self.function_words = function_words
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.bias)), self.vectors.dtype)

    def places(self, words: Sequence[str]) -> list[int]:
        """Rows of the words in the table of outputs; words not met before are added at once."""
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            slots = [slots_of(w) for w in new]
            starts = np.cumsum([0] + [len(x) for x in slots[:-1]])
            own = np.add.reduceat(self.vectors[[k for x in slots for k in x]], starts, axis=0) / np.array([[len(x)] for x in slots], self.vectors.dtype)
            first = len(index)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = (own @ self.outputs) * SCALE
            index.update((w, first + k) for k, w in enumerate(new))
        return [index[w] for w in words]

    def logits(self, sentences_: Sequence[Sequence[str]]) -> np.ndarray:
        """One row of outputs, before the logistic, per sentence of at least one word."""
        if len(self.index) > WORDS_KEPT:
            self.forget()
        flat = [w for s in sentences_ for w in s]
        if not flat:
            return np.zeros((0, len(self.bias)), np.float32)
        n = np.array([len(s) for s in sentences_])
        rows = self.places(flat)
        return np.add.reduceat(self.table[rows], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None] + self.bias

    def readable(self, text: str | None) -> list[list[str]]:
        return [w for s in sentences(text) if readable(w := words_of(s), self.function_words)]

    def shares(self, texts: Sequence[str | None]) -> list[tuple[int, np.ndarray]]:
        """(readable sentences, how many of them have each subject) of every text."""
        own = [self.readable(t) for t in texts]
        sure = 1 / (1 + np.exp(-self.logits([w for t in own for w in t]))) >= SURE
        upto = np.cumsum([0] + [len(t) for t in own])
        return [(len(t), sure[a:b].sum(0)) for t, a, b in zip(own, upto, upto[1:])]


def clean_labels(labels: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """(doc_id, y): the subjects readers named, spelling repaired; each reader's vote counts once per document."""
    plain = F.regexp_replace(F.lower("subject"), "[^\\p{L}]", "")
    number = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(subjects))):
        number = F.when((F.length(plain) >= 3) & F.lit(s).startswith(plain), F.lit(k)).otherwise(number)
    votes = labels.select("doc_id", "labelled_by", number.alias("k")).where("doc_id is not null and k is not null").distinct()
    count = votes.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
    return count.groupBy("doc_id").agg(F.collect_list("k").alias("ks"))  # at most one entry per subject


def train(documents: DataFrame, labels: DataFrame, subjects: Sequence[str], function_words: frozenset[str]) -> Model | None:
    """Both fits over a bounded sample of labelled documents."""
    size = len(subjects)
    known = clean_labels(labels, subjects).orderBy(F.xxhash64("doc_id")).limit(TRAINING_DOCUMENTS)
    sample = documents.select("doc_id", "text").join(known, "doc_id").where("text is not null").dropDuplicates(["doc_id"]).repartition(PARTITIONS, "doc_id")
    sample = materialise(sample, "labelled")

    def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(size)
        for b in batches:
            for text, ks in zip(b["text"].to_pylist(), b["ks"].to_pylist()):
                words = [w for s in sentences(text) if readable(own := words_of(s), function_words) for w in own]
                if words:
                    block.add(words, ks)
                if len(block.starts) >= BLOCK:
                    yield from_rows(_FEATURES, [block.row()])
                    block = Block(size)
        if block.starts:
            yield from_rows(_FEATURES, [block.row()])

    rows = materialise(sample.mapInArrow(document_rows, _FEATURES), "document-features")
    if rows.isEmpty():
        return None
    model = fit(rows, size)
    parts = model.parts
    # sentences of the labelled documents, a share of them by hash, of a bounded expected number
    keep = min(1.0, TRAINING_SENTENCES / max(1, sample.count() * 8))

    def sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, block = Scorer(parts, function_words), Block(size)
        for b in batches:
            for text in b["text"].to_pylist():
                own = scorer.readable(text)
                if not own:
                    continue
                each = scorer.logits(own)
                # where the whole text speaks clearly of one subject, its sentences are taken to do so too
                whole = 1 / (1 + np.exp(-np.average(each, axis=0, weights=[len(w) for w in own])))
                top = np.argsort(whole)[::-1]
                only = int(top[0]) if whole[top[0]] >= ONLY and (size == 1 or whole[top[1]] <= 1 - ONLY) else None
                for words, z in zip(own, each):
                    if zlib.crc32(" ".join(words).encode()) % 10_000 >= keep * 10_000:
                        continue
                    best = np.sort(z)[::-1]
                    lead = best[0] - best[1] if size > 1 else best[0]
                    if only is not None and z[only] >= best[0] - NEAR:
                        block.add(words, [only])
                    else:
                        block.add(words, [int(z.argmax())] if lead >= CLEAR else [])
                    if len(block.starts) >= BLOCK:
                        yield from_rows(_FEATURES, [block.row()])
                        block = Block(size)
        if block.starts:
            yield from_rows(_FEATURES, [block.row()])

    second = materialise(sample.mapInArrow(sentence_rows, _FEATURES), "sentence-features")
    return fit(second, size, rounds=ROUNDS + 10, model=Model(size))


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: Sequence[str], function_words: frozenset[str], share: float = 0.25) -> DataFrame:
    """(doc_id, subject) for every subject of at least ``share`` of a document's readable sentences."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("subject", T.StringType())])
    model = train(documents, labels, subjects, function_words)
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    parts, names = model.parts, list(subjects)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(parts, function_words)
        for b in batches:
            found = scorer.shares(b["text"].to_pylist())
            out = [(d, names[k]) for d, (n, counts) in zip(b["doc_id"].to_pylist(), found) for k in np.flatnonzero(counts >= max(1, share * n))]
            yield from_rows(schema, out)

    rows = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(score, schema).dropDuplicates()
