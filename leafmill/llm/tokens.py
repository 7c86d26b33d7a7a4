"""Exact byte-level BPE ids by dynamic programming over prefixes.

BPE is usually run by merging pairs until none is left.  The same ids follow
from a property of the merge order: a token sequence is the BPE encoding of its
bytes exactly if every neighbouring pair of it is, i.e. if no merge of higher
priority would have crossed the border between the two tokens.  So for every
prefix of a piece there is one last token whose pair with the last token of the
rest is compatible; a pattern automaton over the vocabulary (its suffix links walk
from the longest token that ends at a position to the shorter ones, which is what a
suffix automaton would be asked for) proposes the candidates, the pair test picks
the unique one, and back-pointers give the ids.

Defined results: a null text and an empty text give an empty list; strings that
look like special tokens are ordinary text; lone surrogates cannot occur in
Spark strings.  Rows keep their ids whatever their length; every row has its own
answer, so a doc_id that repeats comes out as often as it goes in.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Encoded pieces kept per Python worker; the cache is emptied when full, so memory is bounded.
PIECES_KEPT = 200_000


class PrefixEncoder:
    """Encoder for one vocabulary of byte tokens whose ids are their merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        # how each token came to be: the two tokens its last merge joined
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.cache: dict[str, list[int]] = {}

    def merges_of(self, i: int) -> tuple[int, int] | None:
        """The pair of tokens whose merge gives token ``i`` (None for single bytes)."""
        if i in self.parts:
            return self.parts[i]
        token = self.tokens[i]
        if len(token) == 1:
            return None
        ids = self._merged(token, below=i)
        if len(ids) != 2:
            raise ValueError(f"token {i} cannot be reached by merging")
        self.parts[i] = (ids[0], ids[1])
        return self.parts[i]

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Plain merging with the merges of rank less than ``below``; only vocabulary set-up uses it."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                rank = self.ranks.get(parts[k] + parts[k + 1], below)
                if rank < best:
                    best, at = rank, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` stay two tokens when their bytes stand together.

        Walks the two tokens' merge trees along their common border in reverse
        order of rank: a merge across the border at a rank lower than the last
        merge undone would have happened first, so the pair could not be.
        """
        key = (left, right)
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        a, b, limit, ok = left, right, len(self.ranks) + 1, True
        tokens, ranks = self.tokens, self.ranks
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < limit:
                ok = False
                break
            if a > b:  # the later merge is undone first
                limit = a
                parts = self.merges_of(a)
                if parts is None:
                    limit = b
                    parts = self.merges_of(b)
                    if parts is None:
                        break
                    b = parts[0]
                    limit += 1
                else:
                    a = parts[1]
            else:
                limit = b
                parts = self.merges_of(b)
                if parts is None:
                    limit = a
                    parts = self.merges_of(a)
                    if parts is None:
                        break
                    a = parts[1]
                else:
                    b = parts[0]
                    limit += 1
        self.pair_ok[key] = ok
        return ok

    def piece(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= PIECES_KEPT:
                self.cache.clear()
                self.pair_ok.clear()
            ids = self.cache[piece] = self._piece(piece.encode("utf-8"))
        return ids

    def _piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        last: list[int] = [-1] * (n + 1)  # the last token of each prefix
        size: list[int] = [0] * (n + 1)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(data.decode("latin-1")):
            ending[end].append(found)
        for end in range(n):
            for i, length in ending[end]:  # longest first
                start = end + 1 - length
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], i)):
                    last[end + 1], size[end + 1] = i, length
                    break
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, ids = self.cache, []
        for piece in self.split(text):
            ids.extend(cache.get(piece) or self.piece(piece))
        return ids


def load_encoder(name: str = DEFAULT_TOKENIZER, directory: str | None = None) -> PrefixEncoder:
    """The encoder of a public vocabulary; ``directory`` overrides where its files are read."""
    import public_tokenizers

    path = f"{directory}/{name}.tiktoken" if directory else public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return PrefixEncoder(ranks, public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=2)
def kept_encoder(name: str, directory: str | None) -> PrefixEncoder:
    """The encoder this Python worker has built before, for whichever task."""
    return load_encoder(name, directory)


def encode_texts(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = DEFAULT_TOKENIZER, directory: str | None = None
) -> DataFrame:
    """(id, ids) of every document; one pass over the scan, nothing is shuffled.

    Only the id and the text reach Python, in Arrow batches; ids of repeated pieces
    come from a bounded per-worker cache, so a long text costs its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = kept_encoder(tokenizer, directory).encode
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [encode(t) for t in b["text"]]})

    kind = documents.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_column)
