"""Byte-level BPE by an index of pair occurrences.

All texts of a batch are encoded together. Every pair of neighbouring tokens that can merge is
kept in an index from its rank to its positions; the active ranks are applied in ascending order
over all positions at once, and each merge updates the lists of the pairs beside it. Words are
independent, so the result equals the word-by-word encoding.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraline.plans.lineage import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary (fixed value).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps; when it is full the memory is emptied, which changes no result.
WORD_MEMORY = 200_000
LONGEST_KEPT_WORD = 64


class PairIndexEncoder:
    """Encodes words with ranked merges (``ranks``: bytes of a token to its id, which is its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.merged: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT_PATTERN).findall

    @classmethod
    def parse(cls, vocabulary: bytes) -> PairIndexEncoder:
        pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def _rank(self, left: int, right: int) -> int:
        """The id that the pair merges into, -1 if it never does."""
        key = left << 32 | right
        rank = self.merged.get(key)
        if rank is None:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            self.merged[key] = rank
        return rank

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word; all words share one occurrence index."""
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        bounds = [0]
        for word in words:
            token += [self.byte_ids[b] for b in word.encode("utf-8", "replace")]
            first, last = bounds[-1], len(token)
            after += range(first + 1, last + 1)
            before += range(first - 1, last - 1)
            if last > first:
                after[-1], before[first] = -1, -1
            bounds.append(last)

        positions: dict[int, list[int]] = {}
        rank_of, dead = self._rank, -1
        for i, j in enumerate(after):
            if j != -1 and (rank := rank_of(token[i], token[j])) != -1:
                positions.setdefault(rank, []).append(i)
        active = list(positions)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for i in sorted(positions.pop(rank)):
                if token[i] == dead or (j := after[i]) == -1 or rank_of(token[i], token[j]) != rank:
                    continue  # a neighbouring merge took one of the two
                token[i], token[j] = rank, dead
                after[i] = k = after[j]
                if k != -1:
                    before[k] = i
                for left, right in ((before[i], i), (i, k)):
                    if left != -1 and right != -1 and (new := rank_of(token[left], token[right])) != -1:
                        if new not in positions:
                            positions[new] = []
                            heapq.heappush(active, new)
                        positions[new].append(left)
        return [tuple(t for t in token[a:b] if t != dead) for a, b in zip(bounds, bounds[1:])]

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts give an empty list."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > WORD_MEMORY:
            self.known.clear()
        if len(self.merged) > 4 * WORD_MEMORY:
            self.merged.clear()
        fresh = list({w for words in split for w in words if w not in self.known})
        found = dict(zip(fresh, self.encode_words(fresh)))
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST_KEPT_WORD)
        known = self.known
        return [[i for w in words for i in (known.get(w) or found[w])] for words in split]


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> PairIndexEncoder:
    return PairIndexEncoder.parse(vocabulary)


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: under 1 MB whatever the data, so no worker needs the path."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, id_col: str, text_col: str, path: str, field: str, kind: str, of) -> DataFrame:
    vocabulary = _vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            step = max(1, len(texts) * 1_000_000 // max(1, sum(len(t) for t in texts if t)))
            for at in range(0, len(texts), step):
                ids = encoder.encode_batch(texts[at : at + step])
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + step].to_numpy(), field: [of(x) for x in ids]})

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInPandas(run, f"id {id_type}, {field} {kind}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>) of every row, in one narrow pass: no shuffle, whole texts.

    Null and empty texts give an empty list; special tokens are ordinary text; repeated rows are
    encoded each; other columns of ``df`` are neither read nor returned.
    """
    return _mapped(df, id_col, text_col, vocabulary_path, "ids", "array<int>", list)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id_col, n_tokens int) of every row; 0 for null and empty texts. The ids never leave the worker."""
    return _mapped(df, id_col, text_col, vocabulary_path, "n_tokens", "int", len)
