"""Encoding whole texts by a public byte-level BPE tokenizer, without special tokens.

Per Arrow batch the texts are cut into pre-tokens, and the distinct new ones are merged
together: an index maps each pair of neighbouring tokens to all its positions, the
active ranks are taken in ascending order, and each merge updates the lists of the pairs
it makes and breaks. Ids then follow by array indexing.

Defined cases: a null text gives null ids, an empty text an empty list; strings of
special tokens are ordinary text; every code point, also a lone control character, is
encoded by its UTF-8 bytes, so that ids decode to the very text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pre-token pattern published with the vocabulary (contractions, letters, digits, others, blanks).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept between batches; when there are more the store is emptied, which only costs time.
STORE = 400_000
DONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id, of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class Encoder:
    """Merges of one vocabulary and the pre-tokens encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.ranks, self.bytes = ranks, {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def rank(self, pair: tuple[int, int]) -> int:
        """The rank of the token that ``pair`` makes, -1 if it makes none."""
        got = self.pairs.get(pair)
        if got is None:
            got = self.pairs[pair] = self.ranks.get(self.bytes[pair[0]] + self.bytes[pair[1]], DONE)
        return got

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` one after another, and the number of ids of each."""
        token: list[int] = []
        first = []
        for w in words:
            first.append(len(token))
            token += [self.byte[b] for b in w.encode("utf-8", "surrogatepass")]
        n = len(token)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, b in zip(first, [*first[1:], n]):
            if b > a:
                before[a], follow[b - 1] = -1, -1
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            if (j := follow[i]) >= 0:
                index.setdefault((token[i], token[j]), []).append(i)
        active = [(r, p) for p in index if (r := self.rank(p)) >= 0]
        heapq.heapify(active)
        while active:
            r, pair = heapq.heappop(active)
            left, right = pair
            made: set[tuple[int, int]] = set()
            for i in sorted(index.pop(pair, ())):  # leftmost first, as in "aaa"
                j = follow[i]
                if token[i] != left or j < 0 or token[j] != right:
                    continue
                token[i], token[j] = r, DONE
                h, k = before[i], follow[j]
                follow[i] = k
                if k >= 0:
                    before[k] = i
                    p = (r, token[k])
                    if p not in index:
                        index[p] = []
                        made.add(p)
                    index[p].append(i)
                if h >= 0:
                    p = (token[h], r)
                    if p not in index:
                        index[p] = []
                        made.add(p)
                    index[p].append(h)
            for p in made:
                if (q := self.rank(p)) >= 0:
                    heapq.heappush(active, (q, p))
        ids = np.array(token, np.int32)
        kept = ids != DONE
        sizes = np.add.reduceat(kept, first) if n else np.zeros(len(words), np.int64)
        return ids[kept], sizes.astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after another, and the number of ids of each."""
        if len(self.known) > STORE:
            self.clear()
        known, find = self.known, self.find
        places: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        fresh: list[str] = []
        for i, t in enumerate(texts):
            words = find(t)
            counts[i] = len(words)
            got = [known.get(w, DONE) for w in words]
            if DONE in got:
                for j, w in enumerate(words):
                    if got[j] < 0:
                        at = known.get(w)
                        if at is None:
                            at = known[w] = len(known)
                            fresh.append(w)
                        got[j] = at
            places += got
        if fresh:
            ids, sizes = self.merge(fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        at = np.array(places, np.int64)
        sizes = self.ends[at + 1] - self.ends[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.ends[at] - total[:-1], sizes) + np.arange(total[-1])] if len(at) else np.zeros(0, np.int32)
        ends = total[np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)


def encode(df: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(``key``, ids) of every row; ``ids`` is an ARRAY<INT>.

    ``ranks`` is broadcast: its size is that of the vocabulary file, whatever the data.
    No exchange; a task holds one Arrow batch and the stored pre-tokens.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                texts = b.column(1).to_pylist()
                flat, sizes = encoder.encode([t or "" for t in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([t is None for t in texts]))
                yield pa.record_batch([b.column(0), lists], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
