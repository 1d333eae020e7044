"""Passages of held-out evaluation items inside the corpus.

Every item is cut into blocks of ``words // 2`` words; whoever quotes ``words`` words in
a row holds at least one whole block. One Aho-Corasick automaton over all blocks scans
each normalised document once; a hit is extended to both sides, counted in words of the
item, and its offsets are mapped back to the original text. Items that are too many for one
automaton are dealt to several by hash; each scans the corpus for its own.

Normalising leaves letters and digits only: case, accents, vowel marks, stretching
(tatweel), the hamza on alef, the script of digits, punctuation and blanks are gone, so
that other line breaks or spacing do no harm.

Defined cases: null and empty texts and items match nothing; items with fewer words than
asked for cannot leak; items with the same passage are all reported, and so is each place of a passage met again; repeated documents
each come out; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the items of one automaton; a worker takes about 50 bytes for each.
SHARD_CHARS = 2_000_000

#: Letters written with and without hamza or madda, and digits of other scripts.
_SAME = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ـ": ""} | {chr(0x660 + i): str(i) for i in range(10)} | {chr(0x6F0 + i): str(i) for i in range(10)}
_WORD = re.compile(r"\w+")


class _Fold(dict):
    """Code point to its normal form, found when first met."""

    def __missing__(self, point: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", _SAME.get(chr(point), chr(point)).casefold()):
            c = _SAME.get(c, c)
            if c and unicodedata.category(c[0])[0] in "LN":
                out.append(c)
        self[point] = got = "".join(out)
        return got


FOLD = _Fold()


def fold(text: str) -> str:
    """The letters and digits of ``text`` in their normal form."""
    return text.translate(FOLD)


def words(text: str) -> list[str]:
    """Normalised words, split at blanks and at punctuation, empty ones left out."""
    return [w for x in _WORD.findall(re.sub(r"[̀-ͯـً-ٰٟ­​-‏⁠﻿]", "", unicodedata.normalize("NFKD", text))) if (w := fold(x))]


class Matcher:
    """The automaton over the blocks of all items."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        import ahocorasick

        self.least, self.items = least, []
        self.automaton = ahocorasick.Automaton()
        step = max(least // 2, 1)
        blocks: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            parts = words(text or "")
            if len(parts) < least:
                continue
            ends = np.cumsum([len(p) for p in parts])
            n = len(self.items)
            self.items.append((item_id, "".join(parts), np.concatenate([[0], ends])))
            for a in range(0, len(parts) - step + 1, step):
                at = int(ends[a - 1]) if a else 0
                blocks.setdefault("".join(parts[a : a + step]), []).append((n, at))
        for block, places in blocks.items():
            self.automaton.add_word(block, (len(block), places))
        if blocks:
            self.automaton.make_automaton()
        self.any = bool(blocks)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, words, start, end) of each quotation of each item in ``text``, as long as it runs; offsets in folded text."""
        if not self.any:
            return []
        folded, found, done = fold(text), set(), {}
        for end, (size, places) in self.automaton.iter(folded):
            start = end - size + 1
            for n, at in places:
                item_id, item, ends = self.items[n]
                if done.get((n, start - at), -1) > end:  # within what this alignment was extended to before
                    continue
                a, i = start, at
                while a > 0 and i > 0 and folded[a - 1] == item[i - 1]:
                    a, i = a - 1, i - 1
                b, j = end + 1, at + size
                while b < len(folded) and j < len(item) and folded[b] == item[j]:
                    b, j = b + 1, j + 1
                done[n, start - at] = b
                whole = int(np.searchsorted(ends, j, "right") - 1 - np.searchsorted(ends, i, "left"))
                if whole >= self.least:
                    found.add((item_id, whole, a, b))
        return sorted(found)


def originals(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets in ``text`` of folded ranges [start, end)."""
    sizes = np.cumsum([len(FOLD[ord(c)]) for c in text])
    return [(int(np.searchsorted(sizes, start, "right")), int(np.searchsorted(sizes, end, "left")) + 1) for start, end in ranges]


def find_leaks(df: DataFrame, items: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(``key``, ``item_key``, quoted_words, start_char, end_char): a row per quotation of an item in a document.

    ``items`` is the evaluation set. Each automaton holds items of about ``shard_chars``
    characters, the only ones the driver holds at a time; the corpus is scanned once for
    each, without an exchange.
    """
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    shards = max(1, -(-size // shard_chars))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    kind, item_kind = rows.schema["k"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    kept = items.select(item_key, item_text).where(F.col(item_text).isNotNull())

    def scan(shard: int) -> DataFrame:
        held = [tuple(r) for r in kept.where(F.pmod(F.xxhash64(item_key), F.lit(shards)) == shard).collect()]
        shared = df.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, least)
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if hits := matcher.find(t):
                        at += [i] * len(hits)
                        found += [(h[0], h[1], *o) for h, o in zip(hits, originals(t, [h[2:] for h in hits]))]
                columns = list(zip(*found)) or [()] * 4
                yield pa.record_batch(
                    [b.column(0).take(pa.array(at, pa.int32())), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[1:]]],
                    ["k", "i", "quoted_words", "start_char", "end_char"],
                )

        return rows.mapInArrow(run, f"k {kind}, i long, quoted_words int, start_char int, end_char int")

    out = reduce(DataFrame.unionByName, map(scan, range(shards)))
    return out.withColumn("i", F.col("i").cast(item_kind)).withColumnsRenamed({"k": key, "i": item_key})
