"""Cutting oversized texts at natural boundaries, with an overlap between pieces.

Recursive bisection: a text longer than the limit less the overlap is cut at the
strongest boundary near its middle, each half that is still too long is cut again, and
each piece but the first then gets the end of the text before it.

Defined cases: null and empty texts give one piece, the text itself, as does every text
of at most ``limit`` code points; a text without any boundary is cut by length, never
inside a letter and its marks if there is another place; repeated rows each give pieces.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest on; a cut comes after the match.
BOUNDARIES = tuple(map(re.compile, (r"\n\s*\n\s*", r"\n\s*", r"[.!?؟۔…][»\"')\]]*\s+", r"[;:؛،,]\s+", r"\s+")))


def cuts(text: str, limit: int) -> list[int]:
    """Ends of the pieces of ``text``, each of at most ``limit`` code points."""
    places = [sorted({m.end() for m in b.finditer(text)}) for b in BOUNDARIES]
    ends, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit:
            ends.append(b)
            continue
        at = _cut(text, places, a, b)
        todo += [(at, b), (a, at)]
    return ends


def _cut(text: str, places: list[list[int]], a: int, b: int) -> int:
    middle = (a + b) // 2
    for reach in ((b - a) // 4, (b - a) // 2):  # near the middle first, then anywhere
        for ends in places:
            i = bisect.bisect_left(ends, middle)
            near = [x for x in ends[max(i - 1, 0) : i + 1] if a < x < b and abs(x - middle) <= reach]
            if near:
                return min(near, key=lambda x: abs(x - middle))
    at = middle
    while at > a + 1 and _joined(text[at]):
        at -= 1
    return at if at > a + 1 else middle


def _joined(c: str) -> bool:
    return unicodedata.combining(c) > 0 or c in "\u200d\ufe0f"


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``; each starts with about ``overlap`` code points of the one before."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = cuts(text, limit - overlap)
    out = [(0, ends[0])]
    for a, b in zip(ends, ends[1:]):
        start = max(a - overlap, 0)
        word = text.find(" ", start, start + overlap // 4)
        out.append((word + 1 if word >= 0 and start else start, b))
    return out


def split_texts(df: DataFrame, key: str = "article_id", text: str = "text", limit: int = 3000, overlap: int = 200) -> DataFrame:
    """(``key``, piece, pieces, start, piece_text) of every row; ``start`` counts code points from 0.

    Only texts over the limit reach Python; the others stay in the JVM. No exchange.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    long = F.coalesce(F.length("t") > limit, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                spans = pieces(t, limit, overlap)
                n = len(spans)
                yield pa.record_batch(
                    [pa.array([k.as_py()] * n, b.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([s for s, _ in spans], pa.int32()), pa.array([t[s:e] for s, e in spans], pa.string())],
                    ["k", "piece", "pieces", "start", "piece_text"],
                )

    cut = rows.where(long).mapInArrow(run, f"k {kind}, piece int, pieces int, start int, piece_text string")
    whole = rows.where(~long).select("k", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.col("t").alias("piece_text"))
    return cut.unionByName(whole).withColumnRenamed("k", key)
