"""Pairs of short strings within one edit, by pigeonhole segments.

Each value is cut into three segments. One edit, a swap of neighbours included, spoils at
most two of them, so the third stands in the other value, shifted by one place at most: an
inverted index on segments finds every pair, and banded edit distance verifies it. Segments
that many values share are split by what stands beside them, so that no key joins many with many.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raqim.operators.lineage import cut

SEGMENTS = 3
#: Values that may share a segment before it is split.
HOT = 200


def within(a: str, b: str, k: int = 1) -> bool:
    """True if ``a`` becomes ``b`` by ``k`` insertions, deletions, changes or swaps of neighbours; only a band of 2k+1 is computed."""
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    older: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                new[j] = i
                continue
            cost = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, older.get(j - 2, far) + 1)
            new[j] = min(cost, far)
        if min(new.values()) > k:
            return False
        older, row = row, new
    return row.get(len(b), far) <= k


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("value", "other"))
        yield b.filter(pa.array([within(x, y) for x, y in zip(left, right)], pa.bool_()))


def _segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., other, n, seg, part, rest): the segments of each value, and what stands beside them."""
    held = ", ".join(f"named_struct('seg', {i}, 'part', substring(other, {_at('n', i)} + 1, {_at('n', i + 1)} - {_at('n', i)}), 'rest', concat(substring(other, 1, {_at('n', i)}), '\t', substring(other, {_at('n', i + 1)} + 1)))" for i in range(SEGMENTS))
    return df.withColumn("n", F.length("other")).selectExpr(*keys, "other", "n", f"inline(array({held}))")


def _probes(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same columns for what a value may share: lengths of the other from one less to one more, places from one before to one after."""
    held = ", ".join(
        f"named_struct('n', n + {d}, 'seg', {i}, 'part', substring(value, {start} + 1, {size}), 'rest', concat(substring(value, 1, {start}), '\t', substring(value, {start} + {size} + 1)))"
        for d in (-1, 0, 1) for i in range(SEGMENTS) for s in (-1, 0, 1)
        for start, size in [(f"greatest({_at(f'(n + {d})', i)} + {s}, 0)", f"({_at(f'(n + {d})', i + 1)} - {_at(f'(n + {d})', i)})")]
    )
    return df.withColumn("n", F.length("value")).selectExpr(*keys, "value", f"inline(array({held}))").distinct()


def _at(n: str, i: int) -> str:
    return f"(({n} * {i}) div {SEGMENTS})"


def _spoilt(df: DataFrame) -> DataFrame:
    """Each row under its ``rest`` and every form of that with one letter left out; two rests within one edit share one."""
    forms = F.expr("concat(array(xxhash64(rest)), transform(sequence(1, length(rest)), i -> xxhash64(concat(substring(rest, 1, i - 1), substring(rest, i + 1)))))")
    return df.withColumn("form", F.explode_outer(F.array_distinct(forms))).drop("rest")


def similar_pairs(df: DataFrame, scope: tuple[str, ...], value: str, least: int = 4, index: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(scope.., value, other), value < other, of all pairs of different values of one scope within one edit.

    With ``index`` the other values are those of its column ``value`` and may be smaller too.
    Values shorter than ``least`` take no part. Nulls match nothing. A segment that more than
    ``hot`` values share is no evidence by itself: there what stands beside it must be within
    one edit too, which is again a join on equal keys (each form with a letter left out).
    The pairs are written to the shared folder, which keeps the plans of their users small.
    """
    keys = list(scope)
    rows = df.select(*keys, F.col(value).alias("value")).where(F.length("value") >= least).distinct()
    other = (rows if index is None else index.select(*keys, "value").where(F.length("value") >= least).distinct()).withColumnRenamed("value", "other")
    index_rows, probe = _segments(other, keys), _probes(rows, keys)
    at = [*keys, "n", "seg", "part"]
    shared = cut(index_rows.groupBy(*at).agg(F.count("*").alias("held")).where(F.col("held") > hot).select(*at))
    proper = F.col("value") < F.col("other") if index is None else F.col("value") != F.col("other")
    if shared.isEmpty():
        found = probe.join(index_rows.drop("rest"), at).where(proper).select(*keys, "value", "other").distinct()
    else:
        few = probe.join(shared, at, "left_anti").join(index_rows.drop("rest"), at)
        many = _spoilt(probe.join(shared, at, "left_semi")).join(_spoilt(index_rows.join(shared, at, "left_semi")), [*at, "form"])
        found = few.select(*keys, "value", "other").unionByName(many.select(*keys, "value", "other")).where(proper).distinct()
    return cut(found.mapInArrow(_verify, found.schema))
