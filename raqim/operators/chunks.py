"""Cutting texts for a model with a limited context, and the messages around the chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raqim.functions.vocabulary import DEFAULT_LIMITS, MODEL_LIMITS

#: Marks at which a chunk may end, where it holds no line break.
STOPS = ("۔", "؟", ".", "!", ";")


def model_limits(model: Column) -> Column:
    """STRUCT(context, completion) of a model family."""
    made = F.struct(F.lit(DEFAULT_LIMITS[0]).alias("context"), F.lit(DEFAULT_LIMITS[1]).alias("completion"))
    for name, context, completion in reversed(MODEL_LIMITS):
        fits = model == name if name.startswith("gpt-3.5") else model.startswith(name)
        made = F.when(fits, F.struct(F.lit(context).alias("context"), F.lit(completion).alias("completion"))).otherwise(made)
    return made


def char_chunks(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, chunk, offset, chunk_text): windows of ``size`` code points, in the JVM. Empty and null texts give none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)))
    return df.select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk", "offset")).select(key, "chunk", "offset", F.substring("_t", F.col("offset") + 1, F.lit(size)).alias("chunk_text"))


def stop_cuts(text: str, limit: int) -> list[int]:
    """Ends of chunks of at most ``limit`` code points, each after its last line break, else its last stop."""
    ends, at = [], 0
    while at < len(text):
        end = min(at + limit, len(text))
        cut = text.rfind("\n", at, end)
        if cut < 0:
            cut = max(text.rfind(s, at, end) for s in STOPS)
        at = cut + 1 if at <= cut < end - 1 else end
        ends.append(at)
    return ends


def stop_chunks(df: DataFrame, limit: int, overlap: int = 0, key: str = "doc_id", text: str = "text", length: Callable[[str], int] | None = None) -> DataFrame:
    """(``key``, chunk, offset, chunk_text): chunks that end at stops, each with the ``overlap`` code points before it."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    kind = rows.schema["k"].dataType.simpleString()
    step = limit - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                ends = stop_cuts(t, step)
                starts = [max(a - overlap, 0) for a in [0, *ends[:-1]]]
                n = len(ends)
                yield pa.record_batch([pa.array([k.as_py()] * n, b.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array(starts, pa.int32()), pa.array([t[s:e] for s, e in zip(starts, ends)], pa.string())], ["k", "chunk", "offset", "chunk_text"])

    return rows.mapInArrow(run, f"k {kind}, chunk int, offset int, chunk_text string").withColumnRenamed("k", key)


def prefix_for_outline(text: Column, budget: int) -> Column:
    """The first ``budget`` code points, for the call that only asks for an outline."""
    return F.substring(text, 1, budget)


def messages(instructions: str, chunk: Column, end: str, inherited: Column | None = None, system: str = "You are an expert in Moroccan legislation text structuring.") -> Column:
    """The system and user messages of a call, as an array of (role, content)."""
    content = F.concat(F.lit(instructions + "\n"), inherited if inherited is not None else F.lit(""), chunk, F.lit("\n" + end))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def message_cost(given: Column, count: Callable[[Column], Column] = F.length) -> Column:
    """4 for each message and 2 at the end, besides what ``count`` says of roles and contents."""
    return F.aggregate(given, F.lit(2), lambda n, m: n + 4 + count(m["role"]) + count(m["content"]))
