"""Operators on spans of text: containment, offsets, edits. Offsets count code points from 0, -1 is unknown."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outside(inner: DataFrame, outer: DataFrame, key: str = "document_id", overlap: Column | None = None) -> DataFrame:
    """Rows of ``inner`` that no row of ``outer`` of the same document contains.

    ``overlap``: a condition on ``inner`` under which touching is enough. An anti join on
    the document with the range as residual; spans of one document meet in one task.
    """
    o = outer.select(F.col(key).alias("_k"), F.col("start_char").alias("_a"), F.col("end_char").alias("_b")).where("_a >= 0")
    hit = (F.col("_a") <= F.col("start_char")) & (F.col("end_char") <= F.col("_b"))
    if overlap is not None:
        hit = hit | (overlap & (F.col("start_char") < F.col("_b")) & (F.col("_a") < F.col("end_char")))
    return inner.join(o, (F.col(key) == F.col("_k")) & (F.col("start_char") >= 0) & hit, "left_anti")


def articles_outside_dates(entities: DataFrame) -> DataFrame:
    """Entities without the ARTICLE ones inside a DATE."""
    articles = entities.where("type = 'ARTICLE'")
    return outside(articles, entities.where("type = 'DATE'")).unionByName(entities.where("type IS NULL OR type <> 'ARTICLE'"))


def articles_outside_refs(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) without ARTICLE ones inside an INTERNAL_REF, or that touch one and hold several
    numbers, and without relations to or from those."""
    articles = entities.where("type = 'ARTICLE'")
    several = F.size(F.regexp_extract_all("text", F.lit(r"[0-9٠-٩]+"), F.lit(0))) > 1
    kept = outside(articles, entities.where("type = 'INTERNAL_REF'"), overlap=several)
    gone = articles.join(kept.select("document_id", "ent_id"), ["document_id", "ent_id"], "left_anti").select("document_id", F.col("ent_id").alias("_e"))
    for end in ("source_id", "target_id"):
        relations = relations.join(gone.withColumnRenamed("_e", end), ["document_id", end], "left_anti")
    return kept.unionByName(entities.where("type IS NULL OR type <> 'ARTICLE'")), relations


def place_spans(text: str, spans: list[tuple], near: int = 50) -> list[tuple[int, int]]:
    """New offsets of (start, end, word), in order: kept if the word stands there, else its nearest free
    occurrence within ``near``, else the nearest anywhere; unknown and absent ones keep theirs."""
    used: list[tuple[int, int]] = []  # in order; those that stay as they were may overlap
    reach: list[int] = []  # the furthest end of those up to each
    out = []

    def take(a: int, b: int) -> None:
        i = bisect_left(used, (a, b))
        used.insert(i, (a, b))
        reach.insert(i, max(b, reach[i - 1] if i else b))
        for k in range(i + 1, len(reach)):
            if reach[k] >= b:
                break
            reach[k] = b

    for start, end, word in spans:
        if start is None or start < 0 or not word:
            out.append((start, end))
            continue
        # free if none that begins before the end reaches over the start
        free = lambda a: (i := bisect_left(used, (a + len(word), -1))) == 0 or reach[i - 1] <= a
        best = None
        if text[start:end] == word and free(start):
            best = start
        else:
            places, at = [], text.find(word)
            while at >= 0:
                places.append(at)
                at = text.find(word, at + 1)
            places.sort(key=lambda a: (abs(a - start) > near, abs(a - start)))
            best = next((a for a in places if free(a)), None)
        if best is None:
            out.append((start, end))
        else:
            out.append((best, best + len(word)))
        take(*out[-1])
    return out


def find_in_order(text: str, words: list[str | None]) -> list[tuple[int, int]]:
    """Offsets of each word in any case: after the one before, else from the start; (-1, -1) where it is not or is empty."""
    lower, at, out = text.lower(), 0, []
    for word in words:
        place = -1
        if word:
            place = lower.find(word.lower(), at)
            place = lower.find(word.lower()) if place < 0 else place
        if place >= 0:
            at = place + len(word)
        out.append((place, at) if place >= 0 else (-1, -1))
    return out


def load_offsets(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, ord, start_char, end_char) found anew in the texts, in the order of the mentions, then fitted as by ``fix_offsets``."""
    return _by_document(entities, documents, lambda body, spans: place_spans(body, [(a, b, s["text"]) for (a, b), s in zip(find_in_order(body, [s["text"] for s in spans]), spans)]))


def save_texts(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """``entities`` with the texts that stand at their offsets, which are left out; without known offsets the text stays."""
    bodies = documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("_body"))
    known = (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")) & (F.col("end_char") <= F.length("_body"))
    text = F.when(known, F.substring("_body", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).otherwise(F.col("text"))
    return entities.join(bodies, "document_id", "left").withColumn("text", text).drop("_body", "start_char", "end_char")


def fix_offsets(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, ord, start_char, end_char) with offsets that fit the texts."""
    return _by_document(entities, documents, lambda body, spans: place_spans(body, [(s["start_char"], s["end_char"], s["text"]) for s in spans]))


def _by_document(entities: DataFrame, documents: DataFrame, place: Callable[[str, list[dict]], list[tuple[int, int]]]) -> DataFrame:
    """(document_id, ord, start_char, end_char) by ``place``.

    The mentions of a document are one array beside its text, so that only documents with
    mentions reach Python, batch by batch.
    """
    held = entities.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start_char", "end_char", "text"))).alias("spans"))
    rows = held.join(documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")), "document_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for doc, spans, body in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("document_id", "spans", "body"))):
                placed = place(body or "", spans)
                made += [(doc, s["ord"], *p) for s, p in zip(spans, placed)]
            columns = list(zip(*made)) or [()] * 4
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[1:]]], ["document_id", "ord", "start_char", "end_char"])

    return rows.mapInArrow(run, "document_id long, ord int, start_char int, end_char int")


def shift_spans(spans: DataFrame, start: Column, end: Column, replacement: Column) -> DataFrame:
    """Spans after text[start:end] was replaced: later ones move, inner and right-overlapping ones go, a
    span that reaches into the edit from the left ends at ``start``."""
    delta = F.length(replacement) - (end - start)
    a, b = F.col("start_char"), F.col("end_char")
    return (
        spans.withColumn("_s", start)
        .where((b <= start) | (a >= end) | (a < start))
        .withColumn("end_char", F.when(a >= end, b + delta).when((a < F.col("_s")) & (b > F.col("_s")), F.col("_s")).otherwise(b))
        .withColumn("start_char", F.when(a >= end, a + delta).otherwise(a))
        .drop("_s")
    )


def replace_text(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), replacement, F.substring(text, end + 1, F.length(text)))


def next_id(ids: Column) -> Column:
    """One more than the greatest number at the end of an id; an aggregate."""
    return F.coalesce(F.max(F.nullif(F.regexp_extract(ids, r"(\d+)$", 1), F.lit("")).cast("bigint")), F.lit(0)) + 1


def add_span(spans: DataFrame, doc: int, start: int, end: int, kind: str, text: DataFrame, normalized: str | None = None) -> DataFrame:
    """``spans`` with one more of a document; an invalid range adds nothing."""
    ids = spans.where(F.col("document_id") == doc).agg(next_id(F.col("id")).cast("string").alias("id"))
    new = text.where(F.col("document_id") == doc).where((F.lit(start) >= 0) & (F.lit(start) < end) & (F.lit(end) <= F.length("text")))
    new = new.withColumn("id", F.lit(ids.first()[0])).select("document_id", "id", F.lit(kind).alias("type"), F.expr(f"substring(text, {start} + 1, {end} - {start})").alias("text"), F.lit(start).alias("start_char"), F.lit(end).alias("end_char"), F.lit(normalized).cast("string").alias("normalized"))
    return spans.unionByName(new)


def delete_span(spans: DataFrame, doc: int, span_id: str) -> DataFrame:
    return spans.where(~((F.col("document_id") == doc) & (F.col("id") == span_id)))


def update_span(spans: DataFrame, doc: int, span_id: str, **fields: object) -> DataFrame:
    """``spans`` with fields of one changed; raises if there is no such span."""
    here = (F.col("document_id") == doc) & (F.col("id") == span_id)
    if spans.where(here).isEmpty():
        raise KeyError(f"no span {span_id} in document {doc}")
    return spans.select(*[F.when(here, F.lit(fields[c])).otherwise(F.col(c)).cast(t).alias(c) if c in fields else F.col(c) for c, t in spans.dtypes])
