"""Whole structured documents: leaf texts of JSON, sections, final forms of nodes, chunk results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raqim.functions.numbers import clean_number
from raqim.functions.text import canonical_type, clean_text
from raqim.functions.markers import insert_brackets
from raqim.operators.nested import Number, record, written


def leaf_text(value: object) -> str:
    """All strings of a JSON value, depth first in the order written, joined by line breaks; empty ones left out."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x and not isinstance(x, Number):
                out.append(x)
        elif isinstance(x, dict):
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return "\n".join(out)


def change_strings(value: object, change: Callable[[str], str]) -> object:
    """A JSON value of any depth with every string but the keys and the numbers changed, in a copy."""
    top = [value]
    todo: list[tuple[list | dict, object]] = [(top, 0)]
    while todo:
        held, at = todo.pop()
        x = held[at]
        if isinstance(x, str) and not isinstance(x, Number):
            held[at] = change(x)
        elif isinstance(x, (dict, list)):
            held[at] = x = x.copy()
            todo += [(x, k) for k in (x if isinstance(x, dict) else range(len(x)))]
    return top[0]


def json_leaf_text(df: DataFrame, key: str = "record_id", json_col: str = "payload") -> DataFrame:
    """(``key``, text) of JSON objects; the order of keys matters, so the raw text is read. Broken or null JSON gives NULL."""
    rows = df.select(F.col(key).alias("k"), F.col(json_col).alias("j"))
    kind = rows.schema["k"].dataType.simpleString()

    def one(text: str | None) -> str | None:
        try:
            return leaf_text(record(text))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(map(one, b.column(1).to_pylist()), pa.string())], ["k", "text"])

    return rows.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def annotate_records(records: DataFrame, entities: DataFrame, key: str = "document_id", json_col: str = "payload") -> DataFrame:
    """``records`` with markers around the texts of their document's entities in every string of the JSON, as JSON text.

    entities (``key``, ord, ent_id, text). Keys of objects and numbers stay; records that
    hold no object stay as they are. The entities of a document are one array beside each of
    its records.
    """
    span = F.struct("ord", F.col("text").alias("text"), F.col("ent_id").alias("id"))
    held = entities.where("text <> '' AND ent_id IS NOT NULL").groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(span)).alias("_held"))
    rows = records.join(held, F.col(key) == F.col("_k"), "left").drop("_k")
    kept = [c for c in records.columns if c != json_col]
    rows = rows.select(*kept, F.col(json_col).alias("_json"), "_held")

    def one(text: str | None, spans: list[dict] | None) -> str | None:
        try:
            return written(change_strings(record(text), lambda s: insert_brackets(s, spans)))
        except ValueError:
            return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(t, h) for t, h in zip(b.column("_json").to_pylist(), b.column("_held").to_pylist())]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(made, pa.string())], [*kept, json_col])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"`{json_col}` string"])
    return rows.mapInArrow(run, schema).select(*records.columns)


def finalize_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with canonical type, clean number (of known types) and clean text; empty texts become NULL."""
    kind = canonical_type(F.col("type"), only_known=False)
    known = kind.isin("قسم", "باب", "جزء", "فصل", "فرع", "مادة")
    return nodes.withColumn("number", F.when(known, clean_number(F.col("number"))).otherwise(F.col("number"))).withColumn("text", F.nullif(clean_text(F.col("text")), F.lit(""))).withColumn("type", kind)


def find_nodes(nodes: DataFrame) -> DataFrame:
    """(doc, type, number, pos): the first node of each type and number in document order."""
    return nodes.where("number IS NOT NULL").groupBy("doc", "type", "number").agg(F.min("pos").alias("pos"))


def merge_chunk_texts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with the texts that chunks gave for the same type and number appended in chunk order.

    Only the first node of a type and number takes the texts; those of nodes that are not in
    the tree are left out, as are nodes of a chunk without a number.
    """
    texts = F.array_sort(F.collect_list(F.struct("chunk", "pos", "text")))
    more = found.where("number IS NOT NULL AND coalesce(text, '') <> ''").groupBy("doc", "type", "number").agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("_more"))
    target = find_nodes(nodes).join(more, ["doc", "type", "number"]).select("doc", "pos", "_more")
    joined = F.concat_ws("\n", F.nullif(F.col("text"), F.lit("")), "_more")
    return nodes.join(target, ["doc", "pos"], "left").withColumn("text", F.when(F.col("_more").isNull(), F.col("text")).otherwise(joined)).drop("_more")


def sections(df: DataFrame, key: str, names: tuple[str, ...] = ("facts", "arguments", "legal_reasons", "decision")) -> DataFrame:
    """(``key``, section, idx, text) of arrays of sentences, one column each; NULL arrays give nothing."""
    held = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("texts")) for n in names]))
    return df.select(key, held.alias("s")).select(key, "s.section", F.posexplode("s.texts").alias("idx", "text"))


def add_entry(section: Column, text: Column) -> Column:
    return F.array_append(F.coalesce(section, F.array().cast("array<string>")), text)


def delete_entry(section: Column, at: int) -> Column:
    """Without the entry at ``at``; other places delete nothing."""
    return F.filter(section, lambda _, i: i != at)


def without_blank_tables(tables: Column) -> Column:
    """Tables (array of struct with rows of columns) that hold some text."""
    return F.filter(tables, lambda t: F.exists(t["rows"], lambda r: F.exists(r["columns"], lambda c: F.coalesce(F.trim(c), F.lit("")) != "")))
