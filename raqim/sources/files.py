"""Files as sources and sinks."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raqim.functions.text import html_escape
from raqim.operators.documents import json_leaf_text


def _named(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"), path.alias("path"), *[c for c in df.columns])


def read_texts(spark: SparkSession, path: str | list[str], pattern: str = "*.txt") -> DataFrame:
    """(file_name, path, text) of whole UTF-8 files; offsets of code points hold in Spark's functions too."""
    return _named(spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)).withColumnRenamed("value", "text")


def read_json_objects(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(good, bad): (file_name, path, text, object VARIANT) of files that hold JSON, and (file_name, path, text) of the others.

    Folders are read in the order given: ``source_rank``.
    """
    paths = [path] if isinstance(path, str) else path
    rows = None
    for rank, p in enumerate(paths):
        one = read_texts(spark, p, pattern).withColumn("source_rank", F.lit(rank))
        rows = one if rows is None else rows.unionByName(one)
    parsed = rows.withColumn("object", F.try_parse_json("text"))
    return parsed.where("object IS NOT NULL"), parsed.where("object IS NULL").drop("object")


def kind_of(path: Column) -> Column:
    """pdf, json or text by the file's ending, in any case."""
    lower = F.lower(path)
    return F.when(lower.endswith(".pdf"), "pdf").when(lower.endswith(".json"), "json").when(lower.endswith(".txt"), "text")


def read_pdfs(spark: SparkSession, path: str, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(file_name, text) of PDF files by ``ocr``, a function of a file's bytes; without one this raises."""
    if ocr is None:
        raise ValueError("no OCR function given")
    rows = _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path)).select("file_name", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_name": b["file_name"], "text": [ocr(bytes(c)) for c in b["content"]]})

    return rows.mapInPandas(run, "file_name string, text string")


def read_documents(spark: SparkSession, path: str, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(file_name, kind, text) of all text, JSON and PDF files of a folder; of JSON the strings in it, of PDF what ``ocr`` reads."""
    texts = read_texts(spark, path).select("file_name", F.lit("text").alias("kind"), "text")
    objects = json_leaf_text(read_texts(spark, path, "*.json"), "file_name", "text").select("file_name", F.lit("json").alias("kind"), "text")
    out = texts.unionByName(objects)
    return out if ocr is None else out.unionByName(read_pdfs(spark, path, ocr).select("file_name", F.lit("pdf").alias("kind"), "text"))


def ask(df: DataFrame, prompt: Column, model: Callable[[str], str], key: str) -> DataFrame:
    """(``key``, reply): ``model`` is any function from a prompt to a reply, called in the workers."""
    rows = df.select(F.col(key).alias("k"), prompt.alias("prompt"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if p is None else model(p) for p in b.column(1).to_pylist()], pa.string())], ["k", "reply"])

    return rows.mapInArrow(run, f"k {kind}, reply string").withColumnRenamed("k", key)


def recorded(replies: dict[str, str]) -> Callable[[str], str]:
    """A model that knows recorded replies, for tests."""
    return lambda prompt: replies[prompt]


def catalog(out: DataFrame, mentions: DataFrame) -> DataFrame:
    """(base, structure, ner): files of ``out`` with the mention file of the same base name, if there is one."""
    base = lambda suffix: F.regexp_replace("file_name", suffix, "")
    return out.select(base(r"\.json$").alias("base"), F.col("path").alias("structure")).join(mentions.select(base(r"_ner\.json$").alias("base"), F.col("path").alias("ner")), "base", "left")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header; missing values as empty fields."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def html_lines(df: DataFrame) -> DataFrame:
    """(value): each row of a result as a row of an HTML table, without its frame."""
    return df.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns], F.lit("</tr>")).alias("value"))


def to_html(df: DataFrame) -> str:
    """A result as one HTML table, for display; its rows come to the driver, so it is for results and not for tables."""
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    rows = "\n".join(r.value for r in html_lines(df).toLocalIterator())
    return f"<table>\n<tr>{head}</tr>\n{rows}\n</table>"


def to_csv(df: DataFrame) -> str:
    """A result as one CSV string with a header; missing values as empty fields."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return out.getvalue()
