"""The four tables of the store: creation, append, upsert with replaced children, counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raqim.functions.numbers import canonical_num
from raqim.functions.text import first_filled, referenced_law, titled_law_number

#: Columns of the tables; ids of documents are hashes of file names, stable over incremental loads.
TABLES = {
    "documents": "document_id BIGINT, file_name STRING, short_title STRING, official_title STRING, doc_type STRING, doc_number STRING, law_number STRING, source_rank INT",
    "articles": "document_id BIGINT, pos INT, number STRING, text STRING",
    "entities": "document_id BIGINT, ord INT, ent_id STRING, type STRING, text STRING, start_char INT, end_char INT, normalized STRING, canonical_num STRING, global_id STRING",
    "relations": "document_id BIGINT, ord INT, relation_id STRING, type STRING, source_id STRING, target_id STRING",
}
ARTICLE_TYPES = ("الفصل", "مادة")


def init_store(spark: SparkSession, folder: str, overwrite: bool = False) -> None:
    """Empty tables in ``folder``; those that are there stay unless ``overwrite``."""
    for name, schema in TABLES.items():
        mode = "overwrite" if overwrite else "ignore"
        spark.createDataFrame([], schema).write.mode(mode).parquet(os.path.join(folder, name))


def append(df: DataFrame, folder: str, name: str) -> None:
    df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("append").parquet(os.path.join(folder, name))


def upsert(current: DataFrame, batch: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``current`` with the rows of ``batch``; of equal keys the last of the batch wins, then the current one.

    The last row per key is an aggregate that combines before the exchange, so a key that
    comes in again and again is no hot partition.
    """
    names = [c for c in current.columns if c not in key]
    newest = batch.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row")).select(*key, "_row.*")
    return current.join(newest, list(key), "left_anti").select(*current.columns).unionByName(newest.select(*current.columns))


def replace_children(current: DataFrame, batch: DataFrame, touched: DataFrame, key: str = "document_id") -> DataFrame:
    """``current`` without the rows of the touched documents, and with those of ``batch``."""
    return current.join(touched.select(key).distinct(), key, "left_anti").unionByName(batch.select(*current.columns))


def articles_of(nodes: DataFrame, types: tuple[str, ...] = ARTICLE_TYPES) -> DataFrame:
    """(doc, pos, number, text) of article nodes with a number and a text."""
    rows = nodes.select("doc", "pos", "type", canonical_num(F.col("number")).alias("number"), "text")
    return rows.where(F.col("type").isin(*types) & F.col("number").isNotNull() & (F.coalesce("text", F.lit("")) != "")).drop("type")


def raw_articles_of(nodes: DataFrame, types: tuple[str, ...] = ("ARTICLE", "الفصل", "مادة")) -> DataFrame:
    """The same for the other importer: the number as written, or the normal form, or the title; empty texts stay."""
    named = [F.col(c) for c in ("number", "normalized", "title") if c in nodes.columns]
    return nodes.where(F.col("type").isin(*types)).select("doc", "pos", first_filled(*named).alias("number"), F.coalesce("text", F.lit("")).alias("text"))


def document_rows(files: DataFrame) -> DataFrame:
    """Rows of ``documents`` from (file_name, short_title, official_title, doc_type, doc_number, source_rank).

    The law number stands in ``law_number`` or a title, else in the first of ``references`` to a law; both columns may be missing.
    """
    title = first_filled(F.col("short_title"), F.col("official_title"), F.col("file_name"))
    told = [F.col("law_number")] if "law_number" in files.columns else []
    law = titled_law_number(*told, F.col("official_title"), F.col("short_title"), F.col("file_name"))
    if "references" in files.columns:
        law = F.coalesce(law, referenced_law(F.col("references")))
    return files.select(F.xxhash64("file_name").alias("document_id"), "file_name", title.alias("short_title"), "official_title", "doc_type", "doc_number", law.alias("law_number"), "source_rank")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table, n) of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def overlay(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``base`` with the values of ``edits`` where those are there, and rows of either."""
    names = [c for c in base.columns if c != key]
    b, e = base.alias("b"), edits.alias("e")
    return b.join(e, key, "full_outer").select(key, *[F.coalesce(F.col(f"e.{c}"), F.col(f"b.{c}")).alias(c) for c in names])


def last_versions(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key, ties broken by the remaining columns of ``order``."""
    place = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
