"""Queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raqim.llm.confusables import changed_values, unify
from raqim.llm.layout_duplicates import distinct_records, layout_groups
from raqim.llm.leaks import find_leaks
from raqim.llm.moderation import severity
from raqim.llm.names import link_names, linked_pairs
from raqim.llm.scans import repair
from raqim.llm.splitting import split_texts
from raqim.llm.survivors import article_number, best_version
from raqim.llm.tokens import encode, read_ranks
from raqim.sources.tables import table


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer ``name`` is installed; ``spark.raqim.tokenizers`` may name another folder."""
    spark = SparkSession.getActiveSession()
    folder = spark and spark.conf.get("spark.raqim.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    found = importlib.util.find_spec("public_tokenizers")
    return f"{found.submodule_search_locations[0] if found else '/opt/tokenizers'}/{name}"


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    members, _ = layout_groups(table(spark, directory, "articles", "article_id", "number", "text"))
    return members.where("article_id <> first_id").select("first_id", "article_id")


def p1_groups(spark: SparkSession, directory: str) -> DataFrame:
    """One row per distinct article with its number of copies."""
    _, groups = layout_groups(table(spark, directory, "articles", "article_id", "number", "text"))
    return groups


def p1_records(spark: SparkSession, directory: str) -> DataFrame:
    """Every article once, with its number of copies; those too short to be compared, too."""
    return distinct_records(table(spark, directory, "articles", "article_id", "number", "text"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    noise, _ = repair(table(spark, directory, "articles", "article_id", "text"))
    return noise.select("article_id", "noise")


def p2_repaired(spark: SparkSession, directory: str) -> DataFrame:
    """Every article as continuous paragraphs."""
    _, repaired = repair(table(spark, directory, "articles", "article_id", "text"))
    return repaired


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return changed_values(table(spark, directory, "entities", "entity_id", "text", "normalized"), ("text", "normalized"))


def p3_unified(spark: SparkSession, directory: str) -> DataFrame:
    """Every mention in its one form."""
    return unify(table(spark, directory, "entities", "entity_id", "text", "normalized"), ("text", "normalized")).select("entity_id", "text", "normalized")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    pieces = split_texts(table(spark, directory, "articles", "article_id", "text"))
    cut = pieces.where("pieces > 1 AND piece = 0").select("article_id")
    articles = table(spark, directory, "articles", "article_id", "document_id")
    documents = table(spark, directory, "documents", "doc_id", "file_name")
    return cut.join(articles, "article_id").join(documents, F.col("document_id") == F.col("doc_id"), "left").select("file_name", "article_id")


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """All pieces of all articles."""
    return split_texts(table(spark, directory, "articles", "article_id", "text"))


PERSONS = ("PERSON", "JUDGE", "LAWYER", "COURT_CLERK")


def _linked(spark: SparkSession, directory: str) -> DataFrame:
    return link_names(table(spark, directory, "entities", "global_id", "type", "text", "normalized"), PERSONS, ("AGENCY",))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return linked_pairs(_linked(spark, directory))


def p5_entities(spark: SparkSession, directory: str) -> DataFrame:
    """Every id with the entity that it means."""
    return _linked(spark, directory)


def _versions(spark: SparkSession, directory: str, policy: str) -> DataFrame:
    articles = table(spark, directory, "articles", "article_id", "document_id", "number", "text", "import_source", "imported_at")
    sources = table(spark, directory, "import_sources", "source_name", "trust_rank")
    # the list of sources is a dimension of a few rows; Spark broadcasts it by its size
    ranked = articles.join(sources, F.col("import_source") == F.col("source_name"), "left")
    return best_version(ranked, {"document_id": F.col("document_id"), "number": article_number(F.col("number"))}, order=(F.col("trust_rank"), -F.unix_micros(F.col("imported_at").cast("timestamp"))), policy=policy)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return _versions(spark, directory, "trust").select("document_id", "number", "article_id")


def p7_consensus(spark: SparkSession, directory: str) -> DataFrame:
    """The version nearest what most copies agree on, whatever their source."""
    return _versions(spark, directory, "votes")


def p7_survivors(spark: SparkSession, directory: str) -> DataFrame:
    """One row per article with several rows: the best text by trust, and the spelling of its number that most rows agree on."""
    articles = table(spark, directory, "articles", "article_id", "document_id", "number")
    group = {"document_id": F.col("document_id"), "number": article_number(F.col("number"))}
    spelled = best_version(articles.withColumn("spelled", F.col("number")), group, text="spelled", policy="votes", fit=lambda c: c.isNotNull())
    texts = _versions(spark, directory, "trust")
    return texts.join(spelled.select("document_id", "number", "spelled"), ["document_id", "number"]).select("document_id", "number", "spelled", "article_id", "text", "versions")


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode(table(spark, directory, "documents", "doc_id", "text"), read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    leaks = find_leaks(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "eval_items", "item_id", "text"))
    return leaks.select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, directory: str) -> DataFrame:
    """Every quotation of each item in each document, by code points of the original."""
    return find_leaks(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "eval_items", "item_id", "text"))


#: Expected severity from which a document counts as abusive; the scale ends at 2.
ABUSIVE = 1.0


def _severity(spark: SparkSession, directory: str) -> DataFrame:
    return severity(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "moderation_labels", "doc_id", "abusive"))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return _severity(spark, directory).where(F.col("severity") >= ABUSIVE).select("doc_id").distinct()


def p10_scores(spark: SparkSession, directory: str) -> DataFrame:
    return _severity(spark, directory)


def p10_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Documents, abusive ones and mean severity of each source."""
    scored = _severity(spark, directory).withColumnRenamed("doc_id", "k")
    # scored keeps one row per document, so that the sources are read beside it by key
    documents = table(spark, directory, "documents", "doc_id", "source")
    return (
        documents.join(scored, F.col("doc_id") == F.col("k"))
        .groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("severity") >= ABUSIVE).alias("abusive"), F.avg("severity").alias("mean_severity"))
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_unified": p3_unified,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p7_found": p7_found,
    "p7_consensus": p7_consensus,
    "p7_survivors": p7_survivors,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
