"""Resolution of references between documents, for whole tables of requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raqim.functions.numbers import canonical_num
from raqim.functions.text import first_filled, law_aliases
from raqim.operators.graph import law_neighbours, nodes_of
from raqim.operators.lineage import cut


def article_hits(requests: DataFrame, documents: DataFrame, articles: DataFrame, limit: int = 5) -> DataFrame:
    """Articles by number: those of the one document with the asked law number first, then all others with
    the number, each (document, number) once; up to ``limit`` of the second sort are added while there are
    fewer than ``limit`` of the first.

    requests (req_id, law, article); documents (doc_id, doc_number, short_title); articles
    (document_id, article_id, number, text). Returns (req_id, place, doc_id, article_id, stage).
    """
    asked = requests.select("req_id", "law", canonical_num(F.col("article")).alias("number")).where("number IS NOT NULL")
    found = articles.select("document_id", "article_id", canonical_num(F.col("number")).alias("number")).where("number IS NOT NULL")
    one = documents.where("doc_number IS NOT NULL").groupBy(F.col("doc_number").alias("law")).agg(F.min("doc_id").alias("law_doc"))
    asked = asked.join(one, "law", "left")
    first = asked.join(found, (asked["number"] == found["number"]) & (asked["law_doc"] == found["document_id"])).select("req_id", "document_id", "article_id", F.lit(1).alias("stage"), F.lit(None).cast("string").alias("doc_number"))
    titled = documents.select(F.col("doc_id").alias("document_id"), "doc_number")
    # a number is asked for by many requests; the ranking is done once a number, not once a request
    ranked = found.join(titled, "document_id").withColumn("r", F.row_number().over(Window.partitionBy("number").orderBy(F.col("doc_number").asc_nulls_last(), "document_id", "article_id")))
    second = asked.join(ranked.where(F.col("r") <= 2 * limit), "number").select("req_id", "document_id", "article_id", F.lit(2).alias("stage"), "doc_number")
    per = Window.partitionBy("req_id")
    order = per.orderBy("stage", F.col("doc_number").asc_nulls_last(), "document_id", "article_id")
    both = first.unionByName(second).withColumn("again", F.row_number().over(Window.partitionBy("req_id", "document_id").orderBy("stage", "article_id")))
    both = both.where("again = 1").withColumn("n", F.row_number().over(order)).withColumn("n1", F.count_if(F.col("stage") == 1).over(per))
    return both.where((F.col("stage") == 1) & (F.col("n") <= limit) | (F.col("stage") == 2) & (F.col("n1") < limit) & (F.col("n") - F.col("n1") <= limit)).select("req_id", F.col("n").alias("place"), F.col("document_id").alias("doc_id"), "article_id", "stage")


def article_cascade(requests: DataFrame, documents: DataFrame, articles: DataFrame, limit: int = 5) -> DataFrame:
    """The first stage that finds anything: law number, law in a title or file name, one of the law's names in either, number alone.

    Names are those in ``names`` (an array of STRING) of the requests, if they have that
    column; case does not matter. Each stage only sees the requests that the ones before
    left over. The first is an equal join on number and law. Where something is looked for
    inside titles, distinct words looked for meet distinct titles that share a run of three
    characters with them, the articles are joined after. The last meets the best ``limit``
    articles of a number, ranked once a number and not once a request.
    """
    named = F.col("names") if "names" in requests.columns else F.lit(None).cast("array<string>")
    asked = requests.select("req_id", "law", canonical_num(F.col("article")).alias("number"), named.alias("names")).where("number IS NOT NULL")
    held = documents.select(F.col("doc_id").alias("document_id"), "doc_number", "law_number", "short_title", "file_name")
    found = articles.select("document_id", "article_id", canonical_num(F.col("number")).alias("number")).where("number IS NOT NULL").join(held, "document_id")
    columns = ["req_id", "document_id", "article_id", "doc_number"]
    keyed = found.withColumn("law", F.explode(F.array_distinct(F.array("doc_number", "law_number")))).where("law IS NOT NULL")
    first = asked.join(keyed, ["number", "law"]).select(*columns, F.lit(1).alias("stage"))
    # each stage is read for its hits and for what it leaves over: written once
    first = cut(first)
    left = cut(asked.join(first.select("req_id"), "req_id", "left_anti"))
    titles = held.select(F.explode(F.array("short_title", "file_name")).alias("title"), "document_id").where("title IS NOT NULL")
    second = _inside(left.where("law IS NOT NULL").select("req_id", "number", F.col("law").alias("part")), titles, found).select(*columns, F.lit(2).alias("stage"))
    second = cut(second)
    left = left.join(second.select("req_id"), "req_id", "left_anti")
    hits = first.unionByName(second)
    if "names" in requests.columns:
        lower = titles.select(F.lower("title").alias("title"), "document_id")
        third = _inside(left.select("req_id", "number", F.explode("names").alias("part")).where("part IS NOT NULL"), lower, found).select(*columns, F.lit(3).alias("stage"))
        left = left.join(third.select("req_id"), "req_id", "left_anti")
        hits = hits.unionByName(third)
    by_number = Window.partitionBy("number").orderBy(F.col("doc_number").asc_nulls_last(), "document_id", "article_id")
    best = found.withColumn("r", F.row_number().over(by_number)).where(F.col("r") <= limit)
    last = left.join(best, "number").select(*columns, F.lit(4).alias("stage"))
    order = Window.partitionBy("req_id").orderBy(F.col("doc_number").asc_nulls_last(), "document_id", "article_id")
    placed = hits.unionByName(last).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return placed.select("req_id", "place", F.col("document_id").alias("doc_id"), "article_id", "stage")


def _inside(asked: DataFrame, titles: DataFrame, found: DataFrame) -> DataFrame:
    """``asked`` (req_id, number, part) with the articles of that number in documents one of whose titles holds ``part``.

    Parts of three characters or more meet titles on their first three; shorter ones, of
    which there are few, on all runs of their own length. Parts that are '' are in every title.
    """
    parts, kinds = asked.select("part").distinct(), titles.select("title").distinct()
    runs = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("title") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("title"), i, F.lit(n))))
    grams = kinds.select("title", F.explode_outer(F.concat(runs(3), runs(2), runs(1), F.array(F.lit("")))).alias("run"))
    met = parts.withColumn("run", F.left("part", F.lit(3))).join(grams, "run").where(F.col("title").contains(F.col("part"))).select("part", "title")
    documents = met.join(titles, "title").select("part", "document_id").distinct()
    return asked.join(documents, "part").join(found, ["document_id", "number"]).drop("part").distinct()


def documents_with(documents: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, file_name, short_title) of the documents that hold one of ``entities``, each once, the first ``limit``."""
    hits = documents.join(entities.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
    return hits.select("doc_id", "file_name", "short_title").orderBy("doc_id").limit(limit)


def law_articles(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """(law, number, text): the last text of each article under its document number, and under its law number,
    or without one the law numbers in its title, where no document has that as its own."""
    texts = articles.select("document_id", canonical_num(F.col("number")).alias("number"), "pos", "article_id", "text").where("number IS NOT NULL AND text <> ''")
    title = F.col("official_title") if "official_title" in documents.columns else F.lit(None).cast("string")
    law = canonical_num(F.col("law_number"))
    aliases = F.when(law.isNotNull(), F.array(law)).otherwise(law_aliases(title))
    keys = documents.select(F.col("doc_id").alias("document_id"), canonical_num(F.col("doc_number")).alias("own"), F.explode_outer(aliases).alias("alias")).where("own IS NOT NULL")
    best = lambda law: texts.join(keys.where(F.col(law).isNotNull()).select("document_id", law).distinct(), "document_id").groupBy(F.col(law).alias("law"), "number").agg(F.max_by("text", F.struct("document_id", "pos", "article_id")).alias("text"))
    own = best("own")
    other = best("alias").join(keys.select(F.col("own").alias("law")).distinct(), "law", "left_anti")
    return own.unionByName(other)


def attach_mentions(files: DataFrame, mentions: DataFrame) -> DataFrame:
    """``mentions`` files (name, ..) with the ``doc_id`` of the file whose name they carry with ``_ner`` before the suffix."""
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    return mentions.withColumn("_base", F.regexp_replace(base("name"), "_ner$", "")).join(files.select(base("file_name").alias("_base"), "doc_id"), "_base").drop("_base")


def article_popups(entities: DataFrame, relations: DataFrame, laws: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, ent_id, popup): what a reader sees on an ARTICLE or INTERNAL_REF.

    The text of an article is that of the document itself (``texts``: document_id, number,
    text), else that of a law it is related to, in order of the relations (``laws`` as
    ``law_articles`` gives them), else of the first law in order that has the number. An
    INTERNAL_REF shows the articles it refers to, one after the other.
    """
    nodes = nodes_of(entities)
    articles = nodes.where("type = 'ARTICLE'").select("document_id", "ent_id", canonical_num(first_filled(F.col("normalized"), F.col("text"))).alias("number")).where("number IS NOT NULL")
    own = texts.select("document_id", canonical_num(F.col("number")).alias("number"), F.col("text").alias("own")).where("number IS NOT NULL AND own <> ''").groupBy("document_id", "number").agg(F.max("own").alias("own"))
    near = law_neighbours(entities, relations).select("document_id", "ent_id", F.posexplode(F.split("laws", ",")).alias("at", "law"))
    related = articles.join(near, ["document_id", "ent_id"]).join(laws, ["law", "number"]).groupBy("document_id", "ent_id").agg(F.min_by("text", "at").alias("related"))
    # of all laws with the number the first in order, once a number
    other = laws.groupBy("number").agg(F.min_by("text", "law").alias("other"))
    shown = articles.join(own, ["document_id", "number"], "left").join(related, ["document_id", "ent_id"], "left").join(other, "number", "left")
    shown = shown.select("document_id", "ent_id", "number", F.coalesce("own", "related", "other").alias("text")).where("text IS NOT NULL")
    popup = F.concat(F.lit("الفصل "), F.col("number"), F.lit("\n"), F.col("text"))
    single = shown.select("document_id", "ent_id", popup.alias("popup"))
    refs = nodes.where("type = 'INTERNAL_REF'").select("document_id", F.col("ent_id").alias("source_id"))
    led = relations.join(refs, ["document_id", "source_id"], "left_semi").select("document_id", "ord", F.col("source_id").alias("ref"), F.col("target_id").alias("ent_id")).join(single, ["document_id", "ent_id"])
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "popup"))), lambda x: x["popup"]), "\n\n")
    return single.unionByName(led.groupBy("document_id", F.col("ref").alias("ent_id")).agg(held.alias("popup")))
