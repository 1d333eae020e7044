"""Operators on entity mentions: normal forms, global ids, expansion of article ranges and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raqim.functions.numbers import ascii_digits, canonical_num, found, law_number
from raqim.functions.text import entity_id, normalize_arabic, parse_date
from raqim.functions.vocabulary import NAME_TYPES
from raqim.operators.tree import numbers_between

#: The pattern of a law with its number.
_LAW = r"(الظهير الشريف|القانون التنظيمي|القانون|الدستور|المرسوم|مرسوم|القرار|قرار)\s*(?:رقم\s*)?(\d+(?:[./]+\d+)*)"
LAW_TYPES = ("LAW", "DECRET", "DAHIR", "CONSTITUTION")


def _has(text: Column, *words: str) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def _law(text: Column) -> Column:
    plain = ascii_digits(text)
    kinds, numbers = (F.regexp_extract_all(plain, F.lit(_LAW), F.lit(i)) for i in (1, 2))
    parts = F.zip_with(kinds, numbers, lambda k, n: F.concat(k, F.lit(" "), canonical_num(n)))
    article = canonical_num(found(plain, r"(?:المادة|الفصل)\s*(\d+(?:[./]+\d+)*)", 1))
    heading = F.when(_has(text, "مادة"), "المادة").otherwise("الفصل")
    headed = F.when(article.isNotNull(), F.array(F.concat(heading, F.lit(" "), article))).otherwise(F.array().cast("array<string>"))
    kind = F.when(_has(text, "ظهير"), "الظهير الشريف")
    for word, name in (("القانون التنظيمي", "القانون التنظيمي"), ("القانون", "القانون"), ("دستور", "الدستور"), ("مرسوم", "المرسوم"), ("قرار", "القرار")):
        kind = kind.when(_has(text, word), name)
    number = law_number(text)
    alone = F.when(number.isNotNull(), F.concat(headed, F.array(F.trim(F.concat_ws(" ", kind.otherwise(""), number)))))
    whole = F.concat(headed, parts)
    return F.array_join(F.when(F.size(whole) > 0, whole).otherwise(alone), " ")


def _article(kind: Column, text: Column) -> Column:
    numbers = F.regexp_extract_all(ascii_digits(text), F.lit(r"\d+"), F.lit(0))
    heading = (
        F.when(_has(text, "مادة", "مواد", "المادتين"), "المادة")
        .when(_has(text, "فصل", "فصول"), "الفصل")
        .when(_has(text, "باب"), "الباب")
        .when(_has(text, "قسم"), "القسم")
        .otherwise(F.when(kind == "ARTICLE", "الفصل").when(kind == "CHAPTER", "الباب").otherwise("القسم"))
    )
    joined = F.array_join(F.transform(numbers, lambda n: F.regexp_replace(n, r"^0+(?=\d)", "")), "_")
    return F.when(F.size(numbers) > 1, F.concat_ws(" ", heading, joined)).otherwise(F.concat(canonical_num(text), F.lit(" "), heading))


def normal_form(kind: Column, text: Column, normalized: Column, transliterate=lambda c: c) -> Column:
    """The normal form of a mention by its type; one already there is kept, but for laws and articles.

    ``transliterate`` is applied to names and all other types, the identity by default.
    """
    fixed = kind.isin("LAW", "DECRET", "ARTICLE", "CHAPTER", "SECTION")
    made = (
        F.when(kind == "DATE", parse_date(text))
        .when(kind.isin("LAW", "DECRET"), _law(text))
        .when(kind.isin("ARTICLE", "CHAPTER", "SECTION"), _article(kind, text))
        .when(kind.isin("OFFICIAL_JOURNAL", "CASE"), canonical_num(text))
        .when(kind.isin(*NAME_TYPES), transliterate(normalize_arabic(text)))
        .otherwise(transliterate(text))
    )
    had = F.nullif(normalized, F.lit(""))
    return F.when(had.isNotNull() & ~F.coalesce(fixed, F.lit(False)), normalized).otherwise(F.coalesce(F.nullif(made, F.lit("")), normalized))


def numeric_ids(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids 1.. by document in order; endpoints follow, those without an entity stay. Of an id used twice the last counts."""
    order = Window.partitionBy("document_id").orderBy("ord")
    numbered = entities.withColumn("new_id", F.row_number().over(order).cast("string"))
    ids = numbered.groupBy("document_id", "ent_id").agg(F.max_by("new_id", "ord").alias("to"))
    out = relations
    for end in ("source_id", "target_id"):
        out = out.join(ids.select("document_id", F.col("ent_id").alias(end), F.col("to").alias("_to")), ["document_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return numbered, out.withColumn("new_relation_id", F.row_number().over(order).cast("string"))


def global_ids(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ord, global_id): laws by number, articles by their law and number, others by hash.

    An article belongs to the law that its first relation leads to.
    """
    value = F.coalesce(F.nullif(F.col("normalized"), F.lit("")), F.col("text"))
    rows = entities.select("document_id", "ord", "ent_id", "type", "text", value.alias("value"))
    laws = rows.where(F.col("type").isin(*LAW_TYPES)).groupBy("document_id", F.col("ent_id").alias("target_id")).agg(F.max_by(F.struct("type", canonical_num(F.col("text")).alias("number")), "ord").alias("law"))
    linked = relations.select("document_id", "source_id", "target_id", F.col("ord").alias("r")).join(laws, ["document_id", "target_id"]).groupBy("document_id", F.col("source_id").alias("ent_id")).agg(F.min_by("law", "r").alias("law"))
    rows = rows.join(linked, ["document_id", "ent_id"], "left")
    law_id = F.coalesce(law_number(F.col("value")), law_number(F.col("text")))
    number = canonical_num(F.col("value"))
    made = (
        F.when(F.col("type").isin(*LAW_TYPES), F.concat("type", F.lit("_"), law_id))
        .when((F.col("type") == "ARTICLE") & F.col("law.number").isNotNull(), F.concat("law.type", F.lit("_"), "law.number", F.lit("_ART_"), number))
        .when(F.col("type") == "ARTICLE", F.concat(F.lit("ART_"), number))
        .when(F.col("value").isNotNull(), entity_id(F.col("type"), F.col("value")))
    )
    return rows.select("document_id", "ord", made.alias("global_id"))


#: The patterns of ranges and lists of articles.
_RANGE = re.compile(r"من\s+(?:الفصل\s+)?([0-9٠-٩]+)\s+(?:إ?لى|الى)\s+(?:الفصل\s+)?([0-9٠-٩]+)")
_LIST = re.compile(r"(?:الفصلين|الفصول)\s*:?[\s ]*((?:[0-9٠-٩]+(?:\s*[،,]\s*|\s*و\s*))*[0-9٠-٩]+)")
_NUMBER = re.compile("[0-9٠-٩]+")


def article_references(text: str) -> list[tuple]:
    """(kind, start, end, normalized, first, last, first_start, first_end, last_start, last_end) of each range, and of each number of a list.

    Bounds are ordered. Numbers too long for a BIGINT are no article numbers.
    """
    out = []
    for m in _RANGE.finditer(text):
        places = [(int(n[0]), m.start() + n.start(), m.start() + n.end()) for n in _NUMBER.finditer(m[0])]
        (a, *x), (b, *y) = sorted(places[:2], key=lambda p: p[0])
        x = y if a == b else x
        out.append(("range", m.start(), m.end(), f"الفصل {a}-{b}", a, b, *x, *y))
    for m in _LIST.finditer(text):
        found = [(int(n[0]), m.start(1) + n.start(), m.start(1) + n.end()) for n in _NUMBER.finditer(m[1])]
        name = "الفصل " + "_".join(str(n) for n, _, _ in found)
        out += [("list", m.start(), m.end(), name, n, n, *at, *at) for n, *at in found]
    return [r for r in out if r[5] < 2**63]


def expand_references(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per number of each article range and list in the texts; texts without either never reach Python.

    Python gives the bounds of a range, the numbers between are generated, however many;
    those that do not stand in the text have no place (-1).
    """
    rows = documents.select(F.col(key).alias("document_id"), F.col(text).alias("t")).where(F.col("t").rlike(r"من\s+(?:الفصل\s+)?[0-9٠-٩]+\s+(?:إ?لى|الى)|الفصلين|الفصول"))
    ends = ("first_start", "first_end", "last_start", "last_end")
    names = ("kind", "start_char", "end_char", "normalized", "first", "last", *ends)
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in article_references(t)]
            columns = list(zip(*made)) or [()] * 11
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], ["document_id", *names])

    bounds = rows.mapInArrow(run, f"document_id long, kind string, start_char int, end_char int, normalized string, first long, last long, {', '.join(f'{e} int' for e in ends)}")
    each = numbers_between(bounds, F.col("first"), F.col("last"), "number")
    at = lambda side: F.when(F.col("number") == F.col("first"), F.col(f"first_{side}")).when(F.col("number") == F.col("last"), F.col(f"last_{side}")).otherwise(-1)
    return each.select("document_id", "kind", "start_char", "end_char", "normalized", "number", at("start").alias("number_start"), at("end").alias("number_end"))


def expand_articles(documents: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) that ranges and lists add: an INTERNAL_REF each, ARTICLE mentions for numbers that
    have none yet, and a ``refers_to`` from the one to each other."""
    parts = expand_references(documents)
    there = entities.where("type = 'ARTICLE'").withColumn("number", canonical_num(F.coalesce(F.nullif("normalized", F.lit("")), "text")).try_cast("bigint")).where("number IS NOT NULL").groupBy("document_id", "number").agg(F.min_by("ent_id", "ord").alias("had"))
    nth = Window.partitionBy("document_id", "normalized").orderBy("start_char")
    ref = F.concat(F.lit("INTERNAL_REF_"), F.regexp_replace("normalized", "^الفصل ", ""), F.lit("_"), F.dense_rank().over(nth).cast("string"))
    # made ids carry on the counter of the ids there with the same number
    base = F.regexp_extract("ent_id", r"^ARTICLE_(\d+)_\d+$", 1).try_cast("bigint")
    counted = entities.select("document_id", base.alias("number"), F.regexp_extract("ent_id", r"_(\d+)$", 1).try_cast("bigint").alias("k")).where("number IS NOT NULL").groupBy("document_id", "number").agg(F.max("k").alias("k"))
    made_id = F.concat(F.lit("ARTICLE_"), F.col("number").cast("string"), F.lit("_"), (F.coalesce("k", F.lit(0)) + 1).cast("string"))
    rows = parts.join(there, ["document_id", "number"], "left").join(counted, ["document_id", "number"], "left").withColumn("ref_id", ref).withColumn("art_id", F.coalesce("had", made_id)).drop("k")
    refs = rows.select("document_id", F.col("ref_id").alias("ent_id"), F.lit("INTERNAL_REF").alias("type"), "start_char", "end_char", "normalized").distinct()
    made = rows.where("had IS NULL").groupBy("document_id", F.col("art_id").alias("ent_id")).agg(F.min(F.struct((F.col("number_start") < 0).alias("unknown"), "number_start", "number_end")).alias("m"))
    arts = made.select("document_id", "ent_id", F.lit("ARTICLE").alias("type"), F.col("m.number_start").alias("start_char"), F.col("m.number_end").alias("end_char"), F.lit(None).cast("string").alias("normalized"))
    links = rows.select("document_id", F.concat_ws("_", F.lit("REL_refers_to"), "ref_id", "art_id").alias("relation_id"), F.lit("refers_to").alias("type"), F.col("ref_id").alias("source_id"), F.col("art_id").alias("target_id")).distinct()
    return refs.unionByName(arts), links


def merge_chunks(entities: DataFrame, relations: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions found chunk by chunk as those of whole documents: offsets move by the chunk's, ids become 1..,
    endpoints follow within their chunk and stay where unknown."""
    order = Window.partitionBy("document_id").orderBy("chunk", "ord")
    known = F.col("start_char") >= 0
    moved = entities.join(offsets, ["document_id", "chunk"]).select(
        "document_id", "chunk", "ord", "ent_id", "type", "text",
        F.when(known, F.col("start_char") + F.col("offset")).otherwise(F.col("start_char")).alias("start_char"),
        F.when(known, F.col("end_char") + F.col("offset")).otherwise(F.col("end_char")).alias("end_char"),
        F.row_number().over(order).cast("string").alias("new_id"),
    )
    ids = moved.groupBy("document_id", "chunk", "ent_id").agg(F.max_by("new_id", "ord").alias("to"))
    for end in ("source_id", "target_id"):
        relations = relations.join(ids.select("document_id", "chunk", F.col("ent_id").alias(end), F.col("to").alias("_to")), ["document_id", "chunk", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return moved, relations


def postprocess(documents: DataFrame, entities: DataFrame, relations: DataFrame, parity: bool = True) -> tuple[DataFrame, DataFrame]:
    """Mentions and relations as they are stored: expanded, placed, without those inside dates or references,
    normalised, numbered, with global ids.

    ``parity`` drops an article inside a reference together with its relations, so that of an
    expanded range only the inner numbers stay; otherwise expanded articles are kept, and
    relations to dropped ones go.
    """
    from raqim.operators.lineage import cut
    from raqim.operators.spans import articles_outside_dates, articles_outside_refs, fix_offsets

    columns = ["document_id", "ent_id", "type", "text", "start_char", "end_char", "normalized"]
    more, links = expand_articles(documents, entities)
    bodies = documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("_body"))
    read = F.when(F.col("start_char") >= 0, F.substring("_body", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).otherwise(F.regexp_extract("ent_id", r"(\d+)_\d+$", 1))
    more = more.join(bodies, "document_id").withColumn("text", read)
    after = Window.partitionBy("document_id").orderBy("added", "ord", "start_char", "ent_id")
    both = entities.select(*columns, "ord", F.lit(0).alias("added")).unionByName(more.select(*columns, F.lit(0).alias("ord"), F.when(F.col("type") == "INTERNAL_REF", 1).otherwise(2).alias("added")))
    both = cut(both.withColumn("ord", F.row_number().over(after)))
    placed = fix_offsets(both, documents).withColumnsRenamed({"start_char": "_a", "end_char": "_b"})
    both = both.join(placed, ["document_id", "ord"], "left").withColumn("start_char", F.coalesce("_a", "start_char")).withColumn("end_char", F.coalesce("_b", "end_char")).drop("_a", "_b")
    names = ["document_id", "relation_id", "type", "source_id", "target_id"]
    first = Window.partitionBy("document_id").orderBy("added", "ord", "relation_id")
    told = relations.select(*names, "ord", F.lit(0).alias("added")).unionByName(links.select(*names, F.lit(0).alias("ord"), F.lit(1).alias("added")))
    told = told.withColumn("ord", F.row_number().over(first)).drop("added")
    both = articles_outside_dates(cut(both))
    if parity:
        both, told = articles_outside_refs(both, told)
    else:
        kept, told = articles_outside_refs(both.where("added <> 2"), told)
        both = kept.unionByName(both.where("added = 2"))
    both = cut(both.drop("added").withColumn("normalized", normal_form(F.col("type"), F.col("text"), F.col("normalized"))))
    told = cut(told)
    ids = global_ids(both, told)
    numbered, told = numeric_ids(both, told)
    return numbered.join(ids, ["document_id", "ord"], "left"), told
