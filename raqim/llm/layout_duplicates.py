"""Records that differ only in layout: spacing, case, punctuation or field order.

Byte-identical (number, text) rows are collapsed first, with counts and before any
canonicalising; only the distinct survivors are canonicalised and grouped again on
their full canonical number and text. The second grouping and every later join move
32-byte SHA-256 digests of the whole canonical values, never the texts.

Defined cases: a null number counts as empty; null, empty and short texts (fewer than
``min_chars`` letters, digits and marks) belong to no group; equal ids or rows repeated
byte for byte count as copies; a text is a labelled one if it begins with a label and a
colon and has at least two such fields; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raqim.operators.lineage import cut

#: What parts fields: a line break or a separator.
_PARTS = r"\n\r\t|;؛,،•·/"
#: A label of a field and its colon: anything with a letter in it that holds neither, of any length.
LABEL = rf"[^{_PARTS}:：\p{{L}}]*+\p{{L}}[^{_PARTS}:：]*+[:：]"
#: What may stand before a label: the start of the text or what parts fields.
BEFORE = rf"(?:^|[{_PARTS}])"


def letters(value: Column) -> Column:
    """The letters, digits and combining marks of ``value``, lower-cased, in order."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}\p{M}]+", "")


def canonical_text(text: Column) -> Column:
    """``letters`` of a text; of a labelled text those of its fields, sorted and joined by ``|``."""
    starts = text.rlike(rf"^[^\p{{L}}\p{{N}}]*+{LABEL}")
    fields = F.split(text, rf"{BEFORE}(?={LABEL})")
    fields = F.array_sort(F.filter(F.transform(fields, letters), lambda f: f != ""))
    return F.when(starts & (F.size(fields) > 1), F.array_join(fields, "|")).otherwise(letters(text))


def _agreed(canon: DataFrame) -> DataFrame:
    """``canon`` with one key for all records that are one by their letters in order or by their fields.

    Where one layout shows a field and another hides it (a blank of another kind in a label,
    a lost colon) the keys differ though the letters don't. Such keys are joined along any
    chain of records; each group takes its smallest key.
    """
    plain = canon.withColumn("plain", F.coalesce("plain", "key"))
    mixed = plain.groupBy("plain").agg(F.min(F.xxhash64("key")).alias("a"), F.max(F.xxhash64("key")).alias("b")).where("a <> b").select("plain")
    mixed = cut(mixed)
    if mixed.isEmpty():
        return canon
    edges = cut(plain.join(mixed, "plain").select("plain", "key").distinct())
    link = edges.select("key", F.col("key").alias("one")).distinct()
    while True:
        # the smallest key one record away, and the one that was known for that
        near = edges.join(link, "key").groupBy("plain").agg(F.min("one").alias("near"))
        near = edges.join(near, "plain").groupBy("key").agg(F.min("near").alias("near"))
        known = link.select(F.col("key").alias("near"), F.col("one").alias("far"))
        link = cut(link.join(near, "key").join(known, "near").select("key", F.least("near", "far").alias("one"), (F.least("near", "far") != F.col("one")).alias("moved")))
        moved = not link.where("moved").isEmpty()
        link = link.select("key", "one")
        if not moved:
            return cut(canon.join(link, "key", "left").select("raw_first", "n", "raw_key", F.coalesce("one", "key").alias("key")))


def digest(*values: Column) -> Column:
    """SHA-256 over the lengths and characters of all values, as 32 bytes."""
    parts = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def layout_groups(df: DataFrame, key: str = "article_id", number: str = "number", text: str = "text", min_chars: int = 60) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of the records that are one record in several layouts.

    members: ``key`` of every record of a group with two or more, and ``first_id``.
    groups: ``first_id``, ``copies`` (rows) and ``layouts`` (distinct raw forms), also of
    records without a copy, so that it holds one row per distinct record.
    """
    # lower case makes at most two characters of one, so no text with min_chars letters is lost here
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(number), F.lit("")).alias("num"), F.col(text).alias("txt")).where(F.length("txt") * 2 >= min_chars)
    distinct = rows.groupBy("num", "txt").agg(F.min("id").alias("raw_first"), F.count("*").alias("n"))
    canon = distinct.withColumn("c", canonical_text(F.col("txt"))).where(F.length(F.replace(F.col("c"), F.lit("|"), F.lit(""))) >= min_chars)
    # narrow and read three times: written once instead of canonicalised three times
    fields = F.length("c") - F.length(F.replace(F.col("c"), F.lit("|"), F.lit("")))
    plain = F.when(F.col("fields") > 0, digest(letters(F.col("num")), letters(F.col("txt"))))
    canon = canon.withColumn("fields", fields).select("raw_first", "n", digest(F.col("num"), F.col("txt")).alias("raw_key"), digest(letters(F.col("num")), F.col("c")).alias("key"), "fields", plain.alias("plain"))
    canon = _agreed(cut(canon))
    groups = canon.groupBy("key").agg(F.min("raw_first").alias("first_id"), F.sum("n").alias("copies"), F.count("*").alias("layouts"))
    repeated = canon.join(groups.where("copies > 1").select("key", "first_id"), "key").select("raw_key", "first_id")
    members = rows.select("id", digest(F.col("num"), F.col("txt")).alias("raw_key")).join(repeated, "raw_key").select(F.col("id").alias(key), "first_id")
    return members, groups.select("first_id", "copies", "layouts")


def distinct_records(df: DataFrame, key: str = "article_id", number: str = "number", text: str = "text", min_chars: int = 60) -> DataFrame:
    """``df`` with one row per record, that of the smallest ``key``, and its ``copies`` and ``layouts``.

    Null, empty and short texts are compared with nothing and each stay as a record of one copy.
    """
    members, groups = layout_groups(df, key, number, text, min_chars)
    others = members.where(F.col(key) != F.col("first_id")).select(key).distinct()
    counted = groups.select(F.col("first_id").alias(key), "copies", "layouts")
    once = F.lit(1).cast("bigint")
    return df.join(others, key, "left_anti").join(counted, key, "left").withColumns({"copies": F.coalesce("copies", once), "layouts": F.coalesce("layouts", once)})
