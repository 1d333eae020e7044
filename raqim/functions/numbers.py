"""Numbers in legal references. Numbers stay STRING: 1.06.169 is an identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raqim.functions.vocabulary import ARABIC_DIGITS, ASCII_DIGITS, ORDINALS, lookup


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or NULL."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def canonical_num(text: Column) -> Column:
    """The first number, digits joined by the first character of each separator run (``.`` or ``/``)."""
    return F.regexp_replace(found(ascii_digits(text), r"\d+(?:[./]+[^\d]*\d+)*"), r"([./])[./]*[^\d]*", "$1")


def law_number(text: Column) -> Column:
    """The number after رقم; with an article word and several numbers the last; else the first."""
    plain = ascii_digits(text)
    numbers = F.regexp_extract_all(plain, F.lit(r"\d+(?:[./]+\d+)*"), F.lit(0))
    article = text.contains("المادة") | text.contains("الفصل")
    return F.coalesce(
        canonical_num(found(plain, r"رقم\s*([0-9]+(?:[./]+[0-9]+)*)", 1)),
        F.when(article & (F.size(numbers) >= 2), canonical_num(F.try_element_at(numbers, F.lit(-1)))),
        canonical_num(F.try_element_at(numbers, F.lit(1))),
    )


def law_article(normalized: Column, text: Column) -> Column:
    """STRUCT(article, law) read from ``normalized``, or from ``text`` where that is empty; NULL unless both are there."""
    source = ascii_digits(F.coalesce(F.nullif(normalized, F.lit("")), text))
    article = canonical_num(found(source, r"(?:المادة|الفصل)\s*(\d+(?:[./]+\d+)*)", 1))
    law = law_number(source)
    return F.when(article.isNotNull() & law.isNotNull(), F.struct(article.alias("article"), law.alias("law")))


def ordinal_to_int(text: Column) -> Column:
    stripped = F.trim(text)
    return F.coalesce(lookup(ORDINALS, stripped), stripped).try_cast("int")


def clean_number(text: Column) -> Column:
    """A heading's number as digits: heading word off, ordinals and Arabic digits read, leading zeros dropped."""
    rest = F.trim(F.regexp_replace(F.trim(text), r"^(?:المادة|مادة|الفصل|فصل|الباب|باب|القسم|قسم|الجزء|جزء|فرع)\s*", ""))
    plain = ascii_digits(F.coalesce(lookup(ORDINALS, rest), rest))
    digits = found(plain, r"\d+")
    return F.coalesce(F.regexp_replace(digits, r"^0+(?=\d)", ""), plain)


def drop_stray_digit(number: Column) -> Column:
    """Digits of more than two places that begin with 8 or 9 lose that digit, a misread mark."""
    stripped = F.trim(number)
    return F.when(stripped.rlike(r"^[89]\d{2,}$"), F.regexp_replace(stripped, "^.", "")).otherwise(number)
