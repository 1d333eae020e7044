"""One form for text that looks the same but is made of other characters.

The work is done by DuckDB inside the Arrow batches of each partition: compatibility
forms by a map, invisible characters and odd spaces by regular expressions, separate
marks by ``nfc_normalize`` and look-alike letters word by word by ``translate``.

Defined cases: null stays null and is no case, '' and blank text stay as they are; names
wholly in another script, vowel marks, ڭ, plain spaces (also doubled) and the digits
U+0660-0669 are kept; repeated rows each come out; other columns are passed by.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other alphabets that look like Latin ones.
LOOKS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
#: Letters of other languages that look like Arabic ones, and their digits.
LOOKS_ARABIC = {"ی": "ي", "ک": "ك", "ڪ": "ك", "ہ": "ه", "ھ": "ه", "ە": "ه"}
OTHER_DIGITS = {"۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۴": "٤", "۵": "٥", "۶": "٦", "۷": "٧", "۸": "٨", "۹": "٩"}

INVISIBLE = "[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿]"
SPACES = "[\t\n\r\u000b\u000c\u0085   -     　]"
FORMS = "[ﬀ-﷿︰-﹏ﹰ-﻾！-￮\U0001d400-\U0001d7ff]"


def form_map() -> dict[str, str]:
    """Full-width, half-width, presentation and mathematical forms with what they stand for, from the Unicode tables."""
    ranges = ((0xFB00, 0xFDFF), (0xFE30, 0xFE4F), (0xFE70, 0xFEFE), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF))
    return {c: n for a, b in ranges for c in map(chr, range(a, b + 1)) if (n := unicodedata.normalize("NFKC", c)) != c}


def _sql(column: str) -> tuple[str, str]:
    """SQL of the one form of ``column``, and of whether it had to change."""
    pair = lambda m: f"'{''.join(m)}', '{''.join(m.values())}'"
    q = f'"{column}"'
    seen = f"regexp_replace({q}, '{INVISIBLE}', '', 'g')"
    spaced = f"regexp_replace({seen}, '{SPACES}', ' ', 'g')"
    formed = f"CASE WHEN regexp_matches({spaced}, '{FORMS}') THEN array_to_string(list_transform(regexp_extract_all({spaced}, '(?s).'), lambda c: coalesce(map_extract_value(MAP($keys, $values), c), c)), '') ELSE {spaced} END"
    composed = f"nfc_normalize({formed})"
    word = f"CASE WHEN regexp_matches(w, '\\p{{Latin}}') THEN translate(w, {pair(LOOKS_LATIN)}) WHEN regexp_matches(w, '\\p{{Arabic}}') THEN translate(w, {pair(LOOKS_ARABIC | OTHER_DIGITS)}) ELSE w END"
    odd = f"[{''.join(LOOKS_LATIN)}{''.join(LOOKS_ARABIC)}{''.join(OTHER_DIGITS)}]"
    words = f"CASE WHEN regexp_matches(c, '{odd}') THEN array_to_string(list_transform(regexp_extract_all(c, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word}), '') ELSE c END"
    one = f"list_transform([{composed}], lambda c: {words})[1]"
    # a mere reordering of marks by NFC is no case, a shorter text is
    changed = f"{q} IS NOT NULL AND ({seen} <> {q} OR {spaced} <> {seen} OR regexp_matches({q}, '{FORMS}') AND {formed} <> {spaced} OR length({composed}) < length({formed}) OR {one} <> {composed})"
    return one, changed


def unify(df: DataFrame, columns: tuple[str, ...], key: str = "entity_id") -> DataFrame:
    """``key`` and, for each of ``columns``, its one form under its own name and ``<name>_changed``.

    No exchange: every Arrow batch is one in-memory query, and nothing of a partition is
    held beyond its batch.
    """
    exprs = ", ".join(f'{one} AS "{c}", {changed} AS "{c}_changed"' for c in columns for one, changed in [_sql(c)])
    query = f'SELECT k, {exprs} FROM batch'
    narrow = df.select(F.col(key).alias("k"), *columns)
    kind = narrow.schema["k"].dataType.simpleString()
    schema = f"k {kind}, " + ", ".join(f"`{c}` string, `{c}_changed` boolean" for c in columns)
    forms = form_map()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                yield from con.sql(query, params={"keys": list(forms), "values": list(forms.values())}).to_arrow_table().to_batches()
        con.close()

    return narrow.mapInArrow(run, schema).withColumnRenamed("k", key)


def changed_values(df: DataFrame, columns: tuple[str, ...], key: str = "entity_id") -> DataFrame:
    """(``key``, field) of every value that had to change."""
    flags = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_changed").alias("changed")) for c in columns])
    return unify(df, columns, key).select(key, F.inline(flags)).where("changed").select(key, "field").distinct()
