"""Text functions: dates, Arabic words, cleaning, paragraphs, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raqim.functions.numbers import ascii_digits, canonical_num, found
from raqim.functions.vocabulary import HEADER_LINES, MONTHS, STRUCTURE_TYPES, lookup

_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
#: Feminine forms and the masculine ones that stand for them.
FEMININE = {"مديرة": "مدير", "قاضية": "قاضي", "محامية": "محامي", "رئيسة": "رئيس", "مستشارة": "مستشار", "كاتبة": "كاتب", "السيدة": "سيد", "سيدة": "سيد", "وزيرة": "وزير"}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def parse_date(text: Column) -> Column:
    """``yyyy-MM-dd`` of a date: day, month name and year; ISO; or day/month/year. NULL if it is none.

    Month names come first and no part is guessed from today, a deliberate correction.
    """
    plain = ascii_digits(text)
    named = [F.regexp_extract(plain, r"(\d{1,2})\s+(\S+)\s+(\d{4})", i) for i in (1, 2, 3)]
    made = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
    iso = found(plain, r"\d{4}-\d{2}-\d{2}")
    slashed = [F.regexp_extract(plain, r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", i) for i in (1, 2, 3)]
    return F.coalesce(
        made(named[2], lookup(MONTHS, named[1]).cast("string"), named[0]),
        F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"),
        F.when(slashed[0] != "", made(slashed[2], slashed[1], slashed[0])),
    )


def normalize_arabic(text: Column) -> Column:
    """Words without the article, feminine forms as masculine, plural endings reduced."""
    words = F.filter(F.split(strip(text), rf"{_SPACE}+"), lambda w: w != "")

    def one(w: Column) -> Column:
        bare = F.when(w.startswith("ال") & (F.length(w) > 2), F.substring(w, F.lit(3), F.length(w))).otherwise(w)
        cut = lambda n, end="": F.concat(F.substring(bare, F.lit(1), F.length(bare) - n), F.lit(end))
        return (
            F.when(lookup(FEMININE, bare).isNotNull(), lookup(FEMININE, bare))
            .when(bare.endswith("وات"), cut(3, "ة"))
            .when(bare.endswith("ات"), cut(2, "ة"))
            .when(bare.endswith("ون") | bare.endswith("ين"), cut(2))
            .otherwise(bare)
        )

    return F.array_join(F.transform(words, one), " ")


def canonical_type(kind: Column, only_known: bool = True) -> Column:
    """A structural type without the article; ``only_known`` keeps the article of unknown types."""
    stripped = F.trim(kind)
    bare = F.when(stripped.startswith("ال"), F.substring(stripped, F.lit(3), F.length(stripped))).otherwise(stripped)
    if only_known:
        bare = F.when(bare.isin(*STRUCTURE_TYPES), bare).otherwise(stripped)
    return F.coalesce(bare, F.lit(""))


def clean_ocr_lines(text: Column, footnotes: bool = True) -> Column:
    """Without header lines and page-number lines, and without ``12 - ..`` footnotes; other lines as they are."""
    page = r"^-?\s*\d+\s*-?$"  # fixed value

    def kept(line: Column) -> Column:
        s = strip(line)
        noise = s.isin(*HEADER_LINES) | ascii_digits(s).rlike(page)
        return ~(noise | ascii_digits(s).rlike(r"^\d+\s*-\s+")) if footnotes else ~noise

    return F.array_join(F.filter(F.split(text, r"\r\n|[\n\r\u000b\u000c\u0085  ]"), kept), "\n")


def clean_text(text: Column) -> Column:
    """A node's text without Latin letters, header phrases, and lines that are numbers."""
    out = F.regexp_replace(text, "[A-Za-z]+", "")
    out = F.regexp_replace(out, r"\n\s*\d+\s*\n", "\n")
    for header in HEADER_LINES:
        out = F.replace(out, F.lit(header), F.lit(""))
    return strip(F.regexp_replace(out, r"(?m)^-?\s*\d+\s*-?$", ""))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, stripped, none of them empty."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def has_preamble_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\bقسم\s+تمهيدي\b"), F.lit(False))


def remove_code_fences(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*|\s*```$", "")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def law_hint(text: Column) -> Column:
    """STRUCT(name, number): what follows ``من`` up to the line end, and the first number in it."""
    name = strip(found(text, r"من ([^\n]+)", 1))  # fixed value
    return F.struct(name.alias("name"), canonical_num(name).alias("number"))


def titled_law_number(*titles: Column) -> Column:
    """The number after القانون رقم in the first title that has one."""
    return F.coalesce(*[found(ascii_digits(t), r"القانون\s+رقم\s*(\d+(?:[./]\d+)*)", 1) for t in titles])  # fixed value


def referenced_law(references: Column) -> Column:
    """The number of the first of ``references`` (array of struct with type and number) whose type names a law."""
    return F.get(F.filter(references, lambda r: r["type"].contains("قانون")), F.lit(0))["number"]


def law_aliases(title: Column) -> Column:
    """All numbers that follow القانون .. رقم in a title."""
    return F.array_distinct(F.transform(F.regexp_extract_all(ascii_digits(title), F.lit(r"القانون[^\d]*رقم\s*([\d.]+)"), F.lit(1)), canonical_num))  # fixed value


def first_filled(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def fill_template(template: str, text: Column, mark: str = "{{TEXT}}") -> Column:
    return F.replace(F.lit(template), F.lit(mark), F.coalesce(text, F.lit("")))


def inherited_fields(reply: Column) -> Column:
    """STRUCT(type, number, title, rest) of a reply; the fields are NULL without an inherited-context line."""
    text = F.regexp_replace(reply, r"^\s+", "")
    begins = text.startswith("Inherited context:")
    line = F.when(begins, F.regexp_extract(text, r"^([^\n]*)", 1))
    field = lambda i: F.trim(found(line, r'^Inherited context:\s*type=([^,]+),\s*number=([^,]+),\s*title="([^"]*)"', i))  # fixed value
    rest = F.when(begins, F.regexp_replace(text, r"^[^\n]*\n?\s*", "")).otherwise(reply)
    return F.struct(field(1).alias("type"), field(2).alias("number"), field(3).alias("title"), rest.alias("rest"))


def escape_bad_unicode(reply: Column) -> Column:
    """A reply in JSON with ``\\u`` that no four digits follow made a literal."""
    return F.regexp_replace(reply, r"\\u(?![0-9a-fA-F]{4})", r"\\\\u")


def entity_id(kind: Column, normalized: Column) -> Column:
    """``TYPE_`` and the first eight digits of the SHA-1 of the normal form."""
    return F.concat_ws("_", kind, F.substring(F.sha1(normalized), 1, 8))
