"""Queries of the text and number functions over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raqim.functions.markers import SPANS, mark_entities, parse_marked_text, strip_markers, write_markers
from raqim.functions.numbers import canonical_num, clean_number, drop_stray_digit, law_article, law_number, ordinal_to_int
from raqim.functions.text import FEMININE, canonical_type, clean_ocr_lines, clean_text, entity_id, html_escape, law_hint, normalize_arabic, paragraphs, parse_date
from raqim.functions.vocabulary import MONTHS, ORDINALS
from raqim.operators.chunks import char_chunks, message_cost, messages, model_limits, stop_chunks
from raqim.sources.tables import table

D = "translate({0}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
MONTH_SQL = "CASE m " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MONTHS.items()) + " END"


def _canonical_sql(x: str) -> str:
    return rf"regexp_replace(nullif(regexp_extract({D.format(x)}, '\d+(?:[./]+[^\d]*\d+)*'), ''), '([./])[./]*[^\d]*', '\1', 'g')"


def canonical_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "article_id", "number").select("article_id", canonical_num(F.col("number")).alias("canonical"))


def law_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities", "entity_id", "type", "text").where("type IN ('LAW', 'ARTICLE')").select("entity_id", law_number(F.col("text")).alias("law"))


def law_article_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "article_id", "number").join(_laws(spark, d), "article_id")
    said = F.concat(F.lit("المادة "), canonical_num(F.col("number")), F.lit(" من القانون رقم "), F.col("law_number"))
    got = law_article(F.lit(None).cast("string"), said)
    return rows.select("article_id", got["article"].alias("article"), got["law"].alias("law"))


def _laws(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles", "article_id", "document_id")
    return articles.join(table(spark, d, "documents", "doc_id", "law_number"), F.col("document_id") == F.col("doc_id")).select("article_id", "law_number")


def clean_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "article_id", "number")
    return rows.select("article_id", clean_number(F.col("number")).alias("clean"), drop_stray_digit(clean_number(F.col("number"))).alias("repaired"))


def ordinals(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("الأول", "الثانية", "الثالث عشر", "تمهيدي", "7", "بلا")))
    rows = table(spark, d, "orders", "o_orderkey").withColumn("word", F.element_at(words, (F.col("o_orderkey") % 6 + 1).cast("int")))
    return rows.select("o_orderkey", ordinal_to_int(F.col("word")).alias("n"))


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities", "entity_id", "type", "text").where("type = 'DATE'").select("entity_id", parse_date(F.col("text")).alias("day"))


def arabic_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities", "entity_id", "type", "text").where("type IN ('COURT', 'GOVERNMENT_BODY', 'AGENCY')").select("entity_id", normalize_arabic(F.col("text")).alias("name"))


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "article_id", "text").select("article_id", clean_ocr_lines(F.col("text")).alias("text"))


def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "article_id", "text").select("article_id", clean_text(F.col("text")).alias("text"))


def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("block_idx", "text"))


def structural_types(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities", "entity_id", "type", "text").where("type = 'ARTICLE'")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    return rows.select("entity_id", canonical_type(word).alias("known"), canonical_type(word, False).alias("bare"))


def entity_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities", "entity_id", "type", "normalized").where("normalized IS NOT NULL").select("entity_id", entity_id(F.col("type"), F.col("normalized")).alias("made_id"))


def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "article_id", "title").where("title IS NOT NULL").select("article_id", html_escape(F.col("title")).alias("html"))


def law_hints(spark: SparkSession, d: str) -> DataFrame:
    got = law_hint(F.col("text"))
    return table(spark, d, "articles", "article_id", "text").select("article_id", got["name"].alias("name"), got["number"].alias("number")).where("name IS NOT NULL")


def marker_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities", "entity_id", "ent_id", "text")
    return rows.select("entity_id", strip_markers(F.concat(F.lit("قبل <"), F.regexp_replace("text", "[,<>]", ""), F.lit(", id:"), F.col("ent_id"), F.lit("> بعد"))).alias("text"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities", "document_id", "ord", "ent_id", "type", "text", "start_char", "end_char", "normalized")
    span = F.struct("start_char", "ord", F.col("ent_id").alias("id"), "type", "text", "end_char", "normalized")
    held = entities.where("text <> ''").groupBy("document_id").agg(F.array_sort(F.collect_list(span)).alias("s"))
    spans = F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["text"].alias("text"), x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), x["normalized"].alias("normalized"))).cast(SPANS)
    return held.select(F.col("document_id").alias("doc_id"), spans.alias("spans")).join(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def marker_insert(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", mark_entities("text", "spans").alias("text"))


def marker_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose markers, written and read again, do not give the text back: none."""
    known = F.filter("spans", lambda s: s["start_char"] >= 0)
    marked = _spans(spark, d).select("doc_id", "text", parse_marked_text(write_markers(F.col("text"), known)).alias("read"))
    return marked.where(F.col("read.text") != F.col("text")).select("doc_id")


def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return char_chunks(table(spark, d, "documents", "doc_id", "text"), 400)


def stop_windows(spark: SparkSession, d: str) -> DataFrame:
    return stop_chunks(table(spark, d, "documents", "doc_id", "text"), 800, 64)


def message_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return rows.select("doc_id", message_cost(messages("Structure:", F.col("text"), "<--- END", system="You are an expert.")).cast("bigint").alias("cost"))


def model_budgets(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("gpt-4o-mini", "gpt-3.5-turbo", "gpt-3.5-turbo-16k", "gpt-4", "other")))
    rows = table(spark, d, "nation", "n_nationkey").withColumn("model", F.element_at(names, F.col("n_nationkey") % 5 + 1))
    return rows.select("n_nationkey", "model", model_limits(F.col("model"))["context"].alias("context"), model_limits(F.col("model"))["completion"].alias("completion"))


QUERIES = {
    "canonical_num": canonical_numbers, "law_number": law_numbers, "parse_law_article": law_article_numbers, "clean_number": clean_numbers, "ordinal_to_int": ordinals,
    "parse_arabic_date": parsed_dates, "normalize_arabic_names": arabic_names, "clean_ocr_lines": ocr_lines, "clean_text": cleaned_texts, "paragraph_blocks": paragraph_blocks,
    "canonical_type": structural_types, "entity_hash": entity_hashes, "html_escape": escaped_titles, "law_hints": law_hints, "marker_strip": marker_strip,
    "marker_insert": marker_insert, "marker_roundtrip": marker_roundtrip, "char_chunks": char_windows, "stop_chunks": stop_windows, "message_cost": message_costs, "model_limits": model_budgets,
}

_S = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
_HEAD = "('مديرية التشريع والدراسات', 'مديرية التشريع والدرامات', 'وزارة العدل', 'المملكة المغربية')"
_ORDINAL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDINALS.items()) + " ELSE w END"
_FEMININE = "CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEMININE.items())

SQL = {
    "canonical_num": f"SELECT article_id, {_canonical_sql('number')} AS canonical FROM articles",
    "law_number": rf"""
WITH t AS (SELECT entity_id, text, {D.format('text')} AS p FROM entities WHERE type IN ('LAW', 'ARTICLE')),
n AS (SELECT *, regexp_extract_all(p, '\d+(?:[./]+\d+)*') AS ns, nullif(regexp_extract(p, 'رقم\s*([0-9]+(?:[./]+[0-9]+)*)', 1), '') AS r FROM t)
SELECT entity_id, {_canonical_sql("coalesce(r, CASE WHEN (contains(text, 'المادة') OR contains(text, 'الفصل')) AND len(ns) >= 2 THEN ns[-1] END, ns[1])")} AS law FROM n""",
    "parse_law_article": rf"""
WITH r AS (SELECT article_id, {_canonical_sql('number')} AS n, law_number FROM articles JOIN documents ON document_id = doc_id)
SELECT article_id, CASE WHEN n IS NOT NULL AND law_number IS NOT NULL THEN n END AS article, CASE WHEN n IS NOT NULL AND law_number IS NOT NULL THEN {_canonical_sql('law_number')} END AS law FROM r""",
    "clean_number": rf"""
WITH a AS (SELECT article_id, trim(regexp_replace(trim(number), '^(?:المادة|مادة|الفصل|فصل|الباب|باب|القسم|قسم|الجزء|جزء|فرع)\s*', '')) AS w FROM articles),
b AS (SELECT article_id, {D.format('(' + _ORDINAL + ')')} AS p FROM a),
c AS (SELECT article_id, CASE WHEN regexp_matches(p, '\d') THEN regexp_replace(regexp_extract(p, '\d+'), '^0+(\d)', '\1') ELSE p END AS clean FROM b)
SELECT article_id, clean, CASE WHEN regexp_full_match(trim(clean), '[89]\d\d+') THEN trim(clean)[2:] ELSE clean END AS repaired FROM c""",
    "ordinal_to_int": f"""
WITH t AS (SELECT o_orderkey, (['الأول', 'الثانية', 'الثالث عشر', 'تمهيدي', '7', 'بلا'])[o_orderkey % 6 + 1] AS w FROM orders)
SELECT o_orderkey, TRY_CAST({_ORDINAL} AS INT) AS n FROM t""",
    "parse_arabic_date": rf"""
WITH t AS (SELECT entity_id, {D.format('text')} AS p FROM entities WHERE type = 'DATE'),
r AS (SELECT *, regexp_extract(p, '(\d{{1,2}})\s+(\S+)\s+(\d{{4}})', 2) AS m FROM t),
n AS (SELECT *, try_strptime(regexp_extract(p, '(\d{{1,2}})\s+(\S+)\s+(\d{{4}})', 3) || '-' || ({MONTH_SQL}) || '-' || regexp_extract(p, '(\d{{1,2}})\s+(\S+)\s+(\d{{4}})', 1), '%Y-%m-%d') AS named,
  try_strptime(nullif(regexp_extract(p, '\d{{4}}-\d{{2}}-\d{{2}}'), ''), '%Y-%m-%d') AS iso,
  try_strptime(regexp_extract(p, '(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})', 3) || '-' || regexp_extract(p, '(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})', 2) || '-' || regexp_extract(p, '(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})', 1), '%Y-%m-%d') AS dmy FROM r)
SELECT entity_id, strftime(coalesce(named, iso, dmy), '%Y-%m-%d') AS day FROM n""",
    "normalize_arabic_names": rf"""
WITH t AS (SELECT entity_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '^{_S}+|{_S}+$', '', 'g'), '{_S}+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(regexp_replace(text, '^{_S}+|{_S}+$', '', 'g'), '{_S}+'), lambda x: x <> ''), 1) AS i
  FROM entities WHERE type IN ('COURT', 'GOVERNMENT_BODY', 'AGENCY')),
u AS (SELECT entity_id, i, CASE WHEN starts_with(w, 'ال') AND length(w) > 2 THEN w[3:] ELSE w END AS b FROM t),
v AS (SELECT entity_id, i, {_FEMININE} ELSE CASE WHEN suffix(b, 'وات') THEN b[:-4] || 'ة' WHEN suffix(b, 'ات') THEN b[:-3] || 'ة' WHEN suffix(b, 'ون') OR suffix(b, 'ين') THEN b[:-3] ELSE b END END AS x FROM u)
SELECT entity_id, string_agg(x, ' ' ORDER BY i) AS name FROM v GROUP BY entity_id""",
    "clean_ocr_lines": rf"""
SELECT article_id, array_to_string(list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x{{85}}\x{{2028}}\x{{2029}}]'),
  lambda l: NOT (regexp_replace(l, '^{_S}+|{_S}+$', '', 'g') IN {_HEAD}
    OR regexp_matches({D.format("regexp_replace(l, '^" + _S + "+|" + _S + "+$', '', 'g')")}, '^-?\s*\d+\s*-?$')
    OR regexp_matches({D.format("regexp_replace(l, '^" + _S + "+|" + _S + "+$', '', 'g')")}, '^\d+\s*-\s+'))), chr(10)) AS text
FROM articles""",
    "clean_text": rf"""
SELECT article_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z]+', '', 'g'), '\n\s*\d+\s*\n', chr(10), 'g'),
  'مديرية التشريع والدراسات|مديرية التشريع والدرامات|وزارة العدل|المملكة المغربية', '', 'g'), '(?m)^-?\s*\d+\s*-?$', '', 'g'), '^{_S}+|{_S}+$', '', 'g') AS text FROM articles""",
    "paragraph_blocks": rf"""
WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^{_S}+|{_S}+$', '', 'g')), lambda p: p <> '') AS b FROM documents)
SELECT doc_id, CAST(i - 1 AS INT) AS block_idx, b[i] AS text FROM t, LATERAL (SELECT unnest(range(1, CAST(len(b) AS BIGINT) + 1)) AS i)""",
    "canonical_type": """
WITH t AS (SELECT entity_id, trim(regexp_extract(text, '^(\\S+)', 1)) AS w FROM entities WHERE type = 'ARTICLE'),
b AS (SELECT *, CASE WHEN starts_with(w, 'ال') THEN w[3:] ELSE w END AS bare FROM t)
SELECT entity_id, CASE WHEN bare IN ('قسم', 'باب', 'جزء', 'فصل', 'فرع', 'مادة') THEN bare ELSE w END AS known, bare FROM b""",
    "entity_hash": "SELECT entity_id, type || '_' || substr(sha1(normalized), 1, 8) AS made_id FROM entities WHERE normalized IS NOT NULL",
    "html_escape": """SELECT article_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM articles WHERE title IS NOT NULL""",
    "law_hints": rf"""
WITH t AS (SELECT article_id, nullif(regexp_extract(text, 'من ([^\n]+)', 1), '') AS raw FROM articles), n AS (SELECT article_id, regexp_replace(raw, '^{_S}+|{_S}+$', '', 'g') AS name FROM t)
SELECT article_id, name, {_canonical_sql('name')} AS number FROM n WHERE name IS NOT NULL""",
    "marker_strip": "SELECT entity_id, 'قبل ' || regexp_replace(text, '[,<>]', '', 'g') || ' بعد' AS text FROM entities",
    "marker_roundtrip": "SELECT doc_id FROM documents WHERE false",
    "char_chunks": """
SELECT doc_id, CAST(o / 400 AS INT) AS chunk, CAST(o AS INT) AS "offset", substr(text, o + 1, 400) AS chunk_text
FROM documents, LATERAL (SELECT unnest(range(0, CAST(length(text) AS BIGINT), 400)) AS o) WHERE length(text) > 0""",
    "message_cost": "SELECT doc_id, 2 + 8 + length('system') + length('user') + length('You are an expert.') + length('Structure:') + 1 + length(text) + 1 + length('<--- END') AS cost FROM documents WHERE text IS NOT NULL",
    "model_limits": """
SELECT n_nationkey, (['gpt-4o-mini', 'gpt-3.5-turbo', 'gpt-3.5-turbo-16k', 'gpt-4', 'other'])[n_nationkey % 5 + 1] AS model,
  ([128000, 4096, 16384, 8192, 16384])[n_nationkey % 5 + 1] AS context, ([4000, 3000, 12000, 4000, 12000])[n_nationkey % 5 + 1] AS completion FROM nation""",
}
