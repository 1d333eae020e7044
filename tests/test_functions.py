import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raqim.functions import markers, numbers, text
from raqim.operators.mentions import article_references, expand_references, normal_form


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "value, expected",
    [("المادة ١٥", "15"), ("رقم 1.06.169", "1.06.169"), ("1..06", "1.06"), ("12/ 3", "12/3"), ("بلا", None), ("", None), (None, None), ("07", "07")],
)
def test_canonical_num(spark, value, expected):
    assert one(spark, value, numbers.canonical_num) == expected


@pytest.mark.parametrize("value, expected", [("المادة 4 من القانون التنظيمي رقم 29.11", "29.11"), ("المادة 15 القانون 30.09", "30.09"), ("القانون 30.09 و 31.10", "30.09"), (None, None)])
def test_law_number(spark, value, expected):
    assert one(spark, value, numbers.law_number) == expected


def test_law_article(spark):
    row = spark.createDataFrame([("المادة 15 القانون 30.09", None), ("", "المادة 15 من القانون 30.09"), (None, "القانون 30.09")], "n string, t string")
    got = [r.x and (r.x.article, r.x.law) for r in row.select(numbers.law_article(F.col("n"), F.col("t")).alias("x")).collect()]
    assert got == [("15", "30.09"), ("15", "30.09"), None]


@pytest.mark.parametrize("value, expected", [("الفصل ٠٧", "7"), ("الثالث عشر", "13"), ("تمهيدي", "0"), ("x", "x"), (None, None)])
def test_clean_number(spark, value, expected):
    assert one(spark, value, numbers.clean_number) == expected


@pytest.mark.parametrize("value, expected", [("812", "12"), ("81", "81"), ("712", "712"), (None, None)])
def test_stray_digit(spark, value, expected):
    assert one(spark, value, numbers.drop_stray_digit) == expected


@pytest.mark.parametrize("value, expected", [("12 يونيو 2025", "2025-06-12"), ("٣ غشت ٢٠١١", "2011-08-03"), ("2020-02-29", "2020-02-29"), ("31/02/2020", None), ("5/3/2021", "2021-03-05"), ("", None), (None, None)])
def test_dates(spark, value, expected):
    assert one(spark, value, text.parse_date) == expected


@pytest.mark.parametrize("value, expected", [("القاضية فاطمة", "قاضي فاطمة"), ("المحاكمات", "محاكمة"), ("  المهندسون ", "مهندس"), ("ال", "ال"), ("", "")])
def test_arabic(spark, value, expected):
    assert one(spark, value, text.normalize_arabic) == expected


def test_cleaning(spark):
    assert one(spark, "وزارة العدل\n- 12 -\nنص\n3 - حاشية\n", text.clean_ocr_lines) == "نص\n"
    assert one(spark, "abc نص\n 7 \nوزارة العدل آخر", text.clean_text) == "نص\n آخر"
    assert one(spark, "ا\n \n\nب\n\n", text.paragraphs) == ["ا", "ب"]
    assert one(spark, "```json\n{}\n```", text.remove_code_fences) == "{}"
    assert one(spark, '<a href="x">\'&', text.html_escape) == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"
    assert one(spark, r'{"a": "\u12"}', text.escape_bad_unicode) == r'{"a": "\\u12"}'
    got = one(spark, 'Inherited context: type=الباب, number=2, title="ع"\n[]', text.inherited_fields)
    assert tuple(got) == ("الباب", "2", "ع", "[]")


@pytest.mark.parametrize(
    "kind, value, expected",
    [
        ("LAW", "المادة 4 من القانون التنظيمي رقم 29.11", "المادة 4 القانون التنظيمي 29.11"),
        ("LAW", "المادة 15 من القانون 30.09", "المادة 15 القانون 30.09"),
        ("LAW", "القانون رقم 30.06 الصادر بالظهير الشريف رقم 1.06.169", "القانون 30.06 الظهير الشريف 1.06.169"),
        ("ARTICLE", "المادة ٧", "7 المادة"), ("ARTICLE", "الفصول 1 و 03", "الفصل 1_3"), ("CASE", "ملف عدد 12/2020", "12/2020"), ("DATE", "3 غشت 2011", "2011-08-03"), ("COURT", "المحكمة", "محكمة"),
    ],
)
def test_normal_forms(spark, kind, value, expected):
    row = spark.createDataFrame([(kind, value, None)], "k string, t string, n string")
    assert row.select(normal_form(F.col("k"), F.col("t"), F.col("n")).alias("x")).first().x == expected


def test_ranges_and_lists(spark):
    text = "من 12 إلى ٩ ثم الفصول: 1، 3 و4"
    assert [(g[0], g[3], g[4], g[5]) for g in article_references(text)] == [("range", "الفصل 9-12", 9, 12)] + [("list", "الفصل 1_3_4", n, n) for n in (1, 3, 4)]
    rows = [(1, text), (2, "من 1 إلى 20000"), (3, "من 5 إلى 5"), (4, None), (5, ""), (6, "من 1 إلى 99999999999999999999999")]
    got = expand_references(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((g.number, g.number_start) for g in got if g.document_id == 1) == [(1, 23), (3, 26), (4, 29), (9, 10), (10, -1), (11, -1), (12, 3)]
    assert sorted(g.number for g in got if g.document_id == 2) == list(range(1, 20_001))
    assert [(g.number, g.number_start) for g in got if g.document_id == 3] == [(5, 9)] and {g.document_id for g in got} == {1, 2, 3}


def test_brackets_are_inserted_once_and_never_inside_each_other():
    entities = [{"text": "القانون 30.09", "id": "1"}, {"text": "القانون", "id": "2"}, {"text": "القانون 30.09", "id": "1"}, {"text": "", "id": "3"}]
    got = markers.insert_brackets("القانون 30.09 والقانون 30.09", entities)
    assert got == "<القانون 30.09, id:1> و<القانون 30.09, id:1>"
    assert markers.insert_brackets(None, entities) is None and markers.highlight("a<b", []) == "a&lt;b"
    assert markers.highlight("ab abc", [{"text": "ab"}, {"text": "abc"}]) == "<mark>ab</mark> <mark>abc</mark>"


def test_spans_are_found_again_near_their_place():
    got = markers.render_spans("xx قانون yy", [{"id": "1", "type": "LAW", "text": "قانون", "start_char": 0, "end_char": 5, "normalized": None}])
    assert got == 'xx <span class="entity" id="entity-1" title="LAW">قانون</span> yy'


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ]\"نص", max_size=40), st.integers(0, 5))
def test_marked_text_is_read_back(body, n):
    rng = random.Random(len(body) * 7 + n)
    cuts = sorted(rng.sample(range(len(body) + 1), min(len(body), 2 * n) // 2 * 2))
    spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if "]" not in body[a:b]]
    marked, at = "", 0
    for a, b in spans:
        marked += body[at:a] + f'[[ENT id=1 type=LAW norm="x"]]{body[a:b]}[[/ENT]]'
        at = b
    got = markers.read_marked(marked + body[at:])
    assert got["text"] == body and [(s["start_char"], s["end_char"]) for s in got["spans"]] == spans


def test_strip_markers(spark):
    assert one(spark, "قبل <نص, id:4> بعد", markers.strip_markers) == "قبل نص بعد"
    assert re.search("id:", one(spark, "a < b, id: c", markers.strip_markers))
