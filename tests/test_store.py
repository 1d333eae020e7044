import random

import pytest
from pyspark.sql import functions as F

from raqim.operators import graph, mentions, references, spans, sql, store
from raqim.sources import files
from raqim.streaming.imports import FILES, Versions, import_stream, sync

ENT = "document_id bigint, ord int, entity_id bigint, ent_id string, type string, text string, start_char int, end_char int, normalized string"
REL = "document_id bigint, ord int, relation_id string, type string, source_id string, target_id string"


def test_global_ids(spark):
    e = spark.createDataFrame([(1, 0, 1, "1", "ARTICLE", "المادة 7", 0, 8, None), (1, 1, 2, "2", "LAW", "القانون رقم 37.22", 9, 20, None), (2, 0, 3, "1", "ARTICLE", "المادة 5", 0, 8, None), (2, 1, 4, "9", "PERSON", "محمد", -1, -1, None)], ENT)
    r = spark.createDataFrame([(1, 0, "1", "refers_to", "1", "2"), (2, 0, "1", "refers_to", "1", "77")], REL)
    got = {(x.document_id, x.ord): x.global_id for x in mentions.global_ids(e, r).collect()}
    assert got[1, 0] == "LAW_37.22_ART_7" and got[1, 1] == "LAW_37.22" and got[2, 0] == "ART_5" and got[2, 1].startswith("PERSON_")


def test_ids_and_edges(spark):
    e = spark.createDataFrame([(1, 0, 1, "E3", "LAW", "a", 0, 1, None), (1, 1, 2, "E3", "LAW", "b", 0, 1, None), (1, 2, 3, "4", "LAW", "c", 0, 1, None)], ENT)
    r = spark.createDataFrame([(1, 0, "1", "refers_to", "E3", "4"), (1, 1, "2", "refers_to", "E3", "none"), (1, 2, "3", "x", None, "4")], REL)
    _, renamed = mentions.numeric_ids(e, r)
    assert sorted((x.source_id, x.target_id) for x in renamed.where("source_id IS NOT NULL").collect()) == [("2", "3"), ("2", "none")]
    assert [(x.source, x.target) for x in graph.edges_of(e, r).collect()] == [(2, 3)]
    tip = graph.relation_tooltips(e, r).first()
    assert tip.tooltip == "يشير إلى c<br/>يشير إلى " and tip.targets == "4,none"


def test_graphml(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, 1, "1", "LAW", "a & b", 0, 1, None), (1, 1, 2, "2", "LAW", "c", 0, 1, None)], ENT)
    graph.write_graphml(e, spark.createDataFrame([(1, 0, "1", "refers_to", "1", "2")], REL), str(tmp_path / "g.xml"))
    import xml.dom.minidom

    whole = "".join(p.read_text() for p in sorted((tmp_path / "g.xml").glob("part-*.txt")))
    assert len(xml.dom.minidom.parseString(whole).getElementsByTagName("node")) == 2
    files.html_lines(e).collect()
    assert files.to_html(e.select("text")) == "<table>\n<tr><th>text</th></tr>\n<tr><td>a &amp; b</td></tr>\n<tr><td>c</td></tr>\n</table>"
    assert files.to_csv(e.select("text", "normalized")) == "text,normalized\na & b,\nc,\n"


def test_a_law_is_found_by_its_names(spark):
    documents = spark.createDataFrame([(1, None, None, "Loi des Baux", "x.json"), (2, "9.9", None, "Code", "baux_2.json"), (3, None, None, None, "y.json")], "doc_id bigint, doc_number string, law_number string, short_title string, file_name string")
    articles = spark.createDataFrame([(d, 10 * d + n, str(n)) for d in (1, 2, 3) for n in (1, 2)], "document_id bigint, article_id bigint, number string")
    asked = [(1, "7", "1", ["baux", "zz"]), (2, None, "2", ["code"]), (3, "9.9", "1", ["loi"]), (4, "json", "2", None), (5, None, "1", ["z"]), (6, None, "1", [None]), (7, None, "1", ["x."])]
    got = references.article_cascade(spark.createDataFrame(asked, "req_id bigint, law string, article string, names array<string>"), documents, articles)
    found = {}
    for r in got.orderBy("req_id", "place").collect():
        found.setdefault(r.req_id, []).append((r.stage, r.doc_id))
    assert found == {1: [(3, 2), (3, 1)], 2: [(3, 2)], 3: [(1, 2)], 4: [(2, 2), (2, 1), (2, 3)], 5: [(4, 2), (4, 1), (4, 3)], 6: [(4, 2), (4, 1), (4, 3)], 7: [(3, 1)]}


def test_popups(spark):
    e = spark.createDataFrame([(1, 0, 1, "1", "ARTICLE", "الفصل 5", 0, 1, None), (1, 1, 2, "2", "LAW", "القانون رقم 3.4", 0, 1, None), (1, 2, 3, "3", "INTERNAL_REF", "5-6", 0, 1, None), (1, 3, 4, "4", "ARTICLE", "الفصل 6", 0, 1, None), (1, 4, 5, "5", "ARTICLE", "الفصل 9", 0, 1, None)], ENT)
    r = spark.createDataFrame([(1, 0, "1", "refers_to", "1", "2"), (1, 1, "2", "refers_to", "3", "1"), (1, 2, "3", "refers_to", "3", "4")], REL)
    laws = spark.createDataFrame([("1.1", "5", "other"), ("3.4", "5", "of the law"), ("1.1", "6", "first")], "law string, number string, text string")
    texts = spark.createDataFrame([(1, "6", "own")], "document_id bigint, number string, text string")
    got = {x.ent_id: x.popup for x in references.article_popups(e, r, laws, texts).collect()}
    assert [tuple(x) for x in graph.reference_law(e, r.union(spark.createDataFrame([(1, 3, "4", "refers_to", "3", "2"), (1, 4, "5", "refers_to", "2", "3")], REL))).collect()] == [(1, "3", "3.4")]
    assert got == {"1": "الفصل 5\nof the law", "4": "الفصل 6\nown", "3": "الفصل 5\nof the law\n\nالفصل 6\nown"}


def test_law_number_of_a_reference(spark):
    schema = "file_name string, short_title string, official_title string, doc_type string, doc_number string, source_rank int, references array<struct<type:string,number:string>>"
    rows = [("a", None, "القانون رقم 1.2", None, None, 0, [("قانون", "3")]), ("b", None, None, None, None, 0, [("مرسوم", "4"), ("القانون", "5"), ("قانون", "6")]), ("c", None, None, None, None, 0, None), ("d", None, None, None, None, 0, [])]
    assert {r.file_name: r.law_number for r in store.document_rows(spark.createDataFrame(rows, schema)).collect()} == {"a": "1.2", "b": "5", "c": None, "d": None}


def test_offsets_are_found_in_order(spark):
    assert spans.find_in_order("Le Juge et le juge", ["juge", "LE", "juge", None, "zz", "et"]) == [(3, 7), (11, 13), (14, 18), (-1, -1), (-1, -1), (8, 10)]
    docs = spark.createDataFrame([(1, "ab AB"), (2, None)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, 0, "ab", None, None), (1, 1, "ab", None, None), (2, 0, "x", 0, 1)], "document_id bigint, ord int, text string, start_char int, end_char int")
    placed = spans.load_offsets(e, docs)
    assert sorted(tuple(r) for r in placed.collect()) == [(1, 0, 0, 2), (1, 1, 3, 5), (2, 0, -1, -1)]
    moved = e.drop("start_char", "end_char").join(placed, ["document_id", "ord"])
    assert sorted((r.document_id, r.ord, r.text) for r in spans.save_texts(moved, docs).collect()) == [(1, 0, "ab"), (1, 1, "AB"), (2, 0, "x")]


def test_placing_equals_a_plain_search():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab ") for _ in range(40))
        asked = [(a, a + n, text[b : b + n]) for a, b, n in ((rng.randrange(-1, 40), rng.randrange(38), rng.randrange(0, 4)) for _ in range(12))]
        used, plain = [], []
        for a, b, w in asked:
            if a < 0 or not w:
                plain.append((a, b))
                continue
            free = lambda x: all(x + len(w) <= p or q <= x for p, q in used)  # noqa: B023
            places = sorted((x for x in range(len(text)) if text.startswith(w, x)), key=lambda x: (abs(x - a) > 50, abs(x - a)))
            best = a if text[a:b] == w and free(a) else next((x for x in places if free(x)), None)
            plain.append((a, b) if best is None else (best, best + len(w)))
            used.append(plain[-1])
        assert spans.place_spans(text, asked) == plain


def test_spans():
    assert spans.place_spans("ab ab ab", [(0, 2, "ab"), (1, 3, "ab"), (-1, -1, "ab"), (5, 7, "zz")]) == [(0, 2), (3, 5), (-1, -1), (5, 7)]


def test_edit_of_spans(spark):
    rows = spark.createDataFrame([(1, "1", "T", "x", a, b, None) for a, b in ((0, 3), (2, 6), (5, 8), (7, 12), (10, 12))], "document_id bigint, id string, type string, text string, start_char int, end_char int, normalized string")
    got = sorted((r.start_char, r.end_char) for r in spans.shift_spans(rows, F.lit(5), F.lit(9), F.lit("!")).collect())
    assert got == [(0, 3), (2, 5), (7, 9)]
    body = spark.createDataFrame([(1, "0123456789abc")], "document_id bigint, text string")
    assert spans.add_span(rows, 1, 0, 2, "LAW", body).where("type = 'LAW'").select("id", "text").first() == ("2", "01")
    assert spans.add_span(rows, 1, 5, 99, "LAW", body).count() == 5
    assert spans.update_span(rows, 1, "1", type="X").where("type = 'X'").count() == 5 and spans.delete_span(rows, 1, "1").count() == 0
    with pytest.raises(KeyError):
        spans.update_span(rows, 1, "none", type="X")


def test_article_hits(spark):
    d = spark.createDataFrame([(1, "1.1", "1.1", "t", "f"), (2, None, "2.2", "القانون 1.1", "g"), (3, "3.3", None, None, None)], "doc_id bigint, doc_number string, law_number string, short_title string, file_name string")
    a = spark.createDataFrame([(1, 10, 0, "المادة 5", "x"), (2, 20, 0, "5", "y"), (3, 30, 0, "5", "z"), (3, 31, 0, None, "z")], "document_id bigint, article_id bigint, pos int, number string, text string")
    q = spark.createDataFrame([(1, "1.1", "5"), (2, "9.9", "5"), (3, "2.2", "٥"), (4, None, "5"), (5, "1.1", None)], "req_id bigint, law string, article string")
    hits = sorted((r.req_id, r.place, r.article_id, r.stage) for r in references.article_hits(q, d, a, 2).collect())
    assert hits[:3] == [(1, 1, 10, 1), (1, 2, 30, 2), (1, 3, 20, 2)] and [h for h in hits if h[0] == 2] == [(2, 1, 10, 2), (2, 2, 30, 2)]
    got = sorted((r.req_id, r.article_id, r.stage) for r in references.article_cascade(q, d, a).collect())
    assert got == [(1, 10, 1), (2, 10, 4), (2, 20, 4), (2, 30, 4), (3, 20, 1), (4, 10, 4), (4, 20, 4), (4, 30, 4)]


def test_import_twice_is_import_once(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "file_name string, v int")
    batch = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "file_name string, v int")
    once = store.upsert(current, batch, ("file_name",), ("v",))
    twice = store.upsert(once, batch, ("file_name",), ("v",))
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 4), ("c", 5)] == sorted(map(tuple, twice.collect()))


def test_upsert_documents_takes_all(spark, tmp_path):
    from raqim.plans.store_queries import upsert_documents

    rows = [(1, "a", "old", 1), (5, "a", "new", 3), (7, "b", "only", 2), (11, "c", "x", None), (12, "c", "y", 1), (13, "d", "p", 4), (14, "d", "q", 4)]
    spark.createDataFrame(rows, "doc_id bigint, file_name string, short_title string, created_at bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in upsert_documents(spark, str(tmp_path)).collect()) == [5, 7, 12, 14]


def test_sql_only_reads(spark):
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("t")
    assert sql.query(spark, "SELECT id FROM t WHERE id = :x", x=1).first().id == 1
    assert sql.query(spark, "WITH a AS (SELECT 1 AS id) SELECT * FROM a").count() == 1
    for bad in ("DROP VIEW t", "CREATE TABLE z (i int)", "INSERT INTO t VALUES (1)", "SET a = b"):
        with pytest.raises(ValueError):
            sql.query(spark, bad)


def test_stream_and_sync(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"a": 1}', encoding="utf-8")
    (source / "b.txt").write_text("not this", encoding="utf-8")
    held = Versions(spark, str(tmp_path / "store"), FILES)
    import_stream(spark, str(source), held, str(tmp_path / "at")).awaitTermination()
    assert [r.text for r in held.read().collect()] == ['{"a": 1}']
    (source / "c.json").write_text("{}", encoding="utf-8")
    import_stream(spark, str(source), held, str(tmp_path / "at")).awaitTermination()
    assert held.read().count() == 2 and sync(spark, str(source), held) == 0
    before = held.current()
    later = spark.createDataFrame([("c.json", "2999-01-01 00:00:00", "later"), ("c.json", "2998-01-01 00:00:00", "sooner")], "file_name string, modified string, text string").withColumn("modified", F.to_timestamp("modified"))
    held.merge(later, ("modified", "text"))
    held.merge(later, ("modified", "text"))
    assert sorted(r.text for r in held.read().collect()) == ["later", '{"a": 1}']
    assert sum(v == held.current()[b] for b, v in before.items()) == len(before) - 1  # other buckets stay as they are
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v-")]) <= 3
    held.merge(later.limit(0), ("modified", "text"))


def test_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": "ع"}', encoding="utf-8")
    (tmp_path / "y.json").write_text('{"a": ', encoding="utf-8")
    good, bad = files.read_json_objects(spark, str(tmp_path))
    assert [r.file_name for r in good.collect()] == ["x.json"] and [r.file_name for r in bad.collect()] == ["y.json"]
    files.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "csv"), ["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"]
    reply = files.ask(spark.createDataFrame([(1, "q"), (2, None)], "k int, t string"), F.col("t"), files.recorded({"q": "r"}), "k")
    assert sorted(map(tuple, reply.collect())) == [(1, "r"), (2, None)]
    with pytest.raises(ValueError):
        files.read_pdfs(spark, str(tmp_path))
    store.init_store(spark, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "entities")).count() == 0
