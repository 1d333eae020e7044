import json

from pyspark.sql import functions as F

from raqim.operators import documents, mentions


def test_leaf_text(spark):
    value = {"preamble": "a", "number": 3, "chapters": [{"articles": [{"text": "b"}, {"text": ""}]}, None], "nested": {"inner": "c"}}
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, "{"), (3, None), (4, "")], "record_id bigint, payload string")
    assert {r.record_id: r.text for r in documents.json_leaf_text(rows).collect()} == {1: "a\nb\nc", 2: None, 3: None, 4: None}
    assert documents.change_strings(value, str.upper)["nested"] == {"inner": "C"}


def test_nodes(spark):
    schema = "doc bigint, pos int, type string, number string, text string"
    nodes = spark.createDataFrame([(1, 0, "الباب", "الأول", "x 5"), (1, 1, "المادة", "٠٣", ""), (1, 2, "ملحق", "A", None)], schema)
    got = [tuple(r)[2:] for r in documents.finalize_nodes(nodes).orderBy("pos").collect()]
    assert got == [("باب", "1", "5"), ("مادة", "3", None), ("ملحق", "A", None)] or got[1:] == [("مادة", "3", None), ("ملحق", "A", None)]
    found = spark.createDataFrame([(1, 2, 0, "المادة", "٠٣", "second"), (1, 1, 0, "المادة", "٠٣", "first"), (1, 1, 1, "المادة", "9", "none")], "doc bigint, chunk int, pos int, type string, number string, text string")
    assert documents.merge_chunk_texts(nodes, found).where("pos = 1").first().text == "first\nsecond"


def test_sections(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "k int, facts array<string>, decision array<string>")
    assert [(r.section, r.idx, r.text) for r in documents.sections(df, "k", ("facts", "decision")).collect()] == [("facts", 0, "a"), ("facts", 1, "b")]
    row = df.select(documents.add_entry(F.col("decision"), F.lit("x")).alias("a"), documents.delete_entry(F.col("facts"), 0).alias("d")).first()
    assert row.a == ["x"] and row.d == ["b"]


def test_chain_after_extraction(spark):
    text = "المادة 4 من القانون رقم 29.11 ومن 7 إلى 9"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    ent = spark.createDataFrame([(1, 0, 1, "1", "LAW", "القانون رقم 29.11", 0, 17, None), (1, 1, 2, "2", "ARTICLE", "المادة 4", 0, 8, None)], "document_id bigint, ord int, entity_id bigint, ent_id string, type string, text string, start_char int, end_char int, normalized string")
    rel = spark.createDataFrame([(1, 0, "1", "refers_to", "2", "1")], "document_id bigint, ord int, relation_id string, type string, source_id string, target_id string")
    out, told = mentions.postprocess(docs, ent, rel)
    got = {r.normalized: r.global_id for r in out.collect()}
    assert got["القانون 29.11"] == "LAW_29.11" and got["4 المادة"] == "LAW_29.11_ART_4" and "8 الفصل" in got and "7 الفصل" not in got
    assert out.where("type = 'LAW'").first().start_char == text.index("القانون")
    kept, _ = mentions.postprocess(docs, ent, rel, parity=False)
    assert {"7 الفصل", "8 الفصل", "9 الفصل"} <= {r.normalized for r in kept.collect()}


def test_marked_records(spark):
    rows = spark.createDataFrame([(1, 7, '{"t": "القانون هنا", "n": [3, {"x": "لا"}]}'), (2, 8, "none"), (3, 7, None)], "record_id bigint, document_id bigint, payload string")
    entities = spark.createDataFrame([(7, 0, "4", "القانون"), (7, 1, "5", ""), (9, 0, "1", "x")], "document_id bigint, ord int, ent_id string, text string")
    got = {r.record_id: r.payload for r in documents.annotate_records(rows, entities).collect()}
    assert got == {1: '{"t":"<القانون, id:4> هنا","n":[3,{"x":"لا"}]}', 2: "none", 3: None}
