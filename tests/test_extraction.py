import json

from pyspark.sql import functions as F

from raqim.operators.chunks import model_limits
from raqim.sources import extraction, files


def recorded(repair=extraction.REPAIR):
    def model(prompt):
        """Replies by what the last line of the chunk says."""
        asked = [line for line in prompt.split("\n")[:-1] if line][-1]
        if prompt.startswith(repair):
            return '{"result": [{"number": "mended"}]}' if "broken" in prompt or "[{" in prompt else "no"
        if "first" in asked:
            return 'Inherited context: type=باب, number=2, title="T"\n```json\n[{"number": 1}, {"number": 2}]\n```'
        if "second" in asked:
            return '[{"carried": %s, "before": %s}]' % (str("Inherited context" in prompt).lower(), str("first" in prompt.split("\n", 2)[-1]).lower())
        if "broken" in asked:
            return "[{"
        return "[]" if len(asked) > 8 else '{"half": "%s"}' % asked

    return model


def test_chunks_are_asked_in_order(spark):
    rows = [(1, 1, "second\n"), (1, 0, "first\n"), (1, 2, "broken"), (2, 0, "abcdefghijklmnop"), (3, 0, ""), (3, 1, None)]
    got = extraction.extract_nodes(spark.createDataFrame(rows, "doc_id bigint, chunk int, chunk_text string"), recorded(), "do", "END").collect()
    made = {d: [(r.chunk, r.in_type, json.loads(r.node)) for r in sorted(got, key=lambda r: r.idx) if r.doc_id == d] for d in (1, 2, 3)}
    assert made[1] == [(0, "باب", {"number": 1}), (0, "باب", {"number": 2}), (1, None, {"carried": True, "before": True}), (2, None, {"number": "mended"})]
    assert made[2] == [(0, None, {"half": "abcdefgh"}), (0, None, {"half": "ijklmnop"})] and made[3] == []


def test_outlines_and_budget(spark):
    rows = [(1, "xy"), (2, "broken"), (3, None), (4, "")]
    got = {r.doc_id: (json.loads(r.payload), r.ok) for r in extraction.extract_outlines(spark.createDataFrame(rows, "doc_id bigint, text string"), recorded(), "do", "END", 100).collect()}
    assert got == {1: ({"half": "xy"}, True), 2: ({"structure": [{"number": "mended"}]}, True)}
    limits = model_limits(F.lit("gpt-4o"))
    row = spark.range(1).select(limits.alias("l"), extraction.completion_budget(F.lit(10), limits).alias("a"), extraction.completion_budget(limits["context"] - 5, limits).alias("b"), extraction.completion_budget(limits["context"], limits).alias("c")).first()
    assert (row.a, row.b, row.c) == (row.l.completion, 5, None)


def test_all_kinds_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("نص", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"x": ["one", {"y": "two"}], "z": 3}', encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = files.read_documents(spark, str(tmp_path), lambda b: b.decode().lower())
    assert sorted((r.file_name, r.kind, r.text) for r in got.collect()) == [("a.txt", "text", "نص"), ("b.json", "json", "one\ntwo"), ("c.pdf", "pdf", "%pdf")]
