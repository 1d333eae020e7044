import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raqim.operators.nested import _read, broken_records, child_table, flat_records, flat_table, infer_paths, loads, node_table, written

KEY = "record_id bigint, payload string"


def brute(payload):
    out = []
    a, b = (payload or "").find("{"), (payload or "").rfind("}")
    try:
        top = json.loads(payload[a : b + 1])
    except (ValueError, TypeError):
        return out

    def walk(x, parent):
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return
        if isinstance(x, list):
            for y in x:
                walk(y, parent)
        elif isinstance(x, dict):
            pos = len(out)
            out.append((pos, parent, x.get("type"), None if x.get("number") is None else str(x["number"])))
            walk(x.get("children"), pos)

    walk(top.get("structure"), -1)
    return out


deep = {"type": "a", "number": 1}
for i in range(15):
    deep = {"type": f"t{i}", "number": i, "children": [deep, None, 0, "…", {"children": {"type": "one"}}]}
CASES = [
    json.dumps({"structure": [deep]}),
    "```json\n" + json.dumps({"structure": {"type": "x", "children": json.dumps([{"type": "y", "number": "٢"}, {"type": "z"}])}}) + "\n``` bye",
    json.dumps({"structure": [{"number": None, "type": " ب "}, {"children": []}, {"children": None}, {"children": ""}]}, ensure_ascii=False, indent=2),
    json.dumps({"structure": [json.dumps({"type": "text", "children": [{"type": "in"}]}), [{"type": "nested list"}]]}),
    json.dumps({"structure": [{"type": "cut", "children": [{"type": "off"}]}]})[:-6],
    json.dumps({"metadata": {}}),
    "",
    None,
    "no json",
]


def test_nodes_equal_a_recursive_walk(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), KEY)
    got = sorted((r.record_id, r.pos, r.parent_pos, r.node_type, r.node_number) for r in node_table(rows, fields=("type", "number")).collect())
    assert got == sorted((k, *n) for k, p in enumerate(CASES) for n in brute(p))


def test_empty_table_and_clashing_columns(spark):
    assert node_table(spark.createDataFrame([], KEY)).collect() == []
    rows = spark.createDataFrame([(1, CASES[1], 7, "x", "y")], KEY + ", pos int, path string, k string")
    assert node_table(rows, fields=("type",)).count() == 3


def test_child_tables_keep_ordinals(spark):
    record = json.dumps({"metadata": {"references": [{"type": "a"}, 3, {"type": "b", "number": 5}]}})
    got = child_table(spark.createDataFrame([(1, record), (2, "{}"), (3, None)], KEY), ("metadata", "references"), fields=("type", "number")).collect()
    assert [(r.record_id, r.ord1, r.type, r.number) for r in got] == [(1, 0, "a", None), (1, 1, "b", "5")]


def test_merged_schema(spark):
    got = {(r.path, r.kind): r.n for r in infer_paths(spark.createDataFrame(list(enumerate(CASES)), KEY)).collect()}
    assert got["$.structure", "array"] == 3 and got["$.structure", "object"] == 1
    assert got["$.structure[].type", "string"] >= 2


@pytest.mark.parametrize("number", [1, 10**18, "01"])
def test_numbers_as_written(spark, number):
    rows = spark.createDataFrame([(1, json.dumps({"structure": {"number": number}}))], KEY)
    assert node_table(rows).first().node_number == str(number)


def test_any_depth_and_size(spark):
    deep = '{"structure":[' + '{"type":"a","children":[' * 10_000 + '{"type":"z"}' + "]}" * 10_000 + "]}"
    wide = '{"structure":[' + ",".join(f'{{"type":"t{i}","text":"{"x" * 900}"}}' for i in range(50_000)) + "]}"
    got = node_table(spark.createDataFrame([(1, deep), (2, deep[:-2]), (3, wide), (4, None)], KEY), fields=("type",)).groupBy("record_id").agg({"pos": "count", "depth": "max"}).collect()
    assert {(r["record_id"], r["count(pos)"], r["max(depth)"]) for r in got} == {(1, 10_001, 10_000), (3, 50_000, 0)}


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.integers(0, 60))
def test_reading_without_recursion(value, cut_at):
    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1), json.dumps(value)[:cut_at], json.dumps(value) + "]"):
        try:
            whole = loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                _read(text)
        else:
            assert _read(text) == whole
            assert json.loads(written(whole) if isinstance(whole, (dict, list)) else "0") == (json.loads(text) if isinstance(whole, (dict, list)) else 0)


def test_broken_records_are_listed(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), KEY)
    assert {r.record_id for r in broken_records(rows).collect()} == {4, 8}


def test_every_array_is_a_table(spark):
    record = json.dumps({"id": 7, "meta": {"lang": "fr", "refs": [{"q": 1}, 5, {"q": 2}]}, "parts": [{"n": "a", "parts": {"n": "b", "parts": [{"n": "c"}]}}]})
    flat = flat_records(spark.createDataFrame([(1, record, "x"), (2, "{", "y")], KEY + ", path string"))
    got = sorted((r.path, r.id, r.parent_id, r.ord, r.fields) for r in flat.collect())
    assert got == sorted([
        ("$", 0, -1, 0, {"id": "7", "meta.lang": "fr"}), ("$.parts[]", 1, 0, 0, {"n": "a"}), ("$.parts[]*", 2, 1, 0, {"n": "b"}), ("$.parts[]*", 3, 2, 0, {"n": "c"}),
        ("$.meta.refs[]", 4, 0, 0, {"q": "1"}), ("$.meta.refs[]", 5, 0, 1, {"q": "2"}),
    ])
    assert [tuple(r) for r in flat_table(flat, "$.meta.refs[]", ["q"]).orderBy("id").collect()] == [(1, 4, 0, 0, "1"), (1, 5, 0, 1, "2")]
