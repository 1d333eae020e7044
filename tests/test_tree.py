import random

import pytest
from pyspark.sql import functions as F

from raqim.operators import tree
from raqim.operators.lineage import cut, drop_cuts

SCHEMA = "doc bigint, pos int, type string, number string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SCHEMA)


def built(df):
    return tree.build_hierarchy(df, tree.rank_of(F.col("type")))


def parents(df):
    return {r.pos: r.parent_pos for r in df.collect()}


def test_branches_nest(spark):
    types = ["قسم", "باب", "فرع", "مادة", "مادة", "فرع", "مادة", "فرع", "مادة"]
    assert parents(built(frame(spark, [(t, "1", "") for t in types]))) == {0: None, 1: 0, 2: 1, 3: 2, 4: 2, 5: 1, 6: 5, 7: 1, 8: 7}


def test_parents_equal_a_stack(spark):
    rng = random.Random(3)
    types = list(tree.RANK)
    rows = [(d, i, rng.choice(types), "1", "") for d in range(40) for i in range(25)]
    got = {(r.doc, r.pos): r.parent_pos for r in built(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d in range(40):
        stack = []
        for _, i, t, *_ in [r for r in rows if r[0] == d]:
            while stack and stack[-1][0] >= tree.RANK[t]:
                stack.pop()
            assert got[d, i] == (stack[-1][1] if stack else None)
            stack.append((tree.RANK[t], i))


def test_monotone_articles(spark):
    kept = tree.monotone_articles(frame(spark, [("مادة", n, t) for n, t in (("50", "a"), ("65", "early"), ("51", "b"), ("65", "late"), ("x", ""))]))
    assert sorted((r.number, r.pos, r.text) for r in kept.collect()) == [("50", 0, "a"), ("51", 2, "b"), ("65", 3, "early")]
    longest = tree.deduplicate_articles(frame(spark, [("مادة", "1", "old"), ("مادة", "1", "new and improved"), ("مادة", "2", None)]))
    assert sorted((r.number, r.pos, r.text) for r in longest.collect()) == [("1", 0, "new and improved"), ("2", 2, "")]


def test_duplicates_merge_with_their_children(spark):
    rows = [("قسم", "1", ""), ("باب", "1", "x"), ("مادة", "1", "a"), ("باب", "1", "y"), ("مادة", "2", "b"), ("باب", "1", "x")]
    got = {r.pos: (r.parent_pos, r.text) for r in tree.merge_duplicates(tree.with_depth(built(frame(spark, rows)), 6), levels=6).collect()}
    assert got == {0: (None, ""), 1: (0, "x\ny"), 2: (1, "a"), 4: (1, "b")}


def test_strays_attach(spark):
    rows = [("باب", "1", ""), ("فصل", "1", ""), ("مادة", "1", ""), ("باب", "2", ""), ("مادة", "2", "")]
    flat = frame(spark, rows).withColumn("parent_pos", F.lit(None).cast("int"))
    assert parents(tree.attach_strays(flat)) == {0: None, 1: 0, 2: 1, 3: None, 4: 3}


def test_prune_and_annex(spark):
    rows = [("قسم", "1", ""), ("مادة", "1", "a"), ("ملحق", "2", "b"), ("قسم", "foo", ""), ("مادة", "3", "c")]
    t = tree.with_depth(built(frame(spark, rows)).withColumn("title", F.lit("ع")), 6)
    assert sorted(r.pos for r in tree.prune_structure(t, levels=6).collect()) == [0, 1]
    assert [(r.pos, r.title, r.text) for r in tree.annexes(t, levels=6).collect()] == [(2, "ملحق 2 ع", "b")]


def test_gaps(spark):
    flat = frame(spark, [("مادة", n, "") for n in ("3", "5", "5", "x", "9", "5000")]).withColumn("parent_pos", F.lit(None).cast("int"))
    got = [(r.after_pos, r.number) for r in tree.fill_missing(flat, F.col("type") == "مادة").collect()]
    assert sorted(got, key=str) == sorted([(None, "1"), (None, "2"), (0, "4"), *((4, str(n)) for n in range(10, 5000))], key=str)


def test_depth_and_ancestors_of_any_tree(spark):
    rng = random.Random(1)
    rows = [(1, i, i - 1 if i else None, "باب") for i in range(70)] + [(2, i, rng.choice([None, *range(i)]), "باب") for i in range(60)] + [(3, 5, 4, "باب")]
    up = {(d, i): u for d, i, u, _ in rows}

    def chain(d, i):
        return chain(d, up[d, i]) + [up[d, i]] if up.get((d, i)) is not None else []

    df = spark.createDataFrame(rows, "doc bigint, pos int, parent_pos int, type string")
    for levels in (2, 8):
        deep = tree.with_depth(df, levels)
        assert {(r.doc, r.pos): r.depth for r in deep.collect()} == {k: len(chain(*k)) for k in up}
        known = {k: [p for p in chain(*k) if (k[0], p) in up] for k in up}
        assert {(r.doc, r.pos): [a.pos for a in r.ancestors] for r in tree.with_chain(df, levels, "type").collect()} == known
        line = deep.where("doc = 1")
        assert {r.pos: [a.pos for a in r.ancestors] for r in tree.with_ancestors(line, levels).collect()} == {i: list(range(i)) for i in range(70)}
    for ring in ([(1, 0, 1, "a"), (1, 1, 0, "a")], [(1, i, (i + 1) % 5, "a") for i in range(5)]):
        with pytest.raises(ValueError):
            tree.with_depth(spark.createDataFrame(ring, "doc bigint, pos int, parent_pos int, type string"), 2)


def test_post_process_and_empty(spark):
    rows = [("قسم", "1", ""), ("مادة", "1", "a"), ("مادة", "812", "b"), ("مادة", "1", "longer")]
    got = tree.post_process(built(frame(spark, rows)))
    assert sorted((r.type, r.number) for r in got.collect()) == [("قسم", "1"), ("مادة", "1"), ("مادة", "12")]
    empty = built(spark.createDataFrame([], SCHEMA))
    assert tree.post_process(empty).collect() == [] and tree.sort_children(empty).collect() == [] and tree.merge_duplicates(tree.with_depth(empty)).collect() == []


def test_renumbering_follows_the_tree(spark):
    rows = [(1, 0, None, "باب"), (1, 1, None, "فصل"), (1, 2, 1, "مادة"), (1, 3, 0, "مادة"), (2, 5, None, "باب")]
    df = spark.createDataFrame(rows, "doc bigint, pos int, parent_pos int, type string")
    got = sorted((r.doc, r.pos, r.parent_pos, r.type) for r in tree.renumber(df, 4).collect())
    assert got == [(1, 0, None, "باب"), (1, 1, 0, "مادة"), (1, 2, None, "فصل"), (1, 3, 2, "مادة"), (2, 0, None, "باب")]


def test_written_tables_can_be_dropped(spark):
    df = cut(spark.range(3))
    assert df.count() == 3 and drop_cuts(spark) >= 1 and drop_cuts(spark) == 0
