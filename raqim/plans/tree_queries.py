"""Queries of the tree operators, with their SQL.

Trees are made of ``entities``: the mentions of a document are its nodes in order, types and
numbers follow from the mention's key, equally in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raqim.functions.numbers import ascii_digits
from raqim.functions.vocabulary import RANK
from raqim.operators import tree
from raqim.operators.nested import node_table
from raqim.operators.store import articles_of
from raqim.plans.nested_queries import SQL as NESTED
from raqim.sources.tables import table

_TYPES = list(RANK)


def nodes(spark: SparkSession, d: str, unknown: bool = False) -> DataFrame:
    """(doc, pos, type, number, text); with ``unknown`` every thirteenth node is of a type that is none."""
    rows = table(spark, d, "entities", "document_id", "ord", "entity_id", "text")
    a, b = F.col("entity_id") * 13 % 101, F.col("entity_id") * 17 % 97
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (a % 6 + 1).cast("int"))
    if unknown:
        kind = F.when(a % 13 == 0, "ملحق").otherwise(kind)
    number = F.when(b % 11 == 0, "أ").otherwise((b % 9 + 1).cast("string"))
    text = F.when(F.col("entity_id") % 3 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "entity_id"))
    return rows.select(F.col("document_id").alias("doc"), pos.alias("pos"), kind.alias("type"), number.alias("number"), text.alias("text"))


def _built(spark: SparkSession, d: str, unknown: bool = False) -> DataFrame:
    return tree.build_hierarchy(nodes(spark, d, unknown), tree.rank_of(F.col("type")))


def hierarchy_parent(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).select("doc", "pos", "parent_pos")


def hierarchy_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The older profile: ranks compacted to the types present."""
    from raqim.functions.vocabulary import LEGACY_RANK

    rank = F.coalesce(*[F.when(F.col("type") == t, r) for t, r in LEGACY_RANK.items()])
    ranked = nodes(spark, d).withColumn("rank", tree.compact_rank(rank))
    return tree.build_hierarchy(ranked, F.col("rank")).select("doc", "pos", F.col("rank").cast("int").alias("rank"), "parent_pos")


def node_depth(spark: SparkSession, d: str) -> DataFrame:
    return tree.with_depth(_built(spark, d), 6).select("doc", "pos", "depth")


def flatten_articles(spark: SparkSession, d: str) -> DataFrame:
    """A parent that is a فرع counts as an article here, so that there is something to flatten."""
    rows = tree.with_depth(_built(spark, d), 6)
    return tree.flatten_articles(rows, "فرع", 6).select("doc", "pos", "parent_pos")


def prune_structure(spark: SparkSession, d: str) -> DataFrame:
    return tree.prune_structure(tree.with_depth(_built(spark, d), 6), ("قسم", "باب", "جزء", "فصل", "مادة"), levels=6).select("doc", "pos")


def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return tree.merge_duplicates(tree.with_depth(_built(spark, d), 6), levels=6).select("doc", "pos", "parent_pos", "type", "number", "text")


def dedup_articles_monotone(spark: SparkSession, d: str) -> DataFrame:
    return tree.monotone_articles(nodes(spark, d), "مادة")


def dedup_articles(spark: SparkSession, d: str) -> DataFrame:
    return tree.deduplicate_articles(nodes(spark, d))


def attach_strays(spark: SparkSession, d: str) -> DataFrame:
    return tree.attach_strays(_built(spark, d).where("type <> 'قسم'").withColumn("parent_pos", F.lit(None).cast("int"))).select("doc", "pos", "parent_pos")


def sort_children(spark: SparkSession, d: str) -> DataFrame:
    return tree.sort_children(_built(spark, d)).select("doc", "pos", "ord")


def fill_missing_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).withColumn("parent_pos", F.lit(None).cast("int"))
    return tree.fill_missing(rows, F.col("type") == "مادة").select("doc", "after_pos", "number")


def fill_missing_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).withColumn("parent_pos", F.lit(None).cast("int"))
    return tree.fill_missing(rows, F.col("type") != "مادة").select("doc", "after_pos", "type", "number")


def drop_empty_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.drop_empty(_built(spark, d)).select("doc", "pos")


def annex_texts(spark: SparkSession, d: str) -> DataFrame:
    built = tree.build_hierarchy(nodes(spark, d, True).withColumn("title", F.lit(None).cast("string")), tree.rank_of(F.col("type")))
    return tree.annexes(tree.with_depth(built, 6), levels=6)


def keep_deepest(spark: SparkSession, d: str) -> DataFrame:
    return tree.keep_deepest(tree.with_depth(_built(spark, d), 6))


def post_processed(spark: SparkSession, d: str) -> DataFrame:
    return tree.post_process(_built(spark, d)).select("doc", "pos", "parent_pos", "type", "number")


def collected_articles(spark: SparkSession, d: str) -> DataFrame:
    return articles_of(nodes(spark, d), ("مادة", "فصل"))


def record_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(doc, pos, parent_pos, type, number, text) of the trees in the records as they came."""
    nodes = node_table(table(spark, d, "structure_records", "record_id", "payload"), fields=("type", "number", "text"))
    parent = F.when(F.col("parent_pos") >= 0, F.col("parent_pos"))
    return nodes.select(F.col("record_id").alias("doc"), "pos", parent.alias("parent_pos"), *[F.coalesce(f"node_{c}", F.lit("")).alias(c) for c in ("type", "number", "text")])


def record_depth(spark: SparkSession, d: str) -> DataFrame:
    return tree.with_depth(record_nodes(spark, d)).select("doc", "pos", "depth")


def record_merged(spark: SparkSession, d: str) -> DataFrame:
    return tree.merge_duplicates(tree.with_depth(record_nodes(spark, d))).select("doc", "pos", "parent_pos", "type", "number")


def record_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Articles inside what is no article, whatever the word for it: here the innermost type that records use."""
    return tree.flatten_articles(tree.with_depth(record_nodes(spark, d)), "الباب").select("doc", "pos", "parent_pos")


def record_pruned(spark: SparkSession, d: str) -> DataFrame:
    rows = record_nodes(spark, d).withColumn("number", ascii_digits(F.col("number")))
    return tree.prune_structure(tree.with_depth(rows), ("الجزء", "الباب", "Titre", "Chapitre"), "المادة").select("doc", "pos")


def record_strays(spark: SparkSession, d: str) -> DataFrame:
    """Strays at every level of the trees that ranks build, under the parents that stand."""
    return tree.attach_strays(_built(spark, d)).select("doc", "pos", "parent_pos")


QUERIES = {
    "record_depth": record_depth, "record_merge_duplicates": record_merged, "record_flatten": record_flattened, "record_prune": record_pruned, "attach_strays_nested": record_strays,
    "hierarchy_parent": hierarchy_parent, "hierarchy_legacy": hierarchy_legacy, "node_depth": node_depth, "flatten_articles": flatten_articles, "prune_structure": prune_structure,
    "merge_duplicates": merge_duplicates, "dedup_articles_monotone": dedup_articles_monotone, "dedup_articles": dedup_articles, "attach_strays": attach_strays,
    "sort_children": sort_children, "fill_missing_articles": fill_missing_articles, "fill_missing_sections": fill_missing_sections, "drop_empty_nodes": drop_empty_nodes,
    "annex_texts": annex_texts, "keep_deepest": keep_deepest, "post_process": post_processed, "collect_articles": collected_articles,
}

_KIND = "(['قسم', 'باب', 'جزء', 'فصل', 'فرع', 'مادة'])[entity_id * 13 % 101 % 6 + 1]"
_RANK = "CASE type " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in RANK.items()) + " END"


def _nodes(unknown: bool = False) -> str:
    kind = f"CASE WHEN entity_id * 13 % 101 % 13 = 0 THEN 'ملحق' ELSE {_KIND} END" if unknown else _KIND
    return f"""nodes AS (SELECT document_id AS doc, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord, entity_id) AS INT) AS pos, {kind} AS type,
  CASE WHEN entity_id * 17 % 97 % 11 = 0 THEN 'أ' ELSE CAST(entity_id * 17 % 97 % 9 + 1 AS VARCHAR) END AS number,
  CASE WHEN entity_id % 3 = 0 THEN '' ELSE coalesce(text, '') END AS text FROM entities)"""


def _tree(unknown: bool = False) -> str:
    """A parent is found by a correlated maximum, another way than the query's."""
    return f"""{_nodes(unknown)}, ranked AS (SELECT *, {_RANK} AS rank FROM nodes),
tree AS (SELECT n.doc, n.pos, n.type, n.number, n.text, max(p.pos) AS parent_pos FROM ranked n LEFT JOIN ranked p ON p.doc = n.doc AND p.pos < n.pos AND p.rank < n.rank GROUP BY ALL)"""


def _records() -> str:
    return f"""tree AS (SELECT record_id AS doc, pos, node_type AS type, node_number AS number, '' AS text, CASE WHEN parent_pos >= 0 THEN parent_pos END AS parent_pos FROM ({NESTED["p6_found"]}))"""


def _walk(unknown: bool = False, base: str | None = None) -> str:
    return f"""{base or _tree(unknown)}, walk AS (
  SELECT doc, pos, type, number, text, parent_pos, 0 AS depth, CAST([] AS STRUCT(pos INT, type VARCHAR, number VARCHAR)[]) AS up FROM tree WHERE parent_pos IS NULL
  UNION ALL SELECT t.doc, t.pos, t.type, t.number, t.text, t.parent_pos, w.depth + 1, list_append(w.up, struct_pack(pos := w.pos, type := w.type, number := w.number)) FROM tree t JOIN walk w ON t.doc = w.doc AND t.parent_pos = w.pos)"""


_MERGED = """, named AS (
  SELECT *, list_transform(up, lambda a: CASE WHEN a.type = 'مادة' THEN '#' || a.pos ELSE a.type || '/' || a.number END) AS above,
    CASE WHEN type = 'مادة' THEN '#' || pos ELSE type || '/' || number END AS own FROM walk),
ways AS (SELECT *, array_to_string(list_append(above, own), chr(9)) AS way, array_to_string(above, chr(9)) AS up_way FROM named),
kept AS (SELECT doc, way, any_value(up_way) AS up_way, min(pos) AS pos, any_value(type) AS type, any_value(number) AS number FROM ways GROUP BY ALL)
SELECT k.doc, k.pos, p.pos AS parent_pos, k.type, k.number FROM kept k LEFT JOIN kept p ON p.doc = k.doc AND p.way = k.up_way"""

SQL = {
    "record_depth": f"WITH RECURSIVE {_walk(base=_records())} SELECT doc, pos, depth FROM walk",
    "record_merge_duplicates": f"WITH RECURSIVE {_walk(base=_records())} {_MERGED}",
    "record_flatten": f"WITH RECURSIVE {_walk(base=_records())} SELECT doc, pos, (list_filter(up, lambda a: a.type <> 'الباب')[-1]).pos AS parent_pos FROM walk",
    "record_prune": f"""
WITH RECURSIVE {_records()}, good AS (SELECT * FROM tree WHERE type IN ('الجزء', 'الباب', 'Titre', 'Chapitre') AND regexp_full_match(trim(translate(number, '٠١٢٣٤٥٦٧٨٩', '0123456789')), '\\d*')),
walk AS (SELECT doc, pos FROM good WHERE parent_pos IS NULL UNION ALL SELECT g.doc, g.pos FROM good g JOIN walk w ON g.doc = w.doc AND g.parent_pos = w.pos)
SELECT doc, pos FROM walk""",
    "attach_strays_nested": f"""
WITH {_tree()}, s AS (SELECT doc, pos, parent_pos, CASE WHEN type <> 'مادة' THEN {_RANK} END AS rank FROM tree),
b AS (SELECT n.doc, n.pos, n.parent_pos, n.rank, coalesce(bool_or(p.rank < n.rank) FILTER (WHERE p.parent_pos IS NOT DISTINCT FROM n.parent_pos), false) AS deeper,
  coalesce(bool_or(p.rank IS NOT NULL) FILTER (WHERE p.parent_pos IS NOT DISTINCT FROM n.parent_pos), false) AS beside, max(p.pos) FILTER (WHERE p.rank IS NOT NULL) AS last
  FROM s n LEFT JOIN s p ON p.doc = n.doc AND p.pos < n.pos GROUP BY 1, 2, 3, 4)
SELECT b.doc, b.pos, CASE WHEN b.rank IS NULL AND b.beside THEN b.last WHEN b.deeper THEN max(h.pos) ELSE b.parent_pos END AS parent_pos
FROM b LEFT JOIN b h ON h.doc = b.doc AND h.pos < b.pos AND h.parent_pos IS NOT DISTINCT FROM b.parent_pos AND h.rank IS NOT NULL AND NOT h.deeper GROUP BY b.doc, b.pos, b.parent_pos, b.rank, b.last, b.deeper, b.beside""",
    "hierarchy_parent": f"WITH {_tree()} SELECT doc, pos, parent_pos FROM tree",
    "hierarchy_legacy": f"""
WITH {_nodes()}, r AS (SELECT *, CASE type WHEN 'قسم' THEN 0 WHEN 'جزء' THEN 0 WHEN 'باب' THEN 1 WHEN 'فصل' THEN 2 WHEN 'فرع' THEN 3 WHEN 'مادة' THEN 4 END AS old FROM nodes),
c AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY old) - 1 AS INT) AS rank FROM r)
SELECT n.doc, n.pos, n.rank, max(p.pos) AS parent_pos FROM c n LEFT JOIN c p ON p.doc = n.doc AND p.pos < n.pos AND p.rank < n.rank GROUP BY ALL""",
    "node_depth": f"WITH RECURSIVE {_walk()} SELECT doc, pos, depth FROM walk",
    "flatten_articles": f"WITH RECURSIVE {_walk()} SELECT doc, pos, (list_filter(up, lambda a: a.type <> 'فرع')[-1]).pos AS parent_pos FROM walk",
    "prune_structure": f"""
WITH RECURSIVE {_tree()}, good AS (SELECT * FROM tree WHERE type IN ('قسم', 'باب', 'جزء', 'فصل', 'مادة') AND regexp_full_match(trim(number), '\\d*')),
walk AS (SELECT doc, pos FROM good WHERE parent_pos IS NULL AND type <> 'مادة' UNION ALL SELECT g.doc, g.pos FROM good g JOIN walk w ON g.doc = w.doc AND g.parent_pos = w.pos)
SELECT doc, pos FROM walk""",
    "merge_duplicates": f"""
WITH RECURSIVE {_walk()}, named AS (
  SELECT *, list_transform(up, lambda a: CASE WHEN a.type = 'مادة' THEN '#' || a.pos ELSE a.type || '/' || a.number END) AS above,
    CASE WHEN type = 'مادة' THEN '#' || pos ELSE type || '/' || number END AS own FROM walk),
ways AS (SELECT *, array_to_string(list_append(above, own), chr(9)) AS way, array_to_string(above, chr(9)) AS up_way FROM named),
texts AS (SELECT doc, way, text, min(pos) AS first FROM ways WHERE text <> '' GROUP BY ALL),
joined AS (SELECT doc, way, string_agg(text, chr(10) ORDER BY first) AS text FROM texts GROUP BY ALL),
kept AS (SELECT doc, way, any_value(up_way) AS up_way, min(pos) AS pos, any_value(type) AS type, any_value(number) AS number FROM ways GROUP BY ALL)
SELECT k.doc, k.pos, p.pos AS parent_pos, k.type, k.number, coalesce(j.text, '') AS text FROM kept k LEFT JOIN kept p ON p.doc = k.doc AND p.way = k.up_way LEFT JOIN joined j ON j.doc = k.doc AND j.way = k.way""",
    "dedup_articles_monotone": f"""
WITH RECURSIVE {_nodes()}, a AS (SELECT doc, number, pos, text, dense_rank() OVER (PARTITION BY doc ORDER BY CAST(number AS INT)) AS nth FROM nodes WHERE type = 'مادة' AND number <> 'أ'),
pick AS (
  SELECT doc, CAST(0 AS BIGINT) AS nth, '' AS number, -1 AS pos FROM (SELECT DISTINCT doc FROM a)
  UNION ALL SELECT p.doc, p.nth + 1, n.number, coalesce(n.later, n.latest) FROM pick p JOIN LATERAL (
    SELECT any_value(number) AS number, min(pos) FILTER (WHERE pos > p.pos) AS later, max(pos) AS latest FROM a WHERE a.doc = p.doc AND a.nth = p.nth + 1 HAVING count(*) > 0) n ON true)
SELECT p.doc, p.number, p.pos, arg_max(a.text, (length(a.text), a.pos = p.pos, -a.pos)) AS text FROM pick p JOIN a ON a.doc = p.doc AND a.nth = p.nth WHERE p.nth > 0 GROUP BY ALL""",
    "dedup_articles": f"WITH {_nodes()} SELECT doc, number, min(pos) AS pos, arg_max(text, (length(text), -pos)) AS text FROM nodes WHERE type = 'مادة' GROUP BY ALL",
    "attach_strays": f"""
WITH {_nodes()}, s AS (SELECT doc, pos, CASE WHEN type <> 'مادة' THEN {_RANK} END AS rank FROM nodes WHERE type <> 'قسم'),
b AS (SELECT n.doc, n.pos, n.rank, coalesce(bool_or(p.rank < n.rank), false) AS deeper, max(p.pos) FILTER (WHERE p.rank IS NOT NULL) AS last FROM s n LEFT JOIN s p ON p.doc = n.doc AND p.pos < n.pos GROUP BY 1, 2, 3)
SELECT b.doc, b.pos, CASE WHEN b.rank IS NULL THEN b.last WHEN b.deeper THEN max(h.pos) END AS parent_pos
FROM b LEFT JOIN b h ON h.doc = b.doc AND h.pos < b.pos AND h.rank IS NOT NULL AND NOT h.deeper GROUP BY b.doc, b.pos, b.rank, b.last, b.deeper""",
    "sort_children": f"""
WITH {_tree()}, s AS (SELECT *, count(DISTINCT type) OVER (PARTITION BY doc, parent_pos) = 1 AS same FROM tree)
SELECT doc, pos, CAST(row_number() OVER (PARTITION BY doc, parent_pos ORDER BY CASE WHEN same THEN (TRY_CAST(number AS BIGINT) IS NULL)::INT END, CASE WHEN same THEN TRY_CAST(number AS BIGINT) END, CASE WHEN same THEN number END, pos) - 1 AS INT) AS ord FROM s""",
    "fill_missing_articles": f"""
WITH {_nodes()}, n AS (SELECT *, TRY_CAST(number AS BIGINT) AS n FROM nodes), l AS (SELECT *, lag(pos) OVER w AS p, lag(type) OVER w AS t, lag(n) OVER w AS m FROM n WINDOW w AS (PARTITION BY doc ORDER BY pos)),
g AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN t = type THEN m END AS start FROM l WHERE type = 'مادة')
SELECT doc, p AS after_pos, CAST(unnest(range(start + 1, n)) AS VARCHAR) AS number FROM g WHERE n > start + 1""",
    "fill_missing_sections": f"""
WITH {_nodes()}, n AS (SELECT *, TRY_CAST(number AS BIGINT) AS n FROM nodes), l AS (SELECT *, lag(pos) OVER w AS p, lag(type) OVER w AS t, lag(n) OVER w AS m FROM n WINDOW w AS (PARTITION BY doc ORDER BY pos)),
g AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN t = type THEN m END AS start FROM l WHERE type <> 'مادة')
SELECT doc, p AS after_pos, type, CAST(unnest(range(start + 1, n)) AS VARCHAR) AS number FROM g WHERE n > start + 1""",
    "drop_empty_nodes": f"WITH {_tree()} SELECT doc, pos FROM tree t WHERE type = 'مادة' OR text <> '' OR EXISTS (SELECT 1 FROM tree c WHERE c.doc = t.doc AND c.parent_pos = t.pos)",
    "annex_texts": f"""
WITH RECURSIVE {_walk(True)}, known AS (SELECT *, coalesce((list_filter(up, lambda a: a.type = 'ملحق')[1]).pos, CASE WHEN type = 'ملحق' THEN pos END) AS top FROM walk)
SELECT doc, top AS pos, max(CASE WHEN pos = top THEN type || ' ' || number END) AS title, string_agg(nullif(text, ''), chr(10) ORDER BY pos) AS text FROM known WHERE top IS NOT NULL GROUP BY doc, top""",
    "keep_deepest": f"""
WITH RECURSIVE {_walk()}, t AS (SELECT doc, type, number, text, min(pos) AS first FROM walk WHERE text <> '' GROUP BY ALL), j AS (SELECT doc, type, number, string_agg(text, chr(10) ORDER BY first) AS text FROM t GROUP BY ALL),
k AS (SELECT doc, type, number, arg_max(pos, (depth, length(text), -pos)) AS pos FROM walk GROUP BY ALL)
SELECT k.doc, k.type, k.number, k.pos, coalesce(j.text, '') AS text FROM k LEFT JOIN j USING (doc, type, number)""",
    "collect_articles": f"WITH {_nodes()} SELECT doc, pos, number, text FROM nodes WHERE type IN ('مادة', 'فصل') AND number <> 'أ' AND text <> ''",
}
