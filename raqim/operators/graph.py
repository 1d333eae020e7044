"""The graph of entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raqim.functions.text import html_escape
from raqim.functions.vocabulary import RELATION_LABELS, lookup


def nodes_of(entities: DataFrame) -> DataFrame:
    """One row per (document_id, ent_id); of an id used twice the last counts."""
    return entities.groupBy("document_id", "ent_id").agg(F.max_by(F.struct("entity_id", "type", "text", "normalized"), F.struct("ord", "entity_id")).alias("e")).select("document_id", "ent_id", "e.*")


def edges_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ord, type, source, target) of relations both of whose ends are entities of the document."""
    nodes = nodes_of(entities).select("document_id", "ent_id", "entity_id")
    out = relations.select("document_id", "ord", "type", "source_id", "target_id")
    for end, name in (("source_id", "source"), ("target_id", "target")):
        out = out.join(nodes.select("document_id", F.col("ent_id").alias(end), F.col("entity_id").alias(name)), ["document_id", end])
    return out.select("document_id", "ord", "type", "source", "target")


def relation_tooltips(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, source_id, tooltip, targets): what each source is related to, in order; unknown targets as ''."""
    nodes = nodes_of(entities).select("document_id", F.col("ent_id").alias("target_id"), F.col("text").alias("target_text"))
    rows = relations.where("source_id IS NOT NULL").join(nodes, ["document_id", "target_id"], "left")
    says = F.concat(F.coalesce(lookup(RELATION_LABELS, F.col("type")), F.col("type"), F.lit("")), F.lit(" "), F.coalesce("target_text", F.lit("")))
    held = F.array_sort(F.collect_list(F.struct("ord", "relation_id", says.alias("says"), F.col("target_id"))))
    return rows.groupBy("document_id", "source_id").agg(held.alias("h")).select(
        "document_id", "source_id", F.array_join(F.transform("h", lambda x: x["says"]), "<br/>").alias("tooltip"), F.array_join(F.filter(F.transform("h", lambda x: x["target_id"]), lambda t: t.isNotNull()), ",").alias("targets")
    )


def neighbours(relations: DataFrame) -> DataFrame:
    """(document_id, node, other, ord): each relation in both directions."""
    rows = relations.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("document_id", "ord", "source_id", "target_id")
    ends = F.array(F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("other")))
    return rows.select("document_id", "ord", F.inline(ends))


def law_neighbours(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ent_id, laws): distinct law numbers next to each ARTICLE or INTERNAL_REF, in relation order."""
    from raqim.functions.numbers import law_number

    nodes = nodes_of(entities)
    laws = nodes.where("type IN ('LAW', 'DECRET', 'DAHIR', 'CONSTITUTION', 'DECREE', 'STATUTE')").select("document_id", F.col("ent_id").alias("other"), law_number(F.col("text")).alias("law")).where("law IS NOT NULL")
    asked = nodes.where("type IN ('ARTICLE', 'INTERNAL_REF')").select("document_id", F.col("ent_id").alias("node"))
    met = neighbours(relations).join(laws, ["document_id", "other"]).join(asked, ["document_id", "node"], "left_semi")
    first = met.groupBy("document_id", "node", "law").agg(F.min("ord").alias("ord"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("ord", "law"))), lambda x: x["law"])
    return first.groupBy("document_id", F.col("node").alias("ent_id")).agg(F.array_join(held, ",").alias("laws"))


def article_law(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ent_id, law): of each ARTICLE the law number of its first relation to a law, either way round."""
    met = law_neighbours(entities.where("type <> 'INTERNAL_REF'"), relations)
    return met.select("document_id", "ent_id", F.substring_index("laws", ",", 1).alias("law"))


def reference_law(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ent_id, law): of each INTERNAL_REF the number of the first law that it leads to, in the direction of the relation."""
    from raqim.functions.numbers import law_number

    nodes = nodes_of(entities)
    laws = nodes.where("type IN ('LAW', 'DECRET', 'DAHIR', 'CONSTITUTION', 'DECREE', 'STATUTE')").select("document_id", F.col("ent_id").alias("target_id"), law_number(F.col("text")).alias("law")).where("law IS NOT NULL")
    refs = nodes.where("type = 'INTERNAL_REF'").select("document_id", F.col("ent_id").alias("source_id"))
    led = relations.join(refs, ["document_id", "source_id"], "left_semi").join(laws, ["document_id", "target_id"])
    return led.groupBy("document_id", F.col("source_id").alias("ent_id")).agg(F.min_by("law", F.struct("ord", "law")).alias("law"))


def entity_references(relations: DataFrame) -> DataFrame:
    """(document_id, node, n, others): how often and beside what each node is related, either way round."""
    return neighbours(relations).groupBy("document_id", "node").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))


def entity_arrays(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, ent_id, refs, rels, articles): of each entity what it is related to, either way round, in order.

    ``refs`` are the ids of the others, ``rels`` the ids of the relations, ``articles`` the ids of those that are an ARTICLE.
    """
    rows = relations.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("document_id", "ord", "relation_id", "source_id", "target_id")
    ends = F.array(F.struct(F.col("source_id").alias("ent_id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("ent_id"), F.col("source_id").alias("other")))
    both = rows.select("document_id", "ord", "relation_id", F.inline(ends))
    kinds = nodes_of(entities).select("document_id", F.col("ent_id").alias("other"), (F.col("type") == "ARTICLE").alias("article"))
    held = F.array_sort(F.collect_list(F.struct("ord", "other", "relation_id", "article")))
    took = both.join(kinds, ["document_id", "other"], "left").groupBy("document_id", "ent_id").agg(held.alias("h"))
    join = lambda field, rows: F.array_join(F.transform(rows, lambda x: x[field]), ",")
    return took.select("document_id", "ent_id", join("other", F.col("h")).alias("refs"), join("relation_id", F.col("h")).alias("rels"), join("other", F.filter("h", lambda x: x["article"])).alias("articles"))


def _data(**values: Column) -> Column:
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'<data key="{k}">'), html_escape(v), F.lit("</data>"))) for k, v in values.items()]
    return F.concat_ws("", *parts)


def graphml_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, value): the lines of a GraphML file; parts 0 and 3 are its head and foot, 1 nodes, 2 edges."""
    keys = [f'<key id="{at}" for="{kind}" attr.name="{at}" attr.type="string"/>' for at, kind in (("document", "node"), ("type", "node"), ("text", "node"), ("normalized", "node"), ("relation", "edge"))]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    frame = entities.sparkSession.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, value string")
    n = F.struct(F.col("document_id").cast("string").alias("d"))
    nodes = nodes_of(entities).select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), F.col("entity_id").cast("string"), F.lit('">'), _data(document=n["d"], type=F.col("type"), text=F.col("text"), normalized=F.col("normalized")), F.lit("</node>")).alias("value"))
    edges = edges_of(entities, relations).select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), F.col("source").cast("string"), F.lit('" target="'), F.col("target").cast("string"), F.lit('">'), _data(relation=F.coalesce("type", F.lit(""))), F.lit("</edge>")).alias("value"))
    return frame.unionByName(nodes).unionByName(edges)


def write_graphml(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """The whole graph as GraphML: text files in the folder ``path`` that make one file in the order of their names.

    The executors write them; a range of ``part`` keeps head, nodes, edges and foot in order.
    """
    graphml_lines(entities, relations).repartitionByRange("part", F.xxhash64("value")).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)
