"""Queries of mentions, references, the graph and the store, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raqim.functions.vocabulary import RELATION_LABELS
from raqim.operators.lineage import shared_folder
from raqim.operators import documents, graph, mentions, nested, references, spans, sql, store
from raqim.plans.text_queries import _canonical_sql
from raqim.sources.tables import table
from raqim.streaming import imports

ENTITY = ("document_id", "ord", "entity_id", "ent_id", "type", "text", "start_char", "end_char", "normalized", "global_id")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with a unique ``ord`` in their document."""
    order = Window.partitionBy("document_id").orderBy("ord", "entity_id")
    return table(spark, d, "entities", *ENTITY).withColumn("ord", F.row_number().over(order))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct relations; ``ord`` is made unique by the remaining columns."""
    rows = table(spark, d, "relations", "document_id", "ord", "relation_id", "type", "source_id", "target_id").distinct()
    order = Window.partitionBy("document_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("ord", "relation_id", "type", "source_id", "target_id")])
    return rows.withColumn("ord", F.row_number().over(order))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """One request for every article: its number, in its document's law."""
    articles = table(spark, d, "articles", "article_id", "document_id", "number")
    documents = table(spark, d, "documents", "doc_id", "law_number")
    return articles.join(documents, F.col("document_id") == F.col("doc_id")).select(F.col("article_id").alias("req_id"), F.col("law_number").alias("law"), F.col("number").alias("article"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "doc_number", "law_number", "short_title", "file_name")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles", "document_id", "article_id", "pos", "number", "text")


def article_hits_by_law(spark: SparkSession, d: str) -> DataFrame:
    return references.article_hits(_requests(spark, d), _documents(spark, d), _articles(spark, d))


def article_hits_cascade(spark: SparkSession, d: str) -> DataFrame:
    laws = _documents(spark, d).where("law_number IS NOT NULL").select("law_number").distinct()
    asked = laws.select(F.col("law_number").alias("req_id"), F.col("law_number").alias("law"), F.regexp_extract("law_number", r"(\d+)$", 1).alias("article"))
    return references.article_cascade(asked, _documents(spark, d), _articles(spark, d))


def article_hits_named(spark: SparkSession, d: str) -> DataFrame:
    """Article 1 of whatever document has the title of each one, without its law number."""
    asked = _documents(spark, d).select(F.col("doc_id").alias("req_id"), F.lit(None).cast("string").alias("law"), F.lit("1").alias("article"), F.array(F.lower("short_title")).alias("names"))
    return references.article_cascade(asked, _documents(spark, d), _articles(spark, d))


def article_popups(spark: SparkSession, d: str) -> DataFrame:
    texts = _articles(spark, d).groupBy("document_id", "number").agg(F.max_by("text", F.struct("pos", "article_id")).alias("text"))
    return references.article_popups(_entities(spark, d), _relations(spark, d), references.law_articles(_documents(spark, d), _articles(spark, d)), texts)


def entity_arrays(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_arrays(_entities(spark, d), _relations(spark, d))


def graphml_lines(spark: SparkSession, d: str) -> DataFrame:
    return graph.graphml_lines(_entities(spark, d), _relations(spark, d)).where("part IN (1, 2)")


def record_law_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The law number of each record: in its titles or file name, else that of the first reference to a law."""
    records = table(spark, d, "structure_records", "record_id", "file_name", "payload")
    meta = nested.json_object(F.col("payload"))
    field = lambda n: F.try_variant_get(meta, f"$.metadata.{n}", "string")
    refs = F.try_variant_get(meta, "$.metadata.references", "array<struct<type:string,number:string>>")
    rows = records.select("record_id", "file_name", field("law_number").alias("law_number"), field("official_title").alias("official_title"), field("short_title").alias("short_title"), refs.alias("references"))
    rows = rows.select(F.concat_ws("\t", F.col("record_id").cast("string"), "file_name").alias("file_name"), "law_number", "official_title", "short_title", "references", F.lit("").alias("doc_type"), F.lit("").alias("doc_number"), F.lit(0).alias("source_rank"))
    return store.document_rows(rows).select(F.substring_index("file_name", "\t", 1).cast("bigint").alias("record_id"), "law_number")


def docs_by_entity(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "entities", "document_id", "global_id").where("global_id LIKE 'COURT%'")
    return references.documents_with(_documents(spark, d), wanted, 100)


def docs_by_person(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "entities", "document_id", "type", "normalized").where("type = 'PERSON' AND normalized LIKE 'محمد%'")
    return references.documents_with(_documents(spark, d), wanted, 200)


def judged_by_like(spark: SparkSession, d: str) -> DataFrame:
    judges = table(spark, d, "entities", "document_id", "type", "text").where("type = 'JUDGE' AND text LIKE '%محمد%'")
    return _documents(spark, d).join(judges, F.col("doc_id") == F.col("document_id")).select("doc_id", "file_name", F.col("text").alias("judge"))


def docs_per_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_type").groupBy("doc_type").agg(F.count("*").alias("n"))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.table_counts(**{n: table(spark, d, n) for n in ("documents", "articles", "entities", "relations")})


def law_articles(spark: SparkSession, d: str) -> DataFrame:
    return references.law_articles(_documents(spark, d), _articles(spark, d))


def global_ids(spark: SparkSession, d: str) -> DataFrame:
    return mentions.global_ids(_entities(spark, d), _relations(spark, d))


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities", "entity_id", "type", "text")
    return rows.select("entity_id", mentions.normal_form(F.col("type"), F.col("text"), F.lit(None).cast("string")).alias("normal"))


def article_normals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities", "entity_id", "type", "text").where("type = 'ARTICLE'")
    return rows.select("entity_id", mentions.normal_form(F.col("type"), F.col("text"), F.lit(None).cast("string")).alias("normal"))


def assign_numeric_ids(spark: SparkSession, d: str) -> DataFrame:
    _, relations = mentions.numeric_ids(_entities(spark, d), _relations(spark, d))
    return relations.select("document_id", "new_relation_id", "type", "source_id", "target_id")


def expanded_references(spark: SparkSession, d: str) -> DataFrame:
    """Ranges and lists of articles in the texts of all documents and articles."""
    texts = table(spark, d, "documents", "doc_id", "text").unionByName(table(spark, d, "articles", F.col("article_id").alias("doc_id"), "text"))
    return mentions.expand_references(texts).select("document_id", "kind", "normalized", "number")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).where("start_char >= 0")


def articles_outside_dates(spark: SparkSession, d: str) -> DataFrame:
    """All mentions without the articles inside a date."""
    return spans.articles_outside_dates(_entities(spark, d)).select("document_id", "entity_id")


def articles_outside_refs(spark: SparkSession, d: str) -> DataFrame:
    """All mentions and the ranges and lists of the texts, without the articles inside those."""
    found = mentions.expand_references(table(spark, d, "documents", "doc_id", "text")).select("document_id", "start_char", "end_char").distinct()
    refs = found.select("document_id", F.lit(None).cast("bigint").alias("entity_id"), F.lit("").alias("ent_id"), F.lit("INTERNAL_REF").alias("type"), F.lit("").alias("text"), "start_char", "end_char")
    rows = _entities(spark, d).select("document_id", "entity_id", "ent_id", "type", "text", "start_char", "end_char")
    kept, _ = spans.articles_outside_refs(rows.unionByName(refs), _relations(spark, d))
    return kept.where("entity_id IS NOT NULL").select("document_id", "entity_id")


def fixed_offsets(spark: SparkSession, d: str) -> DataFrame:
    return spans.fix_offsets(_entities(spark, d), table(spark, d, "documents", "doc_id", "text"))


def loaded_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of all mentions found anew in their documents."""
    return spans.load_offsets(_entities(spark, d), table(spark, d, "documents", "doc_id", "text"))


def saved_texts(spark: SparkSession, d: str) -> DataFrame:
    return spans.save_texts(_entities(spark, d), table(spark, d, "documents", "doc_id", "text")).select("document_id", "entity_id", "text")


def annotated_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record with markers around the mentions of its document."""
    return documents.annotate_records(table(spark, d, "structure_records", "record_id", "document_id", "payload"), _entities(spark, d))


def shifted_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _placed(spark, d).select("document_id", "entity_id", "start_char", "end_char")
    return spans.shift_spans(rows, F.lit(120), F.lit(160), F.lit("نص بديل"))


def next_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities", "document_id", "ent_id").groupBy("document_id").agg(spans.next_id(F.col("ent_id")).alias("next_id"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(_entities(spark, d), _relations(spark, d))


def relation_tooltips(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_tooltips(_entities(spark, d), _relations(spark, d))


def entity_references(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_references(_relations(spark, d))


def law_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.law_neighbours(_entities(spark, d), _relations(spark, d))


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents as one batch over the first import of each file; later rows last."""
    rows = table(spark, d, "documents", "doc_id", "file_name", "short_title", "created_at")
    first = rows.groupBy("file_name").agg(F.min_by(F.struct("doc_id", "short_title", "created_at"), F.struct("created_at", "doc_id")).alias("r"))
    return store.upsert(first.select("r.doc_id", "file_name", "r.short_title", "r.created_at"), rows, ("file_name",), ("created_at", "doc_id"))


def replace_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles", "document_id", "article_id", "number")
    batch = rows.where("document_id % 3 = 0 AND article_id % 2 = 0").withColumn("number", F.concat(F.lit("جديد "), F.coalesce("number", F.lit(""))))
    return store.replace_children(rows, batch, rows.where("document_id % 3 = 0"))


def document_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "file_name", "short_title", "official_title", "doc_type", "doc_number").withColumn("source_rank", F.lit(0))
    return store.document_rows(rows).select("file_name", "short_title", "law_number")


def catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Titles of even documents laid over those of all."""
    rows = table(spark, d, "documents", "doc_id", "short_title", "source")
    return store.overlay(rows, rows.where("doc_id % 2 = 0").withColumn("short_title", F.upper("source")).withColumn("source", F.lit(None).cast("string")), "doc_id")


def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "documents").createOrReplaceTempView("raqim_documents")
    sql.register_functions(spark)
    return sql.query(spark, "SELECT source, canonical_num(law_number) AS law, count(*) AS n FROM raqim_documents WHERE lang = :lang GROUP BY 1, 2", lang="ar")


def stream_import(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of files into a store; the last version of each file name stays."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet" if os.path.isfile(f"{d}/documents.parquet") else "*.parquet")
    stream = stream.parquet(d if os.path.isfile(f"{d}/documents.parquet") else f"{d}/documents.parquet")
    kept = imports.Versions(spark, f"{folder}/store", imports.FILES)
    imports.import_rows(stream.select("file_name", F.col("created_at").cast("timestamp").alias("modified"), "text"), kept, f"{folder}/at").awaitTermination()
    return kept.read().select("file_name", F.length("text").alias("n_chars"), F.sha1("text").alias("digest"))


def postprocessed(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain after extraction over all documents and their mentions."""
    out, _ = mentions.postprocess(table(spark, d, "documents", "doc_id", "text"), _entities(spark, d), _relations(spark, d))
    return out.select("document_id", "ord", "new_id", "type", "start_char", "end_char", "normalized", "global_id")


def leaf_texts(spark: SparkSession, d: str) -> DataFrame:
    return documents.json_leaf_text(table(spark, d, "structure_records", "record_id", "payload"))


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of a document by type as sections of sentences."""
    rows = table(spark, d, "entities", "document_id", "entity_id", "type", "text").where("text IS NOT NULL")
    held = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("entity_id", "text")))), lambda x: x["text"])
    made = rows.groupBy("document_id").agg(held("LAW").alias("laws"), held("DATE").alias("dates"))
    return documents.sections(made, "document_id", ("laws", "dates"))


QUERIES = {
    "postprocess": postprocessed, "json_leaf_text": leaf_texts, "decision_sections": document_sections,
    "article_hits_by_law": article_hits_by_law, "article_hits_cascade": article_hits_cascade, "article_hits_named": article_hits_named, "article_popups": article_popups, "entity_arrays": entity_arrays,
    "graphml_lines": graphml_lines, "record_law_numbers": record_law_numbers, "docs_by_entity": docs_by_entity, "docs_by_person": docs_by_person, "judged_by_like": judged_by_like,
    "docs_per_type": docs_per_type, "table_counts": table_counts, "law_articles": law_articles, "global_ids": global_ids, "normal_forms": normal_forms, "article_normals": article_normals,
    "assign_numeric_ids": assign_numeric_ids, "expand_references": expanded_references, "articles_outside_dates": articles_outside_dates, "articles_outside_refs": articles_outside_refs,
    "fix_offsets": fixed_offsets, "load_offsets": loaded_offsets, "save_texts": saved_texts, "annotate_records": annotated_records, "shift_spans_on_replace": shifted_spans, "next_id": next_ids, "graph_edges": graph_edges, "relation_tooltips": relation_tooltips,
    "entity_references": entity_references, "law_neighbours": law_neighbours, "upsert_documents": upsert_documents, "replace_children": replace_children, "document_rows": document_titles,
    "overlay": catalogs, "adhoc_sql": adhoc_sql, "stream_import": stream_import,
}

_REQ = f"""requests AS (SELECT article_id AS req_id, law_number AS law, {_canonical_sql('number')} AS number FROM articles JOIN documents ON document_id = doc_id),
found AS (SELECT document_id, article_id, {_canonical_sql('number')} AS number FROM articles)"""
_ENT = "e AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY document_id ORDER BY ord, entity_id) AS ord FROM entities)"
_REL = """r0 AS (SELECT DISTINCT document_id, ord AS o, relation_id, type, source_id, target_id FROM relations),
r AS (SELECT document_id, relation_id, type, source_id, target_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY o NULLS FIRST, relation_id NULLS FIRST, type NULLS FIRST, source_id NULLS FIRST, target_id NULLS FIRST) AS INT) AS ord FROM r0)"""
_LABEL = "CASE r.type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATION_LABELS.items()) + " ELSE coalesce(r.type, '') END"
_NODE = "node AS (SELECT document_id, ent_id, unnest(arg_max(struct_pack(entity_id := entity_id, type := type, text := text), struct_pack(o := ord, i := entity_id))) FROM e GROUP BY document_id, ent_id)"
_LAWNO = rf"""coalesce({_canonical_sql(r"nullif(regexp_extract(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), 'رقم\s*([0-9]+(?:[./]+[0-9]+)*)', 1), '')")},
 CASE WHEN (contains(text, 'المادة') OR contains(text, 'الفصل')) AND len(regexp_extract_all(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\d+(?:[./]+\d+)*')) >= 2 THEN {_canonical_sql(r"regexp_extract_all(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\d+(?:[./]+\d+)*')[-1]")} END,
 {_canonical_sql(r"regexp_extract_all(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\d+(?:[./]+\d+)*')[1]")})"""

_RANGE_SQL = r"من\s+(?:الفصل\s+)?([0-9٠-٩]+)\s+(?:إ?لى|الى)\s+(?:الفصل\s+)?([0-9٠-٩]+)"
_LIST_SQL = r"(?:الفصلين|الفصول)\s*:?[\s ]*((?:[0-9٠-٩]+(?:\s*[،,]\s*|\s*و\s*))*[0-9٠-٩]+)"
_WHERE = "(SELECT doc_id AS id, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS t FROM documents UNION ALL SELECT article_id, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') FROM articles)"
_RANGES = f"""ranges AS (SELECT id, least(x, y) AS a, greatest(x, y) AS b FROM (
  SELECT id, CAST(unnest(regexp_extract_all(t, '{_RANGE_SQL}', 1)) AS BIGINT) AS x, CAST(unnest(regexp_extract_all(t, '{_RANGE_SQL}', 2)) AS BIGINT) AS y FROM {_WHERE}))"""
_LISTS = f"""lists AS (SELECT id, list_transform(regexp_extract_all(said, '[0-9]+'), lambda n: CAST(n AS BIGINT)) AS ns FROM (SELECT id, unnest(regexp_extract_all(t, '{_LIST_SQL}', 1)) AS said FROM {_WHERE}))"""
_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"

SQL = {
    "save_texts": """
SELECT e.document_id, e.entity_id, CASE WHEN start_char >= 0 AND end_char > start_char AND end_char <= length(d.text) THEN substr(d.text, start_char + 1, end_char - start_char) ELSE e.text END AS text
FROM entities e LEFT JOIN documents d ON d.doc_id = e.document_id""",
    "json_leaf_text": r"""
WITH v AS (SELECT record_id, regexp_extract(payload, '(?s)\{.*\}') AS j FROM structure_records), g AS (SELECT record_id, CASE WHEN json_valid(j) THEN j ELSE '{}' END AS j, json_valid(j) AS ok FROM v)
SELECT record_id, CASE WHEN any_value(ok) THEN coalesce(string_agg(t.atom ->> '$', chr(10) ORDER BY t.id) FILTER (WHERE t.type = 'VARCHAR' AND t.atom ->> '$' <> ''), '') END AS text FROM g, json_tree(j) t GROUP BY 1""",
    "article_hits_named": f"""
WITH q AS (SELECT doc_id AS req_id, lower(short_title) AS part, '1' AS number FROM documents),
f AS (SELECT document_id, article_id, {_canonical_sql('number')} AS number, doc_number, short_title, file_name FROM articles JOIN documents ON doc_id = document_id),
h AS (SELECT req_id, document_id, article_id, doc_number, CASE WHEN coalesce(contains(lower(short_title), part), false) OR coalesce(contains(lower(file_name), part), false) THEN 3 ELSE 4 END AS stage FROM q JOIN f ON f.number = q.number),
l AS (SELECT *, min(stage) OVER (PARTITION BY req_id) AS least FROM h)
SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY doc_number NULLS LAST, document_id, article_id) AS INT) AS place, document_id AS doc_id, article_id, stage FROM l WHERE stage = least
QUALIFY place <= 5""",
    "entity_arrays": f"""
WITH {_ENT}, {_REL}, {_NODE}, b AS (SELECT document_id, ord, relation_id, source_id AS ent_id, target_id AS other FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT document_id, ord, relation_id, target_id, source_id FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
SELECT b.document_id, b.ent_id, string_agg(other, ',' ORDER BY ord, other) AS refs, coalesce(string_agg(relation_id, ',' ORDER BY ord, other), '') AS rels, coalesce(string_agg(CASE WHEN n.type = 'ARTICLE' THEN other END, ',' ORDER BY ord, other), '') AS articles
FROM b LEFT JOIN node n ON n.document_id = b.document_id AND n.ent_id = b.other GROUP BY 1, 2""",
    "graphml_lines": f"""
WITH {_ENT}, {_REL}, node AS (SELECT document_id, ent_id, unnest(arg_max(struct_pack(entity_id := entity_id, type := type, text := text, normalized := normalized), struct_pack(o := ord, i := entity_id))) FROM e GROUP BY document_id, ent_id)
SELECT 1 AS part, concat('<node id="', entity_id, '"><data key="document">', document_id, '</data>', '<data key="type">' || {_ESC('type')} || '</data>', '<data key="text">' || {_ESC('text')} || '</data>', '<data key="normalized">' || {_ESC('normalized')} || '</data>', '</node>') AS value FROM node
UNION ALL SELECT 2, concat('<edge source="', s.entity_id, '" target="', t.entity_id, '"><data key="relation">', {_ESC("coalesce(r.type, '')")}, '</data></edge>')
FROM r JOIN node s ON s.document_id = r.document_id AND s.ent_id = r.source_id JOIN node t ON t.document_id = r.document_id AND t.ent_id = r.target_id""",
    "record_law_numbers": r"""
WITH o AS (SELECT record_id, file_name, regexp_extract(payload, '(?s)\{.*\}') AS j FROM structure_records), v AS (SELECT record_id, file_name, CASE WHEN json_valid(j) THEN json_extract(j, '$.metadata') END AS m FROM o),
t AS (SELECT *, translate(unnest([m ->> '$.law_number', m ->> '$.official_title', m ->> '$.short_title', file_name]), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS title, unnest([1, 2, 3, 4]) AS place FROM v),
n AS (SELECT record_id, arg_min(nullif(regexp_extract(title, 'القانون\s+رقم\s*(\d+(?:[./]\d+)*)', 1), ''), place) FILTER (WHERE regexp_matches(title, 'القانون\s+رقم\s*\d')) AS titled, any_value(m) AS m FROM t GROUP BY 1)
SELECT record_id, coalesce(titled, list_filter(CASE WHEN json_type(m, '$.references') = 'ARRAY' THEN json_extract(m, '$.references[*]') ELSE [] END, lambda x: contains(x ->> '$.type', 'قانون'))[1] ->> '$.number') AS law_number FROM n""",
    "article_popups": f"""
WITH {_ENT}, {_REL}, {_NODE}, la AS (SELECT * FROM (LAW_ARTICLES)),
full_node AS (SELECT document_id, ent_id, arg_max(coalesce(nullif(normalized, ''), text), struct_pack(o := ord, i := entity_id)) AS value FROM e GROUP BY 1, 2),
a AS (SELECT n.document_id, n.ent_id, {_canonical_sql('f.value')} AS number FROM node n JOIN full_node f USING (document_id, ent_id) WHERE n.type = 'ARTICLE'),
last AS (SELECT document_id, {_canonical_sql('number')} AS number, arg_max(text, (pos, article_id)) AS text FROM articles GROUP BY document_id, articles.number),
own AS (SELECT document_id, number, max(text) AS own FROM last WHERE text <> '' AND number IS NOT NULL GROUP BY 1, 2),
b AS (SELECT document_id, ord, source_id AS node, target_id AS other FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT document_id, ord, target_id, source_id FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
l AS (SELECT document_id, ent_id AS other, {_LAWNO} AS law FROM node WHERE type IN ('LAW', 'DECRET', 'DAHIR', 'CONSTITUTION', 'DECREE', 'STATUTE')),
near AS (SELECT b.document_id, b.node AS ent_id, l.law, min(b.ord) AS o FROM b JOIN l USING (document_id, other) WHERE law IS NOT NULL GROUP BY 1, 2, 3),
related AS (SELECT a.document_id, a.ent_id, arg_min(la.text, (o, near.law)) AS related FROM a JOIN near USING (document_id, ent_id) JOIN la ON la.law = near.law AND la.number = a.number GROUP BY 1, 2),
other AS (SELECT number, arg_min(text, law) AS other FROM la GROUP BY 1)
SELECT document_id, ent_id, 'الفصل ' || number || chr(10) || coalesce(own, related, other) AS popup FROM a LEFT JOIN own USING (document_id, number) LEFT JOIN related USING (document_id, ent_id) LEFT JOIN other USING (number) WHERE coalesce(own, related, other) IS NOT NULL""",
    "decision_sections": """
SELECT document_id, CASE type WHEN 'LAW' THEN 'laws' ELSE 'dates' END AS section, CAST(row_number() OVER (PARTITION BY document_id, type ORDER BY entity_id) - 1 AS INT) AS idx, text
FROM entities WHERE type IN ('LAW', 'DATE') AND text IS NOT NULL""",
    "article_hits_by_law": f"""
WITH {_REQ}, one AS (SELECT doc_number AS law, min(doc_id) AS law_doc FROM documents WHERE doc_number IS NOT NULL GROUP BY 1),
first AS (SELECT req_id, document_id, article_id, 1 AS stage, NULL AS doc_number FROM requests q JOIN one USING (law) JOIN found f ON f.number = q.number AND f.document_id = law_doc),
ranked AS (SELECT f.*, doc_number, row_number() OVER (PARTITION BY f.number ORDER BY doc_number NULLS LAST, document_id, article_id) AS r FROM found f JOIN documents ON doc_id = document_id WHERE f.number IS NOT NULL),
both_ AS (SELECT * FROM first UNION ALL SELECT req_id, document_id, article_id, 2, doc_number FROM requests q JOIN ranked f ON f.number = q.number WHERE r <= 10),
once AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY req_id, document_id ORDER BY stage, article_id) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY stage, doc_number NULLS LAST, document_id, article_id) AS n, count(*) FILTER (WHERE stage = 1) OVER (PARTITION BY req_id) AS n1 FROM once)
SELECT req_id, CAST(n AS INT) AS place, document_id AS doc_id, article_id, stage FROM placed WHERE stage = 1 AND n <= 5 OR stage = 2 AND n1 < 5 AND n - n1 <= 5""",
    "article_hits_cascade": f"""
WITH q AS (SELECT DISTINCT law_number AS req_id, law_number AS law, nullif(regexp_extract(law_number, '(\\d+)$', 1), '') AS number FROM documents WHERE law_number IS NOT NULL),
f AS (SELECT document_id, article_id, {_canonical_sql('number')} AS number, doc_number, law_number, short_title, file_name FROM articles JOIN documents ON doc_id = document_id),
h AS (SELECT req_id, document_id, article_id, doc_number, CASE WHEN coalesce(doc_number = law OR law_number = law, false) THEN 1 WHEN coalesce(contains(short_title, law) OR contains(file_name, law), false) THEN 2 ELSE 4 END AS stage FROM q JOIN f ON f.number = q.number),
l AS (SELECT *, min(stage) OVER (PARTITION BY req_id) AS least FROM h)
SELECT req_id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY doc_number NULLS LAST, document_id, article_id) AS INT) AS place, document_id AS doc_id, article_id, stage FROM l WHERE stage = least
QUALIFY place <= 5""",
    "docs_by_entity": "SELECT doc_id, file_name, short_title FROM documents WHERE doc_id IN (SELECT document_id FROM entities WHERE global_id LIKE 'COURT%') ORDER BY doc_id LIMIT 100",
    "docs_by_person": "SELECT doc_id, file_name, short_title FROM documents WHERE doc_id IN (SELECT document_id FROM entities WHERE type = 'PERSON' AND normalized LIKE 'محمد%') ORDER BY doc_id LIMIT 200",
    "judged_by_like": "SELECT doc_id, file_name, e.text AS judge FROM documents JOIN entities e ON doc_id = document_id WHERE type = 'JUDGE' AND e.text LIKE '%محمد%'",
    "docs_per_type": "SELECT doc_type, count(*) AS n FROM documents GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("documents", "articles", "entities", "relations")),
    "law_articles": f"""
WITH t AS (SELECT document_id, {_canonical_sql('number')} AS number, pos, article_id, text FROM articles WHERE text <> ''), k AS (SELECT doc_id, {_canonical_sql('doc_number')} AS own, {_canonical_sql('law_number')} AS alias FROM documents),
o AS (SELECT own AS law, number, arg_max(text, (document_id, pos, article_id)) AS text FROM t JOIN k ON doc_id = document_id WHERE own IS NOT NULL AND number IS NOT NULL GROUP BY 1, 2),
a AS (SELECT alias AS law, number, arg_max(text, (document_id, pos, article_id)) AS text FROM t JOIN k ON doc_id = document_id WHERE own IS NOT NULL AND alias IS NOT NULL AND number IS NOT NULL GROUP BY 1, 2)
SELECT * FROM o UNION ALL SELECT * FROM a WHERE law NOT IN (SELECT own FROM k WHERE own IS NOT NULL)""",
    "global_ids": f"""
WITH {_ENT}, {_REL}, v AS (SELECT document_id, ord, ent_id, type, text, coalesce(nullif(normalized, ''), text) AS value FROM e),
laws AS (SELECT document_id, ent_id, arg_max(struct_pack(t := type, n := {_canonical_sql('text')}), ord) AS law FROM v WHERE type IN ('LAW', 'DECRET', 'DAHIR', 'CONSTITUTION') GROUP BY 1, 2),
linked AS (SELECT r.document_id, r.source_id AS ent_id, arg_min(l.law, r.ord) AS law FROM r JOIN laws l ON l.document_id = r.document_id AND l.ent_id = r.target_id GROUP BY 1, 2)
SELECT v.document_id, CAST(v.ord AS INT) AS ord, CASE
  WHEN type IN ('LAW', 'DECRET', 'DAHIR', 'CONSTITUTION') THEN type || '_' || coalesce({_LAWNO.replace('text', 'value')}, {_LAWNO})
  WHEN type = 'ARTICLE' AND k.law.n IS NOT NULL THEN k.law.t || '_' || k.law.n || '_ART_' || {_canonical_sql('value')}
  WHEN type = 'ARTICLE' THEN 'ART_' || {_canonical_sql('value')}
  ELSE type || '_' || substr(sha1(value), 1, 8) END AS global_id
FROM v LEFT JOIN linked k ON k.document_id = v.document_id AND k.ent_id = v.ent_id""",
    "article_normals": rf"""
WITH t AS (SELECT entity_id, text, regexp_extract_all(translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\d+') AS ns, {_canonical_sql('text')} AS c FROM entities WHERE type = 'ARTICLE'),
h AS (SELECT *, CASE WHEN contains(text, 'مادة') OR contains(text, 'مواد') OR contains(text, 'المادتين') THEN 'المادة' WHEN contains(text, 'فصل') OR contains(text, 'فصول') THEN 'الفصل' WHEN contains(text, 'باب') THEN 'الباب' WHEN contains(text, 'قسم') THEN 'القسم' ELSE 'الفصل' END AS head FROM t)
SELECT entity_id, CASE WHEN len(ns) > 1 THEN head || ' ' || array_to_string(list_transform(ns, lambda n: regexp_replace(n, '^0+(\d)', '\1')), '_') ELSE c || ' ' || head END AS normal FROM h""",
    "assign_numeric_ids": f"""
WITH {_ENT}, {_REL}, ids AS (SELECT document_id, ent_id, CAST(max(ord) AS VARCHAR) AS new_id FROM e GROUP BY 1, 2)
SELECT r.document_id, CAST(r.ord AS VARCHAR) AS new_relation_id, r.type, coalesce(s.new_id, r.source_id) AS source_id, coalesce(t.new_id, r.target_id) AS target_id
FROM r LEFT JOIN ids s ON s.document_id = r.document_id AND s.ent_id = r.source_id LEFT JOIN ids t ON t.document_id = r.document_id AND t.ent_id = r.target_id""",
    "expand_references": rf"""
WITH {_RANGES}, {_LISTS}
SELECT id AS document_id, 'range' AS kind, 'الفصل ' || a || '-' || b AS normalized, unnest(range(a, b + 1)) AS number FROM ranges
UNION ALL SELECT id, 'list', 'الفصل ' || array_to_string(ns, '_'), unnest(ns) FROM lists""",
    "articles_outside_dates": """
SELECT document_id, entity_id FROM entities i WHERE NOT (coalesce(type = 'ARTICLE', false) AND EXISTS (
  SELECT 1 FROM entities o WHERE o.type = 'DATE' AND o.document_id = i.document_id AND o.start_char >= 0 AND i.start_char >= 0 AND o.start_char <= i.start_char AND i.end_char <= o.end_char))""",
    "articles_outside_refs": rf"""
WITH t AS (SELECT doc_id AS id, text FROM documents), whole AS (
  SELECT id, text, unnest(list_concat(regexp_extract_all(text, '{_RANGE_SQL}'), regexp_extract_all(text, '{_LIST_SQL}'))) AS said FROM t),
refs AS (SELECT DISTINCT id, strpos(text, said) - 1 AS a, strpos(text, said) - 1 + length(said) AS b FROM whole)
SELECT document_id, entity_id FROM entities i WHERE NOT (coalesce(type = 'ARTICLE', false) AND EXISTS (
  SELECT 1 FROM refs o WHERE o.id = i.document_id AND i.start_char >= 0 AND (a <= i.start_char AND i.end_char <= b OR len(regexp_extract_all(i.text, '[0-9٠-٩]+')) > 1 AND i.start_char < b AND a < i.end_char)))""",
    "shift_spans_on_replace": """
SELECT document_id, entity_id, CAST(CASE WHEN start_char >= 160 THEN start_char - 33 ELSE start_char END AS INT) AS start_char,
  CAST(CASE WHEN start_char >= 160 THEN end_char - 33 WHEN start_char < 120 AND end_char > 120 THEN 120 ELSE end_char END AS INT) AS end_char
FROM entities WHERE start_char >= 0 AND (end_char <= 120 OR start_char >= 160 OR start_char < 120)""",
    "next_id": "SELECT document_id, coalesce(max(CAST(nullif(regexp_extract(ent_id, '(\\d+)$', 1), '') AS BIGINT)), 0) + 1 AS next_id FROM entities GROUP BY 1",
    "graph_edges": f"""
WITH {_ENT}, {_REL}, {_NODE}
SELECT r.document_id, r.ord, r.type, s.entity_id AS source, t.entity_id AS target FROM r JOIN node s ON s.document_id = r.document_id AND s.ent_id = r.source_id JOIN node t ON t.document_id = r.document_id AND t.ent_id = r.target_id""",
    "relation_tooltips": f"""
WITH {_ENT}, {_REL}, {_NODE}
SELECT r.document_id, r.source_id, string_agg({_LABEL} || ' ' || coalesce(t.text, ''), '<br/>' ORDER BY r.ord) AS tooltip, coalesce(string_agg(r.target_id, ',' ORDER BY r.ord), '') AS targets
FROM r LEFT JOIN node t ON t.document_id = r.document_id AND t.ent_id = r.target_id WHERE r.source_id IS NOT NULL GROUP BY 1, 2""",
    "entity_references": f"""
WITH {_REL}, b AS (SELECT document_id, source_id AS node, target_id AS other FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT document_id, target_id, source_id FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
SELECT document_id, node, count(*) AS n, array_to_string(list_sort(list_distinct(list(other))), ',') AS others FROM b GROUP BY 1, 2""",
    "law_neighbours": f"""
WITH {_ENT}, {_REL}, {_NODE}, b AS (SELECT document_id, ord, source_id AS node, target_id AS other FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT document_id, ord, target_id, source_id FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
l AS (SELECT document_id, ent_id AS other, {_LAWNO} AS law FROM node WHERE type IN ('LAW', 'DECRET', 'DAHIR', 'CONSTITUTION', 'DECREE', 'STATUTE')),
m AS (SELECT b.document_id, b.node, l.law, min(b.ord) AS o FROM b JOIN l USING (document_id, other) JOIN node a ON a.document_id = b.document_id AND a.ent_id = b.node AND a.type IN ('ARTICLE', 'INTERNAL_REF') WHERE law IS NOT NULL GROUP BY 1, 2, 3)
SELECT document_id, node AS ent_id, string_agg(law, ',' ORDER BY o, law) AS laws FROM m GROUP BY 1, 2""",
    # of a file name the last import counts, and every file name has one
    "upsert_documents": "SELECT doc_id, file_name, short_title, created_at FROM documents QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY created_at DESC NULLS LAST, doc_id DESC) = 1",
    "replace_children": "SELECT document_id, article_id, number FROM articles WHERE document_id % 3 <> 0 UNION ALL SELECT document_id, article_id, 'جديد ' || coalesce(number, '') FROM articles WHERE document_id % 3 = 0 AND article_id % 2 = 0",
    "document_rows": r"""
SELECT file_name, coalesce(nullif(short_title, ''), nullif(official_title, ''), file_name) AS short_title,
  coalesce(nullif(regexp_extract(translate(official_title, '٠١٢٣٤٥٦٧٨٩', '0123456789'), 'القانون\s+رقم\s*(\d+(?:[./]\d+)*)', 1), ''), nullif(regexp_extract(translate(short_title, '٠١٢٣٤٥٦٧٨٩', '0123456789'), 'القانون\s+رقم\s*(\d+(?:[./]\d+)*)', 1), ''), nullif(regexp_extract(file_name, 'القانون\s+رقم\s*(\d+(?:[./]\d+)*)', 1), '')) AS law_number
FROM documents""",
    "overlay": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(upper(source), short_title) ELSE short_title END AS short_title, source FROM documents",
    "adhoc_sql": f"SELECT source, {_canonical_sql('law_number')} AS law, count(*) AS n FROM documents WHERE lang = 'ar' GROUP BY 1, 2",
    "stream_import": "SELECT file_name, CAST(length(text) AS INT) AS n_chars, sha1(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY created_at DESC NULLS LAST, text DESC NULLS LAST) = 1",
}
SQL["article_popups"] = SQL["article_popups"].replace("LAW_ARTICLES", SQL["law_articles"])
