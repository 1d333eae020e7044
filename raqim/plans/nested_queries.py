"""Queries on nested records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raqim.operators.nested import broken_records, child_table, flat_records, infer_paths, node_table
from raqim.sources.tables import table


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    nodes = node_table(table(spark, directory, "structure_records", "record_id", "payload"), fields=("type", "number"))
    return nodes.select("record_id", "pos", "parent_pos", F.coalesce("node_type", F.lit("")).alias("node_type"), F.coalesce("node_number", F.lit("")).alias("node_number"))


def p6_references(spark: SparkSession, directory: str) -> DataFrame:
    """The law references in the metadata of each record, as a child table."""
    records = table(spark, directory, "structure_records", "record_id", "payload")
    rows = child_table(records, ("metadata", "references"), fields=("type", "number"))
    return rows.select("record_id", F.col("ord1").alias("ord"), F.col("type").alias("ref_type"), F.col("number").alias("ref_number"))


def p6_schema(spark: SparkSession, directory: str) -> DataFrame:
    return infer_paths(table(spark, directory, "structure_records", "payload"))


def p6_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Every array of objects of every record, one row per object, with the key of its parent row."""
    flat = flat_records(table(spark, directory, "structure_records", "record_id", "payload"))
    return flat.select("record_id", "path", "id", "parent_id", "ord", F.size("fields").alias("fields"))


def p6_broken(spark: SparkSession, directory: str) -> DataFrame:
    """The records that hold no whole object, which give no rows elsewhere."""
    return broken_records(table(spark, directory, "structure_records", "record_id", "payload")).select("record_id")


QUERIES = {"p6_found": p6_found, "p6_references": p6_references, "p6_schema": p6_schema, "p6_tables": p6_tables, "p6_broken": p6_broken}

SQL = {
    "p6_references": r"""
WITH o AS (
  SELECT record_id, regexp_extract(payload, '(?s)\{.*\}') AS j FROM structure_records
), v AS (SELECT record_id, j FROM o WHERE json_valid(j))
SELECT record_id, CAST(i - 1 AS INT) AS ord,
       json_extract_string(j, '$.metadata.references[' || (i - 1) || '].type') AS ref_type,
       json_extract_string(j, '$.metadata.references[' || (i - 1) || '].number') AS ref_number
FROM v, LATERAL (SELECT unnest(range(1, 1 + CAST(json_array_length(j, '$.metadata.references') AS BIGINT))) AS i)
WHERE json_type(j, '$.metadata.references[' || (i - 1) || ']') = 'OBJECT'
""",
    "p6_broken": r"""
SELECT record_id FROM structure_records WHERE trim(payload, chr(9) || chr(10) || chr(13) || ' ') <> '' AND NOT json_valid(regexp_extract(payload, '(?s)\{.*\}'))
""",
    # a value that is JSON text is opened first; lists give their elements, objects are nodes; the way is the order
    "p6_found": r"""
WITH RECURSIVE o AS (SELECT record_id, regexp_extract(payload, '(?s)\{.*\}') AS j FROM structure_records),
w AS (
  SELECT record_id, CAST([0] AS BIGINT[]) AS way, CAST([] AS BIGINT[]) AS up, json_extract(CAST(j AS JSON), '$.structure') AS v FROM o WHERE json_valid(j)
  UNION ALL
  SELECT record_id, list_append(way, n.i), CASE WHEN kind = 'OBJECT' THEN way ELSE up END, n.e
  FROM (SELECT record_id, way, up, v, json_type(v) AS kind FROM w) p,
  LATERAL (
    SELECT unnest(parts) AS e, generate_subscripts(parts, 1) AS i FROM (SELECT CASE
      WHEN kind = 'ARRAY' THEN json_extract(v, '$[*]') WHEN kind = 'OBJECT' THEN [json_extract(v, '$.children')]
      WHEN kind = 'VARCHAR' AND regexp_matches(json_extract_string(v, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(v, '$')) THEN [CAST(json_extract_string(v, '$') AS JSON)]
      ELSE [] END AS parts)) n
  WHERE n.e IS NOT NULL
), nodes AS (
  SELECT record_id, way, up, v, CAST(row_number() OVER (PARTITION BY record_id ORDER BY way) - 1 AS INT) AS pos FROM w WHERE json_type(v) = 'OBJECT'
)
SELECT n.record_id, n.pos, coalesce(p.pos, -1) AS parent_pos, coalesce(json_extract_string(n.v, '$.type'), '') AS node_type, coalesce(json_extract_string(n.v, '$.number'), '') AS node_number
FROM nodes n LEFT JOIN nodes p ON p.record_id = n.record_id AND p.way = n.up
""",
}
