"""Ad-hoc SQL that may only read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What a statement that is no query parses to.
_WRITES = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


def query(spark: SparkSession, sql: str, **arguments: object) -> DataFrame:
    """The result of ``sql`` with named parameters; anything but a query raises before it runs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    if any(loader.loadClass(name).isInstance(plan) for name in _WRITES):
        raise ValueError(f"only queries are allowed, not {plan.nodeName()}")
    return spark.sql(sql, args=arguments or None)


def register_functions(spark: SparkSession) -> None:
    """The number functions as SQL functions, inlined by the optimizer."""
    digits = "translate(v, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION canonical_num(v STRING) RETURNS STRING RETURN regexp_replace(nullif(regexp_extract({digits}, '\\\\d+(?:[./]+[^\\\\d]*\\\\d+)*', 0), ''), '([./])[./]*[^\\\\d]*', '$1')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION strip_markers(v STRING) RETURNS STRING RETURN regexp_replace(v, '<([^,<>]+), id:[^>]+>', '$1')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION entity_id(kind STRING, v STRING) RETURNS STRING RETURN concat_ws('_', kind, substr(sha1(v), 1, 8))")
