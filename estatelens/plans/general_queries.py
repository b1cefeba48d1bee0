"""Queries of the general training-data operators (p1, p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators.skew import dominant_keys, per_key_totals
from estatelens.operators.timestamps import with_instant
from estatelens.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id and UTC microseconds of every row whose last_modified denotes one instant."""
    files = table(spark, d, "classified_files").select("row_id", "source_system", "last_modified")
    return with_instant(files, table(spark, d, "estates")).filter(F.col("utc_micros").isNotNull()).select("row_id", "utc_micros")


def _with_instants(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "classified_files").select("row_id", "source_system", "entity_scheme", "size", "last_modified")
    return with_instant(files, table(spark, d, "estates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of entity_scheme and source_system that at least 3 % of the rows hold."""
    return dominant_keys(per_key_totals(_with_instants(spark, d)), 0.03)


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per-scheme and per-estate counts, sizes and newest instant."""
    return per_key_totals(_with_instants(spark, d))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per-scheme and per-estate counts and sizes, without the newest instant."""
    return per_key_totals(table(spark, d, "classified_files"), instant=None).drop("newest_micros")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_totals": p2_totals, "p2_sizes": p2_sizes}

SQL = {
    "p2_sizes": """
        SELECT 'entity_scheme' AS field_name, entity_scheme AS key_value, count(*) AS n_files, sum(size)::BIGINT AS total_bytes, max(size) AS max_bytes FROM classified_files GROUP BY 2
        UNION ALL SELECT 'source_system', source_system, count(*), sum(size)::BIGINT, max(size) FROM classified_files GROUP BY 2""",
    "p2_found": """
        WITH k AS (SELECT 'entity_scheme' AS field_name, entity_scheme AS key_value FROM classified_files
                   UNION ALL SELECT 'source_system', source_system FROM classified_files)
        SELECT field_name, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2
        HAVING count(*) >= 0.03 * (SELECT count(*) FROM classified_files)""",
}
