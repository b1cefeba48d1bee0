"""Queries that write tables by the sinks and read them back by the readers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.config import default_config
from estatelens.operators import folders
from estatelens.operators.ingest import SourceFormat
from estatelens.plans.reference_queries import _estate
from estatelens.plans.reference_sql import _EST, _SCHEMES
from estatelens.session import checkpoint_dir, table
from estatelens.sources import readers, sinks


def _place(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/estatelens-io-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def s1_csv(spark: SparkSession, d: str) -> DataFrame:
    """S1, S6, SK2: all rows through a CSV listing."""
    path = _place(spark)
    sinks.write_csv(table(spark, d, "classified_files").select("row_id", "full_path", "owner", "dup_is_latest"), path)
    read = readers.READERS["csv"](spark, path, SourceFormat({}))
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in read.columns])


def s1_header_row(spark: SparkSession, d: str) -> DataFrame:
    """A listing whose header comes after two other rows."""
    path = _place(spark)
    t = table(spark, d, "address_rows").select("addr_id", F.concat_ws(",", F.col("addr_id").cast("string"), F.concat(F.lit('"'), F.replace(F.translate(F.coalesce("entity_address", F.lit("")), "\r\n", ""), F.lit('"'), F.lit('""')), F.lit('"'))).alias("value"))
    head = spark.createDataFrame([(-3, "made for a test"), (-2, "1,2,3"), (-1, "Number,Address")], "addr_id bigint, value string")
    head.unionByName(t).coalesce(1).sortWithinPartitions("addr_id").select("value").write.text(path)
    read = readers.READERS["csv"](spark, path, SourceFormat({}, header_row=2))
    return read.select(F.col("Number").cast("bigint").alias("addr_id"), F.coalesce("Address", F.lit("")).alias("address"))


def s7_classified(spark: SparkSession, d: str) -> DataFrame:
    """S7, SK1: classified rows through JSON Lines."""
    path = _place(spark)
    t = table(spark, d, "classified_files").select("row_id", "full_path", "segments", "size", "overall_confidence", "dup_is_latest", "last_modified")
    sinks.write_jsonl(t, path)
    return readers.read_jsonl(spark, path, t.schema).select("row_id", "full_path", F.array_join("segments", "|").alias("folders"), "size", "overall_confidence", "dup_is_latest", "last_modified")


def s8_listing(spark: SparkSession, d: str) -> DataFrame:
    """A raw list of paths."""
    path = _place(spark)
    table(spark, d, "classified_files").select(F.translate(F.col("full_path"), "\r\n", "").alias("value")).filter("value <> ''").write.text(path)
    return readers.read_paths(spark, path).groupBy("full_path").agg(F.count(F.lit(1)).alias("n"))


def s10_places(spark: SparkSession, d: str) -> DataFrame:
    """Names of a text file and of a column of a CSV file."""
    a, b = _place(spark), _place(spark)
    names = table(spark, d, "classified_files").select(F.explode("segments").alias("value")).filter("value IS NOT NULL")
    names.filter("value LIKE 'Q%'").write.text(a)
    names.filter("value NOT LIKE 'Q%'").select(F.lit("1").alias("id"), F.col("value").alias("place18nm")).write.option("header", True).option("escape", '"').csv(b)
    return readers.read_place_names(spark, a, b)


def s11_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets as one list of paths."""
    t = table(spark, d, "classified_files")
    first = t.filter("row_id % 3 = 0").select(F.when(F.col("row_id") % 5 != 0, F.col("full_path")).otherwise(" ").alias("File Path"), "size")
    return readers.merge_sheets(first, t.filter("row_id % 2 = 0").select(F.col("full_path").alias("File Path")))


def s12_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """S12, SK4: the scheme candidates through their JSON file."""
    path = _place(spark)
    sinks.write_sidecar(folders.detect_schemes(_estate(spark, d).drop("entity_scheme", "entity_scheme_depth"), default_config())[1], path)
    return readers.read_sidecar(spark, path).select("folder_path", "status", "confidence", "depth", "unique_entities", "n_dev_categories")


def sk2_full(spark: SparkSession, d: str) -> DataFrame:
    """SK2: the full CSV; columns that the table lacks are empty."""
    return sinks.csv_frame(table(spark, d, "classified_files").drop("last_modified"), titles=sinks.FULL)


def sk3_slim(spark: SparkSession, d: str) -> DataFrame:
    """SK3: the slim CSV, written and read."""
    path = _place(spark)
    sinks.write_csv(table(spark, d, "classified_files").drop("last_modified"), path, titles=sinks.SLIM)
    read = readers.READERS["csv"](spark, path, SourceFormat({}))
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in read.columns])


def sk5_report(spark: SparkSession, d: str) -> DataFrame:
    """SK5, A12: a report with positions, written and read."""
    path = _place(spark)
    counts = table(spark, d, "classified_files").filter("extension IS NOT NULL").groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"))
    sinks.write_report(counts, path, "n_files", "extension")
    read = readers.READERS["csv"](spark, path, SourceFormat({}))
    return read.toDF("position", "extension", "n_files").select(F.col("position").cast("bigint").alias("position"), F.coalesce("extension", F.lit("")).alias("extension"), F.col("n_files").cast("bigint").alias("n_files"))


QUERIES = {q.__name__: q for q in (s1_csv, s1_header_row, s7_classified, s8_listing, s10_places, s11_merged, s12_sidecar, sk2_full, sk3_slim, sk5_report)}

_TEXTS = {
    **{c: f"coalesce(CAST({c} AS VARCHAR), '')" for c in "file_id full_path source_system filename_stem extension size owner depth inferred_type inferred_category overall_confidence entity_plot entity_plot_cluster_id entity_address entity_address_cluster_id entity_scheme entity_scheme_cluster_id dup_group_id dup_group_size".split()},
    "entity_address_canonical": "coalesce(entity_address_canonical, '')", "dup_is_latest": "CASE dup_is_latest WHEN true THEN 'True' WHEN false THEN 'False' ELSE '' END", "segments": "coalesce(array_to_string(segments, ' | '), '')",
}


def _csv_sql(titles: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"""{_TEXTS.get(c, "''")} AS "{t}\"""" for c, t in titles.items()) + " FROM classified_files"


SQL = {
    "s1_csv": "SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(full_path, '') AS full_path, coalesce(owner, '') AS owner, CASE dup_is_latest WHEN true THEN 'True' WHEN false THEN 'False' ELSE '' END AS dup_is_latest FROM classified_files",
    "s1_header_row": "SELECT addr_id, coalesce(translate(entity_address, chr(13) || chr(10), ''), '') AS address FROM address_rows",
    "s7_classified": "SELECT row_id, full_path, array_to_string(segments, '|') AS folders, size, overall_confidence, dup_is_latest, last_modified FROM classified_files",
    "s8_listing": "SELECT translate(full_path, chr(13) || chr(10), '') AS full_path, count(*) AS n FROM classified_files WHERE translate(full_path, chr(13) || chr(10), '') <> '' GROUP BY 1",
    "s10_places": "SELECT DISTINCT lower(trim(n)) AS name FROM (SELECT unnest(segments) AS n FROM classified_files) WHERE length(lower(trim(n))) >= 4",
    "s11_merged": "SELECT DISTINCT p AS \"Path\" FROM (SELECT CASE WHEN row_id % 5 <> 0 THEN full_path ELSE ' ' END AS p FROM classified_files WHERE row_id % 3 = 0 UNION ALL SELECT full_path FROM classified_files WHERE row_id % 2 = 0) WHERE trim(p) <> ''",
    "s12_sidecar": f"""WITH {_EST}, {_SCHEMES} SELECT folder_path, status, confidence, CAST(level - 1 AS INT) AS depth, unique_entities, CAST(n_dev AS INT) AS n_dev_categories FROM stat
        UNION ALL SELECT folder_path, excluded_by, 0.0, CAST(level AS INT), unique_entities, CAST(n_dev AS INT) FROM cand WHERE excluded_by IS NOT NULL""",
    "sk2_full": _csv_sql(sinks.FULL),
    "sk3_slim": _csv_sql(sinks.SLIM),
    "sk5_report": "SELECT row_number() OVER (ORDER BY count(*) DESC, extension) AS position, extension, count(*) AS n_files FROM classified_files WHERE extension IS NOT NULL GROUP BY extension",
}
