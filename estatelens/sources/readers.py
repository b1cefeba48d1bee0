"""Scans of listings and classified files, by a registry of formats."""

from __future__ import annotations

import csv
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.operators.ingest import FORMATS, SourceFormat
from estatelens.sources import xlsx


def read_csv(spark: SparkSession, path: str, fmt: SourceFormat) -> DataFrame:
    """CSV with its header ``header_row`` lines down; all columns are strings, read in parallel.

    Lines before the header are found by their row position in each file, not by their content.
    """
    base = spark.read.option("encoding", fmt.encoding).option("escape", '"')
    if not fmt.header_row:
        return base.option("header", True).option("multiLine", False).csv(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    # ids count up line by line within a block, so the lines to skip follow the least id of a file's first block
    first = lines.filter("start = 0").groupBy(F.col("file").alias("of")).agg(F.min("at").alias("low"))
    placed = lines.join(first, F.col("file") == F.col("of"), "left").withColumn("line", F.when(F.col("start") == 0, F.col("at") - F.col("low")))
    header = placed.filter(F.col("line") == fmt.header_row).select("value").head()
    if header is None:
        raise ValueError(f"no header in row {fmt.header_row}")
    schema = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in next(csv.reader([header["value"]])))
    body = placed.filter(F.col("line").isNull() | (F.col("line") > fmt.header_row)).filter(F.length("value") > 0)
    return body.select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")


def read_xlsx(spark: SparkSession, path: str, fmt: SourceFormat) -> DataFrame:
    path_column = next((c for c, n in fmt.column_map.items() if n == "full_path"), "Path")
    return xlsx.read_workbooks(spark, path, fmt.header_row, fmt.sheet_strategy, path_column=path_column)


#: A new format is one function and one entry.
READERS: dict[str, Callable[[SparkSession, str, SourceFormat], DataFrame]] = {"csv": read_csv, "treesize": read_xlsx}


def read_listing(spark: SparkSession, path: str, format_name: str, fmt: SourceFormat | None = None) -> DataFrame:
    """Raw listing; ValueError for an unknown format, FileNotFoundError for a missing local file."""
    if format_name not in READERS:
        raise ValueError(f"unknown format {format_name!r}; known: {', '.join(sorted(READERS))}")
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return READERS[format_name](spark, path, fmt or FORMATS.get(format_name, SourceFormat()))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Classified files; only the columns of ``schema`` are parsed."""
    return spark.read.schema(schema).json(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(full_path) of a text file of paths, or of a CSV file with one of the usual path columns."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        known = [c for c in ("Path", "path", "full_path", "Full Path") if c in df.columns]
        if not known:
            raise ValueError("no path column")
        return df.select(F.coalesce(*[F.col(f"`{c}`") for c in known]).alias("full_path"))
    return spark.read.text(path).select(F.col("value").alias("full_path"))


def read_place_names(spark: SparkSession, text_path: str | None = None, csv_path: str | None = None, least: int = 4) -> DataFrame:
    """(name): distinct lower-case names of a text file and of the place18nm column of a CSV file."""
    parts = []
    if text_path:
        parts.append(spark.read.text(text_path).select(F.col("value").alias("name")))
    if csv_path:
        parts.append(spark.read.option("header", True).csv(csv_path).select(F.col("place18nm").alias("name")))
    out = spark.createDataFrame([], "name string")
    for p in parts:
        out = out.unionByName(p)
    return out.select(F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= least).distinct()


def merge_sheets(first: DataFrame, second: DataFrame, path: str = "File Path") -> DataFrame:
    """One Path column of two sheets without blanks and repeats."""
    united = first.unionByName(second, allowMissingColumns=True).filter(F.trim(F.coalesce(F.col(f"`{path}`"), F.lit(""))) != "")
    return united.select(F.col(f"`{path}`").alias("Path")).distinct()


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("folder_path string, name string, confidence double, depth int, status string, unique_entities bigint, n_dev_categories int, direct_plot_children int, direct_category_children bigint").json(path)
