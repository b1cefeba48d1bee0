"""Sinks: JSON Lines, full and slim CSV, report CSV and text, sidecar JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the full CSV and their titles.
FULL = {
    "file_id": "File ID", "full_path": "Full Path", "relative_path": "Relative Path", "source_system": "Source System", "filename": "File Name", "filename_stem": "Filename Stem", "extension": "Extension",
    "last_modified": "Modified Date", "last_accessed": "Accessed Date", "size": "Size (KB)", "allocated": "Allocated (KB)", "file_count": "File Count", "folder_count": "Folder Count", "pct_parent": "Pct Parent", "owner": "Owner", "depth": "Depth",
    "inferred_type": "Primary Document Type", "type_confidence": "Type Confidence", "secondary_type": "Secondary Type", "secondary_type_confidence": "Secondary Type Confidence", "inferred_category": "Category", "category_confidence": "Category Confidence",
    "overall_confidence": "Overall Confidence", "confidence_band": "Confidence Band", "readiness_status": "Readiness Status",
    "entity_plot": "Plot / Unit", "entity_plot_confidence": "Plot Confidence", "entity_plot_depth": "Plot Depth", "entity_plot_is_scheme_name": "Plot Is Scheme Name", "entity_plot_cluster_id": "Plot Cluster ID", "entity_plot_canonical": "Plot Canonical", "raw_plots": "Raw Plots",
    "entity_address": "Address", "entity_address_confidence": "Address Confidence", "entity_address_depth": "Address Depth", "entity_address_is_scheme_name": "Address Is Scheme Name", "entity_address_cluster_id": "Address Cluster ID", "entity_address_canonical": "Address Canonical", "raw_addresss": "Raw Addresses",
    "entity_project_ref": "Project Ref", "entity_project_ref_confidence": "Project Ref Confidence", "entity_project_ref_depth": "Project Ref Depth", "entity_project_ref_cluster_id": "Project Ref Cluster ID", "entity_project_ref_canonical": "Project Ref Canonical", "raw_project_refs": "Raw Project Refs",
    "entity_scheme": "Scheme", "entity_scheme_confidence": "Scheme Confidence", "entity_scheme_path": "Scheme Path", "entity_scheme_depth": "Scheme Depth", "entity_scheme_place_name_match": "Scheme Place Name", "entity_scheme_address_like_name": "Scheme Address Match", "entity_scheme_cluster_id": "Scheme Cluster ID", "entity_scheme_canonical": "Scheme Canonical",
    "retention_category": "Retention Category", "retention_years": "Retention Years", "calculated_expiry_date": "Calculated Expiry Date", "retention_status": "Retention Status", "retention_basis": "Retention Basis", "sensitivity_level": "Sensitivity Level",
    "entity_scheme_cluster_size": "Scheme Cluster Size", "entity_address_cluster_size": "Address Cluster Size", "entity_plot_cluster_size": "Plot Cluster Size",
    "dup_group_id": "Duplicate Group ID", "dup_group_size": "Duplicate Group Size", "dup_is_latest": "Is Latest in Group", "potential_duplicate": "Potential Duplicate", "dup_is_cross_estate": "Cross-Estate Duplicate", "dup_is_cross_folder": "Cross-Folder Duplicate", "dup_copy_path_suspect": "Copy Path Suspect", "dup_confidence": "Duplicate Confidence",
    "segments": "Path Segments", "reasoning_trace": "Reasoning Trace", "batch_run_id": "Batch Run ID", "run_timestamp": "Run Timestamp",
}
#: Columns of the slim CSV and their titles.
SLIM = {
    "file_id": "File ID", "full_path": "Full Path", "source_system": "Source System", "filename": "File Name", "extension": "Extension", "last_modified": "Modified Date", "size": "Size (KB)",
    "inferred_type": "Primary Document Type", "secondary_type": "Secondary Type", "overall_confidence": "Confidence Score", "confidence_band": "Confidence Band",
    "entity_scheme": "Scheme / Project", "entity_scheme_cluster_id": "Scheme Cluster ID", "entity_scheme_canonical": "Scheme Cluster Name", "entity_address": "Address / Street", "entity_address_cluster_id": "Address Cluster ID", "entity_address_canonical": "Address Cluster Name",
    "entity_plot": "Plot / Unit", "entity_plot_cluster_id": "Plot Cluster ID", "entity_plot_canonical": "Plot Cluster Name", "entity_scheme_confidence": "Scheme Confidence", "entity_address_confidence": "Address Confidence", "entity_plot_confidence": "Plot Confidence",
    "retention_category": "Retention Category", "retention_years": "Retention Years", "calculated_expiry_date": "Calculated Expiry Date", "retention_status": "Retention Status", "sensitivity_level": "Sensitivity Level", "retention_risk_score": "Retention Risk Score",
    "entity_scheme_cluster_size": "Scheme Cluster Size", "entity_address_cluster_size": "Address Cluster Size", "entity_plot_cluster_size": "Plot Cluster Size",
    "dup_group_id": "Duplicate Group ID", "dup_group_size": "Duplicate Group Size", "dup_is_latest": "Is Latest in Group", "potential_duplicate": "Potential Duplicate",
}


def flat(c: Column, kind: T.DataType) -> Column:
    """A column as CSV text: "" for null, True and False, lists joined by " | ", raw matches as "value (confidence)"."""
    if isinstance(kind, T.ArrayType):
        item = (lambda x: F.concat(F.coalesce(x["value"], F.lit("")), F.lit(" ("), F.coalesce(x["confidence"].cast("string"), F.lit("")), F.lit(")"))) if isinstance(kind.elementType, T.StructType) and {"value", "confidence"} <= set(kind.elementType.names) else (lambda x: F.to_json(x) if isinstance(kind.elementType, T.StructType) else x.cast("string"))
        return F.coalesce(F.array_join(F.transform(c, item), " | "), F.lit(""))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def csv_frame(df: DataFrame, columns: tuple[str, ...] | None = None, titles: dict[str, str] | None = None) -> DataFrame:
    """All columns (or the named ones, by default those with titles; absent ones empty) as text under their titles."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = columns or tuple(titles or kinds)
    return df.select(*[(flat(F.col(f"`{c}`"), kinds[c]) if c in kinds else F.lit("")).alias((titles or {}).get(c, c)) for c in names])


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, titles: dict[str, str] | None = None) -> None:
    csv_frame(df, columns, titles).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row, partition by partition; nulls are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def write_sidecar(candidates: DataFrame, path: str) -> None:
    """All scheme candidates with their status, one JSON object per folder."""
    candidates.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, by: str, tie: str) -> None:
    """CSV in descending order of ``by`` with a position from 1 in the first column, behind a byte order mark."""
    from estatelens.session import numbered

    numbered_ = numbered(df, [F.desc(by), F.asc(tie)], "position").withColumn("position", F.col("position") + 1)
    titles = {"position": "\ufeff#"}
    csv_frame(numbered_.select("position", *df.columns).orderBy("position"), ("position", *df.columns), titles).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def text_lines(df: DataFrame, title: str, order: list[Column], most: int = 200) -> list[str]:
    """Title, column names, the first ``most`` rows in ``order`` and how many more there are."""
    rows = df.orderBy(*order).limit(most).collect()  # a report's length
    left = df.count() - len(rows) if len(rows) == most else 0
    lines = [title, "=" * len(title), " | ".join(df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]
    return lines + ([f"... and {left} more"] if left else [])


def text_report(df: DataFrame, path: str, title: str, order: list[Column] | None = None, most: int = 200) -> None:
    """A text table of the first ``most`` rows by ``order`` (by all columns if None) that says how many more there are, rendered on the driver, written by Spark."""
    write_text(df.sparkSession, text_lines(df, title, order or [F.col(f"`{c}`") for c in df.columns], most), path)


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def duplicate_report(files: DataFrame, path: str, most: int = 50) -> None:
    """Text of four sections over ``files`` as ``detect_duplicates`` leaves them: overview, groups by redundant bytes, folder pairs, copy keywords."""
    from estatelens.functions.text import human_size
    from estatelens.operators import duplicates as D

    inside = files.filter("dup_group_id <> ''")
    groups = D.redundancy(D.exact_groups(files))
    overview = inside.agg(F.count(F.lit(1)).alias("files_in_groups"), F.count_distinct("dup_group_id").alias("groups"), F.count_if("dup_is_cross_estate").alias("cross_estate"), F.count_if("dup_is_cross_folder").alias("cross_folder"), F.count_if("dup_copy_path_suspect").alias("copy_path_suspects"))
    bands = groups.groupBy("size_band").agg(F.count(F.lit(1)).alias("groups"), F.sum("redundant_bytes").alias("bytes"))
    sections = [
        text_lines(overview, "Overview", [F.lit(1)]),
        text_lines(bands.select("size_band", "groups", human_size(F.col("bytes")).alias("redundant")), "Sizes of groups", [F.col("size_band")]),
        text_lines(groups.withColumn("redundant", human_size(F.col("redundant_bytes"))), "Exact duplicates", [F.desc("redundant_bytes"), F.asc("dup_group_id")], most),
        text_lines(D.folder_overlaps(files), "Folders that share files", [F.desc("jaccard"), F.asc("folder_a"), F.asc("folder_b")], most),
        text_lines(D.copy_keyword_counts(files), "Copy paths", [F.desc("n_files"), F.asc("keyword")]),
    ]
    write_text(files.sparkSession, [line for s in sections for line in (*s, "")], path)


def review_report(files: DataFrame, path: str, most: int = 50) -> None:
    """Text of the clusters per entity, where their files lie, and the share of files with each finding."""
    from estatelens.operators import reports as R

    sections = [text_lines(R.coverage(files), "Coverage", [F.lit(1)])]
    for e in ("scheme", "address", "plot"):
        sections.append(text_lines(R.cluster_report(files, (e,)), f"Clusters: {e}", [F.desc("file_count"), F.asc("cluster_id")], most))
        sections.append(text_lines(R.cluster_review(files, e), f"Folders of clusters: {e}", [F.desc("n_files"), F.asc(f"entity_{e}_cluster_id"), F.asc("folder"), F.asc("source_system")], most))
    write_text(files.sparkSession, [line for s in sections for line in (*s, "")], path)
