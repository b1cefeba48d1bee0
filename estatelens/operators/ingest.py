"""Listing rows to internal file rows: mapping, filters with audit, normalisation, path decomposition, audit fields."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import nfc

log = logging.getLogger(__name__)
BS = "\\"


@dataclass(frozen=True)
class Exclusions:
    """Names of system files that are removed."""

    filenames: tuple[str, ...] = ("thumbs.db", "desktop.ini", ".ds_store")
    prefixes: tuple[str, ...] = ("~$",)
    extensions: tuple[str, ...] = ("tmp", "bak")


@dataclass(frozen=True)
class SourceFormat:
    """Source column names to internal names, and where the header is."""

    column_map: dict[str, str] = field(default_factory=dict)
    header_row: int = 0
    sheet_strategy: str = "largest"
    encoding: str = "utf-8"


#: Internal names of the columns of known exports.
FORMATS = {
    "treesize": SourceFormat(
        {"Path": "full_path", "Size": "size", "Allocated": "allocated", "Files": "file_count", "Folders": "folder_count", "% of Parent (Allocated)": "pct_parent", "Last Modified": "last_modified", "Last Accessed": "last_accessed", "Owner": "owner"},
        header_row=4,
    ),
    "csv": SourceFormat({"Path": "full_path", "Size": "size", "Last Modified": "last_modified", "Last Accessed": "last_accessed", "Owner": "owner"}),
}


def map_columns(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """Rename the mapped columns that are there and drop all others."""
    missing = [s for s in column_map if s not in df.columns]
    if missing:
        log.warning("columns not in the source: %s", ", ".join(missing))
    return df.select(*[F.col(f"`{s}`").alias(i) for s, i in column_map.items() if s in df.columns])


def validate(df: DataFrame, required: tuple[str, ...] = ("full_path",)) -> DataFrame:
    """``df`` if it has the required columns, else ValueError."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


# filters


def last_component(path: Column) -> Column:
    """What follows the last backslash; slashes do not separate here."""
    return F.element_at(F.split(path, r"\\"), -1)


def is_null_path(path: Column) -> Column:
    """Null, blank, "nan", or without any separator."""
    bare = F.trim(path)
    return path.isNull() | (bare == "") | (bare == "nan") | ~(F.contains(path, F.lit(BS)) | F.contains(path, F.lit("/")))


def is_folder_row(path: Column, folder_count: Column) -> Column:
    """Path that ends in a backslash, or a row that counts folders."""
    return F.endswith(F.rtrim(path), F.lit(BS)) | (F.coalesce(folder_count.try_cast("double"), F.lit(0.0)) > 0)


def system_rules(path: Column, ex: Exclusions) -> dict[str, Column]:
    """The rules that make a row a system file, by name of the rule."""
    name = last_component(path)
    prefixed = F.lit(False)
    for p in ex.prefixes:
        prefixed = prefixed | F.startswith(name, F.lit(p))
    return {
        "filenames": F.lower(name).isin(*[f.lower() for f in ex.filenames]),
        "prefixes": prefixed,
        "extensions": F.element_at(F.split(F.lower(name), r"\."), -1).isin(*[e.lower() for e in ex.extensions]),
    }


def tag_removals(df: DataFrame, ex: Exclusions = Exclusions()) -> DataFrame:
    """Adds ``removal_reason`` (null for rows that stay) and a flag per system rule; the first reason holds."""
    count = F.col("folder_count") if "folder_count" in df.columns else F.lit(None).cast("double")
    path = F.col("full_path").cast("string")
    rules = system_rules(path, ex)
    any_rule = F.lit(False)
    for r in rules.values():
        any_rule = any_rule | F.coalesce(r, F.lit(False))
    reason = F.when(is_null_path(path), "null_path").when(is_folder_row(path, count), "folder_row").when(any_rule, "system_file")
    out = df.withColumn("removal_reason", reason)
    open_ = F.coalesce(F.col("removal_reason"), F.lit("system_file")) == "system_file"
    return out.withColumns({f"rule_{n}": open_ & F.coalesce(r, F.lit(False)) for n, r in rules.items()})


def apply_filters(df: DataFrame, ex: Exclusions = Exclusions()) -> DataFrame:
    """Rows without null paths, folder rows and system files."""
    return tag_removals(df, ex).filter("removal_reason IS NULL").select(*df.columns)


def filter_audit(df: DataFrame, ex: Exclusions = Exclusions()) -> DataFrame:
    """One row of counts: initial, removed by reason, final, and each system rule by itself (rules may overlap)."""
    tagged = tag_removals(df, ex)
    reasons = {n: F.count_if(F.coalesce(F.col("removal_reason") == r, F.lit(False))) for n, r in (("null_paths", "null_path"), ("folder_rows", "folder_row"), ("system_files", "system_file"))}
    return tagged.agg(
        F.count(F.lit(1)).alias("initial"), *[c.alias(n) for n, c in reasons.items()], F.count_if(F.col("removal_reason").isNull()).alias("final"), *[F.count_if(F.col(f"rule_{n}")).alias(f"rule_{n}") for n in ("filenames", "prefixes", "extensions")]
    )


# normalisation

_DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")


def parse_date(c: Column) -> Column:
    """Timestamp without zone by the first fitting format, null if none fits."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in _DATE_FORMATS])


def clean_owner(c: Column) -> Column:
    bare = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(bare == "nan", "").otherwise(bare)


def is_sid(owner: Column) -> Column:
    return F.startswith(owner, F.lit("S-1-5-"))


def normalise(df: DataFrame) -> DataFrame:
    """NFC paths, dates as timestamps, stripped owners; runs after the filters, since NFC is a barrier to pushdown."""
    changed = {"full_path": nfc(F.col("full_path"))}
    for c in ("last_modified", "last_accessed"):
        if c in df.columns and dict(df.dtypes)[c] not in ("timestamp", "timestamp_ntz"):
            changed[c] = parse_date(F.col(c))
    if "owner" in df.columns:
        changed["owner"] = clean_owner(F.col("owner"))
    return df.withColumns(changed)


# paths


def path_parts(path: Column) -> Column:
    """Non-empty components, either separator."""
    return F.filter(F.split(F.translate(path, "/", BS), r"\\"), lambda p: p != "")


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and lower-case extension; a name without dot, or with only a leading one, has none."""
    plain = ~F.contains(name, F.lit(".")) | (F.startswith(name, F.lit(".")) & (F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) == 1))
    extension = F.substring_index(name, ".", -1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(extension) - 1)
    return F.when(plain, name).otherwise(stem), F.when(plain, "").otherwise(F.lower(extension))


def decompose_paths(df: DataFrame, root_prefix: str = "", path: str = "full_path") -> DataFrame:
    """Adds relative_path, segments, filename_stem, extension and depth.

    The root is stripped, ignoring case, only where all its parts match. A path equal to the
    root has empty parts and depth 0.
    """
    root = [p.lower() for p in root_prefix.replace("/", BS).split(BS) if p]
    parts = F.col("__parts")
    if root:
        same = F.transform(F.slice(parts, 1, len(root)), F.lower) == F.array(*[F.lit(p) for p in root])
        rest = F.when(same, F.slice(parts, len(root) + 1, F.greatest(F.size(parts) - len(root), F.lit(0)))).otherwise(parts)
    else:
        rest = parts
    out = df.withColumn("__parts", F.coalesce(path_parts(F.col(path)), F.array().cast("array<string>"))).withColumn("__rest", rest)
    name = F.coalesce(F.try_element_at("__rest", F.lit(-1)), F.lit(""))
    out = out.withColumn("__name", name)
    stem, extension = split_name(F.col("__name"))
    folders = F.slice("__rest", 1, F.greatest(F.size("__rest") - 1, F.lit(0)))
    return out.select(*[c for c in df.columns if c not in ("relative_path", "segments", "filename_stem", "extension", "depth")], F.array_join("__rest", BS).alias("relative_path"), folders.alias("segments"), stem.alias("filename_stem"), extension.alias("extension"), F.size(folders).alias("depth"))


def depth_stats(df: DataFrame) -> DataFrame:
    """One row: files, median and largest depth, root-level files, files without extension."""
    return df.agg(F.count(F.lit(1)).alias("n_files"), F.percentile("depth", F.lit(0.5)).alias("median_depth"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") == 0).alias("root_level"), F.count_if(F.col("extension") == "").alias("no_extension"))


def depth_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("depth").agg(F.count(F.lit(1)).alias("n_files"))


# audit fields


def file_id(path: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(path, 256), 1, length)


def filename(stem: Column, extension: Column) -> Column:
    return F.when(F.coalesce(extension, F.lit("")) != "", F.concat(stem, F.lit("."), extension)).otherwise(stem)


def add_audit_fields(df: DataFrame, batch_run_id: str | None = None, run_timestamp: str | None = None, id_length: int = 16) -> DataFrame:
    """file_id, filename, and one batch id and time for the whole run."""
    return df.withColumns(
        {
            "file_id": file_id(F.col("full_path"), id_length),
            "filename": filename(F.col("filename_stem"), F.col("extension")),
            "batch_run_id": F.lit(batch_run_id or str(uuid.uuid4())),
            "run_timestamp": F.lit(run_timestamp or datetime.now(timezone.utc).isoformat()),
        }
    )


def tag_source(df: DataFrame, source_system: str, root_prefix: str) -> DataFrame:
    return df.withColumns({"source_system": F.lit(source_system), "root_prefix": F.lit(root_prefix)})


def folder_key(segments: Column, level: Column | int) -> Column:
    """Path of the first ``level`` folders."""
    return F.array_join(F.slice(segments, F.lit(1), F.lit(level) if isinstance(level, int) else level), BS)


def display_path(segments: Column) -> Column:
    """Folders above the last one; empty for fewer than two."""
    return F.when(F.size(segments) >= 2, folder_key(segments, F.size(segments) - 1)).otherwise("")


def level_columns(df: DataFrame, levels: int, segments: str = "segments") -> DataFrame:
    """level_1 ... level_n; empty where the path is shorter."""
    return df.withColumns({f"level_{i}": F.coalesce(F.try_element_at(segments, F.lit(i)), F.lit("")) for i in range(1, levels + 1)})
