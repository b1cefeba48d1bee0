"""Exact duplicates, copy-path suspects, duplicate folders and their reports.

Group facts come from one aggregation by key (map-side combined) that is joined back, not from windows, so a
key that holds a third of the rows stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.config import WEIGHTS
from estatelens.functions.text import normalise_size
from estatelens.operators.ingest import BS


def duplicate_key(stem: Column, extension: Column, size: Column) -> Column:
    """``stem|extension|size``, trimmed and in lower case; null where the stem is empty or has no letter or digit, or the size is unknown."""
    bare, n = F.lower(F.trim(stem)), normalise_size(size)
    key = F.concat_ws("|", bare, F.coalesce(F.lower(F.trim(extension)), F.lit("")), n.cast("string"))
    return F.when(bare.rlike("[a-z0-9]") & (n >= 0), key)


def exact_groups(files: DataFrame, date: str = "last_modified", owner: str = "owner", weights: dict | None = None) -> DataFrame:
    """One row per key with at least two files: n, group id, confidence, cross flags and newest date."""
    w = {**WEIGHTS["duplicate_detection"], **((weights or {}).get("duplicate_detection") or {})}
    folder = F.array_join("segments", BS)
    keyed = files.withColumn("__key", duplicate_key(F.col("filename_stem"), F.col("extension"), F.col("size"))).filter("__key IS NOT NULL")
    owners = F.coalesce(F.col(owner), F.lit(""))
    inner = F.when(F.size("segments") > 0, folder)
    groups = keyed.groupBy("__key").agg(
        F.count(F.lit(1)).alias("dup_group_size"),
        ((F.count(date) == F.count(F.lit(1))) & (F.min(date) == F.max(date))).alias("same_date"),
        (F.min(owners) == F.max(owners)).alias("same_owner"),
        F.coalesce(F.min("source_system") != F.max("source_system"), F.lit(False)).alias("dup_is_cross_estate"),
        F.coalesce(F.min(inner) != F.max(inner), F.lit(False)).alias("dup_is_cross_folder"),
        F.max(date).alias("newest"),
        F.min("size").alias("first_size"),
    )
    confidence = F.lit(float(w["base_confidence"])) + F.when(F.coalesce(F.col("same_date"), F.lit(False)), float(w["date_match_boost"])).otherwise(0.0) + F.when(F.col("same_owner"), float(w["owner_match_boost"])).otherwise(0.0)
    return groups.filter("dup_group_size >= 2").withColumns({"dup_group_id": F.substring(F.sha2("__key", 256), 1, 12), "dup_confidence": F.least(F.lit(1.0), F.round(confidence, 3))})


def detect_duplicates(files: DataFrame, date: str = "last_modified", owner: str = "owner", weights: dict | None = None) -> DataFrame:
    """``files`` with dup_group_id ("" outside groups), size, confidence, flags, dup_is_latest, potential_duplicate and dup_copy_path_suspect."""
    own = ["dup_group_id", "dup_group_size", "dup_confidence", "dup_is_cross_estate", "dup_is_cross_folder", "dup_is_latest", "potential_duplicate", "dup_copy_path_suspect"]
    base = files.select(*[c for c in files.columns if c not in own]).withColumn("__k", duplicate_key(F.col("filename_stem"), F.col("extension"), F.col("size")))
    groups = exact_groups(base, date, owner, weights).select(F.col("__key").alias("__gk"), "dup_group_id", "dup_group_size", "dup_confidence", "dup_is_cross_estate", "dup_is_cross_folder", F.col("newest").alias("__newest"), F.coalesce(F.col("same_date"), F.lit(False)).alias("__same"))
    out = base.join(groups, F.col("__k") == F.col("__gk"), "left")
    latest = F.col("__gk").isNull() | F.col("__newest").isNull() | F.coalesce(F.col(date) == F.col("__newest"), F.lit(False))
    out = out.withColumns(
        {
            "dup_is_latest": latest,
            "dup_group_id": F.coalesce("dup_group_id", F.lit("")),
            "dup_group_size": F.coalesce("dup_group_size", F.lit(1).cast("bigint")),
            "dup_confidence": F.coalesce("dup_confidence", F.lit(0.0)),
            "dup_is_cross_estate": F.coalesce("dup_is_cross_estate", F.lit(False)),
            "dup_is_cross_folder": F.coalesce("dup_is_cross_folder", F.lit(False)),
            "potential_duplicate": F.col("__gk").isNotNull(),
        }
    ).drop("__k", "__gk", "__newest", "__same")
    return copy_path_suspects(out, weights)


def in_copy_path(segments: Column, weights: dict | None = None) -> Column:
    """A folder of the path is named like a copy."""
    words = {**WEIGHTS["duplicate_detection"], **((weights or {}).get("duplicate_detection") or {})}["copy_path_keywords"]
    return F.coalesce(F.arrays_overlap(F.transform(segments, lambda s: F.lower(F.trim(s))), F.array(*[F.lit(w) for w in words])), F.lit(False))


def copy_path_suspects(files: DataFrame, weights: dict | None = None) -> DataFrame:
    """Adds dup_copy_path_suspect: in a copy path, and a file of the same name and extension is outside all copy paths."""
    name = F.concat_ws("|", F.lower(F.coalesce("filename_stem", F.lit(""))), F.lower(F.coalesce("extension", F.lit(""))))
    marked = files.withColumns({"__copy": in_copy_path(F.col("segments"), weights), "__name": name})
    originals = marked.filter(~F.col("__copy")).select(F.col("__name").alias("__original")).distinct()
    return marked.join(originals, F.col("__copy") & (F.col("__name") == F.col("__original")), "left").withColumn("dup_copy_path_suspect", F.col("__original").isNotNull()).drop("__copy", "__name", "__original")


# reports


def redundancy(groups: DataFrame, top: int | None = None) -> DataFrame:
    """Bytes that the copies of each group take up, and its size band; the ``top`` largest if given."""
    n = F.col("dup_group_size")
    band = F.when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("20+")
    out = groups.select("dup_group_id", "dup_group_size", (F.col("first_size") * (n - 1)).alias("redundant_bytes"), band.alias("size_band"))
    return out.orderBy(F.desc("redundant_bytes"), "dup_group_id").limit(top) if top else out


def copy_keyword_counts(files: DataFrame, weights: dict | None = None) -> DataFrame:
    """Suspect files per copy keyword."""
    words = {**WEIGHTS["duplicate_detection"], **((weights or {}).get("duplicate_detection") or {})}["copy_path_keywords"]
    suspects = files.filter("dup_copy_path_suspect").select(F.explode(F.array_distinct(F.transform("segments", lambda s: F.lower(F.trim(s))))).alias("keyword"))
    return suspects.filter(F.col("keyword").isin(*words)).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_files"))


def folder_overlaps(files: DataFrame, most_spread: int = 50, least_files: int = 5, threshold: float = 0.5) -> DataFrame:
    """Pairs of folders that share files by (stem, extension) in lower case, whatever their size: shared count and Jaccard lower bound.

    Folders with fewer than ``least_files`` such files take no part. A signature that occurs in more than ``most_spread``
    of the others adds nothing to the shared count (it stays in the union), which is part of the definition of this report.
    """
    folder = F.array_join("segments", BS)
    sig = F.concat_ws("|", F.lower("filename_stem"), F.lower(F.coalesce("extension", F.lit(""))))
    items = files.filter((F.size("segments") > 0) & (F.col("filename_stem") != "")).select(folder.alias("folder"), sig.alias("sig")).distinct()
    sizes = items.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_files)
    inside = items.join(sizes, "folder")
    spread = inside.groupBy("sig").agg(F.count(F.lit(1)).alias("spread")).filter((F.col("spread") > 1) & (F.col("spread") <= most_spread)).select("sig")
    kept = inside.join(spread, "sig")
    a, b = kept.select("sig", F.col("folder").alias("folder_a"), F.col("n").alias("n_a")), kept.select("sig", F.col("folder").alias("folder_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "sig").filter("folder_a < folder_b").groupBy("folder_a", "folder_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    score = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return pairs.withColumn("jaccard", score).filter(F.col("jaccard") >= threshold)
