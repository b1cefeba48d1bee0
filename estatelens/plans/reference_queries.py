"""Queries of matching, scoring, folder, cluster, duplicate, retention and report operators."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.config import Config, SchemeExclusions, default_config
from estatelens.operators import clustering, duplicates, extraction, folders, ingest, matching, reports, retention, scoring, similarity
from estatelens.plans.pipeline import classify, finish
from estatelens.plans.reference_sql import AS_OF, SQL  # noqa: F401
from estatelens.session import table
from estatelens.sources.sinks import csv_frame

_NOW = datetime.fromisoformat(AS_OF)


def _estate(spark: SparkSession, d: str) -> DataFrame:
    """classified_files with folders, names and entities with their depths; the date is the time of the scan."""
    t = table(spark, d, "classified_files")
    segments = F.coalesce("segments", F.array().cast("array<string>"))
    low = F.transform(segments, F.lower)
    plot, address = F.coalesce("entity_plot", F.lit("")), F.coalesce("entity_address", F.lit(""))
    return t.select(
        "row_id", "source_system", "full_path", segments.alias("segments"), F.coalesce("filename_stem", F.lit("")).alias("filename_stem"), F.lower(F.coalesce("extension", F.lit(""))).alias("extension"), "size", "owner", F.col("scanned_at").alias("last_modified"),
        plot.alias("entity_plot"), (F.coalesce(F.array_position(segments, plot), F.lit(0)).cast("int") - 1).alias("entity_plot_depth"), address.alias("entity_address"), (F.coalesce(F.array_position(low, address), F.lit(0)).cast("int") - 1).alias("entity_address_depth"),
        F.coalesce("entity_scheme", F.lit("")).alias("entity_scheme"), (F.coalesce(F.array_position(segments, F.coalesce("entity_scheme", F.lit(""))), F.lit(0)).cast("int") - 1).alias("entity_scheme_depth"), "inferred_type", "inferred_category", F.col("overall_confidence"), "dup_group_id",
        F.coalesce("entity_scheme_cluster_id", F.lit("")).alias("entity_scheme_cluster_id"), F.coalesce("entity_address_cluster_id", F.lit("")).alias("entity_address_cluster_id"), F.coalesce("entity_plot_cluster_id", F.lit("")).alias("entity_plot_cluster_id"),
        F.lit(1.0).alias("entity_plot_confidence"), F.lit(1.0).alias("entity_address_confidence"),
    )


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """The same with what the reports read: canonical forms, scheme paths, raw plots, a plot's context and confidences."""
    e = _estate(spark, d).join(table(spark, d, "classified_files").select(F.col("row_id").alias("__r"), F.coalesce("entity_address_canonical", F.lit("")).alias("entity_address_canonical")), F.col("row_id") == F.col("__r")).drop("__r")
    path = F.when(F.col("entity_scheme_depth") >= 0, F.array_join(F.slice("segments", F.lit(1), F.greatest(F.col("entity_scheme_depth"), F.lit(0)) + 1), "\\")).otherwise(F.col("entity_scheme"))
    context = F.when(F.col("entity_plot") == "", "").when(F.col("entity_scheme_cluster_id") != "", F.col("entity_scheme_cluster_id")).when(F.col("entity_address_cluster_id") != "", F.concat(F.lit("addr:"), "entity_address_cluster_id")).otherwise(F.concat(F.lit("__nocontext__"), F.array_join("segments", "\\")))
    raw = F.transform(F.filter("segments", lambda s: s.rlike("^[A-Z][a-z]+ [0-9]")), lambda s: F.struct(s.alias("value"), F.lit(0.5).alias("confidence")))
    sure = F.coalesce("overall_confidence", F.lit(0.0))
    return e.withColumns({"entity_scheme_canonical": F.upper("entity_scheme"), "entity_plot_canonical": F.lit(""), "entity_scheme_path": path, "entity_plot_cluster_context": context, "raw_plots": raw, "raw_addresss": raw, "entity_scheme_confidence": sure, "entity_address_confidence": sure, "entity_plot_confidence": sure})


def _round(df: DataFrame, *columns: str) -> DataFrame:
    """Means to ten decimals: the order in which doubles are added is not fixed."""
    return df.withColumns({c: F.round(c, 10) for c in columns})


def _stems(spark: SparkSession, d: str) -> DataFrame:
    e = _estate(spark, d)
    return matching.texts_of((e, F.col("filename_stem")))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return matching.texts_of((_estate(spark, d).select(F.explode("segments").alias("s")), F.col("s")))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("text", "label", "ord", "layer", "priority")


def m1_types(spark: SparkSession, d: str) -> DataFrame:
    """M1, M1a-d, M6: type of every distinct stem by phrase, pattern, abbreviation or misspelling."""
    return _hits(matching.type_hits(_stems(spark, d), default_config()))


def m2_categories(spark: SparkSession, d: str) -> DataFrame:
    return _hits(matching.category_hits(_names(spark, d), default_config()))


def m3_extensions(spark: SparkSession, d: str) -> DataFrame:
    return matching.extension_hits(_estate(spark, d).select("extension").distinct(), default_config()).select("extension", "label")


def m4_entities(spark: SparkSession, d: str) -> DataFrame:
    names, c = _names(spark, d), default_config()
    organisational = matching.type_hits(names, c).select("text").unionAll(matching.category_hits(names, c).select("text"))
    return _hits(matching.entity_hits(names, c, organisational))


def m5_folder_signals(spark: SparkSession, d: str) -> DataFrame:
    """M5: category, type and entity signals per folder chain and depth."""
    e, c = _estate(spark, d), default_config()
    s = scoring.folder_signals(e, scoring.text_signals(e, c), c)
    kinds = [("folder_types", "type", "label"), ("folder_categories", "category", "label"), ("folder_entities", "entity", "entity")]
    out = None
    for column, kind, field in kinds:
        own = s.select(F.array_join("segments", "\\").alias("chain"), F.explode(column).alias("x")).select("chain", F.lit(kind).alias("kind"), F.col(f"x.{field}").alias("label"), F.col("x.depth").alias("depth"))
        out = own if out is None else out.unionByName(own)
    return out


def m7_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt tokens with their dictionary word."""
    return matching.misspelt(_stems(spark, d).select(F.explode("tokens").alias("variant")).distinct(), default_config())


PLACES = frozenset({"quillmere", "thrapcombe quay", "wexgarth", "zerouer"})


def m10_places(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    return names.select("text").join(matching.place_texts(names, PLACES).withColumn("is_place", F.lit(True)), "text", "left").select("text", F.coalesce("is_place", F.lit(False)).alias("is_place"))


def m11_known(spark: SparkSession, d: str) -> DataFrame:
    tokens = _stems(spark, d).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return tokens.join(matching.known_terms(default_config(), spark), "term")


def r_scores(spark: SparkSession, d: str) -> DataFrame:
    """Types, categories, confidences, bands."""
    s = scoring.score(_estate(spark, d).select("row_id", "segments", "filename_stem", "extension"), default_config())
    return s.select("row_id", "inferred_type", "overall_confidence", "secondary_type", "inferred_category", "category_confidence", "confidence_band", "readiness_status", "is_ambiguous")


def r10_entities(spark: SparkSession, d: str) -> DataFrame:
    """Deepest match and number of matches per entity."""
    s = scoring.score(_estate(spark, d).select("row_id", "segments", "filename_stem", "extension"), default_config())
    return s.select("row_id", "entity_plot", "entity_plot_depth", "entity_plot_confidence", F.size("raw_plots").alias("n_plots"), "entity_address", "entity_address_depth", F.size("raw_addresss").alias("n_addresses"))


def d1_folder_stats(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up per folder with direct children."""
    f = folders.folder_stats(_estate(spark, d))
    return f.join(folders.direct_children(f), "folder_path", "left").select("folder_path", "level", "file_count", "n_plots", "n_addresses", "direct_plot_children", F.coalesce("total_direct_children", F.lit(0)).alias("total_direct_children"))


def d3_categories(spark: SparkSession, d: str) -> DataFrame:
    """Signal categories beneath each folder and children that have one."""
    c = default_config()
    f = folders.folder_stats(_estate(spark, d))
    hits = matching.category_hits(matching.texts_of((f, F.col("name"))), c)
    out = folders.category_propagation(f, hits, c)
    return out.select("folder_path", F.array_join(F.array_sort("dev_categories"), "|").alias("categories"), F.coalesce("direct_category_children", F.lit(0)).alias("direct_category_children"))


def d6_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Gated folders with the reason that excludes them."""
    return folders.scheme_candidates(_estate(spark, d), default_config()).select("folder_path", "unique_entities", "n_dev_categories", F.coalesce("excluded_by", F.lit("")).alias("excluded_by"))


def place_config() -> Config:
    """The built-in dictionary with place names and exclusions."""
    return replace(default_config(), place_names=PLACES, exclusions=SchemeExclusions(("thrapcombe quay",), ("drawing",), (r"^block\b",)))


def d12_places(spark: SparkSession, d: str) -> DataFrame:
    """The candidates where place names and exclusions are set."""
    return folders.scheme_candidates(_estate(spark, d), place_config()).select("folder_path", F.coalesce("excluded_by", F.lit("")).alias("excluded_by"))


def d13_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Confidence and status of the candidates."""
    c = default_config()
    return folders.score_schemes(folders.scheme_candidates(_estate(spark, d), c), c).select("folder_path", "confidence", "status")


def d17_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Scheme of every file."""
    e = _estate(spark, d).drop("entity_scheme", "entity_scheme_depth")
    return folders.detect_schemes(e, default_config())[0].select("row_id", "entity_scheme", "entity_scheme_depth", "entity_scheme_path", "entity_scheme_confidence")


def d19_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """D19, T21, SK4, S12: all candidates with status and the terms of their score."""
    c = default_config()
    return folders.score_trace(folders.detect_schemes(_estate(spark, d).drop("entity_scheme", "entity_scheme_depth"), c)[1], c).select("folder_path", "status", "trace")


def j15_tree_status(spark: SparkSession, d: str) -> DataFrame:
    """Folders of level 2 to 4 with the status of their scheme candidate."""
    e = _estate(spark, d)
    return folders.sidecar_join(folders.folder_tree(e, entities=()), folders.detect_schemes(e.drop("entity_scheme", "entity_scheme_depth"), default_config())[1]).select("folder_path", "file_count", "scheme_status", "scheme_confidence")


def d20_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """D20, D21."""
    return folders.enforce_hierarchy(_estate(spark, d)).select("row_id", "entity_plot", "entity_plot_depth", "entity_plot_is_scheme_name", "entity_address", "entity_address_depth", "entity_address_is_scheme_name")


def d22_tree(spark: SparkSession, d: str) -> DataFrame:
    """D22, J12."""
    return _round(folders.folder_tree(_reported(spark, d)), "mean_confidence")


def d23_leaves(spark: SparkSession, d: str) -> DataFrame:
    """D23, J5."""
    return folders.leaf_folders(_estate(spark, d))


def d24_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return folders.leaf_conflicts(_reported(spark, d))


def e1_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the distinct folder names."""
    return extraction.extract_distinct(_names(spark, d).select(F.col("text").alias("value")), default_config(), "address")


def e2_plots(spark: SparkSession, d: str) -> DataFrame:
    """E2-E6."""
    return extraction.extract_distinct(_names(spark, d).select(F.col("text").alias("value")), default_config(), "plot")


def e7_schemes(spark: SparkSession, d: str) -> DataFrame:
    """E7, T10, T15."""
    return extraction.extract_distinct(_estate(spark, d).select(F.col("entity_scheme").alias("value")), default_config(), "scheme")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return clustering.value_pool(_estate(spark, d).select("row_id", "segments", "entity_scheme", "entity_scheme_depth"), "scheme")


def c1_pool(spark: SparkSession, d: str) -> DataFrame:
    """Scheme names with their votes."""
    return _pool(spark, d)


def c3_links(spark: SparkSession, d: str) -> DataFrame:
    """Similar scheme names."""
    return similarity.similar_values(_pool(spark, d), 0.55)


def c4_groups(spark: SparkSession, d: str) -> DataFrame:
    """C4: single-linkage groups of the scheme names."""
    pool = _pool(spark, d)
    return similarity.linked_groups(pool.select(F.col("value").alias("node")), similarity.similar_values(pool, 0.55))


def c5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Scheme clusters with canonical names and ids."""
    return clustering.cluster_values(_pool(spark, d), "scheme").select("value", "canonical", "cluster_id")


def c10_sizes(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster_sizes(_estate(spark, d).select("row_id", "entity_scheme_cluster_id"), "scheme").select("row_id", "entity_scheme_cluster_size")


def c8_plots(spark: SparkSession, d: str) -> DataFrame:
    """Plot clusters by context."""
    return clustering.cluster_plots(_estate(spark, d)).select("row_id", "entity_plot_cluster_context", "entity_plot_canonical", "entity_plot_cluster_size")


def c9_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """C7-C11, J13, J14, E8 and all before: the whole chain from the listing."""
    files = ingest.decompose_paths(table(spark, d, "classified_files").select("row_id", "full_path", "size", "owner", "source_system", F.col("scanned_at").alias("last_modified")))
    df, _ = classify(files, default_config())
    return finish(df, default_config(), _NOW, batch_run_id="run", run_timestamp=AS_OF).select("row_id", "inferred_type", "entity_scheme", "entity_scheme_cluster_id", "entity_address_cluster_id", "entity_plot_cluster_id", "entity_plot_cluster_context", "dup_group_id", "retention_status", "retention_risk_score", "file_id")


def u1_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """U1-U7, T18, J3, J4."""
    out = duplicates.detect_duplicates(_estate(spark, d))
    return out.select("row_id", "dup_group_id", "dup_group_size", "dup_confidence", "dup_is_cross_estate", "dup_is_cross_folder", "dup_is_latest", "potential_duplicate", "dup_copy_path_suspect")


def u8_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of at least five files that share half of them."""
    return duplicates.folder_overlaps(_estate(spark, d)).select("folder_a", "folder_b", "n_a", "n_b", "shared", "jaccard")


def u8_pairs(spark: SparkSession, d: str) -> DataFrame:
    """U8, J9 with lower bounds: folders of at least two files that share 0.3 of them."""
    return duplicates.folder_overlaps(_estate(spark, d), 50, 2, 0.3).select("folder_a", "folder_b", "n_a", "n_b", "shared", "jaccard")


def u9_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.redundancy(duplicates.exact_groups(_estate(spark, d)))


def u10_keywords(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copy_keyword_counts(duplicates.copy_path_suspects(_estate(spark, d)))


def g_retention(spark: SparkSession, d: str) -> DataFrame:
    """G1-G4, T19, T20, J2."""
    df = _estate(spark, d).withColumn("last_modified", F.col("last_modified") - F.make_interval(years=F.pmod(F.col("row_id"), F.lit(30)).cast("int")))
    return retention.apply_retention(df, default_config().retention, _NOW).select("row_id", "retention_years", "retention_permanent", "sensitivity_level", "calculated_expiry_date", "retention_status", "retention_risk_score")


def a1_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("overall_confidence")
    return reports.summary(_estate(spark, d).withColumn("confidence_band", F.when(c >= 0.5, "High").when(c >= 0.35, "Medium").otherwise("Low")))


def a2_addresses(spark: SparkSession, d: str) -> DataFrame:
    return reports.entity_report(_reported(spark, d), "address", "plot")


def a3_plots(spark: SparkSession, d: str) -> DataFrame:
    return reports.entity_report(_reported(spark, d).drop("raw_plots"), "plot", "address")


def a4_schemes(spark: SparkSession, d: str) -> DataFrame:
    return reports.scheme_report(_reported(spark, d), "R:\\data")


def a5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all entities, and what the contexts of plots stand for."""
    return reports.cluster_report(_reported(spark, d))


def a6_review(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_review(_estate(spark, d), "address")


def a7_versions(spark: SparkSession, d: str) -> DataFrame:
    return reports.version_clusters(_estate(spark, d).withColumn("version_cluster_id", F.col("dup_group_id"))).drop("has_marker")


def a8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(_estate(spark, d))


def a9_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A9, F6, F7, M11."""
    return reports.token_report(_estate(spark, d), matching.known_terms(default_config(), spark), 3, least_count=2)


def a10_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.scheme_summary(_estate(spark, d)), "mean", "median")


def a10_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A10: files whose scheme is their address, and others with both."""
    return reports.entity_overlap(_reported(spark, d).withColumn("entity_address", F.when(F.col("row_id") % 7 == 0, F.col("entity_scheme")).otherwise(F.col("entity_address"))))


def a11_types(spark: SparkSession, d: str) -> DataFrame:
    return _estate(spark, d).groupBy("inferred_type").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("source_system").alias("n_estates"))


def a12_top(spark: SparkSession, d: str) -> DataFrame:
    """A12, SK5: the ten types with the most files, numbered."""
    return reports.top_rows(a11_types(spark, d).filter("inferred_type IS NOT NULL"), "n_files", "inferred_type", 10)


def proj10_entity_types(spark: SparkSession, d: str) -> DataFrame:
    """Literal tags and the names of the entities of a row."""
    e = ingest.tag_source(_estate(spark, d), "Estate X", "/root")
    return e.select("row_id", reports.entity_types().alias("entity_types"), "source_system", "root_prefix")


def sk2_csv(spark: SparkSession, d: str) -> DataFrame:
    """SK2, SK3: rows as CSV text."""
    t = table(spark, d, "classified_files").select("row_id", "source_system", "segments", "depth", "owner", "dup_is_latest")
    return csv_frame(t, ("row_id", "source_system", "segments", "depth", "owner", "dup_is_latest", "absent"), {"row_id": "Row", "segments": "Folders"})


def q1_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Listing to counts by type and band: filters, paths, matching and scoring."""
    from estatelens.plans.ingest_queries import listing

    files = ingest.decompose_paths(ingest.apply_filters(listing(spark, d)))
    s = scoring.score(files.select("row_id", "segments", "filename_stem", "extension"), default_config())
    return s.groupBy("inferred_type", "confidence_band").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("m1 m2 m3 m4 m5 m7 m10 m11 r r10 d1 d3 d6 d12 d13 d17 d20 d22 d23 d24 e1 e2 e7 c1 c3 c4 c5 c8 c9 c10 u1 u8 u9 u10 g a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12 sk2 q1 d19 j15 proj10".split())}
