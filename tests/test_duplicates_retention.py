from datetime import datetime

import pytest
from pyspark.sql import functions as F

from estatelens.config import Retention
from estatelens.operators import duplicates, reports, retention

FILES = "row_id int, source_system string, segments array<string>, filename_stem string, extension string, size string, owner string, last_modified timestamp_ntz"


def files(spark):
    t1, t2 = datetime(2020, 1, 1), datetime(2021, 1, 1)
    return spark.createDataFrame(
        [
            (1, "E1", ["a"], "Plan", "pdf", "10", "x", t1), (2, "E2", ["b"], " plan ", "PDF", "10.0", "x", t2), (3, "E1", ["backup"], "Plan", "pdf", "11", None, t1), (4, "E1", [], "---", "pdf", "10", None, None),
            (5, "E1", [], "---", "pdf", "10", None, None), (6, "E1", ["c"], "q", None, None, None, None), (7, "E1", ["d"], "r", "txt", "1", None, None), (8, "E1", ["d"], "r", "txt", "1", "", None),
        ],
        FILES,
    )


def test_duplicates(spark):
    got = {r["row_id"]: r for r in duplicates.detect_duplicates(files(spark)).collect()}
    assert got[1]["dup_group_id"] == got[2]["dup_group_id"] != "" and len(got[1]["dup_group_id"]) == 12
    assert (got[1]["dup_is_latest"], got[2]["dup_is_latest"]) == (False, True)
    assert got[1]["dup_is_cross_estate"] and got[1]["dup_is_cross_folder"] and got[1]["dup_confidence"] == 0.9
    assert got[3]["dup_copy_path_suspect"] and not got[1]["dup_copy_path_suspect"]
    assert all(got[i]["dup_group_id"] == "" and got[i]["dup_is_latest"] for i in (3, 4, 5, 6))
    assert got[7]["dup_is_latest"] and got[8]["dup_is_latest"] and got[7]["dup_confidence"] == 0.9  # blank owners count as equal
    assert duplicates.detect_duplicates(files(spark).limit(0)).count() == 0


def test_folder_overlap_and_redundancy(spark):
    rows = [(i, "E", [f], f"n{i % 6}", "txt", "5", None, None) for f in ("p", "q") for i in range(6)] + [(99, "E", ["r"], "n1", "txt", "5", None, None)]
    df = spark.createDataFrame(rows, FILES)
    got = [tuple(r) for r in duplicates.folder_overlaps(df).select("folder_a", "folder_b", "shared", "jaccard").collect()]
    assert got == [("p", "q", 6, 1.0)]
    bands = {r["size_band"] for r in duplicates.redundancy(duplicates.exact_groups(df.withColumn("size", F.col("size").cast("bigint")))).collect()}
    assert bands == {"2", "3-5"}


RULES = Retention({"Lease": (None, "title", "high"), "Invoice": (6, "tax", "medium"), "Photo": (1, "x", "low")})


@pytest.mark.parametrize(
    "kind, date, status, expiry, risk",
    [
        ("Lease", datetime(2000, 1, 1), "Long-term", None, 6), ("Invoice", datetime(2000, 1, 1), "Expired", "2006-01-01T00:00:00", 95), ("Invoice", datetime(2020, 2, 29, 1), "Active", "2026-03-01T01:00:00", 30),
        ("Photo", datetime(2023, 6, 1), "Active", "2024-06-01T00:00:00", 35), ("Other", datetime(2017, 6, 1), "Expired", "2023-06-01T00:00:00", 60), ("Unknown", datetime(2017, 6, 1), "Unknown", None, 0), ("Invoice", None, "Unknown", None, 0), (None, None, "Unknown", None, 0),
    ],
)
def test_retention(spark, kind, date, status, expiry, risk):
    df = spark.createDataFrame([(kind, date)], "inferred_type string, last_modified timestamp_ntz")
    r = retention.apply_retention(df, RULES, datetime(2024, 1, 1)).head()
    assert (r["retention_status"], r["calculated_expiry_date"], r["retention_risk_score"]) == (status, expiry, risk)


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", "E"), ("a", "x", "E"), ("a", "y", "F"), ("a", "w", "F"), ("a", "w", "E"), ("", "x", "E"), (None, "x", "E")], "entity_plot string, inferred_type string, source_system string").withColumn("overall_confidence", F.lit(0.5))
    full = df.withColumns({"entity_plot_cluster_id": F.when(F.col("inferred_type") == "w", "c1").otherwise(""), "entity_plot_canonical": F.lit(""), "entity_plot_confidence": F.lit(0.5), "entity_plot_depth": F.lit(1), "segments": F.array(F.lit("s"), F.lit("a"), F.lit("x")), "entity_scheme": F.lit("S"), "entity_address": F.col("source_system"), "filename_stem": F.lit("f"), "extension": F.lit("pdf")})
    got = {(r["plot"], r["file_count"]): r for r in reports.entity_report(full, "plot", "address").collect()}
    assert set(got) == {("a", 3), ("a", 2)}
    r = got["a", 3]
    assert (r["variant_count"], r["avg_confidence"], r["typical_depth"], r["parent_folder"], r["full_path"], r["schemes"], r["unique_addresses"], r["top_types"], r["sample_filenames"], r["sample_addresses"], r["all_variants"]) == (1, 0.5, 1, "s", "s\\a", "S", 2, "x (2); y (1)", "f.pdf", "E; F", "")
    assert reports.entity_report(full.limit(0), "plot", "address").count() == 0
    top = reports.top_rows(df.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("n")), "n", "inferred_type", 2).collect()
    assert [(t["position"], t["inferred_type"]) for t in top] == [(1, "x"), (2, "w")]


def test_token_query_has_three_words(spark, tmp_path):
    """The query counts phrases of one to three words, as its operator and the reference do by default."""
    import __spark_entry__

    texts = "entity_plot entity_address entity_scheme inferred_type inferred_category dup_group_id entity_scheme_cluster_id entity_address_cluster_id entity_plot_cluster_id".split()
    rows = [(1, ["Harbour Wharf Crane Survey"], "harbour wharf crane"), (2, ["Other"], "harbour wharf crane"), (3, ["Other"], "crane survey")]
    df = spark.createDataFrame(rows, "row_id bigint, segments array<string>, filename_stem string").withColumns({c: F.lit(None).cast("string") for c in (*texts, "source_system", "full_path", "extension", "owner")})
    df.withColumns({"size": F.lit(1).cast("bigint"), "overall_confidence": F.lit(0.5), "scanned_at": F.lit(datetime(2020, 1, 1))}).write.parquet(f"{tmp_path}/classified_files.parquet")
    got = {r["term"]: (r["folder_count"], r["file_count"], r["n_projects"]) for r in __spark_entry__.queries()["a9_tokens"](spark, str(tmp_path)).collect()}
    assert got["harbour wharf crane"] == (1, 2, 2) and got["harbour wharf"] == (1, 2, 2) and got["crane survey"] == (1, 1, 2)
    assert "wharf crane survey" not in got and max(len(t.split()) for t in got) == 3


def test_folder_overlap_ignores_size(spark):
    """Other sizes, unknown sizes and names without a-z0-9 count; blank stems do not."""
    names = [("Plan", "5", "6"), ("letter", None, "7"), ("\u0430\u043a\u0442", "1", "1"), ("n3", "5", "5"), ("---", "5", "5"), ("", "5", "5"), (None, "5", "5")]
    rows = [(i, "E", ["p"], s, "TXT", a, None, None) for i, (s, a, _) in enumerate(names)] + [(10 + i, "E", ["q"], s and s.lower(), "txt", b, None, None) for i, (s, _, b) in enumerate(names)]
    got = [tuple(r) for r in duplicates.folder_overlaps(spark.createDataFrame(rows, FILES)).select("folder_a", "folder_b", "n_a", "n_b", "shared").collect()]
    assert got == [("p", "q", 5, 5, 5)]


def test_folder_spread_counts_qualifying_folders(spark):
    """A name in 60 folders of which 30 have enough files is not too widely spread."""
    rows = [(i, "E", [f"f{i:02}"], "common", "txt", "5", None, None) for i in range(60)] + [(100 + i, "E", [f"f{i:02}"], "other", "txt", "5", None, None) for i in range(30)]
    got = duplicates.folder_overlaps(spark.createDataFrame(rows, FILES), least_files=2).collect()
    assert len(got) == 30 * 29 // 2 and {r["shared"] for r in got} == {2}
