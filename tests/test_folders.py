from pyspark.sql import functions as F

from estatelens.config import default_config
from estatelens.operators import folders

SCHEMA = "row_id int, segments array<string>, entity_plot string, entity_plot_depth int, entity_address string, entity_address_depth int"


def estate(spark, rows):
    out = []
    for i, (segs, plot, address) in enumerate(rows):
        out.append((i, segs, plot or "", segs.index(plot) if plot in segs else -1, address or "", segs.index(address) if address in segs else -1))
    return spark.createDataFrame(out, SCHEMA)


def site(name, n=6, top="Development"):
    return [([top, name, f"Plot {i}", "Sales"], f"Plot {i}", None) for i in range(n)]


def test_stats_and_leaves(spark):
    df = estate(spark, [*site("Oak Field", 3), ([], None, None), (["plot"], None, None), (["plot 1"], None, None), (["plot", "a"], None, None)])
    s = {r["folder_path"]: r for r in folders.folder_stats(df).collect()}
    assert (s["Development\\Oak Field"]["n_plots"], s["Development\\Oak Field"]["file_count"], s["Development\\Oak Field"]["direct_plot_children"]) == (3, 3, 1)
    assert s["Development"]["direct_plot_children"] == 0 and s["Development"]["parent_path"] is None
    leaves = {r[0] for r in folders.leaf_folders(df).collect()}
    assert leaves == {f"Development\\Oak Field\\Plot {i}\\Sales" for i in range(3)} | {"plot 1", "plot\\a"}


def test_schemes(spark):
    rows = [*site("Oak Field"), *site("Elm Rise", 4), *site("Ash Way", 5), *[(["Finance", "Old Wood", f"Plot {i}"], f"Plot {i}", None) for i in range(4)], (["Loose"], None, None)]
    assigned, sidecar = folders.detect_schemes(estate(spark, rows), default_config())
    status = {r["folder_path"]: (r["status"], r["confidence"]) for r in sidecar.collect()}
    assert status["Development\\Oak Field"] == ("chosen", 0.95) and status["Development\\Elm Rise"] == ("chosen", 0.8)
    assert status["Development"][0] == "structural" and status["Finance"][0] == "cat_folder" and status["Finance\\Old Wood"][0] == "nested"
    got = {tuple(r["segments"][:2]): r["entity_scheme"] for r in assigned.collect()}
    assert got[("Development", "Ash Way")] == "Ash Way" and got[("Loose",)] == "" and got[("Finance", "Old Wood")] == ""
    assert all(r["entity_scheme_path"] == "" or "\\".join(r["segments"]).startswith(r["entity_scheme_path"]) for r in assigned.collect())


def test_same_name_takes_the_best_place(spark):
    rows = [*site("Oak Field", 6), *[(["Archive", "x", "y", "Oak Field", f"Plot {i}"], f"Plot {i}", None) for i in range(3)]]
    assigned, _ = folders.detect_schemes(estate(spark, rows), default_config())
    depths = {r["entity_scheme_depth"] for r in assigned.filter("entity_scheme = 'Oak Field'").collect()}
    assert depths == {1}


def test_hierarchy(spark):
    df = spark.createDataFrame(
        [("S", 1, "P", 1, 0.8, "A", 0, 0.8), ("S", 0, "P", 3, 0.8, "A", 2, 0.8), ("", -1, "P", 1, 0.8, "A", 2, 0.8), ("A", 1, "", -1, 0.0, "A", 1, 0.8)],
        "entity_scheme string, entity_scheme_depth int, entity_plot string, entity_plot_depth int, entity_plot_confidence double, entity_address string, entity_address_depth int, entity_address_confidence double",
    )
    got = [(r["entity_plot"], r["entity_address"], r["entity_address_depth"], r["entity_address_is_scheme_name"]) for r in folders.enforce_hierarchy(df).collect()]
    assert got == [("", "", -1, False), ("P", "", -1, False), ("P", "A", 2, False), ("", "", -1, True)]


def test_tree_and_conflicts(spark):
    rows = [(["a", "1 Mill Road", "x"], None, "1 Mill Road"), (["a", "1 Mill Road", "x"], None, None), (["a", "b"], None, None), (["a", "1 Mill Road", "y"], None, "2 Hill Road"), (["a", "1 Mill Road", "y", "z"], None, "1 Mill Road")]
    df = estate(spark, rows).withColumns({"overall_confidence": F.lit(0.5), "entity_address_confidence": F.lit(0.8), "entity_plot_confidence": F.lit(0.0), "entity_plot": F.lit("")})
    tree = {r["folder_path"]: (r["file_count"], r["is_address"], r["address_name"], r["address_file_count"], r["entity_types"]) for r in folders.folder_tree(df, 3, ("address",)).collect()}
    assert tree == {"a\\1 Mill Road": (4, True, "1 Mill Road", 2, "address"), "a\\1 Mill Road\\x": (2, False, "1 Mill Road", 0, ""), "a\\1 Mill Road\\y": (2, False, "1 Mill Road", 0, ""), "a\\b": (1, False, "", 0, "")}
    got = {r["folder_path"]: (r["n_files"], r["address_selected"], r["address_share"], r["address_values"], r["address_conflict"], r["address_confidence"]) for r in folders.leaf_conflicts(df, ("plot", "address")).collect()}
    assert got == {"a\\1 Mill Road\\y": (1, "1 Mill Road", "1/1", "1 Mill Road", False, 0.8)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assigned, sidecar = folders.detect_schemes(empty, default_config())
    assert assigned.count() == 0 and sidecar.count() == 0
