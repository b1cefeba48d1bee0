import pytest
from pyspark.sql import functions as F

from estatelens.config import CategoryDef, Config, EntityDef, TypeDef, default_config, load_config, merge_layers
from estatelens.operators import matching, scoring


def hits(spark, texts, how=matching.type_hits, config=None):
    t = matching.texts_of((spark.createDataFrame([(x,) for x in texts], "text string"), F.col("text")))
    return {(r["text"], r["label"]): r["priority"] for r in how(t, config or default_config()).collect()}


def test_types(spark):
    got = hits(spark, ["Fire Risk Assesment 3", "inv-0042", "site photo", "po 12 purchase order", "Assesment fire of Risk", "nothing", "", None])
    assert got == {
        ("Fire Risk Assesment 3", "Risk Assessment"): matching.FUZZY, ("inv-0042", "Invoice"): matching.PATTERN, ("site photo", "Photo"): matching.TOKEN, ("po 12 purchase order", "Purchase Order"): matching.TOKEN,
        ("Assesment fire of Risk", "Risk Assessment"): matching.FUZZY,
    }


def test_categories_and_entities(spark):
    names = ["Finance", "Plot 7", "Planning plot", "H&S", "12 Mill Road", "Block A", "Finance P12"]
    assert set(hits(spark, names, matching.category_hits)) == {("Finance", "Finance"), ("Planning plot", "Planning"), ("H&S", "Safety"), ("Finance P12", "Finance")}
    t = matching.texts_of((spark.createDataFrame([(x,) for x in names], "text string"), F.col("text")))
    c = default_config()
    organisational = matching.type_hits(t, c).select("text").unionAll(matching.category_hits(t, c).select("text"))
    got = {(r["text"], r["label"]): r["priority"] for r in matching.entity_hits(t, c, organisational).collect()}
    assert got == {("Plot 7", "plot"): 1, ("12 Mill Road", "address"): 1, ("Block A", "plot"): 2, ("Finance P12", "plot"): 2}


def scored(spark, rows, config=None):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "row_id int, segments array<string>, filename_stem string, extension string, inferred_type string")
    return {r["row_id"]: r for r in scoring.score(df.drop("inferred_type"), config or default_config()).collect()}


def test_scores(spark):
    got = scored(
        spark,
        [
            (["Finance"], "invoice 3", "pdf"),  # filename
            (["Handover"], "certificate 9", "pdf"),  # parent and child
            (["Drawings"], "lease", "pdf"),  # conflict
            (["Minutes"], "minutes", "pdf"),  # agreement
            (["Lease", "x"], "photo", "jpg"),  # generic name in a specific folder
            ([], "x", "dwg"),  # extension only
            ([], "", ""),
            (None, None, None),
        ],
    )
    view = lambda i: (got[i]["inferred_type"], got[i]["overall_confidence"], got[i]["confidence_band"])
    assert view(0) == ("Invoice", 0.85, "High") and got[0]["inferred_category"] == "Finance"
    assert view(1) == ("Certificate", 0.9, "High")
    assert view(2) == ("Lease", 0.75, "High")
    assert view(3) == ("Meeting Minutes", 0.95, "High")
    assert view(4) == ("Lease", 0.525, "High") and got[4]["secondary_type"] == "Photo"
    assert view(5) == ("Drawing", 0.2, "Low")
    assert view(6) == view(7) == ("Unknown", 0.0, "Low") and got[7]["entity_plot_depth"] == -1
    assert got[0]["reasoning_trace"][-1].startswith("final: type Invoice")


def test_deepest_entity_wins(spark):
    got = scored(spark, [(["Plot 1", "x", "Plot 2"], "a", "pdf"), (["1 High Street"], "a", "pdf")])
    assert (got[0]["entity_plot"], got[0]["entity_plot_depth"], [m["depth"] for m in got[0]["raw_plots"]]) == ("Plot 2", 2, [2, 0])
    assert (got[1]["entity_address"], got[1]["entity_address_confidence"]) == ("1 High Street", 0.8)


def test_layers(tmp_path):
    base = {"types": {"Plan": {"tokens": ["Plan"], "patterns": ["("], "domain": "Legal"}}, "categories": {"Sales": {"signals": ["sales"]}}}
    client = {"types": {"Plan": {"tokens": ["plan", "layout"], "belongs_to": "Sales"}}, "categories": {"Sales": {"scheme_signal": True}}, "entities": {"plot": {"tokens": ["plot"], "abbreviation_map": {"PLT": "Plot"}}}}
    c = merge_layers([base, {}, client])
    assert c.types == (TypeDef("Plan", ("plan", "layout"), (), (), "Legal", (), 0),)
    assert c.categories == (CategoryDef("Sales", ("sales",), (), True),)
    assert c.entities == (EntityDef("plot", ("plot",), (), (), {"plt": "plot"}),)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path)
    (tmp_path / "classification").mkdir()
    (tmp_path / "classification" / "base.yaml").write_text("types:\n  Invoice:\n    tokens: [Invoice]\n")
    names = tmp_path / "dictionaries"
    names.mkdir()
    (names / "places.txt").write_text("Leeds\nEly\n")
    c = load_config(tmp_path, "housing")
    assert c.types[0].tokens == ("invoice",) and c.entities == () and c.place_names == {"leeds"} and isinstance(c, Config)
