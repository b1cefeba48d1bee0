import pytest
from pyspark.sql import functions as F

from estatelens.config import EntityDef, default_config
from estatelens.operators.extraction import add_extracted, address_of, before_house_number, plot_of, rising, scheme_of, undated

ADDRESS = EntityDef("address", ("road", "lane", "way", "close", "park", "crescent", "court", "street"), ("cres", "rd", "st"), (), {"cres": "crescent", "rd": "road", "st": "street"})
PLOT = EntityDef("plot", ("plot", "unit", "flat", "apartment"), ("plt", "blk"), (r"\bp[-_ ]?\d{1,4}[a-z]?\b", r"\bblock[-_ ]?[a-z0-9]{1,3}\b"), {"plt": "plot", "blk": "block"})


@pytest.mark.parametrize(
    "name, out",
    [
        ("plots 67-70 Hawkes Way", "67-70 hawkes way"), ("24 Warren Wood Road, Rochester", "24 warren wood road rochester"), ("Cotton Lane (Vent-Axia fan", "cotton lane"), ("22-27 Hadlow Close 271115", "22-27 hadlow close"),
        ("Mills Cres", "mills crescent"), ("TN13 1AB", "tn13 1ab"), ("Lenham Road ME10 3ZZ", "lenham road me10 3zz"), ("1 & 2 Oak Rd", "1 & 2 oak road"), ("Nothing here", ""), ("", ""), (None, ""), ("St Mary's Close", "close"),
    ],
)
def test_addresses(name, out):
    assert address_of(name, ADDRESS) == out


@pytest.mark.parametrize(
    "name, out",
    [
        ("Plot 1 & 2", "plot 1 & 2"), ("Plot 16-30 Colemans Close ashford,", "plot 16-30"), ("Plot 66 - 42 Hawkes Way", "plot 66"), ("Plots 63-68 Block 2 Blossom Park Hoo", "plots 63-68"), ("Block E Flats Gas flue boxing", "block e"),
        ("Block A & Block B (Architects)", "block a"), ("Plot 10 - 12 Pippin Court", "plot 10"), ("Plot 10-103 Manston Road", "plot 10"), ("P239-Lv0", "p239"), ("Apartment floor finishes", ""), ("plts 3", "plots 3"), (None, ""),
    ],
)
def test_plots(name, out):
    assert plot_of(name, PLOT, ADDRESS) == out


def test_schemes():
    places = frozenset({"st albans", "hoo", "rochester"})
    assert scheme_of("Phase 2 Liberty Park Hoo Road", ADDRESS) == "liberty park hoo road"
    assert scheme_of("St Albans New scheme 2019", ADDRESS, places) == "st albans"
    assert scheme_of("Phase 1 2020-2023", ADDRESS, places) == "" and scheme_of(None, ADDRESS) == ""


def test_trims_and_dates():
    assert rising(["66", "-", "42"]) == ["66"] and rising(["1", "-", "5"]) == ["1", "-", "5"] and rising(["76", "&", "77", "-", "28"]) == ["76", "&", "77"]
    assert before_house_number(["16-30"], ["Colemans", "Close"], frozenset({"close"})) == ["16-30"]
    assert undated("x 10 July 24 y 18.10.13 160219 (2019-2020)") == "x y"


def test_applied_to_rows(spark):
    df = spark.createDataFrame([(1, "1 Mill Rd", [("1 Mill Rd", 0.5, 2), ("x", 0.5, 1)]), (2, "", []), (3, None, None)], "row_id int, entity_address string, raw_addresss array<struct<value:string,confidence:double,depth:int>>")
    got = {r["row_id"]: (r["entity_address_extracted"], [m["extracted"] for m in r["extracted_addresss"] or []]) for r in add_extracted(df, default_config()).collect()}
    assert got == {1: ("1 mill road", ["1 mill road", ""]), 2: ("", []), 3: (None, [])}
    assert add_extracted(df.limit(0), default_config()).select(F.count(F.lit(1))).head()[0] == 0
