import random

import pytest
from pyspark.sql import functions as F

from estatelens.llm.addresses import deletions, distance, parse, place_groups, same_place_pairs

CASES = {
    "17 fizzaom avenue  yenewick  qs1-8aa": ("", "17", "fizzaom", "avenue", "qs1", "8aa"),
    "no.13 St Jacsoest Crt Dontealow": ("", "13", "saint jacsoest", "court", None, None),
    "FLAT NO 6,13, FIZZAOM LANE,YENEWICK,QS17AA": ("6", "13", "fizzaom", "lane", "qs1", "7aa"),
    "flat9\n59 st jackoest ave\ngenidale\nvv17ba": ("9", "59", "saint jackoest", "avenue", "vv1", "7ba"),
    "41-B GLOGIEL CL\nRIGIEMOUTH": ("", "41b", "glogiel", "close", None, None),
    "17 B Flamieard Lane - Mearawick - QE8 2EA": ("", "17b", "flamieard", "lane", "qe8", "2ea"),
    "Nornieham - 30, Leapouand Crt - Flt 24": ("24", "30", "leapouand", "court", None, None),
    "xc11da, montiwick, 34 koudieard gardens": ("", "34", "koudieard", "gardens", "xc1", "1da"),
    "Pleskimouth,249 Camieest St": ("", "249", "camieest", "street", None, None),
    "Voskamouth; Trisieel Tce": ("", "", "trisieel", "terrace", None, None),
    "DRIXEASTEAD BREAPEAND RD.": ("", "", "breapeand", "road", None, None),
    "24 Warren Wood Road, Rochester ME1 1AA": ("", "24", "warren wood", "road", "me1", "1aa"),
    "9 Lower Church Lane, Rochester": ("", "9", "lower church", "lane", None, None),
    "12 The Broadway, Rochester": ("", "12", "broadway", "", None, None),
    "3 Orchard Yard, Rochester ME1 1AA": ("", "3", "orchard yard", "", "me1", "1aa"),
    "3rd Avenue 12, Rochester": ("", "12", "3rd", "avenue", None, None),
    "Plot 3, 9 Upper Church Lane, Hoo": ("plot 3", "9", "upper church", "lane", None, None),
    "Flat 2, Block B, 67-70 Hawkes Way, Hoo": ("2, block b", "67-70", "hawkes", "way", None, None),
    "12 North Park Road, Hoo": ("", "12", "north park", "road", None, None),
    "12 North Park Close, Hoo": ("", "12", "north park", "close", None, None),
    "Park View, 12 Mill Lane, Hoo": ("", "12", "mill", "lane", None, None),
    "Hawkes Way 67, Hoo": ("", "67", "hawkes", "way", None, None),
}


@pytest.mark.parametrize("text, out", CASES.items())
def test_parse(text, out):
    p = parse(text)
    way = p["ways"][0]
    assert (p["flat"], p["number"], way["street"], way["kind"], p["district"], p["unit"]) == out


def test_no_address():
    assert all(parse(t) is None for t in (None, "", "TBC", "see file", "n/a", "Road", "x" * 10_000))
    assert parse("word " * 20_000) is None
    assert all(parse(t) is None for t in ("1 " + "mill road " * 3000, "mill road " * 3000 + "me1 1aa", "".join(f"a{chr(97 + i % 26)}b road, " for i in range(3000))))
    assert parse("1 " + "mill road " * 90)["ways"] and parse("mill road, " * 90 + "me1 1aa")["ways"]


def apart(a, b):
    """Edits and swaps of neighbours from a to b, by the table of all prefixes."""
    table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i][j] = min(table[i][j], table[i - 2][j - 2] + 1)
    return table[-1][-1]


def test_distance_and_deletions(spark):
    rnd = random.Random(9)
    words = ["stream", "straem", "strem", "streams", "stredm", "ab", "ba", "a", "abc", "acb", "bca", "badc", "abcd", *("".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 6))) for _ in range(60))]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", distance(F.col("a"), F.col("b")).alias("d"), deletions(F.col("a")).alias("x"), deletions(F.col("b")).alias("y")).collect()
    for r in rows:
        assert r["d"] == min(apart(r["a"], r["b"]), 2), (r["a"], r["b"])
        assert r["d"] == 2 or set(r["x"]) & set(r["y"]) or min(len(r["a"]), len(r["b"])) < 3


def spelled(rnd, flat, number, street, kind, town, code):
    short = {"road": ["road", "rd", "Rd."], "close": ["close", "Cl", "CLO"]}[kind]
    house = f"{street} {rnd.choice(short)}"
    parts = [f"{rnd.choice(['', 'no. '])}{number} {house}" if number else house]
    if flat:
        parts.insert(0, f"{rnd.choice(['Flat ', 'apt ', 'flt no '])}{flat}")
    keep = rnd.choice([(1, 1), (1, 0), (0, 1)])
    parts += [town] * keep[0] + ([code[:3] + rnd.choice(["", " ", "-"]) + code[3:]] if keep[1] else [])
    text = rnd.choice([", ", "; ", "\n", " - "]).join(parts)
    return rnd.choice([text, text.upper(), text.lower()])


def test_places(spark):
    rnd = random.Random(3)
    towns = [("Montiwick", "xc1"), ("Rigiemouth", "qc2"), ("Yenewick", "qs3")]
    places = [(f, n, s, k, t, c + u) for (t, c), u in zip(towns, ("1aa", "2bb", "3cc")) for s in ("Koudieard", "Glogiel") for k in ("road", "close") for n in ("5", "5a", "") for f in ("", "2") if n or not f]
    rows, truth = [], {}
    for place in places:
        for _ in range(6):
            i = len(rows)
            rows.append((i, spelled(rnd, *place), "wrong hint"))
            truth.setdefault(place, []).append(i)
    wanted = {(a, b) for ids in truth.values() for a in ids for b in ids if a < b}
    typo = len(rows)
    rows += [(typo, "5 Kuodieard Road, Montiwick, XC1 1AA", ""), (typo + 1, "5 Koudieard Rd, Montwick", None), (typo + 2, None, None), (typo + 3, "", None), (typo + 4, "see file", "5 koudieard road")]
    same = truth[("", "5", "Koudieard", "road", "Montiwick", "xc11aa")]
    wanted |= {(a, b) for a in same for b in (typo, typo + 1)} | {(typo, typo + 1)}
    df = spark.createDataFrame([(*r, "clash") for r in rows], "addr_id bigint, entity_address string, entity_address_canonical string, id string")
    got = {tuple(r) for r in same_place_pairs(df).collect()}
    assert not [(rows[a][1], rows[b][1]) for a, b in sorted(got ^ wanted)]
    groups = {r["id"]: (r["place_id"], r["n_records"]) for r in place_groups(df).collect()}
    assert groups[typo] == (same[0], len(same) + 2) and groups[typo + 2] == (None, None) and len(groups) == len(rows)
    assert same_place_pairs(df.limit(0)).count() == 0


def test_different_places_stay_apart(spark):
    together = [
        ["24 Warren Wood Road, Rochester ME1 1AA", "24 Warren Wood Rd, Rochester", "Rochester, 24 warren wod road, ME1 1AA"],
        ["24 Oak Wood Road, Rochester ME1 1AB", "24 Oak Wood Rd, Rochester"],
        ["9 Lower Church Lane, Rochester ME1 2AA", "9 lower church ln rochester"],
        ["9 Upper Church Lane, Rochester ME1 2AB", "9 upper church la, Rochester"],
        ["12 North Park Road, Rochester ME1 3AA", "12 North Park Rd, Rochester"],
        ["12 North Park Close, Rochester ME1 3AB", "12 North Park Cl, Rochester"],
        ["12 The Broadway, Rochester ME1 4AA", "12 Broadway, Rochester"],
        ["3 Orchard Yard, Rochester ME1 5AA", "3 Orchard Yard Rochester"],
        # alike, but with postcodes of their own
        ["7 Mill Road, Rochester ME1 6AA", "7 Mill Rd, Rochester ME1 6AA"],
        ["7 Hill Road, Rochester ME1 6AB", "7 Hill Rd, Rochester ME1 6AB"],
        # a locality beside the town, known from addresses with a postcode
        ["5 Ferry Lane, Wouldham, Rochester ME1 7AA", "5 Ferry Lane, Wouldham", "5 Ferry La, Wouldham ME1 7AA"],
        ["5 Ferry Lane, Wouldham, Rochester ME1 7AA".replace("5 F", "Flat 1, 5 F")],
        ["Plot 5, Ferry Lane, Wouldham"],
        ["3rd Avenue 12, Gillingham GL1 1AA", "12 3rd Ave, Gillingham GL1 1AA"],
    ]
    texts = [t for group in together for t in group]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "addr_id bigint, entity_address string")
    where = {r["id"]: r["place_id"] for r in place_groups(df).collect()}
    got: dict = {}
    for i, place in where.items():
        got.setdefault(place, set()).add(texts[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, (set(g) for g in together)))


def test_frequent_street_one_letter_from_another(spark):
    rows = [f"{i} Mill Road, Rochester ME1 6AA" for i in range(60)] + [f"{i} Hill Road, Rochester ME1 6AB" for i in range(10)] + ["3 Mlil Road, Rochester ME1 6AA", "4 Mlil Road, Rochester"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "addr_id bigint, entity_address string")
    assert {tuple(r) for r in same_place_pairs(df).collect()} == {(3, 70), (4, 71)}
