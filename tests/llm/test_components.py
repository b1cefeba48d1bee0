import random

from estatelens.llm.components import connected_groups, match_groups

SCHEMA = "left_cluster_id string, right_cluster_id string, is_match boolean, similarity double, id string"


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_shapes(spark):
    rnd = random.Random(1)
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(120)]
    star = [("hub", f"s{i:03}") for i in range(200)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 30:02}") for i in range(30)]
    loose = [(f"x{rnd.randrange(300)}", f"x{rnd.randrange(300)}") for _ in range(200)]
    pairs = [*chain, *star, *ring, *loose]
    rnd.shuffle(pairs)
    rows = [(a, b, True, 0.5, "clash") for a, b in pairs] + [(b.upper(), f" {a} ", True, None, None) for a, b in pairs[:50]]
    rows += [("zz", "yy", False, 0.9, None), ("zz", "yy", None, 0.9, None), ("zz", None, True, 0.9, None), ("", "yy", True, 0.9, None), ("zz", " ZZ", True, 0.9, None), (None, None, True, None, None)]
    got = {r[0]: r[1] for r in match_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([(a, b) for a, b in pairs if a != b])


def test_empty(spark):
    assert match_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert connected_groups(spark.createDataFrame([("a", "b")], "u string, v string")).count() == 2
