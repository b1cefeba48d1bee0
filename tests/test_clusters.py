import random

from pyspark.sql import functions as F

from estatelens.operators import clustering, similarity


def trigrams(s):
    m = f"$${s}$$"
    return {m[i : i + 3] for i in range(len(m) - 2)}


def test_similar_values_against_brute_force(spark):
    rnd = random.Random(2)
    values = sorted({"".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 9))).strip() or "a" for _ in range(150)})
    got = {(r["a"], r["b"]) for r in similarity.similar_values(spark.createDataFrame([(v,) for v in values], "value string"), 0.55).collect()}
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if len(trigrams(a) & trigrams(b)) / len(trigrams(a) | trigrams(b)) >= 0.55}
    assert got == want and want


def test_groups_partition_the_nodes(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("e", "f"), ("h", "g"), ("g", "f")], "a string, b string")
    got = {r["node"]: r["root"] for r in similarity.linked_groups(nodes, pairs).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "e", "h": "e"}


def test_groups_of_chains_and_stars(spark):
    rnd = random.Random(8)
    names = [f"n{i:03d}" for i in range(300)]
    order = rnd.sample(names, 200)
    links = [*zip(order[:100], order[1:100]), *((order[150], x) for x in order[151:200]), (names[0], names[0])]
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in similarity.linked_groups(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: find(n) for n in names}


def test_scheme_overlaps_against_brute_force(spark):
    from estatelens.functions.text import strip_scheme_noise

    rnd = random.Random(6)
    words = ["park"] * 6 + ["road", "phase 2", "mill", "oak", "liberty", "hoo", "new dec 20", "elm", "ash", "way", "quay", "view"]
    names = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7))) for _ in range(120)})
    df = spark.createDataFrame([(n,) for n in names], "value string")
    bare = {r["value"]: r["b"] for r in df.withColumn("b", strip_scheme_noise(F.col("value"))).collect()}
    over = lambda x, y: len(x & y) / min(len(x), len(y))
    w, g = {n: set(bare[n].split()) for n in names}, {n: trigrams(bare[n]) for n in names}
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if min(len(w[a]), len(w[b])) >= 2 and over(w[a], w[b]) >= 0.8 and over(g[a], g[b]) >= 0.6}
    assert {(r["a"], r["b"]) for r in similarity.scheme_overlaps(df).collect()} == want and want


def test_clusters_and_ids(spark):
    pool = spark.createDataFrame([("liberty park hoo road", 5), ("phase 2 liberty park hoo road", 1), ("liberty park hoo rd", 5), ("mill lane", 9)], "value string, count bigint")
    got = {r["value"]: (r["canonical"], r["cluster_id"]) for r in clustering.cluster_values(pool, "scheme").collect()}
    assert got["mill lane"] == ("mill lane", "schm_0001")
    assert {v[0] for k, v in got.items() if k != "mill lane"} == {"liberty park hoo road"} and got["phase 2 liberty park hoo road"][1] == "schm_0000"


def test_contexts_stay_apart(spark):
    pool = spark.createDataFrame([("s1", "plot 1", 2), ("s1", "plot 1a", 1), ("s2", "plot 1", 1), ("__nocontext__x", "plot 1", 1), ("__nocontext__x", "plot 1a", 1)], "context string, value string, count bigint")
    got = {(r["context"], r["value"]): r["cluster_id"] for r in clustering.cluster_values(pool, "plot", 0.5, "context").collect()}
    assert got[("s1", "plot 1")] == got[("s1", "plot 1a")] != got[("s2", "plot 1")]
    assert got[("__nocontext__x", "plot 1")] != got[("__nocontext__x", "plot 1a")]


def test_assignment_and_backfill(spark):
    files = spark.createDataFrame(
        [(1, ["a"], "1 Mill Road", 0, [("1 Mill Road", 0.8, 0, "1 mill road")]), (2, ["b"], "", -1, [("zzz", 0.9, 1, "zzz"), ("1 Mill Rd", 0.5, 0, "1 mill road")]), (3, ["c"], None, -1, [])],
        "row_id int, segments array<string>, entity_address string, entity_address_depth int, extracted_addresss array<struct<value:string,confidence:double,depth:int,extracted:string>>",
    ).withColumn("entity_address_confidence", F.lit(0.0))
    clusters = spark.createDataFrame([("1 mill road", "addr_0000", "1 mill road")], "value string, cluster_id string, canonical string")
    df = clustering.cluster_sizes(clustering.backfill(clustering.assign_clusters(files, clusters, "address"), clusters, "address"), "address")
    got = {r["row_id"]: (r["entity_address"], r["entity_address_cluster_id"], r["entity_address_cluster_size"]) for r in df.collect()}
    assert got == {1: ("1 Mill Road", "addr_0000", 2), 2: ("1 Mill Rd", "addr_0000", 2), 3: (None, "", 0)}


def test_pool_votes_per_folder(spark):
    files = spark.createDataFrame([(1, ["s", "x"], "S", 0), (2, ["s", "y"], "S", 0), (3, ["t"], "S", 0), (4, ["u"], "", -1)], "row_id int, segments array<string>, entity_scheme string, entity_scheme_depth int")
    assert [tuple(r) for r in clustering.value_pool(files, "scheme").collect()] == [("s", 3)]
    assert clustering.value_pool(files.limit(0), "scheme").count() == 0


def grouped(pairs, values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_group_links_give_the_groups_of_all_pairs(spark):
    rnd = random.Random(5)
    streets = ["mill lane", "mill road", "hill road", "mallow court", "mallow close", "willow court", "a", "oak", "oakleigh gardens", "oakleigh garden"]
    values = sorted({f"{rnd.choice(['', 'flat ', 'plot '])}{rnd.choice([1, 12, 120, 121, 2, 21, 210, 7, 77])} {rnd.choice(streets)}{rnd.choice(['', '', ' 3', ' 31', 'b'])}" for _ in range(160)} | {"7", "77", "777", "12", "mill lane", "willow", "$", "1$"})
    for threshold in (0.55, 0.8, 0.3):
        want = grouped(((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if len(trigrams(a) & trigrams(b)) / len(trigrams(a) | trigrams(b)) >= threshold), values)
        got = similarity.group_links(spark.createDataFrame([(v,) for v in values], "value string"), threshold).collect()
        assert grouped(((r["a"], r["b"]) for r in got), values) == want
    pool = spark.createDataFrame([(c, v) for c in ("x", "y") for v in values[:: 1 if c == "x" else 3]], "context string, value string")
    links = similarity.group_links(pool, 0.55, "context").collect()
    for c, some in (("x", values), ("y", values[::3])):
        want = grouped(((a, b) for i, a in enumerate(some) for b in some[i + 1 :] if len(trigrams(a) & trigrams(b)) / len(trigrams(a) | trigrams(b)) >= 0.55), some)
        assert grouped(((r["a"], r["b"]) for r in links if r["context"] == c), some) == want


def test_group_links_are_few(spark):
    values = [f"{n} {street}" for n in range(1, 101) for street in ("quilloway crescent", "quilloway gardens", "brantham terrace")]
    links = similarity.group_links(spark.createDataFrame([(v,) for v in values], "value string"), 0.55).count()
    assert links <= len(values)  # all pairs: 14,850 and more
    assert similarity.group_links(spark.createDataFrame([], "value string"), 0.55).count() == 0
