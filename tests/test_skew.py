import random
from collections import Counter

from pyspark.sql import functions as F

from estatelens.operators.skew import dominant_keys, heavy_keys, per_key_totals, salted_aggregate

SCHEMA = "row_id bigint, entity_scheme string, source_system string, size bigint, utc_micros bigint, __n string"


def rows(n=3000):
    rnd = random.Random(5)
    return [(i, rnd.choice(["hot"] * 6 + ["", None, "a", f"s{i}"]), rnd.choice(["E1", "E1", "E2", None]), rnd.choice([None, i]), rnd.choice([None, i * 7]), "x") for i in range(n)]


def test_totals_against_brute_force(spark):
    data = rows()
    got = {(r["field_name"], r["key_value"]): (r["n_files"], r["total_bytes"], r["max_bytes"], r["newest_micros"]) for r in per_key_totals(spark.createDataFrame(data, SCHEMA), salts=7).collect()}
    for field, at in (("entity_scheme", 1), ("source_system", 2)):
        for key, n in Counter(r[at] for r in data).items():
            own = [r for r in data if r[at] == key]
            sizes, times = [r[3] for r in own if r[3] is not None], [r[4] for r in own if r[4] is not None]
            assert got[(field, key)] == (n, sum(sizes) if sizes else None, max(sizes, default=None), max(times, default=None))


def test_dominant_and_heavy(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r[0], r[1]) for r in dominant_keys(per_key_totals(df), 0.03).collect()}
    want = {(f, k) for f, at in (("entity_scheme", 1), ("source_system", 2)) for k, n in Counter(r[at] for r in data).items() if k is not None and n >= 0.03 * len(data)}
    assert got == want
    assert heavy_keys(df, ["entity_scheme"], 0.5).count() == 1


def test_empty_and_one_key(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert per_key_totals(empty).count() == 0 and dominant_keys(per_key_totals(empty), 0.03).count() == 0
    one = spark.range(1000).select(F.lit("k").alias("k"), "id")
    got = salted_aggregate(one, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, F.col("id")).collect()
    assert [(r["k"], r["n"]) for r in got] == [("k", 1000)]
