from collections import Counter

import pytest
from pyspark.sql import functions as F

from estatelens.llm.mixing import allocation, due_tokens, mix

TARGETS = "source string, target_share double, max_repeats int"


def test_allocation():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "none": (0.0, 9)}
    got = allocation({"a": 1000, "b": 400, "c": 20}, targets)
    assert sum(got.values()) == pytest.approx(400) and got["c"] == pytest.approx(80) and got["a"] == pytest.approx(200)
    filled = allocation({"a": 1000, "b": 400, "c": 20}, targets, 1000)
    assert filled["c"] == 80 and sum(filled.values()) == pytest.approx(1000) and filled["a"] / filled["b"] == pytest.approx(5 / 3)
    assert allocation({"a": 10}, targets, 1e9)["a"] == 10
    assert allocation({}, targets) == {"a": 0, "b": 0, "c": 0, "none": 0}


def documents(spark):
    rows = [(i, "a", 100 + i % 7) for i in range(900)] + [(1000 + i, "b", 90 + i % 5) for i in range(300)] + [(2000 + i, "c", 50) for i in range(20)] + [(3000, "d", 70), (3001, None, 70), (3002, "a", 0), (3003, "b", None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, source string, n_tokens int, slot string")


def test_shares_and_order(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("absent", 0.05, 3)], TARGETS)
    schedule, shares = mix(documents(spark), targets, block=100)
    report = {r["source"]: r for r in shares.collect()}
    for s, share in (("a", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95)):
        assert report[s]["actual_share"] == pytest.approx(share, abs=0.02)
    assert report["absent"]["actual_share"] == 0 and report["c"]["repeats"] == 4
    rows = sorted((r["slot"], r["source"], r["doc_id"], r["repeat_no"], r["n_tokens"]) for r in schedule.collect())
    assert max(Counter(r[2] for r in rows).values()) == 4 and len({(r[2], r[3]) for r in rows}) == len(rows)
    half = [r for r in rows if r[0] < rows[-1][0] / 2]
    assert sum(r[4] for r in half if r[1] == "a") / sum(r[4] for r in half) == pytest.approx(0.5 / 0.95, abs=0.04)
    again = sorted((r["slot"], r["source"], r["doc_id"], r["repeat_no"], r["n_tokens"]) for r in mix(documents(spark), targets, block=100)[0].collect())
    assert again == rows


def test_repeats_are_capped(spark):
    targets = spark.createDataFrame([("a", 0.2, 1), ("c", 0.8, 3)], TARGETS)
    schedule, shares = mix(documents(spark), targets, block=100, total=50_000.0)
    report = {r["source"]: r for r in shares.collect()}
    assert report["c"]["tokens"] == 3000 and report["a"]["tokens"] == pytest.approx(47_000, abs=200)
    assert Counter(r["source"] for r in schedule.collect())["c"] == 60


@pytest.mark.parametrize("block, total", [(100_000, None), (10, 2000.0)])
def test_every_due_source_gets_a_slot(spark, block, total):
    """Few slots for the sources, and a share narrower than the gaps between the points."""
    names = [f"s{i:02}" for i in range(12)]
    rows = [(100 * i + j, s, 10) for i, s in enumerate(names) for j in range(30)]
    goals = [(s, 0.09 if s != "s05" else 0.01, 1) for s in names]
    schedule, shares = mix(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int"), spark.createDataFrame(goals, TARGETS), block=block, total=total)
    report = {r["source"]: r for r in shares.collect()}
    for s, share, _ in goals:
        assert report[s]["tokens"] > 0 and report[s]["actual_share"] == pytest.approx(share, abs=0.005)
    rows = schedule.collect()
    assert {r["source"] for r in rows} == set(names) and len({(r["source"], r["slot"]) for r in rows}) == len({r["slot"] for r in rows})


def test_source_far_larger_than_a_scarce_one(spark):
    """The goal follows the scarce source, so only the first buckets of the large one are summed."""
    rows = spark.range(200_000).selectExpr("id AS doc_id", "'a' AS source", "500 AS n_tokens").union(spark.createDataFrame([(1_000_000, "b", 100)], "doc_id bigint, source string, n_tokens int"))
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    schedule, shares = mix(rows, targets)
    report = {r["source"]: r for r in shares.collect()}
    assert report["b"]["tokens"] == 100 and report["a"]["tokens"] == 1000 and report["a"]["unused_tokens"] == 200_000 * 500 - 1000
    assert schedule.count() == 3


def test_total_of_the_corpus(spark):
    targets = spark.createDataFrame([("a", 0.2, 1), ("c", 0.8, 3)], TARGETS)
    report = {r["source"]: r for r in mix(documents(spark), targets, block=100, total="corpus")[1].collect()}
    size = sum(100 + i % 7 for i in range(900))
    assert report["c"]["tokens"] == 3000 and report["a"]["tokens"] == pytest.approx(size + 1000 - 3000, abs=200) and report["c"]["unused_tokens"] == 0


def test_due_tokens_are_those_of_the_allocation(spark):
    goals = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("absent", 0.05, 3), ("d", 0.0, 5)]
    targets = spark.createDataFrame([*goals, (None, 0.1, 1)], TARGETS)
    sizes = documents(spark).select("source", F.col("n_tokens").alias("n"))
    got = {r["source"]: r["due"] for r in due_tokens(sizes, targets).collect()}
    own = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert got == pytest.approx(allocation(own, {s: (w, k) for s, w, k in goals}))
    assert all(r["due"] == 0 for r in due_tokens(sizes.limit(0), targets).collect())


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    schedule, shares = mix(documents(spark).limit(0), targets)
    assert schedule.count() == 0 and [r["actual_share"] for r in shares.collect()] == [0.0]
    schedule, shares = mix(documents(spark), targets.limit(0))
    assert schedule.count() == 0 and shares.count() == 0
