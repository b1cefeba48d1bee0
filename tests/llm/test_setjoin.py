import random

import pytest
from pyspark.sql import functions as F

from estatelens.llm.setjoin import Measure, Signer, bucket, link_counts, similar_pairs, word_set


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets_of(rnd, n, frequent, size):
    out = []
    while len(out) < n:
        base = {rnd.choice("abcdefgh") + "!" for _ in range(rnd.randint(0, frequent))} | {f"r{rnd.randrange(4 * n)}" for _ in range(rnd.randint(0, size))}
        out.append(base)
        for _ in range(rnd.randint(0, 2)):
            near = set(base)
            for _ in range(rnd.randint(0, 3)):
                near ^= {rnd.choice([*near, f"r{rnd.randrange(4 * n)}", "a!"])}
            out.append(near)
    return out


@pytest.mark.parametrize("seed, frequent, size, num, den", [(1, 6, 6, 7, 10), (2, 8, 0, 7, 10), (3, 3, 40, 7, 10), (4, 2, 12, 1, 2), (5, 4, 9, 9, 10)])
def test_against_brute_force(spark, seed, frequent, size, num, den):
    sets = sets_of(random.Random(seed), 150, frequent, size)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, tokens array<string>")
    got = [tuple(r) for r in similar_pairs(df, num, den).collect()]
    want = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if a and sets[j] and jaccard(a, sets[j]) * den >= num - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_signatures_meet_for_every_similar_pair():
    rnd = random.Random(9)
    m = Measure(7, 10)
    for _ in range(300):
        n = rnd.randint(1, 60)
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rnd.randint(0, max(1, n // 5))):
            b ^= {rnd.choice([*b, rnd.getrandbits(64)]) if b else rnd.getrandbits(64)}
        if not b or jaccard(a, b) < 0.7:
            continue
        frequent = {t: rnd.random() for t in rnd.sample(sorted(a), rnd.randint(0, len(a)))}
        signer = Signer(m, frequent, 1000)
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        asks, needs = signer.probe(sorted(big))
        wanted = {}
        for low, i, kind in needs:
            wanted.setdefault(low, []).append((i, kind))
        assert set(asks) & {*signer.index(sorted(small)), *signer.empties(sorted(small), wanted)}
    assert all(bucket(n)[0] <= n <= bucket(n)[1] for n in range(1, 3000))


def test_word_sets(spark):
    df = spark.createDataFrame([([" A ", None, "", "b c"], "B-c_É9 b"), (None, None), ([], ""), (["x", "X"], "x")], "segments array<string>, stem string")
    assert [r[0] for r in df.select(word_set(F.col("segments"), F.col("stem"))).collect()] == [["a", "b", "b c", "c", "é9"], [], [], ["x"]]


def test_copies_and_counts(spark):
    t = [[f"w{k}" for k in range(8)]] * 5 + [[f"w{k}" for k in range(7)]] + [["z"]] + [[]] * 2
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(t)], "id bigint, tokens array<string>, rep string")
    assert similar_pairs(df).count() == 15
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in link_counts(df).collect()}
    assert got[3] == (0, 1) and got[5] == (5, 1) and got[6] == (6, 0) and got[7] == (None, 0)
    assert similar_pairs(df.limit(0)).count() == 0 and similar_pairs(df.filter("id >= 7")).count() == 0


def test_sets_of_frequent_tokens_only(spark):
    """All tokens are frequent, so that sets are told apart by segments of frequent tokens alone."""
    import random

    rnd = random.Random(12)
    words = [f"w{i:02}" for i in range(30)]
    rows = [(i, sorted(rnd.sample(words, rnd.randint(2, 14)))) for i in range(700)]
    rows += [(1000 + i, sorted(set(t[1:]) | {rnd.choice(words)})) for i, t in rows[:150]]
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(spark.createDataFrame(rows, "id bigint, tokens array<string>"), 7, 10).collect()}
    sets = [(i, set(t)) for i, t in rows]
    want = {(min(i, j), max(i, j)) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if 10 * len(a & b) >= 7 * len(a | b)}
    assert got == want and len(want) > 50
