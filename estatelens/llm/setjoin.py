"""All pairs of similar sets by pigeonhole partitioning.

Equal sets are one class, and the join runs over classes. For a bucket of set sizes the token universe is split
into segments by hash, the tokens that are frequent in the corpus apart from the others, both kinds in a
number that grows with the differences to be bridged, so that sets of frequent tokens alone have segments enough to be told apart by. Two sets whose symmetric difference is at most H must agree
within v_i elements in some segment i whenever the allowances satisfy sum(v_i + 1) >= H + 1; the larger
set picks for every segment to skip it (v = -1), to match it exactly (v = 0) or within one
deletion (v = 1), so that the estimated number of candidates is least. Any choice that meets
the sum finds all pairs; the estimate only saves time. The smaller set is indexed under every segment and every
one-deletion of it. Candidates are verified exactly on the strings.

There is no cap on candidates or partners. A set that lacks too many segments relies on an empty one and is joined
through it, which is exact; the index holds empty segments only where some set asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.session import cut

MASK = (1 << 64) - 1
FREQUENT = 2000  # a token in at least 1/FREQUENT of the sets is frequent: at most FREQUENT x mean set size of them


class Measure:
    """Jaccard threshold num/den with the bounds that follow from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Smallest size that a set similar to one of n elements can have."""
        return -(-self.num * n // self.den)

    def most(self, n: int) -> int:
        return self.den * n // self.num

    def apart(self, a: int, b: int) -> int:
        """Largest symmetric difference of similar sets of sizes a and b."""
        return a + b - 2 * -(-self.num * (a + b) // (self.num + self.den))


@lru_cache(maxsize=100_000)
def bucket(n: int) -> tuple[int, int]:
    """Bounds of the bucket of set sizes that holds n: single sizes up to 24, then steps of 5 %."""
    if n <= 24:
        return n, n
    low = 25
    while True:
        high = low + max(1, low // 20)
        if n < high:
            return low, high - 1
        low = high


@lru_cache(maxsize=100_000)
def segments(low: int, high: int, num: int, den: int) -> int:
    """Number of hashed segments of a bucket."""
    m = Measure(num, den)
    return 3 * (m.apart(m.most(high), high) + 1)


@lru_cache(maxsize=100_000)
def frequent_segments(low: int, high: int, num: int, den: int) -> int:
    """Number of segments of frequent tokens of a bucket: with one deletion each they bridge the largest difference."""
    m = Measure(num, den)
    return m.apart(m.most(high), high) // 2 + 1


@lru_cache(maxsize=1_000_000)
def _seed(low: int, i: int, kind: int) -> int:
    return xxhash.xxh64_intdigest(f"{low}/{i}/{kind}")


def _mix(total: int, low: int, i: int, kind: int) -> int:
    """Signature of the sum of a segment's token hashes in a bucket; kind 0 whole segments, 1 one-deletions."""
    x = (total ^ _seed(low, i, kind)) & MASK
    x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & MASK
    return ((x ^ (x >> 29)) & MASK) - (1 << 63)


class Signer:
    """Signatures of sets; ``frequent`` maps the hash of a frequent token to its share of the sets."""

    def __init__(self, measure: Measure, frequent: dict[int, float], n_sets: int):
        self.m, self.frequent, self.n = measure, frequent, max(1, n_sets)
        self.rare = 0.5 / FREQUENT
        self._lacking: dict[tuple[int, int], tuple[float, float]] = {}

    def split(self, tokens: list[int], low: int, high: int) -> dict[int, list[int]]:
        """Segment number -> token hashes; numbers below 1 hold the frequent tokens."""
        k, f, parts = segments(low, high, self.m.num, self.m.den), frequent_segments(low, high, self.m.num, self.m.den), {}
        for t in tokens:
            parts.setdefault(-((t >> 20) % f) if t in self.frequent else 1 + t % k, []).append(t)
        return parts

    def lacking(self, f: int, j: int) -> tuple[float, float]:
        """Estimated number of sets that have no token of frequent segment j of f, and of those with exactly one."""
        known = self._lacking.get((f, j))
        if known is None:
            shares = [p for t, p in self.frequent.items() if (t >> 20) % f == j]
            none = self.n
            for p in shares:
                none *= 1.0 - min(p, 0.999)
            known = self._lacking[f, j] = (none, none * sum(min(p, 0.999) / (1.0 - min(p, 0.999)) for p in shares))
        return known

    def index(self, tokens: list[int]) -> list[int]:
        """Signatures under which a set is found, without those of empty segments."""
        low, high = bucket(len(tokens))
        out = []
        for i, part in self.split(tokens, low, high).items():
            total = sum(part)
            out.append(_mix(total, low, i, 0))
            if len(part) > 1:
                out += [_mix(total - t, low, i, 1) for t in part]
        return out

    def empties(self, tokens: list[int], wanted: dict[int, list[tuple[int, int]]]) -> list[int]:
        """Index signatures of empty segments, of those that are wanted: bucket -> (segment, kind)."""
        low, high = bucket(len(tokens))
        if low not in wanted:
            return []
        parts = self.split(tokens, low, high)
        return [_mix(0, low, i, kind) for i, kind in wanted[low] if (len(parts.get(i, ())) == (0 if kind == 0 else 1))]

    def _cost(self, part: list[int]) -> float:
        cost = float(self.n)
        for t in part:
            cost *= self.frequent.get(t, self.rare)
        return cost

    def probe(self, tokens: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Signatures that a set looks up among sets not larger than itself, and the empty segments it needs."""
        n, out, need = len(tokens), set(), set()
        size = self.m.least(n)
        while size <= n:
            low, high = bucket(size)
            sizes = range(max(low, self.m.least(n)), min(high, n) + 1)
            budget = max(self.m.apart(n, s) for s in sizes) + 1
            parts = self.split(tokens, low, high)
            options = []
            for i, part in parts.items():
                whole = self._cost(part)
                less = sum(self._cost([x for x in part if x != t]) for t in part) if len(part) > 1 else self.n
                options.append((i, part, whole, whole * 2 + less))
            k = segments(low, high, self.m.num, self.m.den)
            spare = [i for i in range(1, k + 1) if i not in parts]
            options += [(i, [], self.n * 0.9, self.n * 1.8) for i in spare[:budget]]
            f = frequent_segments(low, high, self.m.num, self.m.den)
            for j in range(f):
                if -j not in parts:
                    none, single = self.lacking(f, j)
                    options.append((-j, [], none, none * 2 + single))
            # no choice needs more options than the budget, so only the cheapest of either kind come into question
            if len(options) > budget:
                one_by_one, two_by_two = sorted(range(len(options)), key=lambda o: options[o][2])[:budget], sorted(range(len(options)), key=lambda o: options[o][3])[:budget]
                options = [options[o] for o in sorted({*one_by_one, *two_by_two})]
            # least cost at which the allowances sum to at least the budget
            best: list[tuple[float, tuple]] = [(0.0, ())] + [(float("inf"), ())] * budget
            for at, (_, _, one, two) in enumerate(options):
                for b in range(budget, 0, -1):
                    for gain, cost in ((1, one), (2, two)):
                        before = best[max(0, b - gain)]
                        if before[0] + cost < best[b][0]:
                            best[b] = (before[0] + cost, (*before[1], (at, gain)))
            for at, gain in best[budget][1]:
                i, part, _, _ = options[at]
                total = sum(part)
                out.add(_mix(total, low, i, 0))
                if not part:
                    need.add((low, i, 0))
                if gain == 2:
                    out.add(_mix(total, low, i, 1))
                    if not part:
                        need.add((low, i, 1))
                    if len(part) == 1:
                        need.add((low, i, 0))
                    out.update(_mix(total - t, low, i, 0) for t in part)
            size = high + 1
        return list(out), list(need)


def _hashes(tokens: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens]


def _bits(tokens: list[int]) -> int:
    b = 0
    for t in tokens:
        b |= 1 << (t >> 40) % 64
    return b - (1 << 64) if b >> 63 else b


def word_set(segments_: Column, stem: Column) -> Column:
    """Segments, trimmed and in lower case, and the words of the stem as one sorted set; never null."""
    edge = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    none = F.array().cast("array<string>")
    parts = F.transform(F.coalesce(segments_, none), lambda s: F.lower(F.regexp_replace(s, edge, "")))
    words = F.coalesce(F.regexp_extract_all(F.lower(stem), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), none)
    return F.array_sort(F.array_distinct(F.filter(F.concat(parts, words), lambda s: s.isNotNull() & (s != ""))))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, tokens) sorted sets: classes (rep, tokens) and members (id, rep) of the non-empty ones."""
    some = cut(sets.filter(F.size("tokens") > 0).select("id", "tokens"))  # read twice, and dear to make
    classes = some.groupBy("tokens").agg(F.min("id").alias("rep"))
    members = some.join(classes, "tokens").select("id", "rep")
    return classes.select("rep", "tokens"), members


def similar_classes(classes: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """Pairs (rep_a < rep_b) of distinct sets with Jaccard >= num/den, with their similarity."""
    spark, measure = classes.sparkSession, Measure(num, den)
    n_sets = classes.count()
    counts = classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # at most FREQUENT x mean set size rows: the counts of all tokens sum to n_sets x mean set size
    rows = counts.filter(F.col("n") * FREQUENT >= n_sets).collect() if n_sets else []
    frequent = spark.sparkContext.broadcast({h: r["n"] / n_sets for r, h in zip(rows, _hashes([r["token"] for r in rows]))})

    @F.arrow_udf("struct<bits:bigint,found:array<bigint>,asks:array<bigint>,needs:array<struct<low:int,i:int,kind:int>>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signer = Signer(measure, frequent.value, n_sets)
        kind = pa.struct([("bits", pa.int64()), ("found", pa.list_(pa.int64())), ("asks", pa.list_(pa.int64())), ("needs", pa.list_(pa.struct([("low", pa.int32()), ("i", pa.int32()), ("kind", pa.int32())])))])
        for batch in batches:
            out = []
            for tokens in batch.to_pylist():
                own = _hashes(tokens)
                asks, needs = signer.probe(own)
                out.append({"bits": _bits(own), "found": signer.index(own), "asks": asks, "needs": [{"low": a, "i": b, "kind": c} for a, b, c in needs]})
            yield pa.array(out, kind)

    signed = classes.select("rep", F.size("tokens").alias("n"), sign("tokens").alias("s")).select("rep", "n", "s.bits", "s.found", "s.asks", "s.needs")
    signed = cut(signed)
    # segments and kinds per bucket of sizes, however many the sets
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in signed.select(F.explode("needs").alias("w")).select("w.*").distinct().collect():
        wanted.setdefault(r["low"], []).append((r["i"], r["kind"]))

    @F.arrow_udf("array<bigint>")
    def empty_signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        signer = Signer(measure, frequent.value, n_sets)
        for batch in batches:
            yield pa.array([signer.empties(_hashes(tokens), wanted) for tokens in batch.to_pylist()], pa.list_(pa.int64()))

    found = signed.select(F.explode("found").alias("sig"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    if wanted:
        lows = sorted(wanted)
        span = F.size("tokens") >= lows[0]
        empty = classes.filter(span).select("rep", F.size("tokens").alias("n"), "tokens", empty_signatures("tokens").alias("sigs"))
        bits = signed.select(F.col("rep").alias("r2"), F.col("bits").alias("bits_b"))
        found = found.unionByName(
            empty.select(F.explode("sigs").alias("sig"), F.col("rep").alias("b"), F.col("n").alias("n_b")).join(bits, F.col("b") == F.col("r2")).drop("r2")
        )
    asks = signed.select(F.explode("asks").alias("ask"), F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    both = F.col("n_a") + F.col("n_b")
    apart = both - 2 * F.ceil(both * num / (num + den) - 1e-9)
    fits = (F.col("ask") == F.col("sig")) & ((F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))) & (F.col("n_b") * den >= F.col("n_a") * num) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= apart)
    pairs = asks.join(found, fits).select("a", "b").distinct()
    left, right = classes.select(F.col("rep").alias("a"), F.col("tokens").alias("t_a")), classes.select(F.col("rep").alias("b"), F.col("tokens").alias("t_b"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("shared", shared).withColumn("union", F.size("t_a") + F.size("t_b") - F.col("shared"))
    return checked.filter(F.col("shared") * den >= F.col("union") * num).select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), (F.col("shared") / F.col("union")).alias("similarity"))


def similar_pairs(sets: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """Pairs (id_a < id_b) of ids whose non-empty sets have Jaccard >= num/den, copies included."""
    classes, members = set_classes(sets)
    classes, members = cut(classes), cut(members)
    between = similar_classes(classes, num, den)
    own = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    other = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = between.select("rep_a", "rep_b").join(own, "rep_a").join(other, "rep_b").select("x", "y")
    within = own.join(other, (F.col("rep_a") == F.col("rep_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def link_counts(sets: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """One row per id: its class and the number of other classes that are similar to it; empty sets have a null class."""
    classes, members = set_classes(sets)
    classes = cut(classes)
    between = cut(similar_classes(classes, num, den))
    ends = between.select(F.col("rep_a").alias("rep")).unionAll(between.select(F.col("rep_b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    counted = members.join(degree, "rep", "left")
    return sets.select("id").join(counted, "id", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
