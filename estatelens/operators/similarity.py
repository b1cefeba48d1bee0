"""Trigram similarity joins and single-linkage groups over pools of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import char_trigrams, strip_scheme_noise, tokenise
from estatelens.session import cut


def similar_values(pool: DataFrame, threshold: float = 0.55, within: str | None = None, loose: str | None = None) -> DataFrame:
    """Pairs a < b of values (value) whose trigram Jaccard reaches ``threshold`` (over 0), equal in ``within`` if named.

    ``loose`` names a boolean column: only pairs of which one value at least is marked there.

    Inverted index over a prefix of rare trigrams: with trigrams in ascending order of frequency
    two similar values share one of the first n - ceil(t n) + 1, so frequent trigrams make no
    buckets. Candidates pass the length bound and are verified on whole trigram sets.
    """
    keys = [within] if within else []
    mark = [loose] if loose else []
    named = cut(pool.select("value", *keys, *mark).distinct().withColumn("grams", char_trigrams(F.col("value"))).filter(F.size("grams") > 0))
    counts = named.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = named.select("value", *keys, *mark, F.size("grams").alias("n"), F.explode("grams").alias("g")).join(counts, "g")
    ordered = ranked.groupBy("value", *keys, *mark, "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    need = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    short = cut(ordered.select("value", *keys, *mark, "n", F.explode(F.slice("o", F.lit(1), F.col("n") - need + 1)).alias("p")).select("value", *keys, *mark, "n", F.col("p.g").alias("g")))
    a, b = (short.filter(loose).drop(loose) if loose else short).withColumnsRenamed({"value": "a", "n": "n_a"}), short.withColumnsRenamed({"value": "b", "n": "n_b"})
    fits = (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    once = (F.col("a") < F.col("b")) | (~F.col(loose) & (F.col("a") > F.col("b"))) if loose else F.col("a") < F.col("b")
    pairs = a.join(b, [*keys, "g"]).filter(once).filter(fits).select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = named.select(*keys, F.col("value").alias("a"), F.col("grams").alias("g_a")), named.select(*keys, F.col("value").alias("b"), F.col("grams").alias("g_b"))
    shared = F.size(F.array_intersect("g_a", "g_b"))
    checked = pairs.join(left, [*keys, "a"]).join(right, [*keys, "b"]).withColumn("shared", shared)
    score = F.col("shared") / (F.size("g_a") + F.size("g_b") - F.col("shared"))
    return checked.withColumn("similarity", score).filter(F.col("similarity") >= threshold).select(*keys, "a", "b", "similarity")


def group_links(pool: DataFrame, threshold: float = 0.55, within: str | None = None) -> DataFrame:
    """Pairs that link the same groups as all pairs of ``similar_values``, of which most add nothing: ([within,] a, b).

    Values that differ in their numbers only are of one kind and have the same trigrams without digits (``l``). A kind with
    enough of them is whole: any two of its values are similar, whatever their numbers, so each is linked to the first.
    Whole kinds need one similar pair to be linked. They meet in a prefix of rare trigrams without digits, since two similar
    values share t |l| - (1 - t) most of them (``most``: trigrams with digits of a value). Kinds whose values with the
    fewest digits are similar without any shared digit are linked at once; for the others a link takes shared trigrams with
    digits, in a prefix of which the values of two kinds meet before they are verified. Values of kinds that are not
    whole (``loose``) meet all values as in ``similar_values``.
    """
    keys, t = [within] if within else [], threshold
    digits = lambda g: g.rlike("[0-9]")
    named = pool.select("value", *keys).distinct().withColumns({"kind": F.regexp_replace("value", "[0-9]+", "0"), "grams": char_trigrams(F.col("value"))}).filter(F.size("grams") > 0)
    named = cut(named.select("value", *keys, "kind", F.filter("grams", lambda g: ~digits(g)).alias("l"), F.filter("grams", digits).alias("d")))
    kinds = named.groupBy(*keys, "kind").agg(F.min("value").alias("first"), F.first("l").alias("l"), F.min(F.size("d")).alias("least"), F.max(F.size("d")).alias("most"))
    kinds = kinds.withColumns({"n": F.size("l"), "need": F.ceil(F.size("l") * t - F.col("most") * (1 - t) - 1e-9).cast("int")})
    kinds = kinds.withColumn("whole", (F.col("need") >= 1) & (F.col("n") / (F.col("n") + 2 * F.col("most")) >= t))
    kinds = cut(kinds.withColumn("id", F.monotonically_increasing_id()))
    whole = kinds.filter("whole")
    flagged = named.join(kinds.select(*keys, "kind", "id", "first", "whole"), [*keys, "kind"])
    stars = flagged.filter("whole AND value <> first").select(*keys, F.col("first").alias("a"), F.col("value").alias("b"))

    # kinds that may hold similar values
    counts = whole.select(F.explode("l").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ordered = whole.select("id", *keys, "n", "need", F.explode("l").alias("g")).join(counts, "g").groupBy("id", *keys, "n", "need").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    short = cut(ordered.select("id", *keys, F.explode(F.slice("o", F.lit(1), F.col("n") - F.col("need") + 1)).alias("p")).select("id", *keys, F.col("p.g").alias("g")))
    met = short.withColumnRenamed("id", "i").join(short.withColumnRenamed("id", "j"), [*keys, "g"]).filter("i < j").select("i", "j").distinct()
    side = lambda k: whole.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("first", "l", "n", "least", "most")])
    both = met.join(side("i"), "i").join(side("j"), "j").withColumn("shared", F.size(F.array_intersect("l_i", "l_j"))).drop("l_i", "l_j")
    rest = F.col("n_i") + F.col("n_j") - F.col("shared")  # united trigrams without digits
    ends = F.least("most_i", "most_j")
    both = both.filter((F.col("shared") + ends) / (rest + ends) >= t)
    both = cut(both.select("i", "j", "first_i", "first_j", "shared", rest.alias("rest"), (F.col("shared") / (rest + F.col("least_i") + F.col("least_j")) >= t).alias("sure")))

    # values of two kinds by their numbers
    of_whole = flagged.filter("whole").select("id", "d")
    spread = of_whole.select(F.explode("d").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    by_gram = named.filter(F.size("d") > 0).select("d").distinct().select("d", F.explode("d").alias("g")).join(spread, "g").groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias("o"))
    sets = cut(of_whole.join(by_gram, "d").select("id", "o").distinct())
    open_ = both.filter("NOT sure").select("i", "j", "shared", "rest")
    need = F.greatest(F.lit(1), F.ceil((F.col("rest") + F.size("o")) * t - F.col("shared") - 1e-9).cast("int"))

    def asked(k: str) -> DataFrame:
        own = open_.join(sets.withColumnRenamed("id", k), k).filter(F.size("o") >= need)
        return own.select("i", "j", "shared", "rest", F.col("o").alias(f"o_{k}"), F.explode(F.slice("o", F.lit(1), F.size("o") - need + 1)).alias("g"))

    pairs = asked("i").join(asked("j").drop("shared", "rest"), ["i", "j", "g"])
    same = F.size(F.array_intersect("o_i", "o_j"))
    alike = pairs.filter((F.col("shared") + same) / (F.col("rest") + F.size("o_i") + F.size("o_j") - same) >= t).select("i", "j").distinct()
    named_kinds = both.filter("sure").select("i", "j").unionByName(alike).join(both.select("i", "j", "first_i", "first_j"), ["i", "j"])
    found = named_kinds.join(whole.select(F.col("id").alias("i"), *keys), "i") if keys else named_kinds
    links = stars.unionByName(found.select(*keys, F.least("first_i", "first_j").alias("a"), F.greatest("first_i", "first_j").alias("b")))
    if kinds.filter("NOT whole").isEmpty():
        return links
    return links.unionByName(similar_values(flagged.select("value", *keys, (~F.col("whole")).alias("loose")), t, within, "loose").select(*keys, "a", "b"))


def scheme_overlaps(pool: DataFrame, tokens_least: float = 0.8, grams_least: float = 0.6) -> DataFrame:
    """Second pass for scheme names: overlap of words and of trigrams after stripping phases and dates; both need two words.

    Of two names whose words overlap enough the one with fewer words has one of its n - ceil(t n) + 1 rarest words in the
    other, so only those are looked up, among all words of all names. A frequent word is looked up only by names that have
    no rarer one. Names meet as numbers; words and trigrams come in when candidates are verified.
    """
    named = cut(pool.select("value").distinct().withColumn("bare", strip_scheme_noise(F.col("value"))).withColumns({"words": F.array_distinct(tokenise(F.col("bare"))), "grams": char_trigrams(F.col("bare"))}).filter(F.size("words") >= 2))
    named = cut(named.withColumn("id", F.monotonically_increasing_id()))
    index = named.select("id", F.size("words").alias("n"), F.explode("words").alias("w"))
    counts = index.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ordered = index.join(counts, "w").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    need = F.ceil(F.col("n") * tokens_least - 1e-9).cast("int")
    asks = ordered.select(F.col("id").alias("i"), F.col("n").alias("n_i"), F.explode(F.slice("o", F.lit(1), F.col("n") - need + 1)).alias("p")).select("i", "n_i", F.col("p.w").alias("w"))
    met = asks.join(index.select("w", F.col("id").alias("j"), F.col("n").alias("n_j")), "w").filter("i <> j AND n_i <= n_j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    a, b = (named.select(F.col("id").alias(k), F.col("value").alias(f"v_{k}"), F.col("words").alias(f"w_{k}"), F.col("grams").alias(f"g_{k}")) for k in "ij")
    over = lambda x, y: F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    checked = met.join(a, "i").join(b, "j").filter((over("w_i", "w_j") >= tokens_least) & (over("g_i", "g_j") >= grams_least))
    return checked.select(F.least("v_i", "v_j").alias("a"), F.greatest("v_i", "v_j").alias("b"), over("g_i", "g_j").alias("similarity"))


def linked_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) for all nodes: root is the smallest node linked directly or indirectly.

    Every node hooks onto its smallest neighbour if that is smaller, chains are followed by doubling until they end in a root, then
    edges are relabelled by roots and deduplicated, until none is left: rounds grow with the logarithm of the largest group.
    """
    labels = cut(nodes.select(F.col("node").alias("node"), F.col("node").alias("root")).distinct())
    edges = cut(pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    while not edges.isEmpty():
        # the larger end hooks onto its smallest smaller neighbour; a root has none
        up = cut(edges.groupBy(F.col("y").alias("u")).agg(F.min("x").alias("to")))
        while True:
            above = up.select(F.col("u").alias("m"), F.col("to").alias("m_to"))
            doubled = cut(up.join(above, F.col("to") == F.col("m"), "left").select("u", F.coalesce("m_to", "to").alias("to"), F.col("m").isNotNull().alias("moved")))
            up = doubled.select("u", "to")
            if doubled.filter("moved").isEmpty():
                break
        ends = [up.select(F.col("u").alias(f"{k}_u"), F.col("to").alias(f"{k}_to")) for k in "xy"]
        moved = edges.join(ends[0], F.col("x") == F.col("x_u"), "left").join(ends[1], F.col("y") == F.col("y_u"), "left").select(F.coalesce("x_to", "x").alias("p"), F.coalesce("y_to", "y").alias("q")).filter("p <> q")
        edges = cut(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
        labels = cut(labels.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("to", "root").alias("root")))
    return labels
