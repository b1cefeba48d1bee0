"""Records that denote the same postal address.

An address is a line of words and separators from which postcode, flat or other part, and house number are read. What the
other words are is an assignment: a run of words is the street (whole phrase, with or without a kind such as Road), other runs
are town or locality, the rest adds nothing. Every assignment that the words allow has a cost: for words between house number
and street, for a kind left over, for a missing town, for a street or town that nothing else knows, for spelling. The assignment with the least
sum is taken, over all towns the address can be in.

Blocks are localities. A postcode's district names its town by the corpus (the phrase that the district's addresses share
and other districts lack); an address without postcode is tried in the towns its phrases are within one edit of, and in
the towns beside which its phrases are named elsewhere (neighbouring localities). Town phrases and street phrases meet through a deletion-neighbourhood index
(a phrase and all its one-letter deletions, joined by equality), streets only inside their block.

A street spelling gives way to a more frequent neighbour if most of its postcodes are the neighbour's for the same kind
of street; if it has none to compare, if it is a single row or the neighbour is five times as frequent. Streets of different postcodes stay apart
however alike. Chains of spellings are followed to their end. Flat or part, house number, letter and kind are vetoes: they must be equal, as must
the absence of each.

Everything that is compared is distinct phrases per block, which are aggregated before; addresses
themselves only meet in their final place. Rows without a street, rows without both town and postcode and prose of more than
200 words denote no place. entity_address_canonical is not used: it is often of another place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.components import follow
from estatelens.session import cut

#: Kinds of street and their abbreviations.
KINDS = {
    "road": "road rd", "street": "street str st", "lane": "lane la ln", "avenue": "avenue ave av avn", "close": "close clo cl", "court": "court crt ct", "gardens": "gardens garden gdns gdn",
    "terrace": "terrace terr ter tce", "crescent": "crescent cres cr", "drive": "drive drv dr", "place": "place pl", "square": "square sq", "grove": "grove grv gr", "way": "way wy", "walk": "walk wlk",
    "mews": "mews", "park": "park pk", "hill": "hill hl", "rise": "rise", "row": "row", "green": "green grn", "view": "view", "parade": "parade pde", "quay": "quay",
}
KIND_OF = {a: kind for kind, names in KINDS.items() for a in names.split()}
#: Costs of an assignment, measured by one for an error in the town's name.
COSTS = {
    "away": 3.0,  # the street does not touch the house number
    "behind": 0.5,  # the number follows the street
    "skipped": 0.3,  # a word between the start of the run and the street
    "kind_left": 2.0,  # another kind follows right behind the street
    "more": 0.25,  # each word that follows without a separator
    "inner": 1.5,  # an abbreviated kind inside the name
    "word": 0.1,  # each word of the name but the first
    "no_kind": 2.0,  # a street without a kind
    "nowhere": 4.0,  # neither a postcode nor words for a town
    "unnamed": 1.0,  # the postcode's town is not named
    "beside": 1.5,  # the town by a locality named beside it
    "alone": 2.0,  # a town that no postcode names
    "unknown": 1.0,  # a street that nothing else names, less the more often it is named
    "respelt": 0.5,  # a street by another spelling
    "spelling": 1.0,  # a town by another spelling
}
MARGIN = 2.5  # assignments that cost so much more than the cheapest by their form alone are not tried
_POSTCODE = re.compile(r"\b([a-z]{1,2}\d[a-z\d]?)[\s-]*(\d[a-z]{2})\b")
_FLAT = re.compile(r"\b(?:flat|flt|apartment|apt|unit)\b\.?\s*(?:no\b\.?|number|nr\.?|#)?\s*(\d+[a-z]?\b|[a-z]\b)|\b(?:flat|flt|apartment|apt|unit)\.?\s?(\d+[a-z]?)\b")
_PART = re.compile(r"\b(plot|block|suite|room|floor|studio)\b\.?\s*(?:no\b\.?|number|nr\.?|#)?\s*(\d+[a-z]?\b|[a-z]\b)")
_NUMBER = re.compile(r"(?:\b(?:no|number|nr)\b\.?\s*)?\b(\d+(?:\s*[-/]\s*\d+)?)(?!\d|(?:st|nd|rd|th)\b)(?:[\s-]*([a-z])\b)?")
_SEPARATOR = re.compile(r"[;,\n\r()]|\s+[-–—]+\s+|\s{2,}|\t")
_WORD = re.compile(r"[|,]|\d+(?:st|nd|rd|th)\b|[^\W\d_]+(?:['’][^\W\d_]+)*")
_COUNTRY = {"uk", "gb", "england", "scotland", "wales"}
LONGEST = 6  # words of a street with its kind
MOST_WORDS = 200  # a line of more words is prose, not an address
_KIND = "struct<flat:string,number:string,district:string,unit:string,ways:array<struct<cost:double,street:string,kind:string,phrases:array<string>>>>"
_WAY = pa.struct([("cost", pa.float64()), ("street", pa.string()), ("kind", pa.string()), ("phrases", pa.list_(pa.string()))])
_PARSED = pa.struct([("flat", pa.string()), ("number", pa.string()), ("district", pa.string()), ("unit", pa.string()), ("ways", pa.list_(_WAY))])


class _Line:
    """Words of an address with the run each is in, and the place of the house number (None without one)."""

    def __init__(self, text: str):
        self.words: list[str] = []
        self.run: list[int] = []
        self.mark: int | None = None
        run = 0
        for w in _WORD.findall(text):
            if w == "|":
                self.mark = len(self.words)
                run += 1
            elif w == ",":
                run += 1
            elif w not in _COUNTRY and not (w == "the" and (not self.run or self.run[-1] != run)):
                self.words.append(w)
                self.run.append(run)
        ends: dict[int, tuple[int, int]] = {}
        for i, run in enumerate(self.run):
            ends[run] = (ends.get(run, (i, i))[0], i)
        self.first, self.last = [ends[run][0] for run in self.run], [ends[run][1] for run in self.run]

    def more(self, end: int) -> int:
        """Words of the run behind a word."""
        return self.last[end] - end

    def phrases(self, start: int, end: int) -> list[str]:
        """Phrases of up to three words outside a street."""
        out: dict[str, None] = {}
        runs: dict[tuple[int, bool], list[str]] = {}
        for i, w in enumerate(self.words):
            if not start <= i <= end:
                runs.setdefault((self.run[i], i > end), []).append(w)
        for words in runs.values():
            for i in range(len(words)):
                for k in range(i + 1, min(i + 3, len(words)) + 1):
                    if all(len(w) > 1 and w != "no" for w in words[i:k]):
                        out.setdefault(" ".join(words[i:k]))
        return list(out)

    def name(self, start: int, end: int) -> str:
        words = self.words[start : end + 1]
        if words[0] in ("st", "saint") and len(words) > 1:
            words = ["saint", *words[1:]]
        return " ".join(words)

    def form(self, start: int, end: int) -> float:
        """Cost of a street's place in the line."""
        if self.mark is None:
            cost = COSTS["skipped"] * (start - self.first[start])
        elif start == self.mark:
            cost = 0.0
        else:
            cost = COSTS["behind"] + COSTS["skipped"] * (start - self.first[start]) if end + 1 == self.mark else COSTS["away"]
        if self.more(end):
            cost += COSTS["kind_left"] if self.words[end + 1] in KIND_OF else COSTS["more"] * self.more(end)
        return cost + COSTS["word"] * (end - start)

    def ways(self, coded: bool) -> list[dict]:
        """All assignments: cost of the form, street, kind and the phrases left for the town."""
        found: list[tuple[float, int, int, str]] = []
        words, n = self.words, len(self.words)
        for end in range(1, n):
            if words[end] not in KIND_OF:
                continue
            for start in range(max(self.first[end], end - LONGEST + 1), end):
                inner = sum(COSTS["inner"] for i in range(start, end) if words[i] in KIND_OF and words[i] != KIND_OF[words[i]] and not (i == start and words[i] == "st" and end > start + 1))
                if end == start + 1 and words[start] in ("st", "saint") and n > end + 1 and self.more(end):
                    inner += COSTS["inner"]
                if not (start == end - 1 and words[start] in KIND_OF and words[start] != KIND_OF[words[start]] and words[start] != "st"):
                    found.append((self.form(start, end) + inner, start, end, KIND_OF[words[end]]))
        bare: list[tuple[int, int]] = []
        if self.mark is not None and self.mark < n:
            bare += [(self.mark, end) for end in range(self.mark, min(self.mark + 4, self.last[self.mark] + 1))]
        elif self.mark is not None and n:
            bare.append((self.first[n - 1], n - 1))
        elif coded and n and self.run[-1] != self.run[0]:
            bare.append((0, self.last[0]))
        for start, end in bare:
            if end - start < LONGEST and not any(words[i] in KIND_OF for i in range(start + 1, start + 1 + self.more(start))):
                found.append((self.form(start, end) + COSTS["no_kind"], start, end, ""))
        if self.mark is not None and (near := [f for f in found if f[1] == self.mark or f[2] + 1 == self.mark]):
            found = near  # what touches the house number comes before what does not
        named = [(cost + (0.0 if coded or n > end - start + 1 else COSTS["nowhere"]), start, end, kind) for cost, start, end, kind in found if end - bool(kind) > start or len(words[start]) > 1]
        least = min((way[0] for way in named), default=0.0)
        best: dict[tuple[str, str], dict] = {}
        for cost, start, end, kind in sorted(named):
            if cost <= least + MARGIN:
                street = self.name(start, end - 1 if kind else end)
                if (street, kind) not in best:
                    best[street, kind] = {"cost": cost, "street": street, "kind": kind, "phrases": self.phrases(start, end)}
        return list(best.values())


def parse(text: str | None) -> dict | None:
    """Components of one address: flat, number, district, unit, and the ways to read its street, the cheapest first; None if there is no street."""
    if not text:
        return None
    s = text.lower()
    district = unit = number = None
    if m := _POSTCODE.search(s):
        district, unit = m[1], m[2]
        s = f"{s[: m.start()]} , {s[m.end() :]}"
    parts = []
    if m := _FLAT.search(s):
        parts.append(m[1] or m[2])
        s = f"{s[: m.start()]} , {s[m.end() :]}"
    while m := _PART.search(s):
        parts.append(f"{m[1]} {m[2]}")
        s = f"{s[: m.start()]} , {s[m.end() :]}"
    if m := _NUMBER.search(s):
        number = re.sub(r"\s", "", m[1]) + (m[2] or "")
        s = f"{s[: m.start()]} | {s[m.end() :]}"
    line = _Line(_SEPARATOR.sub(" , ", s))
    ways = line.ways(district is not None) if len(line.words) <= MOST_WORDS else []
    return {"flat": ", ".join(sorted(parts)), "number": number or "", "district": district, "unit": unit, "ways": ways} if ways else None


def parsed_address(address: Column) -> Column:
    """Struct of components per address, null where there is no street."""

    @F.arrow_udf(_KIND)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([parse(t) for t in batch.to_pylist()], _PARSED)

    return parsed.asNondeterministic()(address.cast("string"))  # evaluated once, also where a filter uses it


def distance(a: Column, b: Column) -> Column:
    """0 for equal words, 1 for one edit or swap of neighbours, else 2."""
    places = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(
        places, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    )
    apart = F.levenshtein(a, b, 2)
    return F.when(a == b, 0).when(apart == 1, 1).when((apart == 2) & swapped, 1).otherwise(2)


def deletions(word: Column) -> Column:
    """A word and all its one-letter deletions."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) < 3, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), cuts)))


def neighbours(left: DataFrame, right: DataFrame, block: str | None = None) -> DataFrame:
    """(w, v, d) pairs of words at most one edit apart (d 0 or 1), within equal blocks if named."""
    keys = [block] if block else []
    a = left.select(*keys, F.col("word").alias("w"), F.explode(deletions(F.col("word"))).alias("__cut"))
    b = right.select(*keys, F.col("word").alias("v"), F.explode(deletions(F.col("word"))).alias("__cut"))
    # the planner does not see how much the deletions add to a table, so it is kept from broadcasting them
    met = a.join(b.hint("merge"), [*keys, "__cut"]).select(*keys, "w", "v").distinct()
    return met.withColumn("d", distance(F.col("w"), F.col("v"))).filter("d <= 1")


def canonical_phrases(counted: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(block, word, canon, n_canon) from (block, word, n): a spelling goes to its most frequent neighbour if the two are one street.

    ``codes`` (block, word, kind, code, n) counts the postcodes of spellings; see the module's docstring for the rule.
    """
    counted = cut(counted)
    near = cut(neighbours(counted, counted, "block").filter("d = 1").drop("d"))
    n_w, n_v = counted.select("block", F.col("word").alias("w"), F.col("n").alias("n_w")), counted.select("block", F.col("word").alias("v"), F.col("n").alias("n_v"))
    pairs = near.join(n_w, ["block", "w"]).join(n_v, ["block", "v"]).filter("n_v > n_w OR (n_v = n_w AND v < w)")
    rare = F.col("n_w") <= F.greatest(F.lit(1), F.col("n_v") * 0.2)
    if codes is None:
        met = pairs.filter(rare & (F.col("n_v") > F.col("n_w")))
    else:
        pairs = cut(pairs)
        own = codes.select("block", F.col("word").alias("w"), "kind", "code", F.col("n").alias("n_code"))
        other = codes.select("block", F.col("word").alias("v"), "kind", "code", F.lit(1).alias("same"))
        kinds = codes.select("block", F.col("word").alias("v"), "kind").distinct()
        seen = pairs.join(own, ["block", "w"]).join(kinds, ["block", "v", "kind"]).join(other, ["block", "v", "kind", "code"], "left")
        told = seen.groupBy("block", "w", "v").agg(F.sum("n_code").alias("compared"), F.sum(F.when(F.col("same") == 1, F.col("n_code")).otherwise(0)).alias("shared"))
        met = pairs.join(told, ["block", "w", "v"], "left").filter(F.when(F.col("compared").isNull(), rare & (F.col("n_v") > F.col("n_w"))).otherwise(F.col("shared") * 2 >= F.col("compared")))
    key = lambda c: F.concat_ws("\x1f", "block", c)
    up = met.groupBy("block", "w").agg(F.max(F.struct("n_v", "v")).alias("b")).select(key("w").alias("id"), key("b.v").alias("up"))
    top = follow(cut(up)).select("id", F.substring_index("up", "\x1f", -1).alias("canon"))
    named = counted.join(top, key("word") == F.col("id"), "left").select("block", "word", "n", F.coalesce("canon", "word").alias("canon"))
    total = named.groupBy("block", "canon").agg(F.sum("n").alias("n_canon"))
    return named.join(total, ["block", "canon"]).select("block", "word", "canon", "n_canon")


def _towns(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(district, town, n), (word, town, n, cost) of towns and of localities named beside them, (word) common to many districts."""
    words = parsed.filter("district IS NOT NULL").select("district", F.explode(F.col("ways")[0]["phrases"]).alias("word")).groupBy("district", "word").agg(F.count(F.lit(1)).alias("n"))
    words = cut(words)
    spread = words.groupBy("word").agg(F.count(F.lit(1)).alias("n_districts"), F.sum("n").alias("n_all"))
    scored = words.join(spread, "word").withColumn("score", F.col("n") / (F.col("n_districts") * F.col("n_districts")))
    towns = cut(scored.groupBy("district").agg(F.max(F.struct("score", "n", F.length("word").alias("size"), "word")).alias("b")).select("district", F.col("b.word").alias("town"), F.col("b.n").alias("n")))
    known = towns.groupBy(F.col("town").alias("word")).agg(F.sum("n").alias("n")).select("word", F.col("word").alias("town"), "n", F.lit(0.0).alias("cost"))
    # a locality: at least two rows name it, and most of them in the districts of one town
    at = scored.join(towns.select("district", "town"), "district").filter("word <> town").groupBy("word", "town", "n_all").agg(F.sum("n").alias("n")).filter("n >= 2 AND n * 2 > n_all")
    beside = at.join(known.select("word"), "word", "left_anti").select("word", "town", "n", F.lit(COSTS["beside"]).alias("cost"))
    return towns, cut(known.unionByName(beside)), spread.filter("n_districts > 2").select("word")


def places(rows: DataFrame, row_id: str = "addr_id", address: str = "entity_address") -> DataFrame:
    """(id, town, street, kind, number, flat) of every row that denotes a place."""
    parsed = cut(rows.select(F.col(row_id).alias("id"), parsed_address(F.col(address)).alias("p")).filter("p IS NOT NULL").select("id", "p.*"))
    towns, known, common = _towns(parsed)

    way = lambda df, *extra: df.select("id", "number", "flat", *extra, F.posexplode("ways").alias("way", "x")).select("id", "number", "flat", *extra, "way", "x.*")
    coded = way(parsed.filter("district IS NOT NULL").join(towns.select("district", "town"), "district", "left").withColumn("code", F.concat("district", "unit")), "town", "code")
    coded = coded.withColumn("place_cost", F.when(F.coalesce(F.array_contains("phrases", F.col("town")), F.lit(False)), 0.0).otherwise(COSTS["unnamed"])).withColumn("town", F.coalesce("town", F.concat(F.lit("district "), F.substring("code", F.lit(1), F.length("code") - 3))))

    # addresses without postcode: the towns that their phrases can stand for
    bare = cut(way(parsed.filter("district IS NULL")))
    own_words = cut(bare.filter("way = 0").select(F.explode("phrases").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(bare.filter("way > 0").select(F.explode("phrases").alias("word")).distinct().withColumn("n", F.lit(0).cast("bigint"))).groupBy("word").agg(F.sum("n").alias("n")))
    near = neighbours(own_words, known.select("word").distinct()).join(known.withColumnRenamed("word", "v"), "v")
    stands = cut(near.groupBy(F.col("w").alias("word"), "town").agg(F.min(F.struct((F.col("d") * COSTS["spelling"] + F.col("cost")).alias("place_cost"), (-F.col("n")).alias("neg"))).alias("b")).select("word", "town", "b.place_cost", "b.neg"))
    # towns that no postcode names: phrases that are not known from several districts, spelled alike
    alone = own_words.join(stands.select("word").distinct(), "word", "left_anti").join(common, "word", "left_anti").filter("n > 0").select(F.lit("").alias("block"), "word", "n")
    unknown = canonical_phrases(alone).select("word", F.concat(F.lit("word "), "canon").alias("town"), F.lit(COSTS["alone"]).alias("place_cost"), (-F.col("n_canon")).alias("neg"))
    placed = bare.select("id", "number", "flat", "way", "cost", "street", "kind", F.explode("phrases").alias("word")).join(stands.unionByName(unknown), "word")
    chosen = placed.groupBy("id", "number", "flat", "way", "cost", "street", "kind", "town").agg(F.min(F.struct("place_cost", "neg")).alias("b")).select("id", "number", "flat", "way", "cost", "street", "kind", "town", "b.place_cost", "b.neg")
    options = ("id", "number", "flat", "way", "cost", "street", "kind", "town", "place_cost", "neg")
    every = cut(coded.withColumn("neg", F.lit(0).cast("bigint")).select(*options, "code").unionByName(chosen.withColumn("code", F.lit(None).cast("string"))))

    # street names of a town; only the likeliest way of an address counts for them
    first = every.join(every.groupBy(F.col("id").alias("f_id")).agg(F.min(F.struct(F.col("cost") + F.col("place_cost"), "way", "neg", "town")).alias("f")), (F.col("id") == F.col("f_id")) & (F.col("way") == F.col("f.way")) & (F.col("town") == F.col("f.town")))
    likely = cut(first.select(F.col("town").alias("block"), F.col("street").alias("word"), "kind", "code"))
    spelled = likely.groupBy("block", "word").agg(F.count(F.lit(1)).alias("n")).unionByName(every.filter("way > 0").select(F.col("town").alias("block"), F.col("street").alias("word")).distinct().withColumn("n", F.lit(0).cast("bigint"))).groupBy("block", "word").agg(F.sum("n").alias("n"))
    codes = cut(likely.filter("code IS NOT NULL").groupBy("block", "word", "kind", "code").agg(F.count(F.lit(1)).alias("n")))
    names = cut(canonical_phrases(spelled, codes)).select(F.col("block").alias("town"), F.col("word").alias("street"), "canon", "n_canon")
    priced = every.join(names, ["town", "street"], "left").withColumn("canon", F.coalesce("canon", "street"))
    sum_ = F.col("cost") + F.col("place_cost") + COSTS["unknown"] / F.sqrt(F.greatest(F.lit(1), F.coalesce("n_canon", F.lit(1)))) + F.when(F.col("canon") != F.col("street"), COSTS["respelt"]).otherwise(0.0)
    best = priced.groupBy("id").agg(F.min(F.struct(F.round(sum_, 6).alias("sum"), "place_cost", "neg", "way", "town", F.col("canon").alias("street"), "kind", "number", "flat")).alias("b"))
    return best.select("id", "b.town", "b.street", "b.kind", "b.number", "b.flat")


_PLACE = ("town", "street", "kind", "number", "flat")


def same_place_pairs(rows: DataFrame, row_id: str = "addr_id", address: str = "entity_address") -> DataFrame:
    """(id_a < id_b) of rows that denote the same place. An empty table gives an empty result."""
    found = cut(places(rows, row_id, address))
    a, b = found.withColumnRenamed("id", "id_a"), found.withColumnRenamed("id", "id_b")
    return a.join(b, list(_PLACE)).filter("id_a < id_b").select("id_a", "id_b")


def place_groups(rows: DataFrame, row_id: str = "addr_id", address: str = "entity_address") -> DataFrame:
    """(id, place_id, n_records): place_id is the smallest id of the place; null for rows that denote none."""
    found = cut(places(rows, row_id, address))
    groups = found.groupBy(*_PLACE).agg(F.min("id").alias("place_id"), F.count(F.lit(1)).alias("n_records"))
    return rows.select(F.col(row_id).alias("id")).join(found.join(groups, list(_PLACE)).select("id", "place_id", "n_records"), "id", "left")
