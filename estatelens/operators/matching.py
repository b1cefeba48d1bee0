"""Dictionary matching on distinct texts.

Every distinct folder name and file stem is matched once, whatever the number of files it occurs
in; files join the result. Phrases of up to four tokens join the dictionary (broadcast,
configuration-sized), patterns are regular expressions on the raw text, and misspelt words meet
dictionary words in their one-letter deletions before the distance is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.config import Config, EntityDef, canonical_words, fuzzy_index, small_table
from estatelens.functions.text import UNICODE, all_ngrams, ngrams, tokenise
from estatelens.session import cut

TOKEN, PATTERN, ABBREVIATION, FUZZY = 1, 2, 3, 4
METHODS = {TOKEN: "token", PATTERN: "pattern", ABBREVIATION: "abbreviation", FUZZY: "fuzzy_token"}


def texts_of(*columns: tuple[DataFrame, Column]) -> DataFrame:
    """Distinct non-null texts of columns, with tokens and phrases; written out, since every kind of match reads it."""
    out = None
    for df, c in columns:
        own = df.select(c.alias("text"))
        out = own if out is None else out.unionAll(own)
    tokens = out.filter("text IS NOT NULL").distinct().withColumn("tokens", tokenise(F.col("text")))
    return cut(tokens.withColumn("phrases", F.array_distinct(all_ngrams(F.col("tokens")))))


def _pattern_hits(groups: list[tuple[str, int, int, tuple[str, ...]]]) -> Column:
    """Array of (label, ord, layer, pattern) of the definitions one of whose patterns occurs in ``text``; the first pattern counts."""
    hits = []
    for label, number, layer, patterns in groups:
        first = F.coalesce(*[F.when(F.col("text").rlike(UNICODE + p), F.lit(p)) for p in patterns])
        hits.append(F.when(first.isNotNull(), F.struct(F.lit(label).alias("label"), F.lit(number).alias("ord"), F.lit(layer).alias("layer"), first.alias("term"))))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


_HIT = "text string, label string, ord int, layer int, priority int, term string"


def _best(hits: DataFrame) -> DataFrame:
    """One hit per (text, label): least priority, then first term."""
    return hits.groupBy("text", "label").agg(F.min(F.struct("priority", "term_ord", "term", "ord", "layer")).alias("b")).select("text", "label", "b.ord", "b.layer", "b.priority", "b.term")


def _phrase_hits(texts: DataFrame, spark: SparkSession, rows: list[tuple], over: str = "phrases") -> DataFrame:
    terms = small_table(spark, rows, "phrase string, label string, ord int, layer int, priority int, term_ord int")
    return texts.select("text", F.explode(over).alias("phrase")).join(terms, "phrase").select("text", "label", "ord", "layer", "priority", "term_ord", F.col("phrase").alias("term"))


def type_hits(texts: DataFrame, config: Config) -> DataFrame:
    """(text, label, ord, layer, priority, term): at most one hit per text and type.

    Priorities: listed phrase, pattern on the raw text, whole-token abbreviation, misspelt
    phrase (all its words among the corrected tokens in any order, at least one not literally).
    """
    spark = texts.sparkSession
    exact = [(t, d.name, i, d.layer, TOKEN, k) for i, d in enumerate(config.types) for k, t in enumerate(d.tokens)]
    short = [(a, d.name, i, d.layer, ABBREVIATION, k) for i, d in enumerate(config.types) for k, a in enumerate(d.abbreviations)]
    hits = _phrase_hits(texts, spark, exact).unionByName(_phrase_hits(texts, spark, short, "tokens"))
    groups = [(d.name, i, d.layer, d.patterns) for i, d in enumerate(config.types) if d.patterns]
    if groups:
        found = texts.select("text", F.explode(_pattern_hits(groups)).alias("h")).select("text", "h.label", "h.ord", "h.layer", F.lit(PATTERN).alias("priority"), F.lit(0).alias("term_ord"), "h.term")
        hits = hits.unionByName(found)
    return _best(hits.unionByName(_fuzzy_hits(texts, config)))


def deletions(word: Column) -> Column:
    """A word and all its one-letter deletions."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) < 1, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), cuts)))


def one_edit_apart(a: Column, b: Column) -> Column:
    """One deletion, insertion, substitution by a letter from a to z, or swap of neighbours leads from a to b."""
    places = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = (F.levenshtein(a, b) == 2) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(
        places, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    )
    # the letter that a has and b has not is one of the alphabet's
    return ((F.levenshtein(a, b) == 1) & ((F.length(a) < F.length(b)) | (F.length(F.regexp_replace(a, "[a-z]", "")) <= F.length(F.regexp_replace(b, "[a-z]", ""))))) | swapped


def misspelt(tokens: DataFrame, config: Config) -> DataFrame:
    """(variant, canonical) of distinct tokens (variant) one edit from a dictionary word; of several words the smallest counts, dictionary words are no variants."""
    spark, least = tokens.sparkSession, int(config.weight("fuzzy", "min_token_length"))
    words = canonical_words(config)
    index = small_table(spark, fuzzy_index(config), "cut string, word string")
    other = tokens.filter(F.length("variant") >= least - 1).join(small_table(spark, [(w,) for w in words], "known string"), F.col("variant") == F.col("known"), "left_anti")
    met = other.select("variant", F.explode(deletions(F.col("variant"))).alias("cut")).join(index, "cut").select("variant", "word").distinct()
    return met.filter(one_edit_apart(F.col("variant"), F.col("word"))).groupBy("variant").agg(F.min("word").alias("canonical"))


def corrected_tokens(texts: DataFrame, config: Config) -> DataFrame:
    """(text, tokens, corrected): set of tokens with misspelt dictionary words replaced; texts without any are left out."""
    tokens = texts.select("text", F.explode("tokens").alias("variant")).distinct()
    table = misspelt(tokens.select("variant").distinct(), config)
    wrong = tokens.join(table, "variant").groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("variant", "canonical"))).alias("fix"))
    fixed = F.array_distinct(F.transform("tokens", lambda t: F.coalesce(F.try_element_at("fix", t), t)))
    return texts.join(wrong, "text").select("text", "tokens", fixed.alias("corrected"))


def _fuzzy_hits(texts: DataFrame, config: Config) -> DataFrame:
    spark = texts.sparkSession
    rows = [(w, d.name, i, d.layer, k, t, sorted(set(t.split()))) for i, d in enumerate(config.types) for k, t in enumerate(d.tokens) for w in sorted(set(t.split()))[:1]]
    terms = small_table(spark, rows, "word string, label string, ord int, layer int, term_ord int, term string, words array<string>")
    fixed = corrected_tokens(texts, config)
    met = fixed.select("text", "tokens", "corrected", F.explode("corrected").alias("word")).join(terms, "word")
    fits = (F.size(F.array_except("words", "corrected")) == 0) & (F.size(F.array_except("words", "tokens")) > 0)
    return met.filter(fits).select("text", "label", "ord", "layer", F.lit(FUZZY).alias("priority"), "term_ord", "term")


def category_hits(texts: DataFrame, config: Config) -> DataFrame:
    """Same columns; listed phrases before aliases (whole tokens), one hit per text and category."""
    spark = texts.sparkSession
    phrases = [(t, d.name, i, 0, TOKEN, k) for i, d in enumerate(config.categories) for k, t in enumerate(d.signals)]
    aliases = [(t, d.name, i, 0, ABBREVIATION, k) for i, d in enumerate(config.categories) for k, t in enumerate(d.aliases)]
    hits = _phrase_hits(texts, spark, phrases)
    return _best(hits.unionByName(_phrase_hits(texts, spark, aliases, "tokens")) if aliases else hits)


def entity_hits(texts: DataFrame, config: Config, organisational: DataFrame) -> DataFrame:
    """Same columns per entity; texts of ``organisational`` (text) are tried for patterns only."""
    spark = texts.sparkSession
    exact = [(t, d.name, i, 0, TOKEN, k) for i, d in enumerate(config.entities) for k, t in enumerate(d.tokens)]
    short = [(a, d.name, i, 0, ABBREVIATION, k) for i, d in enumerate(config.entities) for k, a in enumerate(d.abbreviations)]
    free = texts.join(organisational.select("text").distinct(), "text", "left_anti")
    hits = _phrase_hits(free, spark, exact).unionByName(_phrase_hits(free, spark, short, "tokens"))
    groups = [(d.name, i, 0, d.patterns) for i, d in enumerate(config.entities) if d.patterns]
    if groups:
        hits = hits.unionByName(texts.select("text", F.explode(_pattern_hits(groups)).alias("h")).select("text", "h.label", "h.ord", "h.layer", F.lit(PATTERN).alias("priority"), F.lit(0).alias("term_ord"), "h.term"))
    return _best(hits)


def entity_confidence(config: Config) -> Column:
    w = {k: float(config.weight("entity_extraction", k)) for k in ("token_confidence", "pattern_confidence", "abbreviation_confidence")}
    return F.when(F.col("priority") == TOKEN, w["token_confidence"]).when(F.col("priority") == PATTERN, w["pattern_confidence"]).otherwise(w["abbreviation_confidence"])


def extension_hits(extensions: DataFrame, config: Config) -> DataFrame:
    """(extension, label, ord, layer) of (extension); several types may share one."""
    rows = [(e, d.name, i, d.layer) for i, d in enumerate(config.types) for e in d.extensions]
    return extensions.join(small_table(extensions.sparkSession, rows, "extension string, label string, ord int, layer int"), "extension")


def place_texts(texts: DataFrame, names: frozenset[str]) -> DataFrame:
    """(text) of distinct texts (text, tokens) that hold a place name: a token, or two neighbouring ones, among those with a letter or digit.

    Names join as a table whose size is checked; without names there are no such texts.
    """
    kept = F.filter("tokens", lambda t: t.rlike(r"[\p{L}\p{N}]"))
    found = texts.select("text", F.explode(F.array_distinct(F.concat(kept, ngrams(kept, 2)))).alias("place"))
    return found.join(small_table(texts.sparkSession, [(n,) for n in sorted(names)], "place string"), "place", "left_semi").select("text").distinct()


def known_terms(config: Config, spark: SparkSession) -> DataFrame:
    """(term) of all dictionary terms."""
    terms = {t for d in config.types for t in (*d.tokens, *d.abbreviations)} | {t for d in config.categories for t in (*d.signals, *d.aliases)} | {t for d in config.entities for t in (*d.tokens, *d.abbreviations)}
    return small_table(spark, [(t,) for t in sorted(terms)], "term string")


def trigger_words(entity: EntityDef) -> frozenset[str]:
    """Tokens, abbreviations and the literal words that patterns begin with."""
    import re

    led = {m[1].lower() for p in entity.patterns if (m := re.match(r"\\b(\w+)", p))}
    return frozenset({*entity.tokens, *entity.abbreviations, *led})



def method_name(priority: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in METHODS.items():
        out = F.when(priority == k, name).otherwise(out)
    return out
