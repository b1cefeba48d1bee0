"""Addresses, plots and scheme names as normalised strings, extracted from folder names.

Each distinct name is read once by an Arrow kernel: the rules walk over the words of a name in
both directions, which column expressions cannot do readably, and distinct names are few compared with files.
Words are compared without edge punctuation and in lower case; results are in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.config import Config, EntityDef
from estatelens.functions.text import DATES, NEW_NOTE, ORPHAN, PHASE, POSTCODE, WORD_EDGE, YEAR
from estatelens.operators.matching import trigger_words

#: Fixed values.
LINKS = frozenset({"&", "to", "and"})
RANGE_GAP = 30
_DATES = [re.compile(p, re.I) for p in DATES]
_NOISE = [re.compile(p, re.I) for p in (NEW_NOTE, PHASE, YEAR)]
_POSTCODE = re.compile(POSTCODE, re.I)
_ORPHAN = re.compile(ORPHAN)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def undated(text: str) -> str:
    for pattern in _DATES:
        text = pattern.sub("", text)
    return _squeezed(text)


class Words:
    """The words of a name, as written and bare."""

    def __init__(self, text: str):
        self.raw = text.split()
        self.bare = [w.strip(WORD_EDGE).lower() for w in self.raw]

    def __len__(self) -> int:
        return len(self.raw)

    def first(self, wanted: Callable[[str], bool]) -> int | None:
        return next((i for i, w in enumerate(self.bare) if wanted(w)), None)

    def led_by(self, at: int, most: int = 2) -> list[int]:
        """Up to ``most`` alphabetic words right before a position, in order."""
        before = takewhile(lambda i: self.bare[i].isalpha() and self.bare[i] not in LINKS, range(at - 1, max(at - 1 - most, -1), -1))
        return list(before)[::-1]

    def followed(self, at: int) -> list[int]:
        """The next word unless it opens a bracket, or starts with a dash or digit."""
        return [at + 1] if at + 1 < len(self.raw) and not re.match(r"[(\[{\-\d]", self.raw[at + 1]) else []


def tidy(words: list[str]) -> str:
    return " ".join(b for b in (w.strip(WORD_EDGE) for w in " ".join(words).lower().split()) if b)


def _numeric(word: str) -> bool:
    return any(c.isdigit() for c in word)


def address_of(name: str | None, entity: EntityDef) -> str:
    """Number, up to two words, street term (spelt out), one word after, and the postcode; "" if there is none."""
    text = undated((name or "").strip())
    code = ""
    if m := _POSTCODE.search(text):
        code = m[1].lower()
        text = _squeezed(text[: m.start()] + text[m.end() :])
    w = Words(text)
    tokens, short = set(entity.tokens), set(entity.abbreviations)
    at = w.first(tokens.__contains__)
    by_short = at is None
    if by_short:
        at = w.first(short.__contains__)
    if at is None:
        return code
    lead = w.led_by(at)
    start = lead[0] if lead else at
    # the house number: numbers and links before the street's words, single letters only between numbers
    number: list[int] = []
    for i in range(start - 1, -1, -1):
        b = w.bare[i]
        if _numeric(b) or b in LINKS or (len(b) == 1 and b.isalpha() and number and _numeric(w.bare[i + 1])):
            number.insert(0, i)
        else:
            break
    while number and w.bare[number[-1]] in LINKS:
        number.pop()
    term = (entity.expansions.get(w.bare[at]) if by_short else None) or w.raw[at]
    street = tidy([*(w.raw[i] for i in (*number, *lead)), term, *(w.raw[i] for i in w.followed(at))])
    return f"{street} {code}".strip() if code else street


def _leading_number(word: str) -> int | None:
    m = re.match(r"\d+", word.strip(WORD_EDGE))
    return int(m[0]) if m else None


def _is_dash(word: str) -> bool:
    return word.strip() == "-" or word.strip(WORD_EDGE) == "-"


def _without_tail(words: list[str], dashes: bool) -> list[str]:
    out = list(words)
    while out and (out[-1].strip(WORD_EDGE).lower() in LINKS or (dashes and _is_dash(out[-1]))):
        out.pop()
    return out


def rising(words: list[str]) -> list[str]:
    """Cut at the first lone dash whose left number is greater than its right one: it parts two things."""
    for i, word in enumerate(words):
        if _is_dash(word):
            left = next((n for x in reversed(words[:i]) if (n := _leading_number(x)) is not None), None)
            right = next((n for x in words[i + 1 :] if (n := _leading_number(x)) is not None), None)
            if left is not None and right is not None and left > right:
                return words[:i]
    return words


def before_house_number(words: list[str], after: list[str], street_terms: frozenset[str]) -> list[str]:
    """Where a street follows, drop what a lone dash parts off, or the far end of a wide hyphenated range."""
    if not words or not any(x.strip(WORD_EDGE + "-–—").lower() in street_terms for x in after[:3]):
        return words
    dashes = [i for i, word in enumerate(words) if _is_dash(word)]
    if dashes:
        return _without_tail(words[: dashes[-1]], False)
    low, dash, high = words[-1].strip(WORD_EDGE).partition("-")
    a, b = _leading_number(low), _leading_number(high)
    return [*words[:-1], low.strip()] if dash and a is not None and b is not None and b - a > RANGE_GAP else words


def plot_of(name: str | None, entity: EntityDef, address: EntityDef | None = None) -> str:
    """Plot term (spelt out) with its numbers and letters, else the first pattern's match; "" if there is none."""
    text = undated((name or "").strip())
    terms = trigger_words(entity)
    one = lambda x: x[:-1] if x.endswith("s") and len(x) > 1 and x[:-1] in terms else x
    w = Words(text)
    at = w.first(lambda x: x in terms or one(x) in terms)
    if at is not None:
        own = lambda i: (
            w.raw[i][0] not in "([{" and w.bare[i] not in terms and one(w.bare[i]) not in terms and (_numeric(w.bare[i]) or _is_dash(w.raw[i]) or (len(w.bare[i]) == 1 and w.bare[i].isalpha()) or w.bare[i] in LINKS)
        )
        taken = list(takewhile(own, range(at + 1, len(w))))
        stop = taken[-1] + 1 if taken else at + 1
        ids = rising(_without_tail([w.raw[i] for i in taken], True))
        if address is not None:
            ids = before_house_number(ids, w.raw[stop:], frozenset(address.tokens))
        if ids:
            bare = w.bare[at]
            single = one(bare) if bare not in terms else bare
            full = entity.expansions.get(single)
            term = w.raw[at] if not full else full + ("s" if single != bare else "")
            return tidy([term, *ids])
    for pattern in entity.patterns:
        if m := re.search(pattern, text.lower(), re.I):
            return tidy([m[0]])
    return ""


def scheme_of(name: str | None, address: EntityDef, places: frozenset[str] = frozenset()) -> str:
    """Place names and street names of a scheme's folder name, in order; "" if there are none."""
    text = undated((name or "").strip())
    for pattern in _NOISE:
        text = pattern.sub("", text)
    w = Words(_squeezed(_ORPHAN.sub("", _squeezed(text))))
    named = {i for i, b in enumerate(w.bare) if b in places}
    for i in range(len(w) - 1):
        if f"{w.bare[i]} {w.bare[i + 1]}" in places:
            named |= {i, i + 1}
    kept, spelt = set(named), {}
    for i, b in enumerate(w.bare):
        short = b in address.abbreviations
        if b in address.tokens or short:
            before = takewhile(lambda k: w.bare[k].isalpha(), range(i - 1, max(i - 3, -1), -1))
            kept |= {i, *before, *w.followed(i)}
            if short and i not in named and (full := address.expansions.get(b)):
                spelt[i] = full
    return tidy([spelt.get(i, w.raw[i]) for i in sorted(kept)])


def _kernel(read: Callable[[str | None], str]) -> Callable[[Column], Column]:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([read(t) for t in batch.to_pylist()], pa.string())

    return run


def extractors(config: Config) -> dict[str, Callable[[Column], Column]]:
    """Column functions by kind of entity."""
    plot, address, places = config.entity("plot"), config.entity("address"), config.place_names
    return {
        "address": _kernel(lambda t: address_of(t, address)),
        "plot": _kernel(lambda t: plot_of(t, plot, address)),
        "scheme": _kernel(lambda t: scheme_of(t, address, places)),
    }


def extract_distinct(values: DataFrame, config: Config, kind: str) -> DataFrame:
    """(value, extracted) of the distinct non-null values of ``values`` (value)."""
    return values.filter("value IS NOT NULL").distinct().withColumn("extracted", extractors(config)[kind](F.col("value")))


def add_extracted(files: DataFrame, config: Config) -> DataFrame:
    """entity_*_extracted, and for plots and addresses extracted_*s: the raw matches with their extraction."""
    df = files
    for kind in ("address", "plot", "scheme"):
        column = f"entity_{kind}"
        if column not in df.columns:
            continue
        values = files.select(F.col(column).alias("value"))
        raw = f"raw_{kind}s"
        if raw in df.columns:
            values = values.unionAll(files.select(F.explode(F.transform(raw, lambda m: m["value"])).alias("value")))
        read = extract_distinct(values, config, kind)
        one = read.select(F.col("value").alias("__v"), F.col("extracted").alias(f"{column}_extracted"))
        df = df.join(one, F.col(column) == F.col("__v"), "left").drop("__v")
        if raw in df.columns:
            chains = files.select(raw).filter(F.size(raw) > 0).distinct()
            parts = chains.select(raw, F.posexplode(raw).alias("__pos", "__m")).join(read, F.col("__m.value") == F.col("value"))
            lists = parts.groupBy(F.col(raw).alias("__raw")).agg(F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("pos"), F.struct("__m.value", "__m.confidence", "__m.depth", "extracted").alias("m")))).alias("__l"))
            lists = lists.select("__raw", F.transform("__l", lambda x: x["m"]).alias(f"extracted_{kind}s"))
            df = df.join(lists, F.col(raw) == F.col("__raw"), "left").drop("__raw")
    return df
