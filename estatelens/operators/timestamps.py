"""Mixed timestamp notations to one UTC instant.

Every value is reduced to a shape mask (digit -> ``9``, letter -> ``a``, white space -> a
blank, the rest stands). Each distinct mask is matched once against the grammar below and
mapped to a parser: the positions of its fields. All values of a mask are then one
character matrix, so fields are cut out and converted column-wise, and wall-clock times go
through the zone transition tables of :mod:`estatelens.functions.zones`.

Results: ``None`` for null, blank, impossible or truncated values, values without a time of
day, instants before ``floor_year``, wall-clock times that the zone had twice or never, and
wall-clock times without a known zone. Digits beyond microseconds are cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.zones import offset_at, tz_version, wall_to_utc, zone_table

MONTHS = {
    **{m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())},
    **{m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())},
    **{m: i + 1 for i, m in enumerate("januar februar märz april mai juni juli august september oktober november dezember".split())},
    **{m: i + 1 for i, m in enumerate("janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split())},
    "sept": 9, "mrz": 3, "okt": 10, "dez": 12,
}
DAYS = {d for w in "monday tuesday wednesday thursday friday saturday sunday".split() for d in (w, w[:3])} | {"tues", "thur", "thurs"}

_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa(?!a)|a\.a\.))?"
_ZONE = r"(?: ?(?P<off>[+-]99(?::?99)?)(?:\[[a/_+\-9]+\])?| ?(?P<abbr>a{1,5}))?"
_DATES = (
    r"(?P<Y>9999)-(?P<m>99)-(?P<d>99)",
    r"(?P<n1>9999)[/.](?P<n2>99?)[/.](?P<n3>99?)",
    r"(?P<n1>99?)(?P<sep>[/.-])(?P<n2>99?)(?P=sep)(?P<n3>9999|99)",
    r"(?:(?P<dow>a{3,9}),? )?(?P<d>99?)(?:\.? |-)(?P<mon>a{3,9})(?:\.? |-)(?P<Y>9999)",
    r"(?:(?P<dow>a{3,9}),? )?(?P<mon>a{3,9})\.? (?P<d>99?),? (?P<Y>9999)",
)
GRAMMAR = [re.compile(p) for p in [*(rf"{d}(?:(?P<tee>a)|,? )\s?{_TIME}{_ZONE}" for d in _DATES), r"(?P<Y>9{4})(?P<m>99)(?P<d>99)(?P<tee>a)(?P<H>99)(?P<M>99)(?P<S>99)(?P<f>)(?P<off>)(?P<abbr>a?)"]]
#: Plain numbers by their count of digits: units per second and seconds from the unit's epoch to 1970.
EPOCHS = {9: (1, 0), 10: (1, 0), 12: (1_000, 0), 13: (1_000, 0), 15: (1_000_000, 0), 16: (1_000_000, 0), 17: (10_000_000, 11_644_473_600), 18: (10_000_000, 11_644_473_600), 19: (1_000_000_000, 0)}
TICKS_TO_1970 = 62_135_596_800  # 18 digits above this many 100 ns ticks count from year 1
NEVER = np.iinfo("int64").min


@lru_cache(maxsize=100_000)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The parser of one mask: its kind and the span of every field; None if no rule fits."""
    if re.fullmatch("9+", mask):
        return ("compact", {"Y": (0, 4), "m": (4, 6), "d": (6, 8), "H": (8, 10), "M": (10, 12), "S": (12, 14)}) if len(mask) == 14 else ("epoch", {"n": (0, len(mask))}) if len(mask) in EPOCHS else None
    if m := re.fullmatch(r"(?P<n>9{9,10}|9{12,13})\.(?P<f>9+)", mask):
        return "epoch", {k: m.span(k) for k in ("n", "f")}
    if m := re.fullmatch(r"(?P<n>9{5})\.(?P<f>9{1,12})", mask):
        return "serial", {k: m.span(k) for k in ("n", "f")}
    for rule in GRAMMAR:
        if m := rule.fullmatch(mask):
            return "fields", {k: v for k, v in ((k, m.span(k)) for k in rule.groupindex) if v[1] > v[0]}
    return None


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    total = np.zeros(len(chars), "int64")
    for i in range(*span):
        total = total * 10 + (chars[:, i].astype("int64") - 48)
    return total


def _words(texts: list[str], span: tuple[int, int]) -> np.ndarray:
    return np.array([t[span[0] : span[1]] for t in texts], dtype=object)


def _lookup(words: np.ndarray, known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(w.lower(), 0) for w in words], "int64")


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 of proleptic Gregorian dates."""
    month = np.where((m >= 1) & (m <= 12), m, 1)
    first = ((np.clip(y, 1, 9999) - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype("int64")
    return first + d - 1


def _valid_date(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((m >= 1) & (m <= 12), m, 0)]
    return (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length + (leap & (m == 2)))


def _fraction(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Microseconds of the digits after the point; further digits are cut off."""
    used = min(span[1] - span[0], 6)
    return _number(chars, (span[0], span[0] + used)) * 10 ** (6 - used)


def _by_zone(zones: np.ndarray, wall: np.ndarray, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds and validity; names: the abbreviation of each row, None for plain wall clock."""
    utc, ok = np.zeros(len(wall), "int64"), np.zeros(len(wall), bool)
    codes, inverse = np.unique(np.array([z or "" for z in zones], dtype=object).astype(str), return_inverse=True)
    for i, zone in enumerate(codes):
        rows, known = np.flatnonzero(inverse == i), zone_table(zone or None)
        if names is None:
            if known is not None:
                utc[rows], ok[rows] = wall_to_utc(known, wall[rows])
            continue
        for name in set(names[rows]):
            own = rows[names[rows] == name]
            if name in ("UTC", "UT", "Z"):
                utc[own], ok[own] = wall[own], True
            elif known is not None:
                for offset in set(known.offsets[known.names == name]):
                    at = wall[own] - offset
                    fits = known.names[offset_at(known, at)[1]] == name
                    utc[own[fits]], ok[own[fits]] = at[fits], True
    return utc, ok


def _parse(kind: str, spans: dict[str, tuple[int, int]], texts: list[str], zones: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """UTC microseconds of all values of one mask; NEVER where there is no instant."""
    chars = np.array(texts).view("uint32").reshape(len(texts), -1)
    if kind == "epoch":
        digits = spans["n"][1] - spans["n"][0]
        per, before = EPOCHS[digits]
        n = _number(chars, spans["n"])
        if digits == 18:
            before = np.where(n >= TICKS_TO_1970 * per, TICKS_TO_1970, before)
        seconds = n // per - before
        micros = seconds * 1_000_000 + (n % per) * 1_000_000 // per
        if "f" in spans:
            micros += _fraction(chars, spans["f"]) // per
        if digits == 12:  # 12 digits that make no instant from 1980 on as milliseconds are compact digits
            wall, ok = _wall(chars, {"Y": (0, 4), "m": (4, 6), "d": (6, 8), "H": (8, 10), "M": (10, 12)}, texts, orders)
            utc, once = _by_zone(zones, wall, None)
            micros = np.where(seconds >= 315_532_800, micros, np.where(ok & once, utc * 1_000_000, NEVER))
        return micros
    if kind == "serial":
        width = spans["f"][1] - spans["f"][0]
        seconds = (_number(chars, spans["f"]) * 86400 + 10**width // 2) // 10**width
        utc, ok = _by_zone(zones, (_number(chars, spans["n"]) - 25569) * 86400 + seconds, None)
        return np.where(ok, utc * 1_000_000, NEVER)
    wall, ok = _wall(chars, spans, texts, orders)
    micros = _fraction(chars, spans["f"]) if "f" in spans else np.zeros(len(texts), "int64")
    if "off" in spans:
        a, b = spans["off"]
        colon = b - a == 6
        hours, minutes = _number(chars, (a + 1, a + 3)), _number(chars, (a + 3 + colon, b)) if b - a > 3 else 0
        ok &= (hours <= 18) & (np.asarray(minutes) < 60)
        utc = wall - np.where(chars[:, a] == ord("-"), -1, 1) * (hours * 3600 + minutes * 60)
    else:
        names = np.array([x if len(x) > 1 else x.upper() for x in _words(texts, spans["abbr"])], dtype=object) if "abbr" in spans else None
        utc, fits = _by_zone(zones, wall, names)
        ok &= fits
    return np.where(ok, utc * 1_000_000 + micros, NEVER)


def _wall(chars: np.ndarray, spans: dict[str, tuple[int, int]], texts: list[str], orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wall-clock seconds and whether date and time exist."""
    ok = np.ones(len(chars), bool)
    if "n1" in spans:
        n1, n2, n3 = (_number(chars, spans[k]) for k in ("n1", "n2", "n3"))
        if spans["n1"][1] - spans["n1"][0] == 4:
            y, m, d = n1, n2, n3
        else:
            long_year = spans["n3"][1] - spans["n3"][0] == 4
            ymd, mdy = orders == "ymd", orders == "mdy"
            ok &= (ymd & (not long_year)) | mdy | (orders == "dmy")
            y = np.where(ymd, n1, n3) + (0 if long_year else 2000)
            m, d = np.where(ymd | ~mdy, n2, n1), np.where(ymd, n3, np.where(mdy, n2, n1))
    else:
        y, d = _number(chars, spans["Y"]), _number(chars, spans["d"])
        m = _lookup(_words(texts, spans["mon"]), MONTHS) if "mon" in spans else _number(chars, spans["m"])
    if "dow" in spans:
        ok &= np.array([w.lower() in DAYS for w in _words(texts, spans["dow"])])
    if "tee" in spans:
        ok &= np.isin(chars[:, spans["tee"][0]], (ord("T"), ord("t")))
    ok &= _valid_date(y, m, d)
    hour, minute = _number(chars, spans["H"]), _number(chars, spans["M"])
    second = _number(chars, spans["S"]) if "S" in spans else np.zeros(len(chars), "int64")
    if "ap" in spans:
        half = np.array([w.lower().replace(".", "") for w in _words(texts, spans["ap"])], dtype=object)
        ok &= ((half == "am") | (half == "pm")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.where(half == "pm", 12, 0)
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    return _days(y, m, d) * 86400 + hour * 3600 + minute * 60 + second, ok


def parse_batch(values: pa.Array, zones: pa.Array, orders: pa.Array, floor: int) -> pa.Array:
    """UTC microseconds of a batch of values; see the module's docstring."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    trimmed = pc.utf8_trim_whitespace(values.cast(pa.string()))
    mask = trimmed
    for pattern, sign in ((r"\pL", "a"), (r"\d", "9"), (r"\s", " ")):
        mask = pc.replace_substring_regex(mask, pattern, sign)
    coded = pc.dictionary_encode(mask)
    out = np.full(len(values), NEVER, "int64")
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    texts = np.array(trimmed.to_pylist(), dtype=object)
    zone, order = (np.array(x.to_pylist(), dtype=object) for x in (zones, orders))
    by_code = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[by_code], np.arange(len(coded.dictionary) + 1))
    for code, shape in enumerate(coded.dictionary.to_pylist()):
        # "am"/"pm" look like a zone's name in a mask, so their masks are split by that word
        rows = by_code[bounds[code] : bounds[code + 1]]
        if (parser := parser_of(shape)) is not None:
            kind, spans = parser
            own = [texts[i] for i in rows]
            if "ap" in spans and shape[spans["ap"][0] :].isalpha() and spans["ap"][1] == len(shape):
                half = np.array([t[spans["ap"][0] :].lower() in ("am", "pm") for t in own])
                zoned = {k: v for k, v in spans.items() if k != "ap"} | {"abbr": spans["ap"]}
                for part, how in ((half, spans), (~half, zoned)):
                    if part.any():
                        out[rows[part]] = _parse(kind, how, [t for t, p in zip(own, part) if p], zone[rows[part]], order[rows[part]])
            else:
                out[rows] = _parse(kind, spans, own, zone[rows], order[rows])
    return pa.array(out, pa.int64(), mask=out < floor)


def utc_micros(value: Column, zone: Column, order: Column, floor_year: int = 1980) -> Column:
    """Column of UTC microseconds; zone and order are the estate's IANA zone and date order (nullable)."""
    floor, release = int(np.datetime64(f"{floor_year}-01-01", "us").astype("int64")), tz_version()

    @F.arrow_udf("bigint")
    def convert(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if tz_version() != release:
            raise RuntimeError(f"zone tables {tz_version()} here, {release} on the driver")
        for values, zones, orders in batches:
            yield parse_batch(values, zones, orders, floor)

    # marked so that a filter on the result does not evaluate it a second time below the projection
    return convert.asNondeterministic()(value.cast("string"), zone.cast("string"), order.cast("string"))


def with_instant(files: DataFrame, estates: DataFrame, value: str = "last_modified", out: str = "utc_micros", floor_year: int = 1980, keep: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with the UTC instant of ``value`` in ``out``.

    ``estates`` gives ``time_zone`` and ``date_order`` by ``source_system``; rows whose estate is
    missing or null keep values that carry their own zone. ``keep`` names further columns of
    ``estates`` to take along (prefixed ``estate_``). The estates come in by a left join whose
    strategy is left to the planner, which broadcasts them only below its size threshold.
    """
    own = estates.select(
        F.col("source_system").alias("__estate"), F.col("time_zone").alias("__zone"), F.col("date_order").alias("__order"), *[F.col(k).alias(f"estate_{k}") for k in keep]
    ).dropDuplicates(["__estate"])
    joined = files.join(own, files["source_system"] == own["__estate"], "left")
    return joined.withColumn(out, utc_micros(joined[value], joined["__zone"], joined["__order"], floor_year)).drop("__estate", "__zone", "__order")
