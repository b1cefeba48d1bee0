"""Garbled text from wrong character decodings, found and restored.

A wrong decoding is a substitution cipher: bytes of the true encoding became letters of another code page. Ciphers are chains
of steps, each "UTF-8 read as page W" or "page T read as page R". Which cipher was used where is hidden, as is the page itself where it is none
of the known ones. Both are learned by expectation-maximisation against character bigrams of the whole corpus:

* The corpus is reduced to its runs of non-ASCII letters with the ASCII letter on either side, counted per source.
* Known pages are starting points: first the common ones, then, for runs that none of these explains, every code page
  that the Python codecs have, East Asian ones included. Steps are undone one after the other for as long as one fits.
* E-step: the posterior of every cipher that can undo a run, from the bigram likelihood of the
  undone run against the run as it stands and the cipher's weight in that source.
* M-step: weights per source and the bigram counts, which move from garbled to restored letters. Rounds go on until the weights stand still.
* Runs that no page explains are left over. In sources whose leftovers look like UTF-8 (a few letters begin nearly all of them and hardly ever stand second) a
  page is learned freely: letter -> byte, by expectation-maximisation over all spellings of frequent letters
  (forward and backward over the run), until it stands still. It is kept where it explains more than it takes to state it.

Then each text is decoded by the best path over its runs (changing the cipher costs its weight), so
stretches come out whole whatever their bounds, and a run is undone by ``translate()`` with the cipher's
table. Texts that quote garbled letters as their subject (every garbled run of a line stands
directly in quotation marks) keep them. Texts with replacement characters are affected and cannot be restored.
Null, empty and ASCII texts are never affected.

The model is of fixed size (2^20 hashed bigrams, 2^16 letters, weights and tables for 4,096 classes of sources) and so are its messages.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from encodings.aliases import aliases
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.session import cut

#: Pages that UTF-8 bytes are commonly read as, and (read as, truly) pairs of single-byte pages.
PAGES = ("cp1252", "cp437", "cp850", "cp1250", "cp1251", "mac_roman", "koi8-r", "cp866", "iso8859-2")
SWAPS = (("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"))
EAST_PAGES = ("gbk", "cp932", "big5", "cp949", "euc_jp")
BIGRAMS, LETTERS, SOURCES = 1 << 20, 1 << 16, 4096
#: A run is non-ASCII letters of one kind: East Asian ones or others.
_EAST = "ᄀ-ᇿ⺀-鿿ꥠ-꥿가-퟿豈-﫿︰-﹏＀-￯"
RUN = re.compile(rf"[^\x00-\x7f{_EAST}]+|[{_EAST}]+")
#: The East Asian letters of RUN by code point, and its letters below 128.
EAST = np.zeros(0x110000, bool)
for _a, _b in zip(_EAST[::3], _EAST[2::3]):
    EAST[ord(_a) : ord(_b) + 1] = True
_PLAIN = re.compile(r"[\x00-\x7f]+")
CHUNK = 1 << 20  # letters of texts that are worked on at once, which bounds the memory taken
RARITY = 0.5  # weight of single letters beside bigrams
CLEAN = 0.97  # weight of text as it stands before anything is learned
LEAST_CLEAN = 0.05  # and the least it can have
FLOOR = 2e-4  # weight of a cipher that a source has not shown
ENTER = (4.0, 9.0)  # nats that a text must gain to enter a cipher: by its weight, within these bounds
WORSE = -4.0  # a reading that loses more is none
STEADY = 5e-3  # weights that move less stand still
ODD = (4.0, 3.0)  # a run is unlikely beyond this many nats and so many for each letter


@lru_cache(maxsize=256)
def _bytes_of(page: str) -> dict[int, str | int]:
    """Letter -> byte (as a letter below 256) of a page; letters below 256 that it lacks map to U+FFFF."""
    table: dict[int, str | int] = {c: "\uffff" for c in range(128, 256)}
    for b in range(128, 256):
        try:
            letter = bytes([b]).decode(page)
        except UnicodeDecodeError:
            letter = chr(b)  # an undefined byte stays the control letter of its value
        table[ord(letter)] = chr(b)
    if page == "cp1252":  # ISO 8859-1 is read the same way but for its control letters
        for b in range(128, 160):
            table[b] = chr(b)
    return table


@lru_cache(maxsize=1)
def further_pages() -> tuple[str, ...]:
    """All other single-byte pages over ASCII that the codecs have, each once."""
    out, seen = [], {frozenset(_bytes_of(p).items()) for p in PAGES}
    for name in sorted(set(aliases.values()) - set(EAST_PAGES)):
        try:
            if bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
            high = 0
            for b in range(128, 256):
                try:
                    high += len(bytes([b]).decode(name)) == 1
                except UnicodeDecodeError:
                    pass
            if high < 64 or len(bytes([0xC3, 0xA4]).decode(name, "replace")) != 2:
                continue
        except (LookupError, UnicodeError, ValueError, AssertionError):
            continue
        table = frozenset(_bytes_of(name).items())
        if table not in seen and name != "latin_1":
            seen.add(table)
            out.append(name)
    return tuple(out)


@lru_cache(maxsize=64)
def table_of(step: tuple[str, ...]) -> dict[int, str | int]:
    """translate() table of a step: ("utf8", W) gives bytes as letters, (R, T) the true letters."""
    if step[0] == "utf8":
        return _bytes_of(step[1])
    read, true = step
    out: dict[int, str | int] = {}
    for letter, b in _bytes_of(read).items():
        try:
            out[letter] = "\uffff" if b == "\uffff" else bytes([ord(b)]).decode(true)
        except UnicodeDecodeError:
            out[letter] = "\uffff"
    return out


def undo(text: str, step: tuple[str, ...], tables: dict[str, dict[int, str]] | None = None) -> str | None:
    """``text`` before a step, or None if the step cannot have made it; ``tables`` has the learned pages by name."""
    try:
        if step[0] == "utf8" and step[1] in EAST_PAGES:
            return text.encode(step[1]).decode("utf-8")
        if step[0] == "utf8":
            own = (tables or {}).get(step[1]) or table_of(step)
            return text.translate(own).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return None
    letters = table_of(step)
    moved = text.translate(letters)
    return None if "\uffff" in moved or not all(ord(c) in letters for c in text if c > "\x7f") else moved


@lru_cache(maxsize=8)
def _roles(pages: tuple[str, ...]) -> tuple[dict[str, int], dict[str, int]]:
    """Letter -> set of pages (as bits) where it begins a UTF-8 sequence, and where it continues one."""
    lead: dict[str, int] = {}
    inner: dict[str, int] = {}
    for i, page in enumerate(pages):
        for letter, b in _bytes_of(page).items():
            if 0xC2 <= ord(b) <= 0xF4:
                lead[chr(letter)] = lead.get(chr(letter), 0) | 1 << i
            elif 0x80 <= ord(b) <= 0xBF:
                inner[chr(letter)] = inner.get(chr(letter), 0) | 1 << i
    return lead, inner


@lru_cache(maxsize=200_000)
def _east_pages(begin: str) -> tuple[str, ...]:
    """East Asian pages in which two letters can be the beginning of UTF-8 bytes."""
    out = []
    for page in EAST_PAGES:
        try:
            codecs.getincrementaldecoder("utf-8")().decode(begin.encode(page))
        except UnicodeError:
            continue
        out.append(page)
    return tuple(out)


def _is_east(text: str) -> bool:
    return text[0] >= "⺀" or "ᄀ" <= text[0] <= "ᇿ"


def _unread(text: str) -> Iterator[tuple[tuple[str, str], str]]:
    """(step, text before) of the pages that the text can be UTF-8 read as; further pages only where no common one fits."""
    if _is_east(text):
        for page in _east_pages(text[:2]):
            if (before := undo(text, ("utf8", page))) is not None and before != text:
                yield ("utf8", page), before
        return
    if len(text) < 2:
        return
    for pages in (PAGES, further_pages()):
        lead, inner = _roles(pages)
        fits, some = lead.get(text[0], 0) & inner.get(text[1], 0), False
        for i, page in enumerate(pages):
            if fits >> i & 1 and (before := undo(text, ("utf8", page))) is not None:
                some = True
                yield ("utf8", page), before
        if some:
            return


Cipher = tuple[tuple[str, ...], ...]


@lru_cache(maxsize=1 << 15)
def readings(run: str) -> list[tuple[str, list[Cipher]]]:
    """(text before, ciphers) of every text that UTF-8 read wrongly can have made the run of, however often that was repeated.

    Pages share letters, so several ciphers may lead to one text; all are named, as a stretch is
    undone by one cipher throughout.
    """
    out: dict[str, list[Cipher]] = {}
    frontier: dict[str, list[Cipher]] = {run: [()]} if len(run) > 1 or _is_east(run) else {}
    while frontier:
        after: dict[str, list[Cipher]] = {}
        for text, ciphers in frontier.items():
            for step, before in _unread(text):
                if before != run and before not in out:
                    after.setdefault(before, []).extend((*c, step) for c in ciphers)
        for text, ciphers in after.items():
            out.setdefault(text, []).extend(ciphers)
        frontier = {t: c for t, c in after.items() if not t.isascii()}
    return list(out.items())


@lru_cache(maxsize=1)
def _swaps() -> tuple[dict[str, int], list[int]]:
    """Letter -> the SWAPS (as bits) that can have made it, and the place of the page of each among PAGES."""
    fits = {chr(c): (1 << len(SWAPS)) - 1 for c in range(128)}
    for i, step in enumerate(SWAPS):
        for letter, before in table_of(step).items():
            if before != "\uffff":
                fits[chr(letter)] = fits.get(chr(letter), 0) | 1 << i
    return fits, [PAGES.index(read) for read, _ in SWAPS]


@lru_cache(maxsize=1 << 15)
def swapped(text: str) -> list[tuple[str, tuple[str, str]]]:
    """(text before, step) of the pairs of single-byte pages that can have made the text."""
    (letters, places), (lead, inner) = _swaps(), _roles(PAGES)
    fits = (1 << len(SWAPS)) - 1
    for c in text:
        if not (fits := fits & letters.get(c, 0)):
            return []
    # pages in which the text can begin as UTF-8
    begins = -1 if text[:1] < "\x80" else lead.get(text[0], 0) & inner.get(text[1], 0) if len(text) > 1 else 0
    out = []
    for i, step in enumerate(SWAPS):
        if fits >> i & 1 and (before := text.translate(table_of(step))) != text:
            # where the bytes are UTF-8 they were UTF-8
            if not begins >> places[i] & 1 or undo(text, ("utf8", step[0])) is None:
                out.append((before, step))
    return out


def contexts(text: str) -> list[str]:
    """Runs of a text with one letter on either side."""
    out, n = [], len(text)
    for m in RUN.finditer(text):
        a, b = m.span()
        out.append((text[a - 1] if a else "\n") + m[0] + (text[b] if b < n else "\n"))
    return out


def contexts_of(texts: list[str]) -> tuple[list[str], list[int]]:
    """The ``contexts`` of all texts one after the other, and where those of each text begin, with their number at the end."""
    joined = "\n".join(["", *texts, ""])  # a run at the bounds of a text stands beside a new line
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(codes > 127)
    east = EAST[codes[at]]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (east[1:] != east[:-1])
    first = np.flatnonzero(fresh)
    begin, last = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1]
    texts_begin = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
    return [joined[a - 1 : b + 2] for a, b in zip(begin.tolist(), last.tolist())], np.searchsorted(begin, texts_begin).tolist()


def _pieces(texts: list[str]) -> Iterator[slice]:
    """Parts of a list of texts with about CHUNK letters each."""
    begin = size = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= CHUNK:
            yield slice(begin, end)
            begin, size = end, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Parts of the rows whose last value is a text that is not ASCII."""
    some = [row for row in rows if row[-1] and not row[-1].isascii()]
    for piece in _pieces([row[-1] for row in some]):
        yield some[piece]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the number of the text of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))


def _counted(texts: list[str], n: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` by bigram and by letter with one behind it."""
    pairs, letters = np.zeros(BIGRAMS), np.zeros(LETTERS)
    for piece in _pieces(texts):
        codes, owner = _coded(texts[piece])
        inside = owner[:-1] == owner[1:]
        a, b, some = codes[:-1][inside], codes[1:][inside], np.array(n[piece], float)[owner[:-1][inside]]
        pairs += np.bincount(_bucket(a, b), some, BIGRAMS)
        letters += np.bincount(a & LETTERS - 1, some, LETTERS)
    return pairs, letters


def _bucket(a: int, b: int) -> int:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) >> 7 & BIGRAMS - 1


class Model:
    """Bigram likelihoods, the weights of ciphers per class of sources, and the pages learned for them."""

    def __init__(self, pairs: np.ndarray, letters: np.ndarray, weights: dict[int, dict[Cipher, float]], tables: dict[str, dict[int, str]] | None = None):
        self.pairs, self.letters, self.weights, self.tables = pairs, letters, weights, tables or {}
        self.total = float(letters.sum()) + 1.0
        # per pair its count, per letter its share, minus its log, and the log of what a pair with it is divided by
        share = (letters + 0.01) / self.total
        self._pair, self._share, self._rare, self._below = (array("d", x.tobytes()) for x in (pairs, 5.0 * share, -np.log(share), np.log(letters + 5.0)))
        self.kept: dict[str, dict[str, list]] = {}
        self.kept_forced: dict[tuple[str, Cipher], float] = {}

    def parts(self) -> tuple:
        return self.pairs, self.letters, self.weights, self.tables

    def likelihood(self, s: str) -> float:
        """Log likelihood of the letters of ``s`` after its first."""
        out, log, pair, share, below = 0.0, math.log, self._pair, self._share, self._below
        a = ord(s[0])
        for c in s[1:]:
            b = ord(c)
            if a < 128 and b < 128:  # only pairs with a letter beyond ASCII are counted
                a = b
                continue
            out += log(pair[((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) >> 7 & BIGRAMS - 1] + share[b & LETTERS - 1]) - below[a & LETTERS - 1]
            a = b
        return out

    def rarity(self, run: str) -> float:
        """Negative log probability of the letters by themselves."""
        return sum([self._rare[ord(c) & LETTERS - 1] for c in run])

    def likelihoods(self, texts: list[str]) -> list[float]:
        """The ``likelihood`` of each text."""
        out, pair, share, below = [], *(np.frombuffer(x) for x in (self._pair, self._share, self._below))
        for piece in _pieces(texts):
            codes, owner = _coded(texts[piece])
            a, b = codes[:-1], codes[1:]
            counted = np.flatnonzero((owner[:-1] == owner[1:]) & ((a > 127) | (b > 127)))
            a, b = a[counted], b[counted]
            own = pair[_bucket(a, b)] + share[b & LETTERS - 1]
            # the logarithms are those of the single texts to the last bit
            own = np.fromiter(map(math.log, own.tolist()), float, len(own)) - below[a & LETTERS - 1]
            out += np.bincount(owner[:-1][counted], own, len(texts[piece])).tolist()
        return out

    def rarities(self, runs: list[str]) -> list[float]:
        """The ``rarity`` of each run."""
        out, rare = [], np.frombuffer(self._rare)
        for piece in _pieces(runs):
            own = rare[_coded(runs[piece])[0] & LETTERS - 1].tolist()
            out += [sum(own[a:b]) for a, b in pairwise(accumulate(map(len, runs[piece]), initial=0))]
        return out

    def oddness(self, contexts: list[str]) -> list[float]:
        """How far beyond the bound for unlikely runs each run is, in nats."""
        runs = [c[1:-1] for c in contexts]
        return [-like + RARITY * rare - ODD[0] - ODD[1] * len(run) for like, rare, run in zip(self.likelihoods(contexts), self.rarities(runs), runs)]

    def gains(self, contexts: list[str], texts: list[str]) -> list[float]:
        """The ``gain`` of each context and text."""
        once = list(dict.fromkeys(contexts))
        like = dict(zip(once, self.likelihoods(once)))
        rare = dict(zip(once, self.rarities([c[1:-1] for c in once])))
        bare = [_PLAIN.sub("", t) for t in texts]
        after = self.likelihoods([c[0] + t + c[-1] for c, t in zip(contexts, texts)])
        return [now - like[c] + RARITY * (rare[c] / (len(c) - 2) * len(b) - own) for c, now, b, own in zip(contexts, after, bare, self.rarities(bare))]

    def gain(self, context: str, text: str) -> float:
        """Gain in log likelihood where a run is replaced by ``text``."""
        # garbled text keeps the order of letters and so makes bigrams of its own; but its letters are rarer
        run, bare = context[1:-1], _PLAIN.sub("", text)
        return self.likelihood(context[0] + text + context[-1]) - self.likelihood(context) + RARITY * (self.rarity(run) / len(run) * len(bare) - self.rarity(bare))

    def found(self, contexts: Iterable[str], page: str = "") -> dict[str, list[tuple[Cipher, str, float]]]:
        """(cipher, restored run, gain in log likelihood) of each run in its context, the best first; ``page`` is a learned page to try where no other fits."""
        kept = self.kept.setdefault(page, {})
        out = {c: kept.get(c) for c in contexts}
        fresh = [c for c, known in out.items() if known is None]
        if not fresh:
            return out
        read = [readings(c[1:-1]) for c in fresh]
        options = [list(r) for r in read]
        # a swap of pages is only in question where what it is to have made is unlikely
        bases = [(i, text, ciphers) for i, c in enumerate(fresh) for text, ciphers in [(c[1:-1], [()]), *read[i]] if text and not text.isascii() and not _is_east(text)]
        for (i, text, ciphers), odd in zip(bases, self.oddness([fresh[i][0] + text + fresh[i][-1] for i, text, _ in bases])):
            if odd > 0.0:
                options[i] += [(before, [(*c, step) for c in ciphers]) for before, step in swapped(text)]
        named: list[dict[str, list[Cipher]]] = [{} for _ in fresh]
        for own, some in zip(named, options):
            for text, ciphers in some:
                if text:
                    own.setdefault(text, []).extend(ciphers)
        tried = [(i, text) for i, own in enumerate(named) for text in own]
        found: list[list[tuple[Cipher, str, float]]] = [[] for _ in fresh]
        for (i, text), gain in zip(tried, self.gains([fresh[i] for i, _ in tried], [text for _, text in tried])):
            if gain > WORSE:
                found[i] += [(cipher, text, gain) for cipher in named[i][text]]
        for context, own in zip(fresh, found):
            if page and not own and (text := undo(context[1:-1], ("utf8", page), self.tables)):
                if (gain := self.gain(context, text)) > WORSE:
                    own.append(((("utf8", page),), text, gain))
            own.sort(key=lambda f: -f[2])
            out[context] = own
        if len(kept) + len(fresh) >= 200_000:
            kept.clear()
        kept.update(zip(fresh, found))
        return out

    def forced(self, context: str, cipher: Cipher) -> float:
        """Gain of undoing a run by a cipher however unlikely by itself; minus infinity if it cannot be undone."""
        known = self.kept_forced.get((context, cipher))
        if known is not None:
            return known
        text: str | None = context[1:-1]
        for step in cipher:
            text = undo(text, step, self.tables) if text else None
        gain = self.gain(context, text) if text else float("-inf")
        if len(self.kept_forced) >= 200_000:
            self.kept_forced.clear()
        self.kept_forced[(context, cipher)] = gain
        return gain

    def weight(self, source: int, cipher: Cipher) -> float:
        """Log weight of a cipher against text as it stands."""
        own = self.weights.get(source, {})
        return math.log(max(own.get(cipher, 0.0), FLOOR) / max(own.get((), CLEAN), LEAST_CLEAN))


_last: list = [None, None]


def _model(parts: tuple) -> Model:
    """The model that was sent, made once per worker and not once per task."""
    if _last[0] is not parts:
        _last[:] = parts, Model(*parts)
    return _last[1]


def page_name(source: int) -> str:
    """Name of the page learned for a class of sources."""
    return f"learned {source}"


def source_class(source: Column) -> Column:
    """One of 4,096 classes of sources by hash, -1 for null, so that what is learned per source is bounded."""
    return F.when(source.isNull(), -1).otherwise(F.pmod(F.xxhash64(source.cast("string")), F.lit(SOURCES))).cast("int")


def _arrow_rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def count_runs(documents: DataFrame) -> DataFrame:
    """(source, context, n): runs of non-ASCII letters of all texts, counted per class of sources."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, Counter] = {}
            for some in _chunks(zip(batch.column("source").to_pylist(), batch.column("text").to_pylist())):
                around, at = contexts_of([text for _, text in some])
                for (source, _), (a, b) in zip(some, pairwise(at)):
                    own.setdefault(source, Counter()).update(around[a:b])
            rows = [(s, c, n) for s, counts in own.items() for c, n in counts.items()]
            yield _arrow_rows(rows, ["source", "context", "n"], [pa.int32(), pa.string(), pa.int64()])

    counted = documents.select(source_class(F.col("source")).alias("source"), "text").mapInArrow(count, "source int, context string, n bigint")
    # by context, so that a task has the runs of all sources that read alike
    return counted.repartition("context").groupBy("source", "context").agg(F.sum("n").alias("n"))


def _filled(rows, kind: str, size: int) -> np.ndarray:
    """Sums of one kind as an array; ``rows`` is a frame of at most BIGRAMS + LETTERS rows and weights per class of sources."""
    out, own = np.zeros(size), rows[rows["kind"] == kind]
    np.add.at(out, own["key"].to_numpy("int64"), own["v"].to_numpy())
    return np.round(out, 6)  # the order of addition is not fixed


_SUMS = "kind string, key bigint, source int, cipher string, v double"
_SUM_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64()]


def _summed(df: DataFrame, step):
    return df.mapInArrow(step, _SUMS).groupBy("kind", "key", "source", "cipher").agg(F.sum("v").alias("v")).toPandas()


def learn(documents: DataFrame, rounds: int = 50) -> Model:
    """Bigrams, weights and pages by expectation-maximisation over the runs of all documents; stops when the weights stand still, after ``rounds`` at most."""
    runs = cut(count_runs(documents))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, letters, every = np.zeros(BIGRAMS), np.zeros(LETTERS), Counter()
        for batch in batches:
            n = batch.column("n").to_pylist()
            more = _counted(batch.column("context").to_pylist(), n)
            pairs, letters = pairs + more[0], letters + more[1]
            for source, k in zip(batch.column("source").to_pylist(), n):
                every[source] += k
        rows = [("pair", int(k), 0, "", float(pairs[k])) for k in np.flatnonzero(pairs)] + [("letter", int(k), 0, "", float(letters[k])) for k in np.flatnonzero(letters)]
        yield _arrow_rows(rows + [("all", 0, s, "", float(n)) for s, n in every.items()], ["kind", "key", "source", "cipher", "v"], _SUM_TYPES)

    base = _summed(runs, first)
    pairs0, letters0 = _filled(base, "pair", BIGRAMS), _filled(base, "letter", LETTERS)
    every = {int(s): float(v) for s, v in base[base["kind"] == "all"][["source", "v"]].itertuples(index=False)}
    model = Model(pairs0, letters0, {})
    open_ = cut(_open_runs(runs, model))
    for _ in range(rounds):
        model, moved = _round(open_.filter("readable"), model, pairs0, letters0, every)
        if moved < STEADY:
            break
    tables = learn_pages(open_, model)
    if tables:
        model = Model(model.pairs, model.letters, model.weights, tables)
        for _ in range(rounds):
            model, moved = _round(open_, model, pairs0, letters0, every)
            if moved < STEADY:
                break
    return model


def _open_runs(runs: DataFrame, model: Model) -> DataFrame:
    """(source, context, n, readable): runs that a known cipher can undo, and unlikely ones that none can; the others never change."""
    sent = runs.sparkSession.sparkContext.broadcast(model.parts())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = _model(sent.value), {}
        for batch in batches:
            rows = []
            columns = [batch.column(k).to_pylist() for k in ("source", "context", "n")]
            fresh = [c for c in dict.fromkeys(columns[1]) if c not in told]
            if len(told) + len(fresh) >= 200_000:
                told, fresh = {}, list(dict.fromkeys(columns[1]))
            # counts move away from garbled runs, which makes them less likely than they are now
            odd = [not _is_east(c[1:-1]) and far > -2.0 * (len(c) - 2) for c, far in zip(fresh, now.oddness(fresh))]
            before = [(c, text) for c, unlikely in zip(fresh, odd) for text, _ in (*readings(c[1:-1]), *(swapped(c[1:-1]) if unlikely else ())) if text]
            readable = {c for (c, _), gain in zip(before, now.gains([c for c, _ in before], [text for _, text in before])) if gain > 2.0 * WORSE}
            told.update((c, (c in readable, unlikely and len(c) > 3)) for c, unlikely in zip(fresh, odd))
            for source, context, n in zip(*columns):
                if any(told[context]):
                    rows.append((source, context, n, told[context][0]))
            yield _arrow_rows(rows, ["source", "context", "n", "readable"], [pa.int32(), pa.string(), pa.int64(), pa.bool_()])

    return runs.mapInArrow(keep, "source int, context string, n bigint, readable boolean")


def _round(open_: DataFrame, model: Model, pairs0: np.ndarray, letters0: np.ndarray, every: dict[int, float]) -> tuple[Model, float]:
    """One round of expectation and maximisation, and how far the weights moved."""
    sent = open_.sparkSession.sparkContext.broadcast(model.parts())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _model(sent.value)
        pairs, letters, weights = np.zeros(BIGRAMS), np.zeros(LETTERS), {}
        for batch in batches:
            rows, asked, moved, shares = [], {}, [], []
            for source, context, n in zip(*(batch.column(k).to_pylist() for k in ("source", "context", "n"))):
                page = page_name(source) if page_name(source) in now.tables else ""
                rows.append((source, context, n, page))
                asked.setdefault(page, []).append(context)
            known = {page: now.found(some, page) for page, some in asked.items()}
            for source, context, n, page in rows:
                found = known[page][context]
                if not found:
                    continue
                odds = [(c, t, math.exp(min(60.0, g + now.weight(source, c)))) for c, t, g in found]
                whole = 1.0 + sum(o for _, _, o in odds)
                gone = 1.0 - 1.0 / whole
                if gone < 0.02:  # too little to change a count
                    continue
                texts = {context: -n * gone}
                for cipher, text, o in odds:
                    share = n * o / whole
                    weights[source, cipher] = weights.get((source, cipher), 0.0) + share
                    text = context[0] + text + context[-1]
                    texts[text] = texts.get(text, 0.0) + share
                moved += texts
                shares += texts.values()
            more = _counted(moved, shares)
            pairs, letters = pairs + more[0], letters + more[1]
        rows = [("pair", int(k), 0, "", float(pairs[k])) for k in np.flatnonzero(pairs)] + [("letter", int(k), 0, "", float(letters[k])) for k in np.flatnonzero(letters)]
        rows += [("weight", 0, s, "|".join("/".join(x) for x in c), v) for (s, c), v in weights.items()]
        yield _arrow_rows(rows, ["kind", "key", "source", "cipher", "v"], _SUM_TYPES)

    got = _summed(open_, step)
    pairs, letters = np.maximum(pairs0 + _filled(got, "pair", BIGRAMS), 0.0), np.maximum(letters0 + _filled(got, "letter", LETTERS), 0.0)
    weights: dict[int, dict[Cipher, float]] = {s: {} for s in every}
    for source, cipher, v in got[got["kind"] == "weight"][["source", "cipher", "v"]].itertuples(index=False):
        weights[int(source)][tuple(tuple(s.split("/")) for s in cipher.split("|"))] = round(v / every[int(source)], 12)
    for own in weights.values():
        own[()] = max(LEAST_CLEAN, 1.0 - sum(own.values()))
    before = model.weights
    moved = max((abs(w - before.get(s, {}).get(c, 0.0)) for s, own in weights.items() for c, w in own.items() if c), default=0.0)
    return Model(pairs, letters, weights, model.tables), moved


# pages that are not known

INVENTORY = 256  # frequent letters that an unknown page may spell
LEADS = 6  # letters that may begin the sequences of one page
SURE = 0.6  # share of a letter's uses that its byte must have
STATE = 8.0  # nats to state one letter of a page


def learn_pages(open_: DataFrame, model: Model, rounds: int = 50) -> dict[str, dict[int, str]]:
    """Learned pages (letter -> byte) by name, of sources whose unexplained runs look like UTF-8 of one unknown page."""
    suspects = _suspects(open_)
    if suspects is None:
        return {}
    suspects = cut(suspects)
    codes = [k for k in np.argsort(-model.letters)[: 8 * INVENTORY] if k >= 0x80 and model.letters[k] > 0 and not 0xD800 <= k < 0xE000 and not _is_east(chr(k))][:INVENTORY]
    if not codes or suspects.isEmpty():
        return {}
    tables: dict[int, dict[str, np.ndarray]] = {}
    for _ in range(rounds):
        sent = open_.sparkSession.sparkContext.broadcast((model.parts(), codes, tables))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, letters, pages = sent.value
            speller = Speller(Model(*parts), letters)
            told: Counter = Counter()
            for batch in batches:
                for source, context, n in zip(*(batch.column(k).to_pylist() for k in ("source", "context", "n"))):
                    gain, uses = speller.expect(context, pages.get(source, {}))
                    for letter, shares in uses.items():
                        for b in np.flatnonzero(shares > 1e-4):
                            told[("use", ord(letter) << 8 | int(b) + 128, source, "")] += n * float(shares[b])
                    if uses:
                        told[("gain", 0, source, "")] += n * gain
            yield _arrow_rows([(*k, float(v)) for k, v in told.items()], ["kind", "key", "source", "cipher", "v"], _SUM_TYPES)

        got = _summed(suspects, step)
        fresh: dict[int, dict[str, np.ndarray]] = {}
        for source, key, v in got[got["kind"] == "use"][["source", "key", "v"]].itertuples(index=False):
            fresh.setdefault(int(source), {}).setdefault(chr(int(key) >> 8), np.zeros(128))[(int(key) & 255) - 128] += v
        moved = 0.0
        for source, own in fresh.items():
            for letter, uses in own.items():
                own[letter] = (uses + 0.01) / (uses.sum() + 1.28)
                moved = max(moved, float(np.abs(own[letter] - tables.get(source, {}).get(letter, np.full(128, 1 / 128))).max()))
        tables = fresh
        if moved < 0.01:
            break
    out = {}
    for source, gain in got[got["kind"] == "gain"][["source", "v"]].itertuples(index=False):
        page = {ord(letter): chr(128 + int(p.argmax())) for letter, p in tables[int(source)].items() if p.max() >= SURE}
        leads = [b for b in page.values() if b >= "\xc2"]
        # a page is worth stating if it explains several letters by several leads and continuations
        if len(page) - len(leads) >= 4 and leads and gain > STATE * len(page):
            out[page_name(int(source))] = {**{c: "\uffff" for c in range(128, 256)}, **page}
    return out


def _suspects(open_: DataFrame) -> DataFrame | None:
    """Unexplained runs of the classes of sources where at most LEADS letters begin nine in ten of them and hardly ever stand second."""
    left = open_.filter(~F.col("readable")).select("source", "context", "n", F.substring("context", 2, 1).alias("one"), F.substring("context", 3, 1).alias("two"))
    firsts = left.groupBy("source", "one").agg(F.sum("n").alias("n")).groupBy("source").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "one"))).alias("top"))
    leads = firsts.select("source", "all", F.slice("top", 1, LEADS).alias("top")).withColumn("held", -F.aggregate("top", F.lit(0).cast("bigint"), lambda t, x: t + x["neg"]))
    leads = cut(leads.filter("held >= 0.9 * all AND all >= 20").select(F.col("source").alias("s"), "all", F.transform("top", lambda x: x["one"]).alias("letters")))
    if leads.isEmpty():
        return None
    inside = left.join(leads, F.col("source") == F.col("s"))
    mixed = inside.groupBy("source", "all").agg(F.sum(F.when(F.array_contains("letters", F.col("two")), F.col("n")).otherwise(0)).alias("second")).filter("second <= 0.05 * all").select(F.col("source").alias("kept"))
    return inside.join(mixed, F.col("source") == F.col("kept"), "left_semi").select("source", "context", "n")


class Speller:
    """Expected bytes of the letters of a run, over all spellings of frequent letters."""

    def __init__(self, model: Model, codes: list[int]):
        self.model, self.codes = model, [int(c) for c in codes]
        self.bytes = [chr(c).encode("utf-8") for c in self.codes]
        self.sizes = np.array([len(b) for b in self.bytes])
        self.grid = np.array([[b[k] - 128 if k < len(b) else 0 for b in self.bytes] for k in range(4)])
        self.inner = np.array([[self._step(a, b) for b in self.codes] for a in self.codes])

    def _step(self, a: int, b: int) -> float:
        m = self.model
        return math.log(m._pair[_bucket(a, b)] + m._share[b & LETTERS - 1]) - m._below[a & LETTERS - 1]

    def expect(self, context: str, page: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """(gain against the run as it stands, letter -> expected uses of each byte) under the page so far."""
        run, n = context[1:-1], len(context) - 2
        flat = np.full(128, 1 / 128)
        odds = [np.log(page.get(c, flat)) for c in run]
        begin = np.array([self._step(ord(context[0]), c) for c in self.codes])
        close = np.array([self._step(c, ord(context[-1])) for c in self.codes])
        spell = {}
        for i in range(n):
            for size in (2, 3, 4):
                own = self.sizes == size
                if i + size <= n and own.any():
                    spell[i, size] = np.where(own, sum(odds[i + k][self.grid[k]] for k in range(size)), -np.inf)
        none = np.full(len(self.codes), -np.inf)
        ahead, back = [none] * (n + 1), [none] * (n + 1)  # of a letter that ends before i, and of what follows it
        for i in range(n):
            enter = begin if i == 0 else _sum_exp(ahead[i][:, None] + self.inner, 0) if np.isfinite(ahead[i]).any() else none
            for size in (2, 3, 4):
                if (i, size) in spell:
                    ahead[i + size] = np.logaddexp(ahead[i + size], enter + spell[i, size])
        whole = float(_sum_exp(ahead[n] + close, 0)) if np.isfinite(ahead[n]).any() else float("-inf")
        if not math.isfinite(whole):
            return 0.0, {}
        back[n] = close
        uses = {c: np.zeros(128) for c in run}
        for i in range(n - 1, -1, -1):
            ways = none
            for size in (2, 3, 4):
                if (i, size) in spell and np.isfinite(back[i + size]).any():
                    rest = spell[i, size] + back[i + size]
                    ways = np.logaddexp(ways, rest)
                    enter = begin if i == 0 else _sum_exp(ahead[i][:, None] + self.inner, 0) if np.isfinite(ahead[i]).any() else none
                    share = np.exp(np.minimum(0.0, enter + rest - whole))
                    for k in range(size):
                        np.add.at(uses[run[i + k]], self.grid[k], np.where(self.sizes == size, share, 0.0))
            if i and np.isfinite(ways).any():
                back[i] = _sum_exp(self.inner + ways[None, :], 1)
        m = self.model
        return whole - m.likelihood(context), uses


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top, axis=axis)


_QUOTES = ('"', "'", "`")


def restore(text: str | None, source: int, model: Model, around: list[str] | None = None) -> str | None:
    """The original of an affected text, "" if it is lost, None if the text is not affected; ``around`` are its ``contexts`` where they are known."""
    if not text or text.isascii():
        return None
    around = contexts(text) if around is None else around
    if "�" in text and any("�" in c and not (c[0] in _QUOTES and c[-1] in _QUOTES) for c in around):
        return ""
    page = page_name(source) if page_name(source) in model.tables else ""
    known = model.found(around, page)
    found = [known[c] for c in around]
    if not any(f and f[0][2] > 0 for f in found):
        return None
    hope: dict[tuple, float] = {}
    for options in found:
        for cipher, _, gain in options:
            if gain > 0:
                hope[cipher] = hope.get(cipher, 0.0) + gain
    enter = {c: min(ENTER[1], max(ENTER[0], -model.weight(source, c))) for c in hope}
    states = [c for c, gain in hope.items() if gain > enter[c]]
    if len(states) > 1:
        # of ciphers that read all runs alike the source's most frequent one stands for all
        reads: dict[Cipher, list] = {c: [] for c in states}
        for i, options in enumerate(found):
            for cipher, run, _ in options:
                if cipher in reads:
                    reads[cipher].append((i, run))
        alike: dict[tuple, Cipher] = {}
        for c in states:
            key = tuple(reads[c])
            if key not in alike or enter[c] < enter[alike[key]]:
                alike[key] = c
        states = list(alike.values())
    if not states:
        return None
    # best path: text as it stands (-1) scores 0; entering a cipher costs, leaving is free
    none = float("-inf")
    costs, closed, told = [enter[c] for c in states], [none] * len(states), {}
    clean, score, back = 0.0, closed, []
    for context, options in zip(around, found):
        if (gains := told.get(context)) is None:
            own = {c: g for c, _, g in options}
            gains = told[context] = [own[c] if c in own else model.forced(context, c) for c in states]
        best = max(score)
        top, best = (-1, clean) if clean >= best else (score.index(best), best)
        if gains == closed:  # no cipher can have made the run
            score, came = closed, None
        else:
            now, came = [], []
            for k, gain in enumerate(gains):
                stay, switch = score[k], best - costs[k]
                came.append(k if stay >= switch else top)
                now.append((stay if stay >= switch else switch) + gain)
            score = now
        back.append((came, top))
        clean = best
    best = max(score)
    state = -1 if clean >= best else score.index(best)
    path: list[tuple] = []
    for came, top in reversed(back):
        path.append(() if state < 0 else states[state])
        state = top if state < 0 else came[state]
    path.reverse()
    if not any(path):
        return None
    spans = [m.span() for m in RUN.finditer(text)]
    _keep_quoted(text, spans, path)
    if not any(path):
        return None
    out, at = [], 0
    for (a, b), cipher in zip(spans, path):
        if cipher:
            run = text[a:b]
            for s in cipher:
                run = undo(run, s, model.tables) or run
            out += [text[at:a], run]
            at = b
    out.append(text[at:])
    return "".join(out)


def _keep_quoted(text: str, spans: list[tuple[int, int]], path: list[tuple]) -> None:
    """Lines whose garbled runs all stand in quotation marks speak of them: undo one step less, in place."""
    by_line: dict[int, list[int]] = {}
    line, at = 0, 0
    for i, (a, b) in enumerate(spans):
        line += text.count("\n", at, a)
        at = a
        if path[i]:
            by_line.setdefault(line, []).append(i)
    n = len(text)
    for rows in by_line.values():
        quoted = {i: 0 < spans[i][0] and spans[i][1] < n and text[spans[i][0] - 1] in _QUOTES and text[spans[i][1]] in _QUOTES for i in rows}
        if not any(quoted.values()):
            continue
        plain = [len(path[i]) for i in rows if not quoted[i]]
        depths = {len(path[i]) for i in rows}
        keep = max(plain) if plain else (min(depths) - 1 if len(depths) == 1 else min(depths))
        for i in rows:
            if quoted[i] and len(path[i]) > keep:
                path[i] = path[i][:keep]


def restored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, restored) of affected documents; "" where the original is lost."""
    sent = documents.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(sent.value)
        for batch in batches:
            rows = []
            for some in _chunks(zip(*(batch.column(k).to_pylist() for k in ("doc_id", "source", "text")))):
                around, at = contexts_of([text for _, _, text in some])
                pages = [page_name(source) if page_name(source) in own.tables else "" for _, source, _ in some]
                # most texts have no run that gains and no letter that was lost
                better = {}
                for page in set(pages):
                    asked = set(around) if len(own.tables) == 0 else {c for p, (a, b) in zip(pages, pairwise(at)) if p == page for c in around[a:b]}
                    better[page] = {c for c, found in own.found(asked, page).items() if found and found[0][2] > 0}
                for (doc, source, text), page, (a, b) in zip(some, pages, pairwise(at)):
                    if "\ufffd" not in text and better[page].isdisjoint(around[a:b]):
                        continue
                    original = restore(text, source, own, around[a:b])
                    if original is not None:
                        rows.append((doc, original))
            yield _arrow_rows(rows, ["doc_id", "restored"], [pa.int64(), pa.string()])

    return documents.select("doc_id", "text", source_class(F.col("source")).alias("source")).mapInArrow(run, "doc_id bigint, restored string")


def digest(restored_text: str) -> str:
    """SHA-256 of a restored text, "" for a lost one."""
    return hashlib.sha256(restored_text.encode("utf-8", "surrogatepass")).hexdigest() if restored_text else ""


def affected(documents: DataFrame, rounds: int = 50) -> DataFrame:
    """(doc_id, restored_sha256) of every affected document of ``documents`` (doc_id, text, source)."""
    model = learn(documents, rounds)
    return restored(documents, model).select("doc_id", F.when(F.col("restored") != "", F.sha2("restored", 256)).otherwise("").alias("restored_sha256"))
