"""Records that differ in formatting only, collapsed with their number of copies.

Canonical text of a field: Unicode NFC, case folded, letters and decimal digits only; the order of the fields in the line
plays no part, an absent, null or empty value is the same. Lines that are null, blank, cut off or no JSON object are
no records.

Progressive partition refinement over rows that are parsed once and written out: first a cheap key, the stripped length of every
field and the histogram of the record's letters and digits; lines whose class has one member are done. Only lines of
classes with several members get the digest of the canonical record and are grouped by it.

Both counts are map-side combined. Parsing and canonical text stay in the JVM for lines that are flat
objects of plain scalars and whose letters are ASCII; the others (escaped or accented letters, nested values, numbers
with a fraction, very long lines) are read by Python, by the same rules.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.session import cut

FIELDS = ("filename_stem", "extension", "normalized_filename", "size")


def _plain(value: object) -> str:
    """Canonical text of one value."""
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    if text.isascii():
        return "".join(filter(str.isalnum, text.lower()))
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(c for c in text if c.isalpha() or c.isdecimal())


def canonical(line: str | None, fields: tuple[str, ...] = FIELDS) -> list[str] | None:
    """Canonical values in the order of ``fields``; None if the line is no record."""
    if not line:
        return None
    try:
        record = json.loads(line, parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, RecursionError):
        return None
    return [_plain(record.get(f)) for f in fields] if isinstance(record, dict) else None


LONGEST = 8192  # characters of a line that the JVM's pattern reads; longer ones go to Python
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\["\\/bfnrt][^"\\\x00-\x1f]*+)*+"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9]\d*+)|true|false|null)"
_PAIR = rf"\s*+{_STRING}\s*+:\s*+{_SCALAR}\s*+"
#: A flat object of strings without \u escapes, whole numbers, true, false and null, which every parser reads alike.
FLAT = rf"^[ \t\r\n]*+\{{(?:{_PAIR}(?:,{_PAIR})*+|[ \t\r\n]*+)\}}[ \t\r\n]*+$".replace(r"\s*+", r"[ \t\r\n]*+")


def _canonical_rows(lines: DataFrame, line_id: str, line: str, fields: tuple[str, ...]) -> DataFrame:
    """(__id, __text): canonical fields of every line as one text, null where the line is no record."""

    @F.arrow_udf("array<string>")
    def by_python(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if text is None else canonical(text, fields) for text in batch.to_pylist()], pa.list_(pa.string()))

    rows = lines.select(F.col(line_id).alias("__id"), F.col(line).cast("string").alias("__line"))
    flat = F.coalesce((F.length("__line") <= LONGEST) & F.col("__line").rlike(FLAT), F.lit(False))
    names = [f"f{i}" for i in range(len(fields))]
    schema = ", ".join("`" + f.replace("`", "``") + "` string" for f in fields)
    read = F.when(flat, F.from_json("__line", schema, {"allowSingleQuotes": "false"}))
    bare = [F.lower(F.regexp_replace(F.coalesce(F.col("__read").getField(f), F.lit("")), r"[^\p{L}\p{M}\p{Nd}\p{Cn}]", "")) for f in fields]
    rows = rows.withColumn("__read", read).select("__id", "__line", F.col("__read").isNotNull().alias("__flat"), *[c.alias(n) for c, n in zip(bare, names)])
    # marks compose and letters beyond ASCII fold in ways that the JVM does not know, and some characters are newer than it is
    plain = F.col("__flat") & F.concat(*names).rlike(r"^\p{ASCII}*+$")
    rows = rows.select("__id", plain.alias("__plain"), F.array(*names).alias("__own"), F.when(~plain, F.col("__line")).alias("__hard"))
    rows = rows.withColumn("__other", by_python.asNondeterministic()("__hard"))
    return rows.select("__id", F.when(F.col("__plain"), F.col("__own")).otherwise(F.col("__other")).alias("__text"))


def _histogram(text: Column) -> Column:
    """One number for how often each character occurs: the sum of the characters' hashes, whatever their order."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda total, c: total + F.shiftright(F.xxhash64(c), 24))


def _records(lines: DataFrame, line_id: str, line: str, fields: tuple[str, ...], single: bool) -> DataFrame:
    """(first_line_id, n_copies) of the records with several lines, and of single ones if wanted."""
    keyed = _canonical_rows(lines, line_id, line, fields).filter(F.col("__text").isNotNull())
    lengths = [F.length(F.col("__text")[i]) for i in range(len(fields))]
    keyed = cut(keyed.withColumn("__cheap", F.xxhash64(*lengths, _histogram(F.concat_ws("", "__text")))))
    count = [F.min("__id").alias("first_line_id"), F.count(F.lit(1)).alias("n_copies")]
    classes = keyed.groupBy("__cheap").agg(*count)
    several = classes.filter("n_copies > 1").select(F.col("__cheap").alias("__class"))
    refined = keyed.join(several, F.col("__cheap") == F.col("__class"), "left_semi")
    # canonical fields hold no separators, so joined by one they are as distinct as the record
    out = refined.groupBy(F.sha2(F.concat_ws("\x1f", "__text"), 256).alias("__digest")).agg(*count).select("first_line_id", "n_copies")
    if single:
        out = out.unionByName(classes.filter("n_copies = 1").select("first_line_id", "n_copies"))
    return out


def copies(lines: DataFrame, line_id: str = "line_id", line: str = "line", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(first_line_id, n_copies) of every record that occurs at least twice.

    Null ids are not expected; repeated rows of one id count as copies. An empty table gives an
    empty result.
    """
    return _records(lines, line_id, line, fields, False).filter("n_copies > 1")


def distinct_records(lines: DataFrame, line_id: str = "line_id", line: str = "line", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(first_line_id, n_copies) of every record, single ones included."""
    return _records(lines, line_id, line, fields, True)
