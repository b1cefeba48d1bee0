"""Queries of ingestion, text functions and path operators, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import text as T
from estatelens.operators import ingest as I
from estatelens.session import table

_LISTING_SQL = r"""listing AS (
  SELECT row_id, CASE WHEN row_id % 97 = 0 THEN NULL WHEN row_id % 89 = 0 THEN '0' WHEN row_id % 83 = 0 THEN full_path || chr(92)
                      WHEN row_id % 53 = 0 THEN full_path || chr(92) || 'Thumbs.db' WHEN row_id % 59 = 0 THEN full_path || chr(92) || '~$note.docx'
                      WHEN row_id % 61 = 0 THEN full_path || '.bak' ELSE full_path END AS full_path,
         CASE WHEN row_id % 71 = 0 THEN 2 ELSE 0 END AS folder_count, size, owner, source_system FROM classified_files)"""


def listing(spark: SparkSession, d: str) -> DataFrame:
    """A raw listing of the whole classified_files table in which some rows are made into null paths, folders and system files."""
    r, p = F.col("row_id"), F.col("full_path")
    made = (
        F.when(r % 97 == 0, F.lit(None)).when(r % 89 == 0, "0").when(r % 83 == 0, F.concat(p, F.lit("\\"))).when(r % 53 == 0, F.concat(p, F.lit("\\Thumbs.db"))).when(r % 59 == 0, F.concat(p, F.lit("\\~$note.docx"))).when(r % 61 == 0, F.concat(p, F.lit(".bak"))).otherwise(p)
    )
    return table(spark, d, "classified_files").select("row_id", made.alias("full_path"), F.when(r % 71 == 0, 2).otherwise(0).alias("folder_count"), "size", "owner", "source_system")


_REASON_SQL = r"""tagged AS (
  SELECT *, string_split(full_path, chr(92))[-1] AS fname,
    (full_path IS NULL OR trim(full_path) = '' OR trim(full_path) = 'nan' OR NOT (contains(full_path, chr(92)) OR contains(full_path, '/'))) AS is_null,
    (ends_with(rtrim(full_path), chr(92)) OR folder_count > 0) AS is_folder FROM listing),
ruled AS (
  SELECT *, lower(fname) IN ('thumbs.db', 'desktop.ini', '.ds_store') AS r1, starts_with(fname, '~$') AS r2, string_split(lower(fname), '.')[-1] IN ('tmp', 'bak') AS r3 FROM tagged),
reasoned AS (
  SELECT *, CASE WHEN is_null THEN 'null_path' WHEN is_folder THEN 'folder_row' WHEN r1 OR r2 OR r3 THEN 'system_file' END AS removal_reason FROM ruled)"""
_PARTS_SQL = r"""parts AS (SELECT *, list_filter(string_split(replace(full_path, '/', chr(92)), chr(92)), lambda x: x <> '') AS p FROM kept),
named AS (SELECT *, p[-1] AS nm, p[1:len(p)-1] AS segments FROM parts),
split AS (SELECT *, (NOT contains(nm, '.') OR (starts_with(nm, '.') AND length(nm) - length(replace(nm, '.', '')) = 1)) AS plain, string_split(nm, '.')[-1] AS ext0 FROM named)"""


def f_filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay."""
    return I.apply_filters(listing(spark, d)).select("row_id", "full_path")


def f4_audit(spark: SparkSession, d: str) -> DataFrame:
    return I.filter_audit(listing(spark, d))


def f_reasons(spark: SparkSession, d: str) -> DataFrame:
    return I.tag_removals(listing(spark, d)).select("row_id", "removal_reason", "rule_filenames", "rule_prefixes", "rule_extensions")


def n1_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_paths").select("path_id", T.nfc(F.col("filename_stem")).alias("stem"))


def n3_owner(spark: SparkSession, d: str) -> DataFrame:
    o = I.clean_owner(F.col("owner"))
    return table(spark, d, "classified_files").select("row_id", o.alias("owner"), I.is_sid(o).alias("is_sid"))


def n4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Decomposed paths."""
    df = I.decompose_paths(table(spark, d, "classified_files").select("row_id", "full_path"))
    return df.select("row_id", "relative_path", F.array_join("segments", "|").alias("folders"), "filename_stem", "extension", "depth", I.filename(F.col("filename_stem"), F.col("extension")).alias("filename"))


def n4_root(spark: SparkSession, d: str) -> DataFrame:
    """N4 with a root that only some estates have."""
    df = I.decompose_paths(table(spark, d, "classified_files").select("row_id", "full_path"), "//FS-Quillmere/data")
    return df.select("row_id", "relative_path", "depth")


def n7_depth(spark: SparkSession, d: str) -> DataFrame:
    return I.depth_stats(I.decompose_paths(table(spark, d, "classified_files").select("full_path")))


def n7_distribution(spark: SparkSession, d: str) -> DataFrame:
    return I.depth_distribution(I.decompose_paths(table(spark, d, "classified_files").select("full_path")))


def proj4_file_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_files").select("row_id", I.file_id(F.col("full_path")).alias("fid"))


def proj7_folder_paths(spark: SparkSession, d: str) -> DataFrame:
    """Folder key of two levels, display path and level columns."""
    df = I.level_columns(table(spark, d, "classified_files").select("row_id", "segments"), 3)
    return df.select("row_id", I.folder_key(F.col("segments"), 2).alias("two"), I.display_path(F.col("segments")).alias("above"), "level_1", "level_2", "level_3")


def t1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_files").select("row_id", F.array_join(T.tokenise(F.col("filename_stem")), "|").alias("tokens"))


def t3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokenise(F.col("filename_stem"))
    return table(spark, d, "classified_files").select("row_id", F.array_join(T.ngrams(t, 2), "|").alias("bigrams"), F.size(T.all_ngrams(t)).alias("n_phrases"))


def t4_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_files").select("row_id", F.array_join(F.array_sort(T.char_trigrams(F.lower("entity_plot"))), "|").alias("grams"))


def t5_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Stem against normalised filename."""
    a, b = T.char_trigrams(F.lower("filename_stem")), T.char_trigrams(F.lower("normalized_filename"))
    return table(spark, d, "classified_files").select("row_id", T.jaccard(a, b).alias("jaccard"), T.overlap_coefficient(a, b).alias("overlap"))


def t9_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_files").select("row_id", T.normalise_value(F.col("entity_address")).alias("v"))


def t11_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_files").select("row_id", T.purge_dates(_noted("filename_stem")).alias("v"))


def t13_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "address_rows").select("addr_id", T.post_process(F.col("entity_address")).alias("v"))


def t14_numeric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified_files").select("row_id", T.has_digit(F.col("filename_stem")).alias("has_digit"))


def t18_sizes(spark: SparkSession, d: str) -> DataFrame:
    """T16, T18."""
    return table(spark, d, "classified_files").select("row_id", T.normalise_size(F.col("size")).alias("size_number"), T.normalise_size(F.col("owner")).alias("owner_number"))


def f6_noise(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "classified_files").select(F.explode(T.tokenise(F.col("filename_stem"))).alias("token")).distinct()
    return tokens.select("token", T.is_noise_token(F.col("token"), ("the", "and", "for", "copy")).alias("noise"))


def o1_union(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2: estates united by name, one row per path."""
    a = table(spark, d, "classified_files").select("source_system", "filename_stem", "depth")
    b = table(spark, d, "file_paths").select("filename_stem", "source_system", "depth")
    return a.unionByName(b).distinct()


def o3_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.tokenise(F.col("filename_stem")), T.tokenise(F.col("normalized_filename"))
    return table(spark, d, "classified_files").select("row_id", F.array_join(F.array_sort(F.array_except(a, b)), "|").alias("only_stem"), F.array_join(F.array_sort(F.array_intersect(a, b)), "|").alias("both"))


def n2_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in several notations, null where none fits."""
    at, r = F.col("scanned_at"), F.col("row_id") % 4
    text = F.when(r == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(r == 1, F.date_format(at, "dd/MM/yyyy HH:mm")).when(r == 2, F.date_format(at, "yyyy-MM-dd")).otherwise("no date")
    return table(spark, d, "classified_files").select("row_id", F.date_format(I.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


def t10_noise(spark: SparkSession, d: str) -> DataFrame:
    """Names with notes of many kinds."""
    return table(spark, d, "classified_files").select("row_id", T.strip_scheme_noise(_noted("entity_scheme")).alias("v"))


def t12_postcodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "address_rows").select("addr_id", T.postcode(F.col("entity_address")).alias("postcode"))


def t16_human(spark: SparkSession, d: str) -> DataFrame:
    """Sizes for people and clamped confidences."""
    return table(spark, d, "classified_files").select("row_id", T.human_size((F.col("size") / 1024).cast("bigint") * 1024).alias("size_text"), T.clamp(F.col("overall_confidence") * 1.5 - 0.2).alias("clamped"))


def s7_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Records of JSON lines by schema; lines that are no object are null."""
    r = F.from_json("line", "filename_stem string, extension string, normalized_filename string, size string")
    return table(spark, d, "jsonl_lines").select("line_id", r.alias("r")).select("line_id", "r.filename_stem", "r.extension", "r.normalized_filename", "r.size")


def s8_paths(spark: SparkSession, d: str) -> DataFrame:
    """Valid paths of a raw list and distinct lower-case names of at least four letters."""
    p = F.col("full_path")
    names = table(spark, d, "classified_files").filter(~I.is_null_path(p)).select(F.explode("segments").alias("name"))
    return names.select(F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= 4).distinct()


_TOK = r"list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '[_ \t\r\n\f\v]+'), lambda x: trim(x, '()[]{{}}.,;:''\"!?#')), lambda x: x <> '')"
_TRI = "CASE WHEN length(coalesce({c}, '')) > 0 THEN list_distinct(list_transform(range(1, length({c}) + 3), lambda i: substring('$$' || {c} || '$$', i, 3))) ELSE [] END"
# written from the operators' definition, independently of the patterns of the library
_MONTH_SHORT = "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
_MONTH_LONG = "(january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sept|sep|october|oct|november|nov|december|dec)"


def _without(c: str, *patterns: str) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '(?i){p}', '', 'g')"
    return c


_DATES_SQL = _without("c", rf"\b\d\d?\s+{_MONTH_SHORT}\s+\d{{2,4}}\b", rf"\b{_MONTH_SHORT}\s+\d\d\d\d\b", r"\(\d\d\d\d[-–]\d\d\d\d\)", r"\b\d\d\d\d[-–]\d\d\d\d\b", r"\b\d\d?[./]\d\d?[./]\d{2,4}\b", r"\b\d\d\d\d\d\d\b")
_NOISE_SQL = _without(
    "c", rf"\bnew\s+(file\b[\s-]*|scheme\b|{_MONTH_LONG}(\s+\d{{2,4}})?)", r"\b(phase|ph\.|ph)\s*(\d+(\s*&\s*\d+)*|one|two|three|four|five|six|seven|eight|nine|ten)\b", rf"\b\d\d?\s+{_MONTH_LONG}\s+\d{{2,4}}\b", rf"\b{_MONTH_LONG}\s+\d{{2,4}}\b", r"\b\d\d\d\d\s*-\s*\d\d\d\d\b", r"\b(19|20)\d\d\b",
)
# notes and dates of many kinds, one for each row
_NOTES = (
    "may street", "march house", "3 may close", "april cottages phase two", "phase 1a liberty park", "1500-1600 mill lane", "2015–2016 barn", "1200-1300 wall", "(2015-16) yard", "2015 - 2016 hill", "3rd may 21", "12 May 2019 (2019-2020)", "1.2.21 160219 March 2020",
    "phase 4 & 5 park", "Ph.2 new file - 11 May 21", "new scheme", "new dec 20", "PHASE TEN", "11 may 21", "Sept 2021", "sep 21", "1999 2101", "phase two2 x", "31/12/1999", "1/2/3 1.22.333", "newfile new filex", "(1999–2001)", "june 5 july 12345", "2020-2021-2022", "ph 3&4 & 5",
)
_NOTE_SQL = "[" + ", ".join(f"'{n}'" for n in _NOTES) + "][row_id % " + str(len(_NOTES)) + " + 1]"


def _noted(c: str) -> Column:
    """A column with a note behind it; which one depends on the row."""
    return F.concat_ws(" ", c, F.element_at(F.array(*[F.lit(n) for n in _NOTES]), (F.col("row_id") % len(_NOTES) + 1).cast("int")))


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"([fntos]|proj)\d+_|f_", k)}

SQL = {
    "f_filters": f"WITH {_LISTING_SQL}, {_REASON_SQL} SELECT row_id, full_path FROM reasoned WHERE removal_reason IS NULL",
    "f4_audit": f"""WITH {_LISTING_SQL}, {_REASON_SQL}
        SELECT count(*) AS initial, count(*) FILTER (removal_reason = 'null_path') AS null_paths, count(*) FILTER (removal_reason = 'folder_row') AS folder_rows,
          count(*) FILTER (removal_reason = 'system_file') AS system_files, count(*) FILTER (removal_reason IS NULL) AS final,
          count(*) FILTER (coalesce(removal_reason, 'system_file') = 'system_file' AND r1) AS rule_filenames, count(*) FILTER (coalesce(removal_reason, 'system_file') = 'system_file' AND r2) AS rule_prefixes,
          count(*) FILTER (coalesce(removal_reason, 'system_file') = 'system_file' AND r3) AS rule_extensions FROM reasoned""",
    "f_reasons": f"""WITH {_LISTING_SQL}, {_REASON_SQL} SELECT row_id, removal_reason, coalesce(removal_reason, 'system_file') = 'system_file' AND coalesce(r1, false) AS rule_filenames,
        coalesce(removal_reason, 'system_file') = 'system_file' AND coalesce(r2, false) AS rule_prefixes, coalesce(removal_reason, 'system_file') = 'system_file' AND coalesce(r3, false) AS rule_extensions FROM reasoned""",
    "n1_nfc": "SELECT path_id, nfc_normalize(filename_stem) AS stem FROM file_paths",
    "n3_owner": "SELECT row_id, CASE WHEN trim(coalesce(owner, '')) = 'nan' THEN '' ELSE trim(coalesce(owner, '')) END AS owner, starts_with(trim(coalesce(owner, '')), 'S-1-5-') AS is_sid FROM classified_files",
    "n4_paths": f"""WITH kept AS (SELECT row_id, full_path FROM classified_files), {_PARTS_SQL}
        SELECT row_id, array_to_string(p, chr(92)) AS relative_path, coalesce(array_to_string(segments, '|'), '') AS folders, CASE WHEN plain THEN nm ELSE left(nm, length(nm) - length(ext0) - 1) END AS filename_stem,
          CASE WHEN plain THEN '' ELSE lower(ext0) END AS extension, CAST(len(segments) AS INT) AS depth, CASE WHEN plain THEN nm ELSE left(nm, length(nm) - length(ext0)) || lower(ext0) END AS filename FROM split""",
    "n4_root": r"""WITH parts AS (SELECT row_id, list_filter(string_split(replace(full_path, '/', chr(92)), chr(92)), lambda x: x <> '') AS p FROM classified_files),
        rest AS (SELECT row_id, CASE WHEN lower(p[1]) = 'fs-quillmere' AND lower(p[2]) = 'data' THEN p[3:] ELSE p END AS r FROM parts)
        SELECT row_id, coalesce(array_to_string(r, chr(92)), '') AS relative_path, CAST(greatest(len(r) - 1, 0) AS INT) AS depth FROM rest""",
    "n7_depth": f"""WITH kept AS (SELECT full_path FROM classified_files), {_PARTS_SQL}
        SELECT count(*) AS n_files, median(len(segments)) AS median_depth, CAST(max(len(segments)) AS INT) AS max_depth, count(*) FILTER (len(segments) = 0) AS root_level, count(*) FILTER (plain OR ext0 = '') AS no_extension FROM split""",
    "n7_distribution": f"WITH kept AS (SELECT full_path FROM classified_files), {_PARTS_SQL} SELECT CAST(len(segments) AS INT) AS depth, count(*) AS n_files FROM split GROUP BY 1",
    "proj4_file_id": "SELECT row_id, left(sha256(full_path), 16) AS fid FROM classified_files",
    "proj7_folder_paths": """SELECT row_id, coalesce(array_to_string(segments[1:2], chr(92)), '') AS two, CASE WHEN len(segments) >= 2 THEN array_to_string(segments[1:len(segments)-1], chr(92)) ELSE '' END AS above,
        coalesce(segments[1], '') AS level_1, coalesce(segments[2], '') AS level_2, coalesce(segments[3], '') AS level_3 FROM classified_files""",
    "t1_tokens": f"SELECT row_id, coalesce(array_to_string({_TOK.format(c='filename_stem')}, '|'), '') AS tokens FROM classified_files",
    "t3_ngrams": f"""WITH t AS (SELECT row_id, {_TOK.format(c='filename_stem')} AS k FROM classified_files)
        SELECT row_id, coalesce(array_to_string(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), '|'), '') AS bigrams,
          CAST(len(k) + greatest(len(k) - 1, 0) + greatest(len(k) - 2, 0) + greatest(len(k) - 3, 0) AS INT) AS n_phrases FROM t""",
    "t4_trigrams": f"SELECT row_id, coalesce(array_to_string(list_sort({_TRI.format(c='lower(entity_plot)')}), '|'), '') AS grams FROM classified_files",
    "t5_similarity": f"""WITH g AS (SELECT row_id, {_TRI.format(c='lower(filename_stem)')} AS a, {_TRI.format(c='lower(normalized_filename)')} AS b FROM classified_files),
        s AS (SELECT *, len(list_intersect(a, b)) AS i FROM g)
        SELECT row_id, CASE WHEN len(a) + len(b) - i > 0 THEN i / (len(a) + len(b) - i) ELSE 0.0 END AS jaccard, CASE WHEN least(len(a), len(b)) > 0 THEN i / least(len(a), len(b)) ELSE 0.0 END AS overlap FROM s""",
    "t9_values": r"SELECT row_id, trim(regexp_replace(translate(lower(entity_address), '`()[]{},;:''\"!?#@*/' || chr(92), ''), '[ \t\r\n]+', ' ', 'g')) AS v FROM classified_files",
    "t11_dates": f"WITH x AS (SELECT row_id, concat_ws(' ', filename_stem, {_NOTE_SQL}) AS c FROM classified_files) SELECT row_id, trim(regexp_replace({_DATES_SQL}, '\\s+', ' ', 'g')) AS v FROM x",
    "t13_words": r"SELECT addr_id, CASE WHEN entity_address IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(lower(entity_address), '\s+'), lambda x: trim(x, '.,;:''\"!?#()[]{}/')), lambda x: x <> ''), ' '), '') END AS v FROM address_rows",
    "t14_numeric": r"SELECT row_id, regexp_matches(filename_stem, '\d') AS has_digit FROM classified_files",
    "t18_sizes": "SELECT row_id, coalesce(size, -1) AS size_number, coalesce(try_cast(try_cast(owner AS DOUBLE) AS BIGINT), -1) AS owner_number FROM classified_files",
    "f6_noise": rf"""WITH t AS (SELECT DISTINCT unnest({_TOK.format(c='filename_stem')}) AS token FROM classified_files)
        SELECT token, length(token) <= 1 OR token IN ('the', 'and', 'for', 'copy') OR regexp_full_match(token, '\d+') OR regexp_full_match(token, '[vr]\d+')
          OR (length(token) >= 4 AND length(regexp_replace(token, '\D', '', 'g')) / length(token) > 0.6) AS noise FROM t""",
    "n2_dates": "SELECT row_id, CASE row_id % 4 WHEN 0 THEN strftime(scanned_at, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(scanned_at, '%Y-%m-%d %H:%M:00') WHEN 2 THEN strftime(scanned_at, '%Y-%m-%d 00:00:00') END AS at FROM classified_files",
    "t10_noise": rf"""WITH x AS (SELECT row_id, concat_ws(' ', entity_scheme, {_NOTE_SQL}) AS c FROM classified_files),
        y AS (SELECT row_id, string_split({_NOISE_SQL}, ' ') AS w FROM x),
        z AS (SELECT row_id, list_filter(w, lambda p, i: NOT (p = '-' AND ((i = len(w) AND i > 1) OR (i = 1 AND len(w) > 1) OR (i > 1 AND i < len(w) AND w[i + 1] IN ('', '-'))))) AS w FROM y)
        SELECT row_id, coalesce(array_to_string(list_filter(w, lambda p: p <> ''), ' '), '') AS v FROM z""",
    "t12_postcodes": r"SELECT addr_id, upper(regexp_extract(entity_address, '(?i)\b([A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2})\b', 1)) AS postcode FROM address_rows",
    "t16_human": """WITH s AS (SELECT row_id, CAST(trunc(size / 1024) AS BIGINT) * 1024 AS b, overall_confidence AS c FROM classified_files)
        SELECT row_id, CASE WHEN b IS NULL THEN '' WHEN b < 1024 THEN format('{:d} B', b) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576.0::DOUBLE) ELSE format('{:.1f} GB', b / 1073741824.0::DOUBLE) END AS size_text,
          least(1.0::DOUBLE, greatest(0.0::DOUBLE, c * 1.5::DOUBLE - 0.2::DOUBLE)) AS clamped FROM s""",
    "s7_jsonl": """SELECT line_id, CASE WHEN json_valid(line) THEN line ->> 'filename_stem' END AS filename_stem, CASE WHEN json_valid(line) THEN line ->> 'extension' END AS extension,
        CASE WHEN json_valid(line) THEN line ->> 'normalized_filename' END AS normalized_filename, CASE WHEN json_valid(line) THEN line ->> 'size' END AS size FROM jsonl_lines""",
    "s8_paths": "SELECT DISTINCT lower(trim(n)) AS name FROM (SELECT unnest(segments) AS n FROM classified_files WHERE full_path IS NOT NULL AND (contains(full_path, chr(92)) OR contains(full_path, '/'))) WHERE length(lower(trim(n))) >= 4",
    "o1_union": "SELECT source_system, filename_stem, depth FROM classified_files UNION SELECT source_system, filename_stem, depth FROM file_paths",
    "o3_sets": f"""WITH t AS (SELECT row_id, {_TOK.format(c='filename_stem')} AS a, {_TOK.format(c='normalized_filename')} AS b FROM classified_files)
        SELECT row_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), '|'), '') AS only_stem, coalesce(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), '|'), '') AS both FROM t""",
}
