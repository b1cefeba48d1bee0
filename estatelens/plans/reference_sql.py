"""SQL for DuckDB of the reference queries. Dictionaries are written into it as VALUES from the built-in configuration."""

from __future__ import annotations

from estatelens.config import WEIGHTS, canonical_words, default_config
from estatelens.operators.matching import trigger_words
from estatelens.plans.ingest_queries import _LISTING_SQL, _NOISE_SQL, _PARTS_SQL, _REASON_SQL

AS_OF = "2024-01-01T00:00:00"
_C = default_config()


def _q(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) v({columns}))"


_EST = """est AS (
  SELECT row_id, source_system, full_path, coalesce(segments, []) AS segments, coalesce(filename_stem, '') AS filename_stem, lower(coalesce(extension, '')) AS extension, size, owner, scanned_at AS last_modified,
    coalesce(entity_plot, '') AS entity_plot, CAST(coalesce(list_position(segments, coalesce(entity_plot, '')), 0) AS INT) - 1 AS entity_plot_depth, coalesce(entity_address, '') AS entity_address,
    CAST(coalesce(list_position(list_transform(segments, lambda x: lower(x)), coalesce(entity_address, '')), 0) AS INT) - 1 AS entity_address_depth, coalesce(entity_scheme, '') AS entity_scheme,
    CAST(coalesce(list_position(segments, coalesce(entity_scheme, '')), 0) AS INT) - 1 AS entity_scheme_depth, inferred_type, inferred_category, overall_confidence, dup_group_id,
    coalesce(entity_scheme_cluster_id, '') AS entity_scheme_cluster_id, coalesce(entity_address_cluster_id, '') AS entity_address_cluster_id, coalesce(entity_plot_cluster_id, '') AS entity_plot_cluster_id FROM classified_files)"""


def tokens(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({c}), '[_ \t\r\n\f\v]+'), lambda x: trim(x, '()[]{{}}.,;:''\"!?#')), lambda x: x <> '')"


def texts(name: str, source: str) -> str:
    """CTEs {name}(text, k) of distinct texts with tokens and {name}_p(text, phrase)."""
    grams = ", ".join(f"list_transform(range(1, len(k) - {n - 2}), lambda i: array_to_string(k[i:i + {n - 1}], ' '))" for n in (4, 3, 2, 1))
    return f"""{name} AS (SELECT text, {tokens('text')} AS k FROM (SELECT DISTINCT text FROM ({source}) WHERE text IS NOT NULL)),
{name}_p AS (SELECT text, unnest(list_distinct(flatten([{grams}]))) AS phrase FROM {name}), {name}_t AS (SELECT DISTINCT text, unnest(k) AS token FROM {name})"""


_STEMS = texts("st", "SELECT filename_stem AS text FROM est")
_NAMES = texts("nm", "SELECT unnest(segments) AS text FROM est")
_WORDS = canonical_words(_C)
_FUZZY = f"fz AS (SELECT token AS variant, min(w) AS canonical FROM (SELECT DISTINCT token FROM {{t}}_t) JOIN {_values([(w,) for w in _WORDS if len(w) >= 5], 'w')} ON damerau_levenshtein(token, w) = 1 AND regexp_full_match(token, '[a-z]+') WHERE token NOT IN ({', '.join(map(_q, _WORDS))}) GROUP BY 1)"
_BEST = "SELECT DISTINCT ON (text, label) text, label, ord, layer, priority FROM ({}) ORDER BY text, label, priority, term_ord"


def type_hits(name: str, out: str) -> str:
    exact = _values([(t, d.name, i, d.layer, 1, k) for i, d in enumerate(_C.types) for k, t in enumerate(d.tokens)], "phrase, label, ord, layer, priority, term_ord")
    short = _values([(t, d.name, i, d.layer, 3, k) for i, d in enumerate(_C.types) for k, t in enumerate(d.abbreviations)], "token, label, ord, layer, priority, term_ord")
    patterns = " UNION ALL ".join(f"SELECT text, {_q(d.name)}, {i}, {d.layer}, 2, 0 FROM {name} WHERE regexp_matches(text, {_q('(?i)' + p)})" for i, d in enumerate(_C.types) for p in d.patterns)
    fuzzy = _values([(t, d.name, i, d.layer, k) for i, d in enumerate(_C.types) for k, t in enumerate(d.tokens)], "term, label, ord, layer, term_ord")
    wrong = f"""SELECT text, label, ord, layer, 4, term_ord FROM (SELECT text, k, list_transform(k, lambda x: coalesce(m[x], x)) AS fixed FROM {name} JOIN
        (SELECT text, map_from_entries(list(struct_pack(a := variant, b := canonical))) AS m FROM {name}_t JOIN {out}_fz ON token = variant GROUP BY text) USING (text)), {fuzzy}
        WHERE list_has_all(fixed, string_split(term, ' ')) AND NOT list_has_all(k, string_split(term, ' '))"""
    return f"{_FUZZY.format(t=name).replace('fz AS', out + '_fz AS', 1)}, {out} AS ({_BEST.format(f'SELECT text, label, ord, layer, priority, term_ord FROM {name}_p JOIN {exact} USING (phrase) UNION ALL SELECT text, label, ord, layer, priority, term_ord FROM {name}_t JOIN {short} USING (token) UNION ALL {patterns} UNION ALL {wrong}')})"


def category_hits(name: str, out: str) -> str:
    exact = _values([(t, d.name, i, 0, 1, k) for i, d in enumerate(_C.categories) for k, t in enumerate(d.signals)], "phrase, label, ord, layer, priority, term_ord")
    short = _values([(t, d.name, i, 0, 3, k) for i, d in enumerate(_C.categories) for k, t in enumerate(d.aliases)], "token, label, ord, layer, priority, term_ord")
    return f"{out} AS ({_BEST.format(f'SELECT text, label, ord, layer, priority, term_ord FROM {name}_p JOIN {exact} USING (phrase) UNION ALL SELECT text, label, ord, layer, priority, term_ord FROM {name}_t JOIN {short} USING (token)')})"


def entity_hits(name: str, out: str, types_: str, cats: str) -> str:
    exact = _values([(t, d.name, i, 0, 1, k) for i, d in enumerate(_C.entities) for k, t in enumerate(d.tokens)], "phrase, label, ord, layer, priority, term_ord")
    short = _values([(t, d.name, i, 0, 3, k) for i, d in enumerate(_C.entities) for k, t in enumerate(d.abbreviations)], "token, label, ord, layer, priority, term_ord")
    patterns = " UNION ALL ".join(f"SELECT text, {_q(d.name)}, {i}, 0, 2, 0 FROM {name} WHERE regexp_matches(text, {_q('(?i)' + p)})" for i, d in enumerate(_C.entities) for p in d.patterns)
    free = f"text NOT IN (SELECT text FROM {types_} UNION ALL SELECT text FROM {cats})"
    return f"{out} AS ({_BEST.format(f'SELECT text, label, ord, layer, priority, term_ord FROM {name}_p JOIN {exact} USING (phrase) WHERE {free} UNION ALL SELECT text, label, ord, layer, priority, term_ord FROM {name}_t JOIN {short} USING (token) WHERE {free} UNION ALL {patterns}')})"


_ALL_HITS = f"{_STEMS}, {_NAMES}, {type_hits('st', 'sth')}, {type_hits('nm', 'nth')}, {category_hits('nm', 'nch')}, {entity_hits('nm', 'neh', 'nth', 'nch')}"
_EXT = _values([(e, d.name, i, d.layer) for i, d in enumerate(_C.types) for e in d.extensions], "extension, label, ord, layer")
_SEG = "seg AS (SELECT row_id, i - 1 AS depth, segments[i] AS text FROM (SELECT row_id, segments, unnest(range(1, len(segments) + 1)) AS i FROM est))"
_GENERIC = ", ".join(map(_q, WEIGHTS["generic_types"]))
_CHILD = " OR ".join(f"(f.row_id IN (SELECT row_id FROM fts WHERE label = {_q(p)}) AND lab.label IN ({', '.join(map(_q, k))}))" for p, k in WEIGHTS["parent_child"].items())
_DOMAIN = " OR ".join(f"(lab.label = {_q(t.name)} AND coalesce(cat.label, 'Unknown') = {_q(t.belongs_to)})" for t in _C.types if t.belongs_to != "universal")
_SCORES = f"""WITH {_EST}, {_SEG}, {_ALL_HITS},
fts AS (SELECT row_id, depth, label, layer, ord, CASE WHEN priority = 4 THEN 0.425 ELSE 0.5 END::DOUBLE AS w FROM seg JOIN nth USING (text)),
sts AS (SELECT row_id, label, layer, ord, CASE priority WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 WHEN 3 THEN 0.65 ELSE 0.7225 END::DOUBLE AS w FROM est JOIN sth ON filename_stem = text),
xts AS (SELECT row_id, label, layer, ord, 0.2::DOUBLE AS w FROM est JOIN {_EXT} USING (extension)),
cat AS (SELECT DISTINCT ON (row_id) row_id, label FROM seg JOIN nch USING (text) ORDER BY row_id, depth DESC, ord),
bf AS (SELECT DISTINCT ON (row_id) row_id, label, w FROM sts ORDER BY row_id, w DESC, layer DESC, ord),
bd AS (SELECT DISTINCT ON (row_id) row_id, label, w FROM fts ORDER BY row_id, depth DESC, layer DESC, w DESC, ord),
bs AS (SELECT DISTINCT ON (row_id) row_id, label, w FROM fts WHERE label NOT IN ({_GENERIC}) ORDER BY row_id, depth DESC, layer DESC, w DESC, ord),
bx AS (SELECT DISTINCT ON (row_id) row_id, label, w FROM xts ORDER BY row_id, w DESC, layer DESC, ord),
lab AS (SELECT e.row_id, CASE WHEN coalesce(bf.label, bd.label) IN ({_GENERIC}) AND bs.label IS NOT NULL THEN bs.label ELSE coalesce(bf.label, bd.label, bx.label, 'Unknown') END AS label,
   CASE WHEN coalesce(bf.label, bd.label) IN ({_GENERIC}) AND bs.label IS NOT NULL THEN bs.w * 0.85::DOUBLE ELSE coalesce(bf.w, bd.w, bx.w, 0.0) END::DOUBLE AS base
   FROM est e LEFT JOIN bf USING (row_id) LEFT JOIN bd USING (row_id) LEFT JOIN bs USING (row_id) LEFT JOIN bx USING (row_id)),
oth AS (SELECT row_id, label, w, 0 AS src, -1 AS depth, ord FROM sts UNION ALL SELECT row_id, label, w, 1, depth, ord FROM fts UNION ALL SELECT row_id, label, w, 2, -1, ord FROM xts),
sec AS (SELECT DISTINCT ON (o.row_id) o.row_id, o.label, o.w FROM oth o JOIN lab USING (row_id) WHERE o.label <> lab.label ORDER BY o.row_id, o.w DESC, src, o.depth, o.ord),
raised AS (SELECT f.row_id, lab.label, coalesce(cat.label, 'Unknown') AS inferred_category, CASE WHEN cat.label IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS category_confidence,
   CASE WHEN lab.label = 'Unknown' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, lab.base
     + CASE WHEN f.row_id IN (SELECT row_id FROM fts) AND f.row_id IN (SELECT row_id FROM sts) THEN
         CASE WHEN (f.row_id, lab.label) IN (SELECT row_id, label FROM fts) THEN 0.1::DOUBLE WHEN {_CHILD} THEN 0.05::DOUBLE ELSE -0.1::DOUBLE END ELSE 0.0::DOUBLE END
     + CASE WHEN {_DOMAIN} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) END AS conf
   FROM est f JOIN lab USING (row_id) LEFT JOIN cat USING (row_id)),
fin AS (SELECT row_id, CASE WHEN conf < 0.15 THEN 'Unknown' ELSE label END AS inferred_type, CASE WHEN conf < 0.15 THEN 0.0::DOUBLE ELSE conf END AS c, inferred_category, category_confidence FROM raised)"""
_SCORE_SELECT = """SELECT row_id, inferred_type, round(c, 3) AS overall_confidence, coalesce(sec.label, '') AS secondary_type, inferred_category, category_confidence,
   CASE WHEN inferred_type = 'Unknown' THEN 'Low' WHEN c >= 0.5 THEN 'High' WHEN c >= 0.35 THEN 'Medium' ELSE 'Low' END AS confidence_band,
   CASE WHEN inferred_type = 'Unknown' THEN 'Not Ready' WHEN c >= 0.5 THEN 'Ready' WHEN c >= 0.35 THEN 'Review' ELSE 'Not Ready' END AS readiness_status,
   inferred_type <> 'Unknown' AND coalesce(sec.w, 0.0) > 0 AND c - coalesce(sec.w, 0.0) < 0.15::DOUBLE AS is_ambiguous FROM fin LEFT JOIN sec USING (row_id)"""
_PREFIX = "pre AS (SELECT est.*, i AS level, array_to_string(segments[1:i], chr(92)) AS path FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM est) est)"
_STATS = f"""{_PREFIX}, fs AS (SELECT path AS folder_path, CAST(level AS INT) AS level, count(*) AS file_count, count(DISTINCT nullif(entity_plot, '')) AS n_plots, count(DISTINCT nullif(entity_address, '')) AS n_addresses,
   CAST(max(CASE WHEN entity_plot <> '' AND entity_plot_depth = level THEN 1 ELSE 0 END) AS INT) AS direct_plot_children, string_split(path, chr(92))[-1] AS name,
   CASE WHEN level > 1 THEN left(path, length(path) - length(string_split(path, chr(92))[-1]) - 1) END AS parent_path FROM pre GROUP BY path, level)"""
_SIGNALS = ", ".join(_q(c.name) for c in _C.categories if c.scheme_signal)
_CATS = f"""{texts('fn', 'SELECT name AS text FROM fs')}, {category_hits('fn', 'fch')}, own AS (SELECT folder_path, parent_path, label FROM fs JOIN fch ON name = text WHERE label IN ({_SIGNALS})),
dev AS (SELECT path AS folder_path, list_sort(list(DISTINCT label)) AS cats FROM (SELECT label, array_to_string(p[1:i], chr(92)) AS path FROM (SELECT label, string_split(folder_path, chr(92)) AS p, unnest(range(1, len(string_split(folder_path, chr(92))) + 1)) AS i FROM own)) GROUP BY 1),
dcc AS (SELECT parent_path AS folder_path, count(DISTINCT folder_path) AS n FROM own WHERE parent_path IS NOT NULL GROUP BY 1), tdc AS (SELECT parent_path AS folder_path, count(*) AS n FROM fs WHERE parent_path IS NOT NULL GROUP BY 1)"""
_TERMS = ", ".join(_q(t) for t in sorted(trigger_words(_C.entity("plot"))))
_PLOT_RX = " OR ".join(f"regexp_matches(name, {_q('(?i)' + p)})" for p in _C.entity("plot").patterns)
_CAND = f"""{_STATS}, {_CATS}, {type_hits('fn', 'fth')},
org AS (SELECT text AS name, ((len(list_filter(k, lambda x: regexp_matches(x, '[A-Za-z0-9]'))) < 4 AND text IN (SELECT text FROM fch)) OR text IN (SELECT text FROM fch WHERE priority = 1)
   OR (len(list_filter(k, lambda x: regexp_matches(x, '[A-Za-z0-9]'))) < 4 AND text IN (SELECT text FROM fth)) OR text IN (SELECT text FROM fth_strong)) AS organisational, k FROM fn, (SELECT 1)),
gated AS (SELECT fs.*, n_plots + n_addresses AS unique_entities, coalesce(len(cats), 0) AS n_dev, coalesce(dcc.n, 0) AS dcc, coalesce(tdc.n, 0) AS tdc FROM fs LEFT JOIN dev USING (folder_path) LEFT JOIN dcc USING (folder_path) LEFT JOIN tdc USING (folder_path)
   WHERE n_plots + n_addresses >= 3 OR (n_plots + n_addresses >= 1 AND coalesce(len(cats), 0) >= 3) OR coalesce(len(cats), 0) >= 4),
blk AS (SELECT folder_path FROM fs JOIN org USING (name) WHERE organisational AND direct_plot_children = 0),
nst AS (SELECT DISTINCT g.folder_path FROM gated g JOIN blk ON starts_with(g.folder_path, blk.folder_path || chr(92))),
cand AS (SELECT gated.*, CASE WHEN length(trim(name)) < 3 THEN 'too_short' WHEN organisational THEN 'cat_folder' WHEN nst.folder_path IS NOT NULL THEN 'nested'
   WHEN CASE WHEN len(k) > 3 THEN regexp_matches(name, '(?i)^\\s*(?:plots?|flats?|units?|apts?|apartments?)[\\s._-]*\\d+') ELSE (list_has_any(k, [{_TERMS}]) OR {_PLOT_RX}) AND NOT regexp_matches(lower(name), 'phase|block') END THEN 'entity_only' END AS excluded_by
   FROM gated JOIN org USING (name) LEFT JOIN nst USING (folder_path))"""
# single-word phrases of base-layer types do not mark long names
_BASE_SINGLE = ", ".join(_q(t) for d in _C.types if d.layer == 0 for t in d.tokens if " " not in t)
_STRONG = f"""fth_strong AS (SELECT DISTINCT text FROM fth WHERE layer > 0 OR priority <> 1 OR NOT EXISTS (SELECT 1 FROM {_values([(d.name, t) for d in _C.types if d.layer == 0 for t in d.tokens if ' ' not in t], 'label, phrase')} b JOIN fn_p p ON p.phrase = b.phrase WHERE p.text = fth.text AND b.label = fth.label))"""
_CAND = _CAND.replace("\norg AS", f"\n{_STRONG},\norg AS", 1)
_ADDRESS_TERMS = ", ".join(_q(t) for t in sorted({*_C.entity("address").tokens, *_C.entity("address").abbreviations}))
_IS_PLACE = "list_has_any(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])), ['quillmere', 'thrapcombe quay', 'wexgarth', 'zerouer'])"
_PLACED = _CAND.replace("AS organisational, k FROM fn", f"AND NOT {_IS_PLACE} AS organisational, {_IS_PLACE} AS is_place, k FROM fn", 1).replace("(SELECT text FROM fth_strong)) AND", "(SELECT text FROM fth_strong))) AND", 1).replace("org AS (SELECT text AS name, ((len", "org AS (SELECT text AS name, (((len", 1)
_PLACED = _PLACED.replace("'too_short' WHEN organisational", r"'too_short' WHEN lower(trim(name)) = 'thrapcombe quay' OR regexp_replace(lower(trim(name)), '^\d+[\s._-]*', '') = 'thrapcombe quay' OR contains(lower(trim(name)), 'drawing') OR regexp_matches(name, '(?i)^block\b') THEN 'cfg_excl' WHEN organisational", 1)
_PLACED = _PLACED.replace("THEN 'entity_only' END AS excluded_by", f"THEN 'entity_only' WHEN NOT (is_place OR list_has_any(k, [{_ADDRESS_TERMS}])) THEN 'no_location' END AS excluded_by", 1)
_SCHEMES = f"""{_CAND}, op AS (SELECT * FROM cand WHERE excluded_by IS NULL), kid AS (SELECT parent_path AS folder_path, count(*) AS n FROM op GROUP BY 1),
sc AS (SELECT op.*, coalesce(kid.n, 0) AS kids, round(least(1.0::DOUBLE, CASE WHEN unique_entities >= 5 THEN 0.85 ELSE 0.7 END::DOUBLE + CASE WHEN direct_plot_children > 0 THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN n_dev >= 3 THEN 0.1 ELSE 0.0 END::DOUBLE), 3) AS confidence FROM op LEFT JOIN kid USING (folder_path)),
s1 AS (SELECT *, CASE WHEN kids >= 3 AND tdc > 0 AND kids / tdc > 0.5 THEN 'structural' WHEN kids >= 1 AND dcc = 0 AND direct_plot_children = 0 AND tdc = kids THEN 'sub_container' END AS st FROM sc),
ver AS (SELECT p.folder_path, p.dcc > 0 OR p.direct_plot_children > 0 AS structured, count(*) FILTER (c.confidence > 0.5) AS nq, bool_or(c.confidence > 0.5 AND c.confidence > p.confidence) AS higher
   FROM s1 p JOIN s1 c ON c.parent_path = p.folder_path WHERE p.st IS NULL AND c.st IS NULL GROUP BY ALL),
fate AS (SELECT folder_path, CASE WHEN higher OR nq >= 3 THEN 'container' WHEN nq > 0 AND structured THEN 'keeps' WHEN nq > 0 THEN 'container' END AS f FROM ver),
stat AS (SELECT s1.*, coalesce(st, CASE WHEN a.f = 'container' THEN 'container' WHEN b.f = 'keeps' THEN 'subsumed' ELSE 'chosen' END) AS status FROM s1 LEFT JOIN fate a USING (folder_path) LEFT JOIN fate b ON s1.parent_path = b.folder_path)"""
_NORM = r"trim(regexp_replace(translate(lower(entity_scheme), '`()[]{},;:''\"!?#@*/' || chr(92), ''), '[ \t\r\n]+', ' ', 'g'))"
_POOL = f"""pv AS (SELECT row_id, {_NORM} AS value, CASE WHEN entity_scheme_depth >= 0 THEN array_to_string(segments[1:entity_scheme_depth + 1], chr(92)) ELSE '__nodepth__' || {_NORM} END AS folder FROM est WHERE {_NORM} <> ''),
vote AS (SELECT value, count(*) AS n FROM (SELECT folder, arg_min(value, struct_pack(r := row_id, v := value)) AS value FROM pv GROUP BY 1) GROUP BY 1),
pool AS (SELECT value, greatest(coalesce(v.n, 0), count(*)) AS count FROM pv LEFT JOIN vote v USING (value) GROUP BY value, v.n)"""
_LINKS = """g AS (SELECT value, list_distinct(list_transform(range(1, length(value) + 3), lambda i: substring('$$' || value || '$$', i, 3))) AS g FROM pool),
lk AS (SELECT a.value AS a, b.value AS b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS similarity FROM g a JOIN g b ON a.value < b.value AND len(a.g) <= len(b.g) * 2 AND len(b.g) <= len(a.g) * 2),
links AS (SELECT * FROM lk WHERE similarity >= 0.55)"""
_COMP = "both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk(node, seen) AS (SELECT value, value FROM pool UNION SELECT w.node, s.b FROM walk w JOIN both_ s ON w.seen = s.a), comp AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1)"
_OVERLAPS = f"""n1 AS (SELECT value, string_split({_NOISE_SQL}, ' ') AS w FROM (SELECT value, value AS c FROM pool)),
n2 AS (SELECT value, list_filter(w, lambda p, i: p <> '' AND NOT (p = '-' AND ((i = len(w) AND i > 1) OR (i = 1 AND len(w) > 1) OR (i > 1 AND i < len(w) AND w[i + 1] IN ('', '-'))))) AS w FROM n1),
n3 AS (SELECT value, coalesce(array_to_string(w, ' '), '') AS bare FROM n2),
n4 AS (SELECT value, list_distinct({tokens('bare')}) AS ws, list_distinct(list_transform(range(1, length(bare) + 3), lambda i: substring('$$' || bare || '$$', i, 3))) AS gs FROM n3),
n5 AS (SELECT * FROM n4 WHERE len(ws) >= 2),
over_ AS (SELECT a.value AS a, b.value AS b FROM n5 a JOIN n5 b ON a.value < b.value AND len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) >= 0.8 AND len(list_intersect(a.gs, b.gs)) / least(len(a.gs), len(b.gs)) >= 0.6)"""
_KEY = "CASE WHEN regexp_matches(lower(trim(filename_stem)), '[a-z0-9]') AND coalesce(size, -1) >= 0 THEN lower(trim(filename_stem)) || '|' || lower(trim(extension)) || '|' || size END"
_DUP = f"""keyed AS (SELECT *, {_KEY} AS key, array_to_string(segments, chr(92)) AS folder FROM est),
grp AS (SELECT key, count(*) AS n, count(last_modified) = count(*) AND min(last_modified) = max(last_modified) AS same_date, min(coalesce(owner, '')) = max(coalesce(owner, '')) AS same_owner,
   coalesce(min(source_system) <> max(source_system), false) AS cross_estate, coalesce(min(CASE WHEN len(segments) > 0 THEN folder END) <> max(CASE WHEN len(segments) > 0 THEN folder END), false) AS cross_folder, max(last_modified) AS newest, min(size) AS first_size
   FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 2)"""
_WORDS_COPY = ", ".join(_q(w) for w in WEIGHTS["duplicate_detection"]["copy_path_keywords"])
_COPY = f"cp AS (SELECT *, coalesce(list_has_any(list_transform(segments, lambda x: lower(trim(x))), [{_WORDS_COPY}]), false) AS is_copy, lower(filename_stem) || '|' || extension AS nm FROM est), cps AS (SELECT *, is_copy AND nm IN (SELECT nm FROM cp WHERE NOT is_copy) AS suspect FROM cp)"
_RULES = _values([(t, y, b, s) for t, (y, b, s) in _C.retention.rules.items()], "rt, years, basis, sens")
_NOISE = r"length(x) <= 1 OR regexp_full_match(x, '\d+') OR regexp_full_match(x, '[vr]\d+') OR (length(x) >= 4 AND length(regexp_replace(x, '\D', '', 'g')) / length(x) > 0.6)"


_RPT = f"""{_EST}, rep AS (SELECT est.* EXCLUDE (entity_scheme_cluster_id), est.entity_scheme_cluster_id, coalesce(c.entity_address_canonical, '') AS entity_address_canonical, upper(entity_scheme2) AS entity_scheme_canonical, '' AS entity_plot_canonical,
   CASE WHEN entity_scheme_depth >= 0 THEN array_to_string(est.segments[1:entity_scheme_depth + 1], chr(92)) ELSE est.entity_scheme END AS entity_scheme_path,
   CASE WHEN est.entity_plot = '' THEN '' WHEN est.entity_scheme_cluster_id <> '' THEN est.entity_scheme_cluster_id WHEN est.entity_address_cluster_id <> '' THEN 'addr:' || est.entity_address_cluster_id ELSE '__nocontext__' || coalesce(array_to_string(est.segments, chr(92)), '') END AS ctx,
   list_filter(est.segments, lambda s: regexp_matches(s, '^[A-Z][a-z]+ [0-9]')) AS raws, coalesce(est.overall_confidence, 0.0::DOUBLE) AS sure
   FROM (SELECT *, entity_scheme AS entity_scheme2 FROM est) est JOIN classified_files c USING (row_id))"""


def _entity_report(entity: str, other: str, raw: bool) -> str:
    v, plural, many = f"entity_{entity}", f"{other}{'es' if other.endswith('s') else 's'}", f"{entity}{'es' if entity.endswith('s') else 's'}"
    best = lambda e: f"nullif(trim(coalesce(entity_{e}_canonical, entity_{e})), '')"
    items = {
        "canonical": f"entity_{entity}_canonical", "variant": f"nullif(trim({v}), '')", "depth": f"CAST(entity_{entity}_depth + 1000 AS VARCHAR)", "scheme": best("scheme"), "other": best(other), "type": "nullif(trim(inferred_type), '')",
        "path": f"CASE WHEN len(segments) > 0 THEN array_to_string(CASE WHEN entity_{entity}_depth BETWEEN 0 AND len(segments) - 1 THEN segments[1:entity_{entity}_depth + 1] ELSE segments END, chr(92)) END",
        "name": "nullif(trim(filename_stem || CASE WHEN extension <> '' THEN '.' || extension ELSE '' END), '')",
    }
    long = " UNION ALL ".join([f"SELECT g, '{k}' AS k, {x} AS x FROM r" for k, x in items.items()] + (["SELECT g, 'raw', nullif(trim(unnest(raws)), '') FROM r"] if raw else []))
    top = lambda k, n, x="x": f"string_agg({x}, '; ' ORDER BY i) FILTER (k = '{k}' AND i <= {n})"
    every = lambda k: f"string_agg(x, '; ' ORDER BY x) FILTER (k = '{k}')"
    more = f""", coalesce((SELECT string_agg(x, '; ' ORDER BY n DESC, x) FROM c WHERE c.g = t.g AND c.k = 'raw' AND lower(x) <> lower({entity})), '') AS other_folder_{many}""" if raw else ""
    return f"""WITH {_RPT}, r AS (SELECT *, CASE WHEN entity_{entity}_cluster_id <> '' THEN entity_{entity}_cluster_id ELSE 'raw:' || {v} END AS g FROM rep WHERE trim({v}) <> ''),
        c AS (SELECT g, k, x, count(*) AS n FROM ({long}) WHERE x IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY g, k ORDER BY n DESC, x) AS i FROM c),
        f AS (SELECT g, count(*) AS file_count, round(CAST(avg(sure) AS DECIMAL(20,10)), 2)::DOUBLE AS avg_confidence FROM r GROUP BY 1),
        t AS (SELECT g, coalesce(nullif(trim({top('canonical', 1)}), ''), {top('variant', 1)}) AS {entity}, count(*) FILTER (k = 'variant')::INT AS variant_count, CAST({top('depth', 1)} AS INT) - 1000 AS typical_depth, {top('path', 1)} AS p, {every('scheme')} AS schemes,
          count(*) FILTER (k = 'other') AS unique_{plural}, {top('type', 3, "x || ' (' || n || ')'")} AS top_types, {top('name', 5)} AS sample_filenames, {top('path', 5)} AS sample_full_paths, {top('other', 5)} AS sample_{plural}, {every('variant')} AS vs FROM o GROUP BY g)
        SELECT {entity}, variant_count, file_count, avg_confidence, typical_depth, CASE WHEN p IS NULL THEN '' WHEN contains(p, chr(92)) THEN string_split(p, chr(92))[-2] ELSE '(root)' END AS parent_folder, coalesce(p, '') AS full_path, coalesce(schemes, '') AS schemes, unique_{plural}, coalesce(top_types, '') AS top_types,
          coalesce(sample_filenames, '') AS sample_filenames, coalesce(sample_full_paths, '') AS sample_full_paths, coalesce(sample_{plural}, '') AS sample_{plural}, CASE WHEN variant_count > 1 THEN vs ELSE '' END AS all_variants{more} FROM t JOIN f USING (g)"""


def _cluster_report() -> str:
    names = ", ".join(f"{e}_n AS (SELECT entity_{e}_cluster_id AS id, min(entity_{e}_canonical) AS canon FROM rep WHERE entity_{e}_cluster_id <> '' AND entity_{e}_canonical <> '' GROUP BY 1)" for e in ("scheme", "address"))
    parts = " UNION ALL ".join(
        f"""SELECT '{e}' AS entity_type, entity_{e}_cluster_id AS cluster_id, coalesce((SELECT m.v FROM (SELECT entity_{e}_canonical AS v, count(*) AS n FROM rep q WHERE q.entity_{e}_cluster_id = rep.entity_{e}_cluster_id AND entity_{e}_canonical <> '' GROUP BY 1 ORDER BY n DESC, v LIMIT 1) m), '') AS canonical_form,
        count(DISTINCT nullif(entity_{e}, ''))::INT AS variant_count, count(*) AS file_count, count(DISTINCT source_system) AS n_estates, count(DISTINCT coalesce(array_to_string(segments, chr(92)), '')) AS n_folders, coalesce(array_to_string(list_sort(list(DISTINCT nullif(entity_{e}, ''))  FILTER (entity_{e} <> '')), '; '), '') AS variants,
        {"min(nullif(ctx, ''))" if e == "plot" else "NULL"} AS ctx FROM rep WHERE entity_{e}_cluster_id <> '' GROUP BY entity_{e}_cluster_id"""
        for e in ("scheme", "address", "plot")
    )
    return f"""WITH {_RPT}, {names}, u AS ({parts}) SELECT u.* EXCLUDE (ctx), CASE WHEN coalesce(ctx, '') = '' THEN '' WHEN starts_with(ctx, '__nocontext__') THEN '(isolated — no scheme/address context)' WHEN starts_with(ctx, 'addr:') THEN 'address: ' || coalesce(a.canon, substr(ctx, 6)) ELSE 'scheme: ' || coalesce(s.canon, ctx) END AS linked_context
        FROM u LEFT JOIN scheme_n s ON s.id = ctx LEFT JOIN address_n a ON 'addr:' || a.id = ctx"""


def _tree_report() -> str:
    pre = "pre AS (SELECT rep.*, i AS level, array_to_string(segments[1:i], chr(92)) AS path FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS i FROM rep) rep)"
    ctes, columns, joins, kinds = [], [], [], []
    for e in ("scheme", "plot", "address"):
        ctes.append(f"{e}_o AS (SELECT path AS pl, entity_{e} AS v, count(*) AS n, sum(sure) AS c FROM pre WHERE entity_{e} <> '' AND entity_{e}_depth = level - 1 GROUP BY 1, 2), {e}_b AS (SELECT pl, first(v ORDER BY n DESC, v) AS v, sum(n)::BIGINT AS n, round(CAST(sum(c) / sum(n) AS DECIMAL(20,10)), 2)::DOUBLE AS c FROM {e}_o GROUP BY 1), {e}_u AS (SELECT f.folder_path, arg_max(b.v, len(string_split(b.pl, chr(92)))) AS v FROM fo f JOIN {e}_b b ON f.folder_path = b.pl OR starts_with(f.folder_path, b.pl || chr(92)) GROUP BY 1)")
        columns.append(f"{e}_b.pl IS NOT NULL AS is_{e}, coalesce({e}_u.v, '') AS {e}_name, {e}_b.c AS {e}_confidence, coalesce({e}_b.n, 0) AS {e}_file_count")
        joins.append(f"LEFT JOIN {e}_b ON {e}_b.pl = fo.folder_path LEFT JOIN {e}_u ON {e}_u.folder_path = fo.folder_path")
        kinds.append(f"CASE WHEN {e}_b.pl IS NOT NULL THEN '{e}' END")
    return f"""WITH {_RPT}, {pre}, fo AS (SELECT path AS folder_path, level, count(*) AS file_count, avg(overall_confidence) AS mean_confidence FROM pre GROUP BY 1, 2), {', '.join(ctes)}
        SELECT fo.folder_path, CAST(level AS INT) AS level, file_count, round(mean_confidence, 10) AS mean_confidence, {', '.join(columns)}, concat_ws(', ', {', '.join(kinds)}) AS entity_types FROM fo {' '.join(joins)} WHERE level BETWEEN 2 AND 4"""


def _leaf_report() -> str:
    ctes, columns, joins = [], [], []
    for e in ("plot", "address", "scheme"):
        ctes.append(f"{e}_v AS (SELECT path, trim(entity_{e}) AS v, count(*) AS n, sum(sure) FILTER (sure > 0) AS c, count(*) FILTER (sure > 0) AS k FROM ro WHERE trim(entity_{e}) <> '' GROUP BY 1, 2), {e}_f AS (SELECT path, first(v ORDER BY n DESC, v) AS sel, max(n) AS top, sum(n)::BIGINT AS cnt, count(*) AS dis, string_agg(v, '; ' ORDER BY v) AS vals, round(CAST(sum(c) / sum(k) AS DECIMAL(20,10)), 2)::DOUBLE AS conf FROM {e}_v GROUP BY 1)")
        columns.append(f"coalesce({e}_f.sel, '') AS {e}_selected, coalesce({e}_f.top || '/' || {e}_f.cnt, '') AS {e}_share, {e}_f.conf AS {e}_confidence, coalesce({e}_f.cnt, 0) AS {e}_count, coalesce({e}_f.dis, 0) AS {e}_distinct, coalesce({e}_f.vals, '') AS {e}_values, coalesce({e}_f.dis > 1, false) AS {e}_conflict")
        joins.append(f"LEFT JOIN {e}_f ON {e}_f.path = b.path")
    return f"""WITH {_RPT}, sh AS (SELECT *, segments[1:len(segments) - 1] AS s FROM rep WHERE len(segments) >= 2), px AS (SELECT DISTINCT array_to_string(s[1:i], chr(92)) AS path, i FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM sh)),
        ab AS (SELECT DISTINCT left(path, length(path) - length(string_split(path, chr(92))[-1]) - 1) AS p FROM px WHERE i > 1), ro AS (SELECT *, array_to_string(s, chr(92)) AS path FROM sh WHERE array_to_string(s, chr(92)) IN (SELECT path FROM px) AND array_to_string(s, chr(92)) NOT IN (SELECT p FROM ab)),
        b AS (SELECT path, count(*) AS n_files FROM ro GROUP BY 1), {', '.join(ctes)} SELECT b.path AS folder_path, n_files, {', '.join(columns)} FROM b {' '.join(joins)}"""


_FLAG_EST = rf"""{_LISTING_SQL}, {_REASON_SQL}, kept AS (SELECT row_id, full_path FROM reasoned WHERE removal_reason IS NULL), {_PARTS_SQL},
est AS (SELECT row_id, coalesce(segments, []) AS segments, CASE WHEN plain THEN nm ELSE left(nm, length(nm) - length(ext0) - 1) END AS filename_stem, CASE WHEN plain THEN '' ELSE lower(ext0) END AS extension FROM split)"""

SQL = {
    "q1_flagship": f"{_SCORES.replace(_EST, _FLAG_EST)}, s AS ({_SCORE_SELECT}) SELECT inferred_type, confidence_band, count(*) AS n_files FROM s GROUP BY 1, 2",
    "m1_types": f"WITH {_EST}, {_STEMS}, {type_hits('st', 'h')} SELECT * FROM h",
    "m2_categories": f"WITH {_EST}, {_NAMES}, {category_hits('nm', 'h')} SELECT * FROM h",
    "m3_extensions": f"WITH {_EST} SELECT DISTINCT extension, label FROM est JOIN {_EXT} USING (extension)",
    "m4_entities": f"WITH {_EST}, {_NAMES}, {type_hits('nm', 'th')}, {category_hits('nm', 'ch')}, {entity_hits('nm', 'h', 'th', 'ch')} SELECT * FROM h",
    "m5_folder_signals": f"""WITH {_EST}, {_ALL_HITS}, ch AS (SELECT DISTINCT segments FROM est WHERE len(segments) > 0), sg AS (SELECT array_to_string(segments, chr(92)) AS chain, CAST(i - 1 AS INT) AS depth, segments[i] AS text FROM (SELECT segments, unnest(range(1, len(segments) + 1)) AS i FROM ch))
        SELECT chain, 'type' AS kind, label, depth FROM sg JOIN nth USING (text) UNION ALL SELECT chain, 'category', label, depth FROM sg JOIN nch USING (text) UNION ALL SELECT chain, 'entity', label, depth FROM sg JOIN neh USING (text)""",
    "m7_fuzzy": f"WITH {_EST}, {_STEMS}, {_FUZZY.format(t='st')} SELECT * FROM fz",
    "m10_places": f"WITH {_EST}, {_NAMES} SELECT text, coalesce(list_has_any(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])), ['quillmere', 'thrapcombe quay', 'wexgarth', 'zerouer']), false) AS is_place FROM nm",
    "m11_known": f"WITH {_EST}, {_STEMS}, t AS (SELECT unnest(k) AS term FROM st) SELECT term, count(*) AS n FROM t WHERE term IN ({', '.join(_q(x) for x in sorted({t for d in _C.types for t in (*d.tokens, *d.abbreviations)} | {t for d in _C.categories for t in (*d.signals, *d.aliases)} | {t for d in _C.entities for t in (*d.tokens, *d.abbreviations)}))}) GROUP BY 1",
    "r_scores": f"{_SCORES} {_SCORE_SELECT}",
    "r10_entities": f"""WITH {_EST}, {_SEG}, {_ALL_HITS}, en AS (SELECT row_id, depth, text, label, CASE priority WHEN 1 THEN 0.8 WHEN 2 THEN 0.65 ELSE 0.5 END AS conf FROM seg JOIN neh USING (text)),
        b AS (SELECT row_id, label, arg_max(text, depth) AS v, max(depth) AS d, arg_max(conf, depth) AS c, count(*) AS n FROM en GROUP BY 1, 2)
        SELECT row_id, coalesce(p.v, '') AS entity_plot, CAST(coalesce(p.d, -1) AS INT) AS entity_plot_depth, coalesce(p.c, 0.0)::DOUBLE AS entity_plot_confidence, CAST(coalesce(p.n, 0) AS INT) AS n_plots, coalesce(a.v, '') AS entity_address, CAST(coalesce(a.d, -1) AS INT) AS entity_address_depth, CAST(coalesce(a.n, 0) AS INT) AS n_addresses
        FROM est LEFT JOIN (SELECT * FROM b WHERE label = 'plot') p USING (row_id) LEFT JOIN (SELECT * FROM b WHERE label = 'address') a USING (row_id)""",
    "d1_folder_stats": f"WITH {_EST}, {_STATS}, tdc AS (SELECT parent_path AS folder_path, count(*) AS n FROM fs WHERE parent_path IS NOT NULL GROUP BY 1) SELECT folder_path, level, file_count, n_plots, n_addresses, direct_plot_children, coalesce(n, 0) AS total_direct_children FROM fs LEFT JOIN tdc USING (folder_path)",
    "d3_categories": f"WITH {_EST}, {_STATS}, {_CATS} SELECT folder_path, array_to_string(cats, '|') AS categories, coalesce(n, 0) AS direct_category_children FROM dev LEFT JOIN dcc USING (folder_path)",
    "d6_candidates": f"WITH {_EST}, {_CAND} SELECT folder_path, unique_entities, CAST(n_dev AS INT) AS n_dev_categories, coalesce(excluded_by, '') AS excluded_by FROM cand",
    "d12_places": f"""WITH {_EST}, {_PLACED} SELECT folder_path, coalesce(excluded_by, '') AS excluded_by FROM cand""",
    "d13_schemes": f"WITH {_EST}, {_SCHEMES} SELECT folder_path, confidence, status FROM stat",
    "d17_assigned": f"""WITH {_EST}, {_SCHEMES}, cho AS (SELECT folder_path, name, confidence, level - 1 AS depth FROM stat WHERE status = 'chosen'), pri AS (SELECT DISTINCT ON (name) name, folder_path AS scheme_path, confidence, depth FROM cho ORDER BY name, confidence DESC, depth, folder_path),
        mer AS (SELECT cho.folder_path, cho.name, pri.scheme_path, pri.confidence, pri.depth FROM cho JOIN pri USING (name)), hit AS (SELECT DISTINCT ON (row_id) row_id, name, scheme_path, confidence, depth FROM pre JOIN mer ON path = folder_path ORDER BY row_id, level)
        SELECT e.row_id, coalesce(name, '') AS entity_scheme, CAST(coalesce(depth, -1) AS INT) AS entity_scheme_depth, coalesce(scheme_path, '') AS entity_scheme_path, coalesce(confidence, 0.0) AS entity_scheme_confidence FROM est e LEFT JOIN hit USING (row_id)""",
    "d19_sidecar": f"""WITH {_EST}, {_SCHEMES}, u AS (SELECT folder_path, status, unique_entities, direct_plot_children, n_dev FROM stat UNION ALL SELECT folder_path, excluded_by, unique_entities, direct_plot_children, n_dev FROM cand WHERE excluded_by IS NOT NULL)
        SELECT folder_path, status, concat_ws('; ', format('entities {{:d}}: {{}}', unique_entities, CASE WHEN unique_entities >= 5 THEN '0.85' ELSE '0.70' END), CASE WHEN direct_plot_children > 0 THEN 'plots beneath: +0.10' END, CASE WHEN n_dev >= 3 THEN format('categories {{:d}}: +0.10', n_dev) END, 'status ' || status) AS trace FROM u""",
    "j15_tree_status": f"""WITH {_EST}, {_SCHEMES}, u AS (SELECT folder_path, status, confidence FROM stat UNION ALL SELECT folder_path, excluded_by, 0.0 FROM cand WHERE excluded_by IS NOT NULL)
        SELECT fs.folder_path, file_count, status AS scheme_status, u.confidence AS scheme_confidence FROM fs LEFT JOIN u USING (folder_path) WHERE level BETWEEN 2 AND 4""",
    "proj10_entity_types": f"WITH {_EST} SELECT row_id, concat_ws(', ', CASE WHEN entity_scheme <> '' THEN 'scheme' END, CASE WHEN entity_address <> '' THEN 'address' END, CASE WHEN entity_plot <> '' THEN 'plot' END) AS entity_types, 'Estate X' AS source_system, '/root' AS root_prefix FROM est",
    "d20_hierarchy": f"""WITH {_EST}, r1 AS (SELECT *, entity_scheme <> '' AND entity_scheme_depth >= 0 AS hs FROM est), r2 AS (SELECT *, hs AND entity_plot <> '' AND entity_plot_depth <= entity_scheme_depth AS po, hs AND entity_address <> '' AND entity_address_depth <= entity_scheme_depth AS ao FROM r1),
        r3 AS (SELECT row_id, CASE WHEN po THEN '' ELSE entity_plot END AS entity_plot, CASE WHEN po THEN -1 ELSE entity_plot_depth END AS entity_plot_depth, po AND entity_plot = entity_scheme AS entity_plot_is_scheme_name, CASE WHEN ao THEN '' ELSE entity_address END AS ad, CASE WHEN ao THEN -1 ELSE entity_address_depth END AS dd, ao AND entity_address = entity_scheme AS entity_address_is_scheme_name FROM r2),
        r4 AS (SELECT *, entity_plot <> '' AND entity_plot_depth >= 0 AND ad <> '' AND dd >= 0 AND entity_plot_depth > dd AS x FROM r3)
        SELECT row_id, entity_plot, entity_plot_depth, entity_plot_is_scheme_name, CASE WHEN x THEN '' ELSE ad END AS entity_address, CASE WHEN x THEN -1 ELSE dd END AS entity_address_depth, entity_address_is_scheme_name FROM r4""",
    "d23_leaves": f"WITH {_EST}, {_PREFIX}, fo AS (SELECT DISTINCT path, level FROM pre), pa AS (SELECT DISTINCT left(path, length(path) - length(string_split(path, chr(92))[-1]) - 1) AS p FROM fo WHERE level > 1) SELECT path AS folder_path FROM fo WHERE path NOT IN (SELECT p FROM pa)",
    "c1_pool": f"WITH {_EST}, {_POOL} SELECT value, count FROM pool",
    "c3_links": f"WITH {_EST}, {_POOL}, {_LINKS} SELECT a, b, similarity FROM links",
    "c4_groups": f"WITH RECURSIVE {_EST}, {_POOL}, {_LINKS}, {_COMP} SELECT node, root FROM comp",
    "c5_clusters": f"""WITH RECURSIVE {_EST}, {_POOL}, {_LINKS}, {_OVERLAPS}, pairs AS (SELECT a, b FROM links UNION SELECT a, b FROM over_), both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        walk(node, seen) AS (SELECT value, value FROM pool UNION SELECT w.node, s.b FROM walk w JOIN both_ s ON w.seen = s.a), comp AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1),
        m AS (SELECT root, value, count FROM comp JOIN pool ON value = node), c AS (SELECT root, first(value ORDER BY count DESC, length(value) DESC, value) AS canonical, count(*) AS n FROM m GROUP BY 1),
        k AS (SELECT root, canonical, 'schm_' || lpad(CAST(row_number() OVER (ORDER BY n DESC, canonical) - 1 AS VARCHAR), 4, '0') AS cluster_id FROM c) SELECT value, canonical, cluster_id FROM m JOIN k USING (root)""",
    "c10_sizes": f"WITH {_EST} SELECT row_id, CASE WHEN entity_scheme_cluster_id = '' THEN 0 ELSE count(*) OVER (PARTITION BY entity_scheme_cluster_id) END AS entity_scheme_cluster_size FROM est",
    "u1_duplicates": f"""WITH {_EST}, {_DUP}, {_COPY}
        SELECT k.row_id, CASE WHEN g.key IS NULL THEN '' ELSE left(sha256(k.key), 12) END AS dup_group_id, coalesce(g.n, 1) AS dup_group_size, CASE WHEN g.key IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, round(0.85::DOUBLE + CASE WHEN same_date THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN same_owner THEN 0.05 ELSE 0.0 END::DOUBLE, 3)) END AS dup_confidence,
          coalesce(cross_estate, false) AS dup_is_cross_estate, coalesce(cross_folder, false) AS dup_is_cross_folder, g.key IS NULL OR newest IS NULL OR coalesce(k.last_modified = newest, false) AS dup_is_latest, g.key IS NOT NULL AS potential_duplicate, suspect AS dup_copy_path_suspect
        FROM keyed k LEFT JOIN grp g USING (key) JOIN cps ON cps.row_id = k.row_id""",
    "u8_folders": f"""WITH {_EST}, it AS (SELECT DISTINCT array_to_string(segments, chr(92)) AS folder, lower(filename_stem) || '|' || lower(extension) AS sig FROM est WHERE len(segments) > 0 AND filename_stem <> ''), sz AS (SELECT folder, count(*) AS n FROM it GROUP BY 1 HAVING count(*) >= {{least}}),
        i2 AS (SELECT * FROM it JOIN sz USING (folder)), sp AS (SELECT sig FROM i2 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT * FROM i2 WHERE sig IN (SELECT sig FROM sp)),
        p AS (SELECT a.folder AS folder_a, b.folder AS folder_b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM k a JOIN k b USING (sig) WHERE a.folder < b.folder GROUP BY ALL) SELECT *, shared / (n_a + n_b - shared) AS jaccard FROM p WHERE shared / (n_a + n_b - shared) >= {{share}}""",
    "u9_redundancy": f"WITH {_EST}, {_DUP} SELECT left(sha256(key), 12) AS dup_group_id, n AS dup_group_size, first_size * (n - 1) AS redundant_bytes, CASE WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '20+' END AS size_band FROM grp",
    "u10_keywords": f"WITH {_EST}, {_COPY}, w AS (SELECT row_id, unnest(list_distinct(list_transform(segments, lambda x: lower(trim(x))))) AS keyword FROM cps WHERE suspect) SELECT keyword, count(*) AS n_files FROM w WHERE keyword IN ({_WORDS_COPY}) GROUP BY 1",
    "g_retention": f"""WITH {_EST}, b AS (SELECT row_id, inferred_type, CAST(last_modified AS TIMESTAMP) - to_years(CAST(row_id % 30 AS INT)) AS dt FROM est), r AS (SELECT b.*, coalesce(inferred_type, 'Unknown') <> 'Unknown' AS known, rt, years, sens FROM b LEFT JOIN {_RULES} ON inferred_type = rt),
        s AS (SELECT *, CASE WHEN known THEN CASE WHEN rt IS NOT NULL THEN years ELSE 6 END END AS ry, known AND rt IS NOT NULL AND years IS NULL AS perm, CASE WHEN known THEN coalesce(sens, 'medium') END AS sl FROM r),
        e AS (SELECT *, CASE WHEN NOT perm AND ry IS NOT NULL THEN dt + to_years(CAST(ry AS INT)) END AS ex0 FROM s), e2 AS (SELECT *, CASE WHEN month(dt) = 2 AND day(dt) = 29 AND day(ex0) = 28 THEN ex0 + INTERVAL 1 DAY ELSE ex0 END AS ex FROM e),
        t AS (SELECT *, CASE WHEN NOT known THEN 'Unknown' WHEN perm THEN 'Long-term' WHEN ex IS NULL THEN 'Unknown' WHEN ex < TIMESTAMP '2024-01-01 00:00:00' THEN 'Expired' ELSE 'Active' END AS status, floor((epoch_us(ex) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 86400000000.0) / 365.25 AS left_ FROM e2),
        f AS (SELECT *, CASE sl WHEN 'high' THEN 1.25 WHEN 'low' THEN 0.7 ELSE 1.0 END::DOUBLE AS m, CASE status WHEN 'Long-term' THEN 5.0 WHEN 'Expired' THEN CASE WHEN -left_ > 5 THEN 95.0 WHEN -left_ > 2 THEN 80.0 WHEN -left_ > 1 THEN 70.0 ELSE 60.0 END WHEN 'Active' THEN CASE WHEN left_ < 1 THEN 50.0 WHEN left_ < 3 THEN 30.0 WHEN left_ < 5 THEN 15.0 ELSE 5.0 END END::DOUBLE AS base FROM t)
        SELECT row_id, ry AS retention_years, perm AS retention_permanent, sl AS sensitivity_level, strftime(ex, '%Y-%m-%dT%H:%M:%S') AS calculated_expiry_date, status AS retention_status, CASE WHEN base IS NULL THEN 0 ELSE least(100, CAST(trunc(base * m) AS INT)) END AS retention_risk_score FROM f""",
    "d22_tree": _tree_report(),
    "d24_conflicts": _leaf_report(),
    "a2_addresses": _entity_report("address", "plot", True),
    "a3_plots": _entity_report("plot", "address", False),
    "a4_schemes": f"""WITH {_RPT}, r AS (SELECT * FROM rep WHERE entity_scheme <> ''), w AS (SELECT entity_scheme_path AS p, list_sort(list_distinct(list(x))) AS w FROM (SELECT entity_scheme_path, unnest(raws) AS x FROM r) WHERE x <> '' GROUP BY 1),
        g AS (SELECT entity_scheme_path AS p, min(entity_scheme) AS scheme_name, max(sure) AS confidence, count(*) AS file_count, coalesce(list_sort(list(DISTINCT entity_plot) FILTER (entity_plot <> '')), []) AS pl, coalesce(list_sort(list(DISTINCT entity_address) FILTER (entity_address <> '')), []) AS ad FROM r GROUP BY 1),
        j AS (SELECT g.*, coalesce(w, []) AS w, string_split(g.p, chr(92)) AS parts FROM g LEFT JOIN w ON w.p = g.p)
        SELECT scheme_name, confidence, CAST(len(parts) - 1 AS INT) AS depth, file_count, len(pl)::INT AS org_plots, len(ad)::INT AS org_addresses, (len(pl) + len(ad))::INT AS org_total_entities, len(w)::INT AS raw_plot_count, len(w)::INT AS raw_address_count, (2 * len(w))::INT AS raw_total_entities,
          CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], chr(92)) ELSE '(root)' END AS parent_folder, 'R:' || chr(92) || 'data' || chr(92) || p AS full_path, coalesce(array_to_string(pl[1:5], '; '), '') AS sample_org_plots, coalesce(array_to_string(ad[1:5], '; '), '') AS sample_org_addresses, coalesce(array_to_string(w, '; '), '') AS all_raw_plots, coalesce(array_to_string(w, '; '), '') AS all_raw_addresses FROM j""",
    "a5_clusters": _cluster_report(),
    "a10_overlap": f"WITH {_EST}, o AS (SELECT entity_scheme AS s, CASE WHEN row_id % 7 = 0 THEN entity_scheme ELSE entity_address END AS a FROM est) SELECT s = a AS same, count(*) AS n_files FROM o WHERE s <> '' AND a <> '' GROUP BY 1",
    "a1_summary": f"WITH {_EST} SELECT source_system, count(*) AS n_files, count(*) FILTER (overall_confidence >= 0.5) AS n_high, count(*) FILTER (overall_confidence >= 0.35 AND overall_confidence < 0.5) AS n_medium, count(*) FILTER (overall_confidence < 0.35 OR overall_confidence IS NULL) AS n_low, count(DISTINCT inferred_type) AS n_types, count(DISTINCT nullif(dup_group_id, '')) AS n_dup_groups FROM est GROUP BY 1",
    "a6_review": f"WITH {_EST} SELECT entity_address_cluster_id, source_system, coalesce(array_to_string(segments, chr(92)), '') AS folder, count(*) AS n_files FROM est WHERE entity_address_cluster_id <> '' GROUP BY ALL",
    "a7_versions": f"""WITH {_EST}, v AS (SELECT dup_group_id AS version_cluster_id, count(*) AS n_files, count(DISTINCT inferred_type) AS n_types, count(DISTINCT array_to_string(segments, chr(92))) AS n_folders, date_diff('day', CAST(min(last_modified) AS DATE), CAST(max(last_modified) AS DATE)) / 365.25 AS span_years,
          bool_or(regexp_matches(lower(filename_stem), '(^|[^a-z])(v|ver|version|rev)[ ._-]?\\d+|draft|final')) AS mk FROM est WHERE coalesce(dup_group_id, '') <> '' GROUP BY 1)
        SELECT version_cluster_id, n_files, n_types, n_folders, span_years, n_files > 20 AS oversized, n_types > 1 AS mixed_types, NOT mk AS no_version_markers, span_years > 5 AS long_span, n_folders = 1 AS single_folder FROM v""",
    "a8_coverage": f"WITH {_EST} SELECT count(*) AS n_files, {', '.join(f'''avg(CASE WHEN entity_{e} <> '' THEN 1 ELSE 0 END) AS share_{e}, avg(CASE WHEN entity_{e}_cluster_id <> '' THEN 1 ELSE 0 END) AS share_{e}_cluster''' for e in ('scheme', 'address', 'plot'))}, avg(CASE WHEN coalesce(dup_group_id, '') <> '' THEN 1 ELSE 0 END) AS share_duplicate FROM est",
    "a9_tokens": f"""WITH {_EST}, src AS (SELECT coalesce(segments[1], '') AS project, unnest(segments) AS text, 1 AS f, 0 AS n FROM est UNION ALL SELECT coalesce(segments[1], ''), filename_stem, 0, 1 FROM est),
        k AS (SELECT project, f, n, list_filter({tokens('text')}, lambda x: NOT ({_NOISE})) AS k FROM src), ph AS (SELECT project, f, n, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]))) AS term FROM k)
        SELECT term, sum(f)::BIGINT AS folder_count, sum(n)::BIGINT AS file_count, count(DISTINCT project) AS n_projects, term IN ({', '.join(_q(x) for x in sorted({t for d in _C.types for t in (*d.tokens, *d.abbreviations)} | {t for d in _C.categories for t in (*d.signals, *d.aliases)} | {t for d in _C.entities for t in (*d.tokens, *d.abbreviations)}))}) AS is_known FROM ph GROUP BY 1 HAVING sum(f) + sum(n) >= 2""",
    "a10_confidence": f"WITH {_EST} SELECT entity_scheme <> '' AS in_scheme, count(*) AS n_files, round(avg(overall_confidence), 10) AS mean, round(median(overall_confidence), 10) AS median, min(overall_confidence) AS least, max(overall_confidence) AS greatest FROM est GROUP BY 1",
    "a11_types": f"WITH {_EST} SELECT inferred_type, count(*) AS n_files, count(DISTINCT source_system) AS n_estates FROM est GROUP BY 1",
    "a12_top": f"WITH {_EST}, t AS (SELECT inferred_type, count(*) AS n_files, count(DISTINCT source_system) AS n_estates FROM est WHERE inferred_type IS NOT NULL GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n_files DESC, inferred_type) AS INT) AS position FROM t ORDER BY n_files DESC, inferred_type LIMIT 10",
    "sk2_csv": "SELECT CAST(row_id AS VARCHAR) AS \"Row\", coalesce(source_system, '') AS source_system, coalesce(array_to_string(segments, ' | '), '') AS \"Folders\", coalesce(CAST(depth AS VARCHAR), '') AS depth, coalesce(owner, '') AS owner, CASE dup_is_latest WHEN true THEN 'True' WHEN false THEN 'False' ELSE '' END AS dup_is_latest, '' AS absent FROM classified_files",
}
SQL["u8_pairs"] = SQL["u8_folders"].format(least=2, share=0.3)
SQL["u8_folders"] = SQL["u8_folders"].format(least=5, share=0.5)
