"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.addresses import place_groups, same_place_pairs
from estatelens.llm.components import match_groups
from estatelens.llm.encode import load_vocabulary, token_count, token_ids
from estatelens.llm.formatting import copies
from estatelens.llm.mixing import due_tokens, mix
from estatelens.llm.mojibake import affected, learn, restored
from estatelens.llm.setjoin import link_counts, similar_pairs, word_set
from estatelens.llm.survivors import ABSENT, LAST, RANKS, STAND_INS, field_sources, survivors, survivors_by_arrival
from estatelens.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Row that gives the best known value of each field of each group of copies."""
    return field_sources(table(spark, d, "classified_files"), table(spark, d, "estates"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per group, built from whole bundles."""
    return survivors(table(spark, d, "classified_files"), table(spark, d, "estates"))


def p3_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Address and scheme of the surviving record per group where the row loaded last is the best."""
    return survivors_by_arrival(table(spark, d, "classified_files")).select("dup_group_id", "n_rows", "entity_scheme", "entity_scheme_row_id", "entity_address", "entity_address_canonical", "entity_address_row_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records written at least twice, with their number of copies."""
    return copies(table(spark, d, "jsonl_lines"))


def _path_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_paths").select(F.col("path_id").alias("id"), word_set(F.col("segments"), F.col("filename_stem")).alias("tokens"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of paths whose term sets have a Jaccard similarity of at least 0.7."""
    return similar_pairs(_path_sets(spark, d), 7, 10).select(F.col("id_a").alias("path_id_a"), F.col("id_b").alias("path_id_b"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Class of equal sets of every path and the number of other classes that are similar to it."""
    return link_counts(_path_sets(spark, d), 7, 10).select(F.col("id").alias("path_id"), "class_id", "n_links")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of address rows that denote the same place."""
    return same_place_pairs(table(spark, d, "address_rows")).select(F.col("id_a").alias("addr_id_a"), F.col("id_b").alias("addr_id_b"))


def p6_places(spark: SparkSession, d: str) -> DataFrame:
    """Place of every address row."""
    return place_groups(table(spark, d, "address_rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Group of every cluster id that a true match joins to another."""
    return match_groups(table(spark, d, "cluster_links"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return table(spark, d, "documents").select("doc_id", token_ids(F.col("text"), load_vocabulary(spark)).alias("ids"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text"), load_vocabulary(spark)).alias("n_tokens"))


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents with repeats, in the order of the mixing schedule's slots."""
    return mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual against target shares."""
    return mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


def p9_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Actual against target shares where the mix is as large as all documents of the target sources."""
    return mix(_sized(spark, d), table(spark, d, "mix_targets"), total="corpus")[1]


def p9_due(spark: SparkSession, d: str) -> DataFrame:
    """What each source is due by default, by characters."""
    sizes = table(spark, d, "documents").select("source", F.col("n_chars").alias("n"))
    return due_tokens(sizes, table(spark, d, "mix_targets")).withColumn("due", F.round("due", 3))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that went through wrong decodings, with the digest of their original text."""
    return affected(table(spark, d, "documents").select("doc_id", "text", "source"))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Original texts of the affected documents."""
    documents = table(spark, d, "documents").select("doc_id", "text", "source")
    return restored(documents, learn(documents))


QUERIES = {"p3_found": p3_found, "p3_survivors": p3_survivors, "p3_arrivals": p3_arrivals, "p4_found": p4_found, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_places": p6_places, "p7_found": p7_found, "p8_ids": p8_ids, "p9_schedule": p9_schedule, "p9_shares": p9_shares, "p9_corpus": p9_corpus, "p9_due": p9_due, "p10_found": p10_found, "p10_texts": p10_texts}

_USABLE = "CASE WHEN lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) NOT IN ('', " + ", ".join(f"'{w}'" for w in STAND_INS) + ") THEN {c} END"
_SETS = r"""w AS (SELECT path_id, trim(lower(unnest(segments))) AS t FROM file_paths UNION SELECT path_id, unnest(regexp_extract_all(lower(filename_stem), '[\p{L}\p{N}]+')) FROM file_paths)"""

SQL = {
    "p3_arrivals": f"""
        WITH r AS (SELECT dup_group_id AS g, row_id, coalesce(-epoch_us(loaded_at), {LAST})::HUGEINT AS o, {_USABLE.format(c="entity_scheme")} AS s, {_USABLE.format(c="entity_address")} AS a, entity_address_canonical AS ac FROM classified_files WHERE dup_group_id <> ''),
        n AS (SELECT g, count(*) AS n_rows FROM r GROUP BY g HAVING count(*) > 1),
        sc AS (SELECT *, (o - min(o) OVER (PARTITION BY g)) * {RANKS} AS loss FROM (SELECT * FROM r WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, s ORDER BY o, row_id) = 1)),
        ad AS (SELECT *, (o - min(o) OVER (PARTITION BY g)) * {RANKS} AS loss FROM (SELECT * FROM r WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, a ORDER BY o, row_id) = 1)),
        f AS (SELECT g, a, s FROM r WHERE a IS NOT NULL AND s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g, a ORDER BY o, row_id) = 1),
        gap AS (SELECT g, CASE WHEN g IN (SELECT g FROM sc) THEN {ABSENT}::HUGEINT ELSE 0 END AS no_s, CASE WHEN g IN (SELECT g FROM ad) THEN {ABSENT}::HUGEINT ELSE 0 END AS no_a FROM n),
        c AS (SELECT ad.g, ad.loss + sc.loss AS loss, ad.row_id AS ar, sc.row_id AS sr, sc.s, ad.a, ad.ac FROM ad JOIN f ON f.g = ad.g AND f.a = ad.a JOIN sc ON sc.g = f.g AND sc.s = f.s
              UNION ALL SELECT ad.g, loss + no_s, row_id, NULL, NULL, a, ac FROM ad JOIN gap ON gap.g = ad.g
              UNION ALL SELECT sc.g, loss + no_a, NULL, row_id, s, NULL, NULL FROM sc JOIN gap ON gap.g = sc.g
              UNION ALL SELECT g, no_s + no_a, NULL, NULL, NULL, NULL, NULL FROM gap)
        SELECT c.g AS dup_group_id, n_rows, s AS entity_scheme, sr AS entity_scheme_row_id, a AS entity_address, ac AS entity_address_canonical, ar AS entity_address_row_id FROM c JOIN n ON n.g = c.g
        QUALIFY row_number() OVER (PARTITION BY c.g ORDER BY loss, coalesce(ar, {LAST}), coalesce(sr, {LAST})) = 1""",
    "p9_due": """
        WITH s AS (SELECT source, sum(n_chars) AS n FROM documents WHERE n_chars > 0 GROUP BY 1), r AS (SELECT t.source, coalesce(n, 0) AS n, target_share, target_share > 0 AND max_repeats > 0 AND n IS NOT NULL AS live, n * max_repeats / target_share AS most FROM mix_targets t LEFT JOIN s USING (source))
        SELECT source, n::BIGINT AS available, round(CASE WHEN live THEN target_share * (SELECT min(most) FROM r WHERE live) ELSE 0 END, 3) AS due FROM r""",
    "p5_links": f"""
        WITH {_SETS},
        k AS (SELECT path_id, list_sort(list(t)) AS s FROM w WHERE t <> '' GROUP BY 1), c AS (SELECT s, min(path_id) AS c FROM k GROUP BY 1),
        e AS (SELECT c, unnest(s) AS t, len(s) AS n FROM c),
        i AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))),
        l AS (SELECT a, count(*) AS n FROM i GROUP BY a)
        SELECT p.path_id, c.c AS class_id, coalesce(l.n, 0) AS n_links FROM file_paths p LEFT JOIN k ON k.path_id = p.path_id LEFT JOIN c ON c.s = k.s LEFT JOIN l ON l.a = c.c""",
    "p7_found": """
        WITH RECURSIVE e AS (
          SELECT DISTINCT lower(trim(left_cluster_id)) AS a, lower(trim(right_cluster_id)) AS b FROM cluster_links
          WHERE is_match AND trim(left_cluster_id) <> '' AND trim(right_cluster_id) <> '' AND lower(trim(left_cluster_id)) <> lower(trim(right_cluster_id))),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(id, seen) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.seen = s.a)
        SELECT id AS cluster_id, min(seen) AS group_id FROM r GROUP BY id""",
    "p4_found": r"""
        WITH j AS (SELECT line_id, CAST(line AS JSON) AS o FROM jsonl_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'),
        k AS (SELECT line_id, [regexp_replace(lower(nfc_normalize(coalesce(o ->> f, ''))), '[^\p{L}\p{Nd}]', '', 'g') FOR f IN ['filename_stem', 'extension', 'normalized_filename', 'size']] AS c FROM j)
        SELECT min(line_id) AS first_line_id, count(*) AS n_copies FROM k GROUP BY c HAVING count(*) > 1""",
    "p5_found": r"""
        WITH w AS (SELECT path_id, trim(lower(unnest(segments))) AS t FROM file_paths UNION SELECT path_id, unnest(regexp_extract_all(lower(filename_stem), '[\p{L}\p{N}]+')) FROM file_paths),
        s AS (SELECT * FROM w WHERE t <> ''), n AS (SELECT path_id, count(*) AS n FROM s GROUP BY 1),
        i AS (SELECT a.path_id AS a, b.path_id AS b, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.path_id < b.path_id GROUP BY 1, 2)
        SELECT a AS path_id_a, b AS path_id_b FROM i JOIN n x ON x.path_id = a JOIN n y ON y.path_id = b WHERE 10 * i >= 7 * (x.n + y.n - i)""",
}
