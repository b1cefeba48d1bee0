"""Aggregate reports over classified files. All are group-bys; lists in a report are sorted and of stated length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.text import is_noise_token, ngrams, tokenise, two_places
from estatelens.operators.ingest import BS


def most_frequent(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(by, out): the most frequent non-empty value per key, of equals the first in order."""
    counts = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("b")).select(by, F.col("b.v").alias(out))


def top_values(rows: DataFrame, by: str, value: str, n: int, out: str) -> DataFrame:
    """(by, out): the n most frequent non-empty values per key joined by " | ", by count, then value.

    Values are counted before they are ranked, so the window holds distinct values, not rows.
    """
    counts = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("c"), F.asc(value)))).filter(F.col("r") <= n)
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"]), " | ").alias(out))


def summary(files: DataFrame) -> DataFrame:
    """Per estate: files, bands, distinct types, clusters and duplicate groups."""
    return files.groupBy("source_system").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col("confidence_band") == b).alias(f"n_{b.lower()}") for b in ("High", "Medium", "Low")], F.count_distinct("inferred_type").alias("n_types"), F.count_distinct(F.nullif("dup_group_id", F.lit(""))).alias("n_dup_groups")
    )


def text_of(c: str) -> Column:
    """A value as text without surrounding blanks, null where nothing is left."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def path_to(entity: str) -> Column:
    """Folders down to the one that carries the entity, all folders where the depth is out of range; null without folders."""
    depth = F.coalesce(F.col(f"entity_{entity}_depth"), F.lit(-1))
    inside = (depth >= 0) & (depth < F.size("segments"))
    return F.when(F.size("segments") > 0, F.array_join(F.when(inside, F.slice("segments", F.lit(1), F.greatest(depth, F.lit(0)) + 1)).otherwise(F.col("segments")), BS))


def parent_of(path: Column) -> Column:
    """Name of the folder above a path's last one, (root) if there is none."""
    parts = F.split(path, r"\\")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit("(root)"))


def joined(values: Column, sep: str = "; ") -> Column:
    return F.coalesce(F.array_join(values, sep), F.lit(""))


def entity_report(files: DataFrame, entity: str, other: str, types: str = "inferred_type") -> DataFrame:
    """One row per cluster of an entity (files without cluster by value): canonical form, variants, files, mean confidence, usual depth,
    parent folder and path, schemes, the ``other`` entity (distinct number and the most frequent five), types, file names and paths.

    Canonical is the most frequent canonical form, or value where that is empty; lists of most frequent items are ordered by count, then value,
    other lists by value. Where ``raw_{entity}s`` exists, its values beside the canonical one are listed by count.
    All columns come from one combined count of (group, kind of item, item), so a hot group spreads over its items.
    """
    v, c = f"entity_{entity}", f"entity_{entity}_cluster_id"
    rows = files.filter(text_of(v).isNotNull()).withColumn("__g", F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.concat(F.lit("raw:"), v)))
    has = lambda name: F.col(name) if name in files.columns else F.lit(None).cast("string")
    best = lambda e: F.nullif(F.trim(F.coalesce(has(f"entity_{e}_canonical"), F.col(f"entity_{e}"))), F.lit(""))
    name = F.concat(F.coalesce("filename_stem", F.lit("")), F.when(F.coalesce("extension", F.lit("")) != "", F.concat(F.lit("."), "extension")).otherwise(""))
    items = {
        "canonical": has(f"entity_{entity}_canonical"), "variant": text_of(v), "depth": (F.coalesce(F.col(f"entity_{entity}_depth"), F.lit(-1)) + 1000).cast("string"),
        "path": path_to(entity), "scheme": best("scheme"), "other": best(other), "type": text_of(types), "name": F.nullif(F.trim(name), F.lit("")),
    }
    pairs = [F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x")) for k, x in items.items()])]
    if f"raw_{entity}s" in files.columns:
        pairs.append(F.transform(F.coalesce(F.col(f"raw_{entity}s"), F.array().cast(files.schema[f"raw_{entity}s"].dataType)), lambda m: F.struct(F.lit("raw").alias("k"), F.nullif(F.trim(m["value"]), F.lit("")).alias("x"))))
    counts = rows.select("__g", F.explode(F.filter(F.concat(*pairs), lambda p: p["x"].isNotNull())).alias("p")).groupBy("__g", "p.k", "p.x").agg(F.count(F.lit(1)).alias("n"))
    most = counts.withColumn("r", F.row_number().over(Window.partitionBy("__g", "k").orderBy(F.desc("n"), F.asc("x")))).filter("r <= 5")
    top = lambda k, n: F.array_sort(F.collect_list(F.when((F.col("k") == k) & (F.col("r") <= n), F.struct("r", "x", "n"))))
    tops = most.groupBy("__g").agg(*[top(k, n).alias(f"t_{k}") for k, n in (("canonical", 1), ("variant", 1), ("depth", 1), ("path", 5), ("other", 5), ("type", 3), ("name", 5))])
    every = lambda k: F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("x"))))
    raw = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == "raw", F.struct((-F.col("n")).alias("neg"), "x")))), lambda m: m["x"])
    lists = counts.filter(F.col("k").isin("variant", "scheme", "raw")).groupBy(F.col("__g").alias("__l")).agg(every("variant").alias("variants"), every("scheme").alias("schemes"), raw.alias("raws"))
    others = counts.filter("k = 'other'").groupBy(F.col("__g").alias("__o")).agg(F.count(F.lit(1)).alias("n_others"))
    facts = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("file_count"), two_places(F.avg(f"entity_{entity}_confidence")).alias("avg_confidence"))
    df = facts.join(tops, "__g").join(lists, F.col("__g") == F.col("__l")).join(others, F.col("__g") == F.col("__o"), "left")
    first = lambda k: F.try_element_at(f"t_{k}", F.lit(1))["x"]
    canonical = F.coalesce(F.nullif(F.trim(first("canonical")), F.lit("")), first("variant"))
    all_of = lambda k: joined(F.transform(f"t_{k}", lambda m: m["x"]))
    plural = other + ("es" if other.endswith("s") else "s")
    out = [
        canonical.alias(entity), F.size("variants").alias("variant_count"), "file_count", "avg_confidence", (first("depth").cast("int") - 1000).alias("typical_depth"), F.when(first("path").isNotNull(), parent_of(first("path"))).otherwise("").alias("parent_folder"),
        F.coalesce(first("path"), F.lit("")).alias("full_path"), joined(F.col("schemes")).alias("schemes"), F.coalesce("n_others", F.lit(0)).alias(f"unique_{plural}"), joined(F.transform("t_type", lambda m: F.concat(m["x"], F.lit(" ("), m["n"].cast("string"), F.lit(")")))).alias("top_types"),
        all_of("name").alias("sample_filenames"), all_of("path").alias("sample_full_paths"), all_of("other").alias(f"sample_{plural}"), F.when(F.size("variants") > 1, joined(F.col("variants"))).otherwise("").alias("all_variants"),
    ]
    if f"raw_{entity}s" in files.columns:
        out.append(joined(F.filter("raws", lambda x: F.lower(x) != F.lower(canonical))).alias(f"other_folder_{entity}{'es' if entity.endswith('s') else 's'}"))
    return df.select(*out)


def scheme_report(files: DataFrame, root_prefix: str = "", samples: int = 5) -> DataFrame:
    """One row per scheme path: name, confidence, depth, files, distinct assigned and raw plots and addresses, parent, path, and samples.

    ``raw_plots`` and ``raw_addresss`` are used where they exist. The first ``samples`` values in order are shown of the assigned ones, all of the raw ones.
    """
    rows = files.filter(F.coalesce("entity_scheme", F.lit("")) != "")
    own = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    firsts = [F.min("entity_scheme").alias("scheme_name"), F.max("entity_scheme_confidence").alias("confidence"), F.count(F.lit(1)).alias("file_count"), own("entity_plot").alias("plots"), own("entity_address").alias("addresses")]
    out = rows.groupBy("entity_scheme_path").agg(*firsts)
    for c, n in (("raw_plots", "rp"), ("raw_addresss", "ra")):
        if c in files.columns:
            raw = rows.select(F.col("entity_scheme_path").alias(f"__{n}"), F.explode(c).alias("m")).filter(F.coalesce("m.value", F.lit("")) != "").groupBy(f"__{n}").agg(F.array_sort(F.collect_set("m.value")).alias(n))
            out = out.join(raw, F.col("entity_scheme_path") == F.col(f"__{n}"), "left").drop(f"__{n}")
        else:
            out = out.withColumn(n, F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    out = out.withColumns({"rp": F.coalesce("rp", none), "ra": F.coalesce("ra", none)})
    parts = F.split("entity_scheme_path", r"\\")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), BS)).otherwise(F.lit("(root)"))
    whole = F.concat(F.lit(root_prefix.rstrip(BS) + BS if root_prefix else ""), "entity_scheme_path")
    return out.select(
        "scheme_name", "confidence", (F.size(parts) - 1).alias("depth"), "file_count", F.size("plots").alias("org_plots"), F.size("addresses").alias("org_addresses"), (F.size("plots") + F.size("addresses")).alias("org_total_entities"),
        F.size("rp").alias("raw_plot_count"), F.size("ra").alias("raw_address_count"), (F.size("rp") + F.size("ra")).alias("raw_total_entities"), parent.alias("parent_folder"), whole.alias("full_path"),
        joined(F.slice("plots", 1, samples)).alias("sample_org_plots"), joined(F.slice("addresses", 1, samples)).alias("sample_org_addresses"), joined(F.col("rp")).alias("all_raw_plots"), joined(F.col("ra")).alias("all_raw_addresses"),
    )


def decode_context(contexts: DataFrame, files: DataFrame, context: str = "entity_plot_cluster_context") -> DataFrame:
    """``contexts`` with ``linked_context``: the canonical scheme or address that a plot's context stands for; unknown ids stand for themselves."""
    def names(e: str) -> DataFrame:
        known = files.filter((F.coalesce(F.col(f"entity_{e}_cluster_id"), F.lit("")) != "") & (F.coalesce(F.col(f"entity_{e}_canonical"), F.lit("")) != ""))
        return known.groupBy(F.col(f"entity_{e}_cluster_id").alias(f"__{e}_id")).agg(F.min(f"entity_{e}_canonical").alias(f"__{e}"))

    c = F.coalesce(F.col(context), F.lit(""))
    address = F.when(F.startswith(c, F.lit("addr:")), F.substring(c, 6, 1 << 20))
    df = contexts.join(names("scheme"), c == F.col("__scheme_id"), "left").join(names("address"), address == F.col("__address_id"), "left")
    text = F.when(c == "", "").when(F.startswith(c, F.lit("__nocontext__")), "(isolated — no scheme/address context)").when(address.isNotNull(), F.concat(F.lit("address: "), F.coalesce("__address", address))).otherwise(F.concat(F.lit("scheme: "), F.coalesce("__scheme", c)))
    return df.withColumn("linked_context", text).drop("__scheme_id", "__scheme", "__address_id", "__address")


def cluster_report(files: DataFrame, entities: tuple[str, ...] = ("scheme", "address", "plot")) -> DataFrame:
    """Per cluster of each entity: canonical form, distinct variants, files, estates, folders, and for plots what their context stands for."""
    out = None
    for e in entities:
        c, v = f"entity_{e}_cluster_id", f"entity_{e}"
        rows = files.filter(F.coalesce(F.col(c), F.lit("")) != "").withColumn("__canonical", F.coalesce(F.col(f"entity_{e}_canonical"), F.lit("")) if f"entity_{e}_canonical" in files.columns else F.lit(""))
        context = F.min(F.nullif(F.col("entity_plot_cluster_context"), F.lit(""))) if e == "plot" and "entity_plot_cluster_context" in files.columns else F.lit(None).cast("string")
        facts = rows.groupBy(F.col(c).alias("cluster_id")).agg(
            F.count(F.lit(1)).alias("file_count"), F.count_distinct("source_system").alias("n_estates"), F.count_distinct(F.array_join("segments", BS)).alias("n_folders"),
            F.array_sort(F.collect_set(F.nullif(F.col(v), F.lit("")))).alias("values"), context.alias("entity_plot_cluster_context"),
        )
        named = most_frequent(rows, c, "__canonical", "canonical_form").withColumnRenamed(c, "__c")
        own = facts.join(named, F.col("cluster_id") == F.col("__c"), "left").select(F.lit(e).alias("entity_type"), "cluster_id", F.coalesce("canonical_form", F.lit("")).alias("canonical_form"), F.size("values").alias("variant_count"), "file_count", "n_estates", "n_folders", joined(F.col("values")).alias("variants"), "entity_plot_cluster_context")
        out = own if out is None else out.unionByName(own)
    return decode_context(out, files).drop("entity_plot_cluster_context")


def cluster_review(files: DataFrame, entity: str) -> DataFrame:
    """Files per cluster id, estate and folder."""
    c = f"entity_{entity}_cluster_id"
    return files.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy(c, "source_system", F.array_join("segments", BS).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"))


def version_clusters(files: DataFrame, cluster: str = "version_cluster_id", when: str = "last_modified") -> DataFrame:
    """Per version cluster: size, types, folders, span in years and anomaly flags. Nothing here makes the clusters; the column must exist."""
    rows = files.filter(F.coalesce(F.col(cluster), F.lit("")) != "")
    marked = F.lower("filename_stem").rlike(r"(^|[^a-z])(v|ver|version|rev)[ ._-]?\d+|draft|final")
    span = F.datediff(F.max(when), F.min(when)) / 365.25
    out = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("inferred_type").alias("n_types"), F.count_distinct(F.array_join("segments", BS)).alias("n_folders"), span.alias("span_years"), F.max(marked).alias("has_marker"))
    return out.withColumns({"oversized": F.col("n_files") > 20, "mixed_types": F.col("n_types") > 1, "no_version_markers": ~F.col("has_marker"), "long_span": F.coalesce(F.col("span_years") > 5, F.lit(False)), "single_folder": F.col("n_folders") == 1})


def coverage(files: DataFrame) -> DataFrame:
    """Share of files with each kind of finding."""
    def some(c: str) -> Column:
        return F.avg((F.coalesce(F.col(c), F.lit("")) != "").cast("int"))

    return files.agg(F.count(F.lit(1)).alias("n_files"), *[some(f"entity_{e}").alias(f"share_{e}") for e in ("scheme", "address", "plot")], *[some(f"entity_{e}_cluster_id").alias(f"share_{e}_cluster") for e in ("scheme", "address", "plot")], some("dup_group_id").alias("share_duplicate"))


def token_report(files: DataFrame, known: DataFrame, most: int = 3, stopwords: tuple[str, ...] = (), least_count: int = 1, least_projects: int = 1, unknown_only: bool = False) -> DataFrame:
    """Phrases of up to ``most`` words in folders and file names: counts, distinct first folders, known in the dictionary or not.

    Phrases are built from tokens that are no noise. The folder count of a phrase is per file, as file names are.
    """
    def phrases(c: Column) -> Column:
        kept = F.filter(tokenise(c), lambda t: ~is_noise_token(t, stopwords))
        return F.flatten(F.array(*[ngrams(kept, n) for n in range(1, most + 1)]))

    project = F.coalesce(F.try_element_at("segments", F.lit(1)), F.lit(""))
    chains = files.groupBy("segments", project.alias("project")).agg(F.count(F.lit(1)).alias("n")).filter(F.size("segments") > 0)
    in_folders = chains.select("project", "n", F.explode("segments").alias("s")).groupBy("project", "s").agg(F.sum("n").alias("n")).select("project", "n", F.explode(phrases(F.col("s"))).alias("term")).groupBy("term", "project").agg(F.sum("n").alias("folder_count"), F.lit(0).cast("bigint").alias("file_count"))
    in_names = files.select(project.alias("project"), F.explode(phrases(F.col("filename_stem"))).alias("term")).groupBy("term", "project").agg(F.lit(0).cast("bigint").alias("folder_count"), F.count(F.lit(1)).alias("file_count"))
    out = in_folders.unionByName(in_names).groupBy("term").agg(F.sum("folder_count").alias("folder_count"), F.sum("file_count").alias("file_count"), F.count_distinct("project").alias("n_projects"))
    out = out.join(known.withColumn("is_known", F.lit(True)), "term", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    out = out.filter((F.col("folder_count") + F.col("file_count") >= least_count) & (F.col("n_projects") >= least_projects))
    return out.filter(~F.col("is_known")) if unknown_only else out


def entity_types(entities: tuple[str, ...] = ("scheme", "address", "plot")) -> Column:
    """Names of the entities that a row has, joined by ", "."""
    return F.concat_ws(", ", *[F.when(F.coalesce(F.col(f"entity_{e}"), F.lit("")) != "", e) for e in entities])


def scheme_summary(files: DataFrame, confidence: str = "overall_confidence") -> DataFrame:
    """Mean, median, least and greatest confidence of files with and without scheme."""
    return files.groupBy((F.coalesce("entity_scheme", F.lit("")) != "").alias("in_scheme")).agg(F.count(F.lit(1)).alias("n_files"), F.avg(confidence).alias("mean"), F.percentile(confidence, F.lit(0.5)).alias("median"), F.min(confidence).alias("least"), F.max(confidence).alias("greatest"))


def entity_overlap(files: DataFrame) -> DataFrame:
    """(same, n_files): files with a scheme and an address, by whether the two are the same text."""
    both = files.filter((F.coalesce("entity_scheme", F.lit("")) != "") & (F.coalesce("entity_address", F.lit("")) != ""))
    return both.groupBy((F.col("entity_scheme") == F.col("entity_address")).alias("same")).agg(F.count(F.lit(1)).alias("n_files"))


def top_rows(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n rows with the greatest ``by``, numbered from 1 in ``position``."""
    best = df.orderBy(F.desc(by), F.asc(tie)).limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc(by), F.asc(tie))))  # n rows
