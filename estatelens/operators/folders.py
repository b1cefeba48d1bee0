"""Folder-tree roll-ups and detection of schemes (named sites) in the tree.

One folder dimension serves all: per distinct folder chain and entity values the files are
counted first, and only these counts are exploded to the prefixes of the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.config import Config
from estatelens.functions.text import UNICODE, tokenise, two_places
from estatelens.operators.ingest import BS
from estatelens.operators.matching import category_hits, place_texts, texts_of, trigger_words, type_hits
from estatelens.session import cut


def prefixes(segments: Column) -> Column:
    """(level, path) of every folder of a chain, from 1 on."""
    return F.transform(F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(segments, F.lit(1), i), BS).alias("path")))


def folder_stats(files: DataFrame) -> DataFrame:
    """Per folder: file_count, distinct plots and addresses beneath, whether plots lie directly beneath.

    ``files`` has segments and entity_plot / entity_address with depths (from 0; -1 for none).
    Entities are compared as they stand; the empty string is none.
    """
    counted = files.groupBy("segments", "entity_plot", "entity_plot_depth", "entity_address", "entity_address_depth").agg(F.count(F.lit(1)).alias("n"))
    at = counted.withColumn("f", F.explode(prefixes(F.col("segments"))))
    # an entity of a file counts for every folder of the file's chain
    plot, address = F.when(F.col("entity_plot") != "", F.col("entity_plot")), F.when(F.col("entity_address") != "", F.col("entity_address"))
    direct = F.coalesce(F.max(F.when(plot.isNotNull() & (F.col("entity_plot_depth") == F.col("f.level")), 1)), F.lit(0))
    return at.groupBy(F.col("f.path").alias("folder_path"), F.col("f.level").alias("level")).agg(
        F.sum("n").alias("file_count"), F.count_distinct(plot).alias("n_plots"), F.count_distinct(address).alias("n_addresses"), direct.alias("direct_plot_children")
    ).withColumns({"name": F.element_at(F.split("folder_path", r"\\"), -1), "parent_path": F.when(F.col("level") > 1, F.substring("folder_path", F.lit(1), F.length("folder_path") - F.length(F.element_at(F.split("folder_path", r"\\"), -1)) - 1))})


def category_propagation(folders: DataFrame, categories: DataFrame, config: Config) -> DataFrame:
    """folder_path with its set of scheme-signal categories and the number of children that have one.

    A folder's categories count for the folder and for all above it.
    """
    signals = [c.name for c in config.categories if c.scheme_signal]
    own = folders.join(categories.filter(F.col("label").isin(*signals) if signals else F.lit(False)).select(F.col("text").alias("name"), "label"), "name").select("folder_path", "parent_path", "label")
    chain = own.withColumn("f", F.explode(prefixes(F.split("folder_path", r"\\"))))
    sets = chain.groupBy(F.col("f.path").alias("folder_path")).agg(F.collect_set("label").alias("dev_categories"))
    children = own.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("folder_path")).agg(F.count_distinct("folder_path").alias("direct_category_children"))
    return sets.join(children, "folder_path", "full")


def direct_children(folders: DataFrame) -> DataFrame:
    return folders.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("folder_path")).agg(F.count(F.lit(1)).alias("total_direct_children"))


def organisational_names(names: DataFrame, config: Config, types: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, is_organisational, is_place) of distinct folder names (name): named for a category or type, not for a place.

    For names of four and more words, category aliases and single-word phrases of base-layer types do not count.
    """
    words = F.filter(tokenise(F.col("name")), lambda t: t.rlike("[A-Za-z0-9]"))
    long_name = F.size(words) >= 4
    cats = categories.groupBy(F.col("text").alias("c_text")).agg(F.max(F.when(F.col("priority") == 1, 1).otherwise(0)).alias("c_phrase"))
    kinds = types.groupBy(F.col("text").alias("t_text")).agg(F.max(F.when((F.col("layer") > 0) | (F.col("priority") != 1) | F.contains("term", F.lit(" ")), 1).otherwise(0)).alias("t_strong"))
    joined = names.join(cats, F.col("name") == F.col("c_text"), "left").join(kinds, F.col("name") == F.col("t_text"), "left")
    by_category = F.col("c_text").isNotNull() & (~long_name | (F.col("c_phrase") == 1))
    by_type = F.col("t_text").isNotNull() & (~long_name | (F.col("t_strong") == 1))
    if config.place_names:
        places = place_texts(names.select(F.col("name").alias("text"), tokenise(F.col("name")).alias("tokens")), config.place_names)
        joined = joined.join(places.select(F.col("text").alias("p_text")), F.col("name") == F.col("p_text"), "left").withColumn("is_place", F.col("p_text").isNotNull())
    else:
        joined = joined.withColumn("is_place", F.lit(False))
    return joined.select("name", (~F.col("is_place") & (by_category | by_type)).alias("is_organisational"), "is_place")


_UNIT = r"(?iuU)^\s*(?:plots?|flats?|units?|apts?|apartments?)[\s._-]*\d+"


def entity_only_name(name: Column, config: Config, most: int = 3) -> Column:
    """A name that is nothing but a plot: by pattern if long, by a plot term (but no phase or block) if short."""
    tokens = tokenise(name)
    plot = config.entity("plot")
    terms = F.array(*[F.lit(t) for t in sorted(trigger_words(plot))]).cast("array<string>")
    pattern = F.lit(False)
    for p in plot.patterns:
        pattern = pattern | name.rlike(UNICODE + p)
    grouped = F.lower(name).rlike("phase|block")
    return F.when(F.size(tokens) > most, name.rlike(_UNIT)).otherwise((F.arrays_overlap(tokens, terms) | pattern) & ~grouped)


def excluded_by_config(name: Column, config: Config) -> Column:
    """Excluded exactly (also without a leading number), by a part, or by a pattern."""
    ex, low = config.exclusions, F.lower(F.trim(name))
    bare = F.regexp_replace(low, r"^\d+[\s._-]*", "")
    out = F.lit(False)
    if ex.names:
        out = out | low.isin(*ex.names) | bare.isin(*ex.names)
    for s in ex.substrings:
        out = out | F.contains(low, F.lit(s))
    for p in ex.patterns:
        out = out | name.rlike(UNICODE + p)
    return out


def address_like(name: Column, config: Config) -> Column:
    a = config.entity("address")
    terms = F.array(*[F.lit(t) for t in sorted({*a.tokens, *a.abbreviations})]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(tokenise(name), terms), F.lit(False))


def scheme_candidates(files: DataFrame, config: Config, hits: dict[str, DataFrame] | None = None) -> DataFrame:
    """Folders that pass the structural gate, with all facts and the first reason that excludes them (null: none)."""
    least = int(config.weight("scheme_detection", "min_entities"))
    folders = cut(folder_stats(files))
    names = folders.select("name").distinct()
    if hits is None:
        texts = texts_of((names, F.col("name")))
        hits = {"folder_types": cut(type_hits(texts, config)), "categories": cut(category_hits(texts, config))}
    cats = category_propagation(folders, hits["categories"], config)
    organised = cut(organisational_names(names, config, hits["folder_types"], hits["categories"]))
    df = folders.join(cats, "folder_path", "left").join(direct_children(folders), "folder_path", "left").join(organised, "name", "left")
    df = df.withColumns(
        {
            "unique_entities": F.col("n_plots") + F.col("n_addresses"),
            "n_dev_categories": F.when(F.col("dev_categories").isNull(), 0).otherwise(F.size("dev_categories")),
            "direct_category_children": F.coalesce("direct_category_children", F.lit(0)),
            "total_direct_children": F.coalesce("total_direct_children", F.lit(0)),
        }
    )
    gate = (F.col("unique_entities") >= least) | ((F.col("unique_entities") >= 1) & (F.col("n_dev_categories") >= 3)) | (F.col("n_dev_categories") >= 4)
    blockers = folders.join(organised.filter("is_organisational").select("name"), "name", "left_semi").filter("direct_plot_children = 0").select(F.col("folder_path").alias("above"))
    gated = df.filter(gate)
    above = F.filter(prefixes(F.split("folder_path", r"\\")), lambda p: p["level"] < F.col("level"))
    nested = gated.select("folder_path", F.explode(above).alias("p")).join(blockers, F.col("p.path") == F.col("above")).select(F.col("folder_path").alias("nested_path")).distinct()
    gated = gated.join(nested, F.col("folder_path") == F.col("nested_path"), "left")
    reason = (
        F.when(F.length(F.trim("name")) < int(config.weight("scheme_detection", "min_scheme_name_length")), "too_short")
        .when(excluded_by_config(F.col("name"), config), "cfg_excl")
        .when(F.col("is_organisational"), "cat_folder")
        .when(F.col("nested_path").isNotNull(), "nested")
        .when(entity_only_name(F.col("name"), config, int(config.weight("scheme_detection", "max_entity_only_tokens"))), "entity_only")
    )
    if config.place_names:
        reason = reason.when(~(F.col("is_place") | address_like(F.col("name"), config)), "no_location")
    return gated.withColumn("excluded_by", reason).drop("nested_path", "is_organisational", "is_place")


def score_schemes(candidates: DataFrame, config: Config, root_depth: int = -1) -> DataFrame:
    """Confidence of the open candidates and what becomes of each: ``status`` chosen, structural, sub_container, container, subsumed or root."""
    w = lambda k: float(config.weight("scheme_detection", k))
    open_ = candidates.filter("excluded_by IS NULL")
    kids = open_.groupBy(F.col("parent_path").alias("k_path")).agg(F.count(F.lit(1)).alias("child_candidates"))
    df = open_.join(kids, F.col("folder_path") == F.col("k_path"), "left").drop("k_path").withColumn("child_candidates", F.coalesce("child_candidates", F.lit(0)))
    score = F.when(F.col("unique_entities") >= w("high_entity_threshold"), w("high_entity_confidence")).otherwise(w("med_entity_confidence"))
    score = score + F.when(F.col("direct_plot_children") > 0, w("direct_plot_children_boost")).otherwise(0.0) + F.when(F.col("n_dev_categories") >= 3, w("development_categories_boost")).otherwise(0.0)
    n, total = F.col("child_candidates"), F.col("total_direct_children")
    first = F.when(F.col("level") - 1 <= root_depth, "root").when((n >= 3) & (total > 0) & (n / total > 0.5), "structural").when((n >= 1) & (F.col("direct_category_children") == 0) & (F.col("direct_plot_children") == 0) & (total == n), "sub_container")
    df = cut(df.withColumns({"confidence": F.round(F.least(F.lit(1.0), score), 3), "first_status": first, "depth": F.col("level") - 1}))
    # parents against children, decided for all on the scored set
    scored = df.filter("first_status IS NULL")
    child = scored.select(F.col("parent_path").alias("pp"), F.col("folder_path").alias("child_path"), F.col("confidence").alias("cc"))
    parent = scored.select(F.col("folder_path").alias("pp"), F.col("confidence").alias("pc"), ((F.col("direct_category_children") > 0) | (F.col("direct_plot_children") > 0)).alias("structured"))
    quality = F.col("cc") > w("sibling_quality_threshold")
    verdict = child.join(parent, "pp").groupBy("pp", "structured").agg(F.count_if(quality).alias("nq"), F.max(quality & (F.col("cc") > F.col("pc"))).alias("higher"))
    verdict = verdict.withColumn("fate", F.when(F.col("higher") | (F.col("nq") >= 3), "container").when((F.col("nq") > 0) & F.col("structured"), "keeps").when(F.col("nq") > 0, "container"))
    containers = verdict.filter("fate = 'container'").select(F.col("pp").alias("c_path"))
    keepers = verdict.filter("fate = 'keeps'").select(F.col("pp").alias("s_parent"))
    out = df.join(containers, F.col("folder_path") == F.col("c_path"), "left").join(keepers, F.col("parent_path") == F.col("s_parent"), "left")
    status = F.coalesce(F.col("first_status"), F.when(F.col("c_path").isNotNull(), "container").when(F.col("s_parent").isNotNull(), "subsumed").otherwise("chosen"))
    return out.withColumn("status", status).drop("first_status", "c_path", "s_parent")


def merge_same_names(schemes: DataFrame) -> DataFrame:
    """Chosen schemes by folder; folders of one name all take value, confidence, depth and path of the best (most confident, shallowest, first path)."""
    chosen = schemes.filter("status = 'chosen'")
    best = chosen.groupBy("name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "depth", "folder_path")).alias("b"))
    return chosen.select("folder_path", "name").join(best, "name").select(F.col("folder_path").alias("at_path"), F.col("name").alias("value"), (-F.col("b.c")).alias("confidence"), F.col("b.depth").alias("depth"), F.col("b.folder_path").alias("scheme_path"))


def assign_schemes(files: DataFrame, merged: DataFrame) -> DataFrame:
    """``files`` with the shallowest scheme above: entity_scheme ("" if none), _confidence, _path, _depth."""
    chains = files.select("segments").distinct()
    met = chains.select("segments", F.explode(prefixes(F.col("segments"))).alias("f")).join(merged, F.col("f.path") == F.col("at_path"))
    top = met.groupBy(F.col("segments").alias("__s")).agg(F.min(F.struct(F.col("f.level").alias("l"), "value", "confidence", "depth", "scheme_path")).alias("b"))
    out = files.join(top, files["segments"] == F.col("__s"), "left")
    return out.withColumns({"entity_scheme": F.coalesce("b.value", F.lit("")), "entity_scheme_confidence": F.coalesce("b.confidence", F.lit(0.0)), "entity_scheme_path": F.coalesce("b.scheme_path", F.lit("")), "entity_scheme_depth": F.coalesce("b.depth", F.lit(-1))}).drop("__s", "b")


def detect_schemes(files: DataFrame, config: Config, hits: dict[str, DataFrame] | None = None, root_depth: int = -1) -> tuple[DataFrame, DataFrame]:
    """(files with schemes, sidecar of all candidates with their status)."""
    candidates = cut(scheme_candidates(files, config, hits))
    schemes = cut(score_schemes(candidates, config, root_depth))
    sidecar = schemes.select("folder_path", "name", "confidence", "depth", "status", "unique_entities", "n_dev_categories", "direct_plot_children", "direct_category_children").unionByName(
        candidates.filter("excluded_by IS NOT NULL").select("folder_path", "name", F.lit(0.0).alias("confidence"), F.col("level").alias("depth"), F.col("excluded_by").alias("status"), "unique_entities", "n_dev_categories", "direct_plot_children", "direct_category_children")
    )
    return assign_schemes(files, merge_same_names(schemes)), sidecar


def enforce_hierarchy(files: DataFrame) -> DataFrame:
    """Clears plots and addresses at or above the scheme's depth, then addresses above a plot; flags those that were the scheme's name."""
    scheme = (F.col("entity_scheme") != "") & (F.col("entity_scheme_depth") >= 0)
    df = files
    for e in ("plot", "address"):
        out = scheme & (F.col(f"entity_{e}") != "") & (F.col(f"entity_{e}_depth") <= F.col("entity_scheme_depth"))
        df = df.withColumn("__out", out).withColumns(
            {
                f"entity_{e}_is_scheme_name": F.col("__out") & (F.col(f"entity_{e}") == F.col("entity_scheme")),
                f"entity_{e}": F.when(F.col("__out"), "").otherwise(F.col(f"entity_{e}")),
                f"entity_{e}_confidence": F.when(F.col("__out"), 0.0).otherwise(F.col(f"entity_{e}_confidence")),
                f"entity_{e}_depth": F.when(F.col("__out"), -1).otherwise(F.col(f"entity_{e}_depth")),
            }
        ).drop("__out")
    above = (F.col("entity_plot") != "") & (F.col("entity_plot_depth") >= 0) & (F.col("entity_address") != "") & (F.col("entity_address_depth") >= 0) & (F.col("entity_plot_depth") > F.col("entity_address_depth"))
    return df.withColumn("__out", above).withColumns({"entity_address": F.when(F.col("__out"), "").otherwise(F.col("entity_address")), "entity_address_confidence": F.when(F.col("__out"), 0.0).otherwise(F.col("entity_address_confidence")), "entity_address_depth": F.when(F.col("__out"), -1).otherwise(F.col("entity_address_depth"))}).drop("__out")


# folder reports


def leaf_folders(files: DataFrame) -> DataFrame:
    """(folder_path) of folders beneath which no other folder lies, by definition of the tree."""
    folders = files.filter(F.size("segments") > 0).select("segments").distinct().select(F.explode(prefixes(F.col("segments"))).alias("f")).select("f.path", "f.level").distinct()
    parents = folders.filter("level > 1").select(F.regexp_replace("path", r"\\[^\\]*$", "").alias("parent")).distinct()
    return folders.join(parents, F.col("path") == F.col("parent"), "left_anti").select(F.col("path").alias("folder_path"))


def folder_tree(files: DataFrame, most: int = 4, entities: tuple[str, ...] = ("scheme", "plot", "address")) -> DataFrame:
    """Folders of level 2 to ``most`` with their files and mean confidence and, per entity: whether the folder is the one that carries it,
    the name (of the nearest such folder at or above), mean confidence and number of the files that have it from there, and the kinds of entity.

    A folder's own name of an entity is the most frequent one, of equals the first in order.
    """
    chains = files.groupBy("segments").agg(F.count(F.lit(1)).alias("n"), F.sum("overall_confidence").alias("c"), F.count("overall_confidence").alias("k"))
    at = chains.withColumn("f", F.explode(prefixes(F.col("segments"))))
    folders = cut(at.groupBy(F.col("f.path").alias("folder_path"), F.col("f.level").alias("level")).agg(F.sum("n").alias("file_count"), (F.sum("c") / F.sum("k")).alias("mean_confidence")))
    out = folders.filter(F.col("level").between(2, most))
    above = cut(out.select("folder_path", F.explode(prefixes(F.split("folder_path", r"\\"))).alias("f")))
    kinds = []
    for e in entities:
        value, depth, sure = F.col(f"entity_{e}"), F.col(f"entity_{e}_depth"), f"entity_{e}_confidence"
        own = files.filter((value != "") & (depth >= 0) & (depth < F.size("segments"))).groupBy(F.array_join(F.slice("segments", F.lit(1), F.greatest(depth, F.lit(0)) + 1), BS).alias("at"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(sure).alias("c"))
        best = cut(own.groupBy("at").agg(F.min(F.struct((-F.col("n")).alias("neg"), "v")).alias("b"), F.sum("n").alias(f"{e}_file_count"), two_places(F.sum("c") / F.sum("n")).alias(f"{e}_confidence")).withColumn("v", F.col("b.v")).drop("b"))
        nearest = above.join(best.select(F.col("at").alias("n_at"), "v"), F.col("f.path") == F.col("n_at")).groupBy(F.col("folder_path").alias("u")).agg(F.max(F.struct("f.level", "v")).alias("b")).select("u", F.col("b.v").alias(f"{e}_name"))
        out = out.join(best.drop("v"), F.col("folder_path") == F.col("at"), "left").join(nearest, F.col("folder_path") == F.col("u"), "left")
        out = out.withColumns({f"is_{e}": F.col("at").isNotNull(), f"{e}_name": F.coalesce(f"{e}_name", F.lit("")), f"{e}_file_count": F.coalesce(f"{e}_file_count", F.lit(0))}).drop("at", "u")
        kinds.append(F.when(F.col(f"is_{e}"), e))
    return out.withColumn("entity_types", F.concat_ws(", ", *kinds))


def leaf_conflicts(files: DataFrame, entities: tuple[str, ...] = ("plot", "address", "scheme")) -> DataFrame:
    """Per leaf of the display paths (folders without the last one): files, and per entity the most frequent value with its share k/n, mean
    confidence (of those above 0), files that have one, distinct values, the list of values and whether they conflict. Of equals the first in order is taken."""
    shown = files.filter(F.size("segments") >= 2).withColumn("__s", F.slice("segments", F.lit(1), F.size("segments") - 1))
    leaves = leaf_folders(shown.select(F.col("__s").alias("segments")))
    rows = shown.withColumn("__path", F.array_join("__s", BS)).join(leaves, F.col("__path") == F.col("folder_path"), "left_semi")
    out = rows.groupBy(F.col("__path").alias("folder_path")).agg(F.count(F.lit(1)).alias("n_files"))
    for e in entities:
        v, c = F.trim(F.col(f"entity_{e}")), F.col(f"entity_{e}_confidence")
        counted = rows.filter(F.coalesce(v, F.lit("")) != "").groupBy(F.col("__path").alias("at"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(c > 0, c)).alias("c"), F.count_if(c > 0).alias("k"))
        facts = counted.groupBy("at").agg(F.min(F.struct((-F.col("n")).alias("neg"), "v")).alias("b"), F.sum("n").alias(f"{e}_count"), F.count(F.lit(1)).alias(f"{e}_distinct"), F.array_join(F.array_sort(F.collect_list("v")), "; ").alias(f"{e}_values"), two_places(F.sum("c") / F.sum("k")).alias(f"{e}_confidence"))
        facts = facts.withColumns({f"{e}_selected": F.col("b.v"), f"{e}_share": F.concat((-F.col("b.neg")).cast("string"), F.lit("/"), F.col(f"{e}_count").cast("string"))}).drop("b")
        out = out.join(facts, F.col("folder_path") == F.col("at"), "left").drop("at")
        out = out.withColumns({f"{e}_conflict": F.coalesce(F.col(f"{e}_distinct") > 1, F.lit(False)), **{k: F.coalesce(k, F.lit(0)) for k in (f"{e}_count", f"{e}_distinct")}, **{k: F.coalesce(k, F.lit("")) for k in (f"{e}_values", f"{e}_selected", f"{e}_share")}})
    return out


def score_trace(sidecar: DataFrame, config: Config) -> DataFrame:
    """``sidecar`` with the terms of the confidence spelt out in ``trace``; excluded folders show their reason."""
    w = lambda k: float(config.weight("scheme_detection", k))
    high = F.col("unique_entities") >= w("high_entity_threshold")
    base = F.format_string("entities %d: %.2f", F.col("unique_entities"), F.when(high, w("high_entity_confidence")).otherwise(w("med_entity_confidence")))
    plots = F.when(F.col("direct_plot_children") > 0, F.format_string("plots beneath: +%.2f", F.lit(w("direct_plot_children_boost"))))
    categories = F.when(F.col("n_dev_categories") >= 3, F.format_string("categories %d: +%.2f", F.col("n_dev_categories"), F.lit(w("development_categories_boost"))))
    return sidecar.withColumn("trace", F.concat_ws("; ", base, plots, categories, F.format_string("status %s", F.col("status"))))


def sidecar_join(tree: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Folders of a report with the candidate status of the sidecar."""
    return tree.join(sidecar.select("folder_path", F.col("status").alias("scheme_status"), F.col("confidence").alias("scheme_confidence")), "folder_path", "left")
