"""Entity clusters: pools of folder values, similar values linked, canonical names and ids, assignment and backfill.

The number of the cluster is its place by size (descending) and canonical name; it is taken over the
clusters themselves, after all rows were aggregated to distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import normalise_value
from estatelens.operators.ingest import BS
from estatelens.operators.similarity import group_links, linked_groups, scheme_overlaps
from estatelens.session import cut, numbered, release

#: Prefixes of cluster ids.
PREFIXES = {"address": "addr", "scheme": "schm", "plot": "plot"}


def value_pool(files: DataFrame, entity: str, order: str = "row_id") -> DataFrame:
    """(value, count): normalised values with one vote per folder that carries them, or the number of files, if greater.

    Folders of equal path in several estates are one. In a folder the first file (by ``order``) votes; files without
    depth vote by value.
    """
    raw = f"extracted_{entity}s" if f"extracted_{entity}s" in files.columns else None
    column = f"entity_{entity}_extracted" if f"entity_{entity}_extracted" in files.columns else f"entity_{entity}"
    depth = f"entity_{entity}_depth"
    if raw:
        votes = files.select(F.col(order).alias("o"), "segments", F.explode(raw).alias("m")).select("o", "segments", normalise_value(F.coalesce(F.nullif(F.col("m.extracted"), F.lit("")), F.col("m.value"))).alias("value"), F.col("m.depth").alias("depth"))
    else:
        votes = files.select(F.col(order).alias("o"), "segments", normalise_value(F.col(column)).alias("value"), F.col(depth).alias("depth"))
    place = F.when(F.coalesce("depth", F.lit(-1)) >= 0, F.array_join(F.slice("segments", F.lit(1), F.greatest(F.col("depth"), F.lit(0)) + 1), BS)).otherwise(F.concat(F.lit("__nodepth__"), F.col("value")))
    voted = votes.filter("value <> ''").groupBy(place.alias("folder")).agg(F.min(F.struct("o", "value")).alias("b")).groupBy(F.col("b.value").alias("value")).agg(F.count(F.lit(1)).alias("n_folders"))
    filed = files.select(normalise_value(F.col(column)).alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n_files"))
    return voted.join(filed, "value", "full").select("value", F.greatest(F.coalesce("n_folders", F.lit(0)), F.coalesce("n_files", F.lit(0))).alias("count"))


def cluster_values(pool: DataFrame, entity: str, threshold: float = 0.55, within: str | None = None) -> DataFrame:
    """(value[, context], root, canonical, cluster_id) of a pool (value, count[, context]).

    The canonical value is the most counted, then longest, then first one. Ids are numbered by size
    and canonical name; plot clusters by context and value.
    """
    pool = cut(pool)
    if within:
        key = F.concat_ws("\x1f", F.col(within), F.col("value"))
        free = pool.filter(~F.startswith(within, F.lit("__nocontext__")))
        links = group_links(free, threshold, within).select(F.concat_ws("\x1f", F.col(within), "a").alias("a"), F.concat_ws("\x1f", F.col(within), "b").alias("b"))
    else:
        key = F.col("value")
        links = group_links(pool, threshold)
        if entity == "scheme":
            links = links.unionByName(scheme_overlaps(pool).select("a", "b"))
    keyed = pool.withColumn("node", key)
    groups = linked_groups(keyed.select("node"), links)
    members = cut(keyed.join(groups, "node"))
    top = members.groupBy("root").agg(F.max(F.struct("count", F.length("value").alias("len"))).alias("t"), F.count(F.lit(1)).alias("n_values"))
    best = members.join(top, "root").filter((F.col("count") == F.col("t.count")) & (F.length("value") == F.col("t.len"))).groupBy("root", "n_values").agg(F.min("value").alias("canonical"))
    order = ["root"] if within else [F.desc("n_values"), F.asc("canonical")]
    named = numbered(best, order, "number").withColumn("cluster_id", F.format_string(f"{PREFIXES.get(entity, entity[:4])}_%04d", F.col("number")))
    return members.join(named, "root").select("value", *([within] if within else []), "root", "canonical", "cluster_id", "count")


def assign_clusters(files: DataFrame, clusters: DataFrame, entity: str) -> DataFrame:
    """entity_x_cluster_id, _canonical ("" where the value has none) and _cluster_size (files per id)."""
    column = f"entity_{entity}_extracted" if f"entity_{entity}_extracted" in files.columns else f"entity_{entity}"
    own = [f"entity_{entity}_cluster_id", f"entity_{entity}_canonical", f"entity_{entity}_cluster_size"]
    df = files.select(*[c for c in files.columns if c not in own]).withColumn("__v", normalise_value(F.col(column)))
    table = clusters.select(F.col("value").alias("__cv"), F.col("cluster_id").alias(own[0]), F.col("canonical").alias(own[1]))
    df = df.join(table, F.col("__v") == F.col("__cv"), "left").drop("__v", "__cv").withColumns({own[0]: F.coalesce(own[0], F.lit("")), own[1]: F.coalesce(own[1], F.lit(""))})
    return df


def backfill(files: DataFrame, clusters: DataFrame, entity: str) -> DataFrame:
    """Files without cluster take the surest of their raw matches that has one, with its value, confidence and depth."""
    raw = f"extracted_{entity}s"
    if raw not in files.columns:
        return files
    table = clusters.select(F.col("value").alias("__cv"), F.col("cluster_id").alias("__cid"), F.col("canonical").alias("__canon"))
    text = normalise_value(F.coalesce(F.nullif(F.col("m.extracted"), F.lit("")), F.col("m.value")))
    lists = files.filter((F.col(f"entity_{entity}_cluster_id") == "") & (F.size(raw) > 0)).select(raw).distinct()
    met = lists.select(raw, F.posexplode(raw).alias("pos", "m")).withColumn("__t", text).join(table, F.col("__t") == F.col("__cv"))
    best = met.groupBy(F.col(raw).alias("__raw")).agg(F.max(F.struct(F.col("m.confidence").alias("c"), (-F.col("pos")).alias("p"), F.col("m.value").alias("value"), F.col("m.depth").alias("depth"), F.col("__cid").alias("cid"), F.col("__canon").alias("canon"))).alias("__b"))
    df = files.join(best, (F.col(raw) == F.col("__raw")) & (F.col(f"entity_{entity}_cluster_id") == ""), "left")
    hit = F.col("__raw").isNotNull()
    pick = {f"entity_{entity}": "value", f"entity_{entity}_confidence": "c", f"entity_{entity}_depth": "depth", f"entity_{entity}_cluster_id": "cid", f"entity_{entity}_canonical": "canon"}
    return df.withColumns({c: F.when(hit, F.col(f"__b.{f}")).otherwise(F.col(c)) for c, f in pick.items()}).drop("__raw", "__b")


def cluster_sizes(files: DataFrame, entity: str) -> DataFrame:
    """entity_x_cluster_size: files per cluster id, 0 for none; counted by aggregation, so large clusters do not pile up."""
    c = f"entity_{entity}_cluster_id"
    sizes = files.filter(F.col(c) != "").groupBy(F.col(c).alias("__id")).agg(F.count(F.lit(1)).alias(f"entity_{entity}_cluster_size"))
    return files.join(sizes, F.col(c) == F.col("__id"), "left").drop("__id").withColumn(f"entity_{entity}_cluster_size", F.coalesce(f"entity_{entity}_cluster_size", F.lit(0)))


def plot_context(files: DataFrame) -> Column:
    """Scheme cluster, else the address cluster above the plot, else the folder by itself."""
    above = (F.col("entity_address_cluster_id") != "") & (F.col("entity_address_depth") >= 0) & (F.col("entity_address_depth") < F.col("entity_plot_depth"))
    folder = F.array_join(F.slice("segments", F.lit(1), F.greatest(F.col("entity_plot_depth"), F.lit(0)) + 1), BS)
    return F.when(F.col("entity_scheme_cluster_id") != "", F.col("entity_scheme_cluster_id")).when(above, F.concat(F.lit("addr:"), "entity_address_cluster_id")).otherwise(F.concat(F.lit("__nocontext__"), folder))


def cluster_plots(files: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Plot clusters within equal contexts: adds context, cluster id, canonical value and size."""
    column = "entity_plot_extracted" if "entity_plot_extracted" in files.columns else "entity_plot"
    df = files.withColumns({"entity_plot_cluster_context": plot_context(files), "__v": normalise_value(F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("entity_plot")))})
    folder = F.array_join(F.slice("segments", F.lit(1), F.greatest(F.col("entity_plot_depth"), F.lit(0)) + 1), BS)
    pool = df.filter("__v <> ''").select(F.col("entity_plot_cluster_context").alias("context"), F.col("__v").alias("value"), folder.alias("folder")).distinct().groupBy("context", "value").agg(F.count(F.lit(1)).alias("count"))
    clusters = cluster_values(pool, "plot", threshold, "context")
    table = clusters.select(F.col("context").alias("__cx"), F.col("value").alias("__cv"), F.col("cluster_id").alias("entity_plot_cluster_id"), F.col("canonical").alias("entity_plot_canonical"))
    kept = df.select(*[c for c in df.columns if c not in ("entity_plot_cluster_id", "entity_plot_canonical", "entity_plot_cluster_size")])
    out = kept.join(table, (F.col("entity_plot_cluster_context") == F.col("__cx")) & (F.col("__v") == F.col("__cv")), "left").drop("__v", "__cx", "__cv")
    out = out.withColumns({"entity_plot_cluster_id": F.coalesce("entity_plot_cluster_id", F.lit("")), "entity_plot_canonical": F.coalesce("entity_plot_canonical", F.lit(""))})
    return cluster_sizes(out.withColumn("entity_plot_cluster_context", F.when(F.col("entity_plot_cluster_id") != "", F.col("entity_plot_cluster_context")).otherwise("")), "plot")


def cluster_entities(files: DataFrame, threshold: float = 0.55, others: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of schemes, then addresses with backfill, then plots in their context, then of all other entities that ``files`` has."""
    df = files

    def clustered(df: DataFrame, entity: str) -> DataFrame:
        clusters = cut(cluster_values(value_pool(df, entity), entity, threshold))
        return cut(cluster_sizes(backfill(assign_clusters(df, clusters, entity), clusters, entity), entity))

    def plotted(df: DataFrame, _: str) -> DataFrame:
        return cut(cluster_plots(df, threshold))

    steps = [(clustered, "scheme"), (clustered, "address"), (plotted, "plot")]
    steps += [(clustered, e) for e in others if e not in ("scheme", "address", "plot") and {f"entity_{e}", f"entity_{e}_depth"} <= set(df.columns)]
    for step, entity in steps:
        before, df = df, step(df, entity)
        if before is not files:
            release(before)
    return df
