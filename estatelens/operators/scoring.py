"""Signals of a file to its type, category and entities.

Folder signals are gathered once per distinct folder chain, filename signals per distinct stem and
extension hints per extension; a file joins the three and is scored by array expressions, so a file
row is never exploded.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.config import Config
from estatelens.functions.text import clamp
from estatelens.operators.matching import ABBREVIATION, FUZZY, PATTERN, TOKEN, category_hits, entity_confidence, entity_hits, extension_hits, texts_of, type_hits
from estatelens.session import checkpoint_dir, cut, release

_TYPE = "array<struct<label:string,depth:int,layer:int,weight:double,ord:int>>"


def _weight(config: Config, role: str) -> Column:
    w = {k: float(config.weight("signal_weights", k)) for k in ("folder_type", "filename_token", "filename_abbreviation", "filename_pattern")}
    by = {TOKEN: w["folder_type"], PATTERN: w["folder_type"], ABBREVIATION: w["folder_type"]} if role == "folder" else {TOKEN: w["filename_token"], PATTERN: w["filename_pattern"], ABBREVIATION: w["filename_abbreviation"]}
    by[FUZZY] = round(by[TOKEN] * (1 - float(config.weight("fuzzy", "fuzzy_penalty"))), 4)
    p = F.col("priority")
    return F.when(p == TOKEN, by[TOKEN]).when(p == PATTERN, by[PATTERN]).when(p == ABBREVIATION, by[ABBREVIATION]).otherwise(by[FUZZY])


def text_signals(files: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Type, category and entity hits of all distinct folder names and stems of ``files`` (segments, filename_stem)."""
    checkpoint_dir(files.sparkSession)
    # the steps are many small jobs that do not wait for each other
    with ThreadPoolExecutor(3) as pool:
        sides = [(files.select(F.explode("segments").alias("s")), F.col("s")), (files, F.col("filename_stem"))]
        folders, stems = pool.map(texts_of, sides)
        stem_types = pool.submit(lambda: cut(type_hits(stems, config)))
        types, categories = pool.map(lambda find: cut(find(folders, config)), (type_hits, category_hits))
        organisational = types.select("text").unionAll(categories.select("text"))
        entities = cut(entity_hits(folders, config, organisational))
        found = {"folder_types": types, "categories": categories, "entities": entities, "stem_types": stem_types.result()}
    release(folders)
    release(stems)
    return found


def folder_signals(files: DataFrame, signals: dict[str, DataFrame], config: Config) -> DataFrame:
    """Per distinct ``segments``: arrays folder_types, folder_categories and folder_entities with depths."""
    chains = cut(files.select("segments").filter(F.size("segments") > 0).distinct())
    at = chains.select("segments", F.posexplode("segments").alias("depth", "text"))
    parts = {
        "folder_types": (signals["folder_types"].withColumn("weight", _weight(config, "folder")), F.struct("label", "depth", "layer", "weight", "ord")),
        "folder_categories": (signals["categories"].withColumn("weight", F.lit(float(config.weight("signal_weights", "folder_category")))), F.struct("label", "depth", "weight", "ord")),
        "folder_entities": (signals["entities"].withColumn("confidence", entity_confidence(config)), F.struct(F.col("label").alias("entity"), F.col("text").alias("value"), "confidence", "depth", "ord")),
    }
    united = None
    for name, (hits, packed) in parts.items():
        own = at.join(hits, "text").select("segments", *[(packed if n == name else F.lit(None).cast(t)).alias(n) for n, t in (("folder_types", "struct<label:string,depth:int,layer:int,weight:double,ord:int>"), ("folder_categories", "struct<label:string,depth:int,weight:double,ord:int>"), ("folder_entities", "struct<entity:string,value:string,confidence:double,depth:int,ord:int>"))])
        united = own if united is None else united.unionByName(own)
    return united.groupBy("segments").agg(*[F.collect_list(n).alias(n) for n in parts])


def _top(signals: Column, *keys: str) -> Column:
    """The signal with the greatest keys; of equals the first (shallower before deeper, dictionary order)."""
    ranks = lambda s: [s[k].cast("double") for k in keys] + [F.lit(0.0)] * (3 - len(keys))
    kind = "array<struct<k0:double,k1:double,k2:double,d:int,o:int,label:string,weight:double,depth:int>>"
    packed = F.transform(signals, lambda s: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(ranks(s))], (F.lit(0) if "depth" in keys else -s["depth"]).alias("d"), (-s["ord"]).alias("o"), s["label"].alias("label"), s["weight"].alias("weight"), s["depth"].alias("depth")))
    return F.array_max(packed.cast(kind))


def score(files: DataFrame, config: Config, signals: dict[str, DataFrame] | None = None) -> DataFrame:
    """``files`` with inferred types, category, confidences, band, status, entities and the raw matches of each entity.

    A file without signals is ``Unknown`` with confidence 0. Columns of an entity e without match:
    entity_e "", confidence 0.0, depth -1.
    """
    signals = signals or text_signals(files, config)
    folders = folder_signals(files, signals, config).withColumnRenamed("segments", "__segments")
    stem_w = signals["stem_types"].withColumn("weight", _weight(config, "file")).groupBy(F.col("text").alias("__stem")).agg(F.collect_list(F.struct("label", F.lit(-1).alias("depth"), "layer", "weight", "ord")).alias("file_types"))
    hint = float(config.weight("signal_weights", "extension_hint"))
    ext = extension_hits(files.select("extension").distinct(), config).groupBy(F.col("extension").alias("__ext")).agg(F.collect_list(F.struct("label", F.lit(-1).alias("depth"), "layer", F.lit(hint).alias("weight"), "ord")).alias("hints"))
    df = files.join(folders, files["segments"] == F.col("__segments"), "left").join(stem_w, F.col("filename_stem") == F.col("__stem"), "left").join(ext, F.col("extension") == F.col("__ext"), "left").drop("__segments", "__stem", "__ext")
    none = F.array().cast(_TYPE)
    df = df.withColumns({"__f": F.coalesce("file_types", none), "__d": F.coalesce("folder_types", none), "__x": F.coalesce("hints", none)}).drop("file_types", "folder_types", "hints")

    generic = F.array(*[F.lit(g) for g in config.weights.get("generic_types", [])]).cast("array<string>")
    discount = float(config.weights.get("generic_suppression_discount", 0.85))
    df = df.withColumns(
        {
            "__bf": _top(F.col("__f"), "weight", "layer"),
            "__bd": _top(F.col("__d"), "depth", "layer", "weight"),
            "__bs": _top(F.filter("__d", lambda s: ~F.array_contains(generic, s["label"])), "depth", "layer", "weight"),
            "__bx": _top(F.col("__x"), "weight", "layer"),
            "__cat": F.array_max(F.transform(F.coalesce("folder_categories", F.array().cast("array<struct<label:string,depth:int,weight:double,ord:int>>")), lambda s: F.struct(s["depth"].alias("d"), s["weight"].alias("w"), (-s["ord"]).alias("o"), s["label"].alias("label")))),
        }
    )
    filed = F.coalesce(F.col("__bf"), F.col("__bd"))
    suppressed = filed.isNotNull() & F.array_contains(generic, filed["label"]) & F.col("__bs").isNotNull()
    label = F.when(suppressed, F.col("__bs")["label"]).when(filed.isNotNull(), filed["label"]).otherwise(F.coalesce(F.col("__bx")["label"], F.lit("Unknown")))
    base = F.when(suppressed, F.col("__bs")["weight"] * discount).when(filed.isNotNull(), filed["weight"]).otherwise(F.coalesce(F.col("__bx")["weight"], F.lit(0.0)))
    df = df.withColumns({"__label": label, "__base": base, "inferred_category": F.coalesce(F.col("__cat")["label"], F.lit("Unknown")), "category_confidence": F.round(clamp(F.coalesce(F.col("__cat")["w"], F.lit(0.0))), 3)})

    # runner-up: best weight of another label; equals by filename, folder, extension, then order of appearance
    rank = lambda src, s: F.struct(s["weight"].alias("w"), F.lit(-src).alias("s"), (-s["depth"]).alias("d"), (-s["ord"]).alias("o"), s["label"].alias("label"))
    others = F.concat(*[F.transform(F.filter(c, lambda s: s["label"] != F.col("__label")), lambda s, i=i: rank(i, s)) for i, c in enumerate(("__f", "__d", "__x"))])
    df = df.withColumn("__second", F.array_max(others))

    names = lambda c: F.transform(c, lambda s: s["label"])
    both = (F.size("__d") > 0) & (F.size("__f") > 0)
    child = F.lit(False)
    for parent, kids in (config.weights.get("parent_child") or {}).items():
        child = child | (F.array_contains(names("__d"), parent) & F.col("__label").isin(*kids))
    agree = F.array_contains(names("__d"), F.col("__label"))
    shift = F.when(both & agree, float(config.weight("reinforcement", "type_agreement_boost"))).when(both & child, float(config.weights.get("parent_child_boost", 0.05))).when(both, -float(config.weight("conflict", "type_disagreement_penalty"))).otherwise(0.0)
    in_domain = F.lit(False)
    for t in config.types:
        if t.belongs_to != "universal":
            in_domain = in_domain | ((F.col("__label") == t.name) & (F.col("inferred_category") == t.belongs_to))
    raised = F.col("__base") + shift + F.when(in_domain, float(config.weight("reinforcement", "category_domain_boost"))).otherwise(0.0)
    sure = clamp(F.when(F.col("__label") == "Unknown", 0.0).otherwise(raised))
    df = df.withColumn("__sure", sure)
    low = F.col("__sure") < float(config.weight("thresholds", "minimum_confidence"))
    df = df.withColumns({"inferred_type": F.when(low, "Unknown").otherwise(F.col("__label")), "__conf": F.when(low, 0.0).otherwise(F.col("__sure"))})
    high, medium = float(config.weight("readiness", "high_threshold")), float(config.weight("readiness", "medium_threshold"))
    unknown, c = F.col("inferred_type") == "Unknown", F.col("__conf")
    second_conf = F.coalesce(F.col("__second")["w"], F.lit(0.0))
    df = df.withColumns(
        {
            "type_confidence": F.round(c, 3),
            "overall_confidence": F.round(c, 3),
            "secondary_type": F.coalesce(F.col("__second")["label"], F.lit("")),
            "secondary_type_confidence": F.round(second_conf, 3),
            "confidence_band": F.when(unknown, "Low").when(c >= high, "High").when(c >= medium, "Medium").otherwise("Low"),
            "readiness_status": F.when(unknown, str(config.weights.get("readiness", {}).get("unknown_status", "Not Ready"))).when(c >= high, "Ready").when(c >= medium, "Review").otherwise("Not Ready"),
            "is_ambiguous": ~unknown & (second_conf > 0) & (c - second_conf < 0.15),
        }
    )
    df = df.withColumn("reasoning_trace", _trace())
    return _entities(df, config).drop("__f", "__d", "__x", "__bf", "__bd", "__bs", "__bx", "__cat", "__label", "__base", "__second", "__sure", "__conf", "folder_categories", "folder_entities")


def _trace() -> Column:
    """What decided, in order: signals found, category, type, result."""
    def line(name: str, c: str) -> Column:
        return F.transform(F.array_sort(F.transform(c, lambda s: F.struct(s["depth"].alias("depth"), s["ord"].alias("ord"), s["label"].alias("label"), s["weight"].alias("weight")))), lambda s: F.format_string(f"{name} -> %s (depth %d, weight %.2f)", s["label"], s["depth"], s["weight"]))

    end = F.format_string("final: type %s (%.2f), category %s, band %s, status %s", F.col("inferred_type"), F.col("__conf"), F.col("inferred_category"), F.col("confidence_band"), F.col("readiness_status"))
    return F.concat(line("folder type", "__d"), line("filename type", "__f"), line("extension hint", "__x"), F.when(F.col("is_ambiguous"), F.array(F.format_string("ambiguous: runner-up %s (%.2f)", F.col("secondary_type"), F.col("secondary_type_confidence")))).otherwise(F.array().cast("array<string>")), F.array(end))


def _entities(df: DataFrame, config: Config) -> DataFrame:
    """Deepest match of each entity and all of them, deepest first."""
    kind = "array<struct<value:string,confidence:double,depth:int>>"
    added = {}
    for e in config.entities:
        own = F.filter(F.coalesce("folder_entities", F.array().cast("array<struct<entity:string,value:string,confidence:double,depth:int,ord:int>>")), lambda s: s["entity"] == e.name)
        deepest = F.reverse(F.array_sort(F.transform(own, lambda s: F.struct(s["depth"].alias("depth"), s["value"].alias("value"), s["confidence"].alias("confidence")))))
        raw = F.transform(deepest, lambda s: F.struct(s["value"].alias("value"), s["confidence"].alias("confidence"), s["depth"].alias("depth"))).cast(kind)
        top = F.try_element_at(raw, F.lit(1))
        added |= {f"raw_{e.name}s": raw, f"entity_{e.name}": F.coalesce(top["value"], F.lit("")), f"entity_{e.name}_confidence": F.coalesce(top["confidence"], F.lit(0.0)), f"entity_{e.name}_depth": F.coalesce(top["depth"], F.lit(-1))}
    return df.withColumns(added)
