"""The pipeline of estates: read, map, filter, normalise, decompose, score, schemes, entities, clusters, duplicates, retention, audit."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.config import Config, default_config
from estatelens.operators import clustering, duplicates, extraction, folders, ingest, retention, scoring
from estatelens.sources.readers import read_listing
from estatelens.session import cut, release

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Estate:
    """One listing to read."""

    name: str
    path: str
    format_name: str = "csv"
    root_prefix: str = ""
    source: ingest.SourceFormat | None = None
    exclusions: ingest.Exclusions = field(default_factory=ingest.Exclusions)


def ingest_listing(raw: DataFrame, estate: Estate) -> DataFrame:
    """Mapped, filtered, normalised and decomposed rows with a row_id for rules of the first row."""
    fmt = estate.source or ingest.FORMATS.get(estate.format_name, ingest.SourceFormat())
    df = ingest.validate(ingest.map_columns(raw, fmt.column_map) if fmt.column_map else raw)
    df = ingest.decompose_paths(ingest.normalise(ingest.apply_filters(df, estate.exclusions)), estate.root_prefix)
    df = ingest.tag_source(df, estate.name, estate.root_prefix)
    if "row_id" in df.columns:
        return df
    # ids count up in the order in which the files of the listing are read, so the first row of a listing stays the first
    return df.withColumn("row_id", F.monotonically_increasing_id())


def classify(files: DataFrame, config: Config, root_depth: int = -1) -> tuple[DataFrame, DataFrame]:
    """(files with type, category, entities and schemes, sidecar of scheme candidates)."""
    # each step reads its input several times, so it is written out, and removed behind the next one
    files = cut(files)
    signals = scoring.text_signals(files, config)
    scored = cut(scoring.score(files, config, signals))
    release(files)
    schemed, sidecar = folders.detect_schemes(scored, config, signals, root_depth)
    ruled = cut(folders.enforce_hierarchy(schemed))
    release(scored)
    extracted = cut(extraction.add_extracted(ruled, config))
    release(ruled)
    return extracted, sidecar


def finish(files: DataFrame, config: Config, as_of: datetime, cluster: bool = True, find_duplicates: bool = True, batch_run_id: str | None = None, run_timestamp: str | None = None) -> DataFrame:
    """Clusters, duplicates, retention and audit fields over all estates together."""
    df = files
    for c in ("last_modified", "owner", "size"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("timestamp_ntz" if c == "last_modified" else "string"))
    if cluster:
        df = clustering.cluster_entities(df, float(config.weight("entity_clustering", "similarity_threshold")), tuple(e.name for e in config.entities))
    if find_duplicates:
        df = duplicates.detect_duplicates(df, weights=config.weights)
    df = retention.apply_retention(df, config.retention, as_of)
    return ingest.add_audit_fields(df, batch_run_id, run_timestamp, int(config.weight("pipeline", "file_id_hash_length")))


def run_estates(spark: SparkSession, estates: list[Estate], as_of: datetime, config: Config | None = None, cluster: bool = True) -> tuple[DataFrame, DataFrame]:
    """(classified files, sidecar) of all estates; schemes are found per estate, clusters and duplicates over all.

    An estate that cannot be read is skipped with a warning; RuntimeError if none can. One estate alone
    gets no duplicate detection.
    """
    if not estates:
        raise ValueError("no estates given")
    config = config or default_config()
    done, sidecars = [], []
    for i, e in enumerate(estates):
        try:
            raw = read_listing(spark, e.path, e.format_name, e.source)
            listing = ingest_listing(raw, e)
            files, sidecar = classify(listing.withColumn("row_id", F.col("row_id") + F.lit(i % 128 << 56)), config)
        except (FileNotFoundError, ValueError) as problem:
            log.warning("estate %s skipped: %s", e.name, problem)
            continue
        done.append(files)
        sidecars.append(sidecar.withColumn("source_system", F.lit(e.name)))
    if not done:
        raise RuntimeError("no estate could be read")
    united, side = done[0], sidecars[0]
    for more, s in zip(done[1:], sidecars[1:]):
        united, side = united.unionByName(more, allowMissingColumns=True), side.unionByName(s)
    return finish(united, config, as_of, cluster, len(estates) > 1), side
