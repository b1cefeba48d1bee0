"""Row-wise stages over a stream of listing rows, and late-data aware counts of arrivals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.config import Config
from estatelens.functions.text import all_ngrams, tokenise
from estatelens.operators import ingest
from estatelens.operators.retention import apply_retention


def stream_listing(spark: SparkSession, folder: str, schema: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Stream of listing rows from files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).format(fmt).load(folder)


def classify_stream(rows: DataFrame, config: Config, as_of: datetime, exclusions: ingest.Exclusions = ingest.Exclusions()) -> DataFrame:
    """Filters, normalises, decomposes, and types files by extension and whole-token file names; then retention.

    Folder signals, schemes, clusters and duplicates need the whole estate and stay with the batch pipeline.
    """
    df = ingest.decompose_paths(ingest.normalise(ingest.apply_filters(rows, exclusions)))
    found = F.array_distinct(all_ngrams(tokenise(F.col("filename_stem"))))
    by_name = [F.when(F.arrays_overlap("__phrases", F.array(*[F.lit(x) for x in t.tokens])), t.name) for t in config.types if t.tokens]
    by_extension = [F.when(F.col("extension").isin(*t.extensions), t.name) for t in config.types if t.extensions]
    df = df.withColumn("__phrases", found).withColumn("inferred_type", F.coalesce(*by_name, *by_extension, F.lit("Unknown"))).drop("__phrases")
    return apply_retention(df, config.retention, as_of)


def arrivals_per_window(rows: DataFrame, at: str = "loaded_at", by: str = "source_system", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Files per window and estate; rows later than ``late`` behind the watermark are left out by it."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n_files")).select(F.col("window.start").alias("window_start"), by, "n_files")
