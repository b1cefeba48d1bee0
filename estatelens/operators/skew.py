"""Per-key aggregation that does not pile up on a few keys.

Two stages: rows of heavy keys get a salt and are aggregated by (key, salt); the partial
results are then merged by key. A key is heavy when it holds at least ``heavy_share`` of the
rows, so there are at most ``1 / heavy_share`` heavy keys whatever the data. The salt is a hash of
a row identifier, hence spread like a random one but the same again when a task is repeated
after the loss of an executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: list[str], heavy_share: float) -> DataFrame:
    """Keys (null-safe) that hold at least ``heavy_share`` of all rows, with their count.

    Exact: the count per key is combined on the map side, so one row per key and task moves.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    return counts.filter(F.col("__n") >= total.scalar() * heavy_share).select(*keys, "__n")


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partials: dict[str, Column],
    merges: dict[str, Column],
    salt_of: Column,
    salts: int = 32,
    heavy_share: float = 0.01,
) -> DataFrame:
    """Aggregate ``df`` by ``keys`` in two salted stages.

    ``partials`` are the aggregates per (key, salt), ``merges`` combine the partial columns (by
    name) per key. Null keys form their own group. An empty input gives an empty result.
    Heavy keys, at most ``1 / heavy_share`` of them by definition, are broadcast.
    """
    if salts < 1 or not 0 < heavy_share <= 1:
        raise ValueError("salts must be positive and heavy_share in (0, 1]")
    heavy = F.broadcast(heavy_keys(df, keys, heavy_share).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__heavy")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    salted = df.join(heavy, same, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(salt_of), F.lit(salts))).otherwise(F.lit(0)))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merges.items()])


def per_key_totals(files: DataFrame, fields: tuple[str, ...] = ("entity_scheme", "source_system"), instant: str | None = "utc_micros", salts: int = 32, heavy_share: float = 0.01) -> DataFrame:
    """File count, known sizes and newest instant for every value of each of ``fields``.

    Columns: field_name, key_value (null where the field is null), n_files, total_bytes (null if no
    size is known), max_bytes, newest_micros (null if no instant is known or ``instant`` is None).
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields])
    long = files.select(
        F.col("row_id").alias("__row"), F.col("size").cast("bigint").alias("__size"), (F.col(instant) if instant else F.lit(None).cast("bigint")).alias("__at"), F.explode(pairs).alias("__pair")
    ).select("__row", "__size", "__at", "__pair.field_name", "__pair.key_value")
    return salted_aggregate(
        long,
        ["field_name", "key_value"],
        {"n_files": F.count(F.lit(1)), "total_bytes": F.sum("__size"), "max_bytes": F.max("__size"), "newest_micros": F.max("__at")},
        {"n_files": F.sum("n_files"), "total_bytes": F.sum("total_bytes"), "max_bytes": F.max("max_bytes"), "newest_micros": F.max("newest_micros")},
        F.col("__row"),
        salts,
        heavy_share,
    )


def dominant_keys(totals: DataFrame, share: float) -> DataFrame:
    """Non-null keys of ``per_key_totals`` that hold at least ``share`` of all rows.

    Every row has one key per field (null included), so the rows of a field sum to the table.
    """
    whole = totals.groupBy("field_name").agg(F.sum("n_files").alias("__all"))  # one row per field name, of which there are as many as fields given
    return totals.join(F.broadcast(whole), "field_name").filter(F.col("key_value").isNotNull() & (F.col("n_files") >= F.col("__all") * share)).select("field_name", "key_value")
