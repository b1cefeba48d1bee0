"""Retention rules: period, expiry, status and risk of every file at a given time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.config import Retention, small_table
from estatelens.functions.text import add_years


def risk_score(status: Column, sensitivity: Column, years_left: Column) -> Column:
    """0 to 100 by status, time to or since expiry, and sensitivity; cut to a whole number."""
    factor = F.when(sensitivity == "high", 1.25).when(sensitivity == "low", 0.7).otherwise(1.0)
    over = -years_left
    expired = F.when(over > 5, 95.0).when(over > 2, 80.0).when(over > 1, 70.0).otherwise(60.0)
    active = F.when(years_left < 1, 50.0).when(years_left < 3, 30.0).when(years_left < 5, 15.0).otherwise(5.0)
    base = F.when(status == "Long-term", 5.0).when(status == "Expired", expired).when(status == "Active", active)
    return F.when(base.isNotNull(), F.least(F.lit(100), (base * factor).cast("int"))).otherwise(0)


def apply_retention(files: DataFrame, rules: Retention, as_of: datetime, date: str = "last_modified") -> DataFrame:
    """Adds retention_years, retention_permanent, retention_basis, sensitivity_level, calculated_expiry_date,
    retention_status and retention_risk_score.

    ``as_of`` is a parameter, never the clock. Files of unknown type have no rule (nulls, status
    Unknown, risk 0); types without a rule take the default. Files without date have status Unknown.
    """
    rows = [(t, y, y is None, b, s) for t, (y, b, s) in rules.rules.items()]
    table = small_table(files.sparkSession, rows, "__type string, __years int, __permanent boolean, __basis string, __sensitivity string")
    df = files.join(table, F.col("inferred_type") == F.col("__type"), "left")
    known = F.coalesce(F.col("inferred_type"), F.lit("Unknown")) != "Unknown"
    ruled = F.col("__type").isNotNull()
    df = df.withColumns(
        {
            "retention_years": F.when(known, F.when(ruled, F.col("__years")).otherwise(rules.default_years)),
            "retention_permanent": F.coalesce(known & F.col("__permanent"), F.lit(False)),
            "retention_basis": F.when(known, F.coalesce("__basis", F.lit("default"))),
            "sensitivity_level": F.when(known, F.coalesce("__sensitivity", F.lit(rules.default_sensitivity))),
        }
    )
    when = F.col(date).cast("timestamp_ntz")
    expiry = F.when(~F.col("retention_permanent") & F.col("retention_years").isNotNull(), add_years(when, F.col("retention_years")))
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    status = F.when(~known, "Unknown").when(F.col("retention_permanent"), "Long-term").when(F.col("__expiry").isNull(), "Unknown").when(F.col("__expiry") < now, "Expired").otherwise("Active")
    df = df.withColumn("__expiry", expiry)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    years_left = F.floor((micros(F.col("__expiry")) - micros(now)) / 86_400_000_000) / 365.25
    df = df.withColumn("retention_status", status)
    df = df.withColumns({"calculated_expiry_date": F.date_format("__expiry", "yyyy-MM-dd'T'HH:mm:ss"), "retention_risk_score": risk_score(F.col("retention_status"), F.col("sensitivity_level"), years_left)})
    return df.drop("__type", "__years", "__permanent", "__basis", "__sensitivity", "__expiry")
