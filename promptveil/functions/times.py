"""Event time as whole microseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_instant(df: DataFrame, ts: str) -> Column:
    """A timestamp column as an instant; times without a zone are UTC whatever the session's zone is."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts))
        return local.cast("timestamp")
    return F.col(ts)


def micros_of(df: DataFrame, ts: str) -> Column:
    return F.unix_micros(as_instant(df, ts))
