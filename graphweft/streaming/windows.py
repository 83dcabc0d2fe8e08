"""Time buckets of a series that arrives as a stream.

A resource may be a streaming DataFrame: filters, the join to the static graph and projections of a query then run as a stream.
For buckets over event time, :func:`windowed` puts a watermark on the series and aggregates per id and window, so state is
dropped once a window can't change any more. It equals a DT block with an aggregation over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def windowed(series: DataFrame, interval: str, aggregations: list[str], watermark: str, id_col: str = "id", time_col: str = "timestamp", value_col: str = "value", keys: list[str] | None = None) -> DataFrame:
    """(id, keys, timestamp, value_<agg>...) per bucket of ``interval`` (like ``5 seconds``); late rows beyond ``watermark`` are left out of streams."""
    unknown = [a for a in aggregations if a not in _AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregation {unknown[0]}")
    rows = series.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if series.isStreaming:
        rows = rows.withWatermark(time_col, watermark)
    by = [id_col, *(keys or [])]
    out = rows.groupBy(*by, F.window(time_col, interval).alias("w")).agg(*[_AGGREGATES[a](value_col).alias(f"{value_col}_{a}") for a in aggregations])
    return out.select(*by, F.col("w.start").alias(time_col), *[f"{value_col}_{a}" for a in aggregations])
