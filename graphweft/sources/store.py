"""Tables of a database or warehouse over JDBC, for use as a resource's relation.

The table is one of a Spark catalog, so Catalyst hands filters, columns, aggregates and limits on it to the store as SQL in the store's own
dialect, and the store's answer is read by executors. ``split`` names a numeric, date or timestamp column and a number of ranges of it that are read
in parallel; its bounds are asked of the store, and values outside or null belong to the outer ranges, so no row is lost.

Edge cases: an empty table gives an empty result and is read in one range; names are taken as the store keeps them.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"


def store_table(spark: SparkSession, url: str, table: str, driver: str | None = None, catalog: str = "store", split: tuple[str, int] | None = None, **options: str) -> DataFrame:
    """The table ``table`` (schema.name) at a JDBC url. ``catalog`` is the name under which the store is known to the session; ``options``
    are those of Spark's JDBC source (user, password, fetchsize, ...)."""
    settings = {"": _CATALOG, ".url": url} | ({".driver": driver} if driver else {}) | {f".{k}": v for k, v in options.items()}
    known = spark.conf.get(f"spark.sql.catalog.{catalog}.url", None)
    if known is not None and known != url:
        raise ValueError(f"the catalog {catalog} is another store in this session")
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.catalog.{catalog}{name}", value)
    name = ".".join(f"`{x}`" for x in (catalog, *table.split(".")))
    if split is None:
        return spark.table(name)
    column, ranges = split
    low, high = spark.table(name).agg(F.min(column), F.max(column)).first()
    if low is None:
        return spark.table(name)
    bound = lambda x: str(math.floor(x)) if isinstance(x, (int, float, Decimal)) else str(x)
    return spark.read.options(partitionColumn=column, lowerBound=bound(low), upperBound=bound(high), numPartitions=str(ranges)).table(name)


def pushed(df: DataFrame) -> list[str]:
    """What the store is asked for: the scans of the physical plan, with their pushed filters, aggregates and limits."""
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Pushed" in line]
