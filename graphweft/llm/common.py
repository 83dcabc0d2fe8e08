"""Helpers shared by the corpus operators: table access, scratch tables, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule: space and the code points 9 to 13.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: ``spark.checkpoint.dir``.

    Only where the session names none, and only on a local master, a temporary folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    found = sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphweft-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, owner: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back: lineage ends there.

    The table goes when the driver's JVM ends, or earlier by :func:`dropped` if its path is put into ``owner``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/graphweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    if owner is not None:
        owner.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, owner: list[str]) -> None:
    """Delete the tables whose paths are in ``owner``: nothing that is still to run may read them."""
    for path in owner:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    owner.clear()


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most about ``size`` bytes for what runs inside: without it a task of a scan holds 64 MB of text on either side."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most ``rows`` rows and about ``size`` bytes of the string ``column``, or items of a list; a longer text is a part of its own."""
    for batch in batches:
        measure = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
        lengths = pc.fill_null(measure(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
        while at < batch.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + size, "right")) - 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


#: Rows of a few numbers that a broadcast may have: at most some 20 MB.
BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of rows of a few numbers, marked for broadcast if its counted rows are few; joins shuffle otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows of a few numbers that a part file may have at least; less isn't worth a task, a file and, on a local disk, the processes that set its mode.
FILE_ROWS = 100_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows of a few numbers, in no more partitions than that is worth, where Spark doesn't merge small ones."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, compared without case as Spark does."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        new = f"__gw_{name}"
        while new.lower() in have:
            new += "_"
        have.add(new.lower())
        out.append(new)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Smallest node id of each node's component, as (node, component), for every node in ``edges``.

    Alternating large-star and small-star rounds, each one aggregation and a written table; rounds grow
    with the logarithm of the diameter. Large-star never sends a whole neighbourhood to one task: the
    smallest neighbour is an aggregate with map-side combination, joined back by key, and Spark's
    skew-join handling splits hot keys. It ends when the stars are disjoint: no node is both a centre and
    a leaf, and no leaf has two centres. Nothing is collected but that flag.
    """
    spark, old, new = edges.sparkSession, [], []
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), old)
    most = e.count()  # no round has more edges than the one before
    for _ in range(max_rounds):
        # Large star: neighbours above the node move to the least of the node and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below the node, and the node, move to the least of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        low = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(few_files(low.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), most), new)
        dropped(spark, old)
        old, new = new, []
        # Of each node: how many centres it has, and whether it is a centre.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
        if odd.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    flat = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return flat.unionByName(roots)
