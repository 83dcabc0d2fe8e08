"""Sharding along a Hilbert curve.

Metadata dimensions (source, language, size) are quantised to a few bits each; the cell's index on the Hilbert
curve orders the documents, and the order is cut into runs. Neighbours on the curve are neighbours in every
dimension, so a shard covers a small box and a reader can skip shards by the bounds of any dimension
(:func:`shard_bounds`).

The law is ``rows``: documents are ranked by (curve index, hash bucket, id) and shard = rank x shards / rows, so
counts are at most one apart. Ranks come from prefix sums over a histogram of at most 4096 cells x 64 buckets, and
a window inside each bucket; no task sorts a whole cell, and texts are never shuffled. Only DataFrame functions run.

Edge cases: a null text is an empty text (size 16, checksum 0); null dimensions are the value of a hash of null; null
ids come first in their bucket; repeated rows take neighbouring ranks; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, table, written

BITS = 4
SUB_BUCKETS = 64


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """The Hilbert curve index of a cell, natively: Skilling's transform as a fold over (bit, axis) steps."""
    n = len(coords)
    start = F.array(*[c.cast("int") for c in coords])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(axis).alias("a")) for b in range(bits - 1, 0, -1) for axis in range(n)])

    def undo(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        swapped = F.element_at(x, 1).bitwiseXOR(F.element_at(x, s["a"] + 1)).bitwiseAND(p)
        flip = F.element_at(x, s["a"] + 1).bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, i: F.when(flip, F.when(i == 0, v.bitwiseXOR(p)).otherwise(v))
                           .otherwise(F.when((i == 0) | (i == s["a"]), F.when(s["a"] == 0, v).otherwise(v.bitwiseXOR(swapped))).otherwise(v)))

    x = F.aggregate(steps, start, undo)
    # Gray encoding: each axis takes the one before, then every axis the parity of the last one's higher bits.
    x = F.aggregate(F.sequence(F.lit(2), F.lit(n)), x, lambda acc, k: F.transform(acc, lambda v, i: F.when(i == k - 1, v.bitwiseXOR(F.element_at(acc, k - 1))).otherwise(v)))
    t = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.lit(0), lambda acc, q: F.when(F.element_at(x, n).bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
    x = F.transform(x, lambda v: v.bitwiseXOR(t))
    order = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(axis + 1).alias("a")) for b in range(bits - 1, -1, -1) for axis in range(n)])
    return F.aggregate(order, F.lit(0), lambda acc, s: acc * 2 + F.when(F.element_at(x, s["a"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))


def quantised(source: Column, lang: Column, size: Column) -> list[Column]:
    """Three coordinates of BITS bits: hashes of the two names, and the binary logarithm of the size."""
    top = (1 << BITS) - 1
    return [F.pmod(F.xxhash64(source), F.lit(top + 1)).cast("int"), F.pmod(F.xxhash64(lang), F.lit(top + 1)).cast("int"),
            F.greatest(F.lit(0), F.least(F.lit(top), F.floor(F.log2(size.cast("double"))) - 4)).cast("int")]


def hilbert_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, x, y, z, curve, law, shard, slot, grown_shard) per row of ``docs``."""
    text = F.coalesce(col(text_col), F.lit(""))
    size = (F.octet_length(text) + 16).cast("bigint")
    slim = docs.select(col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), col(source_col).alias("s"), col(lang_col).alias("l"))
    x, y, z = quantised(F.col("s"), F.col("l"), F.col("size"))
    slim = written(slim.select("doc_id", "size", "text_crc32", x.alias("x"), y.alias("y"), z.alias("z"), F.pmod(F.xxhash64("doc_id"), F.lit(SUB_BUCKETS)).cast("int").alias("sub")))
    hist = slim.groupBy("x", "y", "z", "sub").agg(F.count(F.lit(1)).alias("n"))
    cells = hist.groupBy("x", "y", "z").agg(F.sum("n").alias("cell_n"), F.count(F.lit(1)).alias("subs"))
    cells = cells.withColumn("curve", hilbert_index([F.col("x"), F.col("y"), F.col("z")]))
    line = Window.orderBy("curve")  # over cells: 4096 rows at most
    cells = cells.withColumns({
        "cell_before": F.coalesce(F.sum("cell_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("cell_n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    inside = Window.partitionBy("x", "y", "z").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("sub_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n").join(cells.drop("cell_n", "subs"), ["x", "y", "z"])
    place = Window.partitionBy("x", "y", "z", "sub").orderBy("doc_id", "size", "text_crc32")
    ranked = slim.withColumn("place", F.row_number().over(place)).join(hist, ["x", "y", "z", "sub"])
    rank = F.col("cell_before") + F.col("sub_before") + F.col("place") - 1
    out = ranked.withColumn("rank", rank.cast("bigint"))
    out = out.withColumn("shard", F.expr(f"CAST(rank * {n_shards} DIV total AS INT)"))
    out = out.withColumn("slot", F.expr(f"rank - (CAST(shard AS BIGINT) * total + {n_shards - 1}) DIV {n_shards}"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "x", "y", "z")


def shard_bounds(shards: DataFrame) -> DataFrame:
    """The box of each shard in the quantised dimensions, for pruning."""
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents")).drop("x", "y", "z")
