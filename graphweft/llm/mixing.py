"""Mixing sources to target weights by entropy balancing.

The mix asks for one token constraint per source: its tokens, each document weighted by a rate, sum to the
source's target. Among all rates the ones closest in relative entropy to "every token once" are exponential
tilts, ``rate = exp(lambda[source])``, and lambda solves a convex dual. Newton's iterations for that dual need
only the token sum of each source, so documents are read once, sums stay a DataFrame, and every iteration is a
step of a fold over the source rows. Rates are then rounded into whole copies: every document gets the whole
part of its rate; the fractional part f of a source goes to the documents that come first in a hash order,
until f of the source's tokens are reached, so the taken tokens miss the target by half a document at most.

Only DataFrame functions run. A hot source is spread over 4096 hash buckets for its sums; the fraction of a source ends in one
of them, and only that bucket's rows are ordered, so a document's copies follow from its own hash and a row of its source: texts
are never shuffled while the sources are few enough to broadcast, which is counted first. Windows without a partition run over
source rows alone.

Edge cases: a null text has size 0; size-0 documents take 0 words; null sources are a source of their own, the
last; a table with no words has targets 0; rows with equal id and text have one place in the order and are taken
alike; an empty table gives an empty mix; extra columns are ignored by :func:`mix` and
kept by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, fresh, small, table, written

#: Weights dealt to the sources in order, and the most times a word may be taken.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
NEWTON_STEPS = 80
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: shares of all sizes by weight, none above MAX_REPEATS times its size.

    Capping and sharing the excess again settles at one level L: target = least(cap, L x weight). With sources by
    rising cap / weight, L is the largest of the levels that are no higher than their own source's ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MAX_REPEATS))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    top = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return s.select("source", "source_size", F.least("cap", F.coalesce(top * F.col("weight"), F.col("cap"))).alias("target"))


def newton_rates(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rate``: exp of each source's dual variable after Newton's iterations, at most MAX_REPEATS."""
    dual = F.expr(f"aggregate(sequence(1, {NEWTON_STEPS}), 0D, (x, i) -> x - (source_size * exp(x) - target) / (source_size * exp(x)))")
    return sources.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.least(F.exp(dual), F.lit(float(MAX_REPEATS)))).otherwise(0.0))


def _cutoffs(rows: DataFrame) -> DataFrame:
    """rows: (source, size, u). Per source: source_size, target, rate, and the place (cut_hb, cut_u) in hash order up to which the fraction goes.

    Sums per hash bucket give the one bucket of a source in which the fraction ends; only its rows are ordered.
    """
    rows = rows.withColumn("hb", F.shiftrightunsigned(F.col("u"), 64 - BUCKET_BITS))
    buckets = rows.groupBy("source", "hb").agg(F.sum("size").alias("bucket_size"))
    sources = newton_rates(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))))
    sources = written(sources.withColumn("wanted", (F.col("rate") - _whole("rate")) * F.col("source_size")))
    b, s = buckets.alias("b"), small(sources).alias("s")
    buckets = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "wanted")
    earlier = Window.partitionBy("source").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    last = buckets.where("before < wanted").groupBy("source").agg(F.max(F.struct("hb", "before", "wanted")).alias("at")).select("source", "at.*")
    last = written(last)
    inside = rows.alias("r").join(small(last).alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.hb") == F.col("l.hb"))).select("r.*", "l.before", "l.wanted")
    upto = F.sum("size").over(Window.partitionBy("source", "hb").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("middle", F.col("before") + upto - F.col("size") / 2).where("middle < wanted")
    cut = inside.groupBy("source").agg(F.max("u").alias("cut_u"))
    l, c, s = last.alias("l"), cut.alias("c"), sources.alias("s")
    out = s.join(l, F.col("s.source").eqNullSafe(F.col("l.source")), "left").join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left")
    return written(out.select("s.source", "s.source_size", "s.target", "s.rate", F.col("l.hb").alias("cut_hb"), F.col("c.cut_u").alias("cut_u")))


def _whole(rate: str) -> Column:
    return F.floor(F.col(rate) + 1e-9)


def _copies(size: Column, u: Column) -> Column:
    """Copies of a document, by the columns of :func:`_cutoffs`: the whole part of the rate, and one more before the cut."""
    hb = F.shiftrightunsigned(u, 64 - BUCKET_BITS)
    extra = (size > 0) & ((hb < F.col("cut_hb")) | ((hb == F.col("cut_hb")) & (u <= F.col("cut_u"))))
    return (_whole("rate") + F.when(extra, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken."""
    rows = written(docs.select(col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"), F.xxhash64(col(id_col), F.xxhash64(col(text_col))).alias("u")))
    s = small(_cutoffs(rows.select("source", "size", "u"))).alias("s")
    out = rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source")))
    out = out.select(F.col("r.id").alias("doc_id"), "r.size", "s.source_size", "s.target", "s.rate", _copies(F.col("r.size"), F.col("r.u")).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts aren't shuffled unless the sources are too many to broadcast."""
    names = fresh(docs, "source", "size", "u", "copies")
    source, size, u, copies = names
    hashed = docs.withColumns({size: word_count(col(text_col)), u: F.xxhash64(col(id_col), F.xxhash64(col(text_col)))})
    slim = written(hashed.select(col(source_col).alias("source"), F.col(size).alias("size"), F.col(u).alias("u")))
    s = _cutoffs(slim).select(F.col("source").alias(source), "rate", "cut_hb", "cut_u")
    inner = fresh(docs, "rate", "cut_hb", "cut_u")
    # The names of the cutoffs must not meet columns of the documents.
    clash = {"rate", "cut_hb", "cut_u"} & {c.lower() for c in docs.columns}
    row = hashed if not clash else hashed.select(F.struct(*[col(c) for c in docs.columns]).alias(inner[0]), F.col(size), F.col(u), col(source_col).alias(inner[1]))
    key = col(source_col) if not clash else F.col(inner[1])
    joined = row.join(small(s), key.eqNullSafe(F.col(source)))
    joined = joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), _copies(F.col(size), F.col(u)))))
    return joined.select(*[col(c) for c in docs.columns]) if not clash else joined.select(f"{inner[0]}.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
