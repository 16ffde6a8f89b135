"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its weight's share of the total budget, capped at ``max_epochs`` times its size; what a
cap frees is shared again by weight (water filling, solved in closed form from one row per source). Complete
epochs come first; the fraction left is filled in the order of the keys -ln(u) / w, u a hash of the document's id
and w its quality weight: the smallest keys are a weighted sample without replacement.

No source is sorted in one task: keys fall into buckets by the hash's leading digits (of the key's distribution
function), buckets' sizes are summed, and only within a bucket is there an order. The prefix sum of a document is
its bucket's offset plus its sum within the bucket.

Defined results: a null text has size 0 and is never taken in part; a null source is a source of its own, last;
a null weight counts as 1; rows that repeat are separate documents whose keys tie, all with the same key are
ordered by size and taken one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Documents of a bucket, about.
BUCKET = 2048
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """(0, 1), from the first 52 bits of the md5 of the key and the seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sources: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, weight, source_size) with ``target``. Only one row per source is ordered here: with the
    sources by cap / weight, the level that spends the budget lies between two neighbours."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    s = sources.withColumn("cap", cap).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    w = Window.orderBy("ratio", "rank")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(budget)
    s = s.withColumn("_capped", F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_weight", F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("_total", total)
    s = s.withColumn("_level", F.when(F.col("_weight") > 0, (F.col("_total") - F.col("_capped")) / F.col("_weight")))
    level = F.max(F.when(F.col("_level") <= F.col("ratio"), F.col("_level"))).over(Window.partitionBy())
    s = s.withColumn("_at", level)
    return s.withColumn("target", F.when(F.col("_at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("_at")))).drop("cap", "ratio", "_capped", "_weight", "_total", "_level", "_at")


def mix(df: DataFrame, sources: DataFrame | None = None, id_col: str = "doc_id", budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """df(id, source, size, weight) -> id, source, size, source_size, target, copies, taken, key and the columns ``keep``.

    ``sources``(source, weight) gives target weights; without it WEIGHTS repeat over the sources by code point,
    null last."""
    per = df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    if sources is None:
        per = per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS)))))
    else:
        given = sources.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        per = per.join(given, per["source"].eqNullSafe(given["_s"]), "left").drop("_s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    per = targets(per, budget, max_epochs).withColumn("epochs", F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(max_epochs)))
    per = per.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    small = per.select(F.col("source").alias("_s"), "rank", "source_size", "target", "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).alias("buckets"))
    u = uniform(F.col(id_col))
    docs = df.join(small, df["source"].eqNullSafe(small["_s"])).drop("_s")
    docs = docs.withColumn("key", -F.log(u) / F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), F.lit(1e-9)))
    docs = docs.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1))
    sums = docs.groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(offsets, ["rank", "bucket"])
    start = F.col("offset") + F.col("_inside")
    # taken if it ends within the rest, or if it crosses the rest's end and lands nearer to it than leaving it does
    more = (F.col("rest") - start >= F.col("size") / 2) & (F.col("size") > 0) & (F.col("rest") > 0) & (F.col("epochs") < max_epochs)
    docs = docs.withColumn("copies", (F.col("epochs") + more.cast("int")).cast("int"))
    return docs.select(F.col(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key", *keep)
