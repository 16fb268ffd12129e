"""Mixing sources to target weights with hash-threshold histograms.

A source's target comes from weights by water-filling: each source gets its weight's share of all tokens, none
more than ``max_epochs`` times its own tokens, the excess reshared by weight. A source whose target is r times its
tokens gives every document floor(r) times, and once more those whose hash lies below the source's threshold.

The threshold is found without sorting: token sums by source and leading hash bits give the bucket in which
the budget ends; only that bucket is summed again by the next bits, and so on for ``LEVELS`` levels. Thresholds are
nested: a larger budget takes a superset of the documents of a smaller one. Each level is one
map-side combined aggregation whose result has at most 2^BITS rows a source.

Sizes are words (runs of other characters than ASCII white space). Null or empty texts have size 0 and are taken as 0.
A null source is a source of its own, last in order. The hash covers the doc_id, or the text where doc_id is null, so
reruns agree and rows that repeat a doc_id go together. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import numbered
from .shared import broadcast_if_small, materialise

BITS, LEVELS = 12, 4
#: rows of per-source figures that are broadcast at most
BROADCAST_SOURCES = 50_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``totals(source, source_size)`` with each source's ``target`` in tokens.

    Sources in code-point order, null last, take the weights in turn. A source is full if its share of what the full ones leave
    reaches its cap; sums over all sources tell the share, until no more become full. They are sums of whole numbers, so
    that reruns agree to the last bit.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rn") % len(weights) + 1).cast("int"))
    rows = numbered(totals, [F.col("source").asc_nulls_last()], "rn").withColumn("weight", weight.cast("long"))
    rows = materialise(rows.withColumn("cap", F.col("source_size") * max_epochs).drop("rn"), "sources")
    total, free = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if not free:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    level, n = total / free, 0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        caps, free, now = rows.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if now == n:
            return rows.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))
        level, n = (total - caps) / free, now


def _thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, whole, threshold): copies of every document, and the hash below which there is one more.

    ``sized(source, size, h)``, h in [0, 2^(BITS * LEVELS)).
    """
    per = 1 << BITS
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = aims.withColumn("whole", whole.cast("long"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    state = state.select("source", "whole", left.alias("left"), F.lit(0).cast("long").alias("prefix"))
    state = materialise(state, "budgets")
    n = state.count()
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized
        if level:
            ends = state.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
            on = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift + BITS) == F.col("_p"))
            inside = sized.join(broadcast_if_small(ends, n, BROADCAST_SOURCES), on).drop("_s", "_p")
        bucket = F.shiftright("h", shift).bitwiseAND(F.lit(per - 1))
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        histogram = materialise(histogram, "histogram")
        run = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        joined = state.alias("s").join(histogram.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
        # at the last level a bucket is one document, taken if that comes nearer to the budget
        over = F.col("t.tokens") / 2 if level == LEVELS - 1 else F.lit(0)
        fits = F.col("t.upto") - over <= F.col("s.left")
        # the first bucket that no longer fits is refined; all before it are taken
        joined = joined.groupBy(F.col("s.source").alias("source"), "s.whole", "s.left", "s.prefix").agg(
            F.coalesce(F.min(F.when(~fits, F.col("t.bucket"))), F.lit(per)).alias("end"),
            F.coalesce(F.max(F.when(fits, F.col("t.upto"))), F.lit(0)).alias("used"),
        )
        # where all buckets fit, the threshold is the end of the last bucket
        prefix = F.col("prefix") * per + F.col("end")
        state = materialise(joined.select("source", "whole", (F.col("left") - F.col("used")).alias("left"), prefix.cast("long").alias("prefix")), "budgets")
    return state.select("source", "whole", F.col("prefix").alias("threshold"))


def _hash():
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return F.shiftrightunsigned(key, 64 - BITS * LEVELS)


def _plan(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: _s, source_size, target, whole, threshold; broadcast if counted as small."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialise(targets(totals, weights, max_epochs), "targets")
    limits = materialise(_thresholds(sized.select("source", "size", "h"), aims), "thresholds")
    plan = aims.alias("x").join(limits.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")))
    plan = materialise(plan.select(F.col("x.source").alias("_s"), "source_size", "target", "whole", "threshold"), "plan")
    return broadcast_if_small(plan, plan.count(), BROADCAST_SOURCES)


def _sized(docs: DataFrame) -> DataFrame:
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        _hash().alias("h"),
    )
    return materialise(sized, "sizes")


def _epochs(max_epochs: int):
    epochs = F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")
    return F.least(epochs, F.lit(max_epochs).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size and target (of its source), taken (words, repeats counted), epochs."""
    sized = _sized(docs)
    plan = _plan(sized, weights, max_epochs)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("epochs", _epochs(max_epochs))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``max_epochs`` times), all columns kept.

    A filter on the hash and a repeat: texts are not shuffled.
    """
    plan = _plan(_sized(docs), weights, max_epochs).select("_s", "whole", "threshold")
    # the row travels as one struct, so that no column of it can clash with the plan's
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.select(row, docs["source"].cast("string").alias("source"), _hash().alias("h"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_s"])).where(_epochs(max_epochs) > 0)
    times = F.sequence(F.lit(1).cast("long"), _epochs(max_epochs))
    return rows.select("row", F.explode(times).alias("n")).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
