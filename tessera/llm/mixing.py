"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets words in proportion to its weight, but no more than ``max_epochs`` times its size; what a full source
cannot take is shared again among the others by weight until none is above its cap. A source's target is then taken as
whole repetitions of all its documents and, for the rest, once more of the documents that come first in a seeded random
order; the document at which the target is reached is repeated in part, so a source's words miss its target by less
than one word.

Defined results: a null text has no words; a null source is a source of its own, ranked last; a null id is hashed as an
empty one; rows that repeat an id are rows of their own; a source without words has target 0; an empty table gives no
rows. Only ``doc_id``, ``source`` and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_settled, settle

WEIGHTS = (3, 1, 2)
#: All targets together, as a fraction of all sizes.
SHARE = (3, 2)
MAX_EPOCHS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that split a source: the running sum is taken in 16**3 parts, so a hot source is no hot task.
BUCKET_DIGITS = 3


def _running(frame: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``frame`` with, under each name, the sum of a column over all rows that come earlier in an order without ties.

    Rows are dealt by ranges of the order, summed within their range and moved by the sums of the ranges before it, so a
    task has the rows of one range, or one row for each range. The ranges are written down, as they are drawn by chance.
    """
    dealt = settle(frame.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("before_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("range").alias("before_range")).agg(*[F.sum(c).alias(f"{n}_sum") for n, c in sums.items()])
    ranges = totals.select("before_range", *[F.coalesce(F.sum(f"{n}_sum").over(earlier), F.lit(0)).alias(f"{n}_sum") for n in sums])
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = local.join(ranges, F.col("range") == F.col("before_range"))
    return joined.select(*frame.columns, *[(F.col(n) + F.col(f"{n}_sum")).alias(n) for n in sums])


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size): the level at which capped shares sum to ``share`` of all sizes.

    Sources sorted by cap over weight fill up in that order, so the level is known at the first source that does not
    fill up: no iteration is needed. There may be as many sources as web sites: no task has more than a range of them,
    and two single rows (the totals, the first open source) reach the driver.
    """
    up, down = share
    by_code_point = F.col("source").asc_nulls_last()
    placed = _running(sizes.select("source", "source_size"), [by_code_point], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = placed.select("source", "source_size", (F.col("source_size") * max_epochs).alias("cap"), weight.alias("weight"))
    filling = _running(ranked.withColumn("fill", F.col("cap") / F.col("weight")), [F.col("fill").asc(), by_code_point], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    drop_settled(placed)
    totals = filling.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weights_sum = totals["size"] or 0, totals["weight"] or 0
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731  # products of words and weights may pass 64 bits
    left_over, rest_weight = F.lit(size * up) - F.col("cap_before") * down, F.lit(weights_sum) - F.col("weight_before")
    full = wide(F.col("cap")) * wide(rest_weight * down) <= wide(left_over) * wide(F.col("weight"))
    first = F.struct("fill", F.col("source").isNull(), F.col("source"))
    level = filling.where(~full).agg(F.min_by(F.struct(left_over.alias("left_over"), rest_weight.alias("rest_weight")), first).alias("open")).first()["open"]
    target = F.col("cap").cast("double")
    if level is not None:
        shared = (wide(F.col("weight")) * wide(F.lit(level["left_over"]))).cast("double") / F.lit(float(level["rest_weight"] * down))
        target = F.when(full, target).otherwise(shared)
    return filling.select("source", "source_size", target.alias("target"))


def mix_sources(
    documents: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    if not weights or min(weights) <= 0 or max_epochs < 1 or share[0] > max_epochs * share[1]:
        raise ValueError("weights must be positive and the share within max_epochs")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = settle(
        documents.select("doc_id", "source", order.alias("ord"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix"
    )
    # A null source joins as the pair (empty, null).
    keyed = sized.withColumns({"s": F.coalesce("source", F.lit("")), "no_source": F.col("source").isNull(), "bucket": F.substring("ord", 1, BUCKET_DIGITS)})
    parts = keyed.groupBy("s", "no_source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = parts.groupBy("s", "no_source").agg(F.sum("bucket_size").alias("source_size"))
    filled = water_fill(sizes.select(F.when(~F.col("no_source"), F.col("s")).alias("source"), "source_size"), weights, share, max_epochs)
    filled = filled.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"), "source_size", "target")
    in_source = Window.partitionBy("s", "no_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0))).drop("bucket_size")
    parts = settle(parts.join(filled, ["s", "no_source"]), "mix-parts")
    drop_settled(filled)
    in_bucket = Window.partitionBy("s", "no_source", "bucket").orderBy("ord", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(parts, ["s", "no_source", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.col("target") - whole * F.col("source_size")
    before = (F.col("before_bucket") + F.col("before")).cast("double")
    part = F.least(F.col("size").cast("double"), F.greatest(F.lit(0.0), F.floor(budget - before).cast("double"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * whole + part).alias("taken"))
