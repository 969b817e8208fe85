"""Mixing sources to target weights by repetition: floor(rate) copies plus a hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm.common import WORD_PATTERN, cut

#: Sources up to this number are broadcast (each row is a name and a few numbers); more are joined by a salted key.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Parts of the circle of draws among whose beginnings a source's seed is chosen.
STEPS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """One row per source: `_source`, `_source_size`, `_target` and `_rate`, from rows of (`_source`, `_size`).

    Sources in code-point order, null last, weigh 1, 2, ..., `cycle` and again. The targets share the sum of all sizes by
    weight; a target stops at `cap` times its source's size and the excess is shared anew. That is filling with water:
    by rising size/weight, a source is full if its share of what the sources before it leave is at least its limit.
    Partial sums leave one row per source, and only those rows meet in the ordered windows.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    per = per.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("long"))
    rising = Window.orderBy(F.col("size") / F.col("weight"), F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(every) - F.lit(float(cap)) * F.coalesce(F.sum("size").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", left / weights)
    full = F.lit(float(cap)) * F.col("size") <= F.col("_level") * F.col("weight")
    per = per.withColumn("_open", F.first(F.when(~full, F.col("_level")), ignorenulls=True).over(every))
    per = per.withColumn("_target", F.when(full, F.lit(float(cap)) * F.col("size")).otherwise(F.col("_open") * F.col("weight")))
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.col("_target") / F.col("size")))
    return per.select("_source", F.col("size").alias("_source_size"), "_target", rate.alias("_rate"))


def seed_shifts(sizes: DataFrame, rates: DataFrame, steps: int) -> DataFrame:
    """`rates` with `_shift`, the part of each source's seed: where the interval of draws that get one more copy begins.

    sizes has the words of each (`_source`, `_step`), a step being 1/steps of the circle of draws. Of all shifts the one
    is chosen whose interval holds words nearest to the fraction of the source; of equals the first. So a few very long
    documents don't carry a source far from its target. The interval's length is the fraction, whatever the shift; as draws
    are hashes of seed, id and text, over many seeds each document gets its extra copy about so often (see the test).
    """
    part = F.col("_rate") - F.floor("_rate")
    grid = rates.select("_source", "_source_size", part.alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(2 * steps))).alias("_at"))
    filled = grid.join(sizes.select(F.col("_source").alias("_s"), "_step", F.col("_size").alias("_words")), F.col("_source").eqNullSafe(F.col("_s")) & (F.pmod("_at", F.lit(steps)) == F.col("_step")), "left")
    along = Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = filled.withColumn("_sum", F.coalesce(F.sum(F.coalesce("_words", F.lit(0))).over(along), F.lit(0)))
    begin = sums.filter(F.col("_at") < steps).select(F.col("_source").alias("_b"), F.col("_at").alias("_shift"), F.col("_sum").alias("_from"), (F.col("_at") + F.round(F.col("_part") * steps)).cast("int").alias("_to"), (F.col("_part") * F.col("_source_size")).alias("_want"))
    both = begin.join(sums.select("_source", "_at", "_sum"), F.col("_b").eqNullSafe(F.col("_source")) & (F.col("_to") == F.col("_at")))
    best = both.groupBy(F.col("_b").alias("_of")).agg(F.min(F.struct(F.abs(F.col("_sum") - F.col("_from") - F.col("_want")).alias("gap"), "_shift")).alias("best"))
    return rates.join(best, F.col("_source").eqNullSafe(F.col("_of"))).select(*rates.columns, F.col("best._shift").alias("_shift"))


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5 of seed, id and text; equal rows draw alike in every run."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, seed: int, cap: float, text_col: str, source_col: str, id_col: str) -> DataFrame:
    """The input's columns as c0, c1, ... beside `_size`, `_source_size`, `_target` and `_copies`."""
    text, source, id_ = (F.col(f"c{docs.columns.index(c)}") for c in (text_col, source_col, id_col))
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    sized = inner.withColumns({"_size": word_count(text), "_draw": draw(seed, id_, text), "_from": source})
    sizes = cut(sized.groupBy(F.col("_from").alias("_source"), F.floor(F.col("_draw") * STEPS).cast("int").alias("_step")).agg(F.sum("_size").alias("_size")))
    rates = cut(seed_shifts(sizes, source_rates(sizes, cap), STEPS))
    same = F.col("_from").eqNullSafe(F.col("_source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(rates), same, "left")
    else:
        wide = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("_mine", F.pmod(F.xxhash64(id_, text), F.lit(SALTS)).cast("int")).join(wide, same & (F.col("_mine") == F.col("_salt")), "left")
    whole = F.floor("_rate")
    turned = F.col("_draw") - F.col("_shift") / F.lit(float(STEPS))
    extra = turned + F.when(turned < 0, 1.0).otherwise(0.0) < F.col("_rate") - whole
    return joined.withColumn("_copies", (whole + extra.cast("int")).cast("long"))


def mix_plan(docs: DataFrame, seed: int = 17, cap: float = 3.0, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Every document with `size` (words), `source_size`, `target` and `copies`, the number of times the mix takes it.

    A null text has size 0; a null source is a source of its own. Documents without words are taken like others, at no
    words. Equal rows get equal numbers of copies. An empty table gives an empty result. Input columns named size,
    source_size, target or copies are replaced, others stay whatever their names. Sources meet in one ordered window, one
    row each, so there may be thousands or millions of them, not as many as documents.
    """
    added = {"size": "_size", "source_size": "_source_size", "target": "_target", "copies": "_copies"}
    plan = _planned(docs, seed, cap, text_col, source_col, id_col)
    return plan.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in added], *[F.col(v).alias(k) for k, v in added.items()])


def mix_sources(docs: DataFrame, seed: int = 17, cap: float = 3.0, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself, with the columns of `docs`: each document repeated as `mix_plan` says, those with 0 copies left out."""
    plan = _planned(docs, seed, cap, text_col, source_col, id_col).filter("_copies > 0")
    return plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
