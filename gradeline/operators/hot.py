"""Joins whose keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT of all rows is hot (there are fewer than HOT of them); its rows are dealt to SALTS tasks.
HOT, SALTS = 200, 64


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys that more than 1/HOT of all rows have: fewer than HOT, found by counts that are summed before the exchange."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    most = counts.orderBy(F.desc("_n"), *on).limit(HOT).collect()
    if not most or most[0]["_n"] <= SALTS:
        return None
    total = rows.count()
    found = [tuple(r[k] for k in on) for r in most if r["_n"] * HOT > total]
    return rows.sparkSession.createDataFrame(found, counts.select(*on).schema) if found else None


def join_dealt(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join `rows` to a `table` by equal keys; rows of hot keys are dealt to many tasks, each with the table's rows of the key.
    hint: Spark's join hint for the table, needed where its size can't be told from what it is made of.

    A row's task follows from its place among the `rows`, so these must come in the same order when a lost executor's work
    is done again: read from files."""
    hinted = lambda t: t.hint(hint) if hint else t
    hot = hot_keys(rows, on)
    if hot is None:
        return rows.join(hinted(table), on, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    mine = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, on, "left").withColumn("_salt", mine).drop("_hot")
    wide = table.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(hinted(wide), [*on, "_salt"], how).drop("_salt")
