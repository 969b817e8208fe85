"""Snapshot rows: validation with itemised reasons, canonical form, first-valid-wins, quarantine reports, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.codes import states
from gradeline.functions.ratings import blank_to_null, condition_class, decode_dms, guarded_pad, lowest, share, strict_digit
from gradeline.operators.hot import join_dealt

REASONS = ["row_structural_fault", "unknown_state_code", "structure_number_invalid", "coordinate_missing_or_zero", "coordinate_invalid", "coordinate_outside_state", "year_built_impossible", "adt_invalid", "structure_length_invalid", "condition_code_invalid", "duplicate_key"]
CONDITIONS = ["deck", "superstructure", "substructure", "culvert"]


def resolve_state(df: DataFrame, column: str) -> DataFrame:
    """Add fips, usps, state_name and bounds by padded FIPS or, case aside, by USPS code; null if unknown."""
    table = states(df.sparkSession)
    keys = table.select(F.explode(F.array("fips", "usps")).alias("_key"), *table.columns)
    return df.withColumn("_key", F.upper(guarded_pad(F.col(column), 2))).join(F.broadcast(keys), "_key", "left").drop("_key")


def with_state(df: DataFrame, column: str) -> DataFrame:
    """Add the same columns by padded FIPS alone, as published rows must have it; null if unknown."""
    table = F.broadcast(states(df.sparkSession))
    return df.withColumn("_key", guarded_pad(F.col(column), 2)).join(table, F.col("_key") == table["fips"], "left").drop("_key")


def inside_bounds(lat: Column, lon: Column) -> Column:
    """Bounds included; true where a state has none."""
    return F.col("south").isNull() | (lat.between(F.col("south"), F.col("north")) & lon.between(F.col("west"), F.col("east")))


def whole_number(c: Column) -> Column:
    """The trimmed text as a whole number of 32 bits if it is one, sign allowed."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def decimal_number(c: Column) -> Column:
    """The trimmed text, thousands separators taken out, as decimal(9,1)."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^[+-]?([0-9]{1,8}(\.[0-9]*)?|\.[0-9]+)$"), t.try_cast("decimal(9,1)"))


def validate(raw: DataFrame, snapshot_year: int) -> DataFrame:
    """Add `lat`, `lon`, the state's columns and `reasons`: every reason that a raw text row fails for, in REASONS' order."""
    df = with_state(raw, "state")
    df = df.withColumns({k if k != "fault" else "_fault": v for k, v in decode_dms(F.col("lat_raw"), F.col("lon_raw")).items()})
    given = lambda c: blank_to_null(F.col(c)).isNotNull()
    year, adt, length = whole_number(F.col("year_built")), whole_number(F.col("adt")), decimal_number(F.col("length"))
    bad_code = F.exists(F.array(*[blank_to_null(F.col(c)) for c in CONDITIONS]), lambda v: v.isNotNull() & ~v.rlike("^[0-9Nn]$"))
    tests = {
        "unknown_state_code": F.col("fips").isNull(),
        "structure_number_invalid": ~F.coalesce(F.length(blank_to_null(F.col("structure_number"))) <= 15, F.lit(False)),
        "coordinate_missing_or_zero": F.col("_fault") == "missing_or_zero",
        "coordinate_invalid": F.col("_fault").isin("malformed", "out_of_range"),
        "coordinate_outside_state": F.col("_fault").isNull() & F.col("fips").isNotNull() & ~inside_bounds(F.col("lat"), F.col("lon")),
        "year_built_impossible": given("year_built") & (year.isNull() | (year < 1600) | (year > snapshot_year + 1)),
        "adt_invalid": given("adt") & (adt.isNull() | (adt < 0)),
        "structure_length_invalid": given("length") & (length.isNull() | (length < 0)),
        "condition_code_invalid": F.coalesce(bad_code, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return df.withColumn("reasons", reasons).drop("_fault")


def canonical(valid: DataFrame, snapshot_year: int, *carried: str) -> DataFrame:
    """Typed and padded columns of valid rows, with the carried columns before them."""
    low = lowest(*[strict_digit(F.col(c)) for c in CONDITIONS])
    return valid.select(
        *carried, F.col("fips").alias("state_code"), guarded_pad(F.col("county"), 3).alias("county_code"), F.trim("structure_number").alias("structure_number"), blank_to_null(F.col("record_type"), "1").alias("record_type"),
        F.upper(blank_to_null(F.col("material"))).alias("material"), F.upper(guarded_pad(F.col("design"), 2)).alias("design"),
        whole_number(F.col("year_built")).alias("year_built"), whole_number(F.col("adt")).alias("adt"), decimal_number(F.col("length")).alias("length_m"),
        low.cast("int").alias("lowest"), condition_class(low).alias("condition_class"), F.lit(snapshot_year).alias("snapshot_year"),
    )


def first_valid_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Append duplicate_key to the reasons of every valid row but the first of its key; invalid rows claim no key.

    The first is a grouped minimum over valid rows, summed before the exchange. Keys of a single valid row need no more; only
    the others are joined back, and rows of a key that very many have are dealt to many tasks. Invalid rows don't move."""
    # nulls in a struct are equal to each other
    valid = df.filter(F.size("reasons") == 0).withColumn("_key", F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(key)]))
    first = valid.groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    told = join_dealt(valid, first, ["_key"], "left")
    told = told.withColumn("reasons", F.when(F.col(order) > F.col("_first"), F.array(F.lit("duplicate_key"))).otherwise(F.col("reasons")))
    return told.select(*df.columns).unionByName(df.filter(F.size("reasons") > 0))


def quarantine_by_reason(df: DataFrame) -> DataFrame:
    return df.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def reject_rate(df: DataFrame) -> DataFrame:
    """One row: n_read, n_rejected and rejected_percent (null without rows)."""
    sums = df.agg(F.count("*").alias("n_read"), F.count_if(F.size("reasons") > 0).alias("n_rejected"))
    return sums.withColumn("rejected_percent", share(F.col("n_rejected"), F.col("n_read"), 2))


def quarantine_by_state(df: DataFrame, top: int = 15) -> DataFrame:
    bad = df.filter(F.size("reasons") > 0)
    return bad.groupBy("state").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "state").limit(top)


def upsert(target: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The target with all rows of incoming keys replaced; null keys are equal to each other."""
    t, i = target.alias("t"), incoming.select(*key).distinct().alias("i")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"i.{k}"))
    return t.join(i, same, "left_anti").unionByName(incoming)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, then by the other columns."""
    rest = [c for c in df.columns if c not in key and c not in order]
    last = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in [*order, *rest]])
