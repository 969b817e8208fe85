"""Delimited text with a header line, all fields as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.operators.crosscheck import population
from gradeline.sources.snapshot import bind_header


def read_delimited(spark: SparkSession, path: str, columns: dict[str, str], delimiter: str = "|", prefix: tuple[str, str] | None = None) -> DataFrame:
    """The wanted columns (published name -> ours) as text, trimmed, blank as null; quotes are ordinary signs.

    Names are bound by the header, case and order aside; a missing one is an error. Lines with fewer fields have nulls for
    the rest, further fields are passed over. prefix (published name, text): only rows that begin so; the scan itself drops
    the others."""
    scan = spark.read.option("sep", delimiter).option("quote", "").option("escape", "").option("header", "true").option("inferSchema", "false").option("mode", "PERMISSIVE")
    header = scan.csv(path).columns
    place = bind_header(header, list(columns))
    rows = spark.read.option("sep", delimiter).option("quote", "").option("escape", "").option("header", "true").option("enforceSchema", "true").schema(", ".join(f"`c{k}` string" for k in range(len(header)))).csv(path)
    if prefix is not None:
        rows = rows.filter(F.col(f"c{place[prefix[0].upper()]}").startswith(prefix[1]))
    return rows.select(*[F.nullif(F.trim(F.col(f"c{place[theirs.upper()]}")), F.lit("")).alias(ours) for theirs, ours in columns.items()])


def read_population(spark: SparkSession, path: str, year: int, key: str = "GEO_ID", value: str = "B01003_E001", margin: str = "B01003_M001", prefix: str = "0500000US", width: int = 5) -> DataFrame:
    """Population by area from a pipe-delimited table: geoid, geoid_fq, population, margin, vintage, period, table.

    Only rows of the key's prefix; a value that is negative or no whole number is null; the margin of error stays with it.
    The period is the five years that end with `year`."""
    raw = read_delimited(spark, path, {key: "key", value: "value", margin: "margin"}, prefix=(key, prefix))
    people = population(raw, prefix, width, "key", "margin")
    margin_ = F.col("margin").try_cast("bigint")
    return people.select("geoid", F.col("key").alias("geoid_fq"), "population", F.when(margin_ >= 0, margin_).alias("margin"), F.lit(year).cast("smallint").alias("vintage"), F.lit(f"{year - 4}-{year}").alias("period"), F.lit(value.split("_")[0]).alias("table"))
