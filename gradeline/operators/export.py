"""GeoJSON lines, bounded feature collections and CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(id_: Column, lon: Column, lat: Column, properties: list[str]) -> Column:
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_.alias("id"), point.alias("geometry"), F.struct(*properties).alias("properties")))


def geojson_lines(df: DataFrame, id_: Column, properties: list[str]) -> DataFrame:
    return df.select(feature(id_, F.col("lon"), F.col("lat"), properties).alias("line"))


def write_geojson(df: DataFrame, order: list[str], id_: Column, properties: list[str], path: str, run_id: str) -> int:
    """Write the features in order as lines, and beside them one line that names the run and counts what was written."""
    spark = df.sparkSession
    df.orderBy(*order).select(feature(id_, F.col("lon"), F.col("lat"), properties).alias("value")).write.text(f"{path}/features")
    n = spark.read.text(f"{path}/features").count()
    meta = spark.createDataFrame([(run_id, n)], "run_id string, features bigint").withColumn("written_at", F.current_timestamp())
    meta.coalesce(1).write.json(f"{path}/meta")
    return n


def capped_sizes(df: DataFrame, cap: int = 5000) -> DataFrame:
    """total, returned and truncated of a feature collection of at most `cap` features."""
    return df.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(cap)).alias("returned"), (F.col("total") > cap).alias("truncated"))


def capped_features(df: DataFrame, order: list[str], id_: Column, properties: list[str], cap: int = 5000) -> DataFrame:
    """One row: the sizes and the first `cap` features as an array of JSON texts; the cap is the feature."""
    first = df.orderBy(*order).limit(cap).select(*order, feature(id_, F.col("lon"), F.col("lat"), properties).alias("f"))
    listed = first.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "f"))), lambda s: s["f"]).alias("features"))
    return capped_sizes(df, cap).crossJoin(listed)


def csv_field(c: Column) -> Column:
    """RFC 4180: quoted if it holds a comma or quote; line breaks become spaces; null is empty."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r\n|\r|\n", " ")
    return F.when(text.rlike('[",]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_report(df: DataFrame, columns: list[str], order: list[str], preamble: list[str]) -> DataFrame:
    """Lines of a report in order: `#` lines, header, rows. (section, key..., line)"""
    spark = df.sparkSession
    head = spark.createDataFrame([(k, f"# {t}") for k, t in enumerate(preamble)] + [(len(preamble), ",".join(columns))], "at int, line string")
    body = df.select(*order, F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line")).orderBy(*order)
    numbered = body.select(F.monotonically_increasing_id().alias("k"), "line")
    return head.select(F.lit(0).alias("section"), F.col("at").cast("long").alias("k"), "line").unionByName(numbered.select(F.lit(1).alias("section"), "k", "line"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", "k").select("line").coalesce(1).write.option("lineSep", "\n").text(path)
