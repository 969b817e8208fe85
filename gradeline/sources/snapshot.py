"""Delimited snapshots: numbered physical lines, quoted fields, header binding, row or fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeline.functions.ratings import blank_to_null


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `line_number` (from 1, blank lines counted) and `line` of every line under path, in parallel.

    Rows of one file block stand together in one task, so a line's number is its place in the block plus the lines of
    the blocks before; only one row per block is ordered, and these rows (a few for each gigabyte) go to the lines, which stay
    where they are read."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(F.broadcast(blocks), ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int").alias("line_number"), "line")


#: What stands between the quotes, `""` for a quote; taken without going back, so that a field may be of any length.
_BETWEEN = r'[^"]*+(?:""[^"]*+)*+'


def quoted_fields(line: Column) -> Column:
    """Fields of one comma-separated line; a field that starts with a quote goes to its closing quote, `""` is a quote.

    Text after a closing quote is appended as it is; a quote that never closes takes the rest of the line. Each field is
    found with the comma before it, so the line gets one in front."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf',(?:"{_BETWEEN}(?:"[^,]*+|\z)|[^,]*+)'), 0)

    def plain(f: Column) -> Column:
        inner, tail = F.regexp_extract(f, f'^,"({_BETWEEN})', 1), F.regexp_extract(f, f'^,"{_BETWEEN}"([^,]*+)', 1)
        return F.when(f.startswith(',"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), tail)).otherwise(F.substring(f, 2, 2**31 - 1))

    return F.when(line.contains('"'), F.transform(fields, plain)).otherwise(F.split(line, ",", -1))


def bind_header(header: list[str], required: list[str]) -> dict[str, int]:
    """Upper-cased trimmed names to places; the first of equal names counts; a missing required name is an error."""
    found: dict[str, int] = {}
    for k, name in enumerate(header):
        found.setdefault(name.strip().upper(), k)
    missing = [r for r in required if r.upper() not in found]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return found


def read_snapshot(spark: SparkSession, path: str, columns: dict[str, str], required: list[str], key: list[str], limit: int | None = None) -> DataFrame:
    """Rows or faults of one file: line_number, raw_line, `fault`, and the wanted columns (published name -> ours), blank as null.

    A wrong number of fields or a blank key column is `row_structural_fault`. limit: only the first rows read, faults included."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    first = lines.orderBy("line_number").first()
    names = [str(x) for x in spark.createDataFrame([(first["line"],)], "line string").select(quoted_fields(F.col("line")).alias("f")).first()["f"]]
    places = bind_header(names, required)
    rows = lines.filter(F.col("line_number") > first["line_number"]).withColumn("_fields", quoted_fields(F.col("line")))
    if limit is not None:
        rows = rows.orderBy("line_number").limit(limit)
    value = lambda n: blank_to_null(F.get("_fields", places[n.upper()])) if n.upper() in places else F.lit(None).cast("string")
    rows = rows.withColumns({ours: value(name) for name, ours in columns.items()})
    bad = F.size("_fields") != len(names)
    for k in key:
        bad = bad | F.col(k).isNull()
    return rows.select("line_number", F.col("line").alias("raw_line"), F.when(bad, "row_structural_fault").alias("fault"), *columns.values())
