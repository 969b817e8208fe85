"""Yearly text vintages with drifting schemas, bound to one declared superset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradeline.functions.ratings import strict_digit
from gradeline.operators.publish import content_digest
from gradeline.sources.files import fingerprints
from gradeline.sources.snapshot import numbered_lines

#: The column that marks an era, narrowest first, and the years of each era.
ERA_SIGNATURES = (("ten_year_rule", "STATUS_WITH_10YR_RULE"), ("performance_measures", "BRIDGE_CONDITION"), ("sufficiency_rating", "SUFFICIENCY_RATING"))
ERA_YEARS = {"ten_year_rule": [*range(1992, 2010), *range(2012, 2019)], "sufficiency_rating": [2010, 2011], "performance_measures": [*range(2019, 2026)]}


def plain_fields(line: Column) -> Column:
    """Split on every comma; each field trimmed, one balanced pair of apostrophes taken off, trimmed again."""
    return F.transform(F.split(line, ",", -1), lambda f: F.trim(F.regexp_replace(F.trim(f), "^'(.*)'$", "$1")))


def era_of(columns: list[str]) -> str | None:
    present = {c.upper() for c in columns}
    return next((era for era, mark in ERA_SIGNATURES if mark in present), None)


def check_year(year: int, era: str | None) -> None:
    expected = next((e for e, years in ERA_YEARS.items() if year in years), None)
    if era is None or era != expected:
        raise ValueError(f"{year}: expected the era {expected}, the header is of {era}")


def read_vintage(spark: SparkSession, path: str, year: int, superset: list[str], key: list[str], ratings: list[str], seen: Observation | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, rejects, absent columns) of one file.

    Rows have VINTAGE_YEAR, SOURCE_FILE, SOURCE_SHA256, SOURCE_ROW, the superset as text (absent columns null) and a typed
    `_NUM` column for each rating. Rejects: row_field_count_mismatch and missing_key_field. seen: counts the data lines (`read`) as the first job over them scans them. An unknown column, a missing
    key column or a year of another era is an error."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "").withColumn("_fields", plain_fields(F.col("line")))
    first = lines.orderBy("line_number").first()
    header = [h.upper() for h in first["_fields"]]
    check_year(year, era_of(header))
    if unknown := sorted(set(header) - set(superset)):
        raise ValueError(f"unknown columns: {unknown}")
    if missing := sorted(set(key) - set(header)):
        raise ValueError(f"key columns are missing: {missing}")
    place = {h: k for k, h in reversed(list(enumerate(header)))}
    rows = lines.filter(F.col("line_number") > first["line_number"])
    rows = rows if seen is None else rows.observe(seen, F.count(F.lit(1)).alias("read"))
    rows = rows.join(F.broadcast(fingerprints(spark, path).select("file", "sha256")), "file", "left")
    blank = F.exists(F.array(*[F.get("_fields", place[k]) for k in key]), lambda v: F.coalesce(v, F.lit("")) == "")
    rows = rows.withColumn("reason", F.when(F.size("_fields") != len(header), "row_field_count_mismatch").when(blank, "missing_key_field"))
    value = lambda c: F.nullif(F.get("_fields", place[c]), F.lit("")) if c in place else F.lit(None).cast("string")
    good = rows.filter("reason is null").select(F.lit(year).cast("smallint").alias("VINTAGE_YEAR"), F.element_at(F.split("file", "/"), -1).alias("SOURCE_FILE"), F.col("sha256").alias("SOURCE_SHA256"), F.col("line_number").alias("SOURCE_ROW"), *[value(c).alias(c) for c in superset])
    good = good.withColumns({f"{r}_NUM": strict_digit(F.col(r)) for r in ratings})
    return good, rows.filter("reason is not null").select("line_number", "reason", F.col("line").alias("raw_line")), [c for c in superset if c not in place]


def write_vintages(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "zstd").partitionBy("VINTAGE_YEAR").parquet(path)


def read_vintages(spark: SparkSession, path: str, schema) -> DataFrame:
    """All vintages by the declared schema; schemas are never merged."""
    return spark.read.schema(schema).parquet(path)


def unified(df: DataFrame, renamed: dict[str, list[str]], numbers: dict[str, str]) -> DataFrame:
    """`df` with one column for names that changed over the years (the first given one that is not blank; names that no
    vintage here has are passed over) and numbers (ours -> published) as doubles, null where the text is none."""
    text = {ours: [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns] for ours, names in renamed.items()}
    merged = {ours: F.coalesce(*found) if found else F.lit(None).cast("string") for ours, found in text.items()}
    return df.withColumns(merged | {ours: F.trim(F.col(c).cast("string")).try_cast("double") for ours, c in numbers.items()})


def manifest_rows(df: DataFrame, json: str, entry: str = "string", key: str = "key", value: str = "entry") -> DataFrame:
    """A row for each key of JSON objects, with what it holds read as `entry` (a type, nested or not)."""
    held = F.from_json(F.col(json), f"map<string,{entry}>")
    return df.select(F.explode(held).alias(key, value))


def differing_counts(rows: DataFrame, manifest: DataFrame, year: str, stated: str) -> DataFrame:
    """Vintages that the manifest states with another number of rows than there are; one that either side lacks differs."""
    per = rows.groupBy(year).agg(F.count("*").alias("n_rows"))
    return per.join(manifest.select(year, stated), year, "full_outer").filter(~F.col("n_rows").eqNullSafe(F.col(stated)))


#: What a conversion says of one vintage.
SUMMARY = "year smallint, era string, file string, sha256 string, read bigint, converted bigint, rejected bigint, by_reason map<string,bigint>, reconciles boolean, absent_columns array<string>"


def convert_vintage(spark: SparkSession, path: str, out: str, year: int, superset: list[str], key: list[str], ratings: list[str]) -> DataFrame:
    """Convert one file to Parquet under `out` (rows, and rejects beside them) and tell how it went, one row of SUMMARY.

    Lines are counted where they are scanned, rows and rejects where they lie after writing: three counts that nothing makes
    equal but a conversion that loses nothing. An earlier conversion of the same year is replaced."""
    seen = Observation()
    rows, rejects, absent = read_vintage(spark, path, year, superset, key, ratings, seen)
    rows.drop("VINTAGE_YEAR").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/rows/VINTAGE_YEAR={year}")
    rejects.write.mode("overwrite").parquet(f"{out}/rejects/VINTAGE_YEAR={year}")
    source = fingerprints(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file"), "sha256")
    era = next(e for e, years in ERA_YEARS.items() if year in years)
    told = vintage_counts(spark, out, year).withColumn("read", F.lit(seen.get["read"]).cast("long"))
    told = told.crossJoin(F.broadcast(source)).withColumns({"year": F.lit(year).cast("smallint"), "era": F.lit(era), "absent_columns": F.array(*map(F.lit, absent)).cast("array<string>"), "reconciles": F.col("read") == F.col("converted") + F.col("rejected")})
    return told.select(*[c.split()[0] for c in SUMMARY.split(", ")])


def vintage_counts(spark: SparkSession, out: str, year: int) -> DataFrame:
    """converted, rejected and by_reason of what lies under `out` for the year."""
    rejects = spark.read.parquet(f"{out}/rejects/VINTAGE_YEAR={year}")
    return summary(spark.read.parquet(f"{out}/rows/VINTAGE_YEAR={year}"), rejects).drop("read")


#: Where a source came from, as its download noted it.
PROVENANCE = "file string, url string, archive string, archive_sha256 string, file_sha256 string, downloaded_at string"


def with_provenance(sources: DataFrame, provenance: DataFrame) -> DataFrame:
    """Sources (file, sha256, ...) of any kind, vintages or others, with what the downloads noted (PROVENANCE) and
    `same_bytes`: whether the file is the one that was downloaded (null where nothing was noted)."""
    noted = provenance.select(*[c.split()[0] for c in PROVENANCE.split(", ")])
    return sources.join(noted, "file", "left").withColumn("same_bytes", F.col("sha256") == F.col("file_sha256")).drop("file_sha256")


def read_provenance(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """PROVENANCE from the JSON notes of downloads under path (one object a file, at any depth), published name -> ours."""
    fields = [c.split()[0] for c in PROVENANCE.split(", ")]
    schema = ", ".join(f"`{k}` string" for k in names)
    notes = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    back = {ours: theirs for theirs, ours in names.items()}
    return notes.select(*[F.col(f"`{back[f]}`").alias(f) if f in back else F.lit(None).cast("string").alias(f) for f in fields])


def source_catalog(spark: SparkSession, sources: dict[str, tuple[str, DataFrame]], provenance: DataFrame) -> DataFrame:
    """A row for each file of further sources (kind -> (path, rows made of it)): kind, file, n_bytes, sha256, n_rows and digest of
    the rows, and where it came from. Kinds are as many as are named in the code."""
    found = None
    for kind, (path, rows) in sorted(sources.items()):
        n = rows.agg(*content_digest(rows)).select(F.col("n").alias("n_rows"), F.concat_ws(":", "digest0", "digest1").alias("digest"))
        files = fingerprints(spark, path).select(F.lit(kind).alias("kind"), F.element_at(F.split("file", "/"), -1).alias("file"), "n_bytes", "sha256")
        one = files.crossJoin(F.broadcast(n))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("there are no sources")
    return with_provenance(found, provenance)


def catalog(summaries: list[tuple[int, str, str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(vintages, totals): each (year, file, sha256, `summary`) as a row in order of the year, and the sums of all."""
    rows = None
    for year, file, sha256, one in summaries:
        row = one.select(F.lit(year).cast("smallint").alias("year"), F.lit(file).alias("file"), F.lit(sha256).alias("sha256"), "read", "converted", "rejected", "by_reason")
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        raise ValueError("there are no vintages")
    totals = rows.agg(F.count("*").alias("vintages"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), *[F.sum(c).alias(c) for c in ("read", "converted", "rejected")])
    return rows.orderBy("year"), totals


def summary(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """converted, rejected, and rejects by reason."""
    by = rejects.groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("by_reason"), F.coalesce(F.sum("n"), F.lit(0)).alias("rejected"))
    return good.agg(F.count("*").alias("converted")).crossJoin(by).withColumn("read", F.col("converted") + F.col("rejected"))
