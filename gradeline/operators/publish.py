"""Run directories, manifests from what was written, and a pointer that moves only after all checks."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradeline.operators.checks import gate, written_per_vintage
from gradeline.operators.versions import Versions, VersionTaken, put_text

LEDGER = "run_id string, source_hash string, year int, status string, n_rows bigint, n_read bigint, n_rejected bigint, error string, at timestamp"


def _ledger(spark: SparkSession, root: str, *row) -> None:
    """One more row, in a file of its own: attempts that run at once don't meet."""
    names = [x.split()[0] for x in LEDGER.split(", ")]
    told = dict(zip(names, [*row, datetime.now(UTC).isoformat()], strict=True))
    put_text(spark, f"{root}/ledger", f"{uuid.uuid4().hex}.json", json.dumps(told))


def _read(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """The rows under a path; none if it does not exist yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """A row for each state of each attempt: Running, then Completed or Failed (and Retired), with what was read, rejected and written."""
    return _read(spark, f"{root}/ledger", LEDGER, "json")


def versions(spark: SparkSession, root: str) -> Versions:
    """The pointer: one numbered manifest for each publication."""
    return Versions(spark, f"{root.rstrip('/')}/versions")


def current_run(spark: SparkSession, root: str) -> str | None:
    """The attempt that readers see, by the pointer."""
    return versions(spark, root).latest()[1].get("run_id")


def job_id(source_hash: str, year: int) -> str:
    """The same for the same source and year."""
    return hashlib.sha256(f"{source_hash}:{year}".encode()).hexdigest()[:16]


def content_digest(df: DataFrame) -> list[Column]:
    """Aggregates that tell the rows apart whatever their order: two sums of 64-bit hashes over all values and which are null."""
    names = sorted(df.columns)
    value = [F.to_json(c) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in names]
    empty = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in names])
    both = [F.sum(F.xxhash64(*value, empty, F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(b, F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"digest{k}") for k, b in enumerate(both)]]


@dataclass
class Table:
    """One file to publish: its rows, the key that sorts them, columns whose spans and distinct values the manifest states, the
    year column of its rows per year, and the rows per year (`year`, converted) that the rows must come to."""

    rows: DataFrame
    key: list[str]
    spans: list[str] = field(default_factory=list)
    distinct: list[list[str]] = field(default_factory=list)
    year: str | None = None
    converted: DataFrame | None = None


def contents(back: DataFrame, table: Table) -> dict:
    """What the manifest says of the rows read back: n, digest, rows with a null in the key, spans, distinct values, rows per year."""
    null_key = F.array_contains(F.array(*[F.col(k).isNull() for k in table.key]), True)
    spans = [f(F.col(c)).cast("string").alias(f"{name}{k}") for k, c in enumerate(table.spans) for name, f in (("low", F.min), ("high", F.max))]
    found = back.agg(*content_digest(back), F.count_if(null_key).alias("null_keys"), *spans, *[F.count_distinct(F.struct(*c)).alias(f"distinct{k}") for k, c in enumerate(table.distinct)]).first()
    out = {"rows": found["n"], "digest": [found["digest0"], found["digest1"]], "null_keys": found["null_keys"]}
    out["spans"] = {c: [found[f"low{k}"], found[f"high{k}"]] for k, c in enumerate(table.spans)}
    out["distinct"] = {",".join(c): found[f"distinct{k}"] for k, c in enumerate(table.distinct)}
    if table.year:
        # as many as there are years
        out["rows_per_year"] = {str(r[0]): r["count"] for r in back.groupBy(table.year).count().orderBy(table.year).collect()}
    return out


def _holds(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Mapping[str, str]) -> list[str]:
    """The rules (SQL over the tables by their names, one value each) that are not true."""
    bad = []
    for name, sql in rules.items():
        first = spark.sql(sql, **tables).first()
        if first is None or first[0] is not True:
            bad.append(name)
    return bad


def publish(
    spark: SparkSession, root: str, tables: Mapping[str, Table | tuple[DataFrame, list[str]]], checks: dict[str, DataFrame], source_hash: str, year: int,
    force: bool = False, with_csv: bool = False, n_read: int | None = None, n_rejected: int | None = None, rules: Mapping[str, str] | None = None,
) -> dict | None:
    """Check, write every table sorted by its key under the attempt's own directory, check what is there, then move the pointer.

    The same (hash, year) that is served is skipped (None) unless forced. A forced run writes beside the served one, which
    stays as it is until the pointer moves. Each table is computed once: the rows that go out are counted and digested on
    their way, and those read back must be the same rows, and not none, with no null in the key; rows per year must be those
    converted; `rules`, SQL over the tables read back ({name} stands for a table), must give true. CSV is made from what was
    written. The manifest tells what was read back.

    A failed check or rule leaves the pointer where it was and a Failed row in the ledger. The pointer is the number after
    the one that was served when the run began: of two publishers at once the second gets VersionTaken, with a Failed row.
    """
    pointer = versions(spark, root)
    number, now = pointer.latest()
    job = job_id(source_hash, year)
    if not force and now.get("run_id", "").startswith(job):
        return None
    run_id = f"{job}-{uuid.uuid4().hex[:12]}"
    _ledger(spark, root, run_id, source_hash, year, "Running", None, n_read, n_rejected, None)
    try:
        gate(checks)
        manifest: dict = {"run_id": run_id, "source_hash": source_hash, "year": year, "n_read": n_read, "n_rejected": n_rejected, "tables": {}, "contents": {}}
        written: dict[str, DataFrame] = {}
        for name, given in tables.items():
            table = given if isinstance(given, Table) else Table(*given)
            at, seen = f"{root}/run_id={run_id}/{name}", Observation()
            table.rows.orderBy(*table.key).observe(seen, *content_digest(table.rows)).write.mode("errorifexists").option("compression", "zstd").parquet(at)
            back = written[name] = spark.read.schema(table.rows.schema).parquet(at)
            if with_csv:
                back.orderBy(*table.key).write.option("header", True).csv(f"{at}_csv")
            told, sent = contents(back, table), seen.get
            if [told["rows"], *told["digest"]] != [sent["n"], sent["digest0"], sent["digest1"]] or not told["rows"]:
                raise ValueError(f"{name}: what was read back ({told['rows']} rows) is not what was written ({sent['n']} rows)")
            if told["null_keys"]:
                raise ValueError(f"{name}: {told['null_keys']} rows have a null in their key")
            if table.converted is not None and (off := written_per_vintage(back, table.converted, table.year or "VINTAGE_YEAR").collect()):
                raise ValueError(f"{name}: rows per year differ from those converted: {[tuple(r) for r in off]}")
            manifest["tables"][name], manifest["contents"][name] = told["rows"], told
        if bad := _holds(spark, written, rules or {}):
            raise ValueError(f"rules that don't hold: {bad}")
        manifest["version"] = pointer.publish(number, manifest)
    except Exception as e:
        _ledger(spark, root, run_id, source_hash, year, "Failed", 0, n_read, n_rejected, str(e)[:500])
        raise
    _ledger(spark, root, run_id, source_hash, year, "Completed", sum(manifest["tables"].values()), n_read, n_rejected, None)
    return manifest


def manifest_of(spark: SparkSession, root: str, run_id: str) -> dict:
    """The manifest of a run that was published."""
    pointer = versions(spark, root)
    for n in reversed(pointer.numbers()):
        if (told := pointer.load(n))["run_id"] == run_id:
            return told
    raise ValueError(f"{run_id} was never published")


def reconcile(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """(name, expected, actual) of the run's tables whose files hold other rows than the manifest says, be their number the same."""
    told = manifest_of(spark, root, run_id)["contents"]
    rows = []
    for name, c in told.items():
        back = spark.read.parquet(f"{root}/run_id={run_id}/{name}")
        found = back.agg(*content_digest(back))
        same = (F.col("n") == c["rows"]) & (F.col("digest0") == c["digest"][0]) & (F.col("digest1") == c["digest"][1])
        rows.append(found.filter(~same).select(F.lit(name).alias("name"), F.lit(c["rows"]).cast("long").alias("expected"), F.col("n").alias("actual")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def retire(spark: SparkSession, root: str, grace: timedelta) -> list[str]:
    """Delete the files of attempts that readers can no longer get: superseded and failed ones, and those that never ended,
    if nothing happened to them for `grace` (readers and publishers that run longer are not known to anyone). The ledger
    tells it. Manifests stay."""
    serving = current_run(spark, root)
    last = ledger(spark, root).groupBy("run_id").agg(F.max("at").alias("at"), F.max_by("status", "at").alias("status"), F.max("source_hash").alias("h"), F.max("year").alias("y"))
    pointer = versions(spark, root)
    # a run is superseded when the one after it completes
    since = {pointer.load(a)["run_id"]: pointer.load(b)["run_id"] for a, b in zip(pointer.numbers(), pointer.numbers()[1:], strict=False)}
    rows = {r["run_id"]: r for r in last.collect()}
    limit, gone = datetime.now() - grace, []
    for run, r in rows.items():
        ended = max(r["at"], rows[since[run]]["at"] if since.get(run) in rows else r["at"])
        path = pointer.path("..", f"run_id={run}")
        if run != serving and r["status"] != "Retired" and ended <= limit:
            pointer.fs.delete(path, True)
            _ledger(spark, root, run, r["h"], r["y"], "Retired", None, None, None, None)
            gone.append(run)
    return sorted(gone)


def read_back(spark: SparkSession, path: str, schema: str, key: list[str], rules: dict[str, str], expected: int | None = None) -> DataFrame:
    """Published rows, after all their checks: exactly the columns and types of `schema`, no null or repeated key, every rule
    (a SQL condition) true of every row, and as many rows as expected. One ValueError names all that is wrong."""
    rows = spark.read.parquet(path)
    declared = spark.createDataFrame([], schema).schema
    found, wanted = ({f.name: f.dataType.simpleString() for f in s} for s in (rows.schema, declared))
    if found != wanted:
        raise ValueError(f"{path}: has the columns {found}, not {wanted}")
    null_key = F.array_contains(F.array(*[F.col(k).isNull() for k in key]), True)
    sums = rows.agg(F.count("*").alias("n"), F.count_if(null_key).alias("null_keys"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())]).first()
    again = rows.groupBy(*key).count().filter("count > 1").limit(1).count()
    bad = [f"{name} ({sums[f'r{k}']} rows)" for k, name in enumerate(rules) if sums[f"r{k}"]]
    bad += ["null keys"] if sums["null_keys"] else []
    bad += ["repeated keys"] if again else []
    bad += [f"{sums['n']} rows, not {expected}"] if expected is not None and sums["n"] != expected else []
    if bad:
        raise ValueError(f"{path}: {'; '.join(bad)}")
    return rows


def served(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current run, with its run id and the time of its completed ledger row."""
    run = current_run(spark, root)
    if run is None:
        raise ValueError(f"{root}: nothing is published")
    rows = spark.read.parquet(f"{root}/run_id={run}/{name}").withColumn("run_id", F.lit(run))
    runs = ledger(spark, root).filter((F.col("status") == "Completed") & (F.col("run_id") == run)).groupBy("run_id").agg(F.max("at").alias("published_at"))
    return rows.join(F.broadcast(runs), "run_id")


__all__ = ["Table", "VersionTaken", "content_digest", "contents", "current_run", "job_id", "ledger", "manifest_of", "publish", "read_back", "reconcile", "retire", "served", "versions"]
