"""A table kept in parts by the hash of its key: upserts rewrite the parts that they touch and swap a manifest last."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeline.operators.ingest import upsert
from gradeline.operators.versions import Versions


class KeyedTable:
    """Rows under `root`, in `parts` numbered parts by their key (null keys are equal to each other).

    A load writes its parts into a folder of its own; the manifest of the next version names for each part the folder that
    holds it. Readers go by the manifest that they have loaded, so a load that runs, dies or loses to another one changes
    nothing for them, and parts without an incoming key stay the same files. Old folders go by `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str] | None = None, parts: int = 64):
        """Opens the table, or begins one with this key and number of parts; the number is fixed with the first load."""
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/versions")
        self.version, self.manifest = self.versions.latest()
        self.key: list[str] = self.manifest.get("key") or key or []
        self.parts: int = self.manifest.get("parts", parts)
        if not self.key or key is not None and key != self.key:
            raise ValueError(f"the key is {self.manifest.get('key')}, not {key}")

    def _part(self) -> Column:
        null = F.concat_ws("", *[F.col(k).isNull().cast("int").cast("string") for k in self.key])
        return F.pmod(F.xxhash64(*self.key, null), F.lit(self.parts)).cast("int")

    def _paths(self, only: set[int] | None = None) -> list[str]:
        held = self.manifest.get("folders", {})
        return [f"{self.root}/{folder}/_part={k}" for k, folder in sorted(held.items(), key=lambda x: int(x[0])) if only is None or int(k) in only]

    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(self.manifest["schema"]) if self.manifest else None

    def rows(self, only: set[int] | None = None) -> DataFrame:
        """The rows of the version that was loaded."""
        schema = self.schema()
        if schema is None:
            raise ValueError(f"{self.root}: nothing is loaded")
        paths = self._paths(only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def refresh(self) -> KeyedTable:
        """Go on to the newest version."""
        self.version, self.manifest = self.versions.latest()
        return self

    def load(self, incoming: DataFrame) -> dict:
        """Replace all rows of the incoming keys; VersionTaken if another load was first (nothing is changed then).

        Returns how many parts were rewritten. Incoming rows are computed once, into the load's own folder; the parts that
        they touch are told by numbers, at most `parts`. Parts of any size are written by as many tasks as they need."""
        schema = self.schema()
        if schema is not None and {f.name: f.dataType for f in schema} != {f.name: f.dataType for f in incoming.schema}:
            raise ValueError(f"rows of {incoming.schema.simpleString()} can't go to {schema.simpleString()}")
        own = f"load-{uuid.uuid4().hex}"
        staged_at = f"{self.root}/{own}-in"
        incoming.withColumn("_part", self._part()).write.partitionBy("_part").parquet(staged_at)
        staged = self.spark.read.schema(T.StructType([*incoming.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(staged_at)
        touched = {r[0] for r in staged.select("_part").distinct().collect()}
        rows = staged.drop("_part")
        if schema is not None and touched:
            rows = upsert(self.rows(touched), rows.select(*schema.names), self.key)
        folders = dict(self.manifest.get("folders", {}))
        if touched:
            rows.withColumn("_part", self._part()).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.root}/{own}")
            folders |= {str(k): own for k in touched}
        manifest = {"key": self.key, "parts": self.parts, "schema": (schema or incoming.schema).jsonValue(), "folders": folders}
        try:
            self.version = self.versions.publish(self.version, manifest)
        finally:
            self.versions.fs.delete(self.versions.path("..", f"{own}-in"), True)
        self.manifest = manifest
        return {"version": self.version, "rewritten": len(touched), "kept": len(folders) - len(touched)}

    def vacuum(self, grace: timedelta) -> list[str]:
        """Delete the folders that the newest manifest doesn't name, if they were last written more than `grace` ago."""
        needed = {*self.versions.latest()[1].get("folders", {}).values()}
        limit, gone = (datetime.now() - grace).timestamp() * 1000, []
        for s in self.versions.fs.listStatus(self.versions.path("..")):
            name = s.getPath().getName()
            if name.startswith("load-") and name not in needed and s.getModificationTime() <= limit:
                self.versions.fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)
