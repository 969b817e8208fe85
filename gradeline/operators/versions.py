"""Numbered manifests in a folder: the next number goes to one writer only, readers see whole manifests."""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file of a new name; readers see it whole or not at all, and writers of other names don't meet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hidden, final = path(f"{folder}/.{name}"), path(f"{folder}/{name}")
    fs = hidden.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(hidden, final):
        raise OSError(f"{final} can't be written")


class VersionTaken(RuntimeError):
    """Another writer has published the version that this one was to become."""


class Versions:
    """`00000001.json`, `00000002.json`, ... in a folder that all machines share.

    A manifest is written under a name of its own and then linked or renamed to its number; both fail where the number is
    there already (hard links on local and mounted file systems, renames without overwriting elsewhere). A reader that has
    loaded a version keeps reading its files, whatever is published later."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([folder.rstrip("/"), *parts]))
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder, self.jvm = folder, jvm

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path()):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path()))
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d{8,})\.json", n) for n in names) if m)

    def load(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"{number:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, manifest); (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.load(numbers[-1])) if numbers else (0, {})

    def publish(self, after: int, manifest: dict) -> int:
        """Make `manifest` the version after `after`. VersionTaken if another writer was first."""
        number, own = after + 1, f".{uuid.uuid4().hex}"
        self.fs.mkdirs(self.path())
        if number in self.numbers():
            raise VersionTaken(f"{self.folder}: version {number} is there already")
        out = self.fs.create(self.path(own), False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, default=str).encode()))
        out.close()
        name = f"{number:08d}.json"
        try:
            if self.fs.getUri().getScheme() == "file":
                local = [unquote(urlparse(self.fs.makeQualified(self.path(n)).toUri().toString()).path) for n in (own, name)]
                try:
                    os.link(*local)
                except FileExistsError:
                    raise VersionTaken(f"{self.folder}: version {number} is there already") from None
            elif not self.fs.rename(self.path(own), self.path(name)):
                raise VersionTaken(f"{self.folder}: version {number} is there already")
        finally:
            self.fs.delete(self.path(own), False)
        return number
