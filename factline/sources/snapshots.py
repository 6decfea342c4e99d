"""Snapshots of several tables that appear whole or not at all.

A version's tables are written into a folder of their own; then one small manifest, renamed into place, names
them. Readers go by the newest manifest, so they see a version's tables together or the version
before. A job that dies earlier leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "_manifests", "_data"


class Files:
    """The few file operations that a manifest needs, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.root = self.path(root)
        self.system = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that comes into being with its whole content; fails if there is one of that name."""
        hidden = self.path(f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}")
        stream = self.system.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # A file context's rename never replaces a file, unlike that of some file systems.
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        context.rename(hidden, self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def current(spark: SparkSession, root: str) -> dict[str, Any] | None:
    """The newest manifest: `version`, `tables` (name to path) and `note`; None before the first."""
    files = Files(spark, root)
    names = [n for n in files.names(f"{root}/{MANIFESTS}") if not n.startswith(("_", "."))]
    return json.loads(files.read(f"{root}/{MANIFESTS}/{names[-1]}")) if names else None


def publish(tables: Mapping[str, DataFrame], root: str, note: Mapping[str, Any] | None = None) -> dict[str, str]:
    """Write every table in full as the next version under `root`; the paths of that version's tables.

    Tables may be read from the version before. Of two that publish at once the later one fails.
    """
    spark = next(iter(tables.values())).sparkSession
    known = current(spark, root)
    version = known["version"] + 1 if known else 1
    folder = f"{root}/{DATA}/{version:010d}-{uuid.uuid4().hex}"
    out = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(out[name])
    manifest = {"version": version, "tables": out, "note": dict(note or {})}
    Files(spark, root).create(f"{root}/{MANIFESTS}/{version:010d}.json", json.dumps(manifest))
    return out


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest version; later versions don't disturb the frame."""
    known = current(spark, root)
    if known is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return spark.read.parquet(known["tables"][name])


def forget(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest `keep` versions, and what dead jobs left. A job that is writing the next version goes on."""
    files = Files(spark, root)
    manifests = [n for n in files.names(f"{root}/{MANIFESTS}") if not n.startswith(("_", "."))]
    kept = [json.loads(files.read(f"{root}/{MANIFESTS}/{n}")) for n in manifests[-keep:]]
    named = {path.split("/")[-2] for m in kept for path in m["tables"].values()}
    for n in manifests[:-keep]:
        files.delete(f"{root}/{MANIFESTS}/{n}")
    for folder in files.names(f"{root}/{DATA}"):
        if folder not in named and kept and int(folder.split("-")[0]) <= kept[-1]["version"]:
            files.delete(f"{root}/{DATA}/{folder}")
