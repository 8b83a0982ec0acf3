"""A table whose versions are published whole: a reader sees the one before or the one after a merge, never part of it.

Rows lie in buckets by the hash of a key, each bucket in a folder that is never changed. A merge reads the buckets of its new
rows' keys, writes them anew into a folder of its own, and then publishes a manifest, the list of all buckets' folders, by
renaming it to the next version's name. That fails where the name is taken, so of two merges onto one version just one is
published and the other raises Conflict; a merge that fails before leaves the table as it was. Older versions stay readable.

Scale: a merge costs the buckets that it touches, not the table; a manifest has a row for each bucket, which is all that the
driver holds. Buckets are hashes of keys, so a key with many new rows is a matter for the merge's own aggregation. Whether a
rename refuses a taken name at once is the file system's: HDFS does, a local folder looks first and renames then.

Defined results: a null key is a key; without new rows nothing is published; a bucket whose rows are all gone is left out; an
empty or missing folder is version 0, which has no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


class Conflict(RuntimeError):
    """Another merge has published the version that this one was to be."""


class Versions:
    """The versions of a table below path; buckets are fixed for the life of a table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def version(self) -> int:
        """The newest version's number."""
        folder = self._fs.Path(f"{self.path}/manifests")
        store = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        return self._rows(self._folders(self.version() if version is None else version))

    def merge(self, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Publishes merged(old, new), where old is the rows of the buckets of new's keys; the version's number."""
        base = self.version()
        folders = self._folders(base)
        touched = {r["bucket"] for r in new.select(self._bucket()).distinct().collect()}
        if not touched:
            return base
        folder = uuid.uuid4().hex
        old = self._rows({b: f for b, f in folders.items() if b in touched})
        rows = merged(old, new).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{folder}")
        filled = {r["bucket"]: folder for r in written.select("bucket").distinct().collect()}
        self._publish({b: f for b, f in folders.items() if b not in touched} | filled, base + 1)
        return base + 1

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _folders(self, version: int) -> dict[int, str]:
        if not version:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/manifests/v{version}")
        return {r["bucket"]: r["folder"] for r in rows.collect()}

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def _publish(self, folders: dict[int, str], version: int) -> None:
        draft, name = (self._fs.Path(f"{self.path}/manifests/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"v{version}"))
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray("\n".join(json.dumps({"bucket": b, "folder": f}) for b, f in sorted(folders.items())), "utf-8"))
        out.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self._fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, name, options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} is published already") from e
            raise
