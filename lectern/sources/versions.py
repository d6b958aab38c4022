"""Tables in versions: batches are appended as deltas, a manifest names the files of each version.

    manifest/version=V/   one row: the base and the deltas that version V is made of
    base/version=V/       all rows, written by a reload or when many deltas have gathered
    delta/version=V/      the last row of each key of one batch

A batch writes its own rows and a manifest, whatever the size of the table; readers merge the deltas over the base by key.
Every `compact_every` batches the merge is written as a new base, so the rows written are
a small multiple of the rows that came.  A manifest is one file that Spark's commit makes visible as a whole: readers see
the version before or the version after.  A batch whose manifest is there has been committed and is not
written again, so a stream may replay it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "base string, deltas array<string>"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for `name` in the shared checkpoint folder of the session."""
    import tempfile
    import uuid

    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        shared = tempfile.mkdtemp(prefix="spark-tables-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(path: str) -> None:
    """Deletes a folder of a local, HDFS, S3 or GCS path."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    where.delete_dir(inner)


class VersionedTable:
    """A table of rows with a key, in versions; `order` decides between rows of one key in one batch, then all columns do.

    Rows with a null key are one row like any other key's.  Columns must be of types that have an order (no maps).
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, schema, compact_every: int = 16):
        self.spark, self.path, self.key, self.order, self.schema, self.compact_every = spark, path.rstrip("/"), key, order, schema, compact_every

    # ---- manifests

    def versions(self) -> list[tuple[int, str, list[str]]]:
        """(version, base, deltas) of every version that is there, the newest first."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, version long").json(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(((r.version, r.base, list(r.deltas)) for r in rows.collect()), reverse=True)

    def _publish(self, version: int, base: str, deltas: list[str]) -> None:
        self.spark.createDataFrame([(base, deltas)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")

    # ---- reading

    def _last(self, rows: DataFrame, *first: str) -> DataFrame:
        columns = [c for c in rows.columns if c not in self.key and c not in first]
        best = F.max(F.struct(*first, F.col(self.order).alias("_order"), *columns)).alias("_x")
        return rows.groupBy(*self.key).agg(best).select(*self.key, *[F.col(f"_x.{c}").alias(c) for c in columns])

    def _merged(self, base: str, deltas: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{p}").withColumn("_age", F.lit(i)) for i, p in enumerate([base, *deltas]) if p]
        columns = self.spark.createDataFrame([], self.schema).columns
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts)
        return (self._last(rows, "_age") if len(parts) > 1 else rows).select(*columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; a table without versions is empty."""
        found = [v for v in self.versions() if version is None or v[0] <= version]
        return self._merged(*found[0][1:]) if found else self.spark.createDataFrame([], self.schema)

    # ---- writing

    def append(self, batch: DataFrame, version: int) -> bool:
        """Adds a batch as `version` over the newest version below it; False if that version is there already."""
        known = self.versions()
        if any(v == version for v, _, _ in known):
            return False
        base, deltas = next(((b, d) for v, b, d in known if v < version), ("", []))
        columns = self.spark.createDataFrame([], self.schema).columns
        self._last(batch.select(*columns)).select(*columns).write.mode("overwrite").parquet(f"{self.path}/delta/version={version}")
        deltas = [*deltas, f"delta/version={version}"]
        if len(deltas) >= self.compact_every:
            self._merged(base, deltas).write.mode("overwrite").parquet(f"{self.path}/base/version={version}")
            base, deltas = f"base/version={version}", []
        self._publish(version, base, deltas)
        return True

    def append_new(self, batch: DataFrame, version: int) -> bool:
        """Adds the rows of a batch whose key the table does not have: the first of a key wins."""
        return self.append(batch.join(self.read(version - 1).select(*self.key), self.key, "left_anti"), version)

    def reload(self, rows: DataFrame) -> int:
        """Replaces all rows at once; readers see the old rows until the new ones are complete."""
        version = max((v for v, _, _ in self.versions()), default=0) + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/base/version={version}")
        self._publish(version, f"base/version={version}", [])
        return version

    def drop_old(self, keep: int = 2, delete: Callable[[str], None] = delete_folder) -> list[str]:
        """Drops all versions but the newest `keep`, and the files that no kept version has; returns their folders."""
        known = self.versions()
        used = {p for _, b, d in known[:keep] for p in [b, *d]}
        gone = sorted({p for _, b, d in known[keep:] for p in [b, *d] if p} - used)
        folders = [f"manifest/version={v}" for v, _, _ in known[keep:]] + gone
        for folder in folders:  # manifests first: no manifest ever names files that are gone
            delete(f"{self.path}/{folder}")
        return folders
