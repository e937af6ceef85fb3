"""Keyed cache tables (S10, S11): Parquet bucketed by key, versioned appends, compaction.

A cache is a folder; each version of it is a subfolder ``v000001-b64`` of Parquet files bucketed by
``key`` into the number of buckets that its name tells.  An append adds one file per bucket to the
newest version, with only those keys that no earlier append holds and with the time of the append
(``seq``).  ``compact`` writes the next version with one file per bucket; a version counts from the
moment its commit marker is there, so a compaction that dies leaves the version before it in use.

Because the files are bucketed by key, a lookup joins the cache without shuffling it: only the rows
that ask move.  ``read`` gives one value per key even if two writers appended a key at the same time:
the earliest append wins (ties: the smallest value), aggregated inside the buckets.

Null keys are not stored.  The folder must be one that all executors reach.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_VERSION = re.compile(r"^v([0-9]{6})-b([0-9]+)$")


class KeyedCache:
    """``key → value columns`` at ``path``.  ``schema`` (DDL of the value columns) is needed only
    where the cache may not exist yet and is read before its first append."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(self._path).toString()
        self._schema = StructType.fromDDL(schema) if schema else None

    def versions(self) -> list[tuple[int, int, str]]:
        """``(version, buckets, folder)`` of the committed versions that hold rows, oldest first."""
        if not self._fs.exists(self._path):
            return []
        out = []
        for status in self._fs.listStatus(self._path):
            m = _VERSION.match(status.getPath().getName())
            if not m:
                continue
            names = [f.getPath().getName() for f in self._fs.listStatus(status.getPath())]
            if "_SUCCESS" in names and any(n.startswith("part-") for n in names):
                out.append((int(m[1]), int(m[2]), status.getPath().toString()))
        return sorted(out)

    def _table(self, folder: str, buckets: int, columns: StructType) -> str:
        """Catalog name of a version; the session only learns where its files are."""
        name = f"lingomesh_cache_{hashlib.sha1(folder.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(name):
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
            place = folder.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(name)
        return name

    def _newest(self) -> DataFrame | None:
        found = self.versions()
        if not found:
            return None
        _, buckets, folder = found[-1]
        columns = self.spark.read.parquet(folder).schema
        return self.spark.table(self._table(folder, buckets, columns))

    def read(self) -> DataFrame:
        """``key`` and the value columns, one row per key; no shuffle of the stored rows."""
        stored = self._newest()
        if stored is None:
            if self._schema is None:
                raise FileNotFoundError(f"no cache at {self.path}")
            return self.spark.createDataFrame([], StructType().add("key", "string")).select(
                "key", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema.fields])
        values = [c for c in stored.columns if c not in ("key", "seq")]
        best = F.min(F.struct("seq", *values)).alias("best")
        return stored.groupBy("key").agg(best).select("key", *[F.col("best")[c].alias(c) for c in values])

    def append(self, rows: DataFrame) -> None:
        """Store the ``rows`` (``key`` and value columns) whose key the cache does not hold yet; of
        rows that share a key the smallest value is stored."""
        values = [c for c in rows.columns if c != "key"]
        new = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(*values)).alias("best"))
        new = new.select("key", *[F.col("best")[c].alias(c) for c in values])
        found = self.versions()
        if found:
            version, buckets, folder = found[-1]
            new = new.join(self._newest().select("key"), "key", "left_anti")
        else:
            version, buckets = 1, self.buckets
            folder = f"{self.path}/v{version:06d}-b{buckets}"
        self._write(new.withColumn("seq", F.unix_micros(F.current_timestamp())), folder, buckets)

    def compact(self) -> None:
        """Write the next version: every key once, one file per bucket.  Older versions stay for
        the readers that have opened them, until :meth:`drop_old`."""
        found = self.versions()
        if found:
            version, buckets, _ = found[-1]
            merged = self.read().withColumn("seq", F.unix_micros(F.current_timestamp()))
            self._write(merged, f"{self.path}/v{version + 1:06d}-b{buckets}", buckets)

    def drop_old(self) -> None:
        for _, _, folder in self.versions()[:-1]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> None:
        names = ["key", "seq", *[c for c in rows.columns if c not in ("key", "seq")]]
        rows = rows.select(*names)
        name = self._table(folder, buckets, rows.schema)
        # one task per bucket, so that an append adds one file to each
        (rows.repartition(buckets, "key").write.mode("append").format("parquet")
         .bucketBy(buckets, "key").sortBy("key").option("path", folder).saveAsTable(name))
        self.spark.catalog.refreshTable(name)
