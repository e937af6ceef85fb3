"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401  (used by the operators here)
from ..session import cut_lineage, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``; survives lost executors."""
    return cut_lineage(df)


class Scratch:
    """Tables written as Parquet (snappy: little memory beside the heap) below the folder of ``spark.checkpoint.dir``: they cut lineage, survive lost
    executors, take less room than a checkpoint and are read by column.  ``drop`` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.option("compression", "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = [*getattr(self, "_held", []), out]      # ids stay unique while the tables live
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(t)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The Arrow function ``run``, after whose last batch the worker gives freed memory back: workers outlive their
    tasks, and what they keep is missing to the next stage of the executor."""
    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)        # glibc only
        if trim is not None:
            trim(0)
    return inner


def chunk_leaders(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Rows ``key, doc, lead`` of distinct (key, doc): ``lead`` is the smallest doc of the key
    in this chunk.  Only leaders (``lead = doc``) have to meet the rows of other chunks, so a
    key that stands in a third of all documents sends one row per chunk to its group."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    lead = np.repeat(doc[at], np.diff(np.append(at, len(key))))
    keep = np.ones(len(key), bool)
    keep[1:] = new[1:] | (doc[1:] != doc[:-1])
    many = np.repeat(np.add.reduceat(keep.astype(np.int64), at), np.diff(np.append(at, len(key)))) > 1 if len(key) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[keep].view(np.int64)), pa.array(doc[keep]), pa.array(lead[keep]), pa.array(many[keep])],
        names=["key", "doc", "lead", "many"])


LEADER_SCHEMA = "key long, doc long, lead long, many boolean"


def leaders_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]], chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Gather (keys, docs) to chunks of about ``chunk`` entries and find their leaders."""
    keys: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    held = 0
    for k, d in pairs:
        keys.append(k)
        docs.append(d)
        held += len(k)
        if held >= chunk:
            yield from slices(chunk_leaders(np.concatenate(keys), np.concatenate(docs)))
            keys, docs, held = [], [], 0
    if held:
        yield from slices(chunk_leaders(np.concatenate(keys), np.concatenate(docs)))


def slices(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def first_of_key(leaders: DataFrame) -> DataFrame:
    """Add ``first``, the smallest doc of the key among all chunks' leaders (for followers, the
    doc itself), and ``shared``, whether the key stands in two documents at least.  Followers
    are spread by their doc: they neither wait for nor crowd the group of a hot key."""
    salt = F.when(F.col("lead") == F.col("doc"), F.lit(-1).cast("long")).otherwise(F.col("doc"))
    w = Window.partitionBy("key", "salt")
    return (
        leaders.withColumn("salt", salt)
        .withColumn("first", F.min("doc").over(w))
        .withColumn("last", F.max("doc").over(w))
        .withColumn("shared", F.col("many") | (F.col("first") < F.col("last")))
        .drop("salt", "last", "many")
    )


@tidy
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [None if t is None else pack.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])


def packed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, packed``: texts compressed with zstd, for a shuffle of two thirds the size."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack, "id long, packed binary")


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """``name``: 0-based rank of each row within ``keys``, without gaps, with no group in one task.

    Rows are dealt by a hash of ``order`` into as many buckets as there are ``rows_per_bucket``
    rows (a count that grows with the table); a small table of bucket counts gives each bucket
    its first rank.  The order inside a key is by bucket, then ``order``.  ``df`` should be cheap
    to read twice (checkpoint it first).  Null keys form a group of their own.
    """
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    at = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = at.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("__base", F.coalesce(before, F.lit(0).cast("long"))).drop("__n")
    base = base.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), "__base")
    ranked = at.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1)
    on = F.col("__bucket") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (ranked.join(base, on).withColumn(name, F.col("__base") + F.col("__rn"))
            .drop("__bucket", "__b", "__base", "__rn", *[f"__k_{k}" for k in keys]))


def first_of_group(df: DataFrame, keys: list[str], order: list, n: int, spread: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank`` (from 1).  A group is cut by a hash of ``spread`` first, so that
    the last sort holds ``salts`` times ``n`` of its rows whatever the number of map tasks."""
    part = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    part = part.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col("__r") <= n).drop("__r", "__salt")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def let(value, body):
    """``body(value)`` with the value computed once.  Naming a column does not do: the optimizer
    may put its expression back into a lambda, where it would run once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
