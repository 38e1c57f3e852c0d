"""Shared helpers: reading tables, shared scratch tables, bounded samples, label joins and vector sums."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-column label table that one broadcast may hold (about 75 MB of hash table); larger ones are shuffled.
MAX_BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where it is unset (tests) a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        shared = spark.sparkContext.getCheckpointDir()
    return shared


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors, and are dropped by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.drop(label)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            if path := self.paths.pop(label, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(name: str, taken: list[str] | tuple[str, ...]) -> str:
    """The name, lengthened until no column has it (in either case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def crc_mod(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the hash of the columns, the same in every run and on every executor."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 7, total: int | None = None) -> DataFrame:
    """At most `rows` rows, by the hash of the key: all rows where there are fewer. Adds the column `_u`."""
    total = df.count() if total is None else total
    df = df.withColumn("_u", unit_hash(F.col(key), seed=seed))
    if total <= rows:
        return df
    return df.filter(F.col("_u") < 1.1 * rows / total).orderBy("_u", key).limit(rows)


def join_on_key(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", small_rows: int | None = None) -> DataFrame:
    """Joins with a narrow table: broadcast if its counted rows fit MAX_BROADCAST_ROWS, else a shuffle join (AQE splits skew)."""
    small_rows = small.count() if small_rows is None else small_rows
    return big.join(F.broadcast(small) if small_rows <= MAX_BROADCAST_ROWS else small, key, how)


def vector_pieces(vector: np.ndarray, pieces: int) -> Iterator[tuple[int, bytes]]:
    """The pieces of a vector (padded to a whole number of them) that hold anything, compressed."""
    step = -(-len(vector) // pieces)
    for k in range(pieces):
        part = vector[k * step : (k + 1) * step]
        if part.any():
            yield k, zlib.compress(part.tobytes(), 1)


def add_pieces(parts: DataFrame, size: int, pieces: int = 32, fan_in: int = 32) -> np.ndarray:
    """parts: a written table of piece, data, as of vector_pieces, of any number of int64 vectors of one size. Returns their sum.

    Pieces are added in levels of at most about fan_in inputs a group, so that no task's input grows with their number. Only
    the sum reaches the driver; its size is the parameter `size`, whatever the input.
    """

    def total(group: pa.Table) -> pa.Table:
        data, out = group["data"], None
        for one in data:
            part = np.frombuffer(zlib.decompress(one.as_py()), np.int64)
            out = part.copy() if out is None else np.add(out, part, out=out)
        return pa.table({"piece": group["piece"][:1].cast(pa.int32()), "data": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    step, groups = -(-size // pieces), -(-parts.count() // pieces)
    while groups > 1:
        groups = -(-groups // fan_in)
        parts = parts.withColumn("_group", F.pmod(F.xxhash64("data"), F.lit(groups))).groupBy("piece", "_group").applyInArrow(total, "piece int, data binary")
    out = np.zeros(step * pieces, np.int64)
    for k, data in parts.collect():
        part = np.frombuffer(zlib.decompress(data), np.int64)
        out[k * step : k * step + len(part)] += part
    return out[:size]


def sum_vectors(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, pieces: int = 32) -> np.ndarray:
    """Sums one int64 vector of fixed size per partition."""

    def partial(batches):
        for k, data in vector_pieces(fill(batches), pieces):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["piece", "data"])

    scratch = Scratch(df.sparkSession)
    out = add_pieces(scratch.save(df.mapInArrow(partial, "piece int, data binary"), "pieces"), size, pieces)
    scratch.drop("pieces")
    return out
