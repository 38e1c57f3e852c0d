"""Follow-the-regularised-leader (proximal) updates for sparse linear models, trained in Spark tasks on shards of a bounded sample (train) or of all rows (train_whole).

Every shard is worked off by one task; a weight of the model is its mean over the shards that have met its feature
(parameter mixing), so rare features don't fade. Rows of a shard are taken in the order of their hash, so the model is the same in every run.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, add_pieces, vector_pieces
from .textnum import few_rows, give_back

#: Weights are added as whole multiples of 1 / POINT, so that their sum doesn't depend on the order.
POINT = 1 << 32
PIECES = 32


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: learning rate; l1, l2: elastic-net penalties; epochs: passes over a shard; shard_bytes: of features that a shard holds at most, of more
    rows those first by hash train."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1e-6
    epochs: int = 3
    shards: int = 4
    shard_bytes: int = 256 << 20


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, how: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size + 1, classes) of a softmax model, or (size + 1, 1) of a logistic one if classes is 1, the last row the bias; and which rows were met."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(zi, ni, l1):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for idx, val, y in rows:
            zi, ni, zb, nb = z[idx], n[idx], z[size], n[size]
            w, b = weights(zi, ni, how.l1), weights(zb, nb, 0.0)
            logits = np.clip(val @ w + b, -60, 60)
            if classes == 1:
                err = 1 / (1 + np.exp(-logits)) - y
            else:
                e = np.exp(logits - logits.max())
                err = e / e.sum()
                err[y] -= 1
            g = val[:, None] * err[None, :]
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha * w
            n[idx] = ni + g * g
            z[size] = zb + err - (np.sqrt(nb + err * err) - np.sqrt(nb)) / how.alpha * b
            n[size] = nb + err * err
    out = weights(z, n, how.l1)
    out[size] = weights(z[size], n[size], 0.0)
    return out, (n > 0).any(1)


def featurised(sample: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]], how: Ftrl, most: int | None = None, spread: bool = False) -> DataFrame:
    """shard, u, y and features (idx, val) of the rows of a sample that have a class; of more than `most` those first by hash, made where the texts are read.
    spread: rows of one hash, which repeated ids have, are dealt over the shards in turn."""

    def featurise(batches: Iterator[pa.RecordBatch]):
        met = Counter()
        for batch in few_rows(batches):
            u, ys, idx, val = batch.column("_u"), batch.column("y"), [], []
            for text in batch.column("text").to_pylist():
                i, v = features(text or "")
                idx.append(i.astype(np.int32).tobytes())
                val.append(v.astype(np.float32).tobytes())
            turns = [0] * len(u)
            if spread:
                for k, x in enumerate(u.to_pylist()):
                    turns[k] = met[x]
                    met[x] += 1
            shard = pa.array([(int(x * 1e9) + k) % how.shards for x, k in zip(u.to_pylist(), turns, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, u, ys.cast(pa.int32()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["shard", "u", "y", "idx", "val"])

    some = sample.select("_u", "text", F.col("y").cast("int").alias("y")).filter(F.col("y").isNotNull())
    rows = some.mapInArrow(featurise, "shard int, u double, y int, idx binary, val binary")
    return rows if most is None else rows.orderBy("u", "y", F.xxhash64("idx", "val")).limit(most)


def within_bytes(rows: DataFrame, how: Ftrl) -> DataFrame:
    """rows: shard, u, idx, val, a written table of a bounded number of rows. Of each shard the rows by u whose features have shard_bytes at most together."""
    size = F.length("idx") + F.length("val")
    totals = rows.groupBy("shard").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > how.shard_bytes)
    if totals.isEmpty():
        return rows
    place = Window.partitionBy("shard").orderBy("u", "y", F.xxhash64("idx", "val"))
    sums = rows.withColumn("_bytes", F.sum(size).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return sums.filter(F.col("_bytes") <= how.shard_bytes).drop("_bytes")


def rows_of(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    return [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(group["idx"].to_pylist(), group["val"].to_pylist(), group["y"].to_pylist(), strict=True)]


def train(sample: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]], size: int, classes: int, how: Ftrl, most: int | None = None) -> np.ndarray:
    """sample: columns _u (order), text, y (class number); bounded by the caller or by `most`. Returns float32 weights as of fit()."""

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("u", "ascending")])
        rows = rows_of(group)
        w, met = fit(rows, size, classes, how)
        keep, w = np.flatnonzero(met).astype(np.int32), w.astype(np.float32)
        del rows, group
        give_back()
        return pa.table({"at": pa.array([keep.tobytes()], pa.binary()), "w": pa.array([w[keep].tobytes()], pa.binary())})

    scratch = Scratch(sample.sparkSession)
    rows = within_bytes(scratch.save(featurised(sample, features, how, most), "features"), how)
    parts = rows.groupBy("shard").applyInArrow(shard, "at binary, w binary").collect()
    scratch.drop("features")
    out, met = np.zeros((size + 1, classes), np.float64), np.zeros((size + 1, 1))
    for p in parts:
        at = np.frombuffer(p.at, np.int32)
        out[at] += np.frombuffer(p.w, np.float32).reshape(-1, classes)
        met[at] += 1
    return (out / np.maximum(met, 1)).astype(np.float32)


def train_whole(rows: DataFrame, features: Callable[[str], tuple[np.ndarray, np.ndarray]], size: int, how: Ftrl, shards: int) -> np.ndarray:
    """rows: columns _u (order), text, y (0 or 1), of any number; every one trains, in one of the shards. Returns float32 weights of a logistic model as of fit().

    The caller counts the shards, so that one fits a task. Their weights are added in levels; what reaches the driver depends on `size` alone.
    """

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("u", "y", "idx", "val")])
        rows = rows_of(group)
        w, met = fit(rows, size, 1, how)
        del rows, group
        pieces = list(vector_pieces(np.concatenate([np.rint(w[:, 0] * POINT).astype(np.int64), met.astype(np.int64)]), PIECES))
        give_back()
        return pa.table({"piece": pa.array([k for k, _ in pieces], pa.int32()), "data": pa.array([data for _, data in pieces], pa.binary())})

    scratch = Scratch(rows.sparkSession)
    dealt = featurised(rows, features, replace(how, shards=shards), spread=True)
    parts = scratch.save(dealt.groupBy("shard").applyInArrow(shard, "piece int, data binary"), "weights")
    sums, met = add_pieces(parts, 2 * (size + 1), PIECES).reshape(2, size + 1)
    scratch.drop("weights")
    return (sums / POINT / np.maximum(met, 1)).astype(np.float32)[:, None]
