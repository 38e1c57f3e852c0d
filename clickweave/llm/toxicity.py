"""Toxicity: character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

For every bucket of character n-grams (of lower-cased text) the number of toxic and of other labelled documents that
hold it gives the log-count ratio r. A logistic model on the binary features times r, scaled to length 1, is trained with FTRL updates. Every labelled row is used,
whatever their number: a fifth (by hash) calibrates, all others are counted and train. They train in shards, as many as it takes for one to fit a task, and a weight is its mean over the
shards that have met its feature. All calibrating rows set
where the score 0.5 lies: at the least sum of the share of toxic rows that are missed and `clean_weight` times the share of clean rows that are taken
for toxic, in the middle where many places are as good. Sizes, rates and weights were chosen by cross-validation within rows that may be learned from.

Edge cases: null, empty and short texts have no feature and get the score of the bias; texts of any length are scored
whole, a row at a time; rows with null labels or text don't train; ties: a score of 0.5 counts as label 1, rows of equal hash train in the order of their labels and features; repeated
rows are counted, trained on and scored each, those of one id dealt over the shards; empty tables work (no
labels: score 0.5); further columns of the documents don't matter and aren't returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_on_key, sum_vectors, unit_hash
from .ftrl import Ftrl, train_whole
from .textnum import char_ngrams, few_rows


@dataclass(frozen=True)
class ToxicityParams:
    """sizes: characters of the n-grams; smoothing: rows of the mean class mix that every bucket is counted in besides its own, so that
    a bucket without evidence has a ratio of 0; least_ratio: smaller log-count ratios count as 0; shard_rows: about as many labelled rows train in one shard, fewer where their
    features would fill more than half of ftrl.shard_bytes (the rest is room for what hashing deals unevenly); driver_rows: the sums of more calibrating rows are cut in Spark; clean_weight: of an error on clean rows when calibrating, which needs at least
    least_clean and least_toxic rows of either kind."""

    sizes: tuple[int, ...] = (5, 6, 7)
    bits: int = 20
    smoothing: float = 5.0
    least_ratio: float = 0.7
    shard_rows: int = 30_000
    driver_rows: int = 7_500
    clean_weight: float = 20.0
    least_clean: int = 100
    least_toxic: int = 20
    ftrl: Ftrl = Ftrl(alpha=1.0, l1=0.05, l2=1e-4, epochs=4, shards=1)


def buckets(text: str | None, params: ToxicityParams) -> np.ndarray:
    return char_ngrams(f" {text.lower()} ", params.sizes, params.bits) if text else np.empty(0, np.int64)


def distinct(grams: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sorted distinct buckets; flags: all false, before and after."""
    if len(grams) < 2000:
        return np.unique(grams)
    flags[grams] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def scaled(text: str | None, ratio: np.ndarray, used: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with evidence (used: where the ratio isn't 0) and their ratios, scaled to length 1."""
    grams = buckets(text, params)
    idx = np.unique(grams[used[grams]])  # few are left to be sorted
    val = ratio[idx].astype(np.float64)
    return idx, val / (np.sqrt(val @ val) or 1.0)


def threshold(y: list[int], z: np.ndarray, params: ToxicityParams) -> float:
    """Where the calibrating rows' sums are cut; 0 where there are too few rows of either kind."""
    y = np.asarray(y)
    toxic, clean = np.sort(z[y == 1]), np.sort(z[y == 0])
    if len(toxic) < params.least_toxic or len(clean) < params.least_clean:
        return 0.0
    cuts = np.unique(z)
    cost = np.searchsorted(toxic, cuts, "right") / len(toxic) + params.clean_weight * (1 - np.searchsorted(clean, cuts, "right") / len(clean))
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(best[len(best) // 2])
    return float((cuts[k] + cuts[min(k + 1, len(cuts) - 1)]) / 2)


def threshold_of(sums: DataFrame, params: ToxicityParams) -> float:
    """The same as threshold() for any number of calibrating rows: y, z, a written table. Sums are counted up in ranges of z."""
    toxic, clean = (F.count_if(F.col("y") == k) for k in (1, 0))
    n = sums.agg(toxic.alias("toxic"), clean.alias("clean")).first()
    if n.toxic < params.least_toxic or n.clean < params.least_clean:
        return 0.0
    scratch = Scratch(sums.sparkSession)
    by_z = sums.groupBy("z").agg(toxic.alias("toxic"), clean.alias("clean"))
    cuts = scratch.save(by_z.repartitionByRange("z").withColumn("part", F.spark_partition_id()), "cuts")
    before, at = [], (0, 0)
    for r in sorted(cuts.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()):
        before.append((r.part, *at))
        at = at[0] + r.toxic, at[1] + r.clean
    before = sums.sparkSession.createDataFrame(before, "part int, toxic_before long, clean_before long")
    up = Window.partitionBy("part").orderBy("z")
    missed, left = (F.col(f"{c}_before") + F.sum(c).over(up) for c in ("toxic", "clean"))
    costs = cuts.join(F.broadcast(before), "part").select("part", "z", (missed / n.toxic + params.clean_weight * (1 - left / n.clean)).alias("cost"))
    best = costs.filter(F.col("cost") <= costs.agg(F.min("cost")).first()[0] + 1e-12)
    found = sorted(best.groupBy("part").count().collect())
    place = sum(r["count"] for r in found) // 2  # the middle one, from 0: its part, and its place there
    for r in found:
        if place < r["count"]:
            break
        place -= r["count"]
    cut = best.filter(F.col("part") == r.part).withColumn("place", F.row_number().over(up)).filter(F.col("place") == place + 1).first().z
    after = cuts.filter(F.col("z") > cut).agg(F.min("z")).first()[0]
    scratch.drop("cuts")
    return (cut + (cut if after is None else after)) / 2


def shards(sums: np.ndarray, used: np.ndarray, params: ToxicityParams) -> int:
    """How many shards the counted rows take: sums has the rows that hold a bucket, of either kind, and their numbers."""
    features = int(sums[:-2].reshape(2, -1)[:, used].sum())
    return max(params.ftrl.shards, -(-int(sums[-2:].sum()) // params.shard_rows), -(-16 * features // params.ftrl.shard_bytes))


def train_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> np.ndarray:
    """labels: doc_id, y (0 or 1). Returns the log-count ratios of 2**bits buckets, and after them the weights and the bias, a row of two for each."""
    size = 1 << params.bits
    labels = labels.filter("y IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("y").cast("int").alias("y"))
    calibrates = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(5)) == 0
    calibrating, labels = labels.filter(calibrates), labels.filter(~calibrates)
    rows = labels.count()
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")

    def count(batches):
        sums, flags, docs_of = np.zeros((2, size), np.int64), np.zeros(size, bool), np.zeros(2, np.int64)
        for batch in few_rows(batches):
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                sums[int(y > 0)][distinct(buckets(text.as_py(), params), flags)] += 1
                docs_of[int(y > 0)] += 1
        return np.concatenate([sums.ravel(), docs_of])

    sums = sum_vectors(join_on_key(texts, labels, "doc_id", small_rows=rows).select("text", "y"), count, 2 * size + 2)
    total = sums[2 * size :, None]
    share = (total + 1e-9) / (total.sum() + 2e-9)
    q, p = (sums[: 2 * size].reshape(2, size) + params.smoothing * share) / (total + params.smoothing)
    ratio = np.log(p / q).astype(np.float32) if total.all() else np.zeros(size, np.float32)
    ratio[np.abs(ratio) < params.least_ratio] = 0
    held = docs.sparkSession.sparkContext.broadcast((ratio, ratio != 0))
    known = join_on_key(texts, labels.withColumn("_u", unit_hash(F.col("doc_id"), seed=7)), "doc_id", small_rows=rows)
    w = train_whole(known, lambda text: scaled(text, *held.value, params), size, params.ftrl, shards(sums, ratio != 0, params))[:, 0]
    sent, scratch = docs.sparkSession.sparkContext.broadcast(w), Scratch(docs.sparkSession)

    def sums_of(batches):
        for batch in few_rows(batches):
            z = [(v @ sent.value[i]) + sent.value[-1] for i, v in (scaled(t.as_py(), *held.value, params) for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.array(z, np.float64))], ["y", "z"])

    got = scratch.save(join_on_key(texts, calibrating, "doc_id").select("text", "y").mapInArrow(sums_of, "y int, z double"), "calibrating")
    if got.count() > params.driver_rows:
        w[-1] -= threshold_of(got, params)
    else:
        few = got.collect()
        w[-1] -= threshold([r.y for r in few], np.array([r.z for r in few]), params)
    scratch.drop("calibrating")
    return np.stack([np.append(ratio, 0), w])


def score_toxicity(docs: DataFrame, model: np.ndarray, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, score: the probability of label 1 for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        ratio, w = held.value
        used = ratio != 0
        for batch in few_rows(batches):
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                idx, val = scaled(text.as_py(), ratio, used, params)
                out[k] = val @ w[idx] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
