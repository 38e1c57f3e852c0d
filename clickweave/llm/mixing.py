"""Mixing sources to target weights by Poisson replication.

A source s with n_s rows, target weight w_s and a mixture of `total` rows repeats each document with mean
rate_s = total * w_s / n_s. A document's count is the inverse Poisson distribution function of rate_s at a number in [0, 1)
that the hash of seed and doc_id gives: the same in every run, on every executor, and for repeated rows. A mean rate r leaves
out the share exp(-r) of a source's documents: 37 % of them at 1, 14 % at 2. Documents are exploded by their counts and dealt to partitions by
ranges of a hash of seed, doc_id and copy, then sorted by it: a global shuffle in equal shares, whatever source holds most
rows. The hash is uniform, so its ranges are known without a sample.

Edge cases: a null source is a source of its own, the same as the empty one; a null doc_id hashes as the empty text; a source without a weight gets
rate 0, as does one of weight 0, and its rows go; ties: copies of equal rows have equal places and stand in any order beside each other; null and
empty and very long texts are documents like others; an empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Scratch, fresh


@dataclass(frozen=True)
class MixParams:
    """power: a source of n rows has the target weight n**power / sum, where no weights are given; epochs: rows of the mixture over rows of the input."""

    power: float = 0.5
    epochs: float = 1.0
    seed: str = "mix-1"


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def unit(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of a hash."""
    return F.conv(F.substring(_key(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def order_key(*parts: Column) -> Column:
    """60 bits of a hash."""
    return F.conv(F.substring(_key(*parts), 1, 15), 16, 10).cast("long")


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """The first count k that matters and P(count <= k), P(count <= k + 1), ...: within 12 standard deviations and 20 of the mean."""
    if rate <= 0:
        return 0, np.ones(1)
    first, last = max(0, int(rate - 12 * math.sqrt(rate) - 20)), math.ceil(rate + 12 * math.sqrt(rate) + 20)
    logs = np.concatenate([[first * math.log(rate) - rate - math.lgamma(first + 1)], math.log(rate) - np.log(np.arange(first + 1, last + 1))])
    return first, np.cumsum(np.exp(np.cumsum(logs)))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, rate: adds base and cdf, as of poisson_table."""

    def tables(batches):
        for batch in batches:
            made = [poisson_table(rate) for rate in batch.column("rate").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array([b for b, _ in made], pa.int64()), pa.array([c for _, c in made], pa.list_(pa.float64()))], ["source", "base", "cdf"])

    return rates.select("source", "rate").mapInArrow(tables, "source string, base long, cdf array<double>")


def source_rates(docs: DataFrame, params: MixParams = MixParams(), weights: DataFrame | None = None) -> DataFrame:
    """source, n, rate. weights: source, weight (not below 0); they are scaled to the sum 1."""
    n = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow("n", F.lit(params.power)))
    else:
        given = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum("weight").alias("weight"))
        n = n.join(given, "source", "left").fillna(0.0, ["weight"])
    n = Scratch(docs.sparkSession).save(n, "sources")
    sums = n.agg(F.sum("n"), F.sum("weight")).first()
    rows, total = float(sums[0] or 0), float(sums[1] or 0)
    return n.select("source", "n", (F.lit(rows * params.epochs) * F.col("weight") / F.lit(total or 1.0) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, params: MixParams = MixParams(), weights: DataFrame | None = None, names: tuple[str, str] = ("copy", "order_key")) -> DataFrame:
    """The columns of docs, the copy's number (from 1) and its place in the shuffle, in that order."""
    source, base, cdf, n, copy, order = (fresh(f"_{c}", docs.columns) for c in ("source_key", "base", "cdf", "n", "copy", "order"))
    rates = poisson_tables(source_rates(docs, params, weights).filter("rate > 0")).select(F.col("source").alias(source), F.col("base").alias(base), F.col("cdf").alias(cdf))
    rates = Scratch(docs.sparkSession).save(rates, "rates")
    few = (rates.agg(F.sum(F.size(cdf))).first()[0] or 0) <= MAX_BROADCAST_ROWS
    keyed = docs.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit(""))).join(F.broadcast(rates) if few else rates, source)
    u = unit(F.lit(params.seed), F.col("doc_id"))
    keyed = keyed.withColumn(n, (F.col(base) + F.aggregate(cdf, F.lit(0), lambda k, c: k + (c <= u).cast("int"))).cast("int"))
    copies = keyed.filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.withColumn(order, order_key(F.lit(params.seed), F.col("doc_id"), F.col(copy))).select(*docs.columns, copy, order)
    part = F.shiftright(F.shiftright(order, 30) * F.lit(parts), 30).cast("int")
    dealt = copies.repartitionById(parts, part).sortWithinPartitions(order)
    return dealt.withColumnsRenamed({copy: names[0], order: names[1]})
