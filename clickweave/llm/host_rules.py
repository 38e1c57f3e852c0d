"""Quality rules with host verdicts, in DataFrame functions only.

Every whole text gives word and line statistics and a base verdict. Failures are counted by host (combined before the
shuffle), the hosts' failure rates are shrunk with an empirical beta prior (fitted by moments over all hosts), and the posterior gives each host a
verdict that is joined back to its documents: all documents of a host fail whose rate lies above the limit by its lower credible bound. The prior
decides: a few failures of a small host leave its bound near the mean, those of many documents don't. Elsewhere the base verdict holds.

Words in repeated 5-word windows are found inside each row: 64-bit hashes of all windows are sorted with their places, and
the places of hashes that occur twice or more are merged, so the cost is n log n for texts of any length.

Edge cases: null and empty texts have no word, fail the base rules and count for their host; a null host is a host of its own, the same as the empty
one; texts of any length are taken whole; ties: a host whose bound is at the limit isn't rejected; repeated rows count
each; an empty table gives an empty result; further columns don't matter and aren't returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, Scratch


@dataclass(frozen=True)
class HostParams:
    """A host is rejected if the lower bound of its failure rate (deviations below the posterior mean; 2.33 leave one in a hundred below it) is above both
    multiple times the mean of all documents and least_rate; strengths: bounds of the prior's strength, in documents; salts: parts that a host's rows are
    joined in if verdicts are too many to broadcast."""

    window: int = 5
    min_words: int = 10
    repeat_percent: int = 20
    multiple: float = 3.0
    least_rate: float = 0.2
    deviations: float = 2.33
    strengths: tuple[float, float] = (1.0, 1000.0)
    salts: int = 16


def repeated_words(words: Column, size: int) -> Column:
    """Words that lie in windows of `size` words that occur twice or more."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i - 1 + k) for k in range(size))))
    return hashes


def text_stats(docs: DataFrame, params: HostParams = HostParams()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to the other columns of docs but text."""
    size, others = params.window, [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        *others,
        F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("_words"),
        (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    df = df.select(
        *others,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > size, repeated_words(F.col("_words"), size)).alias("_windows"),
    )
    df = df.withColumn("_again", F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("_again") - 1
    twice = F.filter("_again", lambda x, i: ((i > 0) & (F.get("_again", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("_again", i + 1)["h"] == x["h"])))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-size).alias("end")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p + size - acc["end"])).alias("n"), (p + size).alias("end")), lambda acc: acc["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.repeat_percent * F.col("n_words"))
    return df.select(*others, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(stats: DataFrame, host: str = "host", params: HostParams = HostParams()) -> DataFrame:
    """host, n, failures, rate, bound, mean: the rate is the mean of the posterior under a beta prior that has the mean and the spread of all hosts' rates, the
    bound lies `deviations` of the posterior below it.

    With m the failure share of all documents and v the variance of host rates (weighted by documents) less what chance alone
    would give, the prior has the strength m (1 - m) / v - 1, held between `strengths`; it is the greater of them where v isn't above 0.
    """
    hosts = stats.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    total = hosts.agg(F.sum("n").alias("_n"), F.sum("failures").alias("_f"), F.count("*").alias("_hosts"), F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("_ff")).first()
    n, f, k, ff = (float(x or 0) for x in total)
    m = f / n if n else 0.0
    # sum of n_h (r_h - m)^2 has the expectation m (1 - m) (k - 1) + v (n - sum n_h^2 / n), of which the last part is taken as n here
    v = (ff - n * m * m - m * (1 - m) * max(k - 1, 0)) / n if n else 0.0
    least, most = params.strengths
    strength = min(most, max(least, m * (1 - m) / v - 1)) if v > 0 else most
    rate = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    bound = F.col("rate") - F.lit(params.deviations) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(strength + 1)))
    return hosts.withColumn("rate", rate).withColumn("bound", bound).withColumn("mean", F.lit(m))


def judge(docs: DataFrame, host: Column, params: HostParams = HostParams()) -> DataFrame:
    """doc_id, the statistics, base_failed, host_rate, host_rejected and kept for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.save(text_stats(docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), "text"), params), "stats")
    rejected = (F.col("bound") > F.lit(params.multiple) * F.col("mean")) & (F.col("bound") > params.least_rate)
    rates = scratch.save(host_rates(stats, params=params).select("host", "rate", rejected.alias("rejected")), "rates")
    if rates.count() <= MAX_BROADCAST_ROWS:
        out = stats.join(F.broadcast(rates), "host")
    else:  # a hot host's rows and as many copies of its verdict are dealt over salts
        salted = stats.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(params.salts)).cast("int"))
        out = salted.join(rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1)))), ["host", "_salt"])
    kept = ~F.col("base_failed") & ~F.col("rejected")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"), kept.alias("kept"))
