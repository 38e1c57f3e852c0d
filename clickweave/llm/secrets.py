"""Secret scans in DataFrame functions only: fixed patterns, and a likelihood ratio of two character Markov models.

A pattern's matches and the pieces between them come from the same regular expression; the running sum of their lengths
gives every span. Long runs of key characters outside the spans, and then the parts of other runs between / = _ -, are compared under two
first-order Markov models over characters, one of random strings and one of ordinary identifiers, both estimated from labelled
samples; a run or part with letters whose mean log-likelihood ratio per transition exceeds a limit, a stricter one if it has no digit, is a span of kind `markov`.

A text without a run of 16 key characters, as most are, meets two patterns only. The models are tables of (alphabet + 1) squared numbers, whatever the input; scanning needs no shuffle. Work grows with
the text, and with k * sqrt(k) in the number k of a text's matches.

Edge cases: null text counts as empty and has no span (and stays null when redacted); texts of any length are scanned whole;
ties: spans that start together stand in the order of the kinds; repeated rows are scanned each; without samples no token is added; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fresh

#: Kinds in their order, patterns, the group that a length limit counts, and that limit.
KINDS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: The same matches, found without those that fail for their length; a run that fails can hold none that passes.
FOUND = KINDS | {"access": (r"AKIA[A-Z0-9]{16,}+", 0, 20), "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24)}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
PART = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{16,}+"
IDENTIFIER = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class SecretParams:
    """ratio: least mean log-likelihood ratio of a span; letters_ratio: of a span without a digit; smoothing: added to every transition; sample_docs: the most documents that
    labelled samples are taken from; random_strings: generated samples of random strings of each kind."""

    ratio: float = 0.7
    letters_ratio: float = 1.3
    smoothing: float = 0.5
    sample_docs: int = 5_000
    random_strings: int = 2_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def prefix_sums(lengths: Column) -> Column:
    """For every place the sum of the elements before it, by blocks of about the square root of their number."""

    def total(values):
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def by_blocks(values, block):
        last = F.floor((F.size(values) - 1) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(values, b * block + 1, block)))
        number = lambda i: F.floor(i / block).cast("int")
        return _let(sums, lambda s: F.transform(values, lambda _, i: total(F.slice(s, 1, number(i))) + total(F.slice(values, number(i) * block + 1, i % block))))

    return _let(lengths, lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda block: by_blocks(v, block)))


def has_run(text: Column) -> Column:
    """Whether a text can have a match of any kind but assign."""
    return F.coalesce(text, F.lit("")).rlike(CANDIDATE)


def _matches(text: Column, kind: tuple[str, int, int], gate: Column | None = None) -> Column:
    """Of a text with a match: the matches, what a length limit counts of each, and the pieces between them; null without a match or where the gate is false."""
    pattern, group, _ = kind
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    some = F.coalesce(text, F.lit("")).rlike(pattern)
    return F.when(some if gate is None else gate & some, F.struct(whole.alias("found"), counted.alias("counted"), F.split(text, pattern, -1).alias("pieces")))


def _spans(m: Column, rank: int, passes) -> Column:
    """start, rank, end of the matches that pass."""
    lengths = F.transform(m["found"], lambda x, i: F.length(x) + F.length(F.get(m["pieces"], i)))
    spans = F.transform(prefix_sums(lengths), lambda at, i: F.struct((at + F.length(F.get(m["pieces"], i))).alias("start"), F.lit(rank).alias("rank"), (at + F.length(F.get(m["pieces"], i)) + F.length(F.get(m["found"], i))).alias("end"), passes(F.get(m["counted"], i)).alias("passes")))
    kept = F.filter(spans, lambda s: s["passes"])
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,passes:boolean>>")
    return F.when(m.isNotNull(), kept).otherwise(empty)


def _replaced(text: Column, m: Column, passes, by) -> Column:
    """The text with by(match) in the place of every match that passes."""
    parts = F.transform(m["pieces"], lambda p, i: F.concat(p, F.coalesce(F.when(passes(F.get(m["counted"], i)), by(F.get(m["found"], i))).otherwise(F.get(m["found"], i)), F.lit(""))))
    return F.when(m.isNotNull(), F.array_join(parts, "")).otherwise(text)


def _replace(text: Column, kind: tuple[str, int, int], passes, by, gate: Column | None = None, found=None) -> Column:
    """The text with by(match) for every match that passes; the text and its matches are computed once, so that steps can be chained."""
    found = found or (lambda t: _matches(t, kind, gate))
    return _let(text, lambda t: _let(found(t), lambda m: _replaced(t, m, passes, by)))


def _long(limit: int):
    return lambda x: F.length(x) >= limit


def _blank(x: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(x))


def markov_counts(samples: DataFrame) -> DataFrame:
    """samples: value, label (1 random, 0 ordinary). Returns label, a, b, n: transitions between places in the alphabet, 0 for others."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i")
    pairs = samples.filter(F.length("value") > 1).select("label", "value", at)
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(F.col("value"), i, F.lit(1)))
    return pairs.select("label", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b")).groupBy("label", "a", "b").agg(F.count("*").alias("n"))


def train_markov(samples: DataFrame, params: SecretParams = SecretParams()) -> list[float]:
    """Log-likelihood ratios (random to ordinary) of all transitions, row by row; zeros if either label has no sample."""
    size = len(ALPHABET) + 1
    counts = [[params.smoothing] * (size * size) for _ in range(2)]
    seen = [0, 0]
    for r in markov_counts(samples).collect():  # at most 2 * size * size rows
        counts[r.label][r.a * size + r.b] += r.n
        seen[r.label] += r.n
    if not all(seen):
        return [0.0] * (size * size)
    rows = [[sum(c[a * size : (a + 1) * size]) for a in range(size)] for c in counts]
    return [math.log(counts[1][k] / rows[1][k // size]) - math.log(counts[0][k] / rows[0][k // size]) for k in range(size * size)]


def labelled_samples(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """value, label: values that the fixed patterns find and strings made from digests are random, other identifiers of the same documents ordinary."""
    some = bounded_sample(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id", params.sample_docs, seed=13)
    values, rest = [], F.col("text")
    for pattern, group, limit in FOUND.values():
        values.append(F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), _long(limit)))
        rest = F.regexp_replace(rest, pattern, " ")
    found = some.select(F.explode(F.concat(*values)).alias("value"), F.lit(1).alias("label"))
    ordinary = some.select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("value"), F.lit(0).alias("label"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    forms = F.array(F.translate(F.base64(F.unhex(digest)), "=", ""), F.substring(digest, 1, 40), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))
    made = docs.sparkSession.range(params.random_strings).select(F.explode(forms).alias("value"), F.lit(1).alias("label"))
    return found.union(ordinary).distinct().union(made)


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + F.get(table, code(i) * (len(ALPHABET) + 1) + code(i + 1)))
    return total / (F.length(token) - 1)


def _random(model: list[float], params: SecretParams):
    return lambda x: x.rlike("[A-Za-z]") & (mean_ratio(x, model) > F.when(x.rlike("[0-9]"), params.ratio).otherwise(params.letters_ratio))


def scan(docs: DataFrame, model: list[float], params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_markov of every row."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("run", has_run(F.col("text")))
    df = df.withColumns({f"m_{name}": _matches(F.col("text"), k, None if name == "assign" else F.col("run")) for name, k in FOUND.items()})
    df = df.withColumns({f"s_{name}": _spans(F.col(f"m_{name}"), r, _long(k[2])) for r, (name, k) in enumerate(FOUND.items())})
    # what the patterns found is blanked, one kind after the other, before runs are looked for; where nothing was blanked, matches stay as they are
    rest, same = F.col("text"), F.lit(True)
    for name, kind in FOUND.items():
        rest = _replace(rest, kind, _long(kind[2]), _blank, F.col("run"), lambda t, k=kind, n=name, s=same: F.when(s, F.col(f"m_{n}")).otherwise(_matches(t, k, F.col("run"))))
        same = same & F.col(f"m_{name}").isNull()
    random, rank = _random(model, params), len(FOUND)

    def parts(t, m):
        return _let(_replaced(t, m, random, _blank), lambda u: _let(_matches(u, (PART, 0, 16), m.isNotNull()), lambda p: _spans(p, rank, random)))

    def runs(t):
        return _let(_matches(t, (CANDIDATE, 0, 16), F.col("run")), lambda m: F.struct(_spans(m, rank, random).alias("run"), parts(t, m).alias("part")))

    df = df.withColumn("m", _let(rest, runs)).withColumn("s_run", F.col("m.run")).withColumn("s_part", F.col("m.part"))
    names = F.array(*map(F.lit, [*FOUND, "markov"]))

    def joined(*kinds):
        spans = F.sort_array(F.concat(*(F.col(f"s_{k}") for k in kinds)))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")

    return df.select(
        "doc_id",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in FOUND),
        F.sha2(joined(*FOUND).cast("binary"), 256).alias("base_sha256"),
        joined(*FOUND, "run", "part").alias("spans"),
        (F.size("s_run") + F.size("s_part")).cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, model: list[float], params: SecretParams = SecretParams(), by: str = "[SECRET]") -> DataFrame:
    """docs with `by` in the place of every span, kind after kind, and n_chars (if docs has it) counted again."""
    run = fresh("_run", docs.columns)
    df = docs.withColumn("text", F.col("text").cast("string")).withColumn(run, has_run(F.col("text")))
    text = F.col("text")
    for name, (pattern, group, limit) in [*FOUND.items(), ("run", (CANDIDATE, 0, None)), ("part", (PART, 0, None))]:
        passes = _random(model, params) if limit is None else _long(limit)
        text = _replace(text, (pattern, group, 0), passes, lambda _: F.lit(by), None if name == "assign" else F.col(run))
    df = df.withColumn("text", text).drop(run)
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else df
