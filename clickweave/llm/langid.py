"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, FTRL with elastic net, then temperature calibration.

Inverse document frequencies of hashed character n-grams cover all documents that may be learned from; the classifier is
fitted on a bounded sample of them, which has a floor of rows for every language, and one positive temperature is chosen on a part
of each language's rows that didn't train, by least log-loss. Whole texts are scored; nothing but bounded vectors is shuffled.

A softmax always names some language it knows. What tells texts in none of them is how much of a text the model knows at all:
`familiar`, the share of its squared TF-IDF length in n-grams that have a weight. The model's limit comes from the calibrating rows, which
are text of the learned languages: half of the share that all but one in a hundred of them exceed, whatever the number of languages. A text of n
different n-grams is held to that limit less noise / sqrt(n) of it, since few n-grams say little either way.

Edge cases: null text and text without a letter give `und` with score 0, as does a model that has seen no language; ties: of languages of
equal probability the first by name; texts of any length are scored whole; rows with null lang don't train; repeated rows are scored each; empty
tables work; further columns don't matter; more than max_langs languages (if it is set) are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sum_vectors, unit_hash
from .ftrl import Ftrl, train
from .textnum import char_ngrams, few_rows


@dataclass(frozen=True)
class LangParams:
    """sizes: characters of the n-grams; sample_rows: the most documents that train and calibrate; calibrate: the share of them that calibrates;
    familiar: the limit of familiarity as a share of the calibrating rows' first percentile; noise: how much lower it is for short texts; with max_langs, more languages than that are an error."""

    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    sample_rows: int = 12_000
    calibrate: float = 0.2
    familiar: float = 0.5
    noise: float = 3.0
    max_langs: int | None = None
    ftrl: Ftrl = Ftrl(alpha=0.3, l1=0.05, l2=1e-5, epochs=2)


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    familiar: float = 0.0


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def tfidf(text: str, idf: np.ndarray, params: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values (log-scaled counts) of length 1."""
    grams = char_ngrams(f" {text.lower()} ", params.sizes, params.bits)
    if len(grams) > 8192:
        n = np.bincount(grams, minlength=len(idf))
        idx = np.flatnonzero(n)
        n = n[idx]
    else:
        idx, n = np.unique(grams, return_counts=True)
    val = np.log1p(n) * idf[idx]
    return idx, val / (np.sqrt(val @ val) or 1.0)


def train_langid(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """docs: doc_id, text, lang; all rows may be learned from."""
    size = 1 << params.bits
    known = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        df, rows = np.zeros(size, np.int64), 0
        for batch in few_rows(batches):
            for text in batch.column("text"):
                grams = char_ngrams(f" {text.as_py().lower()} ", params.sizes, params.bits)
                df += np.bincount(grams, minlength=size) > 0 if len(grams) > 8192 else np.bincount(np.unique(grams), minlength=size)
                rows += 1
        return np.append(df, rows)

    sums = sum_vectors(known.select("text"), count, size + 1)
    total = int(sums[-1])
    idf = np.log((1 + total) / (1 + sums[:-1])).astype(np.float32) + 1
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if params.max_langs is not None and len(counts) > params.max_langs:
        raise ValueError(f"{len(counts)} languages, but max_langs is {params.max_langs}")
    langs = sorted(quotas(counts, params.sample_rows))
    if not langs:
        return LangModel([], idf, np.zeros((size + 1, 0), np.float32), 1.0)
    sample = by_language(known, counts, params)
    held = docs.sparkSession.sparkContext.broadcast(idf)
    y = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    sample = sample.select("_u", "text", y.alias("y"), "calibrates")
    w = train(sample.filter("NOT calibrates"), lambda t: tfidf(t, held.value, params), size, len(langs), params.ftrl)
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def logits(batches):
        used = (sent.value[:-1] != 0).any(1)
        for batch in few_rows(batches):
            rows = [tfidf(t, held.value, params) for t in batch.column("text").to_pylist()]
            out = np.array([v @ sent.value[i] + sent.value[-1] for i, v in rows], np.float64).reshape(-1, len(langs))
            share = np.array([(v[used[i]] ** 2).sum() for i, v in rows], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int64()), pa.array(list(out), pa.list_(pa.float64())), pa.array(share)], ["y", "z", "familiar"])

    got = sample.filter("calibrates").select("text", "y").mapInArrow(logits, "y long, z array<double>, familiar double").collect()
    if not got:
        return LangModel(langs, idf, w, 1.0)
    return LangModel(langs, idf, w, temperature([r.y for r in got], np.array([r.z for r in got])), params.familiar * float(np.quantile([r.familiar for r in got], 0.01)))


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows of every language a sample of at most `rows` takes: a floor of a quarter of an even split, and the rest by share.

    Of more languages than rows the most frequent have one each.
    """
    if sum(counts.values()) <= rows:
        return dict(counts)
    most = sorted(counts, key=lambda lang: (-counts[lang], lang))[:rows]
    floor = max(1, rows // (4 * len(most)))
    out = {lang: min(counts[lang], floor) for lang in most}
    rest, over = rows - sum(out.values()), {lang: counts[lang] - out[lang] for lang in most}
    total = sum(over.values())
    return {lang: out[lang] + rest * over[lang] // total for lang in most}


def by_language(known: DataFrame, counts: dict[str, int], params: LangParams) -> DataFrame:
    """A sample of `known` by quotas in the order of a hash. Adds _u and calibrates, which the same share of every language's rows is, rounded down."""
    wanted = quotas(counts, params.sample_rows)
    # the hash keeps few more rows than are wanted, so that only about the sample is sorted
    rows = [(lang, n, (n + 6 * n**0.5 + 20) / counts[lang]) for lang, n in wanted.items()]
    limits = known.sparkSession.createDataFrame(rows, "lang string, _wanted long, _below double")
    df = known.withColumn("_u", unit_hash(F.col("doc_id"), seed=7)).join(F.broadcast(limits), "lang").filter("_u < _below OR _below >= 1")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id", F.xxhash64("text")))
    df = df.withColumn("_place", place).filter("_place <= _wanted")
    other = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(11), "doc_id"), "_place"))
    return df.withColumn("calibrates", other <= F.floor(F.lit(params.calibrate) * F.col("_wanted"))).drop("_wanted", "_below", "_place")


def temperature(y: list[int], z: np.ndarray) -> float:
    """The temperature of least log-loss, on a grid of factors of two to the eighth root."""

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()

    return float(min((2 ** (k / 8) for k in range(-32, 33)), key=loss))


def predict_langid(docs: DataFrame, model: LangModel, params: LangParams = LangParams(), keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "is_familiar")) -> DataFrame:
    """The predicted language, its calibrated probability and whether the text is familiar enough, for every row, after the columns named in keep (doc_id, if none is)."""
    keep = keep or ("doc_id",)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = held.value
        used = (m.weights[:-1] != 0).any(1)
        for batch in few_rows(batches):
            langs, scores, familiar = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not m.langs or not has_letter(text):
                    langs.append("und")
                    continue
                idx, val = tfidf(text, m.idf, params)
                z = (val @ m.weights[idx] + m.weights[-1]) / m.temperature
                e = np.exp(z - z.max())
                best = int(e.argmax())
                langs.append(m.langs[best])
                scores[k] = e[best] / e.sum()
                familiar[k] = (val[used[idx]] ** 2).sum() >= m.familiar * (1 - params.noise / np.sqrt(len(idx)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores), pa.array(familiar)], [*keep, *names])

    rows = docs.select(*(F.col(c) for c in keep if c != "text"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, rows.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean"))
