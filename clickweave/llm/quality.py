"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL updates, scored as sparse dot products.

Words are runs of letters and digits or runs of other signs; a word equal to the one before it counts as the token
"again", so that repetition is a feature of its own. Word 1-grams and 2-grams are hashed into 2**bits buckets with
log-scaled counts of length 1. The model is broadcast (4 * 2**bits bytes, whatever the input), whole texts are scored
in Arrow batches, and a pass over the documents shuffles nothing.

Edge cases: null and empty texts have no feature and get the score of the bias; texts of any length are scored whole;
rows with null labels or null text don't train; ties: a score of 0.5 counts as label 1, rows of equal hash train in the order of their doc_id; repeated
rows are scored each, and don't train beyond the bound; an empty document table gives an empty
result, an empty label table the score 0.5; further columns of the documents don't matter and aren't returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, join_on_key
from .ftrl import Ftrl, train
from .textnum import SIGNS, few_rows, mix, text_slices, word_hashes

_AGAIN = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xDA942042E4DD58B5)


@dataclass(frozen=True)
class QualityParams:
    """sample_rows: the most texts that train the model, by hash of doc_id."""

    bits: int = 20
    sample_rows: int = 12_000
    ftrl: Ftrl = Ftrl(alpha=0.5, l1=0.02, l2=1e-6, epochs=4, shards=1)


def row_features(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.float64)
    words = words.copy()
    words[1:][words[1:] == words[:-1]] = _AGAIN
    grams = np.concatenate([words, mix(words[:-1] * _PAIR + words[1:])])
    idx, n = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    val = np.log1p(n)
    return idx, val / np.sqrt(val @ val)


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, _ = word_hashes(data, np.array([0, len(data)]), SIGNS, lower=False)
    return row_features(words, bits)


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> np.ndarray:
    """labels: doc_id, y (0 or 1). Returns weights of 2**bits buckets and, last, the bias."""
    labels = bounded_sample(labels.filter("y IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "y"), "doc_id", params.sample_rows)
    sample = join_on_key(docs.select("doc_id", "text").filter("text IS NOT NULL"), labels, "doc_id", small_rows=params.sample_rows)
    return train(sample, lambda t: features(t, params.bits), 1 << params.bits, 1, params.ftrl, params.sample_rows)[:, 0]


def score_quality(docs: DataFrame, model: np.ndarray, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, score: the probability of label 1 for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        w = held.value
        for batch in few_rows(batches):
            out = np.empty(batch.num_rows)
            for i, j, data, offsets in text_slices(batch, "text"):
                words, at = word_hashes(data, offsets, SIGNS, lower=False)
                for k in range(j - i):
                    idx, val = row_features(words[at[k] : at[k + 1]], params.bits)
                    out[i + k] = val @ w[idx] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
