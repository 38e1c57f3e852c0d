"""The classifiers once more in plain Python, number by number: features, statistics, updates and scores of every text of a small table."""

import math
from collections import Counter

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from clickweave.llm import textnum
from clickweave.llm.common import unit_hash
from clickweave.llm.langid import LangParams, by_language, has_letter, predict_langid, temperature, train_langid
from clickweave.llm.quality import _AGAIN, _PAIR, QualityParams, score_quality, train_quality
from clickweave.llm.toxicity import ToxicityParams, score_toxicity, train_toxicity

ALL = (1 << 64) - 1
C1, C2, C3 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93
VALUES = [int(v) for v in textnum._VALUES]


def mix(x):
    x = ((x ^ (x >> 30)) * C1) & ALL
    x = ((x ^ (x >> 27)) * C2) & ALL
    return x ^ (x >> 31)


def words(text):
    """Hashes of runs of letters and digits and of runs of other signs."""
    out, run, kind = [], [], 0
    for byte in [*text.encode("utf-8", "surrogatepass"), 0x20]:
        c = 0 if byte == 0x20 or 0x09 <= byte <= 0x0D else 2 if 0x21 <= byte < 0x7F and not (chr(byte).isalnum() or byte == ord("_")) else 1
        if c != kind and run:
            if kind:
                out.append(mix((sum(VALUES[b] * pow(textnum._BASE, k, 1 << 64) for k, b in enumerate(run)) + len(run)) & ALL))
            run = []
        kind = c
        run.append(byte)
    return out


def grams(text, sizes, bits):
    text, out = f" {text.lower()} ", []
    for size in sizes:
        for i in range(len(text) - size + 1):
            h = size
            for ch in text[i : i + size]:
                h = (h * C1 + ord(ch)) & ALL
            h = (h * C2) & ALL
            h = ((h ^ (h >> 29)) * C3) & ALL
            out.append(h >> (64 - bits))
    return out


def ftrl(rows, classes, how):
    """rows: (dict of features, class). Weights by feature, the bias as None."""
    z, n = {}, {}

    def weight(f, c):
        zi, l1 = z.get((f, c), 0.0), how.l1 if f is not None else 0.0
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((how.beta + math.sqrt(n.get((f, c), 0.0))) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for features, y in rows:
            every = {**features, None: 1.0}
            w = {(f, c): weight(f, c) for f in every for c in range(classes)}
            logits = [max(-60.0, min(60.0, sum(v * w[f, c] for f, v in every.items()))) for c in range(classes)]
            if classes == 1:
                err = [1 / (1 + math.exp(-logits[0])) - y]
            else:
                e = [math.exp(x - max(logits)) for x in logits]
                err = [x / sum(e) - (c == y) for c, x in enumerate(e)]
            for f, v in every.items():
                for c in range(classes):
                    g, old = v * err[c], n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / how.alpha * w[f, c]
                    n[f, c] = old + g * g
    return {key: weight(*key) for key in z}, {f for (f, _), k in n.items() if k > 0}


def logistic(x):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")


def labelled(labels, name):
    rows = labels.filter(F.col(name).isNotNull()).select("doc_id", F.col(name).alias("y"), unit_hash(F.col("doc_id"), seed=7).alias("u")).collect()
    return sorted((r.u, r.doc_id, r.y) for r in rows)


def test_quality(tables):
    docs, texts, labels = tables
    params = QualityParams(bits=16)
    got = {r.doc_id: r.score for r in score_quality(docs, train_quality(docs, labels.select("doc_id", F.col("quality").alias("y")), params), params).collect()}

    def features(text):
        w = words(text)
        w = [int(_AGAIN) if k and w[k] == w[k - 1] else w[k] for k in range(len(w))]
        n = Counter(h >> (64 - params.bits) for h in [*w, *(mix((a * int(_PAIR) + b) & ALL) for a, b in zip(w, w[1:], strict=False))])
        length = math.sqrt(sum(math.log1p(k) ** 2 for k in n.values()))
        return {b: math.log1p(k) / length for b, k in n.items()}

    by = {i: features(t) for i, t in texts.items()}
    model, _ = ftrl([({f: float(np.float32(v)) for f, v in by[i].items()}, y) for _, i, y in labelled(labels, "quality") if i in by], 1, params.ftrl)
    for i, f in by.items():
        assert got[i] == pytest.approx(logistic(sum(v * model.get((b, 0), 0.0) for b, v in f.items()) + model[None, 0]), abs=1e-4)


def test_toxicity(tables, monkeypatch):
    docs, texts, labels = tables
    params = ToxicityParams(bits=16, least_toxic=1, least_clean=10)
    got = {r.doc_id: r.score for r in score_toxicity(docs, train_toxicity(docs, labels.select("doc_id", F.col("toxic").alias("y")), params), params).collect()}
    by = {i: set(grams(t, params.sizes, params.bits)) if t else set() for i, t in texts.items()}
    calibrates = {r.doc_id for r in labels.filter("pmod(xxhash64(11, doc_id), 5) = 0").collect()}
    known = [(i, y) for _, i, y in labelled(labels, "toxic") if i in by]
    rows, held_out = [r for r in known if r[0] not in calibrates], [r for r in known if r[0] in calibrates]
    total, held = Counter(y for _, y in rows), [Counter(b for i, y in rows if y == c for b in by[i]) for c in (0, 1)]
    share = [(total[c] + 1e-9) / (len(rows) + 2e-9) for c in (0, 1)]
    ratio = {}
    for b in {b for c in held for b in c}:
        q, p = ((held[c][b] + params.smoothing * share[c]) / (total[c] + params.smoothing) for c in (0, 1))
        r = float(np.float32(math.log(p / q)))
        if abs(r) >= params.least_ratio:
            ratio[b] = r

    def features(i):
        v = {b: ratio[b] for b in by[i] if b in ratio}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {b: x / length for b, x in v.items()}

    model, _ = ftrl([({b: float(np.float32(v)) for b, v in features(i).items()}, y) for i, y in rows], 1, params.ftrl)
    total_of = lambda i: sum(v * model.get((b, 0), 0.0) for b, v in features(i).items()) + model[None, 0]
    sums = sorted((total_of(i), y) for i, y in held_out)
    n = Counter(y for _, y in sums)
    assert n[1] >= 1 and n[0] >= 10
    costs = []  # of a cut after each place
    for k, (z, _) in enumerate(sums):
        if k + 1 == len(sums) or sums[k + 1][0] - z > 1e-9:
            missed, wrong = sum(y for _, y in sums[: k + 1]), sum(1 - y for _, y in sums[k + 1 :])
            costs.append((missed / n[1] + params.clean_weight * wrong / n[0], z, sums[min(k + 1, len(sums) - 1)][0]))
    best = [c for c in costs if c[0] <= min(costs)[0] + 1e-9]
    cut = (best[len(best) // 2][1] + best[len(best) // 2][2]) / 2
    for i in by:
        assert got[i] == pytest.approx(logistic(total_of(i) - cut), abs=2e-3)


def test_language(tables):
    docs, texts, _ = tables
    params = LangParams(bits=12)
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    model = train_langid(docs, params)
    got = {r.doc_id: r for r in predict_langid(docs, model, params).collect()}
    counts = Counter(r.lang for r in known.collect())
    langs, size = sorted(counts), 1 << params.bits
    by = {i: Counter(grams(t, params.sizes, params.bits)) for i, t in texts.items() if t is not None}
    seen = Counter(b for r in known.collect() for b in by[r.doc_id])
    total = sum(counts.values())
    idf = [float(np.float32(math.log((1 + total) / (1 + seen[b])))) + 1 for b in range(size)]

    def features(i):
        v = {b: math.log1p(k) * idf[b] for b, k in by[i].items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / length for b, x in v.items()}

    sample = by_language(known, dict(counts), params).collect()
    shards = [sorted((r for r in sample if not r.calibrates and int(r._u * 1e9) % params.ftrl.shards == k), key=lambda r: r._u) for k in range(params.ftrl.shards)]
    parts = [ftrl([({b: float(np.float32(v)) for b, v in features(r.doc_id).items()}, langs.index(r.lang)) for r in rows], len(langs), params.ftrl) for rows in shards if rows]
    weights = {}
    for f in {f for _, met in parts for f in met}:
        of = [w for w, met in parts if f in met]
        weights[f] = [sum(w.get((f, c), 0.0) for w in of) / len(of) for c in range(len(langs))]
    logits = lambda f: [sum(v * weights[b][c] for b, v in f.items() if b in weights) + weights[None][c] for c in range(len(langs))]
    calibrating = [r for r in sample if r.calibrates]
    assert model.langs == langs
    assert model.temperature == temperature([langs.index(r.lang) for r in calibrating], np.array([logits(features(r.doc_id)) for r in calibrating]))
    for i, text in texts.items():
        if not has_letter(text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = [x / model.temperature for x in logits(features(i))]
        p = [math.exp(x - max(z)) for x in z]
        best = p.index(max(p))
        if sorted(p)[-2] < 0.999 * max(p):
            assert got[i].lang_pred == langs[best]
        assert got[i].score == pytest.approx(p[best] / sum(p), abs=2e-3)
