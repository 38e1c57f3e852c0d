"""Periodic runs, spelling variants and removal of repeated byte strings, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickweave.llm import prefix_free, variants
from clickweave.llm.common import Scratch
from clickweave.llm.prefix_free import ParseParams, remove_repeats
from clickweave.llm.queries import QUERIES
from clickweave.llm.runs import RunParams, find_runs, frequent_segments, repeat_words, runs_of
from clickweave.llm.variants import VariantParams, count_words, group_variants, word_runs

# --- periodic runs -----------------------------------------------------------------------------------------------------


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def spread_words(rng):
    """Words of few kinds with stretches that repeat, some within others."""
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(0, 160))]
    for _ in range(rng.randint(0, 4)):
        if len(words) > 5:
            a, p = rng.randrange(len(words)), rng.randint(1, 25)
            for i in range(a + p, min(len(words), a + rng.randint(1, 110))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng, found = random.Random(seed), 0
    for _ in range(400):
        words = spread_words(rng)
        expected = brute_runs(words)
        assert runs_of(words) == expected
        found += len(expected)
    assert found > 50


def test_splitting_leaves_frequent_words_only():
    rng = random.Random(7)
    for _ in range(300):
        ids = np.array([rng.randrange(rng.choice([2, 9, 30])) for _ in range(rng.randint(0, 200))], np.int64)
        work, expected = [(0, len(ids))], []
        while work:  # the definition, part by part
            s, e = work.pop()
            counts = Counter(ids[s:e].tolist())
            cuts = [i for i in range(s, e) if counts[ids[i]] < 3]
            if e - s >= 24 and not cuts:
                expected.append((s, e))
            elif cuts:
                work += [(a, b) for a, b in zip([s, *(c + 1 for c in cuts)], [*cuts, e], strict=True) if b - a >= 24]
        assert frequent_segments(ids, 3, 24) == sorted(expected)


@pytest.mark.parametrize("make", [lambda i, n: 0, lambda i, n: i % 1000 if i % 1000 > 992 else 0, lambda i, n: i % (n // 4), lambda i, n: i.bit_count() % 2, lambda i, n: i // 3])
def test_long_texts_of_every_kind_end_soon(make):
    n = 60_000
    runs = runs_of([b"%d" % make(i, n) for i in range(n)])
    assert all(length >= max(24, 3 * q) for _, length, q in runs)


def strongest(runs):
    best = [r for r in runs if all(r[1] * o[2] >= o[1] * r[2] for o in runs)]
    return min(best, key=lambda r: (r[0], r[2]), default=None)


def test_runs_of_edge_cases(spark):
    texts = [(i, t, None) for i, t, _ in cases.EDGE_TEXTS] + [(20, " ".join(["a"] * 24), None), (21, " ".join(["a"] * 23), None), (22, "x y z " * 9 + "q " + "c d " * 30, None), (23, "a b " * 30, None), (24, "a b\x1fb " * 24 + "\t\n", None), (25, ("u v w x y z t s " * 3), None)]
    texts += [(26, " ".join([*"ab" * 24, "-", *"cd" * 24]), None)]  # equal exponents: the first counts
    rows = find_runs(cases.docs(spark, texts), keep=("doc_id", "n", "key"), texts=True).collect()
    assert len(rows) == len(texts)
    expected = Counter()
    for i, t, _ in texts:
        words = (t or "").encode().split()
        runs = brute_runs(words) if len(words) < 1000 else [(0, 150_000, 9973)]
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        expected[(i, len(runs), strongest(runs), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    got = Counter((r.doc_id, r.n_runs, None if r.start is None else (r.start, r.length, r.period), r.collapsed_sha256, r.collapsed) for r in rows)
    assert got == expected
    for r in rows:
        listed = "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.key == "x"
        assert r.exponent_milli == (None if r.start is None else 1000 * r.length // r.period)
    assert find_runs(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        RunParams(min_repeats=2)


def test_words_are_repeated_as_stated(spark):
    rows = [(s, t) for s in (0, 1, 5, 17, 1000, 429496729) for t in ("a", "a b c d e f g h i j k l m n", " x  y\n", "", " ", None)]
    df = spark.createDataFrame(rows, "seed long, text string")
    for r in df.withColumn("out", repeat_words(F.col("text"), F.col("seed"))).collect():
        words = (r.text or "").split()
        if words:
            a = r.seed % len(words)
            p = 1 + (len(words) - a) // (3 + r.seed % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert (r.out or "").split() == words


# --- spelling variants ---------------------------------------------------------------------------------------------------


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def made_words(rng, n):
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(7, 10))) for _ in range(n)}
    for w in sorted(words):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + "ÿ" + w[k:], w[:k] + rng.choice("abcdéz") + w[k + 1 :]]))
    return {w: rng.choice([2, 3, 20, 25, 200, 250, 3000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("params", [VariantParams(), VariantParams(part_words=7, pass_bytes=64, edits=50), VariantParams(bits=1, part_words=100_000)])
def test_variants_equal_brute_force(spark, params):
    counts = made_words(random.Random(3), 150)
    long = "ab" * 6000
    counts |= {long: 2, long[:-1]: 20, "x" + long: 2, long[:5000] + "c" + long[5001:]: 2, "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200}
    got = group_variants(spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3), params)
    expected = brute_variants(counts)
    assert set(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == expected and got.count() == len(counts)
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] is not None and r[1] != r[2] for r in expected)


def test_filters_hold_every_word(spark):
    """No word of the vocabulary is missed, and few others get through."""
    words = sorted(made_words(random.Random(5), 400))
    vocabulary, scratch, params = spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark), VariantParams(part_words=50)
    plan = variants.shard_plan(Counter(map(len, words)), params)
    filters = scratch.save(variants.build_filters(vocabulary, plan), "filters")
    assert filters.count() == sum(s.parts for s in plan.values())
    passes = list(variants._passes(filters, 256))
    assert len(passes) > 3
    edits = set()
    for chosen in passes:
        held = variants.held_parts(filters, chosen)
        edits |= set(map(tuple, variants.probe(vocabulary, held, chosen, plan, "abcdézÿ", params).collect()))
    assert all(is_near(a, b) for a, b in edits)
    true = {(a, b) for a in words for b in words if is_near(a, b) and (len(b) < len(a) or (len(a) == len(b) and b > a))}
    assert true <= edits and len(edits - true) < 0.1 * len(words) * 30


def test_words_of_edge_cases(spark):
    texts = [(i, t, None) for i, t, _ in cases.EDGE_TEXTS] + [(30, "ÀBCDEFÉ àbcdefé ÀbCdEfÉ x×y÷zabc1abcdefgh_abcdefgh", None)]
    runs = cases.docs(spark, texts).select(F.explode(word_runs(F.col("text"), 7)).alias("word"))
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    expected = Counter(w for _, t, _ in texts for w in re.findall("[A-Za-zÀ-ÿ]{7,}", (t or "").translate(lower)))
    assert dict(count_words(runs).collect()) == {w: n for w, n in expected.items() if n >= 2}
    assert group_variants(count_words(cases.empty(spark).select(F.explode(word_runs(F.col("text"))).alias("word")))).count() == 0
    assert [tuple(r) for r in group_variants(spark.createDataFrame([("abcdefg", 5)], "word string, n long")).collect()] == [("abcdefg", None, "abcdefg", 5, 0, None)]


def test_variants_query_equals_brute_force_on_edge_cases(spark, tmp_path):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 11))) for _ in range(30)]
    rows = [(None if k % 50 == 0 else k // 2, " ".join(rng.choice(base) for _ in range(40)) if k % 7 else None) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for w in (t or "").split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    got = QUERIES["op12_variants"](spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == brute_variants(counts) and len(got) == len(counts)


# --- repeated byte strings -----------------------------------------------------------------------------------------------

LAST = (1 << 63) - 1


def brute_repeats(rows, width=50):
    first, texts = {}, [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], d), d)
    out = Counter()
    for (doc_id, _), (d, b) in zip(rows, texts, strict=True):
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                covered[i : i + width] = True
        kept = bytes(x for x, c in zip(b, covered, strict=False) if not c)
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[0])
        out[(doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def repeating_rows(rng, n, unique):
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    words = lambda k: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, k)))
    base = [words(120) for _ in range(12)] + ["a" * 300, "ab" * 100, "a" * 3000, "", None]
    rows = []
    for i in range(n):
        kind, text = rng.random(), words(90)
        if kind < 0.3:
            text = rng.choice(base)
        elif kind < 0.7:  # a passage of another text at any place
            b = rng.choice(base) or ""
            x = rng.randint(0, len(b))
            text = words(40) + b[x : rng.randint(x, len(b))] + words(40)
        rows.append((i if unique or rng.random() < 0.9 else rng.choice([None, 0, 3]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("params", [ParseParams(), ParseParams(bucket_bytes=4000, block_bytes=3000, hot=2, group=2, piece=256), ParseParams(bucket_bytes=9000, block_bytes=1000, hot=4, group=3, piece=64)])
def test_repeats_equal_brute_force(spark, params, unique):
    rows = repeating_rows(random.Random(11), 200, unique)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("row", F.lit("clash")).withColumn("data", F.lit(1)).withColumn("doc", F.lit(2))
    expected = brute_repeats(rows)
    assert Counter(map(tuple, remove_repeats(df, params).collect())) == expected
    assert sum(r[2] for r in expected) > 5000


def test_other_lengths_and_real_outputs(spark):
    rows = [(3, "x" * 10 + "0123456789abcdef" + "y" * 5), (1, "0123456789abcdef"), (2, "zz0123456789abcdezz")]
    params = ParseParams(length=12, gram=8)
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"), params, texts=True).collect()}
    assert bytes(got[3].kept) == b"x" * 10 + b"y" * 5 and [tuple(s) for s in got[3].spans] == [(10, 26)]
    assert bytes(got[2].kept) == b"zzzz" and bytes(got[1].kept) == b"0123456789abcdef"
    with pytest.raises(ValueError):
        ParseParams(gram=60)


def test_a_passage_that_most_documents_share_is_dealt_by_phrase(spark):
    """A hot passage behind different words: many different phrases hold its first trigger."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(200))
    rows = [(k, "".join(rng.choice("klmnopq") for _ in range(60)) + passage + "".join(rng.choice("rstuv") for _ in range(60))) for k in range(300)]
    df, params, scratch = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ParseParams(bucket_bytes=20_000, block_bytes=10_000, hot=4, group=8), Scratch(spark)
    assert Counter(map(tuple, remove_repeats(df, params).collect())) == brute_repeats(rows)
    parsed = scratch.save(prefix_free._parse(df.selectExpr("doc_id AS row", "doc_id AS doc", "text"), 5, params), "parsed")
    assert parsed.filter("part > 0").count() > 5
    # of a phrase that all hold a block sends one record
    inner = [prefix_free.unpack([bytes(r.data)], *prefix_free._PHRASE) for r in parsed.filter("bucket >= 0 AND part = 0").collect()]
    most = Counter(int(t) for r in inner for t in r[0]).most_common(1)[0][1]
    assert most <= len(rows) // 8 + 8


def test_repeats_of_edge_cases(spark):
    rows = [(i, t) for i, t, _ in cases.EDGE_TEXTS if t is None or len(t) < 1000]
    got = Counter(map(tuple, remove_repeats(cases.docs(spark, [(i, t, None) for i, t in rows])).collect()))
    assert got == brute_repeats(rows)
    long = {r.doc_id: r for r in remove_repeats(cases.docs(spark), ParseParams(piece=100_000)).collect()}
    n, text = len(cases.LONG), cases.LONG + " end"
    n += sum(text[n + k - 49 : n + k + 1] in cases.LONG for k in range(4))  # its words repeat, so the blank after it is covered, too
    assert (long[6].n_removed, long[7].n_removed, long[7].n_spans) == (0, n, 1)
    assert remove_repeats(cases.empty(spark)).count() == 0


def test_packed_arrays_and_merged_spans():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 1 << 40, 50).astype(np.uint64), rng.integers(-5, 1 << 60, 50), rng.integers(0, 9, 50).astype("<u4")
    data = [prefix_free.pack(prefix_free._low(x, 5), y, z) for x, y, z in ((a[:20], b[:20], c[:20]), (a[20:], b[20:], c[20:]))]
    for want, got in zip((a, b, c), prefix_free.unpack(data, "5", "<i8", "<u4"), strict=True):
        assert (want == got).all()
    row, start = rng.integers(0, 4, 60), rng.integers(0, 300, 60)
    end = start + rng.integers(1, 20, 60)
    covered = {(r, p) for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True) for p in range(s, e)}
    merged = list(zip(*(x.tolist() for x in prefix_free.merge_spans(row, start, end)), strict=True))
    assert {(r, p) for r, s, e in merged for p in range(s, e)} == covered
    assert all((r, s - 1) not in covered and (r, e) not in covered for r, s, e in merged)
