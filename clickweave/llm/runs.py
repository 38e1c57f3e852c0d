"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q and a length of at least max(min_words, min_repeats * q) that no neighbouring
word extends keeping the period. Such a run holds each of its words at least min_repeats times, so a word that occurs less often within a
segment lies in no run of it: it splits the segment, and the parts are split again by their own counts until nothing changes. The larger
part of a split inherits the counts less those of the smaller ones, so the whole recursion costs n log n.

Surviving segments are scanned lag by lag. At lag q only every q-th place is probed: a run of three periods holds two probes in a row and the
words between them, so the hashes of the q (to the next lower power of two) words at both are equal. Probes that agree are extended word by
word to both sides; hashes only choose where to look. A stretch found within a run whose period divides q has that period and is left out.

Edge cases: null and empty texts, and texts of white space only, have no word and no run; a text of fewer than min_words words has none;
texts of any length are worked on whole, by one task each; ties in exponent go to the smallest start, then to the smallest period; repeated rows
give a result each; an empty table gives an empty result; further columns are kept if named in `keep`, others don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import few_rows, mix

_GRAM = 8
_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RunParams:
    """Least length of a run in words and in periods (three or more, on which the probes rest, and at least 24 words)."""

    min_words: int = 24
    min_repeats: int = 3

    def __post_init__(self):
        if self.min_repeats < 3 or self.min_words < 24:
            raise ValueError("runs need min_repeats of 3 or more and min_words of 24 or more")


def frequent_segments(ids: np.ndarray, repeats: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least `least` places in which every value occurs `repeats` times or more, within the stretch."""
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], np.arange(int(ids.max()) + 2 if len(ids) else 1))
    out: list[tuple[int, int]] = []
    work: list[tuple[int, int, dict[int, int] | None, np.ndarray | None]] = [(0, len(ids), None, None)]
    while work:
        start, end, counts, changed = work.pop()
        if end - start < least:
            continue
        if counts is None:
            values, n = np.unique(ids[start:end], return_counts=True)
            counts, changed = dict(zip(values.tolist(), n.tolist(), strict=True)), values
        rare = [v for v in changed.tolist() if 0 < counts.get(v, 0) < repeats]
        if not rare:
            out.append((start, end))
            continue
        places = [order[first[v] : first[v + 1]] for v in rare]
        cuts = np.sort(np.concatenate(places))
        cuts = cuts[(cuts >= start) & (cuts < end)]
        starts, ends = np.concatenate([[start], cuts + 1]), np.concatenate([cuts, [end]])
        big = int(np.argmax(ends - starts))
        removed = np.concatenate([ids[start : starts[big]], ids[ends[big] : end]])
        values, n = np.unique(removed, return_counts=True)
        for v, k in zip(values.tolist(), n.tolist(), strict=True):
            counts[v] -= k
        work += [(s, e, None, None) for j, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if j != big and e - s >= least]
        work.append((int(starts[big]), int(ends[big]), counts, values))
    return sorted(out)


def _grow(a: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The largest s <= i < e with a[j] == a[j + q] for all j in [s, e)."""
    s, step = i, 64
    while s > 0:
        low = max(0, s - step)
        wrong = np.flatnonzero(a[low:s] != a[low + q : s + q])
        if len(wrong):
            s = low + int(wrong[-1]) + 1
            break
        s, step = low, 2 * step
    e, n, step = i, len(a) - q, 64
    while e < n:
        high = min(n, e + step)
        wrong = np.flatnonzero(a[e:high] != a[e + q : high + q])
        if len(wrong):
            e += int(wrong[0])
            break
        e, step = high, 2 * step
    return s, e


def lag_scan(ids: np.ndarray, params: RunParams = RunParams()) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a segment."""
    n, found = len(ids), {}
    if n < params.min_words:
        return []
    size, grams = 1, mix(ids.astype(np.uint64) + _C)
    for q in range(1, n // params.min_repeats + 1):
        want = max(_GRAM, 1 << (q.bit_length() - 1))
        while size < want:  # hashes of twice as many words
            grams = mix(grams[:-size] * _C + grams[size:])
            size *= 2
        probes = grams[::q]
        hits = np.flatnonzero(probes[1:] == probes[:-1]) * q
        if not len(hits):
            continue
        for p in [p for p in found if q % p == 0]:
            starts, ends = found[p]
            k = np.searchsorted(starts, hits, "right") - 1
            hits = hits[(k < 0) | (np.asarray(ends)[k] < hits + q)]
        starts, ends, done = [], [], -1
        for i in hits.tolist():
            if i < done:
                continue
            s, e = _grow(ids, i, q)
            done = max(done, e)
            if e + q - s >= max(params.min_words, params.min_repeats * q):
                starts.append(s)
                ends.append(e + q)
        if starts:
            found[q] = (starts, ends)
    return sorted((s, e - s, q) for q, (starts, ends) in found.items() for s, e in zip(starts, ends, strict=True))


def runs_of(words: list[bytes], params: RunParams = RunParams()) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    if len(words) < params.min_words:
        return []
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    out = []
    for start, end in frequent_segments(ids, params.min_repeats, params.min_words):
        out += [(start + s, length, q) for s, length, q in lag_scan(ids[start:end], params)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared as whole numbers; ties by start, then period."""
    best = None
    for run in runs:  # by start, then period: only a greater one replaces
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, params: RunParams = RunParams(), keep: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """For each row of docs (text and the columns to keep): the number of runs, the strongest, digests of all runs and of the text
    without what repeats (in each run all but the first period is dropped); texts adds the runs and that text themselves."""
    more = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep)), RUN_COLUMNS, *([more] if texts else [])])
    words_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 256):
            rows = []
            for text in batch.column(batch.num_columns - 1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space alone
                runs = runs_of(words, params)
                if runs:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for s, length, q in runs:
                        edges[s + q] += 1
                        edges[s + length] -= 1
                    words = [w for w, dropped in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not dropped]
                top, collapsed = _strongest(runs), b" ".join(words)
                row = [len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None]
                row += [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                rows.append(row + ([[dict(start=s, length=n, period=q) for s, n, q in runs], collapsed.decode("utf-8", "surrogatepass")] if texts else []))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + ([words_type, pa.string()] if texts else [])
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            names = [c.split()[0] for c in RUN_COLUMNS.split(", ")] + (["runs", "collapsed"] if texts else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *names])

    return docs.select(*(F.col(c) for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(scan, schema)


def repeat_words(text, seed):
    """Text whose words from the a-th on repeat with period p, where a and p come from an integer column: a = seed mod n, p = 1 + (n - a) div (3 + seed mod 8)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def repeated(struct):
        ws, a, p = struct["words"], struct["a"], struct["p"]
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, at(i).cast("int"))), " ")

    n = lambda s: F.size(s["words"]).cast("long")
    held = F.filter(F.array(F.struct(words.alias("words"))), lambda s: F.size(s["words"]) > 0)
    with_a = F.transform(held, lambda s: F.struct(s["words"].alias("words"), (seed % n(s)).alias("a")))
    with_p = F.transform(with_a, lambda s: F.struct(s["words"].alias("words"), s["a"].alias("a"), (1 + F.floor((n(s) - s["a"]) / (3 + seed % 8))).cast("long").alias("p")))
    return F.get(F.transform(with_p, repeated), 0)
