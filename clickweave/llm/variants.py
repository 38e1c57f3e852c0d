"""Spelling variants of words by Bloom-guided neighbourhoods.

Words are counted over all texts (combined before the shuffle). For every word all strings that differ from it by one deleted or one replaced
letter are generated as hashes (an inserted letter is a deletion seen from the other word) and probed against Bloom filters of the
vocabulary. Only strings that a filter lets through are made as strings and shuffled to an exact join with the vocabulary, which removes what was let through wrongly.

Filters are sharded by length, and each shard is an array of 64-bit blocks: a word sets a few bits of the one block that its hash names, so a
probe is one read. A shard is cut into parts of at most part_words words by hash; every part is built by a task of its own. Parts are broadcast in
passes of at most pass_bytes, and a pass probes only the edits that fall into its parts: what is sent at once doesn't grow with the vocabulary, the
number of passes does.

Edge cases: null and empty texts have no word; letters are A-Z, a-z and U+00C0 to U+00FF, and only A-Z are lower-cased; words of any length
are taken whole, their edits in pieces; ties in n go to the smallest word in code-point order; repeated rows count each; an empty table
gives an empty result; further columns don't matter and aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textnum import few_rows, mix

#: What words are made of.
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_M = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _M(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class VariantParams:
    """Words of min_length letters and min_count occurrences count; a form must occur `ratio` times as often. bits: of the filter, for each
    word (four are set); part_words: words of a part of a shard; pass_bytes: parts that are broadcast at once; task_words: words whose edits one task probes, for they are
    small beside the work on them; edits: generated at once in a task."""

    min_length: int = 7
    min_count: int = 2
    ratio: int = 10
    bits: int = 16
    part_words: int = 500_000
    pass_bytes: int = 32 << 20
    task_words: int = 50_000
    edits: int = 1 << 20


def word_runs(text: Column, least: int = 1) -> Column:
    """All words of a text that have `least` letters or more, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))


def count_words(runs: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """runs: word. Returns word, n of the words that count."""
    return runs.filter(F.length("word") >= params.min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= params.min_count)


# --- hashes of words and of their edits --------------------------------------------------------------------------------


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + _M(length))


def _same_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places and their letters as one row each."""
    texts = words.to_pylist()
    lengths = np.array([len(w) for w in texts], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer("".join(texts[i] for i in at.tolist()).encode("latin-1"), np.uint8).reshape(len(at), length)


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return _finish((_LETTER[letters] * _powers(letters.shape[1])).sum(1, dtype=np.uint64), letters.shape[1])


def _pieces(letters: np.ndarray, width: int, most: int) -> Iterator[tuple[slice, slice]]:
    """Rows and places whose edits (`width` a place) are generated at once."""
    m, length = letters.shape
    places = max(1, min(length, most // width))
    rows = max(1, most // (width * places))
    for i in range(0, m, rows):
        for k in range(0, length, places):
            yield slice(i, min(m, i + rows)), slice(k, min(length, k + places))


def deletions(letters: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place and hash of every different string that lacks one letter."""
    m, length = letters.shape
    powers, inverse = _powers(length), _M(pow(_BASE, -1, 1 << 64))
    for rows, places in _pieces(letters, 2, most):
        part = _LETTER[letters[rows]] * powers
        before = np.cumsum(part, 1, dtype=np.uint64)
        after = (before[:, -1:] - before) * inverse
        sums = (before - part + after)[:, places]
        doubled = np.zeros((part.shape[0], length), bool)  # of a run of one letter only the last deletion counts
        doubled[:, :-1] = letters[rows, 1:] == letters[rows, :-1]
        r, k = np.nonzero(~doubled[:, places])
        yield r + rows.start, k + places.start, _finish(sums[r, k], length - 1)


def replacements(letters: np.ndarray, alphabet: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place, letter and hash of every string with one letter replaced by a later one (the other half is seen from the other word)."""
    length = letters.shape[1]
    powers = _powers(length)
    total = (_LETTER[letters] * powers).sum(1, dtype=np.uint64)
    for rows, places in _pieces(letters, len(alphabet), most):
        part = letters[rows, places]
        later = alphabet[None, None, :] > part[:, :, None]
        r, k, a = np.nonzero(later)
        new, at = alphabet[a], powers[places][k]
        sums = total[rows][r] + (_LETTER[new] - _LETTER[part[r, k]]) * at
        yield r + rows.start, k + places.start, new, _finish(sums, length)


# --- filters -----------------------------------------------------------------------------------------------------------


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Four bits of a block, from the lower 24 bits."""
    one = _M(1)
    out = one << (hashes & _M(63))
    for k in (6, 12, 18):
        out |= one << ((hashes >> _M(k)) & _M(63))
    return out


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _M(24)) % _M(parts)).astype(np.int64)


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> _M(34)) % _M(blocks)).astype(np.int64)


@dataclass(frozen=True)
class Shard:
    """Parts of the filter of the words of one length, and blocks of each part."""

    parts: int
    blocks: int


def shard_plan(sizes: dict[int, int], params: VariantParams) -> dict[int, Shard]:
    out = {}
    for length, n in sizes.items():
        parts = -(-n // params.part_words)
        out[length] = Shard(parts, max(1, -(-n * params.bits // (64 * parts))))
    return out


def build_filters(words: DataFrame, plan: dict[int, Shard]) -> DataFrame:
    """words: word. Returns length, part, data: every part by one task, which holds its words' hashes only."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 8192):
            for at, letters in _same_length(batch.column(0)):
                h = word_hashes(letters)
                part = _part_of(h, plan[letters.shape[1]].parts)
                for p in np.unique(part).tolist():
                    packed = h[part == p].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([letters.shape[1]], pa.int32()), pa.array([p], pa.int32()), pa.array([packed], pa.binary())], ["length", "part", "data"])

    def build(group: pa.Table) -> pa.Table:
        length, part = group["length"][0].as_py(), group["part"][0].as_py()
        bits = np.zeros(plan[length].blocks, np.uint64)
        for packed in group["data"]:
            h = np.frombuffer(packed.as_py(), np.uint64)
            np.bitwise_or.at(bits, _block_of(h, len(bits)), _bits(h))
        return pa.table({"length": pa.array([length], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([bits.tobytes()], pa.binary())})

    schema = "length int, part int, data binary"
    return words.select("word").mapInArrow(hashed, schema).groupBy("length", "part").applyInArrow(build, schema)


def _passes(filters: DataFrame, pass_bytes: int) -> Iterator[list[tuple[int, int]]]:
    """Parts in passes of at most pass_bytes (or one part)."""
    now, size = [], 0
    for length, part, n in filters.select("length", "part", F.length("data")).orderBy("length", "part").collect():
        if now and size + n > pass_bytes:
            yield now
            now, size = [], 0
        now.append((length, part))
        size += n
    if now:
        yield now


def held_parts(filters: DataFrame, chosen: list[tuple[int, int]]) -> Broadcast:
    """The chosen parts on every executor: at most pass_bytes."""
    spark = filters.sparkSession
    rows = filters.join(F.broadcast(spark.createDataFrame(chosen, "length int, part int")), ["length", "part"]).select("length", "part", "data")
    return spark.sparkContext.broadcast({(length, part): np.frombuffer(data, np.uint64) for length, part, data in rows.collect()})


def probe(words: DataFrame, held: Broadcast, chosen: list[tuple[int, int]], plan: dict[int, Shard], alphabet: str, params: VariantParams) -> DataFrame:
    """word, edit: what the chosen parts let through. words: word."""
    lengths = sorted({length for length, _ in chosen})
    marks = np.frombuffer(alphabet.encode("latin-1"), np.uint8)

    def passed(hashes: np.ndarray, length: int) -> np.ndarray:
        out, part = np.zeros(len(hashes), bool), _part_of(hashes, plan[length].parts)
        for p in range(plan[length].parts):
            bits = held.value.get((length, p))
            if bits is None:
                continue
            at = np.flatnonzero(part == p) if plan[length].parts > 1 else np.arange(len(hashes))
            want = _bits(hashes[at])
            out[at[(bits[_block_of(hashes[at], len(bits))] & want) == want]] = True
        return np.flatnonzero(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 4096):
            words, edits = [], []
            for at, letters in _same_length(batch.column(0)):
                length = letters.shape[1]
                texts = [w.as_py() for w in batch.column(0).take(pa.array(at))]
                if length - 1 in lengths:
                    for r, k, h in deletions(letters, params.edits):
                        for i in passed(h, length - 1).tolist():
                            w = texts[r[i]]
                            words.append(w)
                            edits.append(w[: k[i]] + w[k[i] + 1 :])
                if length in lengths:
                    for r, k, new, h in replacements(letters, marks, params.edits):
                        for i in passed(h, length).tolist():
                            w = texts[r[i]]
                            words.append(w)
                            edits.append(w[: k[i]] + chr(new[i]) + w[k[i] + 1 :])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(edits, pa.string())], ["word", "edit"])

    return words.filter(F.length("word").isin([*lengths, *(n + 1 for n in lengths)])).select("word").mapInArrow(run, "word string, edit string")


# --- forms and roots -----------------------------------------------------------------------------------------------------


def near_pairs(vocabulary: DataFrame, scratch: Scratch, params: VariantParams = VariantParams()) -> DataFrame:
    """vocabulary: word, n, a written table. Returns word, n, near, near_n: every pair of near words once."""
    sizes = dict(vocabulary.groupBy(F.length("word")).count().collect())
    letters = [r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()]  # at most 90
    plan, pairs = shard_plan(sizes, params), None
    # replacements need words of their own length, deletions a shorter one
    filters = scratch.save(build_filters(vocabulary, plan), "filters")
    dealt = vocabulary.select("word").repartition(max(1, -(-sum(sizes.values()) // params.task_words)), "word")
    other, source = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("near_n")), vocabulary.select("word", "n")
    for k, chosen in enumerate(_passes(filters, params.pass_bytes)):
        held = held_parts(filters, chosen)
        found = probe(dealt, held, chosen, plan, "".join(sorted(letters)), params)
        part = scratch.save(found.join(other, "edit").join(source, "word").select("word", "n", F.col("edit").alias("near"), "near_n"), f"pairs-{k}")
        held.unpersist()
        pairs = part if pairs is None else pairs.union(part)
    return pairs if pairs is not None else vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).filter("false")


def roots(forms: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """forms: word, form. Returns word, root: where following forms ends. Each round doubles the steps; a form occurs `ratio` times as often as its
    word, so chains are short. Only words with a form take part."""
    links = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, rounds + 1):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if links.join(onward, "root", "left_semi").isEmpty():
            return links
        links = scratch.save(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def group_variants(vocabulary: DataFrame, params: VariantParams = VariantParams()) -> DataFrame:
    """vocabulary: word, n (words differ). Returns word, form, root, n, n_near, form_n for every word.

    A word's near words are those one inserted, deleted or replaced letter away. Its form is that of largest n, if that is at least `ratio` times its own.
    """
    scratch = Scratch(vocabulary.sparkSession)
    vocabulary = scratch.save(vocabulary, "vocabulary")
    pairs = near_pairs(vocabulary, scratch, params)
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = vocabulary.join(near, "word", "left")
    judged = judged.withColumn("best", F.when(F.col("best.near_n") >= params.ratio * F.col("n"), F.col("best")))
    judged = scratch.save(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")), "judged")
    ends = roots(judged.filter(F.col("form").isNotNull()), scratch)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
