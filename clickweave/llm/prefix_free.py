"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

Only the first `length` bytes (50) of suffixes matter, so the corpus order is made no deeper than that:

1. parse: a rolling hash of `gram` bytes gives each window of `length` bytes its trigger, the least hash in it. A phrase is a stretch of
   windows in a row with one trigger, with the length - 1 bytes that the last of them reaches into the next phrases. Where a window is filed depends on
   its own bytes alone, so equal windows have equal triggers wherever they stand.
2. dictionary: phrases are exchanged as (trigger, hash of the phrase, document, place), packed by trigger. Of equal phrases that of the least
   document is the dictionary's; every other occurrence is covered whole and is settled here. This is what makes repetitive text cheap.
3. suffixes: dictionary phrases that share their trigger with another phrase, and only they, are read again; their suffixes are sorted by their
   first `length` bytes. Neighbours that agree in them are one class, and each suffix of a later document than the least of its class is covered.
4. corpus: what steps 2 and 3 cover is merged by document and taken out of the texts.

Hot triggers: every block of documents settles its equal phrases before anything is exchanged, so that a phrase is sent once a block at most.
A trigger with many different phrases in a block is dealt over tasks by phrase, and its suffixes are exchanged one by one by their hashes (128 bits), each block's equal ones as one,
instead of being sorted in one group.

Edge cases: null texts are empty; texts under `length` bytes keep all; bytes, not characters, are removed; texts of any length are worked on in pieces;
a null doc_id comes after all others; rows that share a doc_id, and rows without one, don't cover each other; an empty table gives an empty result; further
columns don't matter and aren't returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textnum import _VALUES, _Tables, few_rows, mix, text_slices

_M = np.uint64
_C = _M(0x9E3779B97F4A7C15)
_LOW = _M((1 << 40) - 1)
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class ParseParams:
    """length: of the strings; gram: of triggers; bucket_bytes: text for each exchange group; block_bytes: text that is settled before the exchange; hot: phrases of
    a trigger in a block from which on it is dealt by phrase; group: the same in an exchange group; piece: bytes of a long text worked on at once."""

    length: int = 50
    gram: int = 20
    bucket_bytes: int = 16 << 20
    block_bytes: int = 8 << 20
    hot: int = 16
    group: int = 64
    piece: int = 2 << 20

    def __post_init__(self):
        if not 8 <= self.gram <= self.length:
            raise ValueError("8 <= gram <= length")


# --- parsing -------------------------------------------------------------------------------------------------------------


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` values in a row."""
    done = 1
    while 2 * done <= width:
        h, done = np.minimum(h[:-done], h[done:]), 2 * done
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _Tables.get(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def phrases(data: np.ndarray, offsets: np.ndarray, params: ParseParams) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: first window, number of windows, trigger and hash of every phrase."""
    n = len(data) - params.length + 1
    if n < 1:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    sums, down = _sums(data)
    rolling = mix((sums[params.gram :] - sums[: -params.gram]) * down[: len(data) - params.gram + 1])
    trigger = _least(rolling, params.length - params.gram + 1)
    edge = np.zeros(n + 1, np.int64)  # windows that cross the end of a text
    inner = offsets[1:-1]
    np.add.at(edge, np.clip(inner - params.length + 1, 0, n), 1)
    np.add.at(edge, np.clip(inner, 0, n), -1)
    whole = np.cumsum(edge[:-1]) == 0
    new = np.ones(n, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | ~whole[:-1] | ~whole[1:]
    starts = np.flatnonzero(new)
    windows = np.diff(np.append(starts, n))
    held = whole[starts]
    starts, windows = starts[held], windows[held]
    ends = starts + windows + params.length - 1
    return starts, windows, mix(trigger[starts] * _C), mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C)


def _pieces(batch: pa.RecordBatch, params: ParseParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch, place of the first byte in their texts, bytes, offsets; long texts in pieces that share length - 1 bytes."""
    for i, j, data, offsets in text_slices(batch, "text", params.piece):
        if len(data) <= 2 * params.piece:
            yield np.arange(i, j), np.zeros(j - i, np.int64), data, offsets
        else:
            for at in range(0, len(data), params.piece):
                part = data[at : at + params.piece + params.length - 1]
                yield np.array([i]), np.array([at]), part, np.array([0, len(part)])


# --- packed arrays ---------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of arrays of one length, so that bytes that seldom change lie together."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def unpack(packed: list[bytes], *types: str) -> list[np.ndarray]:
    """Arrays as packed, one after the other; types as of numpy, or a number of low bytes of an unsigned number."""
    widths = [int(t) if t.isdigit() else np.dtype(t).itemsize for t in types]
    out = [[] for _ in types]
    for data in packed:
        planes, n, at = np.frombuffer(data, np.uint8), len(data) // sum(widths), 0
        for k, (t, w) in enumerate(zip(types, widths, strict=True)):
            wide = np.zeros((n, 8 if t.isdigit() else w), np.uint8)
            wide[:, :w] = planes[at : at + w * n].reshape(w, n).T
            out[k].append(wide.reshape(-1).view(np.uint64 if t.isdigit() else t))
            at += w * n
    return [np.concatenate(a) if a else np.empty(0, np.uint64 if t.isdigit() else t) for a, t in zip(out, types, strict=True)]


def _low(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every key with its places, which keep their order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    values, first = np.unique(keys[order], return_index=True)
    for value, at in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        yield value, at


def classes(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal keys one number (0, 1, ... in their order) and whether a row's document is later than the least of its class."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(doc), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    number = np.cumsum(new) - 1
    later = doc[order] > doc[order][new][number]
    out, late = np.empty(len(doc), np.int64), np.empty(len(doc), bool)
    out[order], late[order] = number, later
    return out, late


def merge_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row in order, those that meet or overlap as one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    # a running maximum of ends within each row: rows are lifted above each other
    lift = (np.cumsum(fresh) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    fresh[1:] |= start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return row[first], start[first], np.maximum.reduceat(reach, first) - lift[first]


def _home(row: np.ndarray, homes: int) -> np.ndarray:
    return (mix(row.astype(np.uint64) * _C) % _M(homes)).astype(np.int64)


def _rows(columns: list[str], rows: list[tuple]) -> pa.Table:
    types = {"data": pa.binary(), "row": pa.int64()}
    return pa.table({c: pa.array([r[k] for r in rows], types.get(c, pa.int32())) for k, c in enumerate(columns)})


def _span_rows(row: np.ndarray, start: np.ndarray, end: np.ndarray, homes: int) -> list[tuple[int, bytes]]:
    row, start, end = merge_spans(row, start, end)
    return [(home, pack(row[at], start[at], end[at])) for home, at in _groups(_home(row, homes))]


_SPAN = ("<i8", "<i8", "<i8")
_PHRASE = ("5", "<u8", "<i8", "<i8", "<u4", "<u4")
_CANDIDATE = ("<u8", "<i8", "<i8", "<u4", "<u4", "<u1")
_WANTED = np.dtype([("key", "<u8"), ("start", "<u4"), ("windows", "<u4"), ("hot", "<u1")])


# --- the steps ---------------------------------------------------------------------------------------------------------------


def _parse(docs: DataFrame, buckets: int, params: ParseParams) -> DataFrame:
    """docs: row, doc, text. Returns bucket, part, data: packed phrases of triggers (bucket from 0 up, part above 0 where the trigger is hot), and
    what is covered by documents of the same block (bucket -1 - home)."""

    def flush(block: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        if not block:
            return None
        row, doc, start, windows, trigger, phrase = (np.concatenate(a) for a in zip(*block, strict=True))
        bucket, trigger = ((trigger >> _M(40)) % _M(buckets)).astype(np.int64), trigger & _LOW
        number, later = classes([trigger, phrase], doc)
        end = start + windows + params.length - 1
        out = [(-1 - home, 0, data) for home, data in _span_rows(row[later], start[later], end[later], buckets)]
        _, one = np.unique(number, return_index=True)
        triggers, many = np.unique(trigger[one], return_counts=True)
        hot = np.isin(trigger, triggers[many >= params.hot])
        part = np.where(hot, 1 + (phrase % _M(buckets)).astype(np.int64), 0)
        for key, at in _groups(np.where(later, -1, bucket * (buckets + 1) + part)):
            if key >= 0:
                out.append((key // (buckets + 1), key % (buckets + 1), pack(_low(trigger[at], 5), phrase[at], doc[at], row[at], start[at].astype("<u4"), windows[at].astype("<u4"))))
        # the bucket learns of its hot triggers by a mark, a phrase without windows
        marks, first = np.unique(np.where(hot, trigger, _LOW + _M(1)), return_index=True)
        first = first[marks <= _LOW]
        for key, at in _groups(bucket[first]):
            at, zero = first[at], np.zeros(len(at), "<u4")
            out.append((key, 0, pack(_low(trigger[at], 5), zero.astype("<u8"), doc[at], row[at], zero, zero)))
        return _rows(["bucket", "part", "data"], out).to_batches()[0]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in few_rows(batches):
            ids, docs_ = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, base, data, offsets in _pieces(batch, params):
                starts, windows, trigger, phrase = phrases(data, offsets, params)
                if len(starts):
                    at = np.searchsorted(offsets, starts, "right") - 1
                    block.append((ids[rows[at]], docs_[rows[at]], starts - offsets[at] + base[at], windows, trigger, phrase))
                size += len(data)
                if size >= params.block_bytes:
                    if made := flush(block):
                        yield made
                    block, size = [], 0
        if made := flush(block):
            yield made

    return docs.select("row", "doc", "text").mapInArrow(parse, "bucket int, part int, data binary")


def _dictionary(parsed: DataFrame, buckets: int, params: ParseParams) -> DataFrame:
    """Returns kind, home, data: covered spans (0) and phrases whose suffixes must be compared (1)."""

    def settle(group: pa.Table) -> pa.Table:
        bucket, part, packed = group["bucket"][0].as_py(), group["part"][0].as_py(), group["data"].to_pylist()
        if bucket < 0:
            return _rows(["kind", "home", "data"], [(0, home, data) for home, data in _span_rows(*unpack(packed, *_SPAN), buckets)])
        trigger, phrase, doc, row, start, windows = unpack(packed, *_PHRASE)
        start, windows = start.astype(np.int64), windows.astype(np.int64)
        mark = windows == 0
        marked = np.unique(trigger[mark])
        trigger, phrase, doc, row, start, windows = (a[~mark] for a in (trigger, phrase, doc, row, start, windows))
        number, later = classes([trigger, phrase], doc)
        out = [(0, home, data) for home, data in _span_rows(row[later], start[later], (start + windows + params.length - 1)[later], buckets)]
        _, one = np.unique(number, return_index=True)
        triggers, inverse, many = np.unique(trigger[one], return_inverse=True, return_counts=True)
        least, most = np.full(len(triggers), _LAST), np.full(len(triggers), -_LAST - 1)
        np.minimum.at(least, inverse, doc[one])
        np.maximum.at(most, inverse, doc[one])
        long = np.unique(trigger[windows > 32 * params.length])  # of one repeated pattern: few different suffixes
        hot = np.isin(triggers, marked) | (part > 0) | (many > params.group) | np.isin(triggers, long)
        wanted = hot | ((many > 1) & (most > least))
        at = np.searchsorted(triggers, trigger) if len(triggers) else np.empty(0, np.int64)
        chosen = np.flatnonzero(~later & wanted[at]) if len(at) else at
        key = (_M(bucket) << _M(40)) | trigger
        for home, k in _groups(_home(row[chosen], buckets)):
            k = chosen[k]
            out.append((1, home, pack(key[k], doc[k], row[k], start[k].astype("<u4"), windows[k].astype("<u4"), hot[at[k]].astype("<u1"))))
        return _rows(["kind", "home", "data"], out)

    return parsed.groupBy("bucket", "part").applyInArrow(settle, "kind int, home int, data binary")


def _by_row(phrases_: DataFrame) -> DataFrame:
    """Returns row, data: the phrases of each row to be compared, packed as _WANTED."""

    def regroup(group: pa.Table) -> pa.Table:
        key, doc, row, start, windows, hot = unpack(group["data"].to_pylist(), *_CANDIDATE)
        order = np.argsort(row, kind="stable")
        held = np.empty(len(row), _WANTED)
        held["key"], held["start"], held["windows"], held["hot"] = key[order], start[order], windows[order], hot[order]
        rows, first = np.unique(row[order], return_index=True)
        return _rows(["row", "data"], [(r, part.tobytes()) for r, part in zip(rows.tolist(), np.split(held, first[1:]), strict=True)] if len(rows) else [])

    return phrases_.groupBy("home").applyInArrow(regroup, "row long, data binary")


def _big_endian(data: np.ndarray) -> np.ndarray:
    """At every place the next eight bytes as a number that sorts as they do."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << _M(8)) | wide[k : k + len(data)].astype(np.uint64)
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches' numbers and the places in them, one after the other."""
    which = np.repeat(np.arange(len(start)), size)
    return which, start[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def _suffixes(found: DataFrame, buckets: int, params: ParseParams) -> DataFrame:
    """found: row, doc, text, data (phrases of the row). Returns home, data: the covered spans."""
    length, places = params.length, [*range(0, params.length - 8, 8), params.length - 8]

    def exchange(data: np.ndarray, at: np.ndarray, doc: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> list[tuple[int, bytes]]:
        """Phrases that begin at `at` in the data: cold ones whole by trigger, of hot ones the suffixes by their hashes."""
        out, key, start, windows = [], wanted["key"], wanted["start"], wanted["windows"].astype(np.int64)
        cold, hot = np.flatnonzero(wanted["hot"] == 0), np.flatnonzero(wanted["hot"])
        for bucket, k in _groups(((mix(key[cold]) >> _M(8)) % _M(buckets)).astype(np.int64)):
            k = cold[k]
            head = pack(key[k], doc[k], row[k], start[k], windows[k].astype("<u4"))
            out.append((bucket, len(k).to_bytes(4, "little") + head + data[_spread(at[k], windows[k] + length - 1)[1]].tobytes()))
        if len(hot):
            _, bytes_at = _spread(at[hot], windows[hot] + length - 1)
            part = data[bytes_at]
            sums, down = _sums(part)
            sizes = windows[hot] + length - 1
            which, s = _spread(np.cumsum(sizes) - sizes, windows[hot])
            one, words, two = mix((sums[s + length] - sums[s]) * down[s]), _big_endian(part), np.zeros(len(s), np.uint64)
            for p in places:
                two = mix(two * _C + words[s + p])
            place = start[hot][which].astype(np.int64) + s - (np.cumsum(sizes) - sizes)[which]
            doc, row = doc[hot][which], row[hot][which]
            _, later = classes([one, two], doc)
            out += [(-1 - home, spans) for home, spans in _span_rows(row[later], place[later], place[later] + length, buckets)]
            for bucket, k in _groups(np.where(later, -1, ((one >> _M(8)) % _M(buckets)).astype(np.int64))):
                if bucket >= 0:
                    out.append((buckets + bucket, pack(one[k], two[k], doc[k], row[k], place[k].astype("<u4"))))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows, docs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            packed = [d.as_py() for d in batch.column(3)]
            for i, j, data, offsets in text_slices(batch, "text", params.block_bytes):
                wanted = np.frombuffer(b"".join(packed[i:j]), _WANTED)
                text = np.repeat(np.arange(i, j), [len(p) // _WANTED.itemsize for p in packed[i:j]])
                if (wanted["windows"] > params.piece).any():  # phrases of one repeated pattern, in pieces
                    pieces = -(-wanted["windows"].astype(np.int64) // params.piece)
                    which, k = _spread(np.zeros(len(wanted), np.int64), pieces)
                    wanted, text = wanted[which].copy(), text[which]
                    wanted["windows"] = np.minimum(params.piece, wanted["windows"] - k * params.piece)
                    wanted["start"] += (k * params.piece).astype("<u4")
                at = offsets[text - i] + wanted["start"]
                part = np.cumsum(wanted["windows"].astype(np.int64)) // params.piece
                for lot in np.split(np.arange(len(wanted)), np.flatnonzero(np.diff(part)) + 1):
                    if len(lot) and (out := exchange(data, at[lot], docs[text[lot]], rows[text[lot]], wanted[lot])):
                        yield _rows(["bucket", "data"], out).to_batches()[0]

    def order(group: pa.Table) -> pa.Table:
        bucket, packed = group["bucket"][0].as_py(), group["data"].to_pylist()
        if bucket < 0:
            return _rows(["home", "data"], _span_rows(*unpack(packed, *_SPAN), buckets))
        if bucket >= buckets:
            one, two, doc, row, place = unpack(packed, "<u8", "<u8", "<i8", "<i8", "<u4")
            _, later = classes([one, two], doc)
            place = place.astype(np.int64)
            return _rows(["home", "data"], _span_rows(row[later], place[later], place[later] + length, buckets))
        heads, texts = [], []
        for data in packed:
            to = 4 + int.from_bytes(data[:4], "little") * 32
            heads.append(data[4:to])
            texts.append(data[to:])
        key, doc, row, start, windows = unpack(heads, "<u8", "<i8", "<i8", "<u4", "<u4")
        start, windows = start.astype(np.int64), windows.astype(np.int64)
        words = _big_endian(np.frombuffer(b"".join(texts), np.uint8))
        sizes = windows + length - 1
        which, at = _spread(np.cumsum(sizes) - sizes, windows)
        # the suffix array of these phrases to `length` bytes: sorted by trigger, then by the bytes themselves
        _, later = classes([key[which], *(words[at + p] for p in places)], doc[which])
        which, at = which[later], at[later]
        place = start[which] + at - (np.cumsum(sizes) - sizes)[which]
        return _rows(["home", "data"], _span_rows(row[which], place, place + length, buckets))

    exchanged = found.select("row", "doc", "text", "data").mapInArrow(read, "bucket int, data binary")
    return exchanged.groupBy("bucket").applyInArrow(order, "home int, data binary")


def _join(docs: DataFrame, packed: DataFrame, how: str) -> DataFrame:
    """Joins rows with their packed arrays, which grow with the texts: always a shuffle join."""
    return docs.join(packed.hint("merge"), "row", how)


def covered_spans(docs: DataFrame, scratch: Scratch, params: ParseParams = ParseParams()) -> DataFrame:
    """docs: row (unique), doc (what orders them; none null), text. Returns row, data: the spans of each row that are covered, packed."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // params.bucket_bytes))
    settled = scratch.save(_dictionary(_parse(docs, buckets, params), buckets, params), "settled")
    wanted = scratch.save(_by_row(settled.filter("kind = 1").select("home", "data")), "wanted")
    more = scratch.save(_suffixes(_join(docs, wanted, "inner"), buckets, params), "more")

    def merge(group: pa.Table) -> pa.Table:
        row, start, end = merge_spans(*unpack(group["data"].to_pylist(), *_SPAN))
        return _rows(["row", "data"], [(r, pack(row[at], start[at], end[at])) for r, at in _groups(row)])

    spans = scratch.save(settled.filter("kind = 0").select("home", "data").union(more).groupBy("home").applyInArrow(merge, "row long, data binary"), "spans")
    scratch.drop("settled", "wanted", "more")
    return spans


def remove_repeats(docs: DataFrame, params: ParseParams = ParseParams(), texts: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; texts adds kept (binary) and the spans themselves."""
    scratch, doc_id = Scratch(docs.sparkSession), F.col("doc_id").cast("long")
    unique = docs.groupBy(doc_id.alias("id")).count().filter("count > 1 OR id IS NULL").isEmpty()
    rows = docs.select("doc_id", F.coalesce(doc_id, F.lit(_LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ids that repeat or are missing don't tell rows apart: then every row gets a number of its own
    rows = rows.withColumn("row", F.col("doc")) if unique else scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    spans = covered_spans(rows.select("row", "doc", "text"), scratch, params)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,end:long>>" if texts else "")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out = []
            for text, packed in zip(batch.column(1), batch.column(2), strict=True):
                data = kept = text.as_py().encode("utf-8", "surrogatepass")
                start = end = np.empty(0, np.int64)
                if packed.is_valid:
                    _, start, end = unpack([packed.as_py()], *_SPAN)
                    kept = b"".join(data[s:e] for s, e in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
                row = [len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest()]
                out.append(row + ([kept, [dict(start=s, end=e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]] if texts else []))
            types = [pa.int64()] * 3 + [pa.string()] + ([pa.binary(), span_type] if texts else [])
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept", "spans"] if texts else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], ["doc_id", *names])

    return _join(rows, spans, "left").select("doc_id", "text", "data").mapInArrow(cut, schema)
