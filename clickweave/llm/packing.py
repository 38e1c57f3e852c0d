"""Best-fit packing of token pieces into sequences by the linear grouping scheme (de la Vega and Lueker).

Tasks tokenise whole texts and cut documents longer than a sequence; only piece lengths are shuffled. Pieces are dealt to
blocks of about `block_pieces` by hash, one task packs a block, and blocks are as many as the input asks for: a block wastes
part of its last few sequences only. Within a block:

1. full pieces are sequences of their own; others above `small` tokens are large;
2. large pieces, longest first, form `groups` groups of equal numbers, whose lengths are rounded up to their longest;
3. how often to use each configuration of the few rounded lengths is optimised as a cutting-stock linear program by
   column generation (simplex steps; new configurations from an unbounded knapsack), and rounded down;
4. actual documents take their places: for each place of a configuration the longest that is left and isn't above the
   rounded length, and for its last place the longest that the actual lengths before it leave room for; what rounding
   down left over, longest first, and then the small pieces go where they fit best, opening a sequence only where none has room;
5. sequences that the rounding left loose are emptied and their pieces, longest first, go where they fit best, if that
   needs fewer sequences.

Ids are those of `tokenizers` for the named vocabulary. Its default file also comes as ranks, which `tiktoken` encodes to the same ids about four
times as fast, so that is what tasks use; tests compare the two on awkward and on random texts. Other vocabulary files are encoded by `tokenizers`.

Edge cases: null and empty texts are the closing token alone; texts of any length are taken whole; repeated rows are packed each; ties: pieces of
equal length are taken by their place among the block's pieces;
an empty table gives an empty result; further columns don't matter and aren't returned.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textnum import few_rows, give_back


@dataclass(frozen=True)
class PackParams:
    """length: tokens of a sequence; end: the token that closes a document; vocabulary: a tokenizers JSON file, found by that name in tasks
    (default: public_tokenizers' byte_bpe_50k.json); small: pieces up to so many tokens are left to the best fit; loose: sequences with so much room are packed again."""

    length: int = 2048
    end: int = 0
    vocabulary: str | None = None
    small: int = 900
    groups: int = 40
    loose: int = 8
    block_pieces: int = 1 << 15


#: The pattern that byte-level BPE of this family splits text by, before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str | None):
    """A function from text to ids, equal to tokenizers' encode(text, add_special_tokens=False).ids.

    The default vocabulary also comes as ranks, which tiktoken encodes four times as fast to the same ids (a test compares
    them); its one special token is recognised in texts as tokenizers does. Other vocabularies are encoded by tokenizers.
    """
    if vocabulary is None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = tiktoken.Encoding("byte_bpe_50k", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        return lambda text: made.encode(text, allowed_special="all", disallowed_special=()) if "<|endoftext|>" in text else made.encode_ordinary(text)
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary)
    return lambda text: made.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def pieces(batches):
        encode = encoder(params.vocabulary)
        for batch in few_rows(batches):
            rows, docs_of, number, starts, lengths, sums = batch.column("doc_id"), [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), params.end], "<u4")
                first = len(ids) % params.length or params.length
                cuts = [0, *range(first, len(ids) + 1, params.length)]
                for k in range(len(cuts) - 1):
                    docs_of.append(row)
                    number.append(k)
                    starts.append(cuts[k])
                    lengths.append(cuts[k + 1] - cuts[k])
                    sums.append(zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [rows.take(pa.array(docs_of, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, length: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often to use each, for the fewest sequences that meet the demand."""
    k = len(sizes)
    basis = np.diag((length // sizes).astype(float))
    use = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(length + 1), np.full(length + 1, -1)
        for room in range(int(sizes.min()), length + 1):
            fits = np.flatnonzero(sizes <= room)
            gain = best[room - sizes[fits]] + price[fits]
            at = int(gain.argmax())
            if gain[at] > best[room - 1] + 1e-12:
                best[room], pick[room] = gain[at], fits[at]
            else:
                best[room] = best[room - 1]
        if best[length] <= 1 + 1e-6:
            break
        column, room = np.zeros(k), length
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= int(sizes[pick[room]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        use = np.maximum(use - step * ratio[leave], 0)
        use[leave] = ratio[leave]
        basis[:, leave] = column
    return [(basis[:, j].astype(int), float(use[j])) for j in range(k)]


class _Sequences:
    """Best fit: a piece goes to a sequence with the least room that holds it."""

    def __init__(self, size: int):
        self.size, self.pieces = size, []
        self.room: list[list[int]] = [[] for _ in range(size + 1)]
        self.some = 0  # bit r: a sequence has r tokens of room

    def open(self, pieces: list[int], used: int) -> None:
        self._offer(len(self.pieces), self.size - used)
        self.pieces.append(pieces)

    def _offer(self, at: int, room: int) -> None:
        self.room[room].append(at)
        self.some |= 1 << room

    def fit(self, piece: int, need: int) -> None:
        if not (fits := self.some >> need):
            return self.open([piece], need)
        room = need + (fits & -fits).bit_length() - 1
        at = self.room[room].pop()
        if not self.room[room]:
            self.some &= ~(1 << room)
        self.pieces[at].append(piece)
        self._offer(at, room - need)


def pack(lengths: np.ndarray, params: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece."""
    size, need = params.length, lengths.tolist()
    rest = np.flatnonzero(lengths < size)
    rest = rest[np.lexsort((rest, -lengths[rest]))]  # longest first, ties by place
    large, made = rest[lengths[rest] > params.small], _Sequences(size)
    placed: set[int] = set()
    if len(large):
        demand: dict[int, int] = {}
        for g in np.array_split(large, min(params.groups, len(large))):
            demand[need[g[0]]] = demand.get(need[g[0]], 0) + len(g)
        sizes = np.array(sorted(demand, reverse=True))
        left: list[list[int]] = [[] for _ in range(size)]
        for p in large.tolist()[::-1]:
            left[need[p]].append(p)
        some = sum(1 << r for r, pieces in enumerate(left) if pieces)  # bit r: a large piece of r tokens is left
        for config, times in configurations(sizes, np.array([demand[int(s)] for s in sizes], float), size):
            places = np.repeat(sizes, config).tolist()
            for _ in range(int(times + 1e-6)):
                taken, room = [], size
                for k, place in enumerate(places):
                    fits = some & ((2 << min(room, place if k + 1 < len(places) else room)) - 1)
                    if not fits:
                        break
                    r = fits.bit_length() - 1
                    taken.append(left[r].pop())
                    if not left[r]:
                        some ^= 1 << r
                    room -= r
                if taken:
                    made.open(taken, size - room)
                    placed.update(taken)
    for piece in rest.tolist():
        if piece not in placed:
            made.fit(piece, need[piece])
    rooms = [size - sum(need[p] for p in s) for s in made.pieces]
    again = _Sequences(size)
    for piece in sorted((p for s, room in zip(made.pieces, rooms, strict=True) if room >= params.loose for p in s), key=lambda p: (-need[p], p)):
        again.fit(piece, need[piece])
    tight = [s for s, room in zip(made.pieces, rooms, strict=True) if room < params.loose]
    sequences = min(tight + again.pieces, made.pieces, key=len)
    sequence, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, pieces in enumerate([[p] for p in np.flatnonzero(lengths >= size).tolist()] + sequences):
        at = 0
        for p in pieces:
            sequence[p], offset[p] = k, at
            at += need[p]
    return sequence, offset


def pack_documents(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.save(token_pieces(docs, params), "pieces")
    blocks = max(1, -(-pieces.count() // params.block_pieces))
    at = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")

    def block(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack(group["length"].to_numpy(), params)
        out = group.drop_columns(["_block"]).append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 40)))
        give_back()
        return out.append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.withColumn("_block", at).groupBy("_block").applyInArrow(block, schema)
