"""Exact Jaccard self-join on word shingles by a token-group matrix, and the classes of linked documents.

1. Equal sets collapse into one class (128-bit digest of the sorted shingle hashes).
2. With tokens in any one order (here: those first whose hash bucket is rarest), the first n - ceil(t n) + l tokens of two sets
   of similarity t or more have at least l in common, l growing slowly with n (`least_shared`). Sets whose first
   tokens have fewer in common with all others together link with nothing and are set aside; the rest is a small share of ordinary text.
3. The others are partitioned into groups of similar sets: those whose most common shared token and whose size (to a
   factor of t) agree, cut in blocks of bounded documents and tokens. Two tables are stored for the groups: the token-group
   matrix (token, group) of these first tokens, and each group's union of all tokens.
4. A query is compared with groups, not with sets. Its overlap with the matrix, by a join and a grouped count, gives the
   pairs of query and group that may hold a link (`candidates`); for these its overlap with the group's whole union bounds
   the overlap with every member (`bound`). Only groups that still qualify are opened: their members meet the query, and intersections
   are counted exactly. What leaves a task is a spanning forest of the links found and each set's number of links.

Whole texts are read three times: twice without a shuffle, and once more for the sets that are candidates, whose texts meet them by a join (a
broadcast one while they are few). The first tokens are shuffled, not all tokens; all tokens move only for candidates. Frequent tokens come last in the order, and a token that many sets do share is counted before the shuffle and
joined by an equi-join that AQE may split. What grows faster than the input is a family of distinct near copies: its
blocks meet pairwise, as its links must all be counted.

Shingle hashes have 64 bits: two different shingles of a compared pair count as one with probability below n**2 / 2**64.
The unions hold 32 bits of them, which can only open a group too many.

Edge cases: null or empty text and text without words has n_shingles 0, no links and its own id as component; texts of
any length are taken whole; repeated rows and copies are one class whose rows link with each other; ties: a component is
named by its smallest doc_id, tokens of equal counts are ordered by hash, and which group a set falls in changes no result; rows with a null
doc_id are kept with a null component if nothing with an id equals them; an empty table gives an empty result; further
columns don't matter and aren't returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, add_pieces, join_on_key, vector_pieces
from .components import components
from .textnum import few_rows, shingles, text_slices, word_hashes


@dataclass(frozen=True)
class JaccardParams:
    """words per shingle; links reach num / den (a fifth at least); bits: buckets of the token order; extra: one more common token is asked for
    (and one more looked at) for so many tokens of a set; rounds: how often sets that share too few tokens are set aside;
    a block holds about block_docs sets or block_tokens tokens."""

    words: int = 5
    num: int = 80
    den: int = 100
    bits: int = 20
    extra: int = 32
    rounds: int = 2
    block_docs: int = 256
    block_tokens: int = 1 << 16

    def __post_init__(self):
        if self.num * 5 < self.den or self.num > self.den:
            raise ValueError("the similarity must lie in 0.2 to 1")


_PIECES = 32


def _sets(batch: pa.RecordBatch, params: JaccardParams):
    """Row number and sorted distinct shingle hashes of every row that has words."""
    for i, j, data, offsets in text_slices(batch, "text"):
        words, at = word_hashes(data, offsets)
        for k in range(j - i):
            yield i + k, np.unique(shingles(words[at[k] : at[k + 1]], params.words))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def shingle_sets(texts: DataFrame, params: JaccardParams) -> DataFrame:
    """doc_id, n_shingles, set_id (null without words) for every row, piece null; and, with these null, pieces of a count of token buckets."""
    shift, size = np.uint64(64 - params.bits), 1 << params.bits

    def describe(batches):
        sums = np.zeros(size, np.int64)
        for batch in few_rows(batches):
            n, ids = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, tokens in _sets(batch, params):
                if len(tokens):
                    n[i], ids[i] = len(tokens), _digest(tokens)
                    np.add.at(sums, (tokens >> shift).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        for k, data in vector_pieces(sums, _PIECES):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names)

    names = ["doc_id", "n_shingles", "set_id", "piece", "data"]
    return texts.mapInArrow(describe, "doc_id long, n_shingles long, set_id binary, piece int, data binary")


def first_tokens(texts: DataFrame, order: np.ndarray, params: JaccardParams) -> DataFrame:
    """doc_id, set_id, prefix: the tokens of every row that come first in the order (counts of token buckets, then the hash)."""
    shift = np.uint64(64 - params.bits)
    held = texts.sparkSession.sparkContext.broadcast(np.minimum(order, (1 << 32) - 1).astype(np.uint32))

    def prefix(batches):
        for batch in few_rows(batches):
            ids, out = [None] * batch.num_rows, [None] * batch.num_rows
            for i, tokens in _sets(batch, params):
                if len(tokens):
                    n, ids[i] = len(tokens), _digest(tokens)
                    most = n + params.num * n // -params.den + min(1 + n // params.extra, -(-params.num * n // params.den))
                    counts = held.value[(tokens >> shift).astype(np.int64)]
                    out[i] = tokens[np.argsort(counts, kind="stable")[:most]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "set_id", "prefix"])

    return texts.mapInArrow(prefix, "doc_id long, set_id binary, prefix array<long>")


def _least(n: Column, params: JaccardParams) -> Column:
    return F.least(1 + F.floor(n / params.extra), F.ceil(params.num * n / params.den))


def least_shared(n: Column, lo: Column, hi: Column, params: JaccardParams) -> Column:
    """How many first tokens a set of n tokens has in common, at least, with a linked one of lo to hi tokens; null if sizes exclude a link.

    Linked sets of n and s tokens have a = ceil(num (n + s) / (num + den)) in common. The last n - p of a set's tokens hold at
    most so many of these; so the first p of it hold a - (n - p), and what the first ones of that set hold which ends earlier in the order, the other's
    first ones hold, too. With p = n - ceil(t n) + l(n) that is the smaller of a - ceil(t n) + l(n) and a - ceil(t s) + l(s): the
    first grows with s, the second lies above a linear function of s less 2, which is least at an end.
    """
    t, share = params.num / params.den, params.num / (params.num + params.den)
    lo, hi = F.greatest(lo, F.ceil(params.num * n / params.den)), F.least(hi, F.floor(params.den * n / params.num))
    own = F.ceil(params.num * (n + lo) / (params.num + params.den)) - F.ceil(params.num * n / params.den) + _least(n, params)
    line = lambda s: share * (n + s) - t * s + s / params.extra - 1
    need = F.greatest(F.least(_least(n, params), _least(lo, params)), F.least(own, F.ceil(F.least(line(lo), line(hi)))))
    return F.when(lo <= hi, need)


def shared_cells(prefixes: DataFrame, scratch: Scratch, params: JaccardParams) -> DataFrame:
    """prefixes: node, n, prefix. Returns token, node, holders (nodes that have the token) of the sets that share enough first tokens with others.

    The two holders of a token come out of its grouped minimum and maximum; only tokens of three or more are joined again.
    """
    cells, sizes = prefixes.select("node", F.explode("prefix").alias("token")), prefixes.select("node", "n")
    for k in range(params.rounds + 1):
        if k:
            shared = cells.groupBy("node").agg(F.count("*").alias("shared")).join(sizes, "node")
            nodes = scratch.save(shared.filter(F.col("shared") >= least_shared(F.col("n"), F.lit(0), F.lit(1 << 62), params)).select("node"), "enough")
            cells = join_on_key(cells, nodes, "node", "left_semi")
        holders = cells.groupBy("token").agg(F.count("*").alias("holders"), F.min("node").alias("first"), F.max("node").alias("last"))
        holders = scratch.save(holders.filter("first < last"), "holders")
        two = holders.filter("holders = 2").select("token", F.explode(F.array("first", "last")).alias("node"), "holders")
        more = join_on_key(cells.select("token", "node"), holders.filter("holders > 2").select("token", "holders"), "token")
        new = scratch.save(two.unionByName(more), f"cells-{k}")
        scratch.drop(f"cells-{k - 1}")
        cells = new
    scratch.drop("enough", "holders")
    return cells


def group_documents(cells: DataFrame, sizes: DataFrame, params: JaccardParams) -> DataFrame:
    """node, n, gid: sets by their most common shared token and their size to a factor of the similarity, large groups cut in blocks by hash."""
    keyed = cells.groupBy("node").agg(F.max(F.struct("holders", "token"))["token"].alias("key")).join(sizes, "node")
    keyed = keyed.withColumn("band", F.floor(F.log("n") / -float(np.log(min(params.num / params.den, 0.99)))))
    blocks = keyed.groupBy("key", "band").agg(F.greatest(F.ceil(F.count("*") / params.block_docs), F.ceil(F.sum("n") / params.block_tokens)).alias("blocks")).filter("blocks > 1")
    gid = F.xxhash64("key", "band", F.pmod(F.xxhash64(F.lit(3), "node"), F.coalesce("blocks", F.lit(1))))
    return keyed.join(blocks, ["key", "band"], "left").select("node", "n", gid.alias("gid"))


def token_group_matrix(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """token, gid, holders (members that have the token) and, of the whole group, lo and hi (sizes of its sets)."""
    sizes = groups.groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    cells = join_on_key(cells.select("token", "node"), groups.select("node", "gid"), "node")
    return cells.groupBy("token", "gid").agg(F.count("*").alias("holders")).join(sizes, "gid")


def candidates(cells: DataFrame, groups: DataFrame, matrix: DataFrame, params: JaccardParams) -> DataFrame:
    """node, own, gid: queries and the groups whose row of the matrix they share enough tokens with; own <= gid, their own group.

    Each two groups meet in one direction; within its own group a query's tokens count if another member has them.
    """
    queries = join_on_key(cells.select("token", "node"), groups.select("node", "n", F.col("gid").alias("own")), "node")
    need = least_shared(F.col("n"), F.col("lo"), F.col("hi"), params)
    met = queries.join(matrix, "token").filter(((F.col("own") < F.col("gid")) | ((F.col("own") == F.col("gid")) & (F.col("holders") > 1))) & need.isNotNull())
    return met.groupBy("node", "own", "gid", "n", "lo", "hi").agg(F.count("*").alias("shared")).filter(F.col("shared") >= need).select("node", "own", "gid")


def unions(blocks: DataFrame) -> DataFrame:
    """blocks: gid, members. Returns gid, least (size of the smallest set), all (the union of the members' tokens) and twice (those of two members or more)."""

    def unite(batches):
        for batch in few_rows(batches, 64):
            least, every, twice = [], [], []
            for members in batch.column("members"):
                sets = [np.frombuffer(m, np.uint64) >> np.uint64(32) for m in {(m["node"], m["set_id"]): m["tokens"] for m in members.as_py()}.values()]
                least.append(min(map(len, sets)))
                tokens, n = np.unique(np.concatenate([np.unique(s) for s in sets]).astype(np.uint32), return_counts=True)
                every.append(tokens.tobytes())
                twice.append(tokens[n > 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(least, pa.int64()), pa.array(every, pa.binary()), pa.array(twice, pa.binary())], ["gid", "least", "all", "twice"])

    return blocks.mapInArrow(unite, "gid long, least long, all binary, twice binary")


def bound(pairs: DataFrame, blocks: DataFrame, united: DataFrame, params: JaccardParams) -> DataFrame:
    """pairs: node, own, gid. Returns gid, same (own = gid), queries (array of members) of those whose overlap with the group's union may reach the threshold.

    A group's queries come by the group they are in, so that no row holds more than a block of them.
    """
    members = blocks.select(F.col("gid").alias("own"), F.explode("members").alias("m"))
    asked = join_on_key(members.withColumn("node", F.col("m.node")), pairs, ["own", "node"]).groupBy("own", "gid").agg(F.collect_list("m").alias("queries"))
    asked = asked.join(united, "gid").select("gid", (F.col("own") == F.col("gid")).alias("same"), "queries", "least", F.when(F.col("own") == F.col("gid"), F.col("twice")).otherwise(F.col("all")).alias("tokens"))

    def qualify(batches):
        for batch in few_rows(batches, 64):
            lists = batch.column("queries")
            flat, at = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            own, keep = flat.field("tokens"), np.zeros(len(flat), bool)
            for r, (tokens, least) in enumerate(zip(batch.column("tokens"), batch.column("least").to_pylist(), strict=True)):
                union = np.frombuffer(tokens.as_py(), np.uint32)
                if len(union):
                    for k in range(at[r], at[r + 1]):
                        query = (np.frombuffer(own[k].as_py(), np.uint64) >> np.uint64(32)).astype(np.uint32)
                        place = np.searchsorted(union, query)
                        place[place == len(union)] = 0
                        overlap = int((union[place] == query).sum())
                        smallest = max(least, -(-params.num * len(query) // params.den))
                        keep[k] = (params.num + params.den) * overlap >= params.num * (len(query) + smallest)
            left = np.append(0, np.cumsum(keep))[at]
            queries = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep)))
            out = pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("same"), queries], ["gid", "same", "queries"])
            yield out.filter(pa.array(np.diff(left) > 0))

    return asked.mapInArrow(qualify, asked.select("gid", "same", "queries").schema)


def _open_group(queries: list[dict], members: list[dict], same: bool, params: JaccardParams):
    """Yields (place in queries, places in members) of all links; within a group each once, from the smaller node."""
    sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    names = np.array([m["node"] for m in members], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    tokens, owner = every[order], np.repeat(np.arange(len(members)), sizes)[order]
    union, first = np.unique(tokens, return_index=True)
    last = np.append(first[1:], len(tokens))
    for i, m in enumerate(queries):
        query = np.frombuffer(m["tokens"], np.uint64)
        at = np.searchsorted(union, query)
        at[at == len(union)] = 0
        at = at[union[at] == query]
        counts = last[at] - first[at]
        runs = np.repeat(first[at] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        overlap = np.bincount(owner[runs], minlength=len(members))
        hit = params.den * overlap >= params.num * (len(query) + sizes - overlap)
        if same:
            hit &= names > m["node"]
        if hit.any():
            yield i, np.flatnonzero(hit)


def links(qualified: DataFrame, blocks: DataFrame, params: JaccardParams) -> DataFrame:
    """Opens the groups that queries qualify for. Returns forest edges and link counts: node, other, n."""

    def distinct(members):
        return list({(m["node"], m["set_id"]): m for m in members}.values())

    def found(batches):
        for batch in few_rows(batches, 64):
            out: list[tuple[int, int, int]] = []
            for asked, block, same in zip(batch.column("queries"), batch.column("members"), batch.column("same").to_pylist(), strict=True):
                queries, members = distinct(asked.as_py()), distinct(block.as_py())
                root: dict[int, int] = {}
                n: dict[int, int] = {}

                def top(x, root=root):
                    while (up := root.get(x, x)) != x:
                        root[x] = root.get(up, up)
                        x = up
                    return x

                for i, others in _open_group(queries, members, same, params):
                    x = queries[i]
                    for j in others:
                        y = members[j]
                        n[x["node"]] = n.get(x["node"], 0) + y["copies"]
                        n[y["node"]] = n.get(y["node"], 0) + x["copies"]
                        if (p := top(x["node"])) != (q := top(y["node"])):
                            root[max(p, q)] = min(p, q)
                out += [(x, top(x), n[x]) for x in n]
            if out:
                node, other, count = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(count, pa.int64())], ["node", "other", "n"])

    return qualified.join(blocks, "gid").select("queries", "members", "same").mapInArrow(found, "node long, other long, n long")


def tokenised(texts: DataFrame, wanted: DataFrame, params: JaccardParams) -> DataFrame:
    """wanted: gid, node, copies, set_id, of some sets. Returns gid, members: an array of node, copies, set_id and all tokens, for each group."""

    def retoken(batches):
        for batch in few_rows(batches):
            tokens = [b""] * batch.num_rows
            for i, t in _sets(batch, params):
                tokens[i] = t.tobytes()
            same = [hashlib.blake2b(t, digest_size=16).digest() == s for t, s in zip(tokens, batch.column("set_id").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("gid", "node", "copies", "set_id")), pa.array(tokens, pa.binary())], ["gid", "node", "copies", "set_id", "tokens"])
            yield out.filter(pa.array(same))

    again = join_on_key(texts.withColumnRenamed("doc_id", "node"), wanted, "node").select("gid", "node", "copies", "set_id", "text")
    again = again.mapInArrow(retoken, "gid long, node long, copies long, set_id binary, tokens binary")
    return again.groupBy("gid").agg(F.collect_list(F.struct("node", "copies", "set_id", "tokens")).alias("members"))


def link_documents(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (other rows linked directly) of every row."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.save(shingle_sets(texts, params), "sets")
    narrow = sets.filter("piece IS NULL").select("doc_id", "n_shingles", "set_id")
    classes = narrow.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    classes = scratch.save(classes, "classes")
    order = add_pieces(sets.filter("piece IS NOT NULL").select("piece", "data"), 1 << params.bits, _PIECES)
    # the row with a class's least doc_id speaks for it; a doc_id that occurs in several rows stands for all of them
    speaks = join_on_key(first_tokens(texts, order, params), classes.filter("node IS NOT NULL").select("set_id", "node", "n"), "set_id").filter("doc_id = node")
    prefixes = scratch.save(speaks.select("node", "n", "prefix"), "prefixes")
    cells = shared_cells(prefixes, scratch, params)
    groups = scratch.save(group_documents(cells, prefixes.select("node", "n"), params), "groups")
    matrix = scratch.save(token_group_matrix(cells, groups), "matrix")
    pairs = scratch.save(candidates(cells, groups, matrix, params), "pairs")
    asked = groups.join(pairs.select("gid").distinct(), "gid", "left_semi").select("node", "gid").union(pairs.select("node", F.col("own").alias("gid"))).distinct()
    wanted = scratch.save(asked.join(classes.select("node", "copies", "set_id"), "node"), "wanted")
    blocks = scratch.save(tokenised(texts, wanted, params), "blocks")
    united = scratch.save(unions(blocks), "united")
    qualified = scratch.save(bound(pairs, blocks, united, params), "qualified")
    found = scratch.save(links(qualified, blocks, params), "found")
    comps = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, "components")
    counted = found.groupBy("node").agg(F.sum("n").alias("linked"))
    info = classes.join(counted, "node", "left").join(comps, "node", "left")
    info = scratch.save(info.select("set_id", F.coalesce("component", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "info")
    scratch.drop(*(label for label in list(scratch.paths) if label not in ("sets", "info")))
    out = narrow.join(info, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
