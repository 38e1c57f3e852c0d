"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision only where a pair may link.

Every vector is quantised where it is read, and those of possible pairs once more beside their doubles: a unit vector x is kept as s * q + e with int8 codes q, a scale s and the measured length of
e. Equal vectors of a label collapse. The classes of a label are dealt by hash to strips, about the square root of its number of tiles
or more, so that a strip's codes stay bounded; a pair of strips is one task input, so codes (a byte a dimension) are sent about as
often as a label has strips, and a label that holds most rows is spread over all tasks. For two vectors
|x.y - s_x s_y q_x.q_y| <= |e_x| + |e_y| (1 + |e_x|), so pairs whose product lies below the threshold by more than that can't link. What a
pair of strips returns is the vectors of the other pairs, not these pairs; only such vectors are joined with their doubles, and only such pairs are
computed again in double precision. Products of codes are sums of integers below 2**24 and so exact in single precision (blocks of 1,024 dimensions).
The second step returns each vector's number of links and a spanning forest of them, never all pairs of a group.

All strips of a label meet pairwise: the work is quadratic in a label's distinct vectors, 2**20 pairs to a matrix product.

Edge cases: rows with null label or vector, zero vectors and vectors with null or non-finite parts link with nothing;
vectors of different length don't link; repeated rows count as vectors of their own; rows without vec_id link with equal vectors, and with
others as an equal vector with vec_id does, if there is one; ties: a component is named by its smallest vec_id; an empty table
gives an empty result; further columns don't matter and aren't returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_on_key
from .components import components
from .textnum import few_rows


@dataclass(frozen=True)
class EmbeddingParams:
    """tile: rows and columns of a matrix product; strip_bytes: the most bytes of codes of a strip."""

    threshold: float = 0.98
    tile: int = 1024
    strip_bytes: int = 1 << 21


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and upper bounds of the lengths of the errors of unit vectors (rows)."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return codes.astype(np.int8), scale, error


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes, as doubles."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def may_link(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two tiles of codes, scales and errors (if same: of one tile, first before second) whose cosine may reach the threshold."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    near = tile_product(qx, qy) * sx[:, None] * sy[None, :]
    i, j = np.nonzero(near + (ex[:, None] + ey[None, :] * (1 + ex[:, None])) + 1e-12 >= threshold)
    return (i[i < j], j[i < j]) if same else (i, j)


def unit_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return quantise(x / np.sqrt((x * x).sum(1))[:, None])


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of x and y (if same: of x, first before second) whose cosine reaches the threshold."""
    i, j = may_link(unit_codes(x), unit_codes(y), threshold, same)
    hit = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        a, b = x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]
        hit[k : k + (1 << 16)] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))) >= threshold
    return i[hit], j[hit]


def tile_pairs(n: int, m: int | None, tile: int):
    """Slices of all pairs of tiles of n and m rows; without m, of n rows with themselves, and whether the two are one."""
    for a in range(0, n, tile):
        for b in range(a if m is None else 0, n if m is None else m, tile):
            yield slice(a, a + tile), slice(b, b + tile), m is None and a == b


def forest(ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its component) for all nodes of the pairs."""
    nodes, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    a, b = at[: len(ids_a)], at[len(ids_a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return list(zip(nodes.tolist(), nodes[low].tolist(), strict=True))
        low = new


def coded_vectors(vectors: DataFrame, doubles: bool) -> DataFrame:
    """vec_id, label, digest, and codes, scale and error or, if asked for, vector instead; the latter and digest are null where a row can't link."""

    def code(batches):
        for batch in few_rows(batches):
            made, ids = [None] * batch.num_rows, [None] * batch.num_rows
            for k, (v, label) in enumerate(zip(batch.column("embedding"), batch.column("label").to_pylist(), strict=True)):
                if v.is_valid and label is not None and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        # scaled by a power of two, which changes no cosine, so that no square leaves the range of doubles
                        made[k] = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
                        ids[k] = hashlib.blake2b(made[k].tobytes(), digest_size=16).digest()
            out = [batch.column("vec_id"), batch.column("label"), pa.array(ids, pa.binary())]
            if doubles:
                yield pa.RecordBatch.from_arrays([*out, pa.array([None if x is None else x.tobytes() for x in made], pa.binary())], ["vec_id", "label", "digest", "vector"])
                continue
            codes, scale, error = ([None] * batch.num_rows for _ in range(3))
            for size in {len(x) for x in made if x is not None}:
                rows = [k for k, x in enumerate(made) if x is not None and len(x) == size]
                for k, q, s, e in zip(rows, *unit_codes(np.stack([made[k] for k in rows])), strict=True):
                    codes[k], scale[k], error[k] = q.tobytes(), float(s), float(e)
            yield pa.RecordBatch.from_arrays([*out, pa.array(codes, pa.binary()), pa.array(scale, pa.float64()), pa.array(error, pa.float64())], ["vec_id", "label", "digest", "codes", "scale", "error"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(code, "vec_id long, label string, digest binary, " + ("vector binary" if doubles else "codes binary, scale double, error double"))


_PAIR = ["label", "bytes", "t1", "t2"]


def strip_pairs(classes: DataFrame, scratch: Scratch, params: EmbeddingParams) -> DataFrame:
    """label, bytes (dimensions), t1, t2, a and b (arrays of node, copies, digest, codes, scale, error of two strips; b is null where t1 = t2)."""
    classes = classes.filter("node IS NOT NULL").withColumn("bytes", F.length("codes"))
    n = F.count("*")
    strips = F.greatest(F.ceil(F.sqrt(n / params.tile)), F.ceil(n * F.col("bytes") / params.strip_bytes)).cast("int").alias("strips")
    dealt = classes.join(classes.groupBy("label", "bytes").agg(strips), ["label", "bytes"]).withColumn("strip", F.pmod(F.xxhash64("digest"), F.col("strips")).cast("int"))
    item = F.struct("node", "copies", "digest", "codes", "scale", "error")
    made = scratch.save(dealt.groupBy("label", "bytes", "strips", "strip").agg(F.collect_list(item).alias("items")), "strips")
    other = F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("with")
    keyed = made.select("label", "bytes", "strip", other, "items").select("label", "bytes", F.least("strip", "with").alias("t1"), F.greatest("strip", "with").alias("t2"), "strip", "items")
    left = keyed.filter("strip = t1").select(*_PAIR, F.col("items").alias("a"))
    right = keyed.filter("strip = t2 AND t1 < t2").select(*_PAIR, F.col("items").alias("b"))
    one = left.filter("t1 = t2").withColumn("b", F.lit(None).cast(made.schema["items"].dataType))
    return one.unionByName(left.filter("t1 < t2").join(right, _PAIR))


def candidates(pairs: DataFrame, params: EmbeddingParams) -> DataFrame:
    """The pair of strips, side (0 for a), node, copies and digest of every vector that is in a pair that may link."""

    def unpack(items: pa.StructArray):
        codes = np.frombuffer(b"".join(items.field("codes").to_pylist()), np.int8).reshape(len(items), -1)
        return codes, items.field("scale").to_numpy(), items.field("error").to_numpy()

    def find(batches):
        for batch in few_rows(batches, 16):
            for k in range(batch.num_rows):
                a, b = batch.column("a")[k].values, batch.column("b")[k]
                x, sides = unpack(a), [a] if not b.is_valid else [a, b.values]
                y, met = x if not b.is_valid else unpack(b.values), [np.zeros(len(s), bool) for s in sides]
                for p, q, same in tile_pairs(len(a), len(b.values) if b.is_valid else None, params.tile):
                    i, j = may_link(tuple(v[p] for v in x), tuple(v[q] for v in y), params.threshold, same)
                    met[0][p.start + i] = True
                    met[-1][q.start + j] = True
                for side, (items, hit) in enumerate(zip(sides, met, strict=True)):
                    if hit.any():
                        kept, n = items.filter(pa.array(hit)), int(hit.sum())
                        where = [batch.column(c).slice(k, 1).take(pa.array([0] * n)) for c in _PAIR]
                        yield pa.RecordBatch.from_arrays([*where, pa.array([side] * n, pa.int32()), *(kept.field(c) for c in ("node", "copies", "digest"))], [*_PAIR, "side", "node", "copies", "digest"])

    return pairs.select(*_PAIR, "a", "b").mapInArrow(find, "label string, bytes int, t1 int, t2 int, side int, node long, copies long, digest binary")


def links(exact: DataFrame, params: EmbeddingParams) -> DataFrame:
    """exact: t1, t2, items (array of side, node, copies, digest, vector). Returns forest edges and link counts: node, other, n."""

    def link(batches):
        for batch in few_rows(batches, 16):
            for t1, t2, items in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("items"), strict=True):
                once = list({(r["side"], r["node"], r["digest"]): r for r in items.as_py()}.values())
                sides = [[r for r in once if r["side"] == k] for k in ((0,) if t1 == t2 else (0, 1))]
                if not all(sides):
                    continue
                nodes, copies = ([np.array([r[c] for r in s], np.int64) for s in sides] for c in ("node", "copies"))
                vectors = [np.stack([np.frombuffer(r["vector"], np.float64) for r in s]) for s in sides]
                for p, q, same in tile_pairs(len(vectors[0]), len(vectors[1]) if t1 < t2 else None, params.tile):
                    (na, nb), (ca, cb) = (nodes[0][p], nodes[-1][q]), (copies[0][p], copies[-1][q])
                    i, j = tile_links(vectors[0][p], vectors[-1][q], params.threshold, same)
                    if not len(i):
                        continue
                    n: dict[int, int] = {}
                    for ids, add in ((na, np.bincount(i, cb[j], len(na))), (nb, np.bincount(j, ca[i], len(nb)))):
                        for node, k in zip(ids[add > 0].tolist(), add[add > 0].tolist(), strict=True):
                            n[node] = n.get(node, 0) + int(k)
                    node, low = zip(*forest(na[i], nb[j]), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(low, pa.int64()), pa.array([n[x] for x in node], pa.int64())], ["node", "other", "n"])

    return exact.select("t1", "t2", "items").mapInArrow(link, "node long, other long, n long")


def link_embeddings(vectors: DataFrame, params: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """vectors: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept for every row."""
    scratch = Scratch(vectors.sparkSession)
    coded = scratch.save(coded_vectors(vectors, doubles=False), "coded")
    classes = coded.filter("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("codes").alias("codes"), F.first("scale").alias("scale"), F.first("error").alias("error"))
    classes = scratch.save(classes, "classes")
    close = scratch.save(candidates(strip_pairs(classes, scratch, params), params), "close")
    exact = join_on_key(coded_vectors(vectors, doubles=True).select(F.col("vec_id").alias("node"), "digest", "vector"), close.select("node", "digest").distinct(), ["node", "digest"])
    exact = scratch.save(exact, "exact").join(close, ["node", "digest"]).groupBy(*_PAIR).agg(F.collect_list(F.struct("side", "node", "copies", "digest", "vector")).alias("items"))
    found = scratch.save(links(exact, params), "found")
    comps = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, "components")
    counted = found.groupBy("node").agg(F.sum("n").alias("linked"))
    info = classes.select("label", "digest", "node", "copies").join(counted, "node", "left").join(comps, "node", "left")
    info = scratch.save(info.select("label", "digest", F.coalesce("component", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "info")
    scratch.drop(*(label for label in list(scratch.paths) if label not in ("coded", "info")))
    out = coded.select("vec_id", "label", "digest").join(info, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
