"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector's code is the sign pattern of its rotated direction, packed to one bit a dimension; the code's inner product
with the direction is stored beside it as correction factor f. For a query q and a coded vector o, <code, q> / f estimates
c = <o, q> without bias; its standard error is sqrt(1 - c*c) * sqrt(1 - f*f) / f / sqrt(d - 1), which for pairs of a cosine
over the threshold is largest at the threshold. The query is the
other vector's rotated direction in one signed byte a dimension, whose rounding is bounded exactly and added to the
bound. Codes, factors and bytes are computed once, written, and all that travels to the buckets. A pair is
estimated from both sides; only if both upper bounds reach the threshold are the two whole vectors fetched and
their cosine computed, in double precision. SIGMAS standard errors wide, a bound fails with probability 1e-9.

Which pairs are looked at comes from the same kind of bits: several tables, each keyed by some bits of
independently rotated codes. The number of bits grows with the logarithm of the table size, the number of tables
follows from the wanted recall at the threshold, so buckets stay of bounded expected size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .grouped import runs
from .scratch import staged

#: Chance that a pair exactly at the threshold shares no table.
MISS = 1e-3
#: Vectors in a bucket for which bits are chosen, and vectors of a bucket handled against each other at once.
BUCKET, BLOCK = 64, 512
#: Width of the confidence bound in standard errors of the estimate.
SIGMAS = 6.0


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix from a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def layout(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a table's key, tables) for n vectors."""
    bits = max(4, min(48, math.ceil(math.log2(max(2, n / BUCKET)))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - share)))


def unit_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double precision) of the usable rows of one length; the caller groups by length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(lists), -1)
    norm = np.linalg.norm(m, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    big = np.isfinite(m).all(axis=1) & (~np.isfinite(norm) | (norm == 0)) & (m != 0).any(axis=1)
    if big.any():  # the sum of squares over- or underflows: scale by the largest component first
        m = m.copy()
        m[big] /= np.abs(m[big]).max(axis=1, keepdims=True)
        norm[big] = np.linalg.norm(m[big], axis=1)
        ok |= big
    return np.flatnonzero(ok), m[ok] / norm[ok, None]


def key_type(bits: int) -> type:
    """The smallest unsigned integer that holds a table's key."""
    return np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, correction factors, rotated directions in signed bytes, size of one byte step) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, seed)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    step = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned > 0, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step


def coded(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """vectors (cid, dim, v) as cid, dim, code, factor, query, step, keys (binary, `tables` keys from fresh rotations)."""
    def run(batches):
        for batch in batches:
            cids, dims, vs = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            for dim in np.unique(dims):
                pick = pa.array(np.flatnonzero(dims == dim))
                own = vs.take(pick)
                unit = np.frombuffer(b"".join(own.to_pylist()), np.float64).reshape(len(own), dim)
                need, drawn, k = bits * tables, [], 0
                while k * dim < need:
                    drawn.append(unit @ rotation(dim, seed + 1 + k) > 0)
                    k += 1
                flags = np.concatenate(drawn, axis=1)[:, :need].reshape(len(own), tables, bits)
                keys = (flags * (1 << np.arange(bits, dtype=np.uint64))).sum(axis=2).astype(key_type(bits))
                code, factor, query, step = codes(unit, seed)
                yield pa.RecordBatch.from_arrays(
                    [cids.take(pick), pa.array(np.full(len(own), dim, np.int32)), rows_of(code), pa.array(factor), rows_of(query), pa.array(step), rows_of(keys)],
                    ["cid", "dim", "code", "factor", "query", "step", "keys"])

    kinds = [("cid", T.LongType()), ("dim", T.IntegerType()), ("code", T.BinaryType()), ("factor", T.DoubleType()), ("query", T.BinaryType()), ("step", T.DoubleType()), ("keys", T.BinaryType())]
    return vectors.select("cid", "dim", "v").mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def rows_of(matrix: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def matrix_of(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Inverse of rows_of."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def upper_bounds(code: np.ndarray, factor: np.ndarray, query: np.ndarray, step: np.ndarray, dim: int, least: float = 0.0) -> np.ndarray:
    """Upper confidence bounds, for pairs with inner product `least` or more, of coded vectors (rows) and queries (columns).

    A pair whose bound is under `least` has a smaller inner product than that.
    """
    signs = (2 * np.unpackbits(code, axis=1, count=dim).astype(np.float32) - 1) / np.float32(math.sqrt(dim))
    got = signs @ (query.astype(np.float32) * step[:, None].astype(np.float32)).T
    # a unit code moves by at most the length of the rounding error, half a step in each dimension
    rounding = math.sqrt(dim) / 2 * step[None, :]
    spread = SIGMAS * math.sqrt(1 - least**2) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return (got + rounding) / factor[:, None] + spread[:, None]


def candidates(cells: DataFrame, threshold: float, bits: int) -> DataFrame:
    """The members of each block pair of a bucket that the codes can't rule out: cell, side, cid, dim, mates.

    Side 0 are members of the left block; mates has a bit for each member of side 1, in order of cid, that the member may
    link with. A pair belongs to the first table where its keys agree.
    """
    def run(batches):
        for own in runs(batches):
            cell, dim, left, right, t = (own.column(c)[0].as_py() for c in ("cell", "dim", "lo", "hi", "t"))
            block, cid = own.column("block").to_numpy(), own.column("cid").to_numpy()
            order = np.argsort(cid, kind="stable")
            a, b = order[block[order] == left], order[block[order] == right]
            code, query, keys = matrix_of(own.column("code"), np.uint8), matrix_of(own.column("query"), np.int8), matrix_of(own.column("keys"), key_type(bits))
            factor, step = own.column("factor").to_numpy(), own.column("step").to_numpy()
            bound = np.minimum(upper_bounds(code[a], factor[a], query[b], step[b], dim, threshold), upper_bounds(code[b], factor[b], query[a], step[a], dim, threshold).T)
            open_ = bound >= threshold - 1e-4
            if left == right:
                open_ &= cid[a][:, None] < cid[b][None, :]
            for k in range(t):
                open_ &= keys[a, k][:, None] != keys[b, k][None, :]
            rows, columns = open_.any(axis=1), open_.any(axis=0)
            n, m = int(rows.sum()), int(columns.sum())
            if not n:
                continue
            mates = [*(x.tobytes() for x in np.packbits(open_[rows][:, columns], axis=1)), *[None] * m]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + m, cell)), pa.array(np.r_[np.zeros(n, np.int32), np.ones(m, np.int32)]), pa.array(np.r_[cid[a][rows], cid[b][columns]]), pa.array(np.full(n + m, dim, np.int32)), pa.array(mates, pa.binary())],
                ["cell", "side", "cid", "dim", "mates"])

    kinds = [("cell", T.LongType()), ("side", T.IntegerType()), ("cid", T.LongType()), ("dim", T.IntegerType()), ("mates", T.BinaryType())]
    return cells.mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def exact_links(cells: DataFrame, threshold: float) -> DataFrame:
    """cid, n long (vectors linked), low long (smallest cid reached here) for candidates with their vectors v and class sizes."""
    def run(batches):
        for own in runs(batches):
            side, cid, size = (own.column(c).to_numpy() for c in ("side", "cid", "size"))
            unit = matrix_of(own.column("v"), np.float64)
            a, b = (np.flatnonzero(side == k) for k in (0, 1))
            a, b = a[np.argsort(cid[a], kind="stable")], b[np.argsort(cid[b], kind="stable")]
            i, j = np.nonzero(np.unpackbits(matrix_of(own.column("mates").take(pa.array(a)), np.uint8), axis=1, count=len(b)))
            i, j = a[i], b[j]
            keep = np.concatenate([np.einsum("ij,ij->i", unit[i[at : at + 65_536]], unit[j[at : at + 65_536]]) >= threshold for at in range(0, len(i), 65_536)])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            # a class may stand on both sides of its cell
            known, at = np.unique(cid, return_inverse=True)
            i, j, of = at[i], at[j], np.empty(len(known), np.int64)
            of[at] = size
            n = np.bincount(i, of[j], len(known)) + np.bincount(j, of[i], len(known))
            low = known.copy()
            while True:  # smallest cid along the links of this cell
                was = low.copy()
                np.minimum.at(low, i, low[j])
                np.minimum.at(low, j, low[i])
                if np.array_equal(was, low):
                    break
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(known[hit]), pa.array(n[hit].astype(np.int64)), pa.array(low[hit])], ["cid", "n", "low"])

    kinds = [("cid", T.LongType()), ("n", T.LongType()), ("low", T.LongType())]
    return cells.mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, seed: int = 20) -> DataFrame:
    """One row a vector: id_col, n_links long, component_id (smallest id reachable by links, itself included), kept.

    Links join vectors of one length with cosine >= threshold, decided in double precision; a pair below never links.
    A pair at the threshold is missed with probability MISS, closer ones more rarely. Null vectors, zero vectors and
    vectors with null or non-finite components link with nothing. Vectors of equal direction bits (exact
    copies) form one class that goes on once, with its size. A null id gets component null and is kept. Ids are
    numbers; rows that repeat an id count as vectors of their own and share a component. Only the two named columns are
    read, so other columns may be called anything. An empty table gives no rows.

    Large buckets are split into blocks; each pair of blocks is one small task unit of codes. Its candidates are kept as
    one bit a pair, links are counted there and never listed.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(usable, v).alias("v"))

    def unit(batches):
        for batch in batches:
            out = [None] * batch.num_rows
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[size > 0]):
                pick = np.flatnonzero(size == dim)
                at, m = unit_rows(lists.take(pa.array(pick)))
                for k, row in zip(pick[at].tolist(), m):
                    out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])

    units = staged(rows.mapInArrow(unit, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())])).withColumn("h", F.sha2(F.col("v"), 256)))
    live = units.where("v IS NOT NULL AND id IS NOT NULL")
    classes = staged(live.groupBy("h").agg(F.min("id").alias("cid"), F.count("*").alias("size"), F.first("v").alias("v")))
    bits, tables = layout(classes.count(), threshold)
    stored = staged(coded(classes.withColumn("dim", (F.octet_length("v") / 8).cast("int")), bits, tables, seed))

    # the key of table t is a slice of `keys`; bytes of equal keys are equal, so they serve as the key itself
    wide = np.dtype(key_type(bits)).itemsize
    keyed = stored.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("key", F.substring("keys", wide * F.col("t") + 1, F.lit(wide)))
    counts = staged(keyed.groupBy("t", "key", "dim").agg(F.count("*").alias("c")).where("c > 1"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    earlier = F.substring("keys", F.lit(1), wide * F.col("t")).alias("keys")
    entries = keyed.select("t", "key", "cid", "dim", "code", "factor", "query", "step", earlier).join(counts, ["t", "key", "dim"]).withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    cells = entries.withColumn("o", F.explode(others)).select(F.xxhash64("t", "key", "dim", "o.lo", "o.hi").alias("cell"), "t", "dim", "o.lo", "o.hi", "block", "cid", "code", "factor", "query", "step", "keys")
    open_ = staged(candidates(cells.repartition("cell").sortWithinPartitions("cell"), threshold, bits))
    fetched = open_.join(classes.select("cid", "size", "v"), "cid").select("cell", "side", "cid", "mates", "size", "v")
    found = staged(exact_links(fetched.repartition("cell").sortWithinPartitions("cell"), threshold))

    roots = components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")))
    n = found.groupBy("cid").agg(F.sum("n").alias("n"))
    of_class = classes.select("h", "cid", "size").join(n, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    of_class = staged(of_class.select("h", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("component_id")))
    keyed_rows = units.select("id", F.when(F.col("id").isNotNull(), F.col("h")).alias("h"))
    out = keyed_rows.where("h IS NOT NULL").join(of_class, "h").select("id", "n_links", "component_id")
    alone = keyed_rows.where("h IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return both.withColumnRenamed("id", id_col)
