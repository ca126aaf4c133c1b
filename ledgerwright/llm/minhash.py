"""Near-duplicate documents by circulant MinHash, banding and exact verification on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .components import components
from .grouped import runs
from .scratch import staged
from .shingles import mix, shingle_sets

#: Signature coordinates, and how many form a band: a pair at similarity 0.8 shares no band with probability 5e-8.
COORDINATES, BAND_ROWS = 128, 4
#: Of a pair's 128 lowest coordinate bits so many may differ: at 0.8 about 13 do, over 34 with probability 1e-8.
MOST_BITS = 34
#: Documents of a leader that are held against each other at once.
BLOCK = 512
#: Text bytes handled at once in a task.
SLICE_BYTES = 1 << 20


def first_permutation(shingles: np.ndarray) -> np.ndarray:
    """Place of each shingle in a universe of 2**32 places, shuffled."""
    return (mix(shingles ^ np.uint64(0x243F6A8885A308D3)) >> np.uint64(32)).astype(np.uint32)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers: multiplications by odd numbers between right shifts, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signature matrix of the texts with a non-empty set.

    Coordinate k is the smallest value that the second permutation, shifted circularly by k places, gives to the
    places of the text's shingles: all coordinates come from the same two permutations.
    """
    full = sizes[sizes > 0]
    starts = np.r_[0, np.cumsum(full)[:-1]].astype(np.int64)
    out = np.empty((len(full), COORDINATES), np.uint32)
    places = first_permutation(shingles)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(second_permutation(places + np.uint32(k)), starts)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), -1, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1)), bands.shape[:2]).copy()
    for k in range(BAND_ROWS):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + bands[:, :, k])
    return out.view(np.int64)


def by_bytes(batches: Iterator[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text columns of each hold about SLICE_BYTES."""
    import pyarrow.compute as pc

    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(t)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
            yield batch.slice(at, to - at)
            at = to


def signed(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n_shingles long, set_key binary (128-bit digest of the set), s0 and s1 long (lowest coordinate bits), bands array<long>."""
    def run(batches):
        for part in by_bytes(batches, 1):
            shingles, sizes = shingle_sets(part.column(1), words)
            signature = signatures(shingles, sizes)
            bits = np.packbits(signature & 1, axis=1).view(">i8").astype(np.int64)
            bands = band_hashes(signature) if len(signature) else np.empty((0, COORDINATES // BAND_ROWS), np.int64)
            has, ends = sizes > 0, np.cumsum(sizes)
            keys = [hashlib.blake2b(shingles[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
            row = np.cumsum(has) - 1
            half = [pa.array(np.where(has, bits[np.maximum(row, 0), k], 0) if len(bits) else np.zeros(len(has), np.int64), mask=~has) for k in (0, 1)]
            width = COORDINATES // BAND_ROWS
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has * width)].astype(np.int32)), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(keys, pa.binary()), *half, lists], ["id", "n_shingles", "set_key", "s0", "s1", "bands"])

    kinds = [("id", df.schema[id_col].dataType), ("n_shingles", T.LongType()), ("set_key", T.BinaryType()), ("s0", T.LongType()), ("s1", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def may_reach(a: str, b: str, percent: int) -> Column:
    """Whether two sets can have the similarity by their sizes, and do not differ in too many signature bits."""
    one, two = (lambda x: F.col(f"{a}{x}")), (lambda x: F.col(f"{b}{x}"))
    apart = F.bit_count(one("s0").bitwiseXOR(two("s0"))) + F.bit_count(one("s1").bitwiseXOR(two("s1")))
    most = MOST_BITS if percent >= 80 else COORDINATES
    return (100 * F.least(one("n"), two("n")) >= percent * F.greatest(one("n"), two("n"))) & (apart <= most)


def with_texts(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs a, b with the whole texts ta, tb."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    one = pairs.join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "tb"), "b")
    return one.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "ta"), "a").select("a", "b", "ta", "tb")


def set_pairs(part: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two shingle sets of each row of a, b, ta, tb."""
    sets = [shingle_sets(part.column(k), words) for k in (2, 3)]
    ends = [np.cumsum(x[1]) for x in sets]
    for i in range(part.num_rows):
        yield tuple(x[0][e[i] - x[1][i] : e[i]] for x, e in zip(sets, ends))


def verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs a, b whose full shingle sets have 100 * intersection >= percent * union, computed from the whole texts."""
    def run(batches):
        for part in by_bytes(batches, 2, 3):
            keep = []
            for x, y in set_pairs(part, words):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(100 * both >= percent * (len(x) + len(y) - both)) and both > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kinds = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])
    return with_texts(pairs, df, id_col, text_col).mapInArrow(run, kinds)


def edits(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """a, b, n long (size of b's set), e binary: the shingles that only one of both sets has (b's edits of a)."""
    def run(batches):
        for part in by_bytes(batches, 2, 3):
            n, out = [], []
            for x, y in set_pairs(part, words):
                n.append(len(y))
                out.append(np.setxor1d(x, y, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["a", "b", "n", "e"])

    kinds = [(c, pairs.schema[c].dataType) for c in ("a", "b")] + [("n", T.LongType()), ("e", T.BinaryType())]
    return with_texts(pairs, df, id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def common_edits(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Matrix of the numbers of common elements of two lists of sets."""
    value, place = np.unique(np.concatenate([*one, *two]) if one or two else np.empty(0, np.uint64), return_inverse=True)
    shared = np.bincount(place, minlength=len(value)) > 1
    slot = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in [*one, *two]])
    row, slot = row[slot >= 0], slot[slot >= 0]
    order = np.argsort(slot, kind="stable")
    row, slot = row[order], slot[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(slot, [at, at + columns])
        m = np.zeros((len(one) + len(two), columns), np.float32)
        m[row[lo:hi], slot[lo:hi] - at] = 1
        out += m[: len(one)] @ m[len(one) :].T
    return out


def links_by_edits(cells: DataFrame, percent: int) -> DataFrame:
    """a, b: links between documents of a cell that are in different components, as a forest.

    Documents x, y of one leader differ in exactly the shingles in which their edits differ: |e_x| + |e_y| - 2 |common|.
    So a cell decides all its pairs from short lists, and lists none of them.
    """
    def run(batches):
        for own in runs(batches):
            left, right = own.column("lo")[0].as_py(), own.column("hi")[0].as_py()
            block, cid, root, n = (own.column(c).to_numpy() for c in ("block", "b", "root", "n"))
            e = [np.frombuffer(x, np.uint64) for x in own.column("e").to_pylist()]
            x, y = np.flatnonzero(block == left), np.flatnonzero(block == right)
            size = np.array([len(v) for v in e])
            apart = size[x][:, None] + size[y][None, :] - 2 * common_edits([e[i] for i in x], [e[i] for i in y])
            close = (100 - percent) * (n[x][:, None] + n[y][None, :]) >= (100 + percent) * apart
            i, j = np.nonzero(close & (root[x][:, None] != root[y][None, :]))
            i, j = x[i], y[j]
            low = root.copy()
            while len(i):  # smallest root along the links of this cell
                was = low.copy()
                np.minimum.at(low, i, low[j])
                np.minimum.at(low, j, low[i])
                if np.array_equal(was, low):
                    break
            hit = low != root
            yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(low[hit])], ["a", "b"])

    kind = cells.schema["b"].dataType
    return cells.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: id_col, n_shingles long, component_id (smallest linked id, itself included), kept boolean.

    Texts link if their sets of `words`-word shingles have 100 * intersection >= percent * union. Equal sets form
    one class, shown by its smallest id; only classes go further. In each band's bucket the document that
    shares most buckets leads and is compared with all others of the bucket that sizes and signature bits allow.
    Documents of one leader that this leaves in different components are decided from their edits of the leader, block
    against block, without listing pairs; pairs of a bucket with a document that could not reach the leader are
    compared one by one. No pair of a bucket is skipped for its size, and pairs inside a component are never listed.

    Empty and null texts have no set and link with nothing. A null id has component null and stays. Rows that repeat an id
    are one document: each row is compared with its own text, and they share their component. Ids are whole numbers; other
    types raise a TypeError. Only the two named columns are read, so other columns may be called anything. An empty
    table gives no rows.
    """
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must hold whole numbers")
    rows = staged(signed(df, id_col, text_col, words))
    live = rows.where("n_shingles > 0 AND id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("s0", "s1", "bands")]
    classes = staged(live.groupBy("set_key").agg(F.min("id").alias("cid"), F.first("n_shingles").alias("n"), *firsts))

    banded = classes.select("cid", "n", "s0", "s1", F.explode("bands").alias("band"))
    shared = staged(banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    members = staged(banded.join(shared, "band"))
    reach = staged(members.groupBy("cid").agg(F.sum("c").alias("reach")))
    ranked = members.join(reach, "cid").select("band", F.struct("reach", (-F.col("cid")).alias("low"), "n", "s0", "s1").alias("lead"))
    leads = staged(ranked.groupBy("band").agg(F.max("lead").alias("lead")).select("band", *[F.col(f"lead.{c}").alias(f"l_{c}") for c in ("low", "n", "s0", "s1")]).withColumn("l_cid", -F.col("l_low")).drop("l_low"))
    named = members.select("band", *[F.col(c).alias(f"m_{c}") for c in ("cid", "n", "s0", "s1")])
    led = named.join(leads, "band")
    compared = staged(led.where((F.col("l_cid") != F.col("m_cid")) & may_reach("l_", "m_", percent)).select(F.col("l_cid").alias("a"), F.col("m_cid").alias("b")).distinct())
    links = staged(verified(compared, df, id_col, text_col, words, percent).distinct())
    roots = components(links)

    # documents compared with the same leader, but still in different components: decided from their edits of the leader
    rooted = lambda x, c: x.join(roots, F.col(c) == F.col("node"), "left").withColumn("root", F.coalesce("root", c)).drop("node")
    of_lead = staged(rooted(compared, "b"))
    sizes = staged(of_lead.groupBy("a").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("a", "c"))
    if not sizes.isEmpty():
        mixed = staged(of_lead.join(sizes, "a"))
        listed = edits(mixed.select("a", "b"), df, id_col, text_col, words).dropDuplicates(["a", "b"])
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        placed = listed.join(mixed, ["a", "b"]).withColumn("block", F.pmod(F.xxhash64("b"), blocks).cast("int"))
        others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
        cells = placed.withColumn("o", F.explode(others)).select("a", "o.lo", "o.hi", "block", "b", "root", "n", "e")
        cells = cells.select(F.xxhash64("a", "lo", "hi").alias("cell"), "*").drop("a").repartition("cell").sortWithinPartitions("cell")
        links = staged(links.unionByName(links_by_edits(cells, percent)))
        roots = components(links)

    # what is left: pairs of a bucket in different components, of which at least one could not reach the leader
    labelled = rooted(named, "m_cid").withColumnRenamed("root", "m_root").join(leads, "band")
    labelled = staged(labelled.select("band", *[f"m_{c}" for c in ("cid", "n", "s0", "s1", "root")], ((F.col("m_cid") == F.col("l_cid")) | may_reach("l_", "m_", percent)).alias("near")))
    state = staged(labelled.groupBy("band").agg(F.min("m_root").alias("lo"), F.max("m_root").alias("hi"), F.bool_and("near").alias("all_near")).where("lo <> hi AND NOT all_near").select("band"))
    if not state.isEmpty():
        mixed = staged(labelled.join(state, "band"))
        other = mixed.where("NOT near").select("band", *[F.col(f"m_{c}").alias(f"l_{c}") for c in ("cid", "n", "s0", "s1", "root")])
        once = F.col("near") | (F.col("m_cid") < F.col("l_cid"))
        ordered = [F.least("l_cid", "m_cid").alias("a"), F.greatest("l_cid", "m_cid").alias("b")]
        rest = staged(other.join(mixed, "band").where((F.col("m_root") != F.col("l_root")) & once & may_reach("l_", "m_", percent)).select(*ordered).distinct())
        if not rest.isEmpty():
            links = staged(links.unionByName(verified(rest, df, id_col, text_col, words, percent).distinct()))
            roots = components(links)

    of_class = staged(classes.select("set_key", "cid").join(roots, F.col("cid") == F.col("node"), "left").select("set_key", F.coalesce("root", "cid").alias("component_id")))
    keyed = rows.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = keyed.where("set_key IS NOT NULL").join(of_class, "set_key").select("id", "n_shingles", "component_id")
    alone = keyed.where("set_key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    both = out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return both.withColumnRenamed("id", id_col)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group of near duplicates: the one with the smallest id, on equal ids any one; null ids come last.

    Every row is a document of its own here, whatever its id: rows that repeat id and text are a group and one of
    them stays, a repeated id with unlike texts keeps both, rows without an id are grouped like others. Empty and null
    texts resemble nothing and all stay. Ids may have any type. An empty table stays empty. A column named __row is replaced.
    """
    numbered = staged(df.drop("__row").withColumn("__row", F.monotonically_increasing_id()))
    found = near_duplicates(numbered, "__row", text_col, words, percent)
    grouped = staged(found.select("__row", "component_id").join(numbered.select("__row", F.col(id_col).alias("id")), "__row"))
    order = F.struct(F.col("id").isNull(), "id", "__row")
    first = staged(grouped.groupBy("component_id").agg(F.min(order)["__row"].alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = grouped.join(first, "component_id").where("__row <> first").select("__row")
    return numbered.join(gone, "__row", "left_anti").drop("__row")
