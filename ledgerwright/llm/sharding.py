"""Shards of bounded size by extendible hashing. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import cleared, staged

#: Low bits of a row's 64-bit key that differ between equal rows; the others come from the key columns alone.
SALT_BITS = 24
#: Bits that one round looks ahead; a round costs one aggregation of the rows that are still in oversized buckets.
STEP = 8


def row_bits(*key: str) -> Column:
    """A 64-bit key: hash of the key columns, with low bits that also separate rows with equal keys."""
    mask = (1 << SALT_BITS) - 1
    own, salt = F.xxhash64(*key), F.xxhash64(*key, F.monotonically_increasing_id())
    return own.bitwiseAND(F.lit(~mask)).bitwiseOR(salt.bitwiseAND(F.lit(mask)))


def prefix(bits: Column, depth: int) -> Column:
    return F.shiftrightunsigned(bits, 64 - depth) if depth else F.lit(0).cast("long")


def assign_shards(df: DataFrame, bits_col: str, bytes_col: str, limit: int) -> DataFrame:
    """Adds depth int, shard string (the bits of the shard's hash prefix) and shard_bytes long.

    All rows start in one bucket of depth 0. Only a bucket over `limit` bytes is split on its next bit, until every
    shard fits; a bucket of one row, or of rows that share all 64 bits, cannot be split and stays as it is
    (that row is larger than the limit by itself). Null sizes count 0. An empty table gives no rows. The directory is a
    table: one row for each final bucket, never collected. A round sums up buckets STEP bits deeper, in each
    task before the shuffle, from which the sums of all depths between follow; the driver only learns whether any
    bucket is still too large.

    df should be light and stable (a written table): it is read once a round.
    """
    rows = df.withColumn("__b", F.coalesce(F.col(bytes_col), F.lit(0)).cast("long"))
    directory, open_, depth = [], None, 0
    while True:
        to = min(64, depth + STEP)
        live = rows if open_ is None else rows.join(open_, prefix(F.col(bits_col), depth) == F.col("__open"), "left_semi")
        cells = live.groupBy(prefix(F.col(bits_col), to).alias("cell")).agg(F.sum("__b").alias("b"), F.count("*").alias("n"), F.min(bits_col).alias("lo"), F.max(bits_col).alias("hi"))
        # every cell counts for its prefix of each depth of this round
        levels = F.array(*[F.struct(F.lit(d).alias("d"), (F.shiftrightunsigned("cell", to - d) if d else F.lit(0).cast("long")).alias("p")) for d in range(depth, to + 1)])
        sums = cells.select(F.explode(levels).alias("x"), "b", "n", "lo", "hi").groupBy("x.d", "x.p").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        whole = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("lo") == F.col("hi"))
        sums = staged(sums.withColumn("fits", whole))
        # a bucket is final if it fits and its parent (in this round) doesn't
        above = sums.where("not fits").select((F.col("d") + 1).alias("d"), F.col("p").alias("up"))
        below = sums.where("fits").withColumn("up", F.shiftrightunsigned("p", 1))
        start = sums.where(F.col("fits") & (F.col("d") == depth)) if depth == 0 else None
        final = below.where(F.col("d") > depth).join(above, ["d", "up"], "left_semi")
        for part in [final, *([start] if start is not None else [])]:
            directory.append(part.select("d", "p", "b"))
        open_ = sums.where(~F.col("fits") & (F.col("d") == to)).select(F.col("p").alias("__open"))
        if to == 64 or open_.isEmpty():
            break
        depth = to
    buckets = staged(reduce(DataFrame.unionByName, directory))
    # a row's bucket is the only one whose prefix its key has: it is looked up at each depth that occurs
    used = [r[0] for r in buckets.select("d").distinct().collect()] or [0]  # depths, at most 65; any for an empty table
    found = F.array(*[F.struct(F.lit(d).alias("d"), prefix(F.col(bits_col), d).alias("p")) for d in sorted(used)])
    probes = rows.withColumn("__x", F.explode(found)).withColumns({"d": F.col("__x.d"), "p": F.col("__x.p")}).drop("__x")
    joined = probes.join(buckets.withColumnRenamed("b", "shard_bytes"), ["d", "p"])
    names = F.when(F.col("d") == 0, "").otherwise(F.substring(F.lpad(F.conv(F.hex("p"), 16, 2), 64, "0"), -64, 64))
    shard = F.when(F.col("d") == 0, F.lit("")).otherwise(names.substr(65 - F.col("d"), F.col("d")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col("d").cast("int").alias("depth"), shard.alias("shard"), "shard_bytes")


def shard_documents(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes long, depth, shard, shard_bytes for every row; sizes are UTF-8 bytes, a null text has 0.

    Null and repeated ids are rows like others. A text larger than the limit has a shard of its own. An empty table gives
    no rows. Only the two named columns are read, so other columns may be called anything.
    """
    light = df.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), row_bits(id_col, text_col).alias("__bits"))
    return assign_shards(staged(light), "__bits", "n_bytes", limit).drop("__bits")


def write_shards(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", format: str = "parquet") -> None:
    """Shards every row of df as shard_documents does and writes df with one folder a shard; rows go to their shard's task by the shard's name.

    Rows are staged with a number of their own and meet their shards by it, so null and repeated ids are written once
    each. Columns of df named shard or __row are replaced.
    """
    with cleared(df.sparkSession):
        rows = staged(df.drop("shard", "__row").withColumn("__row", F.monotonically_increasing_id()))
        light = rows.select("__row", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("__bytes"), row_bits(id_col, text_col).alias("__bits"))
        assigned = assign_shards(staged(light), "__bits", "__bytes", limit).select("__row", "shard")
        rows.join(assigned, "__row").drop("__row").repartition("shard").write.partitionBy("shard").format(format).save(path)
