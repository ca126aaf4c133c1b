"""Best-fit packing of token sequences by the sum-of-squares rule.

Every piece goes to the open sequence (or a new one) after which the sum, over residual gaps, of the squared
number of open sequences with that gap is smallest; ties go to the smallest gap, which is best fit. Pieces are
dealt by a hash into blocks of bounded expected size, each packed in one task. Only keys and
lengths are shuffled; a block ends with about one sequence that is not full, so the loss against packing
everything at once is about one sequence per BLOCK pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import staged
from .tokens import default_path, id_and_text, slices

#: Pieces in one block, on average.
BLOCK = 16_384


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cuts every text's ids, closed by `end_id`, into pieces of `capacity` ids; only a last piece is shorter.

    Returns id_col, piece int from 0, start long, length long, token_bytes binary (little-endian unsigned 32-bit
    ids). A null or empty text is the one id `end_id`. Rows that repeat an id give pieces each.
    """
    path = tokenizer or default_path()
    tail, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches):
        from .wordbpe import encoder

        own = encoder(path, "prefix")
        for ids, texts, _ in slices(batches):
            row, piece, start, length, out = [], [], [], [], []
            for i, text in enumerate(texts):
                whole = own.encode(text) + tail
                for k, at in enumerate(range(0, len(whole), step)):
                    cut = whole[at : at + step]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(cut) // 4), out.append(cut)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())], ["id", "piece", "start", "length", "token_bytes"])

    kinds = [("id", df.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("token_bytes", T.BinaryType())]
    return id_and_text(df, id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds])).withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the given order; lengths must be from 1 to capacity."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one (gap 0) is closed and not counted
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    # what one more or one less open sequence of a gap adds to the sum of squares
    more, less = np.ones(capacity + 1, np.int64), np.full(capacity + 1, np.iinfo(np.int32).max, np.int64)
    more[0] = less[capacity] = 0
    for k, s in enumerate(lengths.tolist()):
        gap = s + int(np.argmin(less[s:] + more[: capacity + 1 - s]))
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = of_gap[gap].pop()
            count[gap] -= 1
            more[gap] -= 2
            less[gap] = 1 - 2 * count[gap] if count[gap] else np.iinfo(np.int32).max
        sequence[k], offset[k] = at, capacity - gap
        if left := gap - s:
            of_gap[left].append(at)
            count[left] += 1
            more[left] += 2
            less[left] = 1 - 2 * count[left]
    return sequence, offset


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """sum_of_squares() over one block, given longest first, and then again over its emptiest sequences.

    The rule keeps gaps varied and doesn't finish sequences near the end of its input. So it also tries the pieces
    in bands of 64 lengths, shuffled by a fixed seed within a band, keeps the better result, and packs the
    emptiest 5, 20 and 50 % of sequences anew for as long as that saves any.
    """
    banded = np.argsort(-(lengths // 64) + 0.99 * np.random.default_rng(7).random(len(lengths)), kind="stable")
    tries = []
    for order in (np.arange(len(lengths)), banded):
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        sequence[order], offset[order] = sum_of_squares(lengths[order], capacity)
        tries.append((sequence, offset))
    sequence, offset = min(tries, key=lambda t: t[0].max(initial=-1))
    shares, rounds = [0.05, 0.2, 0.5], 0
    while shares and len(lengths) and rounds < 24:
        rounds += 1
        gaps = capacity - np.bincount(sequence, weights=lengths).astype(np.int64)
        worst = np.argsort(-gaps, kind="stable")[: max(2, int(len(gaps) * shares[0]))]
        chosen = np.flatnonzero(np.isin(sequence, worst))
        anew, places = sum_of_squares(lengths[chosen], capacity)
        if anew.max() + 1 >= len(worst):
            shares.pop(0)
            continue
        sequence[chosen], offset[chosen] = len(gaps) + anew, places
        sequence = np.unique(sequence, return_inverse=True)[1]
    return sequence, offset


def pack_pieces(pieces: DataFrame, n_blocks: int, keys: list[str], length_col: str = "length", capacity: int = 2048) -> DataFrame:
    """Adds sequence_id long (unique numbers with gaps) and offset long (gapless from 0 within a sequence).

    `keys` name a piece; with a number of each row they deal pieces to `n_blocks` blocks, so that equal rows (null ids, one
    repeated id) spread too, and they break ties of length. Equal rows of a block simply take places side by side.
    `pieces` should be a written table, so that a task that is repeated numbers its rows alike. All other columns pass through (keep heavy ones out: they'd be shuffled). A null
    length, one under 1 or one over `capacity` raises an error in the task: no piece is dropped.
    """
    block = F.pmod(F.xxhash64(*keys, length_col, F.monotonically_increasing_id()), F.lit(max(1, n_blocks))).cast("int")
    dealt = pieces.withColumn("__block", block)
    names = pieces.columns

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([length_col, *keys], ascending=[False, *[True] * len(keys)], kind="stable", ignore_index=True)
        lengths = own[length_col].to_numpy(np.int64)
        if len(lengths) and (lengths[-1] < 1 or lengths[0] > capacity):
            raise ValueError("a piece's length must be from 1 to the capacity")
        sequence, offset = pack_block(lengths, capacity)
        out = own[names]
        return out.assign(sequence_id=(own["__block"].to_numpy(np.int64) << 32) + sequence, offset=offset)

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("__block").applyInPandas(run, schema)


def blocks_for(df: DataFrame, text_col: str = "text", capacity: int = 2048, block: int = BLOCK) -> int:
    """Number of blocks for a table of texts, from its row count and bytes; a piece holds at least half a byte a token."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    return max(1, -(-(n + (size or 0) // (2 * capacity)) // block))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """token_pieces() with crc32 instead of the ids, packed: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Rows that repeat an id, or have none, give pieces each. An empty
    table gives no rows. Only the two named columns are read, so other columns may be called anything.
    """
    pieces = token_pieces(df, id_col, text_col, tokenizer, capacity)
    light = pieces.select(id_col, "piece", "start", "length", F.crc32("token_bytes").alias("ids_crc32"))
    return pack_pieces(staged(light), blocks_for(df, text_col, capacity), [id_col, "piece"], "length", capacity)
