"""Whole-text encoding, decoding and token counts with the word-level BPE file.

The three operators run in Arrow batches inside Spark tasks, need no shuffle and hold one output slice at a
time, so memory follows the largest single text and not the number of rows. A lost executor repeats only its
own partitions. Null texts count as empty, ids may repeat or be null (each row gives one row), and only the
two named columns are read, so other columns may be called anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Text bytes in one output slice.
SLICE_BYTES = 4_000_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], pa.Array]]:
    """(ids, texts with null as "", text bytes) of slices of the first two columns, each of about SLICE_BYTES."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        size = pc.fill_null(pc.binary_length(texts), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES)))
            yield ids[at:to], [t or "" for t in texts[at:to].to_pylist()], size[at:to]
            at = to


def int_lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))


def bpe_encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encodes every text by dynamic programming over its words' prefixes and decodes the ids again.

    Returns id_col, ids array<int>, decoded string: what the tokenizers library's encode(text,
    add_special_tokens=False) and decode(ids, skip_special_tokens=False) give. Empty text: no ids, "".
    """
    path = tokenizer or default_path()

    def run(batches):
        from .wordbpe import encoder

        own = encoder(path, "prefix")
        for ids, texts, _ in slices(batches):
            encoded = [own.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, int_lists(encoded), pa.array([own.decode(e) for e in encoded], pa.string())], ["id", "ids", "decoded"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: Characters whose class no tokenizer or Unicode version disputes, as parts of a character class.
_LETTERS = r"A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: No apostrophe (it may start a contraction) and no bar (special strings hold bars beside letters).
_SIGNS = r"!-&(-/:-@\[-`{}~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c-\u3011"
#: Places that end a word whatever stands around: behind white space, and between two of digit, letter and sign, or two digits.
BOUNDARY = re.compile(rf"(?<=[\t\n\v\f\r ])|(?<=[{_LETTERS}])(?=[0-9{_SIGNS}])|(?<=[0-9])(?=[0-9{_LETTERS}{_SIGNS}])|(?<=[{_SIGNS}])(?=[0-9{_LETTERS}])")


class Resync:
    """Encodes a huge text in overlapping windows.

    Two windows are spliced at a proven boundary in their overlap: a place where the file's word pattern ends a word
    whatever precedes or follows, where Unicode normalization joins nothing, and which lies in no special string. From the
    first such place the right window is as if it began there, up to the last one the left window is as if it went on;
    the tokens between must agree, so the splice is exact.

    Where an overlap holds no such place (one endless word), the left window is encoded anew from the last splice with
    twice its length, and the overlap is doubled too. Lengths grow geometrically, so the characters encoded stay
    within a small multiple of the text's, and an endless word costs what encoding it whole costs.
    """

    def __init__(self, path: str, window: int, overlap: int):
        from tokenizers import Tokenizer

        if not 0 < overlap < window:
            raise ValueError("0 < overlap < window is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.window, self.overlap = window, overlap
        self.windows = self.widened = self.encoded_chars = 0

    def encode(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        self.windows += 1
        self.encoded_chars += end - begin
        got = self.library.encode(text[begin:end], add_special_tokens=False)
        starts = np.array([o[0] for o in got.offsets], dtype=np.int64) + begin
        return np.array(got.ids, dtype=np.int64), starts

    def splice(self, text: str, left: tuple, right: tuple, begin: int, end: int) -> tuple[int, int] | None:
        """(tokens of left before the splice, first token of right after it) for the overlap text[begin:end]."""
        # a place needs the characters on both sides, so both ends of the overlap are left out
        safe = [m.start() for m in BOUNDARY.finditer(text, begin + 1, end - 1)]
        if len(safe) < 2:
            return None
        (li, lo), (ri, ro) = left, right
        a0, a1 = np.searchsorted(lo, [safe[0], safe[-1]])
        b0, b1 = np.searchsorted(ro, [safe[0], safe[-1]])
        if a1 == a0 or a1 - a0 != b1 - b0 or not (np.array_equal(lo[a0:a1], ro[b0:b1]) and np.array_equal(li[a0:a1], ri[b0:b1])):
            return None
        return int(a0), int(b0)

    def encode_whole(self, text: str) -> np.ndarray:
        n, parts = len(text), []
        begin, end, overlap = 0, min(len(text), self.window), self.overlap
        held = self.encode(text, begin, end)
        while end < n:
            start = max(begin, end - overlap)
            to = min(n, start + max(self.window, 2 * overlap))
            right = self.encode(text, start, to)
            if cut := self.splice(text, held, right, start, end):
                parts.append(held[0][: cut[0]])
                held = right[0][cut[1] :], right[1][cut[1] :]
                begin, end, overlap = int(held[1][0]), to, self.overlap
                continue
            self.widened += 1
            overlap *= 2
            end = min(n, begin + 2 * (end - begin))
            held = self.encode(text, begin, end)
        return np.concatenate([*parts, held[0]])


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 65_536, overlap: int = 2_048) -> DataFrame:
    """Token counts of whole texts; texts over `window` characters go through overlapping windows.

    Returns id_col, n_bytes long (UTF-8), n_tokens long, n_windows long (windows really encoded, those tried again
    with a wider overlap included). Empty and null text: 0 bytes, 0 tokens, 1 window. An empty table gives none.
    """
    path = tokenizer or default_path()

    def run(batches):
        from .wordbpe import encoder

        own, wide = encoder(path, "library"), Resync(path, window, overlap)
        for ids, texts, size in slices(batches):
            n, windows = [], []
            for t in texts:
                before = wide.windows
                n.append(len(own.encode(t)) // 4 if len(t) <= window else len(wide.encode_whole(t)))
                windows.append(max(1, wide.windows - before))
            yield pa.RecordBatch.from_arrays([ids, size.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(windows, pa.int64())], ["id", "n_bytes", "n_tokens", "n_windows"])

    kinds = [("id", df.schema[id_col].dataType), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("n_windows", T.LongType())]
    return id_and_text(df, id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds])).withColumnRenamed("id", id_col)
