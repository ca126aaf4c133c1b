"""Word shingles of whole texts as 64-bit hashes, for Arrow arrays of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once.
SPAN = 1 << 20
#: An odd base of the polynomial over a word's bytes, and an odd factor between the words of a shingle.
BASE, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public-domain splitmix64 generator; a permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), BASE, np.uint64)], dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); A-Z are lower-cased, white space is 0x20 and 0x09 to 0x0D."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before, behind = np.r_[False, word[:-1]], np.r_[word[1:], False]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    inner = offsets[1:][offsets[1:] > 0]
    behind[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~behind) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    length = ends - starts
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN)))
        size = length[at:to]
        first = np.r_[0, np.cumsum(size)[:-1]]
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        letters = data[np.repeat(starts[at:to], size) + place].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(letters * powers(int(size.max()))[place], first)
        at = to
    return mix(out + length.astype(np.uint64) * FACTOR), counts


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, text after text; number of them by text).

    A text with fewer than `words` words has its whole word sequence as one shingle, a text without words none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    many = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    place = np.arange(int(many.sum())) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many) if len(many) else np.empty(0, np.int64)
    start = np.repeat(ends - counts, many) + place
    size = np.repeat(np.minimum(counts, words), many)
    made = mix(size.astype(np.uint64))
    for k in range(words):
        has = size > k
        made[has] = mix(made[has] * FACTOR + hashes[start[has] + k])
    out, sizes = [], np.zeros(len(counts), np.int64)
    at = 0
    for i, m in enumerate(many.tolist()):
        if m:
            own = np.unique(made[at : at + m])
            out.append(own)
            sizes[i] = len(own)
            at += m
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes
