import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerwright.llm import packing, tokens, wordbpe

PATH = tokens.default_path()
TEXTS = [
    None, "", "  ", "<|endoftext|>x<|startoftext|>", "It's we'll DON'T 123 x1y2 a###'s", "été ǅ İstanbul ΑΣ ΣΑΣ.", "日本語 テスト 한국어", "áé ö", "\x1c\x1d a\x85b\xa0c　d",
    "😀😀👍🏽 x<|endoftext|", "𝔘𝔫𝔦 ½ ²³ ªº", "tab\tsep\r\nline", "a" * 3000, "\x00\x01 zero", "ŉ ß ẞ ﬁ", "thethethethethe ingingabab", "internationalization unbelievably", "word " * 700]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_prefix_table_equals_library_on_random_words():
    own, lib, rnd = wordbpe.PrefixBpe(PATH), library(), random.Random(5)
    for _ in range(3000):
        word = "".join(rnd.choice("etaoinshrdluabcé") for _ in range(rnd.randint(1, 14)))
        assert own.encode_word(word) == lib.encode(word, add_special_tokens=False).ids, word
    for same in ("a" * 9, "ab" * 12, "aab" * 7, "0" * 3):
        assert [i for w in (same,) for i in own.encode_word(w)] == lib.encode(same, add_special_tokens=False).ids or same.isdigit()


def test_both_encoders_equal_the_library_on_odd_texts():
    """Capital I with dot, marks in either order, other scripts, digits of them, special strings: whatever is normalised once must not be again."""
    rnd = random.Random(11)
    odd = ["\u0130", "\u0327", "\u0338", "\u0316", "\u0307", "i", "I", "\u00e9", "e\u0301", "\u00df", "\u1e9e", "\u03a3", "\u03c2", "\u0660", "\u00bd", "\u2167", "\u4e2d", "\ud55c", "\u1112\u1161", "\U0001f389", "\u200d", "\u00a0", "\u2028", "\x00",
           "<|endoftext|>", "<|", "'s", "'", "a", "b1", " ", "  ", "\n", "\t", ".", "_"]
    kinds = {kind: wordbpe.TextEncoder(PATH, wordbpe.PrefixBpe(PATH).encode_word if kind == "prefix" else None) for kind in ("prefix", "library")}
    texts = ["".join(rnd.choices(odd, k=rnd.randint(1, 9))) for _ in range(20_000)] + ["\u0130\u0327", "\u0130\u0338", "a \u0130\u0316b"]
    for text, want in zip(texts, library().encode_batch(texts, add_special_tokens=False)):
        for kind, own in kinds.items():
            assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids, (kind, text)


def test_memo_that_overflows_gives_the_same(monkeypatch):
    monkeypatch.setattr(wordbpe, "MAX_WORDS", 3)
    monkeypatch.setattr(wordbpe, "MAX_PAIRS", 2)
    own, lib = wordbpe.TextEncoder(PATH, wordbpe.PrefixBpe(PATH).encode_word), library()
    for text in TEXTS:
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids


def test_encode_decode_and_counts(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "no id", "x")], "doc_id long, text string, ids string")
    lib = library()
    got = tokens.bpe_encode_decode(df).collect()
    counts = {(r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df).collect()}
    assert len(got) == len(TEXTS) + 2
    want = [(k, t or "") for k, t in enumerate(TEXTS)] + [(0, "again"), (None, "no id")]
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.ids, r.decoded))
    for k, t in want:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (ids, lib.decode(ids, skip_special_tokens=False)) in by[k]
        assert (k, len(t.encode()), len(ids)) in counts
    assert tokens.bpe_encode_decode(df.where("false")).count() == 0 and tokens.count_tokens(df.where("false")).count() == 0


@pytest.mark.parametrize("window, overlap", [(50, 3), (300, 20), (1000, 64)])
def test_windows_resynchronise(window, overlap):
    wide, lib, rnd = tokens.Resync(PATH, window, overlap), library(), random.Random(window)
    made = [" ".join("".join(rnd.choice("abcdefé'1<|>") for _ in range(rnd.randint(1, 30))) for _ in range(300)) for _ in range(5)]
    for text in [*made, "abc" * 400, "x<|endoftext|>y " * 60, "\n" * 500 + "a"]:
        assert wide.encode_whole(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_unbroken_texts_take_linear_time():
    lib, rnd = library(), random.Random(4)
    cjk = "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(150_000))
    base64 = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400_000))
    for text, most in (("abcdefghij" * 100_000, 4), (cjk, 4), (base64, 1.2), ("x" * 150_000 + " one two" * 30_000, 4), ("<|endoftext|>" * 12_000, 4), ("e\u0301" * 60_000, 4)):
        wide = tokens.Resync(PATH, 65_536, 2_048)
        began = time.time()
        got = wide.encode_whole(text)
        took, began = time.time() - began, time.time()
        want = lib.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want and wide.encoded_chars <= most * len(text)
        assert took < 10 * (time.time() - began) + 2


def test_counts_of_windowed_texts(spark):
    rnd = random.Random(6)
    texts = [None, "", "short", "a" * 900, "x1" * 400, " ".join(rnd.choice(["alpha", "be,ta", "g4mma", "don't", "\u65e5\u672c\u3002", "<|endoftext|>"]) for _ in range(700)), "\u00e9" * 500 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(df, window=120, overlap=16).collect()}
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(library().encode(t or "", add_special_tokens=False).ids)
        assert got[k].n_bytes == len((t or "").encode()) and (got[k].n_windows == 1) == (len(t or "") <= 120)


def test_packing_is_whole_and_gapless(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "gamma", "12"]) for _ in range(rnd.choice([0, 3, 40, 400, 3000])))) for k in range(120)] + [(7, "twice"), (7, "twice"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lib, cap = library(), 256
    got = [r.asDict() for r in packing.pack_documents(df, capacity=cap).collect()]
    want = []
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), cap)):
            cut = np.array(ids[at : at + cap], "<u4")
            want.append((k, p, at, len(cut), zlib.crc32(cut.tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(by) <= 1.05 * -(-sum(r["length"] for r in got) // cap) + 2
    assert packing.pack_documents(df.where("false")).count() == 0


def test_sum_of_squares_follows_its_rule():
    """Each choice leaves the smallest sum of squares of open-sequence counts, recomputed from scratch."""
    rnd, cap = random.Random(1), 20
    lengths = [rnd.randint(1, cap) for _ in range(200)]
    sequence, offset = packing.sum_of_squares(np.array(lengths), cap)
    fill = {}

    def squares(f):
        counts = defaultdict(int)
        for x in f.values():
            if x < cap:
                counts[cap - x] += 1
        return sum(c * c for c in counts.values())

    for s, at, off in zip(lengths, sequence.tolist(), offset.tolist()):
        options = {squares(fill | {q: x + s}) for q, x in fill.items() if x + s <= cap} | {squares(fill | {"new": s})}
        assert fill.get(at, 0) == off
        fill[at] = off + s
        assert squares(fill) == min(options)


def test_bad_piece_lengths_raise(spark):
    df = spark.createDataFrame([(1, 5000)], "k long, length long")
    with pytest.raises(Exception, match="capacity"):
        packing.pack_pieces(df, 1, ["k"]).collect()
