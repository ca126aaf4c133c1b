import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerwright.llm import chat, quality

NASTY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 0, "us:e\\r\n", ":a\\"), (1, 1, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 3, "user", "#### </turn></turn>\n### user: x"),
         (3, 1, "assistant", "b\\"), (3, 0, "assistant", "\\\\a"), (None, None, "assistant", "no ids"), (4, 0, "system", "only"), (5, 0, "assistant", "x" * 5000)]


def test_examples_read_back(spark):
    df = spark.createDataFrame([(*r, "extra") for r in NASTY], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.format_prefix_targets(df)
    got = {r.conv_id: r for r in chat.conversation_digests(examples).collect()}
    by = defaultdict(list)
    for c, t, role, text in NASTY:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for r in examples.collect():  # only the reply is trainable, and all that precedes it is context
        shown = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert r.target_no is None or r.formatted == r.formatted[: r.loss_start] + shown + "</turn>\n"
    assert examples.where("conv_id = 3").count() == 2 and examples.where("conv_id = 4 AND target_no IS NULL").count() == 1
    assert chat.conversation_digests(chat.format_prefix_targets(df.where("false"))).count() == 0


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules_and_verdicts(spark):
    prose = [" ".join(f"{w}{(i * 7 + k * 3) % 97}" for k in range(60) for w in ("the", "of")) for i in range(40)]
    junk = [" ".join(f"&&{i * 100 + k}##" for k in range(80)) for i in range(8)]
    odd = [None, "", " \n\t ", "a b", "x " * 500, "line one\n\nline one\n \nline two", "é z " * 3, " ".join(map(str, range(30))) + " " + " ".join(map(str, range(8)))]
    texts = prose + junk + odd + [prose[0]]
    df = spark.createDataFrame([(k, t, "n", 1.5) for k, t in enumerate(texts)], "doc_id long, text string, n_words string, ratio double")
    labels = spark.createDataFrame([(k, 1) for k in range(20)] + [(45, 0), (None, 1), (3, 1), (99_999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_documents(df, labels).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
    assert all(got[k].kept for k in range(40)) and not any(got[k].kept for k in range(40, 48))
    assert got[len(texts) - 1].ratio == got[0].ratio and got[40 + 8].ratio == 0
    none = quality.score_documents(df, labels.where("false"))
    assert all(r.kept == (not r.base_failed) for r in none.collect())
    assert quality.score_documents(df.where("false"), labels).count() == 0


def test_gram_counts_equal_a_loop(spark):
    texts = ["a b a b", "c", "", None, "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = [p for t in texts for w in [(t or "").split()] for p in [(x,) for x in w] + list(zip(w, w[1:]))]
    h = {}
    for p in set(pairs):
        one = spark.createDataFrame([p], [f"c{i}" for i in range(len(p))])
        row = one.select(*[F.xxhash64(c).alias(c) for c in one.columns])
        key = "c0" if len(p) == 1 else "h"
        row = row if len(p) == 1 else row.select(F.xxhash64("c0", "c1").alias("h"))
        h[p] = row.first()[key] % quality.BUCKETS
    want = Counter(h[p] for p in pairs)
    assert {r.bucket: r.n for r in quality.gram_counts(df).collect()} == dict(want)
