import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import scratch, components, embedding_dedup, line_dedup, minhash
from ledgerwright.sources.shared import shared_folder


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rnd = random.Random(kind)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(60)] + [(3, 3)], "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)], "none": []}[kind]
    df = spark.createDataFrame(links + [(None, 4), (5, None)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    want = roots({x for p in links for x in p}, links)
    lone = {n for n in want if all(a == b for a, b in links if n in (a, b))}
    assert got == {n: r for n, r in want.items() if n not in lone}


LINES = [(1, "a\nb\nc\nd\na\nb\nc"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (None, "a\nb\nc"), (3, None), (4, ""), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "a\nb"), (8, "q\nr\ns\nt\nu"), (9, "p\nq\nr\ns\nt\nu\nv"), (10, "q\nr\ns\nt\nu"), (2, "other\nrow\nsame\nid")]


def test_line_windows_against_a_loop(spark):
    rnd = random.Random(4)
    many = [(100 + k, "\n".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    df = spark.createDataFrame([(*r, 9) for r in LINES + many], "doc_id long, text string, n_lines int")
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    seen, want = set(), {}
    for no, doc, _, text in sorted({(d is None, d or 0, hashes[d, t], t) for d, t in LINES + many if t is not None}):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip() for x in w):
                gone |= {i, i + 1, i + 2} if w in seen else set()
                seen.add(w)
        want[None if no else doc, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed_lines"]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in out.collect())
    assert got == Counter((d, *want[d, t]) if t is not None else (d, None, 0, 0) for d, t in LINES + many)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def brute_components(rows, words):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    sets = defaultdict(set)
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] |= {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    ids = [d for d in sets if d is not None]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, roots(ids, links), links


def near_rows():
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(70):  # copies of one text with edits: pairs around the threshold, linked by way of others
        w = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4, 5, 6, 8])):
            w[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((3000 + k, " ".join(w)))
    texts = [t for _, t in rows]
    rnd.shuffle(texts)
    rows = [(3000 + k, t) for k, t in enumerate(texts)]
    return rows + [(4000, "a b"), (4001, "A  b"), (4002, "a b c d"), (4003, None), (4004, ""), (4005, " \n"), (None, "a b"), (4006, "b a"), (4000, "a b"), (4007, "é É x y z"), (4008, "é É X y z"), (4009, "one"), (4010, "ONE\n")]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_against_all_pairs(spark, words):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bands string")
    sizes, want, links = brute_components(rows, words)
    got = minhash.near_duplicates(df, words=words).collect()
    assert len(got) == len(rows) and len(links) > 100
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_circulant_signature_estimates_similarity():
    rnd = np.random.default_rng(2)
    common, one, two = (rnd.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    s = minhash.signatures(np.concatenate([common, one, common, two]), np.array([900, 900]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.13
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.second_permutation(x.copy()))) == len(x)


def brute_vectors(rows, threshold):
    unit = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = Counter(x for p in links for x in p)
    return n, roots([i for i, _ in rows], links), len(links)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    vs = list(rng.standard_normal((200, 32)))
    centre = rng.standard_normal(32)
    vs += [centre + rng.standard_normal(32) * 0.18 for _ in range(80)]
    vs += [vs[5], vs[5] * 2.0, vs[5], np.zeros(32), np.full(32, np.nan), np.array([np.inf] + [0.0] * 31), None, rng.standard_normal(8), vs[7] * 1e-200, np.ones(32) * 1e200, np.array([])]
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vs)] + [(900, [1.0, None])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, keys string")
    n, want, links = brute_vectors(rows, 0.95)
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got) / 2
    assert found >= 0.99 * links > 50
    for r in got:
        assert r.n_links <= n[r.vec_id] and (found < links or r.component_id == want[r.vec_id]) and r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.near_duplicate_vectors(df.where("false")).count() == 0


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    turn = embedding_dedup.rotation(64, 1)
    assert np.allclose(turn @ turn.T, np.eye(64))
    a, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 600, 64)))
    q = a * 0.6 + q * 0.8
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    (code, factor, _, _), (_, _, query, step) = embedding_dedup.codes(a, 1), embedding_dedup.codes(q, 1)
    assert code.shape == (600, 8) and query.dtype == np.int8
    assert np.abs(query * step[:, None] - q @ turn).max() <= step.max() / 2 + 1e-12
    true = a @ q.T
    bound = embedding_dedup.upper_bounds(code, factor, query, step, 64)
    assert (bound >= true).all()
    spread = (embedding_dedup.SIGMAS * np.sqrt(1 - factor**2) / factor / np.sqrt(63))[:, None] + np.sqrt(64) / 2 * step[None, :] / factor[:, None]
    assert abs((bound - spread - true).mean()) < 0.01  # the estimate in the middle of the bounds has no bias
    near = a + 0.3 / 8 * rng.standard_normal((600, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    close = (a * near).sum(axis=1)
    _, _, query, step = embedding_dedup.codes(near, 1)
    for least in (0.9, 0.95):
        bound = np.diag(embedding_dedup.upper_bounds(code, factor, query, step, 64, least))
        assert (close >= least).sum() > 100 and (bound[close >= least] >= least).all()


def test_near_duplicate_rows_are_documents_of_their_own(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    near = one.replace("a39", "c39")
    rows = [(5, one), (5, one), (5, two), (3, near), (None, two), (None, near), (7, None), (7, None), (8, ""), (None, "lone words of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect())
    assert got == Counter([(3, near), (5, two), (7, None), (7, None), (8, ""), (None, "lone words of its own here")])
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS __row")
    assert minhash.drop_near_duplicates(named).count() == 6 and minhash.drop_near_duplicates(df.where("false")).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        minhash.near_duplicates(named)


def test_staged_tables_are_removed_when_asked(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch.cleared(spark):
        assert scratch.staged(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
