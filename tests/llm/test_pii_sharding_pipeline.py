import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerwright.llm import pii, sharding, tokens

TEXTS = {
    1: "mail an.34@mail4.example.com, call +1 (017) 555-7713 or 4952935900253052.", 2: "card 4111 1111 1111 1111 bad 4111111111111112 ssn 123-45-6789 000-12-3456", 3: "2021-03-04 and 4.3.2021 or 03/04/2021, 31/12/1999; 2021-02-30 1799-01-01",
    4: "ip 97.51.17.173. and 300.1.1.1 v 1.2.3", 5: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" again an.34@mail4.example.com 4111-1111-1111-1111', 6: None, 7: "", 8: "plain words 12 345 6,789 at 10:30 on page 2024", 9: "AN.34@mail4.example.com|97.51.17.173|2021-03-04"}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    df = spark.createDataFrame([(*r, 5) for r in TEXTS.items()], "doc_id long, text string, n_found int")
    out = pii.pseudonymise(df, "k")
    assert out.columns == ["doc_id", "text", "n_found", "n_changed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].text is None and got[7].text == "" and got[8].text == TEXTS[8] and got[8].n_found == 0
    for k, t in TEXTS.items():
        if t:
            shape = lambda x: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", x)))
            loose = lambda x: re.sub(r"9+", "9", re.sub(r"[0-9a-f]{40}", "h", x))
            # octets and parts of dates may get another number of digits, hexadecimal digits may become letters
            assert shape(got[k].text) == shape(t) if k not in (3, 4, 5, 9) else loose(shape(loose(got[k].text))) == loose(shape(loose(t)))
    card = re.search(r"card ([\d ]{19})", got[2].text)[1]
    assert luhn(card) and card != "4111 1111 1111 1111" and "4111111111111112" in got[2].text and "000-12-3456" in got[2].text
    assert re.sub(r"\D", "", card) == re.sub(r"\D", "", got[5].text.split()[-1])
    mail = re.search(r"\S+@\S+(?=,)", got[1].text)[0]
    assert mail in got[5].text and mail != "an.34@mail4.example.com"
    iso, dotted, slashed = re.match(r"(\S+) and (\S+) or (\S+),", got[3].text).groups()
    y, m, d = map(int, iso.split("-"))
    assert list(map(int, dotted.split("."))) == [d, m, y] and list(map(int, slashed.split("/"))) == [m, d, y]
    assert "2021-02-30" in got[3].text and "1799-01-01" in got[3].text and "300.1.1.1" in got[4].text and "v 1.2.3" in got[4].text
    assert re.search(r"ip (\S+?)\. ", got[4].text)[1] == got[9].text.split("|")[1] and got[9].text.split("|")[2] == iso
    assert re.fullmatch(r'token = "[0-9a-f]{40}" again .*', got[5].text)
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "another").collect()}
    assert other[1] != got[1].text and out.where("false").count() == 0


def test_permutations_are_one_to_one(spark):
    n = pii.DAYS_A * pii.DAYS_B
    days = spark.range(n).select(pii.feistel_number(F.col("id"), pii.DAYS_A, pii.DAYS_B, "k", "date").alias("x"))
    assert days.agg(F.count_distinct("x"), F.min("x"), F.max("x")).first() == (n, 0, n - 1)
    for width in (1, 3, 4):
        text = spark.range(10**width).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), width, "0"), "k", "card").alias("x"))
        assert text.distinct().count() == 10**width


def test_shards_split_only_where_needed(spark):
    rows = [(k, "x" * (k * 37 % 400)) for k in range(400)] + [(9, "z" * 300)] * 40 + [(1000, "y" * 9000), (None, None), (5, None), (6, "")]
    limit = 4000
    got = sharding.shard_documents(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, depth string"), limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    size, count, total = defaultdict(int), Counter(r.shard for r in got), defaultdict(int)
    for r in got:
        size[r.shard] += r.n_bytes
        assert len(r.shard) == r.depth
    for shard, b in size.items():
        assert b <= limit or count[shard] == 1
        for k in range(len(shard)):
            total[shard[:k]] += b
    assert all(b > limit for b in total.values()) and all(r.shard_bytes == size[r.shard] for r in got)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    one = sharding.shard_documents(spark.createDataFrame(rows[:3], "doc_id long, text string"), 10**9).collect()
    assert {(r.depth, r.shard) for r in one} == {(0, "")}
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), limit).count() == 0


def split(rows, limit, depth=0):
    """Buckets of extendible hashing by recursion: {prefix: rows}."""
    if sum(b for _, b in rows) <= limit or len(rows) == 1 or len({k for k, _ in rows}) == 1:
        return {"".join(f"{rows[0][0] % 2**64:064b}"[:depth]): rows} if rows else {}
    bit = lambda r: (r[0] % 2**64) >> (63 - depth) & 1
    return split([r for r in rows if not bit(r)], limit, depth + 1) | split([r for r in rows if bit(r)], limit, depth + 1)


def test_shards_equal_a_recursive_split(spark):
    rnd = random.Random(2)
    keys = [rnd.getrandbits(64) - 2**63 for _ in range(300)] + [(5 << 58) + k for k in range(40)] + [77] * 20
    rows = [(k, rnd.randrange(200)) for k in keys]
    for limit in (100, 1000, 10**6):
        got = sharding.assign_shards(spark.createDataFrame(rows, "bits long, size long"), "bits", "size", limit).collect()
        want = Counter((k, b, name) for name, part in split(rows, limit).items() for k, b in part)
        assert Counter((r.bits, r["size"], r.shard) for r in got) == want


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    prose = [" ".join(f"{w}{(i * 7 + k * 3) % 97}" for k in range(40) for w in ("the", "of")) + f"\nline {i}\nend {i}" for i in range(20)]
    block = "\n".join(f"shared line {k} of a passage that repeats" for k in range(5))
    rows = [(i, t + (f"\n{block}" if i % 4 == 0 else "") + f"\nmail a{i}.b@x{i}.example.com", "en", "s", 1) for i, t in enumerate(prose)] + [(100, None, "en", "s", 0), (101, "too short", "en", "s", 9), (102, prose[3] + "\nmail a3.b@x3.example.com", "de", "t", 5)]
    rows += [rows[7], rows[7]]  # repeated rows
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(20)) | {102}
    lines = {r.doc_id: r for r in corpus_pipeline.line_windows(spark, kept, str(tmp_path)).collect()}
    assert 102 not in lines and block in lines[0].text and all(block not in lines[i].text for i in range(4, 20, 4))
    assert all(r.n_chars == len(r.text) for r in lines.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(lines) and sum(r.length for r in got) > 0
    final = corpus_pipeline.pseudonyms(spark, corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(lines.values()), docs.schema), str(tmp_path)), str(tmp_path))
    from ledgerwright.llm.wordbpe import encoder

    own = encoder(tokens.default_path(), "library")
    want = Counter()
    for r in final.collect():
        assert not re.search(rf"\ba{r.doc_id}\.b@", r.text)
        whole = np.r_[np.frombuffer(own.encode(r.text), "<u4"), 0]
        want.update((r.doc_id, p, len(whole[at : at + 2048])) for p, at in enumerate(range(0, len(whole), 2048)))
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
