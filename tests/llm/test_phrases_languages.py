import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from ledgerwright.llm import language_id, phrases


def brute(docs, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    rows = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in held.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, text, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, text.decode(), -a, l, r, totals[lang], -score))
    return sorted(rows)


def sample(n, seed):
    dice, words = random.Random(seed), ["the", "of", "A", "a", "été", " x", "zz", "new", "york", "city", "İ", "ß", "🎉"]
    ends = [" ", "\t", "  ", ", ", ".", "\n", "!\r\n", " \x0b"]
    docs = []
    for _ in range(n):
        text = "".join(dice.choice(["new york city", dice.choice(words), dice.choice(words)]) + dice.choice(ends[:3] if dice.random() < 0.8 else ends) for _ in range(dice.randint(0, 40)))
        docs.append((dice.choice([text, text.upper()]), dice.choice(["en", "en", "fr", None, "und", "a b", ""])))
    return [*docs, (None, "en"), ("", "fr"), ("new york " * 5_000, "en"), *docs[:5]]


def spark_docs(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, words string, id int").repartition(3)


def test_phrases_by_brute_force(spark):
    docs = sample(200, 3)
    got = sorted(tuple(r) for r in phrases.mine_phrases(spark_docs(spark, docs), top=30).collect())
    assert got == brute(docs, 10, 30)
    assert phrases.mine_phrases(spark_docs(spark, docs).where("false")).count() == 0
    assert phrases.mine_phrases(spark_docs(spark, docs[:1])).count() == 0


def test_phrases_over_many_vocabularies_and_tries(spark, monkeypatch):
    docs = sample(60, 4)
    monkeypatch.setattr(phrases, "PART", 7)
    monkeypatch.setattr(phrases, "TRIE_PART", 9)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert sorted(tuple(r) for r in phrases.mine_phrases(spark_docs(spark, docs), least=4).collect()) == brute(docs, 4, 2000)


def test_scores_beyond_64_bits(spark):
    big = spark.sql("SELECT 900000000000 AS a, 1000000000000 AS l, 999999999999 AS r")
    assert big.select(phrases.score_of("l", "r")).first()[0] == 1_000_000 * 900_000_000_000**2 // (10**12 * (10**12 - 1))


def test_trie_finds_its_candidates_alone():
    dice = np.random.default_rng(2)
    for n, words in ((0, 3), (1, 1), (50, 20), (3_000, 70_000), (20_000, 300)):
        two = np.unique(((dice.random((n, 2)) ** 3) * words).astype(np.int32), axis=0)
        three = np.unique(dice.integers(0, words, (n, 3)).astype(np.int32), axis=0)
        trie, known = phrases.Trie([two, three], words), [tuple(x) for x in [*two.tolist(), *three.tolist()]]
        text = np.concatenate([dice.integers(-1, words, 2_000), *(np.array([*k, -1]) for k in known[:200]), np.zeros(0, int)]).astype(np.int32)
        place = {k: i for i, k in enumerate(known)}
        found = [(k + 1, int(p), int(c)) for k, (at, which) in enumerate(trie.walk(text, 3)) for p, c in zip(at, which)]
        tuples = [(k, i, place[t]) for k in (1, 2, 3) for i in range(len(text) - k + 1) if (t := tuple(text[i:i + k].tolist())) in place]
        assert sorted(found) == sorted(tuples)


SYLLABLES = {"xx": "ka lo mi zu tek", "yy": "schru böt ung ier ach", "zz": "qui été oux ois ette", "ww": "дом кот мир лес рек", "vv": "漢字 水火 山川 日月 木金", "uu": "nth ing wh ost ly"}


def made(n, seed):
    dice, rows = random.Random(seed), []
    for i in range(n):
        lang = dice.choice(list(SYLLABLES))
        word = lambda: "".join(dice.choices(SYLLABLES[lang].split(), k=dice.randint(1, 3)))
        rows.append((i, " ".join(word() for _ in range(dice.randint(3, 40))), lang))
    return rows


def test_codewords_keep_apart():
    for n in (1, 2, 3, 4, 5, 6, 12, 60):
        code = language_id.codewords(n).astype(int)
        distance = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len(code) == n and (n == 1 or min(distance) >= (1 if n < 4 else 4)) and set(np.unique(code)) <= {-1, 1}


def test_held_out_accuracy_and_odd_rows(spark):
    rows = made(400, 1) + [(1_000, None, "xx"), (1_001, "", "yy"), (1_002, "12 ½ !?", "zz"), (1_003, "катомир " * 20_000, None), (None, "kalomi tek", "xx"), (1, "ignored twice", None)]
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, lang string, score int, words string").repartition(3)
    got = [r.asDict() for r in language_id.identify_languages(df).collect()]
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:400]}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1_000, 1_001, 1_002)] == ["und"] * 3 and by[1_000]["score"] == 0 and by[1_003]["lang_pred"] == "ww"


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    df = spark.createDataFrame(made(150, 2), "doc_id long, text string, lang string")
    fold = "crc32(cast(doc_id AS string)) % 4 = 2"
    turned = df.selectExpr("doc_id", "text", f"CASE WHEN {fold} THEN 'wrong' ELSE lang END AS lang", "'a' AS source")
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify_languages(x).collect()} for x in (df, turned))
    assert a == b
    unlearned = language_id.identify_languages(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}
    assert language_id.identify_languages(df.where("false")).count() == 0
    one = language_id.identify_languages(df.where("lang = 'xx'")).collect()
    assert {r.lang_pred for r in one} == {"xx"}


def test_confusable_texts_are_ambiguous(spark):
    model = language_id.fit(spark.createDataFrame(made(200, 3), "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, "kalo qui"), (2, "kalomi zutek kamilo tekka lozu")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(mixed, model, ["doc_id"]).collect()}
    assert got[2].lang_pred == "xx" and not got[2].ambiguous and got[1].score < got[2].score
