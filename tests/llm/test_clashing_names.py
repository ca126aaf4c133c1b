"""Extra columns that are called like columns the operators make for themselves."""

from pyspark.sql import functions as F

from ledgerwright.llm import line_dedup, pii, quality
from ledgerwright.llm.scratch import unused

PASSAGE = "one line here\nanother line there\nand a third one\n"
NAMES = ["__id", "__th", "__key", "__starts", "__of", "__cut", "__l", "__h1", "__h2", "__words", "__new", "__trusted", "pos", "h1", "h2", "first", "n", "a.b", "_tokens", "kept_before"]


def docs(spark):
    rows = [(1, PASSAGE + "alone"), (2, "before\n" + PASSAGE), (3, "card 4111 1111 1111 1111, mail ann@example.com, " + "word " * 30), (4, None), (5, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return plain, plain.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in NAMES])


def same(plain, extra, names):
    kept = {r.doc_id: r for r in extra.select("doc_id", *[F.col(f"`{c}`") for c in NAMES]).collect()}
    assert all(r[c] == f"{c} {i}" for i, r in kept.items() for c in NAMES) and len(kept) == 5
    rows = lambda df: sorted(map(tuple, df.select("doc_id", *names).collect()), key=str)
    assert rows(plain) == rows(extra)


def test_line_dedup_keeps_other_columns(spark):
    plain, extra = docs(spark)
    got = line_dedup.dedup_lines(plain)
    assert {r.doc_id: r.n_removed_lines for r in got.collect()}[2] == 3
    same(got, line_dedup.dedup_lines(extra), ["text", "n_lines", "n_removed_lines"])


def test_quality_keeps_other_columns(spark):
    plain, extra = docs(spark)
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    same(quality.score_documents(plain, labels), quality.score_documents(extra, labels), ["n_words", "n_repeat_words", "ratio", "kept"])


def test_pseudonyms_keep_other_columns(spark):
    plain, extra = docs(spark)
    got = pii.pseudonymise(plain, "key")
    assert got.agg(F.sum("n_changed")).first()[0] == 2
    same(got, pii.pseudonymise(extra, "key"), ["text", "n_found", "n_changed"])


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "__A int, ___a int")
    assert unused(df, "__a", "__a", "b") == ["____a", "_____a", "b"]
