from pyspark.sql import functions as F

from ledgerwright.llm import quality


def test_every_labelled_document_counts(spark):
    """Labelled ids missing from the documents, however many, take no labelled document out of the trusted model."""
    df = spark.createDataFrame([(k, " ".join(f"{w}{(k * 7 + i * 3) % 97}" for i in range(60) for w in ("the", "of"))) for k in range(40)], "doc_id long, text string")
    labels = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    absent = spark.range(1000, 81_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    ratios = lambda table: {r.doc_id: r.ratio for r in quality.score_documents(df, table).collect()}
    assert ratios(labels.unionByName(absent)) == ratios(labels)
    assert quality.trusted_ids(labels.unionByName(absent)).count() == 80_020


def test_buckets_are_a_parameter(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{k * 500 + i}" for i in range(500))) for k in range(20)], "doc_id long, text string")
    assert quality.gram_counts(df).count() < 15_000 and quality.gram_counts(df, buckets=1 << 26).count() >= 19_970  # 19,980 grams
    labels = spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, quality int")
    by = {b: {r.doc_id: r.ratio for r in quality.score_documents(df, labels, buckets=b).collect()} for b in (64, 1 << 17)}
    gap = {b: min(v[k] for k in range(5)) - max(v[k] for k in range(5, 20)) for b, v in by.items()}
    assert gap[1 << 17] > gap[64] and gap[1 << 17] > 0
