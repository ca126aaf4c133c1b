from collections import Counter, defaultdict

from ledgerwright.llm import sharding


def test_every_row_is_written_once(spark, tmp_path):
    rows = [(k, f"{k} " * 30, "c") for k in range(60)] + [(None, "no id", "a"), (None, "no id", "a"), (None, None, "b")] + [(7, f"text {k} " * 20, "d") for k in range(30)] + [(7, "same " * 20, "e")] * 10
    path, limit = str(tmp_path / "shards"), 1000
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, depth string"), path, limit)
    got = spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert got.columns == ["doc_id", "text", "depth"] and Counter(map(tuple, got.collect())) == Counter(rows)
    size, n = defaultdict(int), Counter()
    for r in got.select("text", "_metadata.file_path").collect():
        shard = r.file_path.split("/")[-2]
        size[shard] += len(r.text or "")
        n[shard] += 1
    assert len(size) > 5 and all(b <= limit or n[s] == 1 for s, b in size.items())
