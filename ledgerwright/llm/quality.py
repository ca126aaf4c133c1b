"""Quality rules: plain text statistics, then a hashed n-gram log-likelihood ratio. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import unused

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Buckets of hashed n-grams unless the caller passes another number; the two count vectors and the weights have this size.
BUCKETS = 16_384
#: Lowest length-normalised ratio (nats for one n-gram) that is kept.
MIN_RATIO = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def bound(column: Column, then) -> Column:
    """then(x) with x = column computed once a row, however often `then` uses it."""
    return F.transform(F.array(column), then)[0]


def words(text: Column) -> Column:
    """White-space separated words, no empty ones."""
    inner = F.btrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def word_hashes(ws: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(ws, lambda w: F.xxhash64(w))


def doubled(hashes: Column, step: int) -> Column:
    """Hash of every run of 2 * step words from the hashes of runs of `step` words; the last places are no whole runs."""
    return bound(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))


def repeated_words(pairs: Column, n: Column) -> Column:
    """How many of a text's n words lie in 8-word windows that occur at least twice in it; `pairs`: doubled(word_hashes, 1).

    Windows are compared by 64-bit hashes. A window that occurs again holds five 4-word runs that have occurred
    before, so texts with fewer repeated runs are done after one hash set. In the others equal hashes are brought
    together by sorting, and the marked starts are summed up in order: n log n in a text's words.
    """
    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            marked = F.transform(s, lambda x, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        return bound(bound(ordered, starts), lambda at: F.aggregate(
            at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 30)).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(8), i - acc["last"])).cast("long").alias("n"), i.alias("last")),
            lambda acc: acc["n"]))

    def by_runs(runs: Column) -> Column:
        again = bound(F.slice(runs, F.lit(1), n - 3), lambda r: F.size(r) - F.size(F.array_distinct(r)))
        return F.when(again < 5, F.lit(0).cast("long")).otherwise(count(F.slice(doubled(runs, 4), F.lit(1), n - 7)))

    return F.when(n < 9, F.lit(0).cast("long")).otherwise(bound(doubled(pairs, 2), by_runs))


def whole_pairs(pairs: Column) -> Column:
    """`pairs` without its last place, which holds no whole pair."""
    return F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))


def bucket(gram_hash: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(gram_hash, F.lit(buckets)).cast("int")


def text_rules(df: DataFrame, text_col: str = "text", h1: str = "__h1", h2: str = "__h2") -> DataFrame:
    """Adds the base statistics and the columns h1, h2 (hashes of words and of pairs) to all columns of df; a null text counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed boolean.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    (ws,) = unused(df, "__words")
    split = df.withColumn(ws, words(text)).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        word_hashes(F.col(ws)).alias(h1),
    )
    out = split.withColumn(h2, doubled(F.col(h1), 1)).withColumn("n_repeat_words", repeated_words(F.col(h2), F.size(h2)))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def gram_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket int, n long over all rows. Counts are summed in each task before at most `buckets` rows a task are shuffled.

    Only the words' hashes are exploded; a word's pair is formed from the array that stays beside it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = df.select(word_hashes(words(text)).alias("h"))
    each = hashed.select("h", F.posexplode("h").alias("i", "g"))
    behind = F.get("h", F.col("i") + 1)
    grams = each.select("g", F.when(behind.isNotNull(), F.xxhash64("g", behind)).alias("p"))
    two = grams.select(F.explode(F.array("g", "p")).alias("gram")).where("gram IS NOT NULL")
    return two.select(bucket(F.col("gram"), buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def ratio_weights(raw: DataFrame, trusted: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> Column:
    """A constant array<double>[buckets]: log p_trusted - log p_raw by bucket, to 4 digits.

    p_raw has one added count a bucket. p_trusted has `buckets` added counts shared out by p_raw, so little trusted text
    moves the ratio little. The `buckets` numbers pass through the driver; nothing else does, whatever the corpus size.
    """
    both = gram_counts(raw, text_col, buckets).select("bucket", "n", F.lit(0).cast("long").alias("t")).unionByName(
        gram_counts(trusted, text_col, buckets).select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("t")))
    slots = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("t"))
    by = both.unionByName(slots).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # `buckets` rows, whatever the corpus size
    one = by.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "t"))).alias("a"), F.sum("n").alias("sn"), F.sum("t").alias("st"))
    ratio = F.transform("a", lambda x: F.round(F.log((x["t"] * F.col("sn") / x["n"] + buckets) / (F.col("st") + buckets)), 4))
    # a folded constant: a subquery is not allowed inside higher-order functions, and a joined array would be copied to each row
    return F.from_json(F.lit(one.select(F.to_json(ratio)).first()[0]), "array<double>")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of all rows with quality 1; an id stands as often as it is labelled."""
    return labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("__trusted")).where(F.col("__trusted").isNotNull())


def score_documents(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_ratio: float = MIN_RATIO, buckets: int = BUCKETS) -> DataFrame:
    """All columns of df plus the base statistics, ratio double and kept boolean.

    ratio is the mean, over a document's single words and word pairs, of the log-likelihood ratio of their hashed
    bucket between all documents labelled with quality 1 and all documents. kept is false if base_failed, else ratio >= min_ratio.
    Null and empty texts have ratio 0 and fail the base rules. Without any trusted row (no labels, or none that
    meets a document) both models would be empty, so ratio is 0 and only the base rules decide. Repeated
    rows are scored alike. Columns of df named like an added one are replaced, all others stay whatever their names.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]
    df = df.drop(*own)
    ids = trusted_ids(labels)
    # the labels grow with the corpus, so they are never broadcast
    trusted = df.select(F.col(id_col).alias("__id"), F.col(text_col)).join(ids.hint("merge"), F.col("__id") == F.col("__trusted"), "left_semi")
    weights = ratio_weights(df.select(text_col), trusted.select(text_col), text_col, buckets)
    h1, h2 = unused(df, "__h1", "__h2")
    ruled = text_rules(df, text_col, h1, h2)
    n_grams = F.greatest(2 * F.size(h1) - 1, F.lit(1))
    summed = lambda hashes, first: F.aggregate(hashes, first, lambda acc, h: acc + F.get(weights, bucket(h, buckets)))
    total = summed(whole_pairs(F.col(h2)), summed(F.col(h1), F.lit(0.0))) / n_grams
    scored = ruled.withColumn("ratio", F.coalesce(F.round(total, 9), F.lit(0.0)))
    # a generator of one row: a later filter on `kept` stays above it, instead of computing all scores a second time
    verdict = F.struct(F.col("ratio"), (~F.col("base_failed") & (F.col("ratio") >= min_ratio)).alias("kept"))
    return scored.select(*[F.col(f"`{c}`") for c in ruled.columns if c not in (h1, h2)], F.inline(F.array(verdict)))
