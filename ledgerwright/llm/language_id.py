"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. For each bit a binary classifier tells the languages with a one from those with
a zero: a linear score over letter n-grams, hashed to a fixed number of buckets, whose weights are log ratios of
smoothed counts over all learning texts. A text's language is that whose codeword loses least against all bits' scores,
each bit weighted by how well it did on a bounded sample of the learning texts.

Cases: a null text or one without letters is `und` with score 0; a null language isn't learned; without a learned language all
is `und`; null ids count as empty text for the fold; repeated rows count each; an empty table gives an empty result; other columns
than those named aren't read. Whole texts count. The model has BUCKETS x bits weights whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

NO_LANG = "und"
LETTERS = regex.compile(r"\p{L}+")
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Learning texts on which the bits are weighted; the weights of n-grams come from all learning texts.
CALIBRATION_ROWS = 5_000
#: Distinct words cut, and rows of a batch judged, at once.
CHUNK, ROWS = 50_000, 2_000
#: Below this share of the total weight the best codeword's lead counts as ambiguous.
AMBIGUOUS = 0.1


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits of -1, 1
    weights: np.ndarray  # BUCKETS x bits
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))  # usual size of a bit's score
    trust: np.ndarray = field(default_factory=lambda: np.ones(1))  # weight of a bit's loss


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1. Up to five languages: all ways to part them in two; beyond, the best of 64 random codes by least distance."""
    if n <= 5:
        splits = range(1, max(1 << (n - 1), 2))
        return np.array([[1 if n == 1 or s >> i & 1 else -1 for s in splits] for i in range(n)], np.int8)
    bits, random, best = 15 + 4 * int(np.ceil(np.log2(n))), np.random.default_rng(n), (-1, None)
    for _ in range(64):
        code = np.where(random.random((n, bits)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(0)) < n]  # a bit that all share tells nothing
        nearest = int((code.shape[1] - code.astype(int) @ code.T.astype(int) + 2 * code.shape[1] * np.eye(n, dtype=int)).min() // 2)
        if nearest > best[0]:
            best = (nearest, code)
    return best[1]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def letter_words(texts: pa.Array) -> pa.ListArray:
    """Runs of letters of each text, lower case."""
    found = [LETTERS.findall((t or "").lower()) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array([w for words in found for w in words], pa.string()))


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the words, each set between blanks; n-grams are of code points."""
    points = np.frombuffer("".join(f" {w} " for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners, mixed = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        mixed = mixed[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(n)
        if n in SIZES:
            whole = owner[:len(mixed)] == owner[n - 1:]
            hashed = (mixed[whole] ^ (mixed[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((hashed >> np.uint64(48)).astype(np.int64))
            owners.append(owner[:len(mixed)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def gram_counts(learn: DataFrame) -> DataFrame:
    """lang, bucket, n over all texts: every distinct word of a batch is cut once and counts as often as it occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                met = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(sums[met], pa.float64())], ["lang", "bucket", "n"])
            held.clear()

        for batch in slices(batches):
            for lang in pc.unique(batch.column(0)).to_pylist():
                coded = letter_words(batch.column(1).filter(pc.equal(batch.column(0), lang))).flatten().dictionary_encode()
                times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                sums = held.setdefault(lang, np.zeros(BUCKETS))
                for at in range(0, len(coded.dictionary), CHUNK):
                    buckets, owners = grams(coded.dictionary[at:at + CHUNK])
                    sums += np.bincount(buckets, weights=times[at + owners], minlength=BUCKETS)
            if len(held) > 64:
                yield from out()
        yield from out()

    parts = learn.select("lang", "text").mapInArrow(count, "lang string, bucket int, n double")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def margins(lists: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean score of a text's n-grams for each bit, its number of n-grams); distinct words are scored once a batch."""
    coded = lists.flatten().dictionary_encode()
    n, bits = len(coded.dictionary), weights.shape[1]
    sums = np.zeros((n, bits + 1))
    for at in range(0, n, CHUNK):
        part = coded.dictionary[at:at + CHUNK]
        buckets, owners = grams(part)
        for b in range(bits):
            sums[at:at + len(part), b] = np.bincount(owners, weights=weights[buckets, b], minlength=len(part))
        sums[at:at + len(part), bits] = np.bincount(owners, minlength=len(part))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of, words = np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy(zero_copy_only=False)
    totals = np.stack([np.bincount(of, weights=sums[words, b], minlength=len(lists)) for b in range(bits + 1)], 1)
    return totals[:, :bits] / np.maximum(totals[:, bits:], 1), totals[:, bits]


def fit(learn: DataFrame) -> Model | None:
    """The model of a table of lang and text, whose nulls are left out; None without any language.

    Counts are summed over all rows, per bucket and bit; what reaches the driver is BUCKETS rows and the list of languages.
    """
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = sorted(r[0] for r in learn.select("lang").distinct().collect())
    if not langs:
        return None
    codes = codewords(len(langs))
    ones = F.create_map(*[x for lang, code in zip(langs, codes) for x in (F.lit(lang), F.array(*[F.lit(bool(b > 0)) for b in code]))])
    held = gram_counts(learn).withColumn("one", ones[F.col("lang")])
    sums = [F.sum(F.when(F.col("one")[b] == side, F.col("n")).otherwise(0.0)) for side in (True, False) for b in range(codes.shape[1])]
    rows = held.groupBy("bucket").agg(F.array(*sums).alias("sums")).toPandas()
    counts = np.zeros((BUCKETS, 2 * codes.shape[1]))
    if len(rows):
        counts[rows["bucket"].to_numpy()] = np.stack(rows["sums"].to_list())
    shares = (counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)
    weights = np.log(shares[:, :codes.shape[1]] / shares[:, codes.shape[1]:])
    model = Model(langs, codes, np.ascontiguousarray(weights) if len(langs) > 1 else np.ones((BUCKETS, 1)))
    return calibrated(model, learn)


def calibrated(model: Model, learn: DataFrame) -> Model:
    """The model with each bit's usual score and weight, log((1 - e) / e) of its error e.

    Judged are the CALIBRATION_ROWS texts of the least hashes (and copies of the last): only hashes are sorted for that, and
    what returns are sums for each bit.
    """
    hashed = learn.withColumn("h", F.xxhash64("text"))
    last = hashed.select("h").orderBy("h").limit(CALIBRATION_ROWS).agg(F.max("h")).first()[0]
    weights, codes, places = model.weights, model.codes, {lang: i for i, lang in enumerate(model.langs)}
    bits = weights.shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, n = margins(letter_words(batch.column(1)), weights)
            wanted = codes[[places[x] for x in batch.column(0).to_pylist()]]
            wrong = ((found * wanted <= 0) & (n[:, None] > 0)).sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(bits), pa.int32()), pa.array(wrong, pa.int64()), pa.array(np.abs(found).sum(0), pa.float64()), pa.array(np.full(bits, (n > 0).sum()), pa.int64())],
                ["bit", "wrong", "size", "n"])

    judged = hashed.where(F.col("h") <= last).select("lang", "text").mapInArrow(judge, "bit int, wrong long, size double, n long") if last is not None else None
    rows = judged.groupBy("bit").agg(*[F.sum(c).alias(c) for c in ("wrong", "size", "n")]).orderBy("bit").toPandas() if judged is not None else []
    if not len(rows) or rows["n"].iloc[0] == 0:
        return Model(model.langs, codes, weights, np.ones(bits), np.ones(bits))
    n = rows["n"].to_numpy()
    error = (rows["wrong"].to_numpy() + 1) / (n + 2)
    trust = np.maximum(np.log((1 - error) / error), 0.05)
    return Model(model.langs, codes, weights, np.maximum(rows["size"].to_numpy() / n, 1e-9), trust / trust.sum())


def decode(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the nearest codeword, its share among all, whether the next is about as near): logistic losses of all bits, weighted."""
    z = np.clip(found / model.scale, -30, 30)
    right, wrong = np.logaddexp(0, -2 * z) * model.trust, np.logaddexp(0, 2 * z) * model.trust
    ones = (model.codes > 0).astype(float)
    loss = right @ ones.T + wrong @ (1 - ones).T
    best = loss.argmin(1)
    share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    ordered = np.sort(loss, 1)
    close = ordered[:, 1] - ordered[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, share[np.arange(len(best)), best], close


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, lang_pred, score, ambiguous; only the text is read for them. The model is broadcast: BUCKETS x bits numbers."""
    if model is None:
        return docs.select(*keep, F.lit(NO_LANG).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        names = pa.array([*held.langs, NO_LANG], pa.string())
        for batch in slices(batches):
            found, n = margins(letter_words(batch.column(batch.num_columns - 1)), held.weights)
            best, share, close = decode(held, found)
            empty = n == 0
            best, share, close = np.where(empty, len(held.langs), best), np.where(empty, 0.0, share), close & ~empty
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], names.take(pa.array(best)), pa.array(share), pa.array(close)], [*keep, "lang_pred", "score", "ambiguous"])

    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(judge, fields + ", lang_pred string, score double, ambiguous boolean")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; rows with crc32(doc_id) % 4 = 2 are held out and never learned from."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    rows = docs.select("doc_id", "text", "lang", fold.alias("held_out"))
    return predict(rows, fit(rows.where(~F.col("held_out"))), ["doc_id", "held_out"])
