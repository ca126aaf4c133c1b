"""Removal of passages of lines that occurred before, by overlapping three-line windows. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import staged, unused

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each window of WINDOW neighbouring lines that aren't all blank: __id, __th (hash of the text), pos, h1, h2."""
    def windows(ls: Column) -> Column:
        def one(i: Column) -> Column:
            part = [F.get(ls, i + k) for k in range(WINDOW)]
            blank = ~F.concat(*part).rlike(r"\S")
            return F.struct(i.alias("pos"), F.xxhash64(*part).alias("h1"), F.hash(*part).alias("h2"), blank.alias("blank"))

        found = F.transform(F.sequence(F.lit(0), F.size(ls) - WINDOW), one)
        return F.when(F.size(ls) >= WINDOW, found)

    each = F.transform(F.array(lines_of(F.col(text_col))), windows)[0]
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__th"), F.explode(each).alias("w"))
    return rows.where(~F.col("w.blank")).select("__id", "__th", "w.pos", "w.h1", "w.h2")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Windows (96 bits of hash) that occur more than once, with the place of the first occurrence by (id, text hash, position)."""
    first = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__th", "pos")).alias("first")
    return windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).where("n > 1").select("h1", "h2", "first")


def drop_positions(ls: Column, starts: Column) -> Column:
    """Lines outside the windows that begin at the sorted positions `starts`; linear in the lines."""
    ends = F.concat(starts, F.array(F.size(ls)))
    kept = F.transform(ends, lambda p, i: F.transform(
        F.array(F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1) + WINDOW)),
        lambda begin: F.slice(ls, begin + 1, F.greatest(p - begin, F.lit(0))))[0])
    return F.flatten(kept)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every line that lies in a three-line window which occurred before, in any document or earlier in its own.

    Returns all columns with the shortened text, plus n_lines and n_removed_lines int. The order of occurrences
    is (id with null last, hash of the text, position); the first stays. Blank windows don't count. Texts with
    fewer than three lines never change, null texts stay null (0 lines), a text that loses all lines
    becomes "". Rows that repeat both id and text are one document: they lose the same lines. Columns named
    n_lines or n_removed_lines are replaced, all others stay whatever their names.

    Two shuffles carry windows (about 40 bytes each, repeated ones only in the join), one carries the texts.
    Copies are counted in each task before they are shuffled. Neither side of the join on windows is an
    aggregate (the repeated windows are a written table), so Spark may split the partition of a frequent one.
    """
    df = df.drop("n_lines", "n_removed_lines")
    windows = line_windows(df, id_col, text_col)
    repeated = staged(repeated_windows(windows))
    f = F.col("first")
    later = windows.join(repeated, ["h1", "h2"]).where(~(F.col("__id").eqNullSafe(f["__id"]) & (F.col("__th") == f["__th"]) & (F.col("pos") == f["pos"])))
    of, th, key, starts, cut = unused(df, "__of", "__th", "__key", "__starts", "__cut")
    hits = later.groupBy(F.col("__id").alias(of), F.col("__th").alias(th)).agg(F.sort_array(F.collect_set("pos")).alias(starts))
    keyed = df.withColumn(key, F.xxhash64(text_col))
    joined = keyed.join(hits, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(key) == F.col(th)), "left")
    ls = F.transform(F.array(lines_of(F.col(text_col))), lambda x: F.struct(
        F.size(x).alias("n"), F.when(F.col(starts).isNotNull(), drop_positions(x, F.col(starts))).alias("kept")))[0]
    out = joined.withColumn(cut, ls)
    n, kept = F.col(f"{cut}.n"), F.col(f"{cut}.kept")
    text = F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    made = {text_col: text, "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n), "n_removed_lines": F.when(F.col(starts).isNull(), 0).otherwise(n - F.size(kept))}
    return out.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in [*df.columns, "n_lines", "n_removed_lines"]])
