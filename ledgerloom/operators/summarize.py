"""Aggregates and calibration measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scale import running_totals


def with_total(rows: DataFrame, levels: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of every level and the total, which has NULL in the levels it sums over."""
    return rows.rollup(*levels).agg(F.grouping_id().alias("level"), *aggregates)


def strict_mode(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, NULL where two are equally frequent."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*key).agg(F.max("n").alias("most"))
    return counts.join(top, list(key)).where("n = most").groupBy(*key, "most").agg(F.when(F.count("*") == 1, F.min(value)).alias(value), F.count("*").alias("tied"))


def upper_median(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The element at n div 2 of the sorted values of each key.

    Values are counted first, and the counts summed up over range partitions: a key with most of the rows is many rows
    of many tasks, never one sorted list.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    sums = running_totals(counts, [*key, value], {"_upto": "_c"})
    whole = sums.groupBy(*key).agg(F.sum("_c").alias("n"), F.min(F.col("_upto") - F.col("_c")).alias("_before"))
    whole = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "n", "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    at = sums.join(whole, reduce(lambda a, b: a & b, same)).withColumn("_i", F.col("_upto") - F.col("_before"))
    return at.where("_i > n div 2 and _i - _c <= n div 2").select(*key, F.col(value).alias("median"), "n")


def pivoted(rows: DataFrame, key: Sequence[str], column: str, names: dict[str, str], rest: str = "andere") -> DataFrame:
    """Counts of the values of ``names`` in a column each, and of all other ones in ``rest``: no row is left out."""
    counts = [F.count_if(F.col(column) == v).alias(n) for v, n in names.items()]
    return rows.groupBy(*key).agg(*counts, F.count_if(~F.coalesce(F.col(column).isin(*names), F.lit(False))).alias(rest))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The chance that a wrong row scores above a right one, ties half; NULL if a class is empty.

    Counts by distinct score and their running sums over range partitions stand in for ranks of all rows.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    sums = running_totals(by, ["s"], {"upto": "neg"})
    parts = sums.withColumn("wins", F.col("pos") * (F.col("upto") - F.col("neg") * F.lit(0.5)))
    return parts.agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def calibration(rows: DataFrame, p: str, label: str, edges: Sequence[float]) -> DataFrame:
    """Right and wrong rows in each band of probability, and the Brier score of the band."""
    band = F.lit(0)
    for e in edges:
        band = band + (F.col(p) >= e).cast("int")
    y = F.col(label).cast("double")
    return rows.groupBy(band.alias("band")).agg(F.count_if(F.col(label)).alias("right"), F.count_if(~F.col(label)).alias("wrong"), F.round(F.avg((F.col(p) - y) ** 2), 6).alias("brier"))


def at_thresholds(rows: DataFrame, p: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold the rows below it, how many of them are wrong, and the wrong rows it misses.

    One pass: every threshold is a pair of conditional counts, turned into rows afterwards.
    """
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(p) < t).alias("shown"), F.count_if((F.col(p) < t) & ~F.col(label)).alias("hits"), F.count_if((F.col(p) >= t) & ~F.col(label)).alias("missed")) for t in thresholds]
    return rows.agg(F.array(*counts).alias("t")).select(F.inline("t"))


def state_counts(rows: DataFrame, key: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """One line a key with a count for each of the known states."""
    return rows.groupBy(*key).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def longest_spelling(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """The longest spelling of each key, of equally long ones the first, and how many spellings there are."""
    return rows.groupBy(*key).agg(F.max(F.struct(F.length(name).alias("n"), F.col(name).alias("v"))).alias("m"), F.countDistinct(name).alias("spellings")).select(*key, F.col("m.v").alias(name), "spellings")


def sole_row(rows: DataFrame, key: Sequence[str], wanted: Column, value: str) -> DataFrame:
    """The value of the one row of each key that is wanted; a finding and no value where none or several are."""
    n = F.count_if(wanted)
    state = F.when(n == 0, "fehlt").when(n > 1, "mehrdeutig")
    return rows.groupBy(*key).agg(F.when(n == 1, F.max(F.when(wanted, F.col(value)))).alias(value), state.alias("befund"))


def majority(rows: DataFrame, key: Sequence[str], column: str, votes: Sequence[tuple[Column, str]]) -> DataFrame:
    """What a column means: each row votes by the first test that holds; the meaning with most votes, NULL on a tie."""
    meaning = None
    for test, label in votes:
        meaning = F.when(test, label) if meaning is None else meaning.when(test, label)
    counted = rows.withColumn("_m", meaning).where("_m is not null")
    return strict_mode(counted.withColumnRenamed("_m", "bedeutung"), [*key, column], "bedeutung").select(*key, column, "bedeutung")
