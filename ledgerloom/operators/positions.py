"""Numbers of positions: running, kept, free and renewed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.scale import numbered_globally, salted


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "pos_new") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def kept_or_next(rows: DataFrame, group: Sequence[str], order: Sequence[str], given: str, out: str = "pos_new") -> DataFrame:
    """A given number stays and raises the counter of its group; a row without one takes the counter's next number.

    The counter after a row is the number n of open rows so far plus the greatest (given - n at that row) so far, or
    plus 0: two running windows instead of a fold.
    """
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumn("_n", F.sum(F.col(given).isNull().cast("int")).over(w))
    raised = F.greatest(F.coalesce(F.max(F.col(given) - F.col("_n")).over(w), F.lit(0)), F.lit(0))
    return counted.withColumn(out, F.coalesce(F.col(given), F.col("_n") + raised).cast("int")).drop("_n")


def lowest_free(rows: DataFrame, group: Sequence[str], order: Sequence[str], given: str, out: str = "pos_new") -> DataFrame:
    """A given number stays; rows without one get the lowest numbers their group has not used, in order.

    Free numbers are the gaps between the used ones, made per group from ranks: the n-th free number is n plus the
    used numbers not above it, found by an equi-join on the running number.
    """
    used = rows.where(F.col(given).isNotNull()).select(*group, F.col(given).alias("u")).distinct()
    open_rows = rows.where(F.col(given).isNull())
    need = open_rows.groupBy(*group).agg(F.count("*").alias("need"))
    top = used.groupBy(*group).agg(F.count("*").alias("taken"))
    span = need.join(top, list(group), "left").select(*group, F.explode(F.sequence(F.lit(1), (F.col("need") + F.coalesce("taken", F.lit(0))).cast("int"))).alias("u"))
    free = span.join(used, [*group, "u"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy(*group).orderBy("u")))
    asked = open_rows.withColumn("n", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    filled = asked.join(free, [*group, "n"]).select(*rows.columns, F.col("u").cast("int").alias(out))
    return rows.where(F.col(given).isNotNull()).withColumn(out, F.col(given).cast("int")).unionByName(filled)


def next_ids(rows: DataFrame, existing: DataFrame, id_col: str, prefix: str, width: int, order: Sequence[str]) -> DataFrame:
    """New ids after the greatest existing number, never reused; the offset is one aggregated value, the running
    number comes from range partitions."""
    top = existing.agg(F.max(F.substring(id_col, len(prefix) + 1, 20).try_cast("bigint"))).first()[0] or 0
    numbers = numbered_globally(rows, order, "_n")
    return numbers.withColumn(id_col, F.concat(F.lit(prefix), F.lpad((F.col("_n") + F.lit(top)).cast("string"), width, "0"))).drop("_n")


def duplicates_marked(rows: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """Rows with the first source that holds the same key and the number of other ones; every row stays.

    Both are aggregates: a key that many sources hold is no list, and its rows are spread over the parts of
    ``salted``.
    """
    distinct = rows.groupBy(*key, source).agg(F.count("*"))
    several = distinct.groupBy(*key).agg(F.min(source).alias("first_source"), (F.count(source) - 1).alias("others")).where("others > 0")
    return salted(rows, several, list(key), "left").withColumn("others", F.coalesce("others", F.lit(0)))


def free_names(rows: DataFrame, wish: str, existing: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """A name for each row: the wish, or the wish with -2, -3 ... past the names that exist and those given before."""
    stem = existing.select(F.regexp_replace(name, "-\\d+$", "").alias(wish), F.coalesce(F.nullif(F.regexp_extract(name, "-(\\d+)$", 1), F.lit("")).try_cast("int"), F.lit(1)).alias("k"))
    taken = stem.groupBy(wish).agg(F.max("k").alias("_k"))
    n = F.row_number().over(W.partitionBy(wish).orderBy(*order))
    at = F.coalesce("_k", F.lit(0)) + F.col("_n")
    return rows.withColumn("_n", n).join(taken, wish, "left").withColumn("free_name", F.when(at == 1, F.col(wish)).otherwise(F.concat(F.col(wish), F.lit("-"), at.cast("string")))).drop("_n", "_k")
