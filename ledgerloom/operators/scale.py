"""Global order without a single task: numbers and running sums over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut


def running_totals(rows: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each ``new: column`` of ``sums``, the sum of the column over all rows up to this one.

    Rows are partitioned by range of ``order``; each partition sums for itself and the totals of the partitions
    before it, one row a partition, are added. Rows equal in ``order`` count in the order they are met.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.sortWithinPartitions(*order))
    w = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = ranged.select("*", *[F.sum(c).over(w).alias(f"_in_{n}") for n, c in sums.items()])
    totals = ranged.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    joined = within.join(F.broadcast(offsets), "_p")
    return joined.select(*rows.columns, *[(F.col(f"_in_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def numbered_globally(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """A running number from 1 over all rows in ``order``."""
    return running_totals(rows.withColumn("_one", F.lit(1)), order, {out: "_one"}).drop("_one")


SALTS = 32  #: parts into which the rows of one key are spread


def salted(rows: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key or a small number: rows of a key are spread over ``SALTS``
    parts by the task that reads them, each part with its own copy of the rows of ``few``."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(spread, [*keys, "_salt"], how).drop("_salt")
