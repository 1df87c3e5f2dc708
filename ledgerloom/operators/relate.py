"""Joins the ledger needs, each planned so that only rows that can match meet."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.scale import salted
from ledgerloom.operators.words import windows


def without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks; NULL keys match nothing and stay."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def by_first_name(rows: DataFrame, entries: DataFrame, names: Sequence[Column], key: str, take: Sequence[str]) -> DataFrame:
    """Rows with the entry found under their current name, or else under the first older one that has an entry."""
    ranked = F.array_distinct(F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), n.alias("name")) for i, n in enumerate(names)]), lambda c: c["name"].isNotNull()))
    row = [c for c in rows.columns]
    asked = rows.select(*row, F.inline(ranked))
    hits = asked.join(entries.select(F.col(key).alias("name"), *take), "name")
    best = hits.groupBy(*row).agg(F.min(F.struct("rank", *take)).alias("hit"))
    return rows.join(best, row, "left").select(*row, *[F.col(f"hit.{c}").alias(c) for c in take])


def unique_lookup(dimension: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key where all its rows agree; keys with several values are left out."""
    return dimension.groupBy(key).agg(F.min(value).alias(value), F.countDistinct(value).alias("n")).where("n = 1").drop("n")


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison: same, changed, only_left or only_right for each key."""
    a = left.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_a"))
    b = right.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_b"))
    state = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, "before", "after", state.alias("state"))


def replaced(run: DataFrame, store: DataFrame, doc: str) -> DataFrame:
    """The rows of a run, but those of every document the store owns replaced by its rows."""
    return run.join(store.select(doc).distinct(), doc, "left_anti").unionByName(store, allowMissingColumns=True)


def paired(left: DataFrame, right: DataFrame, group: Sequence[str], mark: str, left_key: str, right_key: str) -> DataFrame:
    """Pairs within a group: first by a mark that is unique on either side, the rest by position.

    Both steps are equi-joins, the second one on (group, running number): no group is multiplied by itself.
    """
    once = lambda df, k: df.where(F.col(mark).isNotNull() & (F.col(mark) != "")).groupBy(*group, mark).agg(F.min(k).alias(k), F.count("*").alias("n")).where("n = 1").drop("n")
    marked = once(left, left_key).join(once(right, right_key), [*group, mark]).select(*group, left_key, right_key, F.lit("mark").alias("art"))
    rest = lambda df, k: df.join(marked.select(k), k, "left_anti").select(*group, k, F.row_number().over(W.partitionBy(*group).orderBy(k)).alias("n"))
    zipped = rest(left, left_key).join(rest(right, right_key), [*group, "n"]).select(*group, left_key, right_key, F.lit("position").alias("art"))
    return marked.unionByName(zipped)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, take: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key not later than it.

    Both sides are stacked and the last seen right row is carried forward by a window, so the work is one sort per
    key and never a range join. Ties take the right row with the greatest values.
    """
    r = right.groupBy(*keys, right_time).agg(F.max(F.struct(*take)).alias("_r")).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), "_r", F.lit(None).cast(_struct(left)).alias("_l"))
    lft = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = r.unionByName(lft).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in take])


def _struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType


def in_range(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, low: str, high: str, width: float) -> DataFrame:
    """Points inside ranges, by bands of ``width``: a range is listed under each band it touches, a point under one."""
    band = F.floor(F.col(point) / width).cast("bigint")
    spread = ranges.withColumn("_band", F.explode(F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor(F.col(high) / width).cast("bigint"))))
    return points.withColumn("_band", band).join(spread, [*keys, "_band"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_band")


def covered(items: DataFrame, stock: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Items with whether the stock covers them: the first n of a key, where the stock holds n of it."""
    n = stock.groupBy(*keys).agg(F.count("*").alias("_stock"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return items.withColumn("_rank", rank).join(n, list(keys), "left").withColumn("covered", F.coalesce(F.col("_rank") <= F.col("_stock"), F.lit(False))).drop("_rank", "_stock")


def contained(sets: DataFrame, items: DataFrame, owner: Sequence[str], set_key: Sequence[str], tokens: str, item_tokens: str, item: str) -> DataFrame:
    """Items all of whose tokens are in a set of the same owner, each pair once.

    An item is looked for under the token of it that fewest sets of its owner have; sets that have that token are
    tested whole. A token in a third of all sets thus meets only items that have no rarer one.
    """
    a = sets.select(*owner, *set_key, F.array_distinct(tokens).alias("_set")).withColumn("_t", F.explode("_set"))
    n = a.groupBy(*owner, "_t").agg(F.count("*").alias("_n"))
    each = items.select(*owner, item, F.array_distinct(item_tokens).alias("_need")).withColumn("_t", F.explode("_need"))
    found = each.join(n, [*owner, "_t"], "left").groupBy(*owner, item, "_need").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_t")).alias("_r"))
    rare = found.where("_r.n > 0").select(*owner, item, "_need", F.col("_r._t").alias("_t"))
    hit = salted(a, rare, [*owner, "_t"]).where(F.size(F.array_except("_need", "_set")) == 0)
    return hit.select(*owner, *set_key, item).distinct()


def phrases(words: DataFrame, dictionary: DataFrame, doc: Sequence[str], order: str, phrase: str, most: int) -> DataFrame:
    """Occurrences of dictionary phrases of up to ``most`` words: the longest at each word, read from the left, none
    overlapping one taken before.

    Hits are found by an equi-join; only runs of hits that overlap each other, which are short whatever the length of
    the document, are read one after the other.
    """
    runs = windows(words, doc, order, most=most).withColumn("_key", F.lower("window"))
    hits = runs.join(dictionary.select(F.lower(phrase).alias("_key")).distinct(), "_key")
    longest = F.row_number().over(W.partitionBy(*doc, "start").orderBy(F.desc("size")))
    firsts = hits.withColumn("_n", longest).where("_n = 1").select(*doc, "start", "size", "window")
    w = W.partitionBy(*doc).orderBy("start")
    reach = F.max(F.col("start") + F.col("size")).over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = firsts.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    runs_of = opened.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, end, keep = pdf.sort_values("start"), None, []
        for start, size in zip(pdf["start"], pdf["size"]):
            keep.append(end is None or start >= end)
            if keep[-1]:
                end = start + size
        return pdf[keep].drop(columns="_run")

    return runs_of.groupBy(*doc, "_run").applyInPandas(greedy, firsts.schema)
