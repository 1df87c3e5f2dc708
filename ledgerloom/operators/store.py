"""A versioned store of positions whose rules are checked before a version is published."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """The newest row of each key; of equally new ones the greatest. Partial aggregation, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in key and c != by]
    return rows.groupBy(*key).agg(F.max(F.struct(by, *rest)).alias("_r")).select(*key, "_r.*").select(*rows.columns)


def changed_values(before: DataFrame, after: DataFrame, key: str, values: Sequence[str], locked: Column) -> DataFrame:
    """Rows locked in both versions of which a value differs: a version with any must not be published."""
    a, b = before.where(locked).alias("a"), after.where(locked).alias("b")
    differs = reduce(lambda x, y: x | y, [~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    return a.join(b, key).where(differs).select(key, *[F.col(f"a.{v}").alias(f"{v}_before") for v in values], *[F.col(f"b.{v}").alias(f"{v}_after") for v in values])


def vanished(before: DataFrame, after: DataFrame, key: Sequence[str], protected: Column) -> DataFrame:
    """Protected rows of the old version that the new one lacks."""
    return before.where(protected).join(after.select(*key), list(key), "left_anti")


def into_closed(inserts: DataFrame, closed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Inserts into groups that are closed."""
    return inserts.join(closed.select(*group).distinct(), list(group), "left_semi")


def latest_state(log: DataFrame, key: Sequence[str], state: str, number: str) -> DataFrame:
    """The newest entry of an append-only log of states."""
    return log.groupBy(*key).agg(F.max_by(state, number).alias(state), F.count("*").alias("entries"))


def merged(old: DataFrame, changes: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The new version: changed rows replaced, new rows added, others kept."""
    a = old.select(*key, *values, F.lit(True).alias("_old"))
    b = changes.select(*key, *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_new"))
    j = a.join(b, list(key), "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("update")
    return j.select(*key, *[F.when(F.col("_new"), F.col(f"_n_{v}")).otherwise(F.col(v)).alias(v) for v in values], action.alias("action"))


def protocol(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, field, before, after) of every value that changed."""
    a, b = old.alias("a"), new.alias("b")
    pairs = F.array(*[F.struct(F.lit(v).alias("feld"), F.col(f"a.{v}").cast("string").alias("vorher"), F.col(f"b.{v}").cast("string").alias("nachher")) for v in values])
    return a.join(b, key).select(key, F.inline(pairs)).where(~F.col("vorher").eqNullSafe(F.col("nachher")))


def field_merged(first: DataFrame, second: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two stores as one: a filled value of the second wins, an empty one never overwrites."""
    b = second.select(*key, *[F.col(v).alias(f"_b_{v}") for v in values])
    filled = lambda v: F.nullif(F.col(f"_b_{v}"), F.lit("")) if dict(second.dtypes)[v] == "string" else F.col(f"_b_{v}")
    return first.join(b, list(key), "full_outer").select(*key, *[F.coalesce(filled(v), F.col(v)).alias(v) for v in values])


def decisions_now(log: DataFrame, key: Sequence[str], action: str, by: str, tombstone: str) -> DataFrame:
    """The decisions in force: the newest of each key, withdrawn ones left out."""
    return log.groupBy(*key).agg(F.max_by(action, by).alias(action)).where(F.col(action) != tombstone)


def unfinished(stamped: DataFrame, done: DataFrame, key: str, stamps: Sequence[str]) -> DataFrame:
    """Rows to process again: those whose key and stamps the finished ones lack."""
    return stamped.join(done.select(key, *stamps).distinct(), [key, *stamps], "left_anti")


def renamed(rows: DataFrame, mapping: DataFrame, name: str, old: str, new: str) -> DataFrame:
    """Rows under their new names; names without an entry stay."""
    m = mapping.select(F.col(old).alias(name), F.col(new).alias("_new"))
    return rows.join(m, name, "left").withColumn(name, F.coalesce("_new", name)).drop("_new")


def superseded(rows: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """The rows that a newer one of their key replaces."""
    top = rows.groupBy(*key).agg(F.max(by).alias("_top"))
    return rows.join(top, list(key)).where(F.col(by) < F.col("_top")).drop("_top")


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of each key that are not the one to keep, by order."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def correction_states(confirmed: Column, self_entered: Column, value: Column, struck: Column, withdrawn: Column) -> Column:
    """withdrawn, struck, confirmed or open: a value is confirmed if ticked off, or typed in by a person, and neither
    struck nor withdrawn."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    typed = yes(self_entered) & (F.trim(F.coalesce(value, F.lit(""))) != "")
    return F.when(yes(withdrawn), "withdrawn").when(yes(struck), "struck").when(yes(confirmed) | typed, "confirmed").otherwise("open")


def struck(version: DataFrame, keys: DataFrame, key: Sequence[str], state: str, at: Column, to: str = "gestrichen") -> tuple[DataFrame, DataFrame]:
    """(new version, journal): the rows of ``keys`` set aside; the journal has what they were, so it can be undone."""
    hit = version.join(keys.select(*key, F.lit(True).alias("_hit")).distinct(), list(key), "left")
    change = F.coalesce("_hit", F.lit(False)) & ~F.col(state).eqNullSafe(F.lit(to))
    journal = hit.where(change).select(*key, F.lit("strike").alias("was"), F.col(state).alias("vorher"), F.lit(to).alias("nachher"), at.alias("zeitpunkt"))
    return hit.withColumn(state, F.when(change, F.lit(to)).otherwise(F.col(state))).select(*version.columns), journal


def restored(version: DataFrame, journal: DataFrame, keys: DataFrame, key: Sequence[str], state: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(new version, journal entries): the rows of ``keys`` as they were before their newest strike that still stands."""
    last = journal.groupBy(*key).agg(F.max(F.struct("zeitpunkt", "was", "vorher", "nachher")).alias("_j"))
    back = last.join(keys.select(*key).distinct(), list(key), "left_semi").where("_j.was = 'strike'")
    hit = version.join(back, list(key), "left")
    change = F.col("_j").isNotNull() & F.col(state).eqNullSafe(F.col("_j.nachher"))
    entries = hit.where(change).select(*key, F.lit("restore").alias("was"), F.col(state).alias("vorher"), F.col("_j.vorher").alias("nachher"), at.alias("zeitpunkt"))
    return hit.withColumn(state, F.when(change, F.col("_j.vorher")).otherwise(F.col(state))).select(*version.columns), entries


def loaded_once(rows: DataFrame, path: str) -> int:
    """Writes ``rows`` as the first version of a store and returns their number; a store with rows, or another number of
    rows read back than were given, is an error."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and not spark.read.parquet(path).isEmpty():
        raise ValueError(f"{path} holds a store already")
    given = rows.count()
    rows.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path).count()
    if stored != given:
        raise RuntimeError(f"{given} rows given, {stored} stored")
    return stored


def reextracted(version: DataFrame, fresh: DataFrame, key: Sequence[str], document: str, values: Sequence[str], stamp: str) -> DataFrame:
    """The version with the rows of each document in ``fresh`` replaced; a fresh row with the values it had before
    carries its old stamp over."""
    kept = version.join(fresh.select(document).distinct(), document, "left_anti")
    before = version.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.col(stamp).alias("_stamp"))
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values])
    carried = fresh.join(before, list(key), "left").withColumn(stamp, F.when(same & F.col("_stamp").isNotNull(), F.col("_stamp")).otherwise(F.col(stamp)))
    return kept.unionByName(carried.select(*version.columns))
