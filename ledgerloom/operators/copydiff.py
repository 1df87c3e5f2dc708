"""Differences between two copies of a table by content-defined chunks.

Each side is reduced to a key hash (128 bits), the newest time and a 64-bit hash of the compared values, by partial
aggregation first, so a key that holds a third of all rows is a few rows a task by then. Sorted by key hash, a side is
cut after each row at which a rolling hash of the last keys meets a condition, so an inserted or lost row moves only
the cuts next to it. Chunks whose fingerprint the other side has too are dropped by an anti-join of the fingerprints;
only then are values read, of the keys in the other chunks, and compared field by field. No value is shuffled before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import amount_cents, bound
from ledgerloom.session import cut

#: Keys of unmatched chunks that are sent to all workers at 16 bytes each; more are joined by a shuffle.
SENT_KEYS = 500_000
MEAN_ROWS, WINDOW = 4, 3  #: rows of a chunk on average, and keys under the rolling hash
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass(frozen=True)
class Field:
    """A compared field: its name in the report, its Column and how it is compared."""

    name: str
    column: Column
    kind: str = "text"  # text | amount | token | number
    tolerance: float = 0.0


def _canonical(f: Field) -> Column:
    """The value as text that is equal for equal values; NULL and '' are the same."""
    raw = f.column.cast("string")
    if f.kind == "amount":
        text = F.lower(F.trim(raw))
        other = F.when(text != "", F.concat(F.lit("t:"), text))
        return bound(amount_cents(raw), lambda cents: F.when(cents == 0, F.lit("0.00")).when(cents.isNotNull(), cents.cast("string")).otherwise(other))
    if f.kind == "token":
        text = F.regexp_replace(F.lower(F.trim(raw)), "[ _]+", "_")
        return F.when(text != "", text)
    return F.when(raw != "", raw)


def _stable(f: Field, value: Column) -> Column:
    """What enters the fingerprint: equal only if the field has no difference to report."""
    if f.kind == "number" and f.tolerance:
        digits = max(0, len(f"{1 / f.tolerance:.0f}") - 1)
        return F.round(value.try_cast("double"), digits).cast("string")
    return value


def _differs(f: Field, a: Column, b: Column) -> Column:
    if f.kind == "number":
        x, y = a.try_cast("double"), b.try_cast("double")
        apart = F.round(F.abs(x - y), 9) > f.tolerance
        return F.coalesce(apart, ~a.eqNullSafe(b))
    return ~a.eqNullSafe(b)


@dataclass(frozen=True)
class Pair:
    """Two copies of a table under one name, each with its key, its compared fields and what makes a row newer."""

    name: str
    left: DataFrame
    right: DataFrame
    left_key: Column
    right_key: Column
    left_fields: Sequence[Field]
    right_fields: Sequence[Field]
    left_newest: Column
    right_newest: Column

    @property
    def sides(self) -> tuple:
        return (self.left, self.left_key, self.left_fields, self.left_newest), (self.right, self.right_key, self.right_fields, self.right_newest)


def _keys(name: str, key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(name), key).alias("k1"), F.xxhash64(F.lit("second"), F.lit(name), key).alias("k2")]


def hashed(df: DataFrame, key: Column, fields: Sequence[Field], newest_by: Column, name: str = "") -> DataFrame:
    """(k1, k2, r): each row as hashes: of its key, and r of its time and values."""
    stable = [F.coalesce(_stable(f, _canonical(f)), F.lit("\u0000")) for f in fields]
    return df.select(*_keys(name, key), F.struct(newest_by.alias("at"), F.xxhash64(key, *stable).alias("h")).alias("r"))


def newest_hashes(rows: DataFrame) -> DataFrame:
    """(k1, k2, h): the newest row of each key."""
    return rows.groupBy("k1", "k2").agg(F.max("r").alias("r")).select("k1", "k2", F.col("r.h").alias("h"))


def cuts(k1: np.ndarray, mean_rows: int = MEAN_ROWS) -> np.ndarray:
    """After which rows a sorted run of keys is cut: where the rolling hash of the last keys is a multiple."""
    keys = k1.view(np.uint64)
    rolling = keys * _MIX[0]
    for i in range(1, WINDOW):
        rolling[i:] += keys[:-i] * _MIX[i]
    return np.flatnonzero((rolling >> np.uint64(20)) % np.uint64(mean_rows) == 0)


def _chunks(mean_rows: int):
    """Rows (bucket, k1, k2, h), sorted -> a row a chunk: bucket, fingerprint, number of rows and their keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None  # rows of a bucket after its last cut, with the keys before them
        seen = 0  # of these, keys already in a chunk: they only take part in the rolling hash
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            at = 0
            while at < len(columns[0]):
                bucket = columns[0][at]
                upto = at + int(np.searchsorted(columns[0][at:], bucket, side="right"))
                part = [c[at:upto] for c in columns]
                if left is not None and left[0][0] == bucket:
                    part = [np.concatenate(x) for x in zip(left, part)]
                elif left is not None:
                    yield from _chunk(left, seen, [len(left[0]) - 1])
                    seen = 0
                ends = [int(e) for e in cuts(part[1], mean_rows) if e >= seen]
                if ends:
                    yield from _chunk(part, seen, ends)
                last = ends[-1] + 1 if ends else seen
                keep = max(0, last - WINDOW + 1)
                left, seen = [c[keep:] for c in part], last - keep
                at = upto
        if left is not None:
            yield from _chunk(left, seen, [len(left[0]) - 1])

    return run


def _chunk(part: list[np.ndarray], first: int, ends: list[int]) -> Iterator[pa.RecordBatch]:
    """The chunks of rows from ``first`` on that end at ``ends``."""
    if ends[-1] < first:
        return
    starts = np.array([first, *(e + 1 for e in ends[:-1])])
    stop = ends[-1] + 1
    prints = np.add.reduceat(part[3][:stop].view(np.uint64), starts).view(np.int64)
    offsets = pa.array(np.append(starts, stop) - first, pa.int32())
    keys = [pa.ListArray.from_arrays(offsets, pa.array(part[i][first:stop], pa.int64())) for i in (1, 2)]
    columns = [pa.array(part[0][starts], pa.int32()), pa.array(prints, pa.int64()), pa.array(np.diff(np.append(starts, stop)), pa.int32()), *keys]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "fp", "n", "k1", "k2"])


def chunked(rows: DataFrame, *, mean_rows: int = MEAN_ROWS) -> DataFrame:
    """(bucket, fp, n, k1, k2): the chunks of rows (k1, k2, h), k1 and k2 as arrays.

    A bucket is what one shuffle partition holds of the aggregation by key before, so nothing is shuffled again; were
    a bucket ever split over tasks, its chunks would only match less.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.hash("k1", "k2"), F.lit(parts)).cast("int").alias("bucket")
    ordered = rows.select(bucket, "k1", "k2", "h").sortWithinPartitions("bucket", "k1", "k2")
    return ordered.mapInArrow(_chunks(mean_rows), "bucket int, fp bigint, n int, k1 array<bigint>, k2 array<bigint>")


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """(k1, k2): the keys in chunks of which the other side has no equal fingerprint."""
    by = ["bucket", "fp", "n"]
    both = left.join(right.select(by), by, "left_anti").unionByName(right.join(left.select(by), by, "left_anti"))
    return both.select(F.inline(F.arrays_zip("k1", "k2")))


def diff_pairs(pairs: Sequence[Pair], *, mean_rows: int = MEAN_ROWS) -> DataFrame:
    """(tabelle, schluessel, spalte, art): keys only one side of a pair has, and each field that differs.

    Null or empty values are equal to each other and differ from zero; a NULL key is compared as ''. Repeated and
    superseded rows are reduced to the newest first, one of equally new ones counts; extra columns are never read; an
    empty side makes every key of the other one a difference, two empty sides an empty result. All pairs share one run
    of chunks: the name of the pair is part of the key.
    """
    rows = [reduce(DataFrame.unionByName, [hashed(df, key, fields, by, p.name) for p in pairs for df, key, fields, by in p.sides[n : n + 1]]) for n in (0, 1)]
    asked = cut(unmatched(*[chunked(newest_hashes(r), mean_rows=mean_rows) for r in rows]))
    few = asked.count() <= SENT_KEYS
    return reduce(DataFrame.unionByName, [_differences(p, asked, few) for p in pairs])


def _differences(pair: Pair, asked: DataFrame, few: bool) -> DataFrame:
    def values(n: int, df: DataFrame, key: Column, fields: Sequence[Field], by: Column) -> DataFrame:
        rows = df.select(*_keys(pair.name, key), key.alias("key"), by.alias("at"), *[f.column.alias(f"c{i}") for i, f in enumerate(fields)])
        if few:
            rows = rows.join(F.broadcast(asked), ["k1", "k2"], "left_semi")
        value = F.struct(*[_canonical(Field(f.name, F.col(f"c{i}"), f.kind, f.tolerance)).alias(f"f{i}") for i, f in enumerate(fields)])
        return rows.select("k1", "k2", "key", F.lit(n).alias("side"), F.struct("at", value.alias("v")).alias("r"))

    of = lambda n: F.max(F.when(F.col("side") == n, F.col("r")))
    rows = values(0, *pair.sides[0]).unionByName(values(1, *pair.sides[1]))
    if few:
        both = rows.groupBy("key").agg(of(0).alias("x"), of(1).alias("y"))
    else:  # aggregated before the join, so that a key of many rows is none in it
        both = rows.groupBy("k1", "k2", "key").agg(of(0).alias("x"), of(1).alias("y")).join(asked, ["k1", "k2"], "left_semi")
    both = both.select("key", F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    one_sided = F.when(F.col("b").isNull(), "nur_original").when(F.col("a").isNull(), "nur_kopie")
    changed = F.array_compact(
        F.array(*[F.when(_differs(f, F.col(f"a.f{i}"), F.col(f"b.f{i}")), F.lit(f.name)) for i, f in enumerate(pair.left_fields)])
    )
    found = F.when(one_sided.isNotNull(), F.array(F.struct(F.lit("").alias("spalte"), one_sided.alias("art")))).otherwise(
        F.transform(changed, lambda c: F.struct(c.alias("spalte"), F.lit("weicht_ab").alias("art")))
    )
    return both.select(F.lit(pair.name).alias("tabelle"), F.col("key").alias("schluessel"), F.inline(found))


def diff_copies(left: DataFrame, right: DataFrame, *, mean_rows: int = MEAN_ROWS, **columns) -> DataFrame:
    """(schluessel, spalte, art) of ``diff_pairs`` for one pair; ``columns`` are the other arguments of ``Pair``."""
    return diff_pairs([Pair("", left, right, **columns)], mean_rows=mean_rows).drop("tabelle")
