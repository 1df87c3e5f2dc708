"""Rules over wide rows: named tests that yield findings, penalties and levels, all parameters given by the caller."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A finding with its code and severity where ``broken`` holds; NULL operands never break a rule."""

    code: str
    severity: str
    broken: Column


def findings(rows: DataFrame, key: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """(key, code, severity): one row a finding."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c.broken, F.lit(False)), F.struct(F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"))) for c in checks]))
    return rows.select(*key, F.inline(found))


def codes(checks: Sequence[Check]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c.broken, F.lit(False)), F.lit(c.code)) for c in checks]))


def off_sum(total: Column, parts: Sequence[Column], tolerance: float) -> Column:
    """The parts do not add up to the total."""
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.abs(total - out) > tolerance


def off_ratio(a: Column, b: Column, expected: float, tolerance: float) -> Column:
    """a is not ``expected`` times b within the share ``tolerance`` of it."""
    return F.abs(a - b * expected) > F.abs(b * expected) * tolerance


def outside(value: Column, low: float | None, high: float | None) -> Column:
    test = F.lit(False)
    if low is not None:
        test = test | (value < low)
    if high is not None:
        test = test | (value > high)
    return test


def swapped(a: Column, b: Column) -> Column:
    """Two columns hold the same non-zero amount or the part exceeds the whole."""
    return ((a == b) & (a != 0)) | (b > a)


def confidence(valid: Column, match: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), valid * match * penalty))


def level(score: Column, steps: Sequence[tuple[float, str]], lowest: str) -> Column:
    """The label of the highest step a score reaches."""
    out = F.lit(lowest)
    for least, label in sorted(steps):
        out = F.when(score >= least, label).otherwise(out)
    return out


def in_bands(rows: DataFrame, bands: DataFrame, key: str, value: str) -> DataFrame:
    """Rows outside the band of their key; keys without a band pass. The band table is one row a key."""
    j = rows.join(bands, key)
    return j.where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")))


def missing_pairs(subjects: DataFrame, concepts: DataFrame, covered: DataFrame, subject: str, concept: str, expects: str) -> DataFrame:
    """What each subject is expected to have and lacks: expectations come by role, so the pairs are an equi-join."""
    expected = subjects.join(concepts, expects).select(subject, concept).distinct()
    return expected.join(covered.select(subject, concept).distinct(), [subject, concept], "left_anti")


def recomputed(capital: Column, rate: Column, days: Column, base: int = 360) -> Column:
    """Interest on a capital at a yearly rate in per cent over days, in decimals so that half a cent rounds up."""
    exact = capital.cast("decimal(18,2)") * rate.cast("decimal(8,4)") * days.cast("decimal(6,0)")
    return F.round(exact / F.lit(100 * base).cast("decimal(8,0)"), 2).cast("double")


def dispatched(rows: DataFrame, key: Sequence[str], typ: str, by_type: dict[str, Sequence[Check]], arithmetic: dict[str, Sequence[Check]] | None = None, skip_arithmetic: bool = False) -> DataFrame:
    """(key, code, severity): the checks of each row's type, without those between amounts if they are skipped; a type
    without checks has no findings."""
    found = []
    for name in sorted({*by_type, *(arithmetic or {})}):
        checks = [*by_type.get(name, ()), *(() if skip_arithmetic else (arithmetic or {}).get(name, ()))]
        found += [F.when((F.col(typ) == name) & F.coalesce(c.broken, F.lit(False)), F.struct(F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"))) for c in checks]
    return rows.select(*key, F.inline(F.array_compact(F.array(*found))))
