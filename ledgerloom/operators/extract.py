"""Types, fields and provenance read from texts by tables of patterns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(text: Column, pattern: str) -> Column:
    """How many different matches of a pattern a text has, without case."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.lower(m))))


def typed(docs: DataFrame, text: str, patterns: dict[str, str], *, head: int | None = None, before: Sequence[tuple[Column, str]] = (), out: str = "typ") -> DataFrame:
    """The type with most distinct hits in the first ``head`` words, of all words if none hits there.

    Rules in ``before`` go first; equal scores are ``multiple``, none is ``unknown``. All patterns are columns of one
    projection, so a document is read once and nothing is shuffled.
    """
    start = F.col(text) if head is None else F.array_join(F.slice(F.split(F.col(text), "\\s+"), 1, head), " ")
    scores = {t: hits(start, p) for t, p in patterns.items()}
    whole = {t: hits(F.col(text), p) for t, p in patterns.items()}
    one = docs.withColumn("_h", F.struct(*[s.alias(t) for t, s in scores.items()]))
    empty = F.greatest(*[F.col(f"_h.{t}") for t in patterns]) == 0 if len(patterns) > 1 else F.col(f"_h.{next(iter(patterns))}") == 0
    two = one.withColumn("_s", F.when(empty, F.struct(*[s.alias(t) for t, s in whole.items()])).otherwise(F.col("_h")))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"_s.{t}")).alias("n"), F.lit(t).alias("t")) for t in patterns]))
    best, second = ranked[0], ranked[1] if len(patterns) > 1 else F.struct(F.lit(1).alias("n"), F.lit("").alias("t"))
    choice = F.when(best["n"] == 0, "unknown").when(best["n"] == second["n"], "multiple").otherwise(best["t"])
    for test, label in reversed(list(before)):
        choice = F.when(test, label).otherwise(choice)
    return two.withColumn(out, choice).withColumn("treffer", -best["n"]).drop("_h", "_s")


@dataclass(frozen=True)
class Rule:
    """A labelled pattern: field, pattern with one group, first or last match, priority by order."""

    field: str
    pattern: str
    last: bool = False


def extracted(docs: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """The documents with a column for each field: the first rule of it that matches."""
    fields: dict[str, list[Column]] = {}
    for r in rules:
        found = F.regexp_extract_all(F.col(text), F.lit(r.pattern), F.lit(1))
        fields.setdefault(r.field, []).append(F.try_element_at(found, F.lit(-1 if r.last else 1)))
    return docs.select("*", *[F.coalesce(*cols).alias(name) for name, cols in fields.items()])


def ruled(rule: Column, model: Column) -> Column:
    """STRUCT<wert, herkunft>: a rule's value goes before the model's."""
    origin = F.when(rule.isNotNull(), "regel").when(model.isNotNull(), "modell")
    return F.struct(F.coalesce(rule, model).alias("wert"), origin.alias("herkunft"))


def grounded(value: Column, text: Column) -> Column:
    """Whether a value occurs in a text, separators aside."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[.,'’\\s]", "")
    return F.coalesce(squeeze(text).contains(squeeze(value)), F.lit(False))


def constrained(value: Column, allowed: Column) -> Column:
    """A value if the list allows it, else the first of the list."""
    return F.when(F.array_contains(allowed, value), value).otherwise(F.try_element_at(allowed, F.lit(1)))


def attributed(roles: Column) -> Column:
    """No role NULL, one role itself, several ``gemeinsam``."""
    n = F.size(F.array_distinct(F.coalesce(roles, F.array().cast("array<string>"))))
    return F.when(n == 1, roles[0]).when(n > 1, "gemeinsam")
