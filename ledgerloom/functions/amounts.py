"""Amounts as they are printed in receipts, as Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters and every kind of blank.
BLANKS = "[\\s\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000\\u200B-\\u200D\\u2060\\uFEFF\\u00AD]"
APOSTROPHES = "['\\u2018\\u2019\\u02BC\\u2032\\uFF07`\\u00B4]"


def _forms(*starts: int) -> tuple[str, str]:
    return "".join(chr(s + i) for s in starts for i in range(10)), "0123456789" * len(starts)


_WIDE, _PLAIN = _forms(0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)


def plain_digits(col: Column) -> Column:
    """Full-width and mathematical digits and marks as ordinary ones."""
    return F.translate(col, _WIDE + "，．－＋‐‑−", _PLAIN + ",.-+---")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def amount_text(col: Column) -> Column:
    """The amount as ``[+-]digits[.digits]``; NULL where the text is no amount or empty.

    Accepts apostrophe, blank and comma thousands, decimal comma, currency marks before the number and
    a dash for missing cents; keeps every decimal given.
    """
    s = F.regexp_replace(F.regexp_replace(plain_digits(col), BLANKS, ""), APOSTROPHES, "")
    s = F.regexp_replace(s, "(?i)^([+-]?)(?:CHF|SFr\\.?|Fr\\.?|EUR|USD)([+-]?)", "$1$2")
    s = F.regexp_replace(s, "(?<=\\d)[.,]?[-\\u2013\\u2014]{1,2}$", "")
    return bound(s, lambda s: bound(_decimal_dot(s), lambda n: F.when(n.rlike("^[+-]?(\\d{1,24}(\\.\\d*)?|\\.\\d+)$"), n)))


def _decimal_dot(s: Column) -> Column:
    return (
        F.when(~s.contains(","), s)
        .when(s.rlike("^[+-]?\\d{1,3}(,\\d{3})+(\\.\\d+)?$"), F.replace(s, F.lit(","), F.lit("")))
        .when(s.rlike("^[+-]?\\d{1,3}(\\.\\d{3})+,\\d{1,2}$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(F.regexp_replace(s, ",(?=\\d{1,2}$)", "."))
    )


def amount_cents(col: Column) -> Column:
    """The amount rounded to the cent, NULL where there is none."""
    return F.round(amount_text(col).try_cast("decimal(32,6)"), 2).cast("decimal(28,2)")


def normalized(col: Column) -> Column:
    """Without apostrophes and blanks, in lower case; NULL becomes ''. Compatibility digits are resolved."""
    s = F.regexp_replace(plain_digits(F.coalesce(col, F.lit(""))), "['\\u2018\\u2019\\u02BC \\u00A0\\u202F\\u2009\\t\\n\\r]", "")
    return F.lower(F.trim(s))


# Printed marks that mean "no amount".
NO_AMOUNT = ("", "-", "–", "—", "–.–", "-.-", ".--", ".—")


def strict_amount(col: Column) -> Column:
    """STRUCT<value DECIMAL(38,2), status>: status is null, ok or garbage.

    The strict reading of a Swiss amount: one leading currency mark with or without its dot, one or two dashes for
    missing cents, a comma is the decimal sign unless there is a dot too, dots between groups of three digits alone are
    thousands, at most two decimals. A value with anything else in it is garbage, never a guess.
    """
    s = F.regexp_replace(plain_digits(F.coalesce(col, F.lit(""))), "[ \\u00A0\\u202F\\u2009\\t\\n\\r]", "")
    s = F.regexp_replace(s, "(?i)^(?:CHF|Fr\\.?|SFr\\.?|EUR|USD)", "")
    n = F.regexp_replace(F.regexp_replace(s, "\\.[-–—]{1,2}$", ""), "['\\u2018\\u2019\\u02BC]", "")
    n = F.when(n.contains("."), F.replace(n, F.lit(","), F.lit(""))).otherwise(F.replace(n, F.lit(","), F.lit(".")))
    n = F.when(n.rlike("^[+-]?[1-9]\\d{0,2}(\\.\\d{3})+$"), F.replace(n, F.lit("."), F.lit(""))).otherwise(n)
    good = n.rlike("^[+-]?\\d+(\\.\\d{1,2})?$")
    status = F.when(s.isin(*NO_AMOUNT), "null").when(good, "ok").otherwise("garbage")
    return F.struct(F.when(good, n.try_cast("decimal(38,2)")).alias("value"), status.alias("status"))


def cell_amount(col: Column) -> Column:
    """The amount of a table cell or NULL: no bare year, no percentage, no date; degree, acute and backtick signs
    between digits are misread apostrophes."""
    t = F.trim(col)
    s = F.regexp_replace(t, "(?i)^(?:CHF|Fr\\.)\\s*", "")
    s = F.regexp_replace(s, "(?<=\\d)[°´`](?=\\d)", "'")
    s = F.regexp_replace(s, "(?<=\\d)\\s+(?=\\d)", "")
    skip = t.rlike("^(19|20)\\d\\d$|^2100$") | t.contains("%") | t.rlike("^\\d{1,2}\\.\\d{1,2}\\.(\\d{4})?$")
    return F.when(~skip & s.rlike("^[+-]?\\d[\\d.,'’]*(?:[-–]{1,2})?$"), strict_amount(s)["value"])


def split_amounts(col: Column) -> Column:
    """The amounts of a merged cell, read from the left: a part closes when it parses and ends on cents.

    NULL unless at least two parts close and nothing remains.
    """
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc["open"], part)
        closed = joined.rlike("^[+-]?\\d[\\d']*\\.\\d\\d$")
        return F.when(closed, F.struct(F.lit("").alias("open"), F.array_append(acc["done"], F.regexp_replace(joined, "'", "")).alias("done"))).otherwise(
            F.struct(joined.alias("open"), acc["done"].alias("done"))
        )

    folded = F.aggregate(F.split(F.trim(col), " +"), start, step)
    return F.when((folded["open"] == "") & (F.size(folded["done"]) > 1), folded["done"])


def bare_amount(col: Column) -> Column:
    """A number without separators, a last comma before one or two digits as dot; other text unchanged."""
    s = F.regexp_replace(F.regexp_replace(col, "['’ ]", ""), ",(\\d{1,2})$", ".$1")
    return F.when(s.rlike("^[+-]?\\d+(\\.\\d+)?$"), s).otherwise(col)


def shown_amount(value: Column) -> Column:
    """12164.855 as 12'164.86, half up."""
    return F.replace(F.format_number(F.round(value.cast("decimal(20,4)"), 2), 2), F.lit(","), F.lit("'"))


def short_amount(value: Column) -> Column:
    """12164.00 as CHF 12'164, other cents kept."""
    return F.concat(F.lit("CHF "), F.regexp_replace(shown_amount(value), "\\.00$", ""))


def lenient(col: Column) -> Column:
    """A form in which corrections are compared: no apostrophes and blanks, comma as dot, no trailing .00."""
    return F.regexp_replace(F.replace(F.regexp_replace(F.coalesce(col, F.lit("")), "['’ ]", ""), F.lit(","), F.lit(".")), "\\.00$", "")


def spellings(value: Column) -> Column:
    """All the ways an amount may be printed, distinct and sorted."""
    plain = F.format_number(value.cast("decimal(18,2)"), 2)  # with comma thousands
    forms = []
    for sep in ("", "'", "’", " ", "."):
        whole = F.replace(F.substring_index(plain, ".", 1), F.lit(","), F.lit(sep))
        cents = F.substring_index(plain, ".", -1)
        forms += [F.concat(whole, F.lit(dot), cents) for dot in (".", ",") if dot != sep]
        forms += [F.when(cents == "00", F.concat(whole, F.lit(end))) for end in ("", ".-", ".--", ".–")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*forms))))


def iban_state(col: Column) -> Column:
    """ok, masked, length or checksum of an account number."""
    s = F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), "[\\s-]", ""))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    mod = F.aggregate(chars, F.lit(0), lambda acc, c: (acc * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)
    return (
        F.when((F.length(s) <= 5) | s.rlike("[X*]{3}"), "masked")
        .when(s.rlike("^(CH|LI)") & (F.length(s) != 21), "length")
        .when(~s.rlike("^[A-Z]{2}\\d{2}[0-9A-Z]{10,30}$"), "length")
        .when(mod == 1, "ok")
        .otherwise("checksum")
    )


def ibans_in(col: Column) -> Column:
    """The Swiss account numbers in a text, without blanks, in order of occurrence."""
    found = F.regexp_extract_all(F.upper(col), F.lit("\\b(?:CH|LI)\\d{2}(?:[ -]?[0-9A-Z]){17}\\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[ -]", "")))


def currencies_in(col: Column) -> Column:
    """The currency codes in a text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit("\\b(CHF|EUR|USD|GBP|JPY)\\b"), F.lit(1))))


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)$"), text.try_cast("double"))


def comma_amount(col: Column) -> Column:
    """Apostrophes dropped, commas as dots; NULL for anything that is then no number."""
    return _number(F.replace(F.replace(F.nullif(col, F.lit("null")), F.lit("'"), F.lit("")), F.lit(","), F.lit(".")))


def dot_thousands_amount(col: Column) -> Column:
    """With comma and dot, the dot is for thousands; with a comma alone it is the decimal sign."""
    s = F.replace(col, F.lit("'"), F.lit(""))
    both = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _number(F.when(s.contains(",") & s.contains("."), both).otherwise(F.replace(s, F.lit(","), F.lit("."))))


def percent_amount(col: Column) -> Column:
    """Apostrophes, blanks and per-cent signs dropped, commas as dots."""
    return _number(F.replace(F.regexp_replace(F.coalesce(col, F.lit("")), "['’ %]", ""), F.lit(","), F.lit(".")))


def is_zero(col: Column) -> Column:
    """Whether a printed amount is zero, a dash for missing cents included."""
    s = F.replace(F.regexp_replace(F.coalesce(col, F.lit("")), "['’ ]", ""), F.lit(","), F.lit("."))
    return F.coalesce(_number(F.regexp_replace(s, "\\.[-—–]$", ".00")) == 0, F.lit(False))


def plain_amount(col: Column) -> Column:
    """Digits and a dot after apostrophes and blanks are dropped; nothing else is read."""
    return _number(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), "[' ]", ""))
