"""Personal data by fixed patterns: scan reports that never hold the match, and simple scrubbing of words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Patterns without look-around, so any regular-expression engine reads them alike.
PATTERNS = {
    "ahv": "756[. ]?\\d{4}[. ]?\\d{4}[. ]?\\d{2}",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]{2,}",
    "iban": "(?:CH|LI)\\d{2}(?: ?\\d{4}){4} ?\\d",
    "phone": "(?:\\+41|0041) ?\\(?0?\\)?\\d{2} ?\\d{3} ?\\d{2} ?\\d{2}",
}


def scanned(rows: DataFrame, key: Sequence[str], text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, category, hash8) of every match: the report has a hash, never the match."""

    def of(category: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(matches, lambda m: F.struct(F.lit(category).alias("category"), F.substring(F.sha2(m, 256), 1, 8).alias("hash8")))

    found = [of(k, p) for k, p in (patterns or PATTERNS).items()]
    return rows.where(F.col(text).isNotNull()).select(*key, F.inline(F.flatten(F.array(*found))))


def scrubbed(col: Column, patterns: dict[str, str] | None = None) -> Column:
    """The text with the category in place of every match, dates left alone."""
    out = col
    for name, pattern in (patterns or PATTERNS).items():
        out = F.regexp_replace(out, pattern, f"[{name.upper()}]")
    return out


def is_placeholder(match: Column) -> Column:
    """A match that names nobody: masked, all zeros or one repeated digit."""
    digits = F.regexp_replace(match, "\\D", "")
    return match.rlike("[xX*]{3}") | digits.rlike("^(\\d)\\1+$") | digits.rlike("^0*$")


def year_not_postcode(word: Column, following: Column) -> Column:
    """A four-digit word that is a year rather than a postcode: 19xx or 20xx and no capitalised place after it."""
    return word.rlike("^(19|20)\\d{2}$") & ~F.coalesce(following.rlike("^[A-ZÄÖÜ][a-zäöü]+(ikon|wil|büel|dorf|hofen|lingen|matt|stetten)\\W*$"), F.lit(False))


# The ways a name is written; f is the first name, l the last one, i the initial of the first.
NAME_FORMS = (
    "{f}", "{l}", "{f} {l}", "{l} {f}", "{l}, {f}", "Herr {f} {l}", "Frau {f} {l}", "Hr. {f} {l}", "Fr. {f} {l}",
    "{i}. {l}", "{i} {l}", "{f}{l}", "{l}{f}", "{f}.{l}", "{l}.{f}", "{f}-{l}", "{l}-{f}",
)
# The ways a date of birth is written.
DATE_FORMS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd.MM.yy", "d.M.yyyy", "d.M.yy", "yyyyMMdd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy")


def _longest_first(forms: Column) -> Column:
    return F.array_sort(F.array_distinct(forms), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def _name_parts(name: Column) -> Column:
    """A name and, if it has several words, each of them with two letters and more."""
    words = F.split(F.trim(name), "\\s+")
    return F.when(F.size(words) > 1, F.concat(F.array(F.trim(name)), F.filter(words, lambda w: F.length(w) >= 2))).otherwise(F.array(F.trim(name)))


def _formed(form: str, first: Column, last: Column) -> Column:
    out = F.lit(form)
    for mark, value in (("{f}", first), ("{l}", last), ("{i}", F.substring(first, 1, 1))):
        out = F.replace(out, F.lit(mark), value) if mark in form else out
    return out


def name_variants(first: Column, last: Column) -> Column:
    """The ways a name is written, also with each word of a name of several, longest first; NULL if a part is empty."""
    pairs = F.flatten(F.transform(_name_parts(first), lambda f: F.transform(_name_parts(last), lambda ln: F.array(*[_formed(x, f, ln) for x in NAME_FORMS]))))
    return F.when((F.trim(first) != "") & (F.trim(last) != ""), _longest_first(F.flatten(pairs)))


def name_variant_pairs(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """ARRAY<STRUCT<original, other>>: each way a name is written beside the same way of another name."""
    form = lambda f, ln: F.array(*[F.struct(_formed(x, f, ln).alias("original"), _formed(x, other_first, other_last).alias("other")) for x in NAME_FORMS])
    return F.array_distinct(F.flatten(F.flatten(F.transform(_name_parts(first), lambda f: F.transform(_name_parts(last), lambda ln: form(f, ln))))))


def birth_date_variants(day: Column) -> Column:
    """The ways a date is written, longest first."""
    return F.when(day.isNotNull(), _longest_first(F.array(*[F.date_format(day, f) for f in DATE_FORMS])))


# What stands in anonymised texts, and what it stands for, in the order of replacement.
REPLACED = (
    ("(?i)(geboren am|geb\\.?) ?[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}", "$1 01.01.1900"),
    ("756[0-9]{10}", "7560000000000"),
    ("756[. ][0-9]{4}[. ][0-9]{4}[. ][0-9]{2}", "756.0000.0000.00"),
    ("(?i)(?:CH|LI)[0-9]{2}(?:[ -]?[0-9A-Z]{4}){4}[ -]?[0-9A-Z]", "CH00 0000 0000 0000 0000 0"),
    ("(?i)(Telefon|Telefax|Tel\\.?|Fax|Mobile|Mobil|Natel|Phone) ?(?:\\+41|0041|0)[0-9]{9}", "$1 044-000-00-00"),
    ("(?:\\+41|0041) ?[0-9]{2} ?[0-9]{3} ?[0-9]{2} ?[0-9]{2}", "044 000 00 00"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "anon@example.com"),
    ("[A-ZÄÖÜ][a-zäöü]+(?:strasse|gasse|weg|platz|quai) [0-9]{1,3}[a-z]?", "Musterstrasse 1"),
    ("[13-9][0-9]{3} ?[A-ZÄÖÜ][a-zäöü]{2,}", "8000 Musterhausen"),
)
DATE_INSIDE = "[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}"
AMOUNT_INSIDE = "[0-9]{1,3}(?:['’][0-9]{3})+\\.[0-9]{2}|[0-9]+\\.[0-9]{2}"


def between(text: Column, pattern: str, outside: Callable[[Column], Column], inside: Callable[[Column], Column]) -> Column:
    """The text with the matches of a pattern and what stands between them changed each in its own way."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(outside(p), F.coalesce(inside(m), F.lit("")))), "")


def anonymised(text: Column, owner: Column) -> Column:
    """A text with placeholders for personal data, in fixed order, and its amounts scaled by a factor of ``owner``; dates
    and years stay as they are, and amounts keep their thousands signs."""
    from ledgerloom.functions.amounts import shown_amount

    out = text
    for pattern, by in REPLACED:
        out = F.regexp_replace(out, pattern, by)

    def amount(m: Column) -> Column:
        value = shown_amount(scaled(F.regexp_replace(m, "['’]", "").cast("double"), owner))
        return F.when(m.rlike("['’]"), value).otherwise(F.replace(value, F.lit("'"), F.lit("")))

    return between(out, DATE_INSIDE, lambda p: between(p, AMOUNT_INSIDE, lambda x: x, amount), lambda d: d)


def stable_markers(names: DataFrame, name: str, prefix: str) -> DataFrame:
    """(name, marker): the same marker for the same name in every run, from its hash."""
    return names.select(name).distinct().withColumn("marker", F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(name, 256), 1, 6))))


def scaled(amount: Column, owner: Column, low: float = 0.8, high: float = 1.2) -> Column:
    """An amount times a factor that is the same for all amounts of an owner and cannot be read back from one."""
    share = F.conv(F.substring(F.sha2(owner, 256), 1, 6), 16, 10).cast("double") / 16777215.0
    return F.round(amount * (low + share * (high - low)), 2)


def spread_match(words: DataFrame, doc: Sequence[str], order: str, text: str, shapes: Sequence[str], category: str) -> DataFrame:
    """Consecutive words that match a sequence of shapes, such as a phone number spread over four words."""
    w = W.partitionBy(*doc).orderBy(order)
    at = [F.col(text)] + [F.lead(text, i).over(w) for i in range(1, len(shapes))]
    test = F.lit(True)
    cols = words.select(*doc, order, *[c.alias(f"_w{i}") for i, c in enumerate(at)])
    for i, s in enumerate(shapes):
        test = test & F.col(f"_w{i}").rlike(f"^(?:{s})$")
    return cols.where(test).select(*doc, F.col(order).alias("start"), F.lit(category).alias("category"), F.lit(len(shapes)).alias("words"))


#: What counts as personal data when texts are shared: spaced and glued forms, and what a reader misread.
DETECTORS = {
    "iban": "(?<![A-Za-z0-9])((?:CH|LI|ch|li)[0-9]{2}[ 0-9]{15,30})(?![0-9])",
    "ahv": "(?<![0-9.])(756[. ]{0,3}[0-9]{4}[. ]{0,3}[0-9]{4}[. ]{0,3}[0-9]{2})(?![0-9])",
    "phone": "(?<![0-9.])((?:\\+41|0041)[ .-]?[0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}|0[0-9]{2}[ .-][0-9]{3}[ .-][0-9]{2}[ .-][0-9]{2})(?![0-9])",
    "misread_phone": "(?<![0-9A-Za-z])(0[0-9OIl]{2}[ .-][0-9OIl]{3}[ .-][0-9OIl]{2}[ .-][0-9OIl]{2})(?![0-9A-Za-z])",
    "email": "(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})",
    "place": "(?<![0-9A-Za-z.'-])((?:CH-|FL-)?[1-9][0-9]{3} ?[A-ZÄÖÜ][a-zäöü]{1,}(?:ikon|wil|büel|dorf|hofen|lingen|matt|stetten))(?![a-zäöü])",
    "account": "(?<![0-9A-Za-z.-])([0-9]{2,3}-[0-9]{3,6}[-.][0-9]{1,3})(?![0-9A-Za-z-])",
    "domain": "(?<![A-Za-z0-9@.-])(www\\.[A-Za-z0-9-]+\\.[a-z]{2,})",
}
# What anonymised texts hold in place of personal data.
PLACEHOLDERS = ("044-000-00-00", "044 000 00 00", "anon@example.com")


def suppressed(category: Column, match: Column) -> Column:
    """Whether a match is a placeholder: check digits 00, nothing but zeros after 756, six zeros in a phone number,
    masked, or one of the fixed ones."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    zeros = F.length(F.regexp_replace(digits, "[^0]", ""))
    return (
        match.isin(*PLACEHOLDERS)
        | (is_placeholder(match) & (digits != ""))
        | match.rlike("[xX*]{3}")
        | ((category == "misread_phone") & ~match.rlike("[OIl]"))
        | ((category == "iban") & (F.substring(digits, 1, 2) == "00"))
        | ((category == "ahv") & digits.rlike("^7560+$"))
        | ((category == "phone") & (F.length(digits) >= 9) & (zeros >= 6))
        | ((category == "email") & F.lower(match).rlike("@(example[.]|beispiel[.])"))
    )


def detected(rows: DataFrame, key: Sequence[str], text: str, detectors: dict[str, str] | None = None) -> DataFrame:
    """(key, category, hash8) of every match that is no placeholder; the report has a hash, never the match."""

    def of(category: str, pattern: str) -> Column:
        matches = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda m: F.trim(m))
        real = F.filter(matches, lambda m: ~suppressed(F.lit(category), m))
        return F.transform(real, lambda m: F.struct(F.lit(category).alias("category"), F.substring(F.sha2(m, 256), 1, 8).alias("hash8")))

    found = [of(k, p) for k, p in (detectors or DETECTORS).items()]
    return rows.where(F.col(text).isNotNull()).select(*key, F.inline(F.flatten(F.array(*found))))


def _unsuppressed(category: str) -> Callable[[Column], Column]:
    return lambda m: ~suppressed(F.lit(category), F.trim(m))


def holds_personal_data(text: Column, detectors: dict[str, str] | None = None) -> Column:
    """Whether a text has a match that is no placeholder."""
    out = F.lit(False)
    for category, pattern in (detectors or DETECTORS).items():
        out = out | F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _unsuppressed(category))
    return F.coalesce(out, F.lit(False))


def placeholders_in(rows: DataFrame, text: str, detectors: dict[str, str] | None = None) -> DataFrame:
    """(category, held) of every match: whether it is a placeholder and so held back from reports."""

    def of(category: str, pattern: str) -> Column:
        matches = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda m: F.trim(m))
        return F.transform(matches, lambda m: F.struct(F.lit(category).alias("category"), suppressed(F.lit(category), m).alias("held")))

    return rows.where(F.col(text).isNotNull()).select(F.inline(F.flatten(F.array(*[of(k, p) for k, p in (detectors or DETECTORS).items()]))))


def leaks(spark, folder: str, detectors: dict[str, str] | None = None) -> DataFrame:
    """(path, line, category, hash8): personal data in the text files below a folder, line by line."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\\r?\\n")).alias("line", "text"))
    return detected(lines.withColumn("line", F.col("line") + 1), ["path", "line"], "text", detectors)


def verified_clean(spark, folder: str, detectors: dict[str, str] | None = None) -> None:
    """Raises with the number of leaks by category if a folder to be shared has any."""
    found = {r.category: r["count"] for r in leaks(spark, folder, detectors).groupBy("category").count().collect()}
    if found:
        raise ValueError(f"personal data in {folder}: {dict(sorted(found.items()))}")
