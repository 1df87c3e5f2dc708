"""Dates, names, keys and value states of receipts as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of glyphs that a reader left unresolved.
GLYPHS = {"228": "ä", "246": "ö", "252": "ü", "196": "Ä", "214": "Ö", "220": "Ü", "233": "é", "232": "è", "224": "à"}
PLACEHOLDERS = ("", "-", "–", "—", "-.-", "–.–", ".--", "n/a", "null", "none", "unbekannt")


def parsed_date(col: Column) -> Column:
    """The date of d.m.yyyy or yyyy-mm-dd; NULL for any other form and for days that do not exist."""
    t = F.trim(col)
    day = F.when(t.rlike("^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$"), F.try_to_timestamp(t, F.lit("d.M.yyyy")))
    iso = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    return F.coalesce(day, iso).cast("date")


def year_in_name(col: Column) -> Column:
    """The year a file name speaks of: the least plausible 20xx in it."""
    years = F.transform(F.regexp_extract_all(col, F.lit("(?:^|[^0-9])(20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.try_cast("int"))
    return F.array_min(F.filter(years, lambda y: y.between(2015, 2035)))


def year_after(col: Column, labels: list[str]) -> Column:
    """The first 20xx within 50 characters after the first label that has one."""
    return F.coalesce(*[F.regexp_extract(col, f"(?i){label}.{{0,50}}?\\b(20\\d\\d)\\b", 1).try_cast("int") for label in labels])


def resolved_glyphs(col: Column) -> Column:
    """``(cid:228)`` as its letter, unknown codes dropped."""
    out = col
    for code, letter in GLYPHS.items():
        out = F.replace(out, F.lit(f"(cid:{code})"), F.lit(letter))
    return F.regexp_replace(out, "\\(cid:\\d+\\)", "")


def clean_person(col: Column) -> Column:
    """A person without a birth date, postcode and place, or further comma parts at the end."""
    s = F.regexp_replace(F.trim(col), "[, ]+(?:geb\\.? ?)?\\d{1,2}\\.\\d{1,2}\\.\\d{4}$", "")
    s = F.regexp_replace(s, ",? *(?:CH-)?\\d{4} +[A-ZÄÖÜ][\\w\\- ]*$", "")
    return F.when(F.size(F.split(s, ",")) >= 3, F.trim(F.element_at(F.split(s, ","), 1))).otherwise(F.trim(s))


def clean_issuer(col: Column) -> Column:
    """An issuer without its postcode and place."""
    return F.trim(F.regexp_replace(F.trim(col), ",? *(?:CH-)?\\d{4} *[A-ZÄÖÜ][\\w\\- ]*$", ""))


_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"


def unaccented(col: Column) -> Column:
    return F.translate(col, _ACCENTED, _PLAIN)


# Letters of other scripts that look like Latin ones.
_LOOKS, _LATIN = "аеорсухіѕјһАВЕКМНОРСТУХІЅЈουνιρακΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‘’ʼ´｀", "aeopcyxisjhABEKMHOPCTYXISJouvipakABEZHIKMNOPTYX" + "'" * 5


def name_forms() -> tuple[str, str]:
    """Full-width characters, accented Latin letters and look-alikes, and the plain character of each."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict(zip(_LOOKS, _LATIN))
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        plain = unicodedata.normalize("NFD", c)[0]
        if plain != c and plain.isascii():
            wide[c] = plain
    return "".join(wide), "".join(wide.values())


def name_tokens(col: Column) -> Column:
    """The words of a name without case, accents, character forms and what is invisible, distinct and sorted."""
    plain = F.translate(F.regexp_replace(F.coalesce(col, F.lit("")), "[\\p{Mn}\\p{Cf}]", ""), *name_forms())
    words = F.split(F.lower(plain), "[\\s\\p{Z},]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def safe_stem(col: Column) -> Column:
    """A file name of ASCII letters, digits, dots, hyphens and underscores."""
    return F.regexp_replace(unaccented(col), "[^A-Za-z0-9._-]", "_")


def short_issuer(col: Column, size: int = 30) -> Column:
    """An issuer without its legal form, cut at a word boundary."""
    s = F.trim(F.regexp_replace(clean_issuer(col), "(?i)[ ,]+(?:AG|SA|GmbH|Genossenschaft|& Co\\.?|Aktiengesellschaft|S\\.A\\.|A\\.G\\.)$", ""))
    cut = F.regexp_extract(F.substring(s, 1, size + 1), "^(.*)\\s", 1)
    return F.when(F.length(s) <= size, s).when(cut != "", F.trim(cut)).otherwise(F.substring(s, 1, size))


def core_name(col: Column) -> Column:
    """The first eight plain letters of a name: what a quick comparison of banks uses."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z]", ""), 1, 8)


def account_key(col: Column) -> Column:
    """An account-like part of a file name: letters and digits as in an account number, or six digits and more."""
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(col, "(?i)(CH\\d{2}[0-9A-Z]{10,17})", 1), F.lit("")), F.nullif(F.regexp_extract(col, "(\\d{6,})", 1), F.lit(""))))


def identifier(col: Column) -> Column:
    """An account number without blanks in capitals; another identifier with single blanks."""
    s = F.upper(F.regexp_replace(F.trim(col), "\\s", ""))
    return F.when(s.rlike("^[A-Z]{2}\\d{2}[0-9A-Z]{8,}$"), s).otherwise(F.regexp_replace(F.trim(col), "\\s+", " "))


def fingerprint(*cols: Column, size: int = 12) -> Column:
    """The first hex digits of the SHA-256 of the values, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, size)


def position_key(doc: Column, target: Column, pos: Column) -> Column:
    """``doc|target`` for the first position, ``doc|target#n`` for further ones."""
    return F.concat(doc, F.lit("|"), target, F.when(pos > 1, F.concat(F.lit("#"), pos.cast("string"))).otherwise(F.lit("")))


def position_parts(key: Column) -> Column:
    """STRUCT<doc, target, pos>: #n counts as position if n is 2..999 without leading zero and no blank is before #."""
    doc, rest = F.substring_index(key, "|", 1), F.regexp_extract(key, "^[^|]*\\|(.*)$", 1)
    number = F.regexp_extract(rest, "^.*[^ ]#([1-9]\\d{0,2})$", 1).try_cast("int")
    counts = F.coalesce(number >= 2, F.lit(False))
    return F.struct(
        doc.alias("doc"),
        F.when(counts, F.regexp_replace(rest, "#\\d+$", "")).otherwise(rest).alias("target"),
        F.when(counts, number).otherwise(F.lit(1)).alias("pos"),
    )


def line_order(col: Column) -> Column:
    """``16.6`` as [16, 6], anything else as [999]: arrays compare element by element."""
    return F.when(col.rlike("^\\d+(\\.\\d+)*$"), F.transform(F.split(col, "\\."), lambda x: x.try_cast("int"))).otherwise(F.array(F.lit(999)))


def ellipsis(col: Column, size: int) -> Column:
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size - 1), F.lit("…"))).otherwise(col)


def table_cell(col: Column) -> Column:
    """A text that can stand in a cell of a text table."""
    return F.regexp_replace(F.replace(col, F.lit("|"), F.lit("\\|")), "[\\r\\n]+", " ")


def unmasked_number(col: Column) -> Column:
    """Whether a number is shown in full: no mask sign and six digits at least."""
    return ~col.rlike("[xX*#]") & (F.length(F.regexp_replace(col, "\\D", "")) >= 6)


def digits_masked(col: Column) -> Column:
    """Shapes kept, digits hidden."""
    return F.regexp_replace(col, "\\d", "9")


def role_of(col: Column, roles: list[str]) -> Column:
    """A role, given as such or in brackets at the end of a name; NULL if neither."""
    inside = F.regexp_extract(col, "\\(([^()]+)\\)\\s*$", 1)
    return F.when(col.isin(*roles), col).when(inside.isin(*roles), inside)


def anchor_parts(col: Column) -> Column:
    """STRUCT<page, bbox> of ``S.2 (x0, top, x1, bottom)``; page 1 and no box for other text."""
    number = "(-?\\d+(?:\\.\\d+)?)"
    pattern = f"^S\\.(\\d+) \\({number}, {number}, {number}, {number}\\)$"
    ok = F.coalesce(col.rlike(pattern), F.lit(False))
    box = F.array(*[F.regexp_extract(col, pattern, i).try_cast("double") for i in range(2, 6)])
    return F.struct(F.when(ok, F.regexp_extract(col, pattern, 1).try_cast("int")).otherwise(F.lit(1)).alias("page"), F.when(ok, box).alias("bbox"))


def anchor_text(page: Column, bbox: Column) -> Column:
    parts = F.array_join(F.transform(bbox, lambda x: x.cast("decimal(10,1)").cast("string")), ", ")
    return F.when(bbox.isNotNull(), F.concat(F.lit("S."), page.cast("string"), F.lit(" ("), parts, F.lit(")")))


def value_state(raw: Column, value: Column) -> Column:
    """absent, placeholder, marker, by_design, zero or real: the states of a value that must not be mixed up."""
    t = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull(), "absent")
        .when(t.startswith("manual_review"), "marker")
        .when(t == "not_in_beleg_by_design", "by_design")
        .when(t.isin(*PLACEHOLDERS), "placeholder")
        .when(value == 0, "zero")
        .otherwise("real")
    )


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def one_of_two(text: Column, first: str, second: str) -> Column:
    """TRUE if only the first pattern occurs, FALSE if only the second, NULL if both or neither."""
    a, b = text.rlike(first), text.rlike(second)
    return F.when(a & ~b, F.lit(True)).when(b & ~a, F.lit(False))
