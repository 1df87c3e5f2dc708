"""Scalar functions on the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import texts as X
from ledgerloom.plans.catalog import Catalog

catalog = Catalog()
query = catalog.query

_W = "０１２３４５６７８９"
_MATH = "".join(chr(s + i) for s in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10))
_DIGITS = "0123456789"


def sql_digits(c: str) -> str:
    """``plain_digits`` in SQL."""
    return f"translate({c}, '{_W}{_MATH}，．－＋‐‑−', '{_DIGITS * 6},.-+---')"


_APOS = "[''\\x{2018}\\x{2019}\\x{02BC}]"
_NORM = "[''\\x{2018}\\x{2019}\\x{02BC} \\x{00A0}\\x{202F}\\x{2009}\\t\\n\\r]"


def sql_norm(c: str) -> str:
    return f"lower(trim(regexp_replace({sql_digits(f'coalesce({c}, chr(32))')}, '{_NORM}', '', 'g'), ' '))"


def sql_name_tokens(c: str) -> str:
    """``name_tokens`` in SQL."""
    wide, plain = X.name_forms()
    folded = f"translate(regexp_replace(coalesce({c}, ''), '[\\p{{Mn}}\\p{{Cf}}]', '', 'g'), '{wide}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({folded}), '[\\s\\p{{Z}},]+'), lambda w: w <> '')))"


def sql_strict(source: str, keys: str, c: str) -> str:
    """A chain of steps that ends in (keys, status, value)."""
    return f"""WITH s0 AS (SELECT {keys}, {sql_digits(f"coalesce({c}, '')")} AS s FROM {source}),
s1 AS (SELECT {keys}, regexp_replace(regexp_replace(s, '[ \\x{{00A0}}\\x{{202F}}\\x{{2009}}\\t\\n\\r]', '', 'g'), '(?i)^(?:CHF|Fr\\.?|SFr\\.?|EUR|USD)', '') AS s FROM s0),
s2 AS (SELECT {keys}, s, regexp_replace(s, '\\.[-–—]{{1,2}}$', '') AS b FROM s1),
s3 AS (SELECT {keys}, s, b, regexp_replace(b, '{_APOS}', '', 'g') AS n FROM s2),
s4 AS (SELECT {keys}, s, b, CASE WHEN NOT contains(n, ',') THEN n WHEN contains(n, '.') THEN replace(n, ',', '') ELSE replace(n, ',', '.') END AS n FROM s3),
s5 AS (SELECT {keys}, s, b, CASE WHEN regexp_matches(n, '^[+-]?[1-9]\\d{{0,2}}(\\.\\d{{3}})+$') THEN replace(n, '.', '') ELSE n END AS n FROM s4),
s6 AS (SELECT {keys}, s IN ('', '-', '–', '—', '–.–', '-.-', '.--', '.—') AS none, NOT regexp_matches(b, '[^\\d.,''\\x{{2018}}\\x{{2019}}\\x{{02BC}}+-]') AND regexp_matches(n, '^[+-]?\\d+(\\.\\d{{1,2}})?$') AS good, n FROM s5),
amounts AS (SELECT {keys}, CASE WHEN none THEN 'null' WHEN good THEN 'ok' ELSE 'garbage' END AS status, CAST(CASE WHEN NOT none AND good THEN TRY_CAST(n AS DECIMAL(38,2)) END AS DOUBLE) AS value FROM s6)
"""


@query(
    "r2_01_normalized",
    f"SELECT row_id, {sql_norm('wert_raw')} AS norm FROM field_rows",
)
def normalized(t):
    return t("field_rows").select("row_id", A.normalized(F.coalesce("wert_raw", F.lit(" "))).alias("norm"))


@query("r2_02_strict_amount", sql_strict("field_rows", "row_id", "wert_raw") + "SELECT row_id, status, value FROM amounts")
def strict_amount(t):
    rows = t("field_rows").select("row_id", A.strict_amount(F.col("wert_raw")).alias("a"))
    return rows.select("row_id", "a.status", F.col("a.value").cast("double").alias("value"))


@query("r2_03_amount_states", sql_strict("position_store", "id", "amount") + "SELECT status, count(*) AS n, round(coalesce(sum(value), 0), 2) AS total FROM amounts GROUP BY status")
def amount_states(t):
    rows = t("position_store").select(A.strict_amount(F.col("amount")).alias("a"))
    return rows.groupBy("a.status").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("a.value").cast("double"), F.lit(0.0)), 2).alias("total"))


@query(
    "r2_04_dates",
    """SELECT row_id, CASE WHEN regexp_matches(trim(wert_raw, ' '), '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$') THEN strftime(try_strptime(trim(wert_raw, ' '), '%d.%m.%Y'), '%Y-%m-%d')
    WHEN regexp_matches(trim(wert_raw, ' '), '^\\d{4}-\\d{2}-\\d{2}$') THEN strftime(try_strptime(trim(wert_raw, ' '), '%Y-%m-%d'), '%Y-%m-%d') END AS tag FROM field_rows WHERE feld IN ('periode_von', 'periode_bis')""",
)
def dates(t):
    return t("field_rows").where("feld in ('periode_von', 'periode_bis')").select("row_id", X.parsed_date(F.col("wert_raw")).cast("string").alias("tag"))


@query(
    "r2_05_cell_amounts",
    """WITH c AS (SELECT word_id, trim(text, ' ') AS t FROM tagged_words),
    d AS (SELECT word_id, t, regexp_replace(t, '(?i)^(?:CHF|Fr\\.)\\s*', '') AS s FROM c WHERE NOT regexp_matches(t, '^(19|20)\\d\\d$|^2100$') AND NOT contains(t, '%') AND NOT regexp_matches(t, '^\\d{1,2}\\.\\d{1,2}\\.(\\d{4})?$')),
    e AS (SELECT word_id, regexp_replace(s, '(\\d)\\s+(\\d)', '\\1\\2', 'g') AS s FROM d WHERE regexp_matches(s, '^[+-]?\\d[\\d.,''’]*(?:[-–]{1,2})?$')),
    f AS (SELECT word_id, regexp_replace(regexp_replace(s, '\\.[-–—]{1,2}$', ''), '[''’]', '', 'g') AS n FROM e),
    g AS (SELECT word_id, CASE WHEN NOT contains(n, ',') THEN n WHEN contains(n, '.') THEN replace(n, ',', '') ELSE replace(n, ',', '.') END AS n FROM f),
    h AS (SELECT word_id, CASE WHEN regexp_matches(n, '^[+-]?[1-9]\\d{0,2}(\\.\\d{3})+$') THEN replace(n, '.', '') ELSE n END AS n FROM g)
    SELECT word_id, CAST(TRY_CAST(n AS DECIMAL(18,2)) AS DOUBLE) AS betrag FROM h WHERE regexp_matches(n, '^[+-]?\\d+(\\.\\d{1,2})?$')""",
)
def cell_amounts(t):
    return t("tagged_words").select("word_id", A.cell_amount(F.col("text")).cast("double").alias("betrag")).where("betrag is not null")


@query("r2_06_split_amounts")
def split_amounts(t):
    lines = t("tagged_words").groupBy("dokument_id", "eingelesen_am", "page", "top").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("zeile"))
    numbers = F.array_join(F.filter(F.split("zeile", " "), lambda w: w.rlike("^[\\d'.]+$")), " ")
    parts = lines.select("dokument_id", "page", "top", F.array_join(A.split_amounts(numbers), "|").alias("teile"))
    return parts.where("teile is not null")


@query(
    "r2_08_shown_amounts",
    """SELECT id, replace(format('{:,.2f}', CAST(betrag AS DECIMAL(18,2))::DOUBLE), ',', '''') AS anzeige,
    'CHF ' || regexp_replace(replace(format('{:,.2f}', CAST(betrag AS DECIMAL(18,2))::DOUBLE), ',', ''''), '\\.00$', '') AS kurz FROM position_store WHERE regexp_matches(betrag, '^-?\\d+(\\.\\d+)?$')""",
)
def shown_amounts(t):
    b = F.col("betrag").try_cast("decimal(18,2)")
    return t("position_store").where(F.col("betrag").rlike("^-?\\d+(\\.\\d+)?$")).select("id", A.shown_amount(b).alias("anzeige"), A.short_amount(b).alias("kurz"))


@query(
    "r2_11_lenient_forms",
    "SELECT id, regexp_replace(replace(regexp_replace(coalesce(amount, ''), '[''’ ]', '', 'g'), ',', '.'), '\\.00$', '') AS form FROM position_store",
)
def lenient_forms(t):
    return t("position_store").select("id", A.lenient(F.col("amount")).alias("form"))


def sql_spellings(c: str) -> str:
    """The list of ``spellings`` of a decimal in SQL."""
    whole, cents = f"split_part(format('{{:,.2f}}', CAST({c} AS DOUBLE)), '.', 1)", f"split_part(format('{{:,.2f}}', CAST({c} AS DOUBLE)), '.', 2)"
    forms = []
    for sep in ("", "''", "’", " ", "."):
        w = f"replace({whole}, ',', '{sep}')"
        forms += [f"{w} || '{dot}' || {cents}" for dot in (".", ",") if dot != sep]
        forms += [f"CASE WHEN {cents} = '00' THEN {w} || '{end}' END" for end in ("", ".-", ".--", ".–")]
    return f"list_sort(list_distinct(list_filter([{', '.join(forms)}], lambda x: x IS NOT NULL)))"


@query("r2_13_spellings", f"SELECT betrag, array_to_string({sql_spellings('CAST(betrag AS DECIMAL(18,2))')}, '|') AS formen FROM (SELECT DISTINCT betrag FROM position_store WHERE regexp_matches(betrag, '^\\d+(\\.\\d+)?$'))")
def spellings(t):
    rows = t("position_store").where(F.col("betrag").rlike("^\\d+(\\.\\d+)?$")).select("betrag").distinct()
    return rows.select("betrag", F.array_join(A.spellings(F.col("betrag").try_cast("decimal(18,2)")), "|").alias("formen"))


@query(
    "r2_14_iban_states",
    """WITH w AS (SELECT row_id, unnest(regexp_extract_all(upper(snippet), '\\b(?:CH|LI)[0-9X]{2}(?:[ -]?[0-9A-Z]){17}\\b')) AS raw FROM field_rows WHERE snippet IS NOT NULL),
    s AS (SELECT row_id, regexp_replace(raw, '[\\s-]', '', 'g') AS s FROM w),
    u AS (SELECT row_id, s, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(s, 5) || substr(s, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS HUGEINT) ELSE CAST(ascii(c) - 55 AS HUGEINT) END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) AS m FROM s)
    SELECT CASE WHEN regexp_matches(s, '[X*]{3}') THEN 'masked' WHEN length(s) <> 21 THEN 'length' WHEN m = 1 THEN 'ok' ELSE 'checksum' END AS zustand, count(*) AS n FROM u GROUP BY 1""",
)
def iban_states(t):
    found = F.regexp_extract_all(F.upper("snippet"), F.lit("\\b(?:CH|LI)[0-9X]{2}(?:[ -]?[0-9A-Z]){17}\\b"), F.lit(0))
    return t("field_rows").where("snippet is not null").select(F.explode(found).alias("i")).groupBy(A.iban_state(F.col("i")).alias("zustand")).agg(F.count("*").alias("n"))


@query(
    "r2_15_currencies",
    "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(CHF|EUR|USD|GBP|JPY)\\b', 1))), ',') AS waehrungen FROM documents WHERE regexp_matches(text, '\\b(CHF|EUR|USD|GBP|JPY)\\b')",
)
def currencies(t):
    return t("documents").select("doc_id", F.array_join(A.currencies_in(F.col("text")), ",").alias("waehrungen")).where("waehrungen <> ''")


@query(
    "r2_16_year_in_name",
    "SELECT id, list_min(list_filter(list_transform(regexp_extract_all(dokument, '(?:^|[^0-9])(20[0-9]{2})', 1), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 2015 AND 2035)) AS jahr_name FROM position_store WHERE NOT regexp_matches(dokument, '(?:^|[^0-9])20[0-9]{3}')",
)
def year_in_name(t):
    rows = t("position_store").where(~F.col("dokument").rlike("(?:^|[^0-9])20[0-9]{3}"))
    return rows.select("id", X.year_in_name(F.col("dokument")).alias("jahr_name"))


@query(
    "r2_17_year_after_label",
    """SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)Saldo.{0,50}?\\b(20\\d\\d)\\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(text, '(?i)für das Jahr.{0,50}?\\b(20\\d\\d)\\b', 1), '') AS INT)) AS jahr FROM documents WHERE text IS NOT NULL""",
)
def year_after_label(t):
    return t("documents").where("text is not null").select("doc_id", X.year_after(F.col("text"), ["Saldo", "für das Jahr"]).alias("jahr"))


@query(
    "r2_18_glyphs",
    "SELECT word_id, regexp_replace(replace(replace(text, '(cid:228)', 'ä'), '(cid:252)', 'ü'), '\\(cid:\\d+\\)', '', 'g') AS wort FROM tagged_words WHERE contains(text, '(cid:')",
)
def glyphs(t):
    return t("tagged_words").where(F.col("text").contains("(cid:")).select("word_id", X.resolved_glyphs(F.col("text")).alias("wort"))


@query(
    "r2_19_clean_issuers",
    "SELECT entry_id, trim(regexp_replace(trim(aussteller_name, ' '), ',? *(?:CH-)?\\d{4} *[A-ZÄÖÜ][\\wäöüéè\\- ]*$', '')) AS name FROM aussteller WHERE aussteller_name IS NOT NULL",
)
def clean_issuers(t):
    s = F.trim(F.regexp_replace(F.trim("aussteller_name"), ",? *(?:CH-)?\\d{4} *[A-ZÄÖÜ][\\wäöüéè\\- ]*$", ""))
    return t("aussteller").where("aussteller_name is not null").select("entry_id", s.alias("name"))


@query(
    "r2_21_name_tokens",
    "SELECT member_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(first_name || ' ' || last_name)), '[\\s,]+'), lambda w: w <> ''))), ' ') AS tokens FROM family",
)
def name_tokens(t):
    return t("family").select("member_id", F.array_join(X.name_tokens(F.concat_ws(" ", "first_name", "last_name")), " ").alias("tokens"))


@query("r2_22_safe_stems", "SELECT member_id, regexp_replace(strip_accents(last_name || ', ' || first_name), '[^A-Za-z0-9._-]', '_', 'g') AS stamm FROM family")
def safe_stems(t):
    return t("family").select("member_id", X.safe_stem(F.concat_ws(", ", "last_name", "first_name")).alias("stamm"))


@query(
    "r2_23_short_issuers",
    """WITH s AS (SELECT ref_id, trim(regexp_replace(kanonischer_name, '(?i)[ ,]+(?:AG|SA|GmbH|Genossenschaft|& Co\\.?|Aktiengesellschaft|S\\.A\\.|A\\.G\\.)$', '')) AS s FROM aussteller_referenz)
    SELECT ref_id, CASE WHEN length(s) <= 20 THEN s WHEN regexp_extract(substr(s, 1, 21), '^(.*)\\s', 1) <> '' THEN trim(regexp_extract(substr(s, 1, 21), '^(.*)\\s', 1)) ELSE substr(s, 1, 20) END AS kurz FROM s""",
)
def short_issuers(t):
    return t("aussteller_referenz").select("ref_id", X.short_issuer(F.col("kanonischer_name"), 20).alias("kurz"))


@query("r2_24_core_names", "SELECT substr(regexp_replace(lower(coalesce(aussteller, '')), '[^a-z]', '', 'g'), 1, 8) AS kern, count(DISTINCT aussteller) AS namen, count(*) AS n FROM position_store GROUP BY 1")
def core_names(t):
    return t("position_store").groupBy(X.core_name(F.col("aussteller")).alias("kern")).agg(F.countDistinct("aussteller").alias("namen"), F.count("*").alias("n"))


@query("r2_25_account_keys", "SELECT id, upper(nullif(regexp_extract(dokument, '(\\d{6,})', 1), '')) AS konto FROM position_store")
def account_keys(t):
    return t("position_store").select("id", X.account_key(F.col("dokument")).alias("konto"))


@query("r2_27_fingerprints", "SELECT entry_id, substr(sha256(coalesce(aussteller_name, '') || '|' || coalesce(belegtyp, '')), 1, 12) AS abdruck FROM aussteller")
def fingerprints(t):
    return t("aussteller").select("entry_id", X.fingerprint(F.col("aussteller_name"), F.col("belegtyp")).alias("abdruck"))


@query("r2_28_position_keys", "SELECT id, dokument || '|' || label || CASE WHEN pos > 1 THEN '#' || pos ELSE '' END AS schluessel, dokument AS doc, label AS target, pos FROM position_store")
def position_keys(t):
    keys = t("position_store").select("id", X.position_key(F.col("dokument"), F.col("label"), F.col("pos")).alias("schluessel"))
    return keys.select("id", "schluessel", X.position_parts(F.col("schluessel")).alias("p")).select("id", "schluessel", "p.*")


@query("r2_29_line_order", "SELECT ziffer, row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(ziffer, '') AS INT), 999), ziffer) AS rang FROM (SELECT DISTINCT ziffer FROM position_store)")
def line_order(t):
    from pyspark.sql import Window as W

    lines = t("position_store").select("ziffer").distinct()  # a handful of form lines
    return lines.select("ziffer", F.row_number().over(W.orderBy(X.line_order(F.col("ziffer")), "ziffer")).cast("bigint").alias("rang"))


@query("r2_30_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS anfang FROM documents WHERE text IS NOT NULL")
def ellipsis(t):
    return t("documents").where("text is not null").select("doc_id", X.ellipsis(F.col("text"), 60).alias("anfang"))


@query("r2_31_unmasked_numbers", "SELECT count(*) AS n FROM field_rows WHERE snippet IS NOT NULL AND NOT regexp_matches(snippet, '[xX*#]') AND length(regexp_replace(snippet, '\\D', '', 'g')) >= 6")
def unmasked_numbers(t):
    return t("field_rows").where("snippet is not null").where(X.unmasked_number(F.col("snippet"))).agg(F.count("*").alias("n"))


@query("r2_34_anchors", "SELECT row_id, anchor_page AS seite, round(anchor_bbox[1], 1) AS x0, round(anchor_bbox[4], 1) AS bottom FROM field_rows WHERE anchor_bbox IS NOT NULL AND anchor_page IS NOT NULL")
def anchors(t):
    rows = t("field_rows").where("anchor_bbox is not null and anchor_page is not null").select("row_id", X.anchor_parts(X.anchor_text(F.col("anchor_page"), F.col("anchor_bbox"))).alias("a"))
    return rows.select("row_id", F.col("a.page").alias("seite"), F.col("a.bbox")[0].alias("x0"), F.col("a.bbox")[3].alias("bottom"))


@query(
    "r2_40_value_states",
    """SELECT feld, CASE WHEN wert_raw IS NULL THEN 'absent' WHEN starts_with(lower(trim(wert_raw, ' ')), 'manual_review') THEN 'marker' WHEN lower(trim(wert_raw, ' ')) = 'not_in_beleg_by_design' THEN 'by_design'
    WHEN lower(trim(wert_raw, ' ')) IN ('', '-', '–', '—', '-.-', '–.–', '.--', 'n/a', 'null', 'none', 'unbekannt') THEN 'placeholder' WHEN TRY_CAST(wert_decimal AS DECIMAL(18,2)) = 0 THEN 'zero' ELSE 'real' END AS zustand, count(*) AS n FROM field_rows GROUP BY 1, 2""",
)
def value_states(t):
    state = X.value_state(F.col("wert_raw"), F.col("wert_decimal").try_cast("decimal(18,2)"))
    return t("field_rows").groupBy("feld", state.alias("zustand")).agg(F.count("*").alias("n"))


@query("r2_41_zero_rows", "SELECT belegtyp, sum(CASE WHEN TRY_CAST(wert_decimal AS DOUBLE) = 0 THEN 1 ELSE 0 END)::BIGINT AS null_zeilen, count(*) AS n FROM field_rows GROUP BY 1")
def zero_rows(t):
    zero = F.coalesce(F.col("wert_decimal").try_cast("double") == 0, F.lit(False))
    return t("field_rows").groupBy("belegtyp").agg(F.count_if(zero).alias("null_zeilen"), F.count("*").alias("n"))


@query(
    "r2_42_first_rule",
    "SELECT regel, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, 'Mahngebühr|Mahnung') THEN 'mahnung' WHEN regexp_matches(text, '(?i)\\bcopie|kopie\\b') THEN 'kopie' WHEN source = 'merkblatt' THEN 'merkblatt' ELSE 'beleg' END AS regel FROM documents) GROUP BY 1",
)
def first_rule(t):
    rules = [(F.col("text").rlike("Mahngebühr|Mahnung"), "mahnung"), (F.col("text").rlike("(?i)\\bcopie|kopie\\b"), "kopie"), (F.col("source") == "merkblatt", "merkblatt")]
    return t("documents").groupBy(X.first_rule(rules, "beleg").alias("regel")).agg(F.count("*").alias("n"))


@query(
    "r2_48_one_of_two",
    """SELECT doc_id, CASE WHEN regexp_matches(text, 'fehlt|manque|missing|manca') AND NOT regexp_matches(text, 'liegt bei|est jointe|is attached|è allegata') THEN true WHEN regexp_matches(text, 'liegt bei|est jointe|is attached|è allegata') AND NOT regexp_matches(text, 'fehlt|manque|missing|manca') THEN false END AS offen FROM documents WHERE text IS NOT NULL""",
)
def one_of_two(t):
    return t("documents").where("text is not null").select("doc_id", X.one_of_two(F.col("text"), "fehlt|manque|missing|manca", "liegt bei|est jointe|is attached|è allegata").alias("offen"))


@query("r17_18_masked_labels", "SELECT regexp_replace(label, '\\d', '9', 'g') AS form, count(*) AS n FROM position_store GROUP BY 1")
def masked_labels(t):
    return t("position_store").groupBy(X.digits_masked(F.col("label")).alias("form")).agg(F.count("*").alias("n"))


@query(
    "r17_16_sole_identifier",
    """WITH f AS (SELECT dokument_id, unnest(regexp_extract_all(upper(snippet), '\\b(?:CH|LI)\\d{2}(?:[ -]?[0-9A-Z]){17}\\b')) AS i FROM field_rows WHERE snippet IS NOT NULL)
    SELECT dokument_id, min(regexp_replace(i, '[ -]', '', 'g')) AS iban FROM f GROUP BY 1 HAVING count(DISTINCT regexp_replace(i, '[ -]', '', 'g')) = 1""",
)
def sole_identifier(t):
    found = t("field_rows").where("snippet is not null").select("dokument_id", F.explode(A.ibans_in(F.col("snippet"))).alias("i"))
    return found.groupBy("dokument_id").agg(F.min("i").alias("iban"), F.countDistinct("i").alias("n")).where("n = 1").drop("n")
