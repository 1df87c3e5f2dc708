"""Types, fields and the whole chain of a document, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import classify as K
from ledgerloom.plans.catalog import Catalog
from ledgerloom.plans.scalars import sql_strict

catalog = Catalog()
query = catalog.query

LABELS = {
    "lohnausweis": [
        ("bruttolohn_pos8", "Bruttolohn total "), ("bruttolohn_pos8", "Bruttolohn "), ("bruttolohn_pos8", "Salaire brut "), ("bruttolohn_pos8", "Gross salary "),
        ("ahv_alv_nbu_abzug_pos9", "AHV/IV/EO/ALV/NBUV "), ("bvg_abzug_pos10a", "Berufliche Vorsorge "), ("nettolohn_pos11", "Nettolohn "), ("nettolohn_pos11", "Salaire net "),
        ("periode_von", "von ", "date"), ("periode_bis", "bis ", "date"),
    ],
    "bank_zinsausweis": [
        ("bruttoertrag", "Bruttoertrag "), ("bruttoertrag", "Bruttozins "), ("bruttoertrag", "Zinszahlung "), ("vermoegensstand_3112", r"Saldo per 31\.12\. "), ("vermoegensstand_3112", "Saldo zu Ihren Gunsten "),
        ("vermoegensstand_3112", "Endsaldo ", "amount", True), ("verrechnungssteuer", "Verrechnungssteuer 35 ?% "),
    ],
    "kk_praemienbescheinigung": [("praemie_kvg_total", "Prämien KVG "), ("praemie_vvg_total", "Prämien VVG "), ("selbstgetragene_kosten", "Selbst getragene Kosten ")],
    "saeule_3a": [("einzahlung_betrag", "Einbezahlter Betrag "), ("einzahlung_betrag", "Einzahlung ")],
    "wertschriftenverzeichnis": [("bestand_3112", "Steuerwert Total "), ("bruttoertrag_total", "Bruttoertrag Total "), ("verrechnungssteuer_total", "Anspruch VSt Total ")],
    "spenden": [("betrag", "Spendentotal "), ("betrag", "Total Franken ")],
    "berufsauslagen": [("betrag", "Kurskosten "), ("betrag", "Rechnungstotal ")],
    "kinderbetreuung": [("betrag", "Total Betreuung "), ("betrag", "Rechnungstotal ")],
    "hypothek_zinsbestaetigung": [("schuldzinsen", "Schuldzinsen "), ("schuldsaldo_3112", r"Schuldsaldo 31\.12\. ")],
    "liegenschaftsunterhalt": [("betrag", r"Rechnungstotal inkl\. MWST "), ("betrag", "Rechnungstotal ")],
    "krankheitskosten": [("betrag", "Total Franken "), ("betrag", "Rechnungsbetrag ")],
}
RULES = K.field_rules(LABELS)

# The field that names the issuer of each type.
ISSUER_FIELDS = {
    "lohnausweis": "arbeitgeber",
    "bank_zinsausweis": "institut",
    "kk_praemienbescheinigung": "kasse",
    "saeule_3a": "stiftung",
    "wertschriftenverzeichnis": "institut",
    "spenden": "empfaenger",
    "berufsauslagen": "anbieter",
    "kinderbetreuung": "anbieter",
    "hypothek_zinsbestaetigung": "institut",
    "liegenschaftsunterhalt": "handwerker_anbieter",
    "krankheitskosten": "leistungserbringer",
}


def _q(text: str) -> str:
    return text.replace("'", "''")


def _glyphs_sql(c: str) -> str:
    from ledgerloom.functions.texts import GLYPHS

    for code, letter in GLYPHS.items():
        c = f"replace({c}, '(cid:{code})', '{letter}')"
    return f"regexp_replace({c}, '\\(cid:\\d+\\)', '', 'g')"


def _score_sql(c: str, pattern: str) -> str:
    return f"len(list_distinct(list_transform(regexp_extract_all({c}, '(?i){_q(pattern)}'), lambda m: lower(m))))"


def typed_sql(source: str, key: str, text: str) -> str:
    """A chain of steps that ends in typed(key, text, typ, grund): ``classified`` in SQL.

    DuckDB's word boundary knows ASCII letters only, so letters of other scripts are made ones before titles are sought.
    """
    types = list(K.TYPE_PATTERNS)
    heads = ", ".join(f"{_score_sql('kopf', p)} AS h{i}, {_score_sql('ganz', p)} AS g{i}" for i, p in enumerate(K.TYPE_PATTERNS.values()))
    at = {t: f"s{i}" for i, t in enumerate(types)}
    scores = ", ".join(f"CASE WHEN greatest({', '.join(f'h{j}' for j in range(len(types)))}) = 0 THEN g{i} ELSE h{i} END AS s{i}" for i in range(len(types)))
    kk, a3 = at["kk_praemienbescheinigung"], at["saeule_3a"]
    rest = ", ".join(f"CASE WHEN {a3} > 0 THEN 0 ELSE {kk} END AS {kk}" if s == kk else s for s in at.values())
    wins = "list_filter([" + ", ".join(f"CASE WHEN {s} = most AND most > 0 THEN '{t}' END" for t, s in at.items()) + "], lambda x: x IS NOT NULL)"
    iban = """len(list_filter(list_transform(regexp_extract_all(upper(kopf), '\\b(?:CH|LI)\\d{2}(?:[ -]?[0-9A-Z]){17}\\b'), lambda i: regexp_replace(i, '[ -]', '', 'g')), lambda i:
      length(i) = 21 AND NOT regexp_matches(i, '[X*]{3}') AND list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(i, 5) || substr(i, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS HUGEINT) ELSE CAST(ascii(c) - 55 AS HUGEINT) END)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1)) > 0"""
    return f"""t0 AS (SELECT {key}, {text} AS text, regexp_split_to_array(trim(regexp_replace({_glyphs_sql(text)}, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]', 'x', 'g'), ' '), '\\s+') AS w FROM {source}),
t1 AS (SELECT {key}, text, array_to_string(list_slice(w, 1, {K.HEAD_WORDS}), ' ') AS kopf, array_to_string(w, ' ') AS ganz FROM t0),
t2 AS (SELECT {key}, text, kopf, {heads} FROM t1),
t3 AS (SELECT {key}, text, kopf, {scores} FROM t2),
t4 AS (SELECT {key}, text, kopf, {rest} FROM t3),
t5 AS (SELECT *, greatest({', '.join(at.values())}) AS most, regexp_matches(kopf, '(?i){K.UNEMPLOYMENT}') AND NOT regexp_matches(kopf, '(?i){_q(K.TYPE_PATTERNS['lohnausweis'])}') AS alv FROM t4),
t6 AS (SELECT *, {wins} AS wins FROM t5),
t7 AS (SELECT {key}, text, alv, wins, CASE WHEN alv THEN CASE WHEN regexp_matches(kopf, '(?i){K.ITALIAN_SALARY}') THEN 'lohnausweis' ELSE 'unknown' END WHEN len(wins) = 0 THEN 'unknown'
  WHEN {at['freizuegigkeitskonto']} > 0 THEN 'freizuegigkeitskonto' WHEN {kk} > 0 AND {at['krankheitskosten']} > 0 THEN 'kk_praemienbescheinigung' WHEN {at['hypothek_zinsbestaetigung']} > 0 AND {at['bank_zinsausweis']} > 0 THEN 'hypothek_zinsbestaetigung'
  WHEN list_contains(wins, 'lohnausweis') THEN 'lohnausweis' WHEN wins = ['bank_zinsausweis', 'kk_praemienbescheinigung'] AND {iban} THEN 'bank_zinsausweis' WHEN len(wins) > 1 THEN 'unknown' ELSE wins[1] END AS typ FROM t6),
typed AS (SELECT {key}, text, typ, CASE WHEN typ = 'unknown' THEN CASE WHEN NOT alv AND len(wins) > 1 THEN 'multiple_belegtyp_match' ELSE 'unsupported_type' END END AS grund FROM t7)"""


def fields_sql(key: str) -> str:
    """fields(key, typ, grund, text, feld, wert, art): ``typed_fields`` in SQL, after ``typed``."""
    by: dict[tuple[str, str], list[K.FieldRule]] = {}
    for r in RULES:
        by.setdefault((r.typ, r.field), []).append(r)
    parts = []
    for (typ, field), rules in by.items():
        found = ", ".join(f"regexp_extract_all(text, '{_q(r.pattern)}', 1)[{-1 if r.last else 1}]" for r in rules)
        parts.append(f"SELECT {key}, typ, grund, text, '{field}' AS feld, coalesce({found}) AS wert, '{rules[0].kind}' AS art FROM typed WHERE typ = '{typ}'")
    return "fields AS (" + " UNION ALL ".join(parts) + ")"


_DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_READ = "last AS (SELECT dokument_id, max(eingelesen_am) AS m FROM tagged_words GROUP BY 1), docs AS (SELECT w.dokument_id, string_agg(coalesce(w.text, ''), ' ' ORDER BY w.tag_id, coalesce(w.text, '')) AS text FROM tagged_words w JOIN last l ON w.dokument_id = l.dokument_id AND w.eingelesen_am = l.m GROUP BY 1)"


@query("r9_01_classified", f"WITH {_DOCS}, {typed_sql('docs', 'doc_id', 'text')} SELECT doc_id, typ, grund FROM typed")
def classified(t):
    return K.classified(t("documents").where("text is not null").select("doc_id", "text"), "text").select("doc_id", "typ", "grund")


@query("r9_01_classified_receipts", f"WITH {_READ}, {typed_sql('docs', 'dokument_id', 'text')} SELECT typ, grund, count(*) AS n FROM typed GROUP BY 1, 2")
def classified_receipts(t):
    return _chain(t).select("dokument_id", "typ", "grund").distinct().groupBy("typ", "grund").agg(F.count("*").alias("n"))


def _chain(t):
    return K.ledger_rows(t("tagged_words").where("dokument_id is not null"), RULES, document="dokument_id", reading="eingelesen_am", order="tag_id", text="text")


_LEDGER = (
    f"WITH {_READ}, {typed_sql('docs', 'dokument_id', 'text')}, {fields_sql('dokument_id')}, "
    + sql_strict("fields", "dokument_id, typ, grund, text, feld, wert, art", "wert").removeprefix("WITH ").rstrip()
    + """, ledger AS (SELECT dokument_id, typ, grund, feld, wert, CASE WHEN art = 'amount' THEN value END AS betrag, CASE WHEN art = 'date' THEN CAST(try_strptime(wert, '%d.%m.%Y') AS DATE) END AS tag,
CASE WHEN wert IS NULL THEN 'fehlt' WHEN art = 'amount' THEN status WHEN art = 'date' AND try_strptime(wert, '%d.%m.%Y') IS NULL THEN 'garbage' ELSE 'ok' END AS status FROM amounts
UNION ALL SELECT dokument_id, typ, grund, NULL, NULL, NULL, NULL, 'fehlt' FROM typed WHERE typ = 'unknown')
"""
)


@query("r9_09_ledger_rows", _LEDGER + "SELECT dokument_id, typ, feld, wert, betrag, CAST(tag AS VARCHAR) AS tag, status FROM ledger")
def ledger_rows(t):
    return _chain(t).select("dokument_id", "typ", "feld", "wert", "betrag", F.col("tag").cast("string").alias("tag"), "status")


@query("r9_05_typed_fields", _LEDGER + "SELECT typ, feld, count(*) AS n, count(wert) AS gefunden, round(sum(betrag), 2) AS summe FROM ledger WHERE feld IS NOT NULL GROUP BY 1, 2")
def typed_fields(t):
    return _chain(t).where("feld is not null").groupBy("typ", "feld").agg(F.count("*").alias("n"), F.count("wert").alias("gefunden"), F.round(F.sum("betrag"), 2).alias("summe"))


_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dokument_id, feld ORDER BY geaendert_am DESC, row_id DESC) AS rn FROM field_rows) WHERE rn = 1"
_ISSUER = "CASE belegtyp " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, f in ISSUER_FIELDS.items()) + " END"


def _newest(t):
    from ledgerloom.operators.store import newest

    rows = t("field_rows").select("dokument_id", "feld", F.struct("geaendert_am", "row_id").alias("at"), "belegtyp", "wert_raw", "wert_decimal", "konfidenz", "anchor_valid", "anchor_page", "anchor_bbox", "snippet")
    return newest(rows, ["dokument_id", "feld"], "at")


@query(
    "r9_11_issuer_and_date",
    f"""SELECT dokument_id, belegtyp, max(CASE WHEN feld = {_ISSUER} THEN wert_raw END) AS aussteller,
    CASE WHEN belegtyp = 'lohnausweis' THEN strftime(try_strptime(max(CASE WHEN feld = 'periode_bis' AND regexp_matches(trim(wert_raw, ' '), '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') THEN trim(wert_raw, ' ') END), '%d.%m.%Y'), '%Y-%m-%d')
    ELSE max(CASE WHEN feld = 'jahr' AND regexp_matches(trim(wert_raw, ' '), '^[0-9]{{4}}$') THEN trim(wert_raw, ' ') || '-12-31' END) END AS datum FROM ({_NEWEST}) GROUP BY 1, 2""",
)
def issuer_and_date(t):
    from ledgerloom.functions.texts import parsed_date

    issuer = F.create_map(*[F.lit(x) for pair in ISSUER_FIELDS.items() for x in pair])
    raw = F.trim("wert_raw")
    german = F.max(F.when((F.col("feld") == "periode_bis") & raw.rlike("^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$"), raw))
    year = F.max(F.when((F.col("feld") == "jahr") & raw.rlike("^[0-9]{4}$"), F.concat(raw, F.lit("-12-31"))))
    date = F.when(F.col("belegtyp") == "lohnausweis", parsed_date(german).cast("string")).otherwise(year)
    return _newest(t).groupBy("dokument_id", "belegtyp").agg(F.max(F.when(F.col("feld") == issuer[F.col("belegtyp")], F.col("wert_raw"))).alias("aussteller"), date.alias("datum"))
