"""Types of receipts and their fields by tables of patterns, and the chain from words to ledger rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions.texts import parsed_date, resolved_glyphs
from ledgerloom.operators.extract import grounded, hits
from ledgerloom.operators.rules import confidence

HEAD_WORDS = 200  #: words in which a title is looked for first

# What the titles of each type are written like.
TYPE_PATTERNS = {
    "lohnausweis": r"\b(Lohnausweis|L[^\p{L}\p{N}_]?hnausw[ei]{1,2}s|Certificat\s+de\s+salaire|Salary\s+Statement|Form\.?\s*11|Bruttolohn\s+total|Nettolohn)\b",
    "bank_zinsausweis": r"\b(Zinsausweis|Steuerausweis|Konto-?auszug|Vermögensausweis|Kapitalbescheinigung|Saldoverzeichnis|Guthabensaldo|Zinsabschluss|Zinsabrechnung|Zinsbescheinigung)\b",
    "kk_praemienbescheinigung": r"(Krankenkasse|Krankenversicherer|Prämienbescheinigung|Prämienübersicht|Prämien-?\s*und\s*Kosten[üu]bersicht|Bescheinigung über die Bezahlung|\bPrämien?\b)",
    "saeule_3a": r"(Säule\s*3a|3a-Konto|3a-Stiftung|gebundene Vorsorge|Form\.?\s*21\b|Vorsorgestiftung\s+3a)",
    "wertschriftenverzeichnis": r"\b(Wertschriften(?:verzeichnis|auszug)|Depot-?(?:auszug|übersicht|verzeichnis)|Steuer-?Reporting|Portfolio[- ]?Auszug|Custodian|Vermögensverwalter|Portfolio-?Wertentwicklung|Vermögensübersicht|Steuerauszug)\b",
    "spenden": r"\b(Spende(?:n)?(?:quittung|bescheinigung)?|Zuwendungs[- ]?bestätigung)\b",
    "berufsauslagen": r"\b(Weiterbildung(?:s|skurs|skosten)?|Berufsauslagen|Kursbestätigung|Aus-?\s*und\s*Weiterbildung)\b",
    "kinderbetreuung": r"\b(Kinderbetreuung|Kita|Krippe|Tagesfamilie|Hort|Mittagstisch|Betreuung(?:sbestätigung|skosten)?)\b",
    "hypothek_zinsbestaetigung": r"\b((?:Fest|Variable|SARON|Libor|Geldmarkt)?-?[Hh]ypothek(?:ar)?(?:zins(?:bestätigung|ausweis)?|kredit)?|Schuld-?Zins(?:bestätigung|ausweis)?|Schuldenausweis)\b",
    "liegenschaftsunterhalt": r"\b(Liegenschaftsunterhalt|Unterhaltskosten|Handwerker-?(?:rechnung|Quittung)|Renovation(?:srechnung)?)\b",
    "krankheitskosten": r"\b(Krankheitskosten|Arzt-?rechnung|Apotheken-?rechnung|Behandlung(?:s|skosten)?|Spital-?rechnung)\b",
    "freizuegigkeitskonto": r"\b(Freiz[üu]gigkeit(?:skonto|sstiftung|sguthaben|sleistung)?|Fronz[üu]gigkeit(?:sstiftung)?|FZK|Vorsorgetechnische(?:\s+Daten)?)\b",
}
UNEMPLOYMENT = r"Arbeitslosenversicherung|Arbeitslosenentsch[äa]digung|\bALV\b.*Taggeld"
ITALIAN_SALARY = r"\bCertificato\s+di\s+salario\b"


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, made by a generator of one row: later expressions refer to their values instead of
    being put together with theirs, which would grow with every step."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def classified(docs: DataFrame, text: str, *, head: int = HEAD_WORDS) -> DataFrame:
    """``docs`` with typ and grund: the type with most different titles in the first ``head`` words, else in all.

    What an unemployment fund issues is no type of its own; a vested-benefits title goes before all, premiums before
    the illness costs listed with them, a mortgage before the bank, a salary title wins ties, and of a tie of bank and
    premiums the bank wins if the head has a valid account number. Other ties and no title at all are ``unknown``, with
    the reason. One projection: a document is read once, nothing is shuffled.
    """
    words = F.split(F.trim(resolved_glyphs(F.col(text))), "\\s+")
    one = staged(staged(docs, _words=words), _head=F.array_join(F.slice("_words", 1, head), " "), _whole=F.array_join("_words", " "))
    titles = {t: "(?iu)" + p for t, p in TYPE_PATTERNS.items()}
    two = staged(one, **{f"_h_{t}": hits(F.col("_head"), p) for t, p in titles.items()})
    none = F.greatest(*[F.col(f"_h_{t}") for t in titles]) == 0
    three = staged(two, **{f"_s_{t}": F.when(none, hits(F.col("_whole"), p)).otherwise(F.col(f"_h_{t}")) for t, p in titles.items()})
    s = {t: F.col(f"_s_{t}") for t in titles}
    three = staged(three, _kk=F.when(s["saeule_3a"] > 0, 0).otherwise(s["kk_praemienbescheinigung"]))
    s["kk_praemienbescheinigung"] = F.col("_kk")
    three = staged(three, _most=F.greatest(*s.values()))
    wins = F.array_compact(F.array(*[F.when((v == F.col("_most")) & (v > 0), F.lit(t)) for t, v in s.items()]))
    unemployed = F.col("_head").rlike("(?iu)" + UNEMPLOYMENT) & ~F.col("_head").rlike("(?iu)" + TYPE_PATTERNS["lohnausweis"])
    four = staged(three, _w=wins, _alv=unemployed)
    w = F.col("_w")
    tie = w == F.array(F.lit("bank_zinsausweis"), F.lit("kk_praemienbescheinigung"))
    own_account = F.exists(A.ibans_in(F.col("_head")), lambda i: A.iban_state(i) == "ok")
    typ = (
        F.when(F.col("_alv"), F.when(F.col("_head").rlike("(?iu)" + ITALIAN_SALARY), "lohnausweis").otherwise("unknown"))
        .when(F.size(w) == 0, "unknown")
        .when(s["freizuegigkeitskonto"] > 0, "freizuegigkeitskonto")
        .when((s["kk_praemienbescheinigung"] > 0) & (s["krankheitskosten"] > 0), "kk_praemienbescheinigung")
        .when((s["hypothek_zinsbestaetigung"] > 0) & (s["bank_zinsausweis"] > 0), "hypothek_zinsbestaetigung")
        .when(F.array_contains(w, "lohnausweis"), "lohnausweis")
        .when(tie & own_account, "bank_zinsausweis")
        .when(F.size(w) > 1, "unknown")
        .otherwise(w[0])
    )
    named = staged(four, typ=typ)
    reason = F.when(F.col("typ") == "unknown", F.when(~F.col("_alv") & (F.size(w) > 1), "multiple_belegtyp_match").otherwise("unsupported_type"))
    return named.select(*docs.columns, "typ", reason.alias("grund"))


@dataclass(frozen=True)
class FieldRule:
    """A labelled pattern of a type: field, pattern with one group, kind of value, first or last match; earlier rules of
    a field go first."""

    typ: str
    field: str
    pattern: str
    kind: str = "amount"  # amount | date | text
    last: bool = False


AMOUNT = r"(?:CHF ?|SFr\.? ?|Fr\.? ?)?([0-9][0-9'’]*(?: [0-9]{3})*(?:[.,][0-9]{2}|\.[-–]{1,2})?)(?: |$)"
DAY = r"([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"


def field_rules(labels: Mapping[str, Sequence[tuple]]) -> list[FieldRule]:
    """Rules from (field, label[, kind[, last]]) by type: the value stands right after its label."""
    shape = {"amount": AMOUNT, "date": DAY, "text": ""}
    out = []
    for typ, rows in labels.items():
        for field, label, *more in rows:
            kind = more[0] if more else "amount"
            out.append(FieldRule(typ, field, label + shape[kind], kind, bool(more[1:] and more[1])))
    return out


def typed_fields(docs: DataFrame, text: str, rules: Sequence[FieldRule], keep: Sequence[str], typ: str = "typ") -> DataFrame:
    """(keep, typ, feld, wert, art): the value of each field that the type of a document has, by its first rule that
    matches; NULL where none does, so that gaps are rows too. Wide then long in one projection, no join with rules."""
    by: dict[tuple[str, str], list[FieldRule]] = {}
    for r in rules:
        by.setdefault((r.typ, r.field), []).append(r)

    def found(r: FieldRule) -> Column:
        return F.try_element_at(F.regexp_extract_all(F.col(text), F.lit(r.pattern), F.lit(1)), F.lit(-1 if r.last else 1))

    types = list(dict.fromkeys(t for t, _ in by))
    per = [F.array(*[F.struct(F.lit(f).alias("feld"), F.coalesce(*[found(r) for r in rs]).alias("wert"), F.lit(rs[0].kind).alias("art")) for (t, f), rs in by.items() if t == name]) for name in types]
    fields = None
    for name, array in zip(types, per):
        fields = F.when(F.col(typ) == name, array) if fields is None else fields.when(F.col(typ) == name, array)
    return docs.withColumn("_f", fields).select(*keep, typ, F.inline("_f"))


def ledger_rows(words: DataFrame, rules: Sequence[FieldRule], *, document: str, reading: str, order: str, text: str) -> DataFrame:
    """The chain of one document: newest reading, text, type, fields, parsed values, check against the text, confidence.

    (document, typ, grund, feld, wert, betrag, tag, status, konf): one row a field; documents of no type have one row
    with feld NULL. status is ok, null, garbage or fehlt.
    """
    newest = words.groupBy(document).agg(F.max(reading).alias(reading))
    last = words.join(newest, [document, reading])
    parts = F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    texts = last.groupBy(document).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), " ").alias("_text"))
    typed = classified(texts, "_text")
    fields = typed_fields(typed, "_text", rules, [document, "grund", "_text"])
    none = typed.where(F.col("typ") == "unknown").select(document, "typ", "grund", F.lit(None).cast("string").alias("feld"), F.lit(None).cast("string").alias("wert"), F.lit(None).cast("double").alias("betrag"), F.lit(None).cast("date").alias("tag"), F.lit("fehlt").alias("status"), F.lit(0.0).alias("konf"))
    amount = A.strict_amount(F.col("wert"))
    status = F.when(F.col("wert").isNull(), "fehlt").when(F.col("art") == "amount", F.col("_status")).when((F.col("art") == "date") & parsed_date(F.col("wert")).isNull(), "garbage").otherwise("ok")
    fields = staged(fields, _value=amount["value"], _status=amount["status"])
    rows = fields.select(document, "typ", "grund", "feld", "wert", F.when(F.col("art") == "amount", F.col("_value").cast("double")).alias("betrag"), F.when(F.col("art") == "date", parsed_date(F.col("wert"))).alias("tag"), status.alias("status"), grounded(F.col("wert"), F.col("_text")).alias("_g"))
    conf = confidence(F.when(F.col("status") == "ok", 1.0).when(F.col("status") == "null", 0.8).otherwise(0.0), F.when(F.col("_g"), 1.0).otherwise(0.7), F.lit(1.0))
    return rows.withColumn("konf", conf).drop("_g").unionByName(none)
