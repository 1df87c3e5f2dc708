"""Store, extraction, rules, gaps, drift and scrubbing over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import texts as X
from ledgerloom.operators import extract as E
from ledgerloom.operators import relate as R
from ledgerloom.operators import rules as Q
from ledgerloom.operators import scrub as C
from ledgerloom.operators import store as S
from ledgerloom.operators import summarize as Z
from ledgerloom.plans.catalog import Catalog
from ledgerloom.plans.scalars import sql_spellings

catalog = Catalog()
query = catalog.query
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dokument_id, feld ORDER BY geaendert_am DESC, row_id DESC) AS rn FROM field_rows) WHERE rn = 1"


def _latest(t):
    rows = t("field_rows").select("dokument_id", "feld", F.struct("geaendert_am", "row_id").alias("at"), "row_id", "belegtyp", "wert_raw", "wert_decimal", "konfidenz", "anchor_valid", "snippet")
    return S.newest(rows, ["dokument_id", "feld"], "at")


# --- store -------------------------------------------------------------------------------------------------------


@query("r8_01_changed_locked", "SELECT a.beleg || '|' || a.zielwert || '|' || a.pos AS k, a.grund AS grund_before, b.grund AS grund_after FROM abgleich a JOIN abgleich_kopie b ON a.beleg = b.beleg AND a.zielwert = b.zielwert AND a.pos = b.pos WHERE a.zustand = 'stimmt' AND b.zustand = 'stimmt' AND a.grund IS DISTINCT FROM b.grund")
def changed_locked(t):
    keyed = lambda n: t(n).withColumn("k", F.concat_ws("|", "beleg", "zielwert", "pos"))
    return S.changed_values(keyed("abgleich"), keyed("abgleich_kopie"), "k", ["grund"], F.col("zustand") == "stimmt")


@query("r8_02_vanished_checked", "SELECT DISTINCT p.dokument, p.zielwert, p.pos FROM position_store p WHERE p.status = 'geprueft' AND NOT EXISTS (SELECT 1 FROM abgleich a WHERE a.beleg = p.dokument AND a.zielwert = p.zielwert AND a.pos = p.pos)")
def vanished_checked(t):
    after = t("abgleich").select(F.col("beleg").alias("dokument"), "zielwert", "pos")
    return S.vanished(t("position_store"), after, ["dokument", "zielwert", "pos"], F.col("status") == "geprueft").select("dokument", "zielwert", "pos").distinct()


@query("r8_03_into_closed", "SELECT id FROM position_store WHERE status = 'vorschlag' AND (dokument, zielwert) IN (SELECT beleg, zielwert FROM abgleich WHERE zustand = 'stimmt')")
def into_closed(t):
    p = t("position_store")
    closed = t("abgleich").where("zustand = 'stimmt'").select(F.col("beleg").alias("dokument"), "zielwert")
    return S.into_closed(p.where("status = 'vorschlag'"), closed, ["dokument", "zielwert"]).select("id")


@query("r8_04_latest_state", "SELECT beleg, zielwert, pos, arg_max(zustand, geaendert_am) AS zustand, count(*) AS entries FROM abgleich GROUP BY 1, 2, 3")
def latest_state(t):
    return S.latest_state(t("abgleich"), ["beleg", "zielwert", "pos"], "zustand", "geaendert_am")


@query("r8_05_checked_positions", "SELECT id, dokument, zielwert, betrag FROM position_store WHERE status = 'geprueft'")
def checked_positions(t):
    return t("position_store").where("status = 'geprueft'").select("id", "dokument", "zielwert", "betrag")


@query(
    "r8_06_merged_version",
    "SELECT coalesce(a.dokument_id, b.dokument_id) AS dokument_id, CASE WHEN b.dokument_id IS NOT NULL THEN b.v ELSE a.v END AS v, CASE WHEN a.dokument_id IS NULL THEN 'insert' WHEN b.dokument_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM (SELECT dokument_id, max(bruttolohn_pos8.value) AS v FROM lohnausweis GROUP BY 1) a FULL OUTER JOIN (SELECT dokument_id, max(bruttolohn_pos8.value) AS v FROM lohnausweis_kopie GROUP BY 1) b ON a.dokument_id = b.dokument_id",
)
def merged_version(t):
    one = lambda n: t(n).groupBy("dokument_id").agg(F.max("bruttolohn_pos8.value").alias("v"))
    return S.merged(one("lohnausweis"), one("lohnausweis_kopie"), ["dokument_id"], ["v"])


@query(
    "r8_06_protocol",
    f"WITH a AS ({_LAST}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dokument_id, feld ORDER BY geaendert_am DESC, row_id DESC) AS rn FROM field_rows_kopie) WHERE rn = 1) SELECT a.dokument_id || '|' || a.feld AS k, 'wert_decimal' AS feld, a.wert_decimal AS vorher, b.wert_decimal AS nachher FROM a JOIN b ON a.dokument_id = b.dokument_id AND a.feld = b.feld WHERE a.wert_decimal IS DISTINCT FROM b.wert_decimal",
)
def protocol(t):
    def last(n):
        rows = t(n).select("dokument_id", F.col("feld").alias("f"), F.struct("geaendert_am", "row_id").alias("at"), "wert_decimal")
        return S.newest(rows, ["dokument_id", "f"], "at").select(F.concat_ws("|", "dokument_id", "f").alias("k"), "wert_decimal")

    return S.protocol(last("field_rows"), last("field_rows_kopie"), "k", ["wert_decimal"])


@query("r8_08_corrected", "SELECT p.id, coalesce(nullif(p.betrag, ''), f.w) AS betrag, CASE WHEN p.betrag <> '' THEN 'ablage' WHEN f.w IS NOT NULL THEN 'feld' END AS quelle FROM position_store p LEFT JOIN (SELECT dokument_id, feld, max(wert_decimal) AS w FROM field_rows GROUP BY 1, 2) f ON f.dokument_id = p.dokument_id AND f.feld = p.zielwert")
def corrected(t):
    f = t("field_rows").groupBy("dokument_id", F.col("feld").alias("zielwert")).agg(F.max("wert_decimal").alias("w"))
    own = F.nullif("betrag", F.lit(""))
    return t("position_store").join(f, ["dokument_id", "zielwert"], "left").select("id", F.coalesce(own, "w").alias("betrag"), F.when(own.isNotNull(), "ablage").when(F.col("w").isNotNull(), "feld").alias("quelle"))


@query(
    "r8_09_field_merged",
    "WITH a AS (SELECT dokument_id, max(bruttolohn_pos8.value) AS b, max(nettolohn_pos11.value) AS n FROM lohnausweis GROUP BY 1), c AS (SELECT dokument_id, max(bruttolohn_pos8.value) AS b, max(nettolohn_pos11.value) AS n FROM lohnausweis_kopie GROUP BY 1) SELECT coalesce(a.dokument_id, c.dokument_id) AS dokument_id, coalesce(nullif(c.b, ''), a.b) AS b, coalesce(nullif(c.n, ''), a.n) AS n FROM a FULL OUTER JOIN c ON a.dokument_id = c.dokument_id",
)
def field_merged(t):
    one = lambda n: t(n).groupBy("dokument_id").agg(F.max("bruttolohn_pos8.value").alias("b"), F.max("nettolohn_pos11.value").alias("n"))
    return S.field_merged(one("lohnausweis"), one("lohnausweis_kopie"), ["dokument_id"], ["b", "n"])


@query("r8_11_decisions", "SELECT beleg, zielwert, aktion FROM (SELECT beleg, zielwert, arg_max(zustand, (geaendert_am, pos)) AS aktion FROM abgleich GROUP BY 1, 2) WHERE aktion <> 'fehlt'")
def decisions(t):
    log = t("abgleich").withColumn("at", F.struct("geaendert_am", "pos"))
    return S.decisions_now(log, ["beleg", "zielwert"], "zustand", "at", "fehlt").withColumnRenamed("zustand", "aktion")


@query("r8_12_renamed", "SELECT a.beleg, coalesce(m.neu, a.beleg) AS dokument, a.zielwert, a.pos FROM abgleich a LEFT JOIN (SELECT DISTINCT dokument AS alt, dokument_id || '.pdf' AS neu FROM position_store WHERE dokument LIKE 'scan%') m ON m.alt = a.beleg")
def renamed(t):
    m = t("position_store").where("dokument like 'scan%'").select(F.col("dokument").alias("alt"), F.concat("dokument_id", F.lit(".pdf")).alias("neu")).distinct()
    return S.renamed(t("abgleich").withColumn("dokument", F.col("beleg")), m, "dokument", "alt", "neu").select("beleg", "dokument", "zielwert", "pos")


@query("r8_15_unfinished", "SELECT DISTINCT dokument_id, feld FROM field_rows a WHERE NOT EXISTS (SELECT 1 FROM field_rows_kopie b WHERE a.dokument_id = b.dokument_id AND a.feld = b.feld AND a.geaendert_am = b.geaendert_am)")
def unfinished(t):
    k = lambda n: t(n).select(F.concat_ws("|", "dokument_id", "feld").alias("k"), "dokument_id", "feld", "geaendert_am")
    return S.unfinished(k("field_rows"), k("field_rows_kopie"), "k", ["geaendert_am"]).select("dokument_id", "feld").distinct()


@query("r8_16_superseded", "SELECT row_id FROM field_rows a JOIN (SELECT dokument_id, feld, max(geaendert_am) AS m FROM field_rows GROUP BY 1, 2) b USING (dokument_id, feld) WHERE a.geaendert_am < b.m")
def superseded(t):
    return S.superseded(t("field_rows"), ["dokument_id", "feld"], "geaendert_am").select("row_id")


# --- classification and extraction -------------------------------------------------------------------------------

_TYPES = {"lohn": "Bruttolohn|Nettolohn|Salaire|Salario|Gross salary", "bank": "Saldo|Zins|solde|interesse|interest", "spende": "Spende|donation", "praemie": "Prämie|prime|premium"}


def _hits_sql(c: str, p: str) -> str:
    return f"len(list_distinct(list_transform(regexp_extract_all({c}, '{p}'), lambda m: lower(m))))"


_TYPED = "WITH h AS (SELECT doc_id, text, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 200), ' ') AS kopf FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, " + ", ".join(
    f"{_hits_sql('kopf', p)} AS h{i}, {_hits_sql('text', p)} AS g{i}" for i, p in enumerate(_TYPES.values())
) + " FROM h), z AS (SELECT doc_id, " + ", ".join(f"CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN g{i} ELSE h{i} END AS s{i}" for i in range(4)) + """ FROM s)
SELECT doc_id, CASE WHEN greatest(s0, s1, s2, s3) = 0 THEN 'unknown' WHEN (s0 = greatest(s0, s1, s2, s3))::INT + (s1 = greatest(s0, s1, s2, s3))::INT + (s2 = greatest(s0, s1, s2, s3))::INT + (s3 = greatest(s0, s1, s2, s3))::INT > 1 THEN 'multiple'
 WHEN s0 = greatest(s0, s1, s2, s3) THEN 'lohn' WHEN s1 = greatest(s0, s1, s2, s3) THEN 'bank' WHEN s2 = greatest(s0, s1, s2, s3) THEN 'spende' ELSE 'praemie' END AS typ, greatest(s0, s1, s2, s3)::BIGINT AS treffer FROM z"""


@query("r9_01_typed", _TYPED)
def typed(t):
    docs = t("documents").where("text is not null").select("doc_id", "text")
    return E.typed(docs, "text", _TYPES, head=200).select("doc_id", "typ", F.col("treffer").cast("bigint").alias("treffer"))


@query("r9_02_constrained", "SELECT d.doc_id, CASE WHEN list_contains(a.l, d.belegtyp) THEN d.belegtyp ELSE a.l[1] END AS typ FROM documents d JOIN (SELECT dossier_id, list_sort(list(DISTINCT belegtyp)) AS l FROM field_rows GROUP BY 1) a USING (dossier_id)")
def constrained(t):
    allowed = t("field_rows").groupBy("dossier_id").agg(F.array_sort(F.collect_set("belegtyp")).alias("l"))
    typ = F.when(F.coalesce(F.array_contains("l", F.col("belegtyp")), F.lit(False)), F.col("belegtyp")).otherwise(F.col("l")[0])
    return t("documents").join(allowed, "dossier_id").select("doc_id", typ.alias("typ"))


_RULES = [
    E.Rule("brutto", "Bruttolohn (?:CHF |Fr\\. )?([0-9'’]+[.,][0-9]{2})"),
    E.Rule("brutto", "Gross salary (?:CHF |Fr\\. )?([0-9'’]+[.,][0-9]{2})"),
    E.Rule("brutto", "Salaire brut (?:CHF |Fr\\. )?([0-9'’]+[.,][0-9]{2})"),
    E.Rule("saldo", "(?:Saldo|Guthaben) per [0-9.]+ beträgt (?:CHF |Fr\\. )?([0-9'’]+[.,][0-9]{2})", last=True),
]
_AMT = "([0-9''’]+[.,][0-9]{2})"


@query(
    "r9_05_extracted",
    f"""SELECT doc_id, coalesce(regexp_extract_all(text, 'Bruttolohn (?:CHF |Fr\\. )?{_AMT}', 1)[1], regexp_extract_all(text, 'Gross salary (?:CHF |Fr\\. )?{_AMT}', 1)[1], regexp_extract_all(text, 'Salaire brut (?:CHF |Fr\\. )?{_AMT}', 1)[1]) AS brutto,
    regexp_extract_all(text, '(?:Saldo|Guthaben) per [0-9.]+ beträgt (?:CHF |Fr\\. )?{_AMT}', 1)[-1] AS saldo FROM documents WHERE text IS NOT NULL""",
)
def extracted(t):
    return E.extracted(t("documents").where("text is not null").select("doc_id", "text"), "text", _RULES).select("doc_id", "brutto", "saldo")


@query(
    "r9_06_provenance",
    "SELECT f.row_id, coalesce(p.betrag, f.wert_decimal) AS wert, CASE WHEN p.betrag IS NOT NULL THEN 'regel' WHEN f.wert_decimal IS NOT NULL THEN 'modell' END AS herkunft FROM field_rows f LEFT JOIN (SELECT dokument_id, zielwert AS feld, min(nullif(betrag, '')) AS betrag FROM position_store WHERE herkunft = 'label' GROUP BY 1, 2) p USING (dokument_id, feld)",
)
def provenance(t):
    p = t("position_store").where("herkunft = 'label'").groupBy("dokument_id", F.col("zielwert").alias("feld")).agg(F.min(F.nullif("betrag", F.lit(""))).alias("b"))
    j = t("field_rows").join(p, ["dokument_id", "feld"], "left")
    return j.select("row_id", E.ruled(F.col("b"), F.col("wert_decimal")).alias("e")).select("row_id", "e.wert", "e.herkunft")


@query("r9_07_grounded", "SELECT row_id, coalesce(contains(regexp_replace(lower(snippet), '[.,''’\\s]', '', 'g'), regexp_replace(lower(wert_raw), '[.,''’\\s]', '', 'g')), false) AS belegt FROM field_rows")
def grounded(t):
    return t("field_rows").select("row_id", E.grounded(F.col("wert_raw"), F.col("snippet")).alias("belegt"))


@query("r9_10_attributed", "SELECT dokument_id, CASE WHEN count(DISTINCT nullif(person, '')) = 1 THEN min(nullif(person, '')) WHEN count(DISTINCT nullif(person, '')) > 1 THEN 'gemeinsam' END AS person FROM position_store GROUP BY 1")
def attributed(t):
    return t("position_store").groupBy("dokument_id").agg(F.collect_set(F.nullif("person", F.lit(""))).alias("r")).select("dokument_id", E.attributed(F.col("r")).alias("person"))


@query("r9_12_buckets", f"SELECT eimer, count(*) AS n FROM (SELECT dokument_id, CASE WHEN bool_and(coalesce(anchor_valid, false)) THEN 'extracted' WHEN bool_or(coalesce(anchor_valid, false)) THEN 'unverified' ELSE 'unprocessed' END AS eimer FROM ({_LAST}) GROUP BY 1) GROUP BY 1")
def buckets(t):
    ok = F.coalesce("anchor_valid", F.lit(False))
    docs = _latest(t).groupBy("dokument_id").agg(F.when(F.bool_and(ok), "extracted").when(F.bool_or(ok), "unverified").otherwise("unprocessed").alias("eimer"))
    return docs.groupBy("eimer").agg(F.count("*").alias("n"))


# --- rules -------------------------------------------------------------------------------------------------------

_WIDE = f"""SELECT dokument_id, max(CASE WHEN feld = 'bruttolohn_pos8' THEN w END) AS brutto, max(CASE WHEN feld = 'nettolohn_pos11' THEN w END) AS netto, max(CASE WHEN feld = 'ahv_alv_nbu_abzug_pos9' THEN w END) AS ahv, max(CASE WHEN feld = 'bvg_abzug_pos10a' THEN w END) AS bvg
 FROM (SELECT dokument_id, feld, TRY_CAST(wert_decimal AS DOUBLE) AS w FROM ({_LAST}) WHERE belegtyp = 'lohnausweis') GROUP BY 1"""


def _wide(t):
    w = _latest(t).where("belegtyp = 'lohnausweis'").withColumn("w", F.col("wert_decimal").try_cast("double"))
    of = lambda f: F.max(F.when(F.col("feld") == f, F.col("w")))
    return w.groupBy("dokument_id").agg(of("bruttolohn_pos8").alias("brutto"), of("nettolohn_pos11").alias("netto"), of("ahv_alv_nbu_abzug_pos9").alias("ahv"), of("bvg_abzug_pos10a").alias("bvg"))


@query(
    "r10_03_findings",
    f"""WITH w AS ({_WIDE}) SELECT dokument_id, 'summe' AS code, 'unstimmig' AS severity FROM w WHERE abs(brutto - (netto + ahv + bvg)) > 5 UNION ALL SELECT dokument_id, 'verhaeltnis', 'hinweis' FROM w WHERE abs(ahv - brutto * 0.064) > abs(brutto * 0.064) * 0.05
    UNION ALL SELECT dokument_id, 'vertauscht', 'unstimmig' FROM w WHERE (brutto = netto AND brutto <> 0) OR netto > brutto UNION ALL SELECT dokument_id, 'bereich', 'hinweis' FROM w WHERE brutto < 0 OR brutto > 1000000""",
)
def rule_findings(t):
    c = F.col
    checks = [
        Q.Check("summe", "unstimmig", Q.off_sum(c("brutto"), [c("netto"), c("ahv"), c("bvg")], 5)),
        Q.Check("verhaeltnis", "hinweis", Q.off_ratio(c("ahv"), c("brutto"), 0.064, 0.05)),
        Q.Check("vertauscht", "unstimmig", Q.swapped(c("brutto"), c("netto"))),
        Q.Check("bereich", "hinweis", Q.outside(c("brutto"), 0, 1_000_000)),
    ]
    return Q.findings(_wide(t), ["dokument_id"], checks)


@query("r10_01_confidence", "SELECT row_id, greatest(0.0, least(1.0, konfidenz * CASE WHEN anchor_valid THEN 1.0 ELSE 0.7 END * CASE WHEN wert_decimal IS NULL THEN 0.85 ELSE 1.0 END)) AS konf FROM field_rows WHERE konfidenz IS NOT NULL")
def confidence(t):
    valid = F.when(F.col("anchor_valid"), 1.0).otherwise(0.7)
    penalty = F.when(F.col("wert_decimal").isNull(), 0.85).otherwise(1.0)
    return t("field_rows").where("konfidenz is not null").select("row_id", Q.confidence(F.col("konfidenz"), valid, penalty).alias("konf"))


@query("r10_07_levels", "SELECT CASE WHEN konfidenz >= 0.85 THEN 'sicher' WHEN konfidenz >= 0.6 THEN 'pruefen' ELSE 'unsicher' END AS stufe, count(*) AS n FROM field_rows WHERE konfidenz IS NOT NULL GROUP BY 1")
def levels(t):
    return t("field_rows").where("konfidenz is not null").groupBy(Q.level(F.col("konfidenz"), [(0.6, "pruefen"), (0.85, "sicher")], "unsicher").alias("stufe")).agg(F.count("*").alias("n"))


@query(
    "r10_08_outside_bands",
    "WITH v AS (SELECT feld, row_id, TRY_CAST(wert_decimal AS DOUBLE) AS w FROM field_rows WHERE wert_decimal IS NOT NULL), b AS (SELECT feld, avg(w) - 2 * stddev_samp(w) AS lo, avg(w) + 2 * stddev_samp(w) AS hi FROM v GROUP BY 1) SELECT row_id FROM v JOIN b USING (feld) WHERE w < lo OR w > hi",
)
def outside_bands(t):
    v = t("field_rows").where("wert_decimal is not null").select("feld", "row_id", F.col("wert_decimal").try_cast("double").alias("w"))
    bands = v.groupBy("feld").agg((F.avg("w") - 2 * F.stddev_samp("w")).alias("lo"), (F.avg("w") + 2 * F.stddev_samp("w")).alias("hi"))
    return Q.in_bands(v, bands, "feld", "w").select("row_id")


@query(
    "r10_09_missing_types",
    "WITH e AS (SELECT DISTINCT f.dossier_id, c.belegtyp FROM family f JOIN (VALUES ('mann', 'lohnausweis'), ('frau', 'lohnausweis'), ('mann', 'saeule_3a'), ('kind1', 'kinderbetreuung')) c(role, belegtyp) USING (role)) SELECT dossier_id, belegtyp FROM e WHERE NOT EXISTS (SELECT 1 FROM field_rows r WHERE r.dossier_id = e.dossier_id AND r.belegtyp = e.belegtyp)",
)
def missing_types(t):
    spark = t("family").sparkSession
    concepts = spark.createDataFrame([("mann", "lohnausweis"), ("frau", "lohnausweis"), ("mann", "saeule_3a"), ("kind1", "kinderbetreuung")], "role string, belegtyp string")
    return Q.missing_pairs(t("family"), concepts, t("field_rows"), "dossier_id", "belegtyp", "role")


@query(
    "r10_12_recomputed",
    f"WITH w AS (SELECT dokument_id, max(CASE WHEN feld = 'schuldsaldo_3112' THEN TRY_CAST(wert_decimal AS DOUBLE) END) AS s, max(CASE WHEN feld = 'schuldzinsen' THEN TRY_CAST(wert_decimal AS DOUBLE) END) AS z FROM ({_LAST}) GROUP BY 1) SELECT dokument_id, CAST(round(CAST(s AS DECIMAL(18,2)) * 0.02, 2) AS DOUBLE) AS erwartet, abs(CAST(round(CAST(s AS DECIMAL(18,2)) * 0.02, 2) AS DOUBLE) - z) <= 0.5 AS stimmt FROM w WHERE s IS NOT NULL AND z IS NOT NULL",
)
def recomputed(t):
    of = lambda f: F.max(F.when(F.col("feld") == f, F.col("wert_decimal").try_cast("double")))
    w = _latest(t).groupBy("dokument_id").agg(of("schuldsaldo_3112").alias("s"), of("schuldzinsen").alias("z")).where("s is not null and z is not null")
    expected = Q.recomputed(F.col("s"), F.lit(2.0), F.lit(360))
    return w.select("dokument_id", expected.alias("erwartet"), (F.abs(expected - F.col("z")) <= 0.5).alias("stimmt"))


# --- gaps and readiness ------------------------------------------------------------------------------------------


@query("r11_01_causes", "SELECT belegtyp, feld, CASE WHEN wert_raw IS NULL OR wert_raw = '' THEN 'fehlt' WHEN wert_raw LIKE 'manual_review%' THEN 'marke' WHEN NOT coalesce(anchor_valid, false) THEN 'kein_anker' WHEN konfidenz < 0.5 THEN 'unsicher' ELSE 'ok' END AS ursache, count(*) AS n FROM field_rows GROUP BY 1, 2, 3")
def causes(t):
    rules = [(F.col("wert_raw").isNull() | (F.col("wert_raw") == ""), "fehlt"), (F.col("wert_raw").startswith("manual_review"), "marke"), (~F.coalesce("anchor_valid", F.lit(False)), "kein_anker"), (F.col("konfidenz") < 0.5, "unsicher")]
    return t("field_rows").groupBy("belegtyp", "feld", X.first_rule(rules, "ok").alias("ursache")).agg(F.count("*").alias("n"))


@query("r11_02_state_matrix", "SELECT zielwert, sum((status = 'geprueft')::INT)::BIGINT AS geprueft, sum((status = 'vorschlag' AND betrag <> '')::INT)::BIGINT AS offen, sum((betrag = '')::INT)::BIGINT AS ohne_betrag, sum((person = '')::INT)::BIGINT AS ohne_person FROM position_store GROUP BY 1")
def state_matrix(t):
    return t("position_store").groupBy("zielwert").agg(
        F.count_if(F.col("status") == "geprueft").alias("geprueft"), F.count_if((F.col("status") == "vorschlag") & (F.col("betrag") != "")).alias("offen"), F.count_if(F.col("betrag") == "").alias("ohne_betrag"), F.count_if(F.col("person") == "").alias("ohne_person")
    )


@query(
    "r11_03_readiness",
    """SELECT 'positionen_geprueft' AS punkt, sum((status <> 'geprueft')::INT)::BIGINT AS betroffen FROM position_store UNION ALL SELECT 'betrag_vorhanden', sum((betrag = '')::INT)::BIGINT FROM position_store UNION ALL SELECT 'anker_gueltig', sum((NOT anchor_valid)::INT)::BIGINT FROM field_rows UNION ALL SELECT 'abgleich_stimmt', sum((zustand <> 'stimmt')::INT)::BIGINT FROM abgleich""",
)
def readiness(t):
    points = [("position_store", "positionen_geprueft", F.col("status") != "geprueft"), ("position_store", "betrag_vorhanden", F.col("betrag") == ""), ("field_rows", "anker_gueltig", ~F.col("anchor_valid")), ("abgleich", "abgleich_stimmt", F.col("zustand") != "stimmt")]
    parts = [t(n).agg(F.lit(p).alias("punkt"), F.count_if(test).alias("betroffen")) for n, p, test in points]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("r11_07_found_corrections", "SELECT (dokument IS NOT NULL) AS gefunden, count(*) AS n FROM abgleich a LEFT JOIN (SELECT DISTINCT dokument, zielwert, pos FROM position_store) p ON p.dokument = a.beleg AND p.zielwert = a.zielwert AND p.pos = a.pos GROUP BY 1")
def found_corrections(t):
    p = t("position_store").select(F.col("dokument").alias("beleg"), "zielwert", "pos").distinct().withColumn("da", F.lit(True))
    return t("abgleich").join(p, ["beleg", "zielwert", "pos"], "left").groupBy(F.coalesce("da", F.lit(False)).alias("gefunden")).agg(F.count("*").alias("n"))


@query(
    "r11_08_proof_in_words",
    f"""WITH f AS (SELECT id, dokument_id, unnest({sql_spellings('CAST(betrag AS DECIMAL(18,2))')}) AS form FROM position_store WHERE regexp_matches(betrag, '^\\d+(\\.\\d+)?$')),
    w AS (SELECT DISTINCT dokument_id, regexp_replace(text, '^[(\\[]|[),;:\\]]$', '', 'g') AS form FROM tagged_words) SELECT id, count(*) AS belege FROM f JOIN w USING (dokument_id, form) GROUP BY 1""",
)
def proof_in_words(t):
    forms = t("position_store").where(F.col("betrag").rlike("^\\d+(\\.\\d+)?$")).select("id", "dokument_id", F.explode(A.spellings(F.col("betrag").try_cast("decimal(18,2)"))).alias("form"))
    tokens = t("tagged_words").select("dokument_id", F.regexp_replace("text", "^[(\\[]|[),;:\\]]$", "").alias("form")).distinct()
    return forms.join(tokens, ["dokument_id", "form"]).groupBy("id").agg(F.count("*").alias("belege"))


# --- drift -------------------------------------------------------------------------------------------------------


@query("r12_01_version_diff", "WITH a AS (SELECT dokument_id, feld, max(wert_decimal) AS w FROM field_rows GROUP BY 1, 2), b AS (SELECT dokument_id, feld, max(wert_decimal) AS w FROM field_rows_kopie GROUP BY 1, 2) SELECT CASE WHEN b.feld IS NULL THEN 'only_left' WHEN a.feld IS NULL THEN 'only_right' WHEN a.w IS NOT DISTINCT FROM b.w THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.dokument_id = b.dokument_id AND a.feld = b.feld GROUP BY 1")
def version_diff(t):
    one = lambda n: t(n).groupBy("dokument_id", "feld").agg(F.max("wert_decimal").alias("w"))
    return R.compared(one("field_rows"), one("field_rows_kopie"), ["dokument_id", "feld"], "w").groupBy("state").agg(F.count("*").alias("n"))


@query("r12_02_counts_before_after", "SELECT coalesce(a.feld, b.feld) AS feld, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT feld, count(*) AS n FROM field_rows GROUP BY 1) a FULL OUTER JOIN (SELECT feld, count(*) AS n FROM field_rows_kopie GROUP BY 1) b ON a.feld = b.feld")
def counts_before_after(t):
    n = lambda x, c: t(x).groupBy("feld").agg(F.count("*").alias(c))
    j = n("field_rows", "before").join(n("field_rows_kopie", "after"), "feld", "full_outer")
    return j.select("feld", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("r12_03_breakdown", "SELECT jahr, sum((herkunft = 'label')::INT)::BIGINT AS label, sum((herkunft = 'modell')::INT)::BIGINT AS modell, sum((herkunft = 'geometrie')::INT)::BIGINT AS geometrie, sum((herkunft = 'mensch')::INT)::BIGINT AS mensch, sum((herkunft NOT IN ('label', 'modell', 'geometrie', 'mensch'))::INT)::BIGINT AS andere FROM position_store GROUP BY 1")
def breakdown(t):
    return Z.pivoted(t("position_store"), ["jahr"], "herkunft", {c: c for c in ("label", "modell", "geometrie", "mensch")})


# --- scrubbing ---------------------------------------------------------------------------------------------------


@query("r13_05_scan_report", " UNION ALL ".join(f"SELECT row_id, '{k}' AS category, substr(sha256(m), 1, 8) AS hash8 FROM (SELECT row_id, unnest(regexp_extract_all(snippet, '{p}')) AS m FROM field_rows WHERE snippet IS NOT NULL)" for k, p in C.PATTERNS.items()))
def scan_report(t):
    return C.scanned(t("field_rows"), ["row_id"], "snippet")


def _scrub_sql() -> str:
    out = "snippet"
    for k, p in C.PATTERNS.items():
        out = f"regexp_replace({out}, '{p}', '[{k.upper()}]', 'g')"
    return f"SELECT row_id, {out} AS text FROM field_rows WHERE snippet IS NOT NULL"


@query("r13_06_scrubbed", _scrub_sql())
def scrubbed(t):
    return t("field_rows").where("snippet is not null").select("row_id", C.scrubbed(F.col("snippet")).alias("text"))


@query("r13_03_years_not_postcodes", "SELECT count(*) AS n FROM (SELECT text, lead(text) OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id) AS f FROM tagged_words) WHERE regexp_matches(text, '^(19|20)\\d{2}$') AND NOT coalesce(regexp_matches(f, '^[A-ZÄÖÜ][a-zäöü]+(ikon|wil|büel|dorf|hofen|lingen|matt|stetten)\\W*$'), false)")
def years_not_postcodes(t):
    from pyspark.sql import Window as W

    follow = F.lead("text").over(W.partitionBy("dokument_id", "eingelesen_am").orderBy("tag_id"))
    return t("tagged_words").select("text", follow.alias("f")).where(C.year_not_postcode(F.col("text"), F.col("f"))).agg(F.count("*").alias("n"))


def _parts_sql(c: str) -> str:
    words = f"regexp_split_to_array(trim({c}, ' '), '\\s+')"
    return f"CASE WHEN len({words}) > 1 THEN list_concat([trim({c}, ' ')], list_filter({words}, lambda w: length(w) >= 2)) ELSE [trim({c}, ' ')] END"


def _forms_sql() -> str:
    out = []
    for form in C.NAME_FORMS:
        text = f"'{form}'"
        for mark, value in (("{f}", "f"), ("{l}", "l"), ("{i}", "substr(f, 1, 1)")):
            text = f"replace({text}, '{mark}', {value})" if mark in form else text
        out.append(text)
    return ", ".join(out)


_VARIANTS = f"SELECT DISTINCT member_id, v FROM (SELECT member_id, unnest([{_forms_sql()}]) AS v FROM (SELECT member_id, f, unnest({_parts_sql('last_name')}) AS l FROM (SELECT member_id, last_name, unnest({_parts_sql('first_name')}) AS f FROM family WHERE trim(first_name, ' ') <> '' AND trim(last_name, ' ') <> '')))"


@query("r13_04_name_variants", f"SELECT count(*) AS n, count(DISTINCT v) AS verschieden, sum(length(v))::BIGINT AS zeichen FROM ({_VARIANTS})")
def name_variants(t):
    v = t("family").select("member_id", F.explode(C.name_variants(F.col("first_name"), F.col("last_name"))).alias("v"))
    return v.agg(F.count("*").alias("n"), F.countDistinct("v").alias("verschieden"), F.sum(F.length("v")).alias("zeichen"))


@query(
    "r13_04_birth_dates",
    "SELECT member_id, unnest(list_distinct([" + ", ".join(f"strftime(birth_date, '{f}')" for f in ("%Y-%m-%d", "%d.%m.%Y", "%d.%m.%y", "%-d.%-m.%Y", "%-d.%-m.%y", "%Y%m%d", "%Y/%m/%d", "%d/%m/%Y", "%d-%m-%Y")) + "])) AS v FROM family WHERE birth_date IS NOT NULL",
)
def birth_dates(t):
    return t("family").select("member_id", F.explode(C.birth_date_variants(F.col("birth_date"))).alias("v"))


def _anonymised_sql() -> str:
    out = "snippet"
    for pattern, by in C.REPLACED:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    amount = C.AMOUNT_INSIDE.replace("'", "''")
    factor = "(0.8 + (('0x' || substr(sha256(dokument_id), 1, 6))::INT::DOUBLE / 16777215.0) * (1.2 - 0.8))"
    scaled = f"replace(format('{{:,.2f}}', round(CAST(regexp_replace(m, '[''’]', '', 'g') AS DOUBLE) * {factor}, 2)), ',', CASE WHEN regexp_matches(m, '[''’]') THEN chr(39) ELSE '' END)"
    return f"""WITH a AS (SELECT row_id, dokument_id, {out} AS t FROM field_rows WHERE snippet IS NOT NULL), d AS (SELECT row_id, dokument_id, generate_subscripts(p, 1) AS i, unnest(p) AS teil, unnest(list_resize(regexp_extract_all(t, '{C.DATE_INSIDE}'), len(p))) AS datum FROM (SELECT *, string_split_regex(t, '{C.DATE_INSIDE}') AS p FROM a)),
    e AS (SELECT row_id, dokument_id, i, datum, generate_subscripts(q, 1) AS j, unnest(q) AS stueck, unnest(list_resize(regexp_extract_all(teil, '{amount}'), len(q))) AS m FROM (SELECT *, string_split_regex(teil, '{amount}') AS q FROM d)),
    f AS (SELECT row_id, i, max(datum) AS datum, string_agg(stueck || coalesce({scaled}, ''), '' ORDER BY j) AS s FROM e GROUP BY 1, 2) SELECT row_id, string_agg(s || coalesce(datum, ''), '' ORDER BY i) AS text FROM f GROUP BY 1"""


@query("r13_06_anonymised", _anonymised_sql())
def anonymised(t):
    return t("field_rows").where("snippet is not null").select("row_id", C.anonymised(F.col("snippet"), F.col("dokument_id")).alias("text"))


@query("r13_07_scaled_amounts", "SELECT row_id, round(TRY_CAST(wert_decimal AS DOUBLE) * (0.8 + (('0x' || substr(sha256(dokument_id), 1, 6))::INT::DOUBLE / 16777215.0) * (1.2 - 0.8)), 2) AS betrag FROM field_rows WHERE wert_decimal IS NOT NULL")
def scaled_amounts(t):
    rows = t("field_rows").where("wert_decimal is not null")
    return rows.select("row_id", C.scaled(F.col("wert_decimal").try_cast("double"), F.col("dokument_id")).alias("betrag"))


@query(
    "r13_08_phones_over_words",
    "SELECT dokument_id, tag_id AS start FROM (SELECT *, lead(text) OVER o AS b, lead(text, 2) OVER o AS c, lead(text, 3) OVER o AS d FROM tagged_words WINDOW o AS (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id)) WHERE regexp_matches(text, '^(?:0\\d{2}|\\(0\\d{2}\\))$') AND regexp_matches(b, '^\\d{3}$') AND regexp_matches(c, '^\\d{2}$') AND regexp_matches(d, '^\\d{2}$')",
)
def phones_over_words(t):
    return C.spread_match(t("tagged_words"), ["dokument_id", "eingelesen_am"], "tag_id", "text", ["0\\d{2}|\\(0\\d{2}\\)", "\\d{3}", "\\d{2}", "\\d{2}"], "phone").select("dokument_id", "start")


@query("r13_09_markers", "SELECT DISTINCT last_name, 'P' || upper(substr(sha256(last_name), 1, 6)) AS marker FROM family")
def markers(t):
    return C.stable_markers(t("family"), "last_name", "P")


@query("r13_10_stale_outputs", "SELECT DISTINCT dokument_id, feld FROM field_rows_kopie k WHERE NOT EXISTS (SELECT 1 FROM field_rows f WHERE f.dokument_id = k.dokument_id AND f.feld = k.feld)")
def stale_outputs(t):
    return R.without(t("field_rows_kopie").select("dokument_id", "feld").distinct(), t("field_rows"), ["dokument_id", "feld"])


# --- composites --------------------------------------------------------------------------------------------------


@query(
    "r17_01_review_rows",
    "SELECT p.id, p.amount AS roh, coalesce(nullif(p.betrag, ''), 'ohne') AS betrag, coalesce(a.zustand, 'offen') AS zustand, CASE WHEN p.status = 'geprueft' THEN 2 WHEN p.herkunft = 'modell' THEN 0 ELSE 1 END AS rang FROM position_store p LEFT JOIN (SELECT beleg, zielwert, pos, arg_max(zustand, geaendert_am) AS zustand FROM abgleich GROUP BY 1, 2, 3) a ON a.beleg = p.dokument AND a.zielwert = p.zielwert AND a.pos = p.pos",
)
def review_rows(t):
    a = S.latest_state(t("abgleich"), ["beleg", "zielwert", "pos"], "zustand", "geaendert_am").withColumnRenamed("beleg", "dokument")
    rank = F.when(F.col("status") == "geprueft", 2).when(F.col("herkunft") == "modell", 0).otherwise(1)
    j = t("position_store").join(a, ["dokument", "zielwert", "pos"], "left")
    return j.select("id", F.col("amount").alias("roh"), F.coalesce(F.nullif("betrag", F.lit("")), F.lit("ohne")).alias("betrag"), F.coalesce("zustand", F.lit("offen")).alias("zustand"), rank.alias("rang"))


@query(
    "r17_02_document_overview",
    "WITH f AS (SELECT dokument_id, count(*) AS n, sum(CASE WHEN TRY_CAST(wert_decimal AS DOUBLE) <> 0 THEN 1 ELSE 0 END) AS werte FROM field_rows GROUP BY 1), p AS (SELECT dokument_id, bool_and(status = 'geprueft') AS fertig FROM position_store GROUP BY 1), w AS (SELECT DISTINCT dokument_id FROM tagged_words) SELECT CASE WHEN f.n IS NULL THEN 'nicht_gelesen' WHEN f.werte = 0 THEN 'null' WHEN p.fertig IS NULL THEN 'ohne_befund' WHEN p.fertig THEN 'geprueft' ELSE 'offen' END AS stand, count(*) AS n FROM w FULL OUTER JOIN f ON w.dokument_id = f.dokument_id LEFT JOIN p ON p.dokument_id = coalesce(f.dokument_id, w.dokument_id) GROUP BY 1",
)
def document_overview(t):
    f = t("field_rows").groupBy("dokument_id").agg(F.count("*").alias("n"), F.count_if(F.col("wert_decimal").try_cast("double") != 0).alias("werte"))
    p = t("position_store").groupBy("dokument_id").agg(F.bool_and(F.col("status") == "geprueft").alias("fertig"))
    w = t("tagged_words").select("dokument_id").distinct()
    state = F.when(F.col("n").isNull(), "nicht_gelesen").when(F.col("werte") == 0, "null").when(F.col("fertig").isNull(), "ohne_befund").when(F.col("fertig"), "geprueft").otherwise("offen")
    return w.join(f, "dokument_id", "full_outer").join(p, "dokument_id", "left").groupBy(state.alias("stand")).agg(F.count("*").alias("n"))


@query("r17_03_mask", f"SELECT dokument_id, max(CASE WHEN feld = 'institut' THEN wert_raw END) AS institut, max(CASE WHEN feld = 'bruttoertrag' THEN wert_decimal END) AS ertrag, max(CASE WHEN feld = 'vermoegensstand_3112' THEN wert_decimal END) AS bestand, 3 - (max(CASE WHEN feld = 'institut' THEN wert_raw END) IS NOT NULL)::INT - (max(CASE WHEN feld = 'bruttoertrag' THEN wert_decimal END) IS NOT NULL)::INT - (max(CASE WHEN feld = 'vermoegensstand_3112' THEN wert_decimal END) IS NOT NULL)::INT AS luecken FROM ({_LAST}) WHERE belegtyp = 'bank_zinsausweis' GROUP BY 1")
def mask(t):
    of = lambda f, c: F.max(F.when(F.col("feld") == f, F.col(c)))
    wide = _latest(t).where("belegtyp = 'bank_zinsausweis'").groupBy("dokument_id").agg(of("institut", "wert_raw").alias("institut"), of("bruttoertrag", "wert_decimal").alias("ertrag"), of("vermoegensstand_3112", "wert_decimal").alias("bestand"))
    gaps = F.lit(3) - sum((F.col(c).isNotNull().cast("int") for c in ("institut", "ertrag", "bestand")), F.lit(0))
    return wide.select("*", gaps.alias("luecken"))


@query("r17_04_entries", "SELECT aussteller, person, jahr, CASE WHEN count(DISTINCT nullif(betrag, '')) = 0 THEN NULL WHEN count(DISTINCT nullif(betrag, '')) = 1 THEN min(nullif(betrag, '')) ELSE 'mehrere' END AS wert, count(*) AS n FROM position_store WHERE zielwert = 'vermoegensstand_3112' GROUP BY 1, 2, 3")
def entries(t):
    b = F.nullif("betrag", F.lit(""))
    k = F.countDistinct(b)
    return t("position_store").where("zielwert = 'vermoegensstand_3112'").groupBy("aussteller", "person", "jahr").agg(F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.min(b)).otherwise("mehrere").alias("wert"), F.count("*").alias("n"))


@query("r17_10_required_missing", "WITH r AS (SELECT DISTINCT belegtyp, feld FROM field_rows), d AS (SELECT DISTINCT dokument_id, belegtyp FROM field_rows) SELECT d.dokument_id, r.feld FROM d JOIN r USING (belegtyp) WHERE NOT EXISTS (SELECT 1 FROM field_rows f WHERE f.dokument_id = d.dokument_id AND f.feld = r.feld)")
def required_missing(t):
    f = t("field_rows")
    return Q.missing_pairs(f.select("dokument_id", "belegtyp").distinct(), f.select("belegtyp", "feld").distinct(), f, "dokument_id", "feld", "belegtyp")


@query("r17_14_store_overview", "SELECT status, herkunft, count(*) AS n, sum((betrag = '')::INT)::BIGINT AS ohne_betrag FROM position_store GROUP BY CUBE (status, herkunft)")
def store_overview(t):
    return t("position_store").cube("status", "herkunft").agg(F.count("*").alias("n"), F.count_if(F.col("betrag") == "").alias("ohne_betrag"))


@query("r17_22_family_name_in_field", "SELECT DISTINCT f.row_id FROM field_rows f JOIN family m ON f.dossier_id = m.dossier_id AND list_contains(regexp_split_to_array(f.wert_raw, '[ ,]+'), m.last_name) WHERE f.wert_raw IS NOT NULL")
def family_name_in_employer(t):
    words = t("field_rows").where("wert_raw is not null").select("dossier_id", "row_id", F.explode(F.split("wert_raw", "[ ,]+")).alias("last_name"))
    return words.join(t("family").select("dossier_id", "last_name").distinct(), ["dossier_id", "last_name"]).select("row_id").distinct()
