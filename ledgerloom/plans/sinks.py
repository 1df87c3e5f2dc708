"""What the sinks write, the store's one-time steps, amount modes and detectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import texts as X
from ledgerloom.operators import rules as Q
from ledgerloom.operators import scrub as C
from ledgerloom.operators import store as S
from ledgerloom.plans.catalog import Catalog
from ledgerloom.plans.chain import _NEWEST, _newest
from ledgerloom.sources import writers as V
from ledgerloom.streaming.incremental import fresh_folder

catalog = Catalog()
query = catalog.query
_B = "TRY_CAST(nullif(betrag, '') AS DECIMAL(18,2))"


# --- sinks -------------------------------------------------------------------------------------------------------


@query(
    "r1_14_run_report",
    f"""SELECT 'typ' AS teil, belegtyp AS wert, count(DISTINCT dokument_id) AS n, round(avg(konfidenz), 6) AS konfidenz FROM ({_NEWEST}) GROUP BY 2
    UNION ALL SELECT 'person', coalesce(nullif(person, ''), 'unbekannt'), count(DISTINCT dokument_id), NULL FROM position_store GROUP BY 2
    UNION ALL SELECT 'grund', coalesce(nullif(grund, ''), 'ohne'), count(*), NULL FROM abgleich GROUP BY 2""",
)
def run_report(t):
    none = F.lit(None).cast("double").alias("konfidenz")
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    types = _newest(t).groupBy(F.col("belegtyp").alias("wert")).agg(F.countDistinct("dokument_id").alias("n"), F.round(F.avg("konfidenz"), 6).alias("konfidenz")).select(F.lit("typ").alias("teil"), "wert", "n", "konfidenz")
    people = t("position_store").groupBy(filled("person", "unbekannt").alias("wert")).agg(F.countDistinct("dokument_id").alias("n")).select(F.lit("person").alias("teil"), "wert", "n", none)
    reasons = t("abgleich").groupBy(filled("grund", "ohne").alias("wert")).agg(F.count("*").alias("n")).select(F.lit("grund").alias("teil"), "wert", "n", none)
    return types.unionByName(people).unionByName(reasons)


def _money(c: str) -> str:
    """``shown_amount`` of a decimal in SQL."""
    return f"coalesce(replace(format('{{:,.2f}}', CAST({c} AS DOUBLE)), ',', ''''), '')"


_CELL = "regexp_replace(replace({}, '|', '\\|'), '[\\r\\n]+', ' ', 'g')"


@query(
    "r1_16_ledger_lines",
    f"""WITH p AS (SELECT zielwert AS form, ziffer AS line, label, {_B} AS b FROM position_store), s AS (SELECT form, line, sum(b) AS s FROM p GROUP BY 1, 2)
    SELECT form, line, 0 AS rang, '| ' || {_CELL.format('line')} || ' | ' || {_CELL.format('label')} || ' | ' || {_money('b')} || ' |' AS text FROM p
    UNION ALL SELECT form, line, 1, '| ' || {_CELL.format('line')} || ' | **Zwischentotal** | ' || {_money('s')} || ' |' FROM s
    UNION ALL SELECT form, NULL, 2, '| | **Total** | ' || {_money('sum(s)')} || ' |' FROM s GROUP BY 1""",
)
def ledger_lines(t):
    rows = t("position_store").withColumn("b", F.nullif("betrag", F.lit("")).try_cast("decimal(18,2)"))
    return V.ledger_lines(rows, "zielwert", "ziffer", "label", "b")


@query(
    "r1_17_evidence",
    """SELECT row_id, CASE WHEN anchor_bbox IS NOT NULL THEN 'S.' || anchor_page || ' (' || array_to_string(list_transform(anchor_bbox, lambda x: CAST(CAST(x AS DECIMAL(10,1)) AS VARCHAR)), ', ') || ')' END AS anker,
    CASE WHEN length(snippet) > 40 THEN substr(snippet, 1, 39) || '…' ELSE snippet END AS ausschnitt, CASE WHEN coalesce(anchor_valid, false) THEN 'belegt' ELSE 'offen' END AS befund FROM field_rows""",
)
def evidence(t):
    found = F.when(F.coalesce("anchor_valid", F.lit(False)), "belegt").otherwise("offen")
    return t("field_rows").select("row_id", X.anchor_text(F.col("anchor_page"), F.col("anchor_bbox")).alias("anker"), X.ellipsis(F.col("snippet"), 40).alias("ausschnitt"), found.alias("befund"))


_LAST_STATE = "SELECT beleg, zielwert, pos, arg_max(zustand, (geaendert_am, coalesce(zustand, ''))) AS zustand FROM abgleich GROUP BY 1, 2, 3"


def _states(t):
    """Positions with the newest state of their reconciliation."""
    last = t("abgleich").groupBy(F.col("beleg").alias("dokument"), "zielwert", "pos").agg(F.max_by("zustand", F.struct("geaendert_am", F.coalesce("zustand", F.lit("")))).alias("zustand"))
    return t("position_store").join(last, ["dokument", "zielwert", "pos"], "left")


@query(
    "r1_19_ledger_rows",
    f"SELECT p.dokument, p.label, p.ziffer, p.person, p.aussteller, CAST({_B} AS DOUBLE) AS betrag, p.jahr, p.unterscheidung, p.status FROM position_store p LEFT JOIN ({_LAST_STATE}) a ON a.beleg = p.dokument AND a.zielwert = p.zielwert AND a.pos = p.pos WHERE {_B} <> 0 AND a.zustand IS DISTINCT FROM 'fehlt'",
)
def ledger_csv_rows(t):
    rows = _states(t).withColumn("betrag", F.nullif("betrag", F.lit("")).try_cast("decimal(18,2)").cast("double"))
    return rows.where("betrag <> 0 and not zustand <=> 'fehlt'").select("dokument", "label", "ziffer", "person", "aussteller", "betrag", "jahr", "unterscheidung", "status")


_LEAD = {"lohnausweis": "nettolohn_pos11", "bank_zinsausweis": "vermoegensstand_3112", "kk_praemienbescheinigung": "praemie_kvg_total", "saeule_3a": "einzahlung_betrag", "wertschriftenverzeichnis": "bestand_3112", "hypothek_zinsbestaetigung": "schuldsaldo_3112"}
_LEAD_SQL = "CASE belegtyp " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, f in _LEAD.items()) + " ELSE 'betrag' END"


@query(
    "r1_21_base_table",
    f"""SELECT dokument_id, min(belegtyp) AS belegtyp, max(CASE WHEN feld = {_LEAD_SQL} THEN TRY_CAST(wert_decimal AS DOUBLE) END) AS leitwert, max(CASE WHEN feld = 'jahr' THEN wert_raw END) AS jahr, count(*) AS felder, sum((wert_raw <> '' AND wert_raw NOT LIKE 'manual_review%')::INT)::BIGINT AS werte,
    round(min(konfidenz), 6) AS konfidenz FROM ({_NEWEST}) GROUP BY 1""",
)
def base_table(t):
    lead = F.coalesce(F.create_map(*[F.lit(x) for pair in _LEAD.items() for x in pair])[F.col("belegtyp")], F.lit("betrag"))
    value = F.max(F.when(F.col("feld") == lead, F.col("wert_decimal").try_cast("double")))
    return _newest(t).groupBy("dokument_id").agg(
        F.min("belegtyp").alias("belegtyp"), value.alias("leitwert"), F.max(F.when(F.col("feld") == "jahr", F.col("wert_raw"))).alias("jahr"), F.count("*").alias("felder"), F.count_if((F.col("wert_raw") != "") & ~F.col("wert_raw").startswith("manual_review")).alias("werte"), F.round(F.min("konfidenz"), 6).alias("konfidenz")
    )


@query("r1_22_debug_rows", f"SELECT dokument_id, feld, wert_raw, konfidenz, CASE WHEN konfidenz >= 0.85 THEN 'sicher' WHEN konfidenz >= 0.6 THEN 'pruefen' ELSE 'unsicher' END AS stufe FROM ({_NEWEST})")
def debug_rows(t):
    return _newest(t).select("dokument_id", "feld", "wert_raw", "konfidenz", Q.level(F.col("konfidenz"), [(0.6, "pruefen"), (0.85, "sicher")], "unsicher").alias("stufe"))


# --- amounts and ranks -------------------------------------------------------------------------------------------


def _num_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)$') THEN TRY_CAST({c} AS DOUBLE) END"


_COMMA = "replace(replace(nullif(wert_raw, 'null'), '''', ''), ',', '.')"
_DOTS = "CASE WHEN contains(wert_raw, ',') AND contains(wert_raw, '.') THEN replace(replace(replace(wert_raw, '''', ''), '.', ''), ',', '.') ELSE replace(replace(wert_raw, '''', ''), ',', '.') END"
_PERCENT = "replace(regexp_replace(coalesce(wert_raw, ''), '[''’ %]', '', 'g'), ',', '.')"
_ZERO = "regexp_replace(replace(regexp_replace(coalesce(wert_raw, ''), '[''’ ]', '', 'g'), ',', '.'), '\\.[-—–]$', '.00')"
_STRICT = "regexp_replace(trim(coalesce(wert_raw, ''), ' '), '['' ]', '', 'g')"


@query(
    "r2_12_amount_modes",
    f"SELECT row_id, {_num_sql('a')} AS komma, {_num_sql('b')} AS punkt_tausend, {_num_sql('c')} AS prozent, coalesce({_num_sql('d')} = 0, false) AS null_betrag, {_num_sql('e')} AS streng FROM (SELECT row_id, {_COMMA} AS a, {_DOTS} AS b, {_PERCENT} AS c, {_ZERO} AS d, {_STRICT} AS e FROM field_rows)",
)
def amount_modes(t):
    c = F.col("wert_raw")
    return t("field_rows").select("row_id", A.comma_amount(c).alias("komma"), A.dot_thousands_amount(c).alias("punkt_tausend"), A.percent_amount(c).alias("prozent"), A.is_zero(c).alias("null_betrag"), A.plain_amount(c).alias("streng"))


@query(
    "r6_10_salary_units",
    "SELECT word_id, dense_rank() OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY page, top)::INT AS rang FROM tagged_words WHERE regexp_matches(text, '^(8|9|10|11)\\.$')",
)
def salary_units(t):
    w = W.partitionBy("dokument_id", "eingelesen_am").orderBy("page", "top")
    return t("tagged_words").where(F.col("text").rlike("^(8|9|10|11)\\.$")).select("word_id", F.dense_rank().over(w).alias("rang"))


# --- store -------------------------------------------------------------------------------------------------------


@query(
    "r2_44_correction_states",
    f"SELECT p.id, CASE WHEN a.zustand = 'andernorts' THEN 'withdrawn' WHEN a.zustand = 'fehlt' THEN 'struck' WHEN p.status = 'geprueft' OR (p.herkunft = 'mensch' AND trim(p.betrag, ' ') <> '') THEN 'confirmed' ELSE 'open' END AS stand FROM position_store p LEFT JOIN ({_LAST_STATE}) a ON a.beleg = p.dokument AND a.zielwert = p.zielwert AND a.pos = p.pos",
)
def correction_states(t):
    c = F.col
    return _states(t).select("id", S.correction_states(c("status") == "geprueft", c("herkunft") == "mensch", c("betrag"), c("zustand") == "fehlt", c("zustand") == "andernorts").alias("stand"))


@query(
    "r17_17_struck_and_restored",
    f"""WITH s AS (SELECT p.id, p.status, a.zustand = 'fehlt' AS weg FROM position_store p LEFT JOIN ({_LAST_STATE}) a ON a.beleg = p.dokument AND a.zielwert = p.zielwert AND a.pos = p.pos)
    SELECT id, CASE WHEN weg AND status = 'geprueft' THEN 'geprueft' WHEN weg THEN 'gestrichen' ELSE status END AS status, CASE WHEN weg AND status = 'geprueft' THEN 2 WHEN weg THEN 1 ELSE 0 END AS eintraege FROM s""",
)
def struck_and_restored(t):
    rows = _states(t)
    version = rows.select("id", "status")
    gone = rows.where("zustand = 'fehlt'").select("id")
    after, journal = S.struck(version, gone, ["id"], "status", F.lit(1))
    checked = gone.join(version.where("status = 'geprueft'"), "id", "left_semi")
    final, undone = S.restored(after, journal, checked, ["id"], "status", F.lit(2))
    entries = journal.unionByName(undone).groupBy("id").agg(F.count("*").cast("int").alias("eintraege"))
    return final.join(entries, "id", "left").select("id", "status", F.coalesce("eintraege", F.lit(0)).alias("eintraege"))


def _loaded(spark, sf_dir):
    """The positions loaded once into a fresh store and read back."""
    from ledgerloom.session import table

    folder = fresh_folder(spark, "store")
    S.loaded_once(table(spark, sf_dir, "position_store"), folder)
    return spark.read.parquet(folder).groupBy("status", "herkunft").agg(F.count("*").alias("n"))


catalog.runs["r17_12_loaded_once"] = _loaded
catalog.sql["r17_12_loaded_once"] = "SELECT status, herkunft, count(*) AS n FROM position_store GROUP BY 1, 2"

_KEYS = "SELECT dokument_id, feld, arg_max(coalesce(wert_raw, ''), (geaendert_am, row_id)) AS wert, max(geaendert_am) AS stand FROM {} GROUP BY 1, 2"


@query(
    "r17_20_reextracted",
    f"""WITH v AS ({_KEYS.format('field_rows')}), f AS ({_KEYS.format('field_rows_kopie')}), d AS (SELECT DISTINCT dokument_id FROM v WHERE wert LIKE 'manual_review%' AND dokument_id IN (SELECT dokument_id FROM f)), n AS (SELECT f.* FROM f JOIN d USING (dokument_id))
    SELECT dokument_id, feld, wert, CAST(stand AS VARCHAR) AS stand FROM v WHERE dokument_id NOT IN (SELECT dokument_id FROM n) UNION ALL SELECT n.dokument_id, n.feld, n.wert, CAST(CASE WHEN n.wert = v.wert THEN v.stand ELSE n.stand END AS VARCHAR) FROM n LEFT JOIN v USING (dokument_id, feld)""",
)
def reextracted(t):
    of = lambda n: t(n).groupBy("dokument_id", "feld").agg(F.max(F.struct("geaendert_am", "row_id", F.coalesce("wert_raw", F.lit("")).alias("w"))).alias("r")).select("dokument_id", "feld", F.col("r.w").alias("wert"), F.date_format("r.geaendert_am", "yyyy-MM-dd HH:mm:ss").alias("stand"))
    version, copy = of("field_rows"), of("field_rows_kopie")
    marked = version.where("wert like 'manual_review%'").select("dokument_id").distinct()
    fresh = copy.join(marked, "dokument_id", "left_semi")
    return S.reextracted(version, fresh, ["dokument_id", "feld"], "dokument_id", ["wert"], "stand")


@query(
    "r17_24_clients",
    "SELECT dossier_id, coalesce(min(CASE WHEN role LIKE 'elternteil%' THEN member_id END), min(member_id)) AS member_id, sum((role LIKE 'elternteil%')::INT)::BIGINT AS erwachsene FROM family GROUP BY 1",
)
def clients(t):
    adult = F.col("role").startswith("elternteil")
    return t("family").groupBy("dossier_id").agg(F.coalesce(F.min(F.when(adult, F.col("member_id"))), F.min("member_id")).alias("member_id"), F.count_if(adult).alias("erwachsene"))


_WIDE_ROWS = f"SELECT dokument_id, min(belegtyp) AS belegtyp, max(CASE WHEN feld = 'bruttolohn_pos8' THEN w END) AS brutto, max(CASE WHEN feld = 'nettolohn_pos11' THEN w END) AS netto, max(CASE WHEN feld = 'bruttoertrag' THEN w END) AS ertrag, max(CASE WHEN feld = 'vermoegensstand_3112' THEN w END) AS bestand, max(CASE WHEN feld = 'verrechnungssteuer' THEN w END) AS steuer FROM (SELECT *, TRY_CAST(wert_decimal AS DOUBLE) AS w FROM ({_NEWEST})) GROUP BY 1"


@query(
    "r10_05_dispatched",
    f"""WITH w AS ({_WIDE_ROWS}) SELECT dokument_id, 'ohne_netto' AS code, 'fehler' AS severity FROM w WHERE belegtyp = 'lohnausweis' AND netto IS NULL UNION ALL SELECT dokument_id, 'vertauscht', 'unstimmig' FROM w WHERE belegtyp = 'lohnausweis' AND ((brutto = netto AND brutto <> 0) OR netto > brutto)
    UNION ALL SELECT dokument_id, 'ohne_bestand', 'fehler' FROM w WHERE belegtyp = 'bank_zinsausweis' AND bestand IS NULL UNION ALL SELECT dokument_id, 'steuersatz', 'hinweis' FROM w WHERE belegtyp = 'bank_zinsausweis' AND abs(steuer - ertrag * 0.35) > abs(ertrag * 0.35) * 0.05""",
)
def dispatched(t):
    c = F.col
    w = _newest(t).withColumn("w", c("wert_decimal").try_cast("double"))
    of = lambda f, n: F.max(F.when(c("feld") == f, c("w"))).alias(n)
    wide = w.groupBy("dokument_id").agg(F.min("belegtyp").alias("belegtyp"), of("bruttolohn_pos8", "brutto"), of("nettolohn_pos11", "netto"), of("bruttoertrag", "ertrag"), of("vermoegensstand_3112", "bestand"), of("verrechnungssteuer", "steuer"))
    plain = {"lohnausweis": [Q.Check("ohne_netto", "fehler", c("netto").isNull())], "bank_zinsausweis": [Q.Check("ohne_bestand", "fehler", c("bestand").isNull())]}
    sums = {"lohnausweis": [Q.Check("vertauscht", "unstimmig", Q.swapped(c("brutto"), c("netto")))], "bank_zinsausweis": [Q.Check("steuersatz", "hinweis", Q.off_ratio(c("steuer"), c("ertrag"), 0.35, 0.05))]}
    return Q.dispatched(wide, ["dokument_id"], "belegtyp", plain, sums)


# --- detectors ---------------------------------------------------------------------------------------------------


def _group_sql(pattern: str) -> str:
    """A detector without look-around: what stands before and after the group is matched instead."""
    import re

    s = re.sub(r"^\(\?<!\[([^\]]*)\]\)", r"(?:^|[^\1])", pattern)
    return re.sub(r"\(\?!\[([^\]]*)\]\)$", r"(?:[^\1]|$)", s).replace("'", "''")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SUPPRESSED = f"""(m IN ('044-000-00-00', '044 000 00 00', 'anon@example.com') OR regexp_matches(m, '[xX*]{{3}}') OR regexp_matches({_DIGITS}, '^(0+|11+|22+|33+|44+|55+|66+|77+|88+|99+)$') OR (category = 'misread_phone' AND NOT regexp_matches(m, '[OIl]')) OR (category = 'iban' AND substr({_DIGITS}, 1, 2) = '00') OR (category = 'ahv' AND regexp_matches({_DIGITS}, '^7560+$'))
 OR (category = 'phone' AND length({_DIGITS}) >= 9 AND length({_DIGITS}) - length(replace({_DIGITS}, '0', '')) >= 6) OR (category = 'email' AND regexp_matches(lower(m), '@(example[.]|beispiel[.])')))"""
_MAIL = _group_sql(C.DETECTORS["email"])


@query(
    "r13_01_detected_mails",
    f"SELECT word_id, category, substr(sha256(m), 1, 8) AS hash8 FROM (SELECT word_id, 'email' AS category, trim(unnest(regexp_extract_all(text, '{_MAIL}', 1)), ' ') AS m FROM tagged_words WHERE text IS NOT NULL) WHERE NOT {_SUPPRESSED}",
)
def detected_mails(t):
    return C.detected(t("tagged_words").select("word_id", "text"), ["word_id"], "text", {"email": C.DETECTORS["email"]})


def _each(column: str, source: str, key: str) -> str:
    parts = []
    for k, p in C.DETECTORS.items():
        if k != "email":
            parts.append(f"SELECT {key}, '{k}' AS category, trim(m, ' ') AS m FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{_group_sql(p)}', 1)) AS m FROM {source} WHERE {column} IS NOT NULL)")
    return " UNION ALL ".join(parts)


@query("r13_01_detected", f"SELECT category, count(*) AS n, count(DISTINCT m) AS verschieden FROM ({_each('snippet', 'field_rows', 'row_id')}) WHERE NOT {_SUPPRESSED} GROUP BY 1")
def detected(t):
    found = C.detected(t("field_rows").select("row_id", "snippet"), ["row_id"], "snippet", {k: p for k, p in C.DETECTORS.items() if k != "email"})
    return found.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("hash8").alias("verschieden"))


@query("r2_47_holds_personal_data", f"SELECT count(*) AS n, count(DISTINCT f.row_id) AS betroffen FROM (SELECT f.row_id, d.row_id AS hit FROM field_rows f LEFT JOIN (SELECT DISTINCT row_id FROM ({_each('snippet', 'field_rows', 'row_id')}) WHERE NOT {_SUPPRESSED}) d USING (row_id)) f WHERE hit IS NOT NULL")
def holds_personal_data(t):
    kinds = {k: p for k, p in C.DETECTORS.items() if k != "email"}
    rows = t("field_rows").where(C.holds_personal_data(F.col("snippet"), kinds))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("betroffen"))


@query("r13_02_placeholders", f"SELECT category, count(*) AS n, sum({_SUPPRESSED}::INT)::BIGINT AS platzhalter FROM ({_each('snippet', 'field_rows', 'row_id')}) GROUP BY 1")
def placeholders(t):
    kinds = {k: p for k, p in C.DETECTORS.items() if k != "email"}
    return C.placeholders_in(t("field_rows").select("snippet"), "snippet", kinds).groupBy("category").agg(F.count("*").alias("n"), F.count_if("held").alias("platzhalter"))


def _leaks(spark, sf_dir):
    """Snippets written as text files of a folder to be shared, and what the leak check finds there."""
    from ledgerloom.session import table

    folder = fresh_folder(spark, "shared")
    text = table(spark, sf_dir, "field_rows").where("snippet is not null").select(F.regexp_replace("snippet", "[\\r\\n]+", " ").alias("value"))
    text.write.text(folder)
    return C.leaks(spark, folder, {k: p for k, p in C.DETECTORS.items() if k != "email"}).groupBy("category").agg(F.count("*").alias("n"))


catalog.runs["r13_11_leaks"] = _leaks
catalog.sql["r13_11_leaks"] = f"SELECT category, count(*) AS n FROM ({_each('snippet', 'field_rows', 'row_id')}) WHERE NOT {_SUPPRESSED} GROUP BY 1"
