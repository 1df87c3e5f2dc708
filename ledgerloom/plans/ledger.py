"""Joins, aggregates, windows and order over the ledger tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import texts as X
from ledgerloom.operators import positions as P
from ledgerloom.operators import relate as R
from ledgerloom.operators import store as S
from ledgerloom.operators import summarize as Z
from ledgerloom.plans.catalog import Catalog
from ledgerloom.plans.scalars import sql_name_tokens

catalog = Catalog()
query = catalog.query
_B = "TRY_CAST(nullif(betrag, '') AS DOUBLE)"


def _positions(t):
    return t("position_store").withColumn("b", F.nullif("betrag", F.lit("")).try_cast("double"))


# --- joins -------------------------------------------------------------------------------------------------------


@query("r4_01_positions_with_state", "SELECT p.id, p.dokument, a.zustand FROM position_store p JOIN abgleich a ON p.dokument = a.beleg AND p.zielwert = a.zielwert AND p.pos = a.pos")
def positions_with_state(t):
    a = t("abgleich").select(F.col("beleg").alias("dokument"), "zielwert", "pos", "zustand")
    return t("position_store").join(a, ["dokument", "zielwert", "pos"]).select("id", "dokument", "zustand")


@query("r4_02_not_reconciled", "SELECT id FROM position_store p WHERE status = 'geprueft' AND NOT EXISTS (SELECT 1 FROM abgleich a WHERE a.beleg = p.dokument AND a.zielwert = p.zielwert AND a.pos = p.pos)")
def not_reconciled(t):
    a = t("abgleich").select(F.col("beleg").alias("dokument"), "zielwert", "pos")
    return R.without(t("position_store").where("status = 'geprueft'"), a, ["dokument", "zielwert", "pos"]).select("id")


@query(
    "r4_03_alias_fallback",
    """WITH e AS (SELECT beleg || '|' || zielwert AS name, min(zustand) AS zustand FROM abgleich GROUP BY 1)
    SELECT p.id, coalesce(a.zustand, b.zustand) AS zustand, CASE WHEN a.name IS NOT NULL THEN 0 WHEN b.name IS NOT NULL THEN 1 END AS rank FROM position_store p LEFT JOIN e a ON a.name = p.dokument || '|' || p.label LEFT JOIN e b ON b.name = p.dokument || '|' || p.zielwert""",
)
def alias_fallback(t):
    entries = t("abgleich").groupBy(F.concat_ws("|", "beleg", "zielwert").alias("name")).agg(F.min("zustand").alias("zustand"))
    rows = t("position_store").select("id", "dokument", "label", "zielwert")
    names = [F.concat_ws("|", "dokument", "label"), F.concat_ws("|", "dokument", "zielwert")]
    ranked = R.by_first_name(rows, entries.withColumn("rank2", F.lit(0)), names, "name", ["zustand"])
    hit = ranked.join(entries.select(F.col("name").alias("_n")), F.concat_ws("|", "dokument", "label") == F.col("_n"), "left")
    return hit.select("id", "zustand", F.when(F.col("_n").isNotNull(), 0).when(F.col("zustand").isNotNull(), 1).alias("rank"))


@query("r4_04_unique_lines", "SELECT zielwert, min(ziffer) AS ziffer FROM position_store WHERE ziffer <> '' GROUP BY 1 HAVING count(DISTINCT ziffer) = 1")
def unique_lines(t):
    return R.unique_lookup(t("position_store").where("ziffer <> ''"), "zielwert", "ziffer")


@query(
    "r4_05_expected_actual",
    f"""WITH p AS (SELECT dokument, zielwert, pos, max({_B}) AS b FROM position_store GROUP BY 1, 2, 3), f AS (SELECT dokument_id, feld, max(TRY_CAST(wert_decimal AS DOUBLE)) AS w FROM field_rows GROUP BY 1, 2),
    d AS (SELECT DISTINCT dokument, dokument_id FROM position_store), j AS (SELECT p.dokument, p.zielwert, p.pos, p.b, f.w FROM p JOIN d USING (dokument) LEFT JOIN f ON f.dokument_id = d.dokument_id AND f.feld = p.zielwert WHERE p.b IS NOT NULL)
    SELECT zustand, count(*) AS n FROM (SELECT CASE WHEN w IS NULL THEN 'fehlt' WHEN abs(w - b) < 0.005 THEN 'stimmt' ELSE 'weicht_ab' END AS zustand FROM j) GROUP BY 1""",
)
def expected_actual(t):
    p = _positions(t).groupBy("dokument", "zielwert", "pos").agg(F.max("b").alias("b")).where("b is not null")
    d = t("position_store").select("dokument", "dokument_id").distinct()
    f = t("field_rows").groupBy("dokument_id", F.col("feld").alias("zielwert")).agg(F.max(F.col("wert_decimal").try_cast("double")).alias("w"))
    state = F.when(F.col("w").isNull(), "fehlt").when(F.abs(F.col("w") - F.col("b")) < 0.005, "stimmt").otherwise("weicht_ab")
    return p.join(d, "dokument").join(f, ["dokument_id", "zielwert"], "left").groupBy(state.alias("zustand")).agg(F.count("*").alias("n"))


@query(
    "r4_06_year_over_year",
    f"""WITH y AS (SELECT aussteller, zielwert, jahr, round(sum({_B}), 2) AS s FROM position_store WHERE aussteller <> '' AND {_B} IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT * FROM y WHERE jahr = '2021'), b AS (SELECT * FROM y WHERE jahr = '2022')
    SELECT coalesce(a.aussteller, b.aussteller) AS aussteller, coalesce(a.zielwert, b.zielwert) AS zielwert, a.s AS before, b.s AS after, CASE WHEN b.s IS NULL THEN 'only_left' WHEN a.s IS NULL THEN 'only_right' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS state FROM a FULL OUTER JOIN b ON a.aussteller = b.aussteller AND a.zielwert = b.zielwert""",
)
def year_over_year(t):
    y = _positions(t).where("aussteller <> '' and b is not null").groupBy("aussteller", "zielwert", "jahr").agg(F.round(F.sum("b"), 2).alias("s"))
    return R.compared(y.where("jahr = '2021'"), y.where("jahr = '2022'"), ["aussteller", "zielwert"], "s")


@query("r4_07_missing_issuers", "SELECT DISTINCT a.aussteller_name, a.belegtyp FROM aussteller a WHERE a.last_seen_year >= 2023 AND a.aussteller_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM position_store p WHERE p.aussteller = a.aussteller_name)")
def missing_issuers(t):
    seen = t("position_store").select(F.col("aussteller").alias("aussteller_name"))
    return R.without(t("aussteller").where("last_seen_year >= 2023 and aussteller_name is not null"), seen, ["aussteller_name"]).select("aussteller_name", "belegtyp").distinct()


@query(
    "r4_08_store_replaces_run",
    "SELECT dokument_id, count(*) AS n, max(quelle) AS quelle FROM (SELECT dokument_id, 'lauf' AS quelle FROM field_rows WHERE dokument_id NOT IN (SELECT dokument_id FROM position_store WHERE status = 'geprueft') UNION ALL SELECT dokument_id, 'ablage' FROM position_store WHERE status = 'geprueft') GROUP BY 1",
)
def store_replaces_run(t):
    run = t("field_rows").select("dokument_id", F.lit("lauf").alias("quelle"))
    store = t("position_store").where("status = 'geprueft'").select("dokument_id", F.lit("ablage").alias("quelle"))
    return R.replaced(run, store, "dokument_id").groupBy("dokument_id").agg(F.count("*").alias("n"), F.max("quelle").alias("quelle"))


@query(
    "r4_09_assigned_rows",
    f"""WITH p AS (SELECT id, dokument_id, {_B} AS b, zielwert FROM position_store WHERE {_B} IS NOT NULL), f AS (SELECT row_id, dokument_id, feld, TRY_CAST(wert_decimal AS DOUBLE) AS w FROM field_rows WHERE wert_decimal IS NOT NULL)
    SELECT p.id, min(f.row_id) AS row_id FROM p JOIN f ON p.dokument_id = f.dokument_id AND (p.b = f.w) GROUP BY 1 HAVING count(DISTINCT f.feld) = 1""",
)
def assigned_rows(t):
    p = _positions(t).where("b is not null").select("id", "dokument_id", "b")
    f = t("field_rows").withColumn("b", F.col("wert_decimal").try_cast("double")).where("b is not null").select("row_id", "dokument_id", "feld", "b")
    return p.join(f, ["dokument_id", "b"]).groupBy("id").agg(F.min("row_id").alias("row_id"), F.countDistinct("feld").alias("k")).where("k = 1").drop("k")


@query(
    "r4_10_paired_positions",
    """WITH d AS (SELECT dokument_id, id AS l, unterscheidung AS m FROM position_store WHERE zielwert = 'schuldsaldo_3112'), z AS (SELECT dokument_id, id AS r, unterscheidung AS m FROM position_store WHERE zielwert = 'schuldzinsen'),
    d1 AS (SELECT dokument_id, m, min(l) AS l FROM d WHERE m <> '' GROUP BY 1, 2 HAVING count(*) = 1), z1 AS (SELECT dokument_id, m, min(r) AS r FROM z WHERE m <> '' GROUP BY 1, 2 HAVING count(*) = 1),
    k AS (SELECT dokument_id, l, r, 'mark' AS art FROM d1 JOIN z1 USING (dokument_id, m)),
    d2 AS (SELECT dokument_id, l, row_number() OVER (PARTITION BY dokument_id ORDER BY l) AS n FROM d WHERE l NOT IN (SELECT l FROM k)), z2 AS (SELECT dokument_id, r, row_number() OVER (PARTITION BY dokument_id ORDER BY r) AS n FROM z WHERE r NOT IN (SELECT r FROM k))
    SELECT l, r, art FROM k UNION ALL SELECT l, r, 'position' FROM d2 JOIN z2 USING (dokument_id, n)""",
)
def paired_positions(t):
    p = t("position_store")
    debt = p.where("zielwert = 'schuldsaldo_3112'").select("dokument_id", "unterscheidung", F.col("id").alias("l"))
    interest = p.where("zielwert = 'schuldzinsen'").select("dokument_id", "unterscheidung", F.col("id").alias("r"))
    return R.paired(debt, interest, ["dokument_id"], "unterscheidung", "l", "r").select("l", "r", "art")


@query(
    "r4_11_same_amount_elsewhere",
    f"SELECT a.zielwert, count(*) AS n FROM (SELECT DISTINCT zielwert, dokument_id, {_B} AS b, substr(regexp_replace(lower(aussteller), '[^a-z]', '', 'g'), 1, 5) AS k, person FROM position_store WHERE {_B} > 0) a JOIN (SELECT DISTINCT zielwert, dokument_id, {_B} AS b, substr(regexp_replace(lower(aussteller), '[^a-z]', '', 'g'), 1, 5) AS k, person FROM position_store WHERE {_B} > 0) c ON a.zielwert = c.zielwert AND a.b = c.b AND a.k = c.k AND a.person = c.person AND a.dokument_id < c.dokument_id GROUP BY 1",
)
def same_amount_elsewhere(t):
    k = F.substring(F.regexp_replace(F.lower("aussteller"), "[^a-z]", ""), 1, 5)
    p = _positions(t).where("b > 0").select("zielwert", "dokument_id", "b", k.alias("k"), "person").distinct()
    sizes = p.groupBy("zielwert", "b", "k", "person").agg(F.count("*").alias("n"))  # pairs are counted, not built
    return sizes.where("n > 1").groupBy("zielwert").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n"))


@query("r4_12_issuer_in_text", "SELECT d.doc_id, r.ref_id FROM documents d JOIN aussteller_referenz r ON contains(d.text, r.kanonischer_name)")
def issuer_in_text(t):
    refs = t("aussteller_referenz").select("ref_id", "kanonischer_name")  # a fixed list
    second = F.element_at(F.split("kanonischer_name", " "), 2)  # a whole word wherever the name stands in a text
    words = t("documents").where("text is not null").select("doc_id", "text", F.explode(F.array_distinct(F.split("text", "[^\\p{L}\\p{N}]+"))).alias("w"))
    return words.join(refs.withColumn("w", second), "w").where(F.col("text").contains(F.col("kanonischer_name"))).select("doc_id", "ref_id").distinct()


@query(
    "r4_13_events_in_ranges",
    "WITH r AS (SELECT user_id AS u, ts AS lo, ts + INTERVAL 1 HOUR AS hi, event_id AS rid FROM events WHERE event_type = 'error') SELECT count(*) AS n FROM events e JOIN r ON e.user_id = r.u AND e.ts BETWEEN r.lo AND r.hi",
)
def events_in_ranges(t):
    e = t("events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("p"))
    r = e.where("event_type = 'error'").select("user_id", F.col("p").alias("lo"), (F.col("p") + 3_600_000_000).alias("hi"))
    return R.in_range(e.select("user_id", "p"), r, ["user_id"], "p", "lo", "hi", 3_600_000_000).agg(F.count("*").alias("n"))


@query(
    "r4_13_as_of",
    "WITH r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, r.v FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts",
)
def as_of(t):
    e = t("events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("v"))
    return R.as_of(errors, bought, ["user_id"], "ts", "at", ["v"]).select("event_id", "v")


@query("r4_14_phrases")
def phrases(t):
    dictionary = t("aussteller_referenz").select("kanonischer_name")
    return R.phrases(t("tagged_words"), dictionary, ["dokument_id", "eingelesen_am"], "tag_id", "kanonischer_name", 4).select("dokument_id", "start", "size", "window")


@query(
    "r4_15_members_named",
    f"""WITH m AS (SELECT dossier_id, member_id, {sql_name_tokens("concat_ws(' ', first_name, last_name)")} AS t FROM family),
    f AS (SELECT dossier_id, row_id, {sql_name_tokens("wert_raw")} AS t FROM field_rows WHERE feld LIKE '%name' AND wert_raw IS NOT NULL)
    SELECT f.row_id, m.member_id FROM f JOIN m ON f.dossier_id = m.dossier_id AND list_has_all(f.t, m.t)""",
)
def members_named(t):
    members = t("family").select("dossier_id", "member_id", X.name_tokens(F.concat_ws(" ", "first_name", "last_name")).alias("mt"))
    fields = t("field_rows").where("feld like '%name' and wert_raw is not null")
    sets = fields.select("dossier_id", "row_id", X.name_tokens(F.col("wert_raw")).alias("st"))
    return R.contained(sets, members, ["dossier_id"], ["row_id"], "st", "mt", "member_id").select("row_id", "member_id")


@query(
    "r4_16_stages",
    """WITH w AS (SELECT DISTINCT dokument_id FROM tagged_words), f AS (SELECT DISTINCT dokument_id FROM field_rows), p AS (SELECT DISTINCT dokument_id FROM position_store),
    a AS (SELECT dokument_id FROM w UNION SELECT dokument_id FROM f UNION SELECT dokument_id FROM p)
    SELECT CASE WHEN p.dokument_id IS NOT NULL THEN 'ledger' WHEN f.dokument_id IS NOT NULL THEN 'felder' ELSE 'woerter' END AS stufe, count(*) AS n FROM a LEFT JOIN w USING (dokument_id) LEFT JOIN f USING (dokument_id) LEFT JOIN p USING (dokument_id) GROUP BY 1""",
)
def stages(t):
    parts = [t(n).select("dokument_id").distinct().withColumn("s", F.lit(i)) for i, n in enumerate(("tagged_words", "field_rows", "position_store"))]
    last = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("dokument_id").agg(F.max("s").alias("s"))
    return last.groupBy(F.element_at(F.array(F.lit("woerter"), F.lit("felder"), F.lit("ledger")), F.col("s") + 1).alias("stufe")).agg(F.count("*").alias("n"))


@query(
    "r4_17_covered",
    f"""WITH i AS (SELECT id, aussteller, zielwert, row_number() OVER (PARTITION BY aussteller, zielwert ORDER BY id) AS r FROM position_store WHERE jahr = '2022'), s AS (SELECT aussteller, zielwert, count(*) AS n FROM position_store WHERE jahr = '2021' GROUP BY 1, 2)
    SELECT i.id, coalesce(i.r <= s.n, false) AS covered FROM i LEFT JOIN s USING (aussteller, zielwert)""",
)
def covered(t):
    p = t("position_store")
    return R.covered(p.where("jahr = '2022'").select("id", "aussteller", "zielwert"), p.where("jahr = '2021'"), ["aussteller", "zielwert"], "id").select("id", "covered")


@query(
    "r4_18_found_elsewhere",
    f"""WITH w AS (SELECT DISTINCT dokument_id, replace(replace(text, '''', ''), '’', '') AS k FROM tagged_words WHERE regexp_matches(text, '^[0-9][0-9''’]*\\.[0-9]{{2}}$')),
    p AS (SELECT id, dokument_id, betrag AS k FROM position_store WHERE regexp_matches(betrag, '^[0-9]{{4,}}\\.[0-9]{{2}}$')),
    o AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.dokument_id = p.dokument_id AND w.k = p.k))
    SELECT o.id, min(w.dokument_id) AS anderswo FROM o LEFT JOIN w ON w.k = o.k AND w.dokument_id <> o.dokument_id GROUP BY 1""",
)
def found_elsewhere(t):
    w = t("tagged_words").where(F.col("text").rlike("^[0-9][0-9'’]*\\.[0-9]{2}$")).select("dokument_id", F.regexp_replace("text", "['’]", "").alias("k")).distinct()
    p = t("position_store").where(F.col("betrag").rlike("^[0-9]{4,}\\.[0-9]{2}$")).select("id", "dokument_id", F.col("betrag").alias("k"))
    away = p.join(w, ["dokument_id", "k"], "left_anti")
    least = w.groupBy("k").agg(F.min("dokument_id").alias("anderswo"))  # the own document is not among them
    return away.join(least, "k", "left").select("id", "anderswo")


@query("r4_19_run_vs_run", "SELECT feld, count(*) AS n, sum(CASE WHEN a.wert_raw IS DISTINCT FROM b.wert_raw THEN 1 ELSE 0 END)::BIGINT AS anders FROM field_rows a JOIN field_rows_kopie b USING (dokument_id, feld) GROUP BY 1")
def run_vs_run(t):
    a, b = t("field_rows"), t("field_rows_kopie").select("dokument_id", "feld", F.col("wert_raw").alias("w2"))
    return a.join(b, ["dokument_id", "feld"]).groupBy("feld").agg(F.count("*").alias("n"), F.count_if(~F.col("wert_raw").eqNullSafe(F.col("w2"))).alias("anders"))


@query("r4_20_truth_in_snippet", "SELECT belegtyp, count(*) AS n, sum(CASE WHEN contains(snippet, wert_raw) THEN 1 ELSE 0 END)::BIGINT AS treffer FROM field_rows WHERE snippet IS NOT NULL AND wert_raw IS NOT NULL GROUP BY 1")
def truth_in_snippet(t):
    rows = t("field_rows").where("snippet is not null and wert_raw is not null")
    return rows.groupBy("belegtyp").agg(F.count("*").alias("n"), F.count_if(F.col("snippet").contains(F.col("wert_raw"))).alias("treffer"))


# --- aggregates --------------------------------------------------------------------------------------------------


@query("r5_01_type_summary", "SELECT belegtyp, count(DISTINCT dokument_id) AS dokumente, count(*) AS zeilen, round(avg(konfidenz), 6) AS konfidenz FROM field_rows GROUP BY 1")
def type_summary(t):
    return t("field_rows").groupBy("belegtyp").agg(F.countDistinct("dokument_id").alias("dokumente"), F.count("*").alias("zeilen"), F.round(F.avg("konfidenz"), 6).alias("konfidenz"))


@query("r5_01_person_pivot", "SELECT zielwert, sum(CASE WHEN person = 'mann' THEN 1 ELSE 0 END)::BIGINT AS mann, sum(CASE WHEN person = 'frau' THEN 1 ELSE 0 END)::BIGINT AS frau, sum(CASE WHEN person = '' THEN 1 ELSE 0 END)::BIGINT AS leer, sum(CASE WHEN person IN ('mann', 'frau', '') THEN 0 ELSE 1 END)::BIGINT AS andere FROM position_store GROUP BY 1")
def person_pivot(t):
    return Z.pivoted(t("position_store"), ["zielwert"], "person", {"mann": "mann", "frau": "frau", "": "leer"})


@query("r5_02_reasons", "SELECT coalesce(nullif(grund, ''), 'ohne') AS grund, zustand, count(*) AS n FROM abgleich GROUP BY 1, 2")
def reasons(t):
    return t("abgleich").groupBy(F.coalesce(F.nullif("grund", F.lit("")), F.lit("ohne")).alias("grund"), "zustand").agg(F.count("*").alias("n"))


@query(
    "r5_03_quality_with_total",
    "SELECT belegtyp, grouping_id(belegtyp) AS level, count(*) AS felder, sum(CASE WHEN anchor_valid THEN 1 ELSE 0 END)::BIGINT AS verankert, sum(CASE WHEN wert_raw LIKE 'manual_review%' THEN 1 ELSE 0 END)::BIGINT AS marken FROM field_rows GROUP BY ROLLUP (belegtyp)",
)
def quality_with_total(t):
    aggregates = [F.count("*").alias("felder"), F.count_if("anchor_valid").alias("verankert"), F.count_if(F.col("wert_raw").startswith("manual_review")).alias("marken")]
    return Z.with_total(t("field_rows"), ["belegtyp"], aggregates)


@query("r5_04_subtotals", f"SELECT ziffer, zielwert, grouping_id(ziffer, zielwert) AS level, round(sum({_B}), 2) AS summe, count(*) AS n FROM position_store GROUP BY ROLLUP (ziffer, zielwert)")
def subtotals(t):
    return Z.with_total(_positions(t), ["ziffer", "zielwert"], [F.round(F.sum("b"), 2).alias("summe"), F.count("*").alias("n")])


@query("r5_05_person_sums", f"SELECT person, jahr, round(sum(CASE WHEN status = 'geprueft' THEN {_B} END), 2) AS summe, string_agg(DISTINCT herkunft, ',' ORDER BY herkunft) AS quellen, bool_or(herkunft = 'mensch') AS von_hand FROM position_store GROUP BY 1, 2")
def person_sums(t):
    return _positions(t).groupBy("person", "jahr").agg(
        F.round(F.sum(F.when(F.col("status") == "geprueft", F.col("b"))), 2).alias("summe"), F.array_join(F.array_sort(F.collect_set("herkunft")), ",").alias("quellen"), F.bool_or(F.col("herkunft") == "mensch").alias("von_hand")
    )


@query(
    "r5_06_split_by_condition",
    """SELECT CASE WHEN v > 0 THEN 'A' WHEN v = 0 THEN 'B' ELSE 'manual' END AS liste, count(*) AS n, round(sum(b), 2) AS ertrag FROM (SELECT dokument_id, max(CASE WHEN feld = 'verrechnungssteuer' THEN TRY_CAST(wert_decimal AS DOUBLE) END) AS v, max(CASE WHEN feld = 'bruttoertrag' THEN TRY_CAST(wert_decimal AS DOUBLE) END) AS b FROM field_rows WHERE belegtyp = 'bank_zinsausweis' GROUP BY 1) GROUP BY 1""",
)
def split_by_condition(t):
    value = lambda f: F.max(F.when(F.col("feld") == f, F.col("wert_decimal").try_cast("double")))
    docs = t("field_rows").where("belegtyp = 'bank_zinsausweis'").groupBy("dokument_id").agg(value("verrechnungssteuer").alias("v"), value("bruttoertrag").alias("b"))
    return docs.groupBy(F.when(F.col("v") > 0, "A").when(F.col("v") == 0, "B").otherwise("manual").alias("liste")).agg(F.count("*").alias("n"), F.round(F.sum("b"), 2).alias("ertrag"))


@query(
    "r5_07_majority_year",
    "WITH c AS (SELECT aussteller, jahr, count(*) AS n FROM position_store WHERE jahr IS NOT NULL GROUP BY 1, 2), m AS (SELECT aussteller, max(n) AS most FROM c GROUP BY 1) SELECT aussteller, most, CASE WHEN count(*) = 1 THEN min(jahr) END AS jahr, count(*) AS tied FROM c JOIN m USING (aussteller) WHERE n = most GROUP BY 1, 2",
)
def majority_year(t):
    return Z.strict_mode(t("position_store"), ["aussteller"], "jahr")


@query("r5_07_upper_median", "SELECT belegtyp, list_sort(list(konfidenz))[count(*) // 2 + 1] AS median, count(*) AS n FROM field_rows WHERE konfidenz IS NOT NULL GROUP BY 1")
def upper_median(t):
    return Z.upper_median(t("field_rows"), ["belegtyp"], "konfidenz")


@query("r5_08_repeated_positions", "SELECT dokument, zielwert, pos, count(*) AS n FROM position_store GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_positions(t):
    return S.repeated(t("position_store"), ["dokument", "zielwert", "pos"])


@query("r5_09_coverage", "SELECT dossier_id, bool_or(belegtyp = 'lohnausweis') AS lohn, bool_or(belegtyp = 'saeule_3a') AS vorsorge, bool_or(belegtyp LIKE 'kk%') AS praemien, count(DISTINCT belegtyp) AS typen FROM field_rows GROUP BY 1")
def coverage(t):
    return t("field_rows").groupBy("dossier_id").agg(
        F.bool_or(F.col("belegtyp") == "lohnausweis").alias("lohn"), F.bool_or(F.col("belegtyp") == "saeule_3a").alias("vorsorge"), F.bool_or(F.col("belegtyp").startswith("kk")).alias("praemien"), F.countDistinct("belegtyp").alias("typen")
    )


@query(
    "r5_10_sum_per_person",
    f"""WITH n AS (SELECT dokument_id, max(CASE WHEN feld = 'versicherte_person_name' THEN wert_raw END) AS p, max(CASE WHEN feld = 'praemie_kvg_total' THEN TRY_CAST(wert_decimal AS DOUBLE) END) AS b FROM field_rows WHERE belegtyp = 'kk_praemienbescheinigung' GROUP BY 1)
    SELECT array_to_string({sql_name_tokens("p")}, ' ') AS person, round(sum(b), 2) AS praemie, count(*) AS n FROM n WHERE p <> '' GROUP BY 1""",
)
def sum_per_person(t):
    docs = t("field_rows").where("belegtyp = 'kk_praemienbescheinigung'").groupBy("dokument_id").agg(
        F.max(F.when(F.col("feld") == "versicherte_person_name", F.col("wert_raw"))).alias("p"), F.max(F.when(F.col("feld") == "praemie_kvg_total", F.col("wert_decimal").try_cast("double"))).alias("b")
    )
    named = docs.where("p is not null and p <> ''")
    return named.groupBy(F.array_join(X.name_tokens(F.col("p")), " ").alias("person")).agg(F.round(F.sum("b"), 2).alias("praemie"), F.count("*").alias("n"))


@query(
    "r5_11_security_balance",
    "SELECT dokument_id, sum(CASE WHEN s = 'gesichert' THEN 1 ELSE 0 END)::BIGINT AS gesichert, sum(CASE WHEN s = 'modell' THEN 1 ELSE 0 END)::BIGINT AS modell, sum(CASE WHEN s = 'warnung' THEN 1 ELSE 0 END)::BIGINT AS warnung, sum(CASE WHEN s = 'fehlt' THEN 1 ELSE 0 END)::BIGINT AS fehlt FROM (SELECT dokument_id, CASE WHEN wert_raw IS NULL OR wert_raw = '' THEN 'fehlt' WHEN NOT anchor_valid THEN 'warnung' WHEN konfidenz >= 0.8 THEN 'gesichert' ELSE 'modell' END AS s FROM field_rows) GROUP BY 1",
)
def security_balance(t):
    s = F.when(F.col("wert_raw").isNull() | (F.col("wert_raw") == ""), "fehlt").when(~F.col("anchor_valid"), "warnung").when(F.col("konfidenz") >= 0.8, "gesichert").otherwise("modell")
    return Z.state_counts(t("field_rows").withColumn("s", s), ["dokument_id"], "s", ["gesichert", "modell", "warnung", "fehlt"])


@query("r5_14_complete_documents", "SELECT complete, count(*) AS n FROM (SELECT dokument_id, count(DISTINCT CASE WHEN wert_raw <> '' THEN feld END) >= 5 AS complete FROM field_rows WHERE belegtyp = 'bank_zinsausweis' GROUP BY 1) GROUP BY 1")
def complete_documents(t):
    docs = t("field_rows").where("belegtyp = 'bank_zinsausweis'").groupBy("dokument_id").agg((F.countDistinct(F.when(F.col("wert_raw") != "", F.col("feld"))) >= 5).alias("complete"))
    return docs.groupBy("complete").agg(F.count("*").alias("n"))


@query("r5_15_mixed_issuers", "SELECT aussteller, count(DISTINCT person) AS personen, count(DISTINCT dokument_id) AS dokumente FROM position_store WHERE aussteller <> '' GROUP BY 1 HAVING count(DISTINCT person) > 1")
def mixed_issuers(t):
    by = t("position_store").where("aussteller <> ''").groupBy("aussteller").agg(F.countDistinct("person").alias("personen"), F.countDistinct("dokument_id").alias("dokumente"))
    return by.where("personen > 1")


@query(
    "r5_17_spelling_lengths",
    "SELECT substr(regexp_replace(lower(aussteller), '[^a-z]', '', 'g'), 1, 8) AS kern, max(length(aussteller)) AS laenge, count(DISTINCT aussteller) AS spellings FROM position_store GROUP BY 1",
)
def spelling_lengths(t):
    rows = t("position_store").select(X.core_name(F.col("aussteller")).alias("kern"), "aussteller")
    longest = Z.longest_spelling(rows, ["kern"], "aussteller")
    return longest.select("kern", F.length("aussteller").cast("bigint").alias("laenge"), "spellings")


@query("r5_18_types_in_order", "SELECT dossier_id, string_agg(DISTINCT belegtyp, '+' ORDER BY belegtyp) AS typen FROM field_rows GROUP BY 1")
def types_in_order(t):
    return t("field_rows").groupBy("dossier_id").agg(F.array_join(F.array_sort(F.collect_set("belegtyp")), "+").alias("typen"))


@query(
    "r5_19_auroc",
    "WITH s AS (SELECT 1 - konfidenz AS s, NOT anchor_valid AS y FROM field_rows WHERE konfidenz IS NOT NULL AND anchor_valid IS NOT NULL), r AS (SELECT y, avg(i) OVER (PARTITION BY s) AS r FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS i FROM s)) SELECT round((sum(CASE WHEN y THEN r END) - count(CASE WHEN y THEN 1 END) * (count(CASE WHEN y THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y THEN 1 END) * count(CASE WHEN NOT y THEN 1 END)), 6) AS auroc, count(CASE WHEN y THEN 1 END) AS positives, count(CASE WHEN NOT y THEN 1 END) AS negatives FROM r",
)
def auroc(t):
    rows = t("field_rows").where("konfidenz is not null and anchor_valid is not null").select((1 - F.col("konfidenz")).alias("s"), (~F.col("anchor_valid")).alias("y"))
    return Z.auroc(rows, "s", "y").select(F.round("auroc", 6).alias("auroc"), "positives", "negatives")


@query(
    "r5_20_calibration",
    "SELECT (konfidenz >= 0.5)::INT + (konfidenz >= 0.6)::INT + (konfidenz >= 0.7)::INT + (konfidenz >= 0.8)::INT + (konfidenz >= 0.9)::INT AS band, sum(anchor_valid::INT)::BIGINT AS \"right\", sum((NOT anchor_valid)::INT)::BIGINT AS wrong, round(avg((konfidenz - anchor_valid::INT) * (konfidenz - anchor_valid::INT)), 6) AS brier FROM field_rows WHERE anchor_valid IS NOT NULL AND konfidenz IS NOT NULL GROUP BY 1",
)
def calibration(t):
    return Z.calibration(t("field_rows").where("anchor_valid is not null and konfidenz is not null"), "konfidenz", "anchor_valid", [0.5, 0.6, 0.7, 0.8, 0.9])


@query(
    "r5_20_thresholds",
    "SELECT t AS threshold, sum((konfidenz < t)::INT)::BIGINT AS shown, sum((konfidenz < t AND NOT anchor_valid)::INT)::BIGINT AS hits, sum((konfidenz >= t AND NOT anchor_valid)::INT)::BIGINT AS missed FROM field_rows, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(t) WHERE anchor_valid IS NOT NULL AND konfidenz IS NOT NULL GROUP BY 1",
)
def thresholds(t):
    return Z.at_thresholds(t("field_rows").where("anchor_valid is not null and konfidenz is not null"), "konfidenz", "anchor_valid", [0.5, 0.7, 0.9])


@query(
    "r5_21_recall_precision",
    "SELECT belegtyp, round(sum((anchor_valid AND konfidenz >= 0.6)::INT) / nullif(sum(anchor_valid::INT), 0), 6) AS recall, round(sum((anchor_valid AND konfidenz >= 0.6)::INT) / nullif(sum((konfidenz >= 0.6)::INT), 0), 6) AS precision FROM field_rows WHERE anchor_valid IS NOT NULL AND konfidenz IS NOT NULL GROUP BY 1",
)
def recall_precision(t):
    hit = F.count_if(F.col("anchor_valid") & (F.col("konfidenz") >= 0.6))
    ratio = lambda n: F.round(hit / F.nullif(n, F.lit(0)), 6)
    return t("field_rows").where("anchor_valid is not null and konfidenz is not null").groupBy("belegtyp").agg(ratio(F.count_if("anchor_valid")).alias("recall"), ratio(F.count_if(F.col("konfidenz") >= 0.6)).alias("precision"))


@query(
    "r5_22_component_sums",
    """SELECT dokument_id, round(coalesce(max(CASE WHEN feld = 'praemie_kvg_total' THEN w END), 0) + coalesce(max(CASE WHEN feld = 'praemie_vvg_total' THEN w END), 0), 2) AS summe, count(w) >= 2 AS belegt FROM (SELECT dokument_id, feld, TRY_CAST(wert_decimal AS DOUBLE) AS w FROM field_rows WHERE feld IN ('praemie_kvg_total', 'praemie_vvg_total')) GROUP BY 1""",
)
def component_sums(t):
    rows = t("field_rows").where("feld in ('praemie_kvg_total', 'praemie_vvg_total')").withColumn("w", F.col("wert_decimal").try_cast("double"))
    part = lambda f: F.coalesce(F.max(F.when(F.col("feld") == f, F.col("w"))), F.lit(0.0))
    return rows.groupBy("dokument_id").agg(F.round(part("praemie_kvg_total") + part("praemie_vvg_total"), 2).alias("summe"), (F.count("w") >= 2).alias("belegt"))


@query("r5_23_document_diagnostics", "SELECT dokument_id, count(*) AS woerter, round(avg(length(text)), 4) AS laenge, round(sum(CASE WHEN contains(text, '(cid:') THEN 1 ELSE 0 END) / count(*), 6) AS cid, sum(CASE WHEN regexp_matches(text, '^20[0-9]{2}$') THEN 1 ELSE 0 END)::BIGINT AS jahre FROM tagged_words GROUP BY 1")
def document_diagnostics(t):
    return t("tagged_words").groupBy("dokument_id").agg(
        F.count("*").alias("woerter"), F.round(F.avg(F.length("text")), 4).alias("laenge"), F.round(F.count_if(F.col("text").contains("(cid:")) / F.count("*"), 6).alias("cid"), F.count_if(F.col("text").rlike("^20[0-9]{2}$")).alias("jahre")
    )


@query(
    "r5_24_metric_deltas",
    "WITH a AS (SELECT feld, avg(konfidenz) AS k, count(*) AS n FROM field_rows GROUP BY 1), b AS (SELECT feld, avg(konfidenz) AS k, count(*) AS n FROM field_rows_kopie GROUP BY 1) SELECT feld, round(b.k - a.k, 6) AS delta_konfidenz, b.n - a.n AS delta_n FROM a JOIN b USING (feld)",
)
def metric_deltas(t):
    m = lambda n, s: t(n).groupBy("feld").agg(F.avg("konfidenz").alias(f"k{s}"), F.count("*").alias(f"n{s}"))
    return m("field_rows", 1).join(m("field_rows_kopie", 2), "feld").select("feld", F.round(F.col("k2") - F.col("k1"), 6).alias("delta_konfidenz"), (F.col("n2") - F.col("n1")).alias("delta_n"))


# --- numbers and windows -----------------------------------------------------------------------------------------


@query("r6_01_numbered", "SELECT id, row_number() OVER (PARTITION BY dokument_id, zielwert ORDER BY id)::INT AS pos_new FROM position_store")
def numbered(t):
    return P.numbered(t("position_store"), ["dokument_id", "zielwert"], ["id"]).select("id", "pos_new")


_GIVEN = "WITH r AS (SELECT id, dokument_id, zielwert, CASE WHEN status = 'geprueft' THEN pos END AS given FROM position_store)"


@query(
    "r6_01_kept_or_next",
    _GIVEN + """, n AS (SELECT *, sum((given IS NULL)::INT) OVER (PARTITION BY dokument_id, zielwert ORDER BY id ROWS UNBOUNDED PRECEDING) AS n FROM r)
    SELECT id, given, coalesce(given, n + greatest(coalesce(max(given - n) OVER (PARTITION BY dokument_id, zielwert ORDER BY id ROWS UNBOUNDED PRECEDING), 0), 0))::INT AS pos_new FROM n""",
)
def kept_or_next(t):
    rows = t("position_store").withColumn("given", F.when(F.col("status") == "geprueft", F.col("pos")))
    return P.kept_or_next(rows, ["dokument_id", "zielwert"], ["id"], "given").select("id", "given", "pos_new")


@query(
    "r6_02_lowest_free",
    _GIVEN + """, u AS (SELECT DISTINCT dokument_id, given AS u FROM r WHERE given IS NOT NULL), o AS (SELECT id, dokument_id, row_number() OVER (PARTITION BY dokument_id ORDER BY id) AS n FROM r WHERE given IS NULL),
    c AS (SELECT dokument_id, unnest(generate_series(1, k)) AS u FROM (SELECT dokument_id, count(*) + coalesce(max(given), 0) AS k FROM r GROUP BY 1)),
    f AS (SELECT dokument_id, u, row_number() OVER (PARTITION BY dokument_id ORDER BY u) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.dokument_id = c.dokument_id AND u.u = c.u))
    SELECT id, given, given AS pos_new FROM r WHERE given IS NOT NULL UNION ALL SELECT o.id, NULL, f.u::INT FROM o JOIN f USING (dokument_id, n)""",
)
def lowest_free(t):
    rows = t("position_store").withColumn("given", F.when(F.col("status") == "geprueft", F.col("pos")))
    return P.lowest_free(rows, ["dokument_id"], ["id"], "given").select("id", "given", "pos_new")


@query("r6_03_by_anchor", "SELECT row_id, row_number() OVER (PARTITION BY dokument_id ORDER BY coalesce(anchor_page, 9999), coalesce(anchor_bbox[2], 1e9), row_id)::INT AS pos_new FROM field_rows")
def by_anchor(t):
    rows = t("field_rows").withColumn("_p", F.coalesce("anchor_page", F.lit(9999))).withColumn("_t", F.coalesce(F.get("anchor_bbox", F.lit(1)), F.lit(1e9)))
    return P.numbered(rows, ["dokument_id"], ["_p", "_t", "row_id"]).select("row_id", "pos_new")


@query("r6_04_next_ids", "SELECT entry_id, 'p' || lpad(((SELECT max(CAST(substr(id, 2) AS BIGINT)) FROM position_store) + row_number() OVER (ORDER BY entry_id))::VARCHAR, 10, '0') AS id FROM aussteller")
def next_ids(t):
    return P.next_ids(t("aussteller").select("entry_id"), t("position_store"), "id", "p", 10, ["entry_id"])


@query("r6_05_next_position", "SELECT dokument_id, zielwert, max(pos) + 1 AS naechste FROM position_store GROUP BY 1, 2")
def next_position(t):
    return t("position_store").groupBy("dokument_id", "zielwert").agg((F.max("pos") + 1).alias("naechste"))


@query("r6_06_last_wins", "SELECT dokument_id, feld, arg_max(wert_raw, (geaendert_am, row_id)) AS wert FROM field_rows WHERE wert_raw IS NOT NULL GROUP BY 1, 2")
def last_wins(t):
    return t("field_rows").where("wert_raw is not null").groupBy("dokument_id", "feld").agg(F.max_by("wert_raw", F.struct("geaendert_am", "row_id")).alias("wert"))


@query("r6_07_word_before", "SELECT word_id, lag(text) OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id) AS davor FROM tagged_words")
def word_before(t):
    return t("tagged_words").select("word_id", F.lag("text").over(W.partitionBy("dokument_id", "eingelesen_am").orderBy("tag_id")).alias("davor"))


@query(
    "r6_08_duplicates_marked",
    "SELECT p.id, s.first_source, coalesce(s.n - 1, 0) AS others FROM position_store p LEFT JOIN (SELECT aussteller, label, betrag, min(dokument_id) AS first_source, count(DISTINCT dokument_id) AS n FROM position_store GROUP BY 1, 2, 3 HAVING count(DISTINCT dokument_id) > 1) s USING (aussteller, label, betrag)",
)
def duplicates_marked(t):
    return P.duplicates_marked(t("position_store"), ["aussteller", "label", "betrag"], "dokument_id").select("id", "first_source", "others")


@query(
    "r6_09_free_names",
    "SELECT id, CASE WHEN k = 1 THEN zielwert ELSE zielwert || '-' || k END AS free_name FROM (SELECT p.id, p.zielwert, row_number() OVER (PARTITION BY p.zielwert ORDER BY p.id) + (a.zielwert IS NOT NULL)::INT AS k FROM position_store p LEFT JOIN (SELECT DISTINCT zielwert FROM abgleich) a ON a.zielwert = p.zielwert)",
)
def free_names(t):
    rows = t("position_store").select("id", F.col("zielwert").alias("wunsch"))
    existing = t("abgleich").select(F.col("zielwert").alias("name")).distinct()
    return P.free_names(rows, "wunsch", existing, "name", ["id"]).select("id", "free_name")


# --- order, limits, sets -----------------------------------------------------------------------------------------


@query("r7_01_ledger_order", "SELECT id, row_number() OVER (PARTITION BY dokument_id ORDER BY coalesce(TRY_CAST(nullif(ziffer, '') AS INT), 999), person, label, id)::INT AS rang FROM position_store")
def ledger_order(t):
    w = W.partitionBy("dokument_id").orderBy(X.line_order(F.col("ziffer")), "person", "label", "id")
    return t("position_store").select("id", F.row_number().over(w).alias("rang"))


@query("r7_03_most_common", "SELECT aussteller, count(*) AS n FROM position_store GROUP BY 1 ORDER BY n DESC, aussteller LIMIT 20")
def most_common(t):
    return t("position_store").groupBy("aussteller").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "aussteller").limit(20)


@query("r7_04_first_words", "SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(trim(text, ' '), ' +'), 1, 200), ' ') AS anfang FROM documents WHERE text IS NOT NULL")
def first_words(t):
    return t("documents").where("text is not null").select("doc_id", F.array_join(F.slice(F.split(F.trim("text"), " +"), 1, 200), " ").alias("anfang"))


@query("r7_05_union_of_sources", "SELECT quelle, count(*) AS n, count(DISTINCT dokument_id) AS dokumente FROM (SELECT 'feld' AS quelle, dokument_id FROM field_rows UNION ALL SELECT 'ablage', dokument_id FROM position_store UNION ALL SELECT 'lohn', dokument_id FROM lohnausweis) GROUP BY 1")
def union_of_sources(t):
    parts = [t(n).select(F.lit(q).alias("quelle"), "dokument_id") for q, n in (("feld", "field_rows"), ("ablage", "position_store"), ("lohn", "lohnausweis"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("quelle").agg(F.count("*").alias("n"), F.countDistinct("dokument_id").alias("dokumente"))


@query("r7_06_orphans", "SELECT DISTINCT dokument FROM position_store WHERE dokument NOT IN (SELECT beleg FROM abgleich)")
def orphans(t):
    return R.without(t("position_store").select("dokument").distinct(), t("abgleich").select(F.col("beleg").alias("dokument")), ["dokument"])


@query("r7_06_difference", "SELECT dokument_id, feld FROM field_rows EXCEPT ALL SELECT dokument_id, feld FROM field_rows_kopie")
def difference(t):
    return t("field_rows").select("dokument_id", "feld").exceptAll(t("field_rows_kopie").select("dokument_id", "feld"))


@query("r7_07_allowed_roles", "SELECT dossier_id, CASE WHEN count(DISTINCT CASE WHEN role IN ('mann', 'frau') THEN role END) = 1 THEN min(CASE WHEN role IN ('mann', 'frau') THEN role END) WHEN count(DISTINCT CASE WHEN role IN ('mann', 'frau') THEN role END) > 1 THEN 'gemeinsam' ELSE 'unbekannt' END AS rolle FROM family GROUP BY 1")
def allowed_roles(t):
    both = F.array_intersect(F.collect_set("role"), F.array(F.lit("mann"), F.lit("frau")))
    return t("family").groupBy("dossier_id").agg(both.alias("r")).select("dossier_id", F.when(F.size("r") == 1, F.col("r")[0]).when(F.size("r") > 1, "gemeinsam").otherwise("unbekannt").alias("rolle"))


@query("r7_08_surplus_rows", "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY dokument_id, feld ORDER BY geaendert_am DESC, row_id) AS n FROM field_rows) WHERE n > 1")
def surplus_rows(t):
    return S.first_rows(t("field_rows"), ["dokument_id", "feld"], [F.desc("geaendert_am"), F.asc("row_id")]).select("row_id")


@query("r7_09_same_value_in_documents", "SELECT betrag, zielwert, count(DISTINCT dokument_id) AS n FROM position_store WHERE betrag <> '' GROUP BY 1, 2 HAVING count(DISTINCT dokument_id) > 1")
def same_value_in_documents(t):
    return t("position_store").where("betrag <> ''").groupBy("betrag", "zielwert").agg(F.countDistinct("dokument_id").alias("n")).where("n > 1")


@query("r7_10_protected", "SELECT DISTINCT a.beleg, a.zielwert, a.pos FROM abgleich a WHERE a.zustand = 'stimmt' AND NOT EXISTS (SELECT 1 FROM abgleich_kopie b WHERE b.beleg = a.beleg AND b.zielwert = a.zielwert AND b.pos = a.pos)")
def protected(t):
    return S.vanished(t("abgleich"), t("abgleich_kopie"), ["beleg", "zielwert", "pos"], F.col("zustand") == "stimmt").select("beleg", "zielwert", "pos").distinct()
