"""Further composites over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.functions import texts as X
from ledgerloom.operators import relate as R
from ledgerloom.operators import rules as Q
from ledgerloom.operators import store as S
from ledgerloom.operators import summarize as Z
from ledgerloom.operators import words as O
from ledgerloom.plans.boxes import _AMOUNT, _CELLS, _NUMBER, _ROWS, DOC, PAGE, ROW, _rows
from ledgerloom.plans.catalog import Catalog
from ledgerloom.plans.scalars import sql_norm

catalog = Catalog()
query = catalog.query


_CELL_TEXTS = f"SELECT dokument_id, eingelesen_am, page, row_no, cell_no, string_agg(text, ' ' ORDER BY x0, word_id) AS cell, min(x0) AS cell_x0, max(x1) AS cell_x1 FROM ({_CELLS}) GROUP BY dokument_id, eingelesen_am, page, row_no, cell_no"


@query(
    "r2_07_row_amounts",
    f"""WITH c AS (SELECT *, trim(cell, ' ') AS t FROM ({_CELL_TEXTS})),
    d AS (SELECT *, regexp_replace(t, '(?i)^(?:CHF|Fr\\.)\\s*', '') AS s FROM c WHERE NOT regexp_matches(t, '^(19|20)\\d\\d$|^2100$') AND NOT contains(t, '%') AND NOT regexp_matches(t, '^\\d{{1,2}}\\.\\d{{1,2}}\\.(\\d{{4}})?$')),
    e AS (SELECT * EXCLUDE (s), regexp_replace(regexp_replace(regexp_replace(s, '(\\d)[°´`](\\d)', '\\1''\\2', 'g'), '(\\d)\\s+(\\d)', '\\1\\2', 'g'), '(\\d)\\s+(\\d)', '\\1\\2', 'g') AS s FROM d),
    f AS (SELECT *, regexp_replace(regexp_replace(s, '\\.[-–—]{{1,2}}$', ''), '[''’]', '', 'g') AS n FROM e WHERE regexp_matches(s, '^[+-]?\\d[\\d.,''’]*(?:[-–]{{1,2}})?$')),
    g AS (SELECT * EXCLUDE (n), CASE WHEN NOT contains(n, ',') THEN n WHEN contains(n, '.') THEN replace(n, ',', '') ELSE replace(n, ',', '.') END AS n FROM f),
    h AS (SELECT * EXCLUDE (n), CASE WHEN regexp_matches(n, '^[+-]?[1-9]\\d{{0,2}}(\\.\\d{{3}})+$') THEN replace(n, '.', '') ELSE n END AS n FROM g)
    SELECT dokument_id, page, row_no, cell_no, CAST(TRY_CAST(n AS DECIMAL(38,2)) AS DOUBLE) AS betrag FROM h WHERE regexp_matches(n, '^[+-]?\\d+(\\.\\d{{1,2}})?$')""",
)
def row_amounts(t):
    cells = O.cells(_rows(t), ROW).withColumn("betrag", A.cell_amount(F.col("cell")).cast("double"))
    return cells.where("betrag is not null").select("dokument_id", "page", "row_no", "cell_no", "betrag")


@query("r2_20_display_names", "SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(wert_raw, '^(Herrn?|Frau|Hr\\.|Fr\\.|Familie|Monsieur|Madame|Signora|Dr\\.) +', ''), ' *\\([^)]*[0-9][^)]*\\)', '', 'g'), ', *[0-9]{4} .*$', ''), ' ') AS anzeige FROM field_rows WHERE feld LIKE '%name' AND wert_raw IS NOT NULL")
def display_names(t):
    s = F.regexp_replace("wert_raw", "^(Herrn?|Frau|Hr\\.|Fr\\.|Familie|Monsieur|Madame|Signora|Dr\\.) +", "")
    s = F.regexp_replace(F.regexp_replace(s, " *\\([^)]*[0-9][^)]*\\)", ""), ", *[0-9]{4} .*$", "")
    return t("field_rows").where("feld like '%name' and wert_raw is not null").select("row_id", F.trim(s).alias("anzeige"))


@query("r2_26_identifiers", "SELECT DISTINCT unterscheidung, CASE WHEN regexp_matches(upper(regexp_replace(trim(unterscheidung, ' '), '\\s', '', 'g')), '^[A-Z]{2}\\d{2}[0-9A-Z]{8,}$') THEN upper(regexp_replace(trim(unterscheidung, ' '), '\\s', '', 'g')) ELSE regexp_replace(trim(unterscheidung, ' '), '\\s+', ' ', 'g') END AS kennung FROM position_store")
def identifiers(t):
    return t("position_store").select("unterscheidung", X.identifier(F.col("unterscheidung")).alias("kennung")).distinct()


@query("r2_32_span_minimum")
def span_minimum(t):
    docs = t("documents").where("text is not null").select("doc_id", "text")
    tokens = docs.select("doc_id", F.posexplode(F.split("text", "(?<= )")).alias("n", "w")).withColumn("p", F.length("w") / 100.0)
    spans = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("Total (?:CHF |Fr\\. )?[0-9'’]+[.,][0-9]{2}"), F.lit(0))).alias("v"), "text").distinct()
    placed = spans.select("doc_id", (F.position("v", "text") - 1).alias("start"), (F.position("v", "text") - 1 + F.length("v")).alias("end")).distinct()
    return O.span_minimum(tokens, placed, "doc_id", "n", "w", "p")


@query("r2_33_roles", "SELECT member_id, role AS rolle FROM family WHERE role IN ('mann', 'frau')")
def roles(t):
    shown = F.concat("first_name", F.lit(" ("), "role", F.lit(")"))
    return t("family").select("member_id", X.role_of(shown, ["mann", "frau"]).alias("rolle")).where("rolle is not null")


@query("r2_43_without_excluded", "SELECT row_id FROM field_rows WHERE feld NOT IN ('jahr', 'periode_von', 'periode_bis')")
def without_excluded(t):
    out = t("field_rows").sparkSession.createDataFrame([("jahr",), ("periode_von",), ("periode_bis",)], "feld string")
    return R.without(t("field_rows"), out, ["feld"]).select("row_id")


@query("r2_45_words_in_any_field", "SELECT id FROM position_store WHERE zielwert = 'betrag' AND regexp_matches(concat_ws(' ', label, aussteller, person), '(?i)zuwendung|spende|stiftung|hilfswerk')")
def words_in_any_field(t):
    return t("position_store").where("zielwert = 'betrag'").where(F.concat_ws(" ", "label", "aussteller", "person").rlike("(?i)zuwendung|spende|stiftung|hilfswerk")).select("id")


@query("r2_46_plausible_years", "SELECT jahr, count(*) AS n, (regexp_matches(jahr, '^\\d{4}$') AND TRY_CAST(jahr AS INT) BETWEEN 2018 AND 2030) AS plausibel FROM position_store GROUP BY 1")
def plausible_years(t):
    ok = F.col("jahr").rlike("^\\d{4}$") & F.col("jahr").try_cast("int").between(2018, 2030)
    return t("position_store").groupBy("jahr").agg(F.count("*").alias("n")).select("jahr", "n", ok.alias("plausibel"))


@query(
    "r3_09_label_spans",
    f"""WITH w AS (SELECT *, {', '.join(f"lead(text, {i}) OVER o AS t{i}, lead(top, {i}) OVER o AS y{i}" for i in (1, 2, 3))} FROM tagged_words WINDOW o AS (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id)),
    r AS (SELECT dokument_id, tag_id AS start, 1 AS size, text AS win, 0.0 AS rise FROM w WHERE text IS NOT NULL UNION ALL SELECT dokument_id, tag_id, 2, text || ' ' || t1, greatest(top, y1) - least(top, y1) FROM w WHERE t1 IS NOT NULL
    UNION ALL SELECT dokument_id, tag_id, 3, concat_ws(' ', text, t1, t2), greatest(top, y1, y2) - least(top, y1, y2) FROM w WHERE t2 IS NOT NULL UNION ALL SELECT dokument_id, tag_id, 4, concat_ws(' ', text, t1, t2, t3), greatest(top, y1, y2, y3) - least(top, y1, y2, y3) FROM w WHERE t3 IS NOT NULL),
    l AS (SELECT DISTINCT label, {sql_norm('label').replace('chr(32)', "''")} AS k FROM position_store)
    SELECT r.dokument_id, r.start, r.size, l.label FROM r JOIN l ON l.k = {sql_norm('r.win').replace('chr(32)', "''")} WHERE rise <= 5.0""",
)
def label_spans(t):
    labels = t("position_store").select("label").distinct()
    return O.label_spans(t("tagged_words"), DOC, "tag_id", labels, "label").select("dokument_id", "start", "size", "label")


_FIT = _NUMBER.replace("'", "''")


@query(
    "r3_13_below_headers",
    f"""WITH c AS ({_CELL_TEXTS}), h AS (SELECT dokument_id, eingelesen_am, page, row_no AS hr, cell AS header, (cell_x0 + cell_x1) / 2 AS m FROM c WHERE regexp_matches(cell, '(?i)brutto|steuerwert')),
    t AS (SELECT DISTINCT dokument_id, eingelesen_am, page, row_no FROM c WHERE regexp_matches(cell, '(?i)total|netto')),
    v AS (SELECT c.*, (cell_x0 + cell_x1) / 2 AS mid FROM c JOIN t USING (dokument_id, eingelesen_am, page, row_no) WHERE regexp_matches(cell, '{_FIT}')),
    j AS (SELECT dokument_id, eingelesen_am, page, hr, header, v.row_no, abs(mid - m) AS d, v.cell FROM v JOIN h USING (dokument_id, eingelesen_am, page) WHERE v.row_no BETWEEN hr + 1 AND hr + 7 AND m BETWEEN cell_x0 - 25.0 AND cell_x1 + 25.0)
    SELECT dokument_id, page, header, arg_min(cell, (row_no, d, cell)) AS value FROM j GROUP BY dokument_id, eingelesen_am, page, hr, header""",
)
def below_headers(t):
    cells = O.cells(_rows(t), ROW)
    found = O.below_header(cells, PAGE, F.col("cell").rlike("(?i)brutto|steuerwert"), F.col("cell").rlike("(?i)total|netto"), F.col("cell").rlike(_NUMBER))
    return found.select("dokument_id", "page", "header", "value")


@query("r3_17_sums_before", "SELECT row_id FROM (SELECT row_id, w, sum(w) OVER (PARTITION BY dokument_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT dokument_id, row_id, TRY_CAST(wert_decimal AS DECIMAL(18,2)) AS w FROM field_rows WHERE wert_decimal IS NOT NULL)) WHERE abs(b - w) <= 0.01")
def sums_before(t):
    rows = t("field_rows").where("wert_decimal is not null").select("dokument_id", "row_id", F.col("wert_decimal").try_cast("decimal(18,2)").alias("w"))
    return O.sums_up_to(rows, ["dokument_id"], ["row_id"], "w").select("row_id")


@query(
    "r3_19_sole_year_rows",
    "SELECT aussteller, person, zielwert, CASE WHEN sum((jahr = '2022')::INT) = 1 THEN max(CASE WHEN jahr = '2022' THEN betrag END) END AS betrag, CASE WHEN sum((jahr = '2022')::INT) = 0 THEN 'fehlt' WHEN sum((jahr = '2022')::INT) > 1 THEN 'mehrdeutig' END AS befund FROM position_store GROUP BY 1, 2, 3",
)
def sole_year_rows(t):
    return Z.sole_row(t("position_store"), ["aussteller", "person", "zielwert"], F.col("jahr") == "2022", "betrag")


@query(
    "r3_19_column_meanings",
    "WITH v AS (SELECT belegtyp, feld, CASE WHEN regexp_matches(wert_raw, '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$') THEN 'datum' WHEN regexp_matches(wert_raw, '^(19|20)\\d{2}$') THEN 'jahr' WHEN regexp_matches(wert_raw, '\\d[.,]\\d{2}$') THEN 'betrag' WHEN regexp_matches(wert_raw, '[a-z]') THEN 'text' END AS b FROM field_rows), c AS (SELECT belegtyp, feld, b, count(*) AS n FROM v WHERE b IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT belegtyp, feld, max(n) AS n FROM c GROUP BY 1, 2) SELECT belegtyp, feld, CASE WHEN count(*) = 1 THEN min(b) END AS bedeutung FROM c JOIN m USING (belegtyp, feld, n) GROUP BY 1, 2",
)
def column_meanings(t):
    v = F.col("wert_raw")
    votes = [(v.rlike("^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$"), "datum"), (v.rlike("^(19|20)\\d{2}$"), "jahr"), (v.rlike("\\d[.,]\\d{2}$"), "betrag"), (v.rlike("[a-z]"), "text")]
    return Z.majority(t("field_rows"), ["belegtyp"], "feld", votes)


@query("r5_12_gap_quote", "SELECT belegtyp, round(sum((wert_raw IS NULL OR wert_raw = '' OR wert_raw LIKE 'manual_review%')::INT) / count(*), 6) AS lueckenquote FROM field_rows GROUP BY 1 HAVING count(*) > 0")
def gap_quote(t):
    gap = F.col("wert_raw").isNull() | (F.col("wert_raw") == "") | F.col("wert_raw").startswith("manual_review")
    return t("field_rows").groupBy("belegtyp").agg(F.round(F.count_if(gap) / F.count("*"), 6).alias("lueckenquote"))


@query("r5_13_field_balance", "SELECT zielwert, count(*) AS erwartet, sum((betrag <> '')::INT)::BIGINT AS mit_wert, sum((TRY_CAST(nullif(betrag, '') AS DOUBLE) = 0)::INT)::BIGINT AS null_wert, sum((person <> '')::INT)::BIGINT AS zugeordnet, sum((status = 'geprueft')::INT)::BIGINT AS geprueft FROM position_store GROUP BY 1")
def field_balance(t):
    c = F.col
    zero = F.coalesce(F.nullif("betrag", F.lit("")).try_cast("double") == 0, F.lit(False))
    n = t("position_store").groupBy("zielwert").agg(
        F.count("*").alias("erwartet"), F.count_if(c("betrag") != "").alias("mit_wert"), F.sum(F.when(c("betrag") != "", zero.cast("int"))).alias("null_wert"), F.count_if(c("person") != "").alias("zugeordnet"), F.count_if(c("status") == "geprueft").alias("geprueft")
    )
    return n


@query("r5_16_family_totals", "SELECT 'gesamt' AS wer, round(sum(TRY_CAST(nullif(betrag, '') AS DOUBLE)), 2) AS summe, count(*) AS n FROM position_store UNION ALL SELECT person, round(sum(TRY_CAST(nullif(betrag, '') AS DOUBLE)), 2), count(*) FROM position_store GROUP BY 1")
def family_totals(t):
    p = t("position_store").withColumn("b", F.nullif("betrag", F.lit("")).try_cast("double"))
    total = p.groupBy(F.lit("gesamt").alias("wer")).agg(F.round(F.sum("b"), 2).alias("summe"), F.count("*").alias("n"))
    return total.unionByName(p.groupBy(F.col("person").alias("wer")).agg(F.round(F.sum("b"), 2).alias("summe"), F.count("*").alias("n")))


@query("r6_06_first_label", "SELECT dokument_id, arg_min(label, CASE zielwert WHEN 'bruttolohn_pos8' THEN 1 WHEN 'bruttoertrag' THEN 2 WHEN 'betrag' THEN 3 ELSE 9 END * 1000000000000 + CAST(substr(id, 2) AS BIGINT)) AS label FROM position_store GROUP BY 1")
def first_label(t):
    rank = F.when(F.col("zielwert") == "bruttolohn_pos8", 1).when(F.col("zielwert") == "bruttoertrag", 2).when(F.col("zielwert") == "betrag", 3).otherwise(9)
    return t("position_store").groupBy("dokument_id").agg(F.min_by("label", F.struct(rank, F.col("id"))).alias("label"))


_SEVERITY = "CASE WHEN zustand = 'fehlt' THEN 1 WHEN zustand = 'weicht_ab' THEN 2 WHEN zustand = 'andernorts' THEN 3 ELSE 9 END"


@query("r7_02_findings_order", f"SELECT beleg, zielwert, pos, row_number() OVER (PARTITION BY beleg ORDER BY {_SEVERITY}, zielwert, pos, geaendert_am)::INT AS rang FROM abgleich WHERE zustand <> 'stimmt'")
def findings_order(t):
    rank = F.when(F.col("zustand") == "fehlt", 1).when(F.col("zustand") == "weicht_ab", 2).when(F.col("zustand") == "andernorts", 3).otherwise(9)
    w = W.partitionBy("beleg").orderBy(rank, "zielwert", "pos", "geaendert_am")
    return t("abgleich").where("zustand <> 'stimmt'").select("beleg", "zielwert", "pos", F.row_number().over(w).alias("rang"))


@query(
    "r8_07_objects_confirmed",
    "SELECT dokument_id FROM (SELECT dokument_id, list(DISTINCT zielwert) AS alle, list(DISTINCT CASE WHEN status = 'geprueft' THEN zielwert END) AS da FROM position_store GROUP BY 1) WHERE list_has_all(list_filter(da, lambda x: x IS NOT NULL), alle)",
)
def objects_confirmed(t):
    marks = t("position_store").groupBy("dokument_id").agg(F.collect_set("zielwert").alias("alle"), F.collect_set(F.when(F.col("status") == "geprueft", F.col("zielwert"))).alias("da"))
    return marks.where(F.size(F.array_except("alle", "da")) == 0).select("dokument_id")


@query(
    "r8_10_imported",
    "WITH k AS (SELECT beleg, zielwert, pos, arg_max(zustand, geaendert_am) AS z FROM abgleich_kopie GROUP BY 1, 2, 3), a AS (SELECT beleg, zielwert, pos, arg_max(zustand, geaendert_am) AS z FROM abgleich GROUP BY 1, 2, 3) SELECT coalesce(a.beleg, k.beleg) AS beleg, coalesce(a.zielwert, k.zielwert) AS zielwert, coalesce(a.pos, k.pos) AS pos, CASE WHEN k.beleg IS NOT NULL THEN k.z ELSE a.z END AS z, CASE WHEN a.beleg IS NULL THEN 'insert' WHEN k.beleg IS NULL THEN 'keep' ELSE 'update' END AS action FROM a FULL OUTER JOIN k ON a.beleg = k.beleg AND a.zielwert = k.zielwert AND a.pos = k.pos",
)
def imported(t):
    latest = lambda n: S.latest_state(t(n), ["beleg", "zielwert", "pos"], "zustand", "geaendert_am").select("beleg", "zielwert", "pos", F.col("zustand").alias("z"))
    return S.merged(latest("abgleich"), latest("abgleich_kopie"), ["beleg", "zielwert", "pos"], ["z"])


@query("r8_13_in_closed_years", "WITH z AS (SELECT jahr, bool_and(status = 'geprueft') AS zu FROM position_store WHERE jahr < '2021' GROUP BY 1) SELECT p.id FROM position_store p WHERE p.jahr IN (SELECT jahr FROM z WHERE zu) OR (p.jahr < '2020' AND p.status = 'vorschlag')")
def in_closed_years(t):
    p = t("position_store")
    closed = p.where("jahr < '2021'").groupBy("jahr").agg(F.bool_and(F.col("status") == "geprueft").alias("zu")).where("zu").select("jahr")
    return p.join(closed.withColumn("_zu", F.lit(True)), "jahr", "left").where("_zu or (jahr < '2020' and status = 'vorschlag')").select("id")


@query("r8_14_restored", "SELECT a.row_id, coalesce(nullif(a.wert_raw, ''), k.w) AS wert FROM field_rows a LEFT JOIN (SELECT dokument_id, feld, max(nullif(wert_raw, '')) AS w FROM field_rows_kopie GROUP BY 1, 2) k USING (dokument_id, feld)")
def restored(t):
    k = t("field_rows_kopie").groupBy("dokument_id", "feld").agg(F.max(F.nullif("wert_raw", F.lit(""))).alias("w"))
    return t("field_rows").join(k, ["dokument_id", "feld"], "left").select("row_id", F.coalesce(F.nullif("wert_raw", F.lit("")), "w").alias("wert"))


@query(
    "r9_08_amounts_without_label",
    f"""WITH a AS (SELECT *, regexp_matches(text, '{_AMOUNT}') AS am FROM ({_ROWS})),
    g AS (SELECT *, coalesce(sum(am::INT) OVER (PARTITION BY dokument_id, eingelesen_am, page, row_no ORDER BY x0, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM a),
    l AS (SELECT dokument_id, page, row_no, coalesce(string_agg(CASE WHEN NOT am THEN text END, ' ' ORDER BY x0, word_id), '') AS label, max(CASE WHEN am THEN text END) AS amount FROM g GROUP BY dokument_id, eingelesen_am, page, row_no, grp HAVING max(CASE WHEN am THEN text END) IS NOT NULL)
    SELECT * FROM l WHERE NOT regexp_matches(label, '(?i)steuer|ertrag|lohn|zins|saldo|total|betrag|kosten|prämien|beiträge|vorsorge|betreuung')""",
)
def amounts_without_label(t):
    left = O.label_left(_rows(t), ROW, F.col("text").rlike(_NUMBER))
    own = F.col("label").rlike("(?i)steuer|ertrag|lohn|zins|saldo|total|betrag|kosten|prämien|beiträge|vorsorge|betreuung")
    return left.where(~own).select("dokument_id", "page", "row_no", "label", "amount")


@query(
    "r10_10_entry_checks",
    "SELECT id, array_to_string(list_filter([CASE WHEN TRY_CAST(nullif(betrag, '') AS DOUBLE) < 0 THEN 'negativ' END, CASE WHEN TRY_CAST(nullif(betrag, '') AS DOUBLE) > 10000000 THEN 'sehr_gross' END, CASE WHEN betrag <> '' AND NOT regexp_matches(betrag, '^-?\\d+(\\.\\d{1,2})?$') THEN 'form' END, CASE WHEN aussteller = '' THEN 'ohne_aussteller' END], lambda x: x IS NOT NULL), ',') AS codes FROM position_store",
)
def entry_checks(t):
    b = F.nullif("betrag", F.lit("")).try_cast("double")
    checks = [Q.Check("negativ", "h", b < 0), Q.Check("sehr_gross", "h", b > 10_000_000), Q.Check("form", "h", (F.col("betrag") != "") & ~F.col("betrag").rlike("^-?\\d+(\\.\\d{1,2})?$")), Q.Check("ohne_aussteller", "h", F.col("aussteller") == "")]
    return t("position_store").select("id", F.array_join(Q.codes(checks), ",").alias("codes"))


@query("r11_04_remaining_actions", "SELECT id, concat_ws('; ', CASE WHEN betrag = '' THEN 'Betrag erfassen' END, CASE WHEN person = '' THEN 'Person zuordnen' END, CASE WHEN status <> 'geprueft' THEN 'prüfen' END) AS rest FROM position_store")
def remaining_actions(t):
    c = F.col
    rest = F.concat_ws("; ", F.when(c("betrag") == "", "Betrag erfassen"), F.when(c("person") == "", "Person zuordnen"), F.when(c("status") != "geprueft", "prüfen"))
    return t("position_store").select("id", rest.alias("rest"))


@query(
    "r11_05_violations",
    "SELECT 'geprueft_ohne_betrag' AS pruefung, id AS zeile FROM position_store WHERE status = 'geprueft' AND betrag = '' UNION ALL SELECT 'pos_unter_1', id FROM position_store WHERE pos < 1 UNION ALL SELECT 'anker_ohne_seite', CAST(row_id AS VARCHAR) FROM field_rows WHERE anchor_valid AND anchor_page IS NULL",
)
def violations(t):
    p, f = t("position_store"), t("field_rows")
    parts = [
        p.where("status = 'geprueft' and betrag = ''").select(F.lit("geprueft_ohne_betrag").alias("pruefung"), F.col("id").alias("zeile")),
        p.where("pos < 1").select(F.lit("pos_unter_1").alias("pruefung"), F.col("id").alias("zeile")),
        f.where("anchor_valid and anchor_page is null").select(F.lit("anker_ohne_seite").alias("pruefung"), F.col("row_id").cast("string").alias("zeile")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("r11_06_totals_checked", "SELECT jahr, abs(a - b) <= 0.01 AS stimmt FROM (SELECT jahr, sum(TRY_CAST(nullif(betrag, '') AS DECIMAL(18,2))) AS a FROM position_store GROUP BY 1) JOIN (SELECT jahr, sum(s) AS b FROM (SELECT jahr, zielwert, sum(TRY_CAST(nullif(betrag, '') AS DECIMAL(18,2))) AS s FROM position_store GROUP BY 1, 2) GROUP BY 1) USING (jahr)")
def totals_checked(t):
    b = t("position_store").withColumn("b", F.nullif("betrag", F.lit("")).try_cast("decimal(18,2)"))
    a = b.groupBy("jahr").agg(F.sum("b").alias("a"))
    parts = b.groupBy("jahr", "zielwert").agg(F.sum("b").alias("s")).groupBy("jahr").agg(F.sum("s").alias("s"))
    return a.join(parts, "jahr").select("jahr", (F.abs(F.col("a") - F.col("s")) <= 0.01).alias("stimmt"))


@query("r12_04_digests", "SELECT belegtyp, count(*) AS n, bit_xor(('0x' || substr(sha256(coalesce(wert_raw, '')), 1, 8))::BIGINT) AS abdruck FROM field_rows GROUP BY 1")
def digests(t):
    word = F.conv(F.substring(F.sha2(F.coalesce("wert_raw", F.lit("")), 256), 1, 8), 16, 10).cast("bigint")
    return t("field_rows").groupBy("belegtyp").agg(F.count("*").alias("n"), F.bit_xor(word).alias("abdruck"))


@query("r17_05_chain_or_document", "SELECT p.id, coalesce(nullif(p.betrag, ''), f.w) AS wert, (p.betrag <> '' AND f.w IS NOT NULL AND p.betrag <> f.w) AS abweichung FROM position_store p LEFT JOIN (SELECT dokument_id, feld, max(wert_decimal) AS w FROM field_rows GROUP BY 1, 2) f ON f.dokument_id = p.dokument_id AND f.feld = p.zielwert")
def chain_or_document(t):
    f = t("field_rows").groupBy("dokument_id", F.col("feld").alias("zielwert")).agg(F.max("wert_decimal").alias("w"))
    j = t("position_store").join(f, ["dokument_id", "zielwert"], "left")
    differs = (F.col("betrag") != "") & F.col("w").isNotNull() & (F.col("betrag") != F.col("w"))
    return j.select("id", F.coalesce(F.nullif("betrag", F.lit("")), "w").alias("wert"), F.coalesce(differs, F.lit(False)).alias("abweichung"))


@query("r17_06_with_leftovers", "SELECT dokument_id, 'kette' AS quelle FROM position_store UNION SELECT dokument_id, 'rest' FROM field_rows WHERE dokument_id NOT IN (SELECT dokument_id FROM position_store)")
def with_leftovers(t):
    chain = t("position_store").select("dokument_id", F.lit("kette").alias("quelle"))
    rest = R.without(t("field_rows"), t("position_store"), ["dokument_id"]).select("dokument_id", F.lit("rest").alias("quelle"))
    return chain.unionByName(rest).distinct()


@query("r17_07_object_marks", "SELECT id, CASE WHEN unterscheidung <> '' THEN right(unterscheidung, 4) ELSE 'S' || CAST(pos AS VARCHAR) END AS marke FROM position_store")
def object_marks(t):
    return t("position_store").select("id", F.when(F.col("unterscheidung") != "", F.right("unterscheidung", F.lit(4))).otherwise(F.concat(F.lit("S"), F.col("pos").cast("string"))).alias("marke"))


@query("r17_08_confirmed_by_rule", "SELECT m.id, CASE WHEN r.b = m.b THEN 'regel' WHEN r.b IS NOT NULL THEN 'abweichend' ELSE 'modell' END AS herkunft_neu FROM (SELECT id, dokument_id, zielwert, nullif(betrag, '') AS b FROM position_store WHERE herkunft = 'modell') m LEFT JOIN (SELECT dokument_id, zielwert, min(nullif(betrag, '')) AS b FROM position_store WHERE herkunft IN ('label', 'geometrie') GROUP BY 1, 2) r USING (dokument_id, zielwert)")
def confirmed_by_rule(t):
    p = t("position_store").withColumn("b", F.nullif("betrag", F.lit("")))
    rule = p.where("herkunft in ('label', 'geometrie')").groupBy("dokument_id", "zielwert").agg(F.min("b").alias("r"))
    state = F.when(F.col("r") == F.col("b"), "regel").when(F.col("r").isNotNull(), "abweichend").otherwise("modell")
    return p.where("herkunft = 'modell'").join(rule, ["dokument_id", "zielwert"], "left").select("id", state.alias("herkunft_neu"))


@query("r17_11_person_view", "SELECT person, zielwert, CASE WHEN betrag = '' THEN 'ohne_wert' WHEN status = 'geprueft' THEN 'entschieden' ELSE 'offen' END AS stand, count(*) AS n FROM position_store GROUP BY 1, 2, 3")
def person_view(t):
    state = F.when(F.col("betrag") == "", "ohne_wert").when(F.col("status") == "geprueft", "entschieden").otherwise("offen")
    return t("position_store").groupBy("person", "zielwert", state.alias("stand")).agg(F.count("*").alias("n"))


@query("r17_13_issuers_unified", "WITH k AS (SELECT substr(regexp_replace(lower(aussteller), '[^a-z]', '', 'g'), 1, 8) AS k, min(aussteller) AS neu FROM position_store WHERE aussteller <> '' GROUP BY 1) SELECT p.id, p.aussteller AS vorher, k.neu AS nachher FROM position_store p JOIN k ON k.k = substr(regexp_replace(lower(p.aussteller), '[^a-z]', '', 'g'), 1, 8) WHERE p.aussteller <> '' AND p.aussteller <> k.neu")
def issuers_unified(t):
    p = t("position_store").where("aussteller <> ''").withColumn("k", X.core_name(F.col("aussteller")))
    new = p.groupBy("k").agg(F.min("aussteller").alias("neu"))
    unified = p.join(new, "k").select("id", F.col("neu").alias("aussteller"))
    return S.protocol(p.select("id", "aussteller"), unified, "id", ["aussteller"]).select("id", "vorher", "nachher")


@query("r17_15_own_rows_in_store", "SELECT a.beleg, a.zielwert, a.pos, (d.dokument IS NOT NULL) AS dokument_da, (s.dokument IS NOT NULL) AS schluessel_da FROM (SELECT DISTINCT beleg, zielwert, pos FROM abgleich) a LEFT JOIN (SELECT DISTINCT dokument FROM position_store) d ON d.dokument = a.beleg LEFT JOIN (SELECT DISTINCT dokument, zielwert, pos FROM position_store) s ON s.dokument = a.beleg AND s.zielwert = a.zielwert AND s.pos = a.pos")
def own_rows_in_store(t):
    own = t("abgleich").select("beleg", "zielwert", "pos").distinct()
    p = t("position_store").withColumnRenamed("dokument", "beleg")
    docs = p.select("beleg").distinct().withColumn("_d", F.lit(True))
    keys = p.select("beleg", "zielwert", "pos").distinct().withColumn("_k", F.lit(True))
    j = own.join(docs, "beleg", "left").join(keys, ["beleg", "zielwert", "pos"], "left")
    return j.select("beleg", "zielwert", "pos", F.coalesce("_d", F.lit(False)).alias("dokument_da"), F.coalesce("_k", F.lit(False)).alias("schluessel_da"))


@query("r17_19_restored_by_priority", "SELECT coalesce(a.dokument_id, b.dokument_id, c.dokument_id) AS dokument_id, coalesce(a.w, b.w, c.w) AS wert, CASE WHEN a.w IS NOT NULL THEN 1 WHEN b.w IS NOT NULL THEN 2 WHEN c.w IS NOT NULL THEN 3 END AS quelle FROM (SELECT dokument_id, max(nullif(betrag, '')) AS w FROM position_store WHERE zielwert = 'nettolohn_pos11' GROUP BY 1) a FULL OUTER JOIN (SELECT dokument_id, max(wert_decimal) AS w FROM field_rows WHERE feld = 'nettolohn_pos11' GROUP BY 1) b ON a.dokument_id = b.dokument_id FULL OUTER JOIN (SELECT dokument_id, max(nettolohn_pos11.value) AS w FROM lohnausweis GROUP BY 1) c ON coalesce(a.dokument_id, b.dokument_id) = c.dokument_id")
def restored_by_priority(t):
    a = t("position_store").where("zielwert = 'nettolohn_pos11'").groupBy("dokument_id").agg(F.max(F.nullif("betrag", F.lit(""))).alias("w"))
    b = t("field_rows").where("feld = 'nettolohn_pos11'").groupBy("dokument_id").agg(F.max("wert_decimal").alias("w"))
    c = t("lohnausweis").groupBy("dokument_id").agg(F.max("nettolohn_pos11.value").alias("w"))
    stacked = reduce(DataFrame.unionByName, [df.withColumn("quelle", F.lit(i + 1)) for i, df in enumerate((a, b, c))])
    best = stacked.groupBy("dokument_id").agg(F.min(F.when(F.col("w").isNotNull(), F.struct("quelle", "w"))).alias("m"))
    return best.select("dokument_id", F.col("m.w").alias("wert"), F.col("m.quelle").alias("quelle"))


@query("r17_21_correction_diagnosis", "SELECT zustand, coalesce(nullif(grund, ''), 'ohne') AS grund, count(*) AS n, count(DISTINCT beleg) AS belege FROM (SELECT beleg, zielwert, pos, arg_max(zustand, geaendert_am) AS zustand, arg_max(grund, geaendert_am) AS grund FROM abgleich GROUP BY 1, 2, 3) GROUP BY 1, 2")
def correction_diagnosis(t):
    last = t("abgleich").groupBy("beleg", "zielwert", "pos").agg(F.max_by("zustand", "geaendert_am").alias("zustand"), F.max_by("grund", "geaendert_am").alias("grund"))
    return last.groupBy("zustand", F.coalesce(F.nullif("grund", F.lit("")), F.lit("ohne")).alias("grund")).agg(F.count("*").alias("n"), F.countDistinct("beleg").alias("belege"))
