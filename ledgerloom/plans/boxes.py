"""Word boxes: reading order, rows, cells, labels, values and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A
from ledgerloom.operators import words as O
from ledgerloom.plans.catalog import Catalog
from ledgerloom.plans.scalars import sql_norm

catalog = Catalog()
query = catalog.query

DOC = ["dokument_id", "eingelesen_am"]
PAGE = [*DOC, "page"]
ROW = [*PAGE, "row_no"]
_AMOUNT = "^-?[0-9][0-9''’]*[.,][0-9]{2}$"
_NUMBER = "^-?[0-9]['0-9’]*[.,][0-9]{2}$"
_ROWS = """SELECT *, (sum(neu) OVER (PARTITION BY dokument_id, eingelesen_am, page ORDER BY mid, x0, word_id ROWS UNBOUNDED PRECEDING))::INT AS row_no FROM
 (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY dokument_id, eingelesen_am, page ORDER BY mid, x0, word_id) < 3.0 THEN 0 ELSE 1 END AS neu FROM
 (SELECT *, (top + bottom) / 2 AS mid FROM tagged_words))"""
_CELLS = f"""SELECT *, (sum(c) OVER (PARTITION BY dokument_id, eingelesen_am, page, row_no ORDER BY x0, word_id ROWS UNBOUNDED PRECEDING))::INT AS cell_no FROM
 (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY dokument_id, eingelesen_am, page, row_no ORDER BY x0, word_id) <= 12.0 THEN 0 ELSE 1 END AS c FROM ({_ROWS}))"""


def _rows(t):
    words = t("tagged_words")
    return O.gap_rows(words.withColumn("_o", F.struct("x0", "word_id")), PAGE, order="_o").drop("_o")


@query("r3_01_dense_tags", "SELECT word_id, row_number() OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id) - 1 AS tag FROM tagged_words WHERE trim(text) <> ''")
def dense_tags(t):
    return O.dense_tags(t("tagged_words"), DOC, "tag_id").select("word_id", F.col("tag").cast("bigint").alias("tag"))


@query(
    "r3_01_tagged_text",
    "SELECT dokument_id, CAST(eingelesen_am AS VARCHAR) AS gelesen, string_agg('[T' || tag || '] ' || trim(text, ' '), ' ' ORDER BY tag) AS tagged FROM (SELECT *, row_number() OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id) - 1 AS tag FROM tagged_words WHERE trim(text) <> '') GROUP BY 1, 2",
)
def tagged_text(t):
    tags = O.dense_tags(t("tagged_words"), DOC, "tag_id")
    return O.tagged_text(tags, DOC).select("dokument_id", F.col("eingelesen_am").cast("string").alias("gelesen"), "tagged")


@query("r3_02_rows_by_gap", f"SELECT word_id, row_no FROM ({_ROWS})")
def rows_by_gap(t):
    return _rows(t).select("word_id", "row_no")


@query("r3_02_rows_by_mean")
def rows_by_mean(t):
    words = t("tagged_words").select("word_id", "dokument_id", "eingelesen_am", "page", "x0", "top", "bottom")
    return O.nearest_rows(words, PAGE, key="word_id").select("word_id", "row_no")


@query("r3_03_cells", f"SELECT dokument_id, page, row_no, cell_no, string_agg(text, ' ' ORDER BY x0, word_id) AS cell, min(x0) AS cell_x0, max(x1) AS cell_x1 FROM ({_CELLS}) GROUP BY dokument_id, eingelesen_am, page, row_no, cell_no")
def cells(t):
    return O.cells(_rows(t), ROW).select("dokument_id", "page", "row_no", "cell_no", "cell", "cell_x0", "cell_x1")


@query(
    "r3_03_row_texts",
    f"SELECT dokument_id, page, row_no, string_agg(cell, ' | ' ORDER BY cell_no) AS row_text, count(*) AS cells FROM (SELECT dokument_id, eingelesen_am, page, row_no, cell_no, string_agg(text, ' ' ORDER BY x0, word_id) AS cell FROM ({_CELLS}) GROUP BY ALL) GROUP BY dokument_id, eingelesen_am, page, row_no",
)
def row_texts(t):
    return O.row_texts(O.cells(_rows(t), ROW), ROW).select("dokument_id", "page", "row_no", "row_text", "cells")


@query("r3_04_without_margin", f"SELECT word_id FROM (SELECT word_id, min(CASE WHEN length(trim(text, ' ')) <= 3 AND x0 < 595 * 0.10 THEN 1 ELSE 0 END) OVER (PARTITION BY dokument_id, eingelesen_am, page, row_no) AS o FROM ({_ROWS})) WHERE o = 0")
def without_margin(t):
    return O.without_margin(_rows(t), ROW, width=595.0, share=0.10).select("word_id")


@query(
    "r3_05_row_search",
    f"SELECT dokument_id, page, row_no FROM (SELECT dokument_id, eingelesen_am, page, row_no, string_agg(text, ' ' ORDER BY x0, word_id) AS z FROM ({_ROWS}) GROUP BY ALL) WHERE regexp_matches(z, '(?i)brutto(lohn|ertrag)')",
)
def row_search(t):
    parts = F.sort_array(F.collect_list(F.struct("x0", "word_id", "text")))
    lines = _rows(t).groupBy(*ROW).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("z"))
    return lines.where(F.col("z").rlike("(?i)brutto(lohn|ertrag)")).select("dokument_id", "page", "row_no")


@query(
    "r3_06_anchor_checks",
    f"""WITH n AS (SELECT feld, {sql_norm('snippet').replace('chr(32)', "''")} AS s, {sql_norm('wert_raw').replace('chr(32)', "''")} AS v FROM field_rows)
    SELECT feld, CASE WHEN s = '' OR v = '' THEN 'none' WHEN contains(s, v) THEN 'forward' WHEN contains(v, s) AND length(s) >= greatest(3, length(v) // 2) THEN 'backward' ELSE 'none' END AS treffer, count(*) AS n FROM n GROUP BY 1, 2""",
)
def anchor_checks(t):
    return t("field_rows").groupBy("feld", O.holds(F.col("snippet"), F.col("wert_raw")).alias("treffer")).agg(F.count("*").alias("n"))


@query(
    "r3_07_windows",
    """WITH w AS (SELECT dokument_id, text AS a, lead(text) OVER o AS b, lead(text, 2) OVER o AS c FROM tagged_words WINDOW o AS (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id))
    SELECT size, count(*) AS n, count(DISTINCT win) AS verschieden FROM (SELECT 1 AS size, a AS win FROM w WHERE a IS NOT NULL UNION ALL SELECT 2, a || ' ' || b FROM w WHERE b IS NOT NULL UNION ALL SELECT 3, a || ' ' || b || ' ' || c FROM w WHERE c IS NOT NULL) GROUP BY size""",
)
def word_windows(t):
    runs = O.windows(t("tagged_words"), DOC, "tag_id", most=3)
    return runs.groupBy("size").agg(F.count("*").alias("n"), F.countDistinct("window").alias("verschieden"))


_NORM_W = sql_norm("text").replace("chr(32)", "''")


@query(
    "r3_07_value_windows",
    f"""WITH v AS (SELECT row_id, dokument_id, {sql_norm('wert_raw').replace('chr(32)', "''")} AS v FROM field_rows), w AS (SELECT dokument_id, eingelesen_am, tag_id, {_NORM_W} AS w FROM tagged_words WHERE {_NORM_W} <> ''),
    a AS (SELECT *, concat_ws('', w, {', '.join(f'lead(w, {i}) OVER o' for i in range(1, 12))}) AS alle, [{', '.join(f"coalesce(lead(w, {i}) OVER o, '')" if i else 'w' for i in range(12))}] AS ws FROM w WINDOW o AS (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id)),
    m AS (SELECT row_id, v, tag_id, w, ws, instr(alle, v) AS stelle FROM a JOIN v USING (dokument_id) WHERE v <> ''),
    f AS (SELECT row_id, min((len(list_filter(range(1, 13), lambda k: k = 1 OR length(array_to_string(ws[1:k - 1], '')) < stelle - 1 + length(v))), tag_id)) AS hit FROM m WHERE stelle > 0 AND stelle <= length(w) GROUP BY 1),
    b AS (SELECT row_id, max((length(w), -tag_id)) AS back FROM m WHERE length(w) >= 3 AND length(w) * 2 >= length(v) AND contains(v, w) GROUP BY 1)
    SELECT row_id, CASE WHEN f.hit IS NOT NULL THEN 'forward' WHEN b.back IS NOT NULL THEN 'backward' ELSE 'none' END AS found, coalesce(f.hit[2], -b.back[2]) AS start, CAST(coalesce(f.hit[1], CASE WHEN b.back IS NOT NULL THEN 1 END) AS INT) AS size FROM v LEFT JOIN f USING (row_id) LEFT JOIN b USING (row_id)""",
)
def value_windows(t):
    values = t("field_rows").select("row_id", "dokument_id", "wert_raw")
    return O.value_windows(values, t("tagged_words"), "dokument_id", "eingelesen_am", "tag_id", value="wert_raw").select("row_id", "found", "start", "size")


@query(
    "r3_08_nearest_to_label",
    f"""WITH l AS (SELECT * FROM tagged_words WHERE regexp_matches(text, '^(Bruttolohn|Nettolohn|Bruttoertrag|Spendentotal|Schuldzinsen)$')), v AS (SELECT * FROM tagged_words WHERE regexp_matches(text, '{_AMOUNT}')),
    p AS (SELECT l.dokument_id, l.eingelesen_am, l.page, l.text AS label, v.text AS value, row_number() OVER (PARTITION BY l.dokument_id, l.eingelesen_am, l.page, l.text ORDER BY abs(v.top - l.top), abs(v.x0 - l.x0), v.text) AS n FROM l JOIN v ON l.dokument_id = v.dokument_id AND l.eingelesen_am = v.eingelesen_am AND l.page = v.page
    WHERE (abs(l.top - v.top) <= 5 AND l.x1 <= v.x0 + 5) OR (v.top - l.top > 0 AND v.top - l.top <= 30 AND least(l.x1, v.x1) - greatest(l.x0, v.x0) >= least(l.x1 - l.x0, v.x1 - v.x0) * 0.3))
    SELECT dokument_id, page, label, value FROM p WHERE n = 1""",
)
def nearest_to_label(t):
    words = t("tagged_words")
    labels = words.where(F.col("text").rlike("^(Bruttolohn|Nettolohn|Bruttoertrag|Spendentotal|Schuldzinsen)$")).withColumn("label", F.col("text"))
    values = words.where(F.col("text").rlike(_NUMBER)).withColumn("value", F.col("text"))
    return O.nearest_value(O.neighbours(labels, values, PAGE), [*PAGE, "label"]).select("dokument_id", "page", "label", "value")


@query(
    "r3_10_thousands_joined",
    """SELECT dokument_id, tag_id AS at, head || text AS joined FROM (SELECT *, lag(text) OVER o AS head, x0 - lag(x1) OVER o AS gap, abs(top - lag(top) OVER o) AS lift FROM tagged_words WINDOW o AS (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id))
    WHERE regexp_matches(head, '^(0|[1-9]\\d{0,2})$') AND lift <= 3 AND gap BETWEEN 0 AND 30 AND (regexp_matches(text, '^\\d{3}(\\.\\d{2})?$') OR (regexp_matches(text, '^\\d{1,2}\\.\\d{1,2}$') AND gap <= 5))""",
)
def thousands_joined(t):
    return O.thousands_joined(t("tagged_words"), DOC, "tag_id").select("dokument_id", "at", "joined")


@query(
    "r3_11_located_values",
    f"""WITH w AS (SELECT dokument_id, tag_id, text AS a, lead(text) OVER o AS b, lead(text, 2) OVER o AS c FROM tagged_words WINDOW o AS (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id)),
    r AS (SELECT dokument_id, tag_id AS start, 1 AS size, a AS win FROM w WHERE a IS NOT NULL UNION ALL SELECT dokument_id, tag_id, 2, a || ' ' || b FROM w WHERE b IS NOT NULL UNION ALL SELECT dokument_id, tag_id, 3, a || ' ' || b || ' ' || c FROM w WHERE c IS NOT NULL),
    k AS (SELECT dokument_id, {sql_norm('win')} AS k, size, start, win FROM r),
    m AS (SELECT dokument_id, k, arg_min(start, size * 100000000 + start) AS at, min(size * 100000000 + start) // 100000000 AS size FROM k WHERE k <> '' GROUP BY 1, 2),
    v AS (SELECT row_id, dokument_id, {sql_norm('wert_raw').replace('chr(32)', "''")} AS k FROM field_rows)
    SELECT v.row_id, m.at, m.size::BIGINT AS size FROM v LEFT JOIN m ON v.dokument_id = m.dokument_id AND v.k = m.k WHERE v.k <> ''""",
)
def located_values(t):
    values = t("field_rows").select("row_id", "dokument_id", "wert_raw")
    spans = O.windows(t("tagged_words"), DOC, "tag_id", most=3).withColumn("_key", A.normalized(F.col("window"))).where("_key <> ''")
    best = spans.groupBy("dokument_id", "_key").agg(F.min(F.struct("size", "start")).alias("hit"))
    asked = values.withColumn("_key", A.normalized(F.col("wert_raw"))).where("_key <> ''")
    return asked.join(best, ["dokument_id", "_key"], "left").select("row_id", F.col("hit.start").alias("at"), F.col("hit.size").cast("bigint").alias("size"))


@query(
    "r3_12_labels_left",
    f"""WITH a AS (SELECT *, regexp_matches(text, '{_AMOUNT}') AS am FROM ({_ROWS})),
    g AS (SELECT *, coalesce(sum(am::INT) OVER (PARTITION BY dokument_id, eingelesen_am, page, row_no ORDER BY x0, word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM a)
    SELECT dokument_id, page, row_no, coalesce(string_agg(CASE WHEN NOT am THEN text END, ' ' ORDER BY x0, word_id), '') AS label, max(CASE WHEN am THEN text END) AS amount FROM g GROUP BY dokument_id, eingelesen_am, page, row_no, grp HAVING max(CASE WHEN am THEN text END) IS NOT NULL""",
)
def labels_left(t):
    out = O.label_left(_rows(t), ROW, F.col("text").rlike(_NUMBER))
    return out.select("dokument_id", "page", "row_no", "label", "amount")


@query(
    "r3_14_lead_values",
    """SELECT dokument_id, coalesce(max(CASE WHEN feld = 'nettolohn_pos11' THEN wert_decimal END), max(CASE WHEN feld = 'bruttoertrag' THEN wert_decimal END), max(CASE WHEN feld = 'betrag' THEN wert_decimal END)) AS leitwert,
    CASE WHEN count(CASE WHEN feld IN ('nettolohn_pos11', 'bruttoertrag', 'betrag') THEN 1 END) = 0 THEN 'kein_feld' WHEN coalesce(max(CASE WHEN feld IN ('nettolohn_pos11', 'bruttoertrag', 'betrag') THEN wert_decimal END), '') = '' THEN 'leer' ELSE 'ok' END AS luecke FROM field_rows GROUP BY 1""",
)
def lead_values(t):
    fields = ("nettolohn_pos11", "bruttoertrag", "betrag")
    of = lambda f: F.max(F.when(F.col("feld") == f, F.col("wert_decimal")))
    any_of = F.col("feld").isin(*fields)
    gap = F.when(F.count_if(any_of) == 0, "kein_feld").when(F.coalesce(F.max(F.when(any_of, F.col("wert_decimal"))), F.lit("")) == "", "leer").otherwise("ok")
    return t("field_rows").groupBy("dokument_id").agg(F.coalesce(*[of(f) for f in fields]).alias("leitwert"), gap.alias("luecke"))


@query(
    "r3_15_neighbours",
    f"""WITH l AS (SELECT * FROM tagged_words WHERE text IN ('Bruttolohn', 'Nettolohn', 'Bruttoertrag')), v AS (SELECT * FROM tagged_words WHERE regexp_matches(text, '{_AMOUNT}')),
    p AS (SELECT l.word_id AS l, v.word_id AS v, CASE WHEN abs(l.top - v.top) <= 5 AND l.x1 <= v.x0 + 5 THEN 'beside' WHEN v.top - l.top > 0 AND v.top - l.top <= 30 AND least(l.x1, v.x1) - greatest(l.x0, v.x0) >= least(l.x1 - l.x0, v.x1 - v.x0) * 0.3 THEN 'below' END AS w FROM l JOIN v ON l.dokument_id = v.dokument_id AND l.eingelesen_am = v.eingelesen_am AND l.page = v.page)
    SELECT w AS lage, count(*) AS n FROM p WHERE w IS NOT NULL GROUP BY 1""",
)
def neighbour_counts(t):
    words = t("tagged_words")
    labels = words.where("text in ('Bruttolohn', 'Nettolohn', 'Bruttoertrag')").withColumn("label", F.col("word_id"))
    values = words.where(F.col("text").rlike(_NUMBER)).withColumn("value", F.col("word_id"))
    return O.neighbours(labels, values, PAGE).groupBy(F.col("where").alias("lage")).agg(F.count("*").alias("n"))


@query(
    "r3_16_largest_amounts",
    f"""WITH a AS (SELECT dokument_id, eingelesen_am, TRY_CAST(replace(replace(replace(text, '''', ''), '’', ''), ',', '.') AS DOUBLE) AS b, max(top) AS top FROM tagged_words WHERE regexp_matches(text, '{_AMOUNT}') GROUP BY 1, 2, 3)
    SELECT dokument_id, b AS betrag, top, r AS rang FROM (SELECT *, dense_rank() OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY b DESC)::INT AS r FROM a) WHERE r <= 2""",
)
def largest_amounts(t):
    b = F.regexp_replace(F.regexp_replace("text", "['’]", ""), ",", ".").try_cast("double")
    found = t("tagged_words").where(F.col("text").rlike(_NUMBER)).withColumn("betrag", b)
    return O.ranked_amounts(found, DOC, value="betrag", top="top").select("dokument_id", "betrag", "top", F.col("rank").alias("rang"))


@query(
    "r3_20_sections",
    "SELECT word_id, (sum(CASE WHEN regexp_matches(text, '^(Saldo|Brutto|Netto|Schuld|Total)') THEN 1 ELSE 0 END) OVER (PARTITION BY dokument_id, eingelesen_am ORDER BY tag_id ROWS UNBOUNDED PRECEDING))::INT AS abschnitt FROM tagged_words",
)
def sections(t):
    return O.sections(t("tagged_words"), DOC, ["tag_id"], F.col("text").rlike("^(Saldo|Brutto|Netto|Schuld|Total)"), "abschnitt").select("word_id", "abschnitt")


@query("r3_21_merged_objects", "WITH v AS (SELECT dossier_id, belegtyp, feld, wert_decimal, count(DISTINCT dokument_id) AS sources, min(dokument_id) AS first_source FROM field_rows WHERE wert_decimal IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT *, count(*) OVER (PARTITION BY dossier_id, belegtyp, feld) AS values FROM v")
def merged_objects(t):
    rows = t("field_rows").where("wert_decimal is not null")
    return O.merged_objects(rows, ["dossier_id", "belegtyp"], "feld", "wert_decimal", "dokument_id")


@query(
    "r3_22_single_values",
    """WITH p AS (SELECT dokument_id, feld, wert_decimal AS v, max(geaendert_am) AS d FROM field_rows WHERE wert_decimal IS NOT NULL GROUP BY 1, 2, 3),
    a AS (SELECT dokument_id, feld, count(*) AS n, count(DISTINCT d) AS k, arg_max(v, d) AS neu, min(v) AS eins, string_agg(v, ' / ' ORDER BY v) AS alle FROM p GROUP BY 1, 2)
    SELECT dokument_id, feld, CASE WHEN n = 1 THEN eins WHEN k = n THEN neu ELSE alle END AS value, CASE WHEN n = 1 THEN 'single' WHEN k = n THEN 'newest' ELSE 'contradiction' END AS state, n FROM a""",
)
def single_values(t):
    return O.single_value(t("field_rows"), ["dokument_id", "feld"], "wert_decimal", "geaendert_am")


@query(
    "r3_23_repeated_labels",
    "SELECT dokument_id, count(*) AS n FROM (SELECT dokument_id, eingelesen_am, tag_id FROM tagged_words WHERE text IN ('Total', 'Saldo')) GROUP BY dokument_id, eingelesen_am HAVING count(*) >= 2",
)
def repeated_labels(t):
    hits = t("tagged_words").where("text in ('Total', 'Saldo')").groupBy(*DOC).agg(F.count("*").alias("n"))
    return hits.where("n >= 2").select("dokument_id", "n")


@query("r1_03_better_readings")
def better_readings(t):
    parts = F.sort_array(F.collect_list(F.struct("x0", "word_id", "text")))
    lines = _rows(t).groupBy(*ROW).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line"), F.round(F.avg("top"), 1).alias("y"))
    return O.merged_readings(lines, ["dokument_id", "page"], "eingelesen_am", score=O.readability(F.col("line")))
