"""Problem 2: the domain tables against their copies in the second system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.copydiff import Field, Pair, diff_pairs
from ledgerloom.session import table


def _key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def _field_rows() -> tuple:
    return ["dokument_id", "feld"], [
        Field("wert_decimal", F.col("wert_decimal"), "amount"),
        Field("konfidenz", F.col("konfidenz"), "number", 0.001),
        Field("anchor_page", F.col("anchor_page")),
    ]


def _lohnausweis() -> tuple:
    return ["dokument_id"], [
        Field("bruttolohn_pos8.value", F.col("bruttolohn_pos8.value"), "amount"),
        Field("nettolohn_pos11.value", F.col("nettolohn_pos11.value"), "amount"),
    ]


def _abgleich() -> tuple:
    return ["beleg", "zielwert", "pos"], [Field("zustand", F.col("zustand"), "token"), Field("grund", F.col("grund"), "token")]


PAIRS = {"field_rows": _field_rows, "lohnausweis": _lohnausweis, "abgleich": _abgleich}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows missing on either side and fields that differ, for the three copied tables."""
    pairs, at = [], F.col("geaendert_am")
    for name, spec in PAIRS.items():
        keys, fields = spec()
        pairs.append(Pair(name, table(spark, sf_dir, name), table(spark, sf_dir, f"{name}_kopie"), _key(*keys), _key(*keys), fields, fields, at, at))
    return diff_pairs(pairs)


def _sql_amount(c: str) -> str:
    """The compared form of an amount in SQL, as ``amount_cents`` defines it."""
    s = f"translate({c}, '０１２３４５６７８９，．－＋‐‑−', '0123456789,.-+---')"
    for start in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        s = f"translate({s}, '{''.join(chr(start + i) for i in range(10))}', '0123456789')"
    s = f"regexp_replace({s}, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200D}}\\x{{202F}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g')"
    s = f"regexp_replace({s}, '[''\\x{{2018}}\\x{{2019}}\\x{{02BC}}\\x{{2032}}\\x{{FF07}}`\\x{{00B4}}]', '', 'g')"
    s = f"regexp_replace({s}, '(?i)^([+-]?)(?:CHF|SFr\\.?|Fr\\.?|EUR|USD)([+-]?)', '\\1\\2')"
    s = f"regexp_replace({s}, '(\\d)[.,]?[-–—]{{1,2}}$', '\\1')"
    s = f"regexp_replace({s}, '^([+-]?\\d*),(\\d{{1,2}})$', '\\1.\\2')"
    n = f"round(try_cast({s} AS DECIMAL(32,6)), 2)"
    return f"coalesce(CAST(CASE WHEN {n} = 0 THEN 0 ELSE {n} END AS VARCHAR), CASE WHEN trim({c}) <> '' THEN 't:' || lower(trim({c})) END)"


def _sql_token(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c})), '[ _]+', '_', 'g'), '')"


def _sql_part(name: str, key: str, fields: dict[str, tuple[str, str]]) -> str:
    """One pair of tables; fields: reported name -> (value, test that two values a and b differ)."""
    cols = ", ".join(f"{v} AS f{i}" for i, (v, _) in enumerate(fields.values()))
    side = "SELECT * FROM (SELECT {key} AS k, {cols}, row_number() OVER (PARTITION BY {key} ORDER BY geaendert_am DESC) AS rn FROM {t}) WHERE rn = 1"
    a, b = (side.format(key=key, cols=cols, t=t) for t in (name, f"{name}_kopie"))
    both = f"(SELECT a.k AS ka, b.k AS kb, {', '.join(f'a.f{i} AS a{i}, b.f{i} AS b{i}' for i in range(len(fields)))} FROM ({a}) a FULL OUTER JOIN ({b}) b ON a.k = b.k)"
    out = [f"SELECT '{name}' AS tabelle, coalesce(ka, kb) AS schluessel, '' AS spalte, CASE WHEN kb IS NULL THEN 'nur_original' ELSE 'nur_kopie' END AS art FROM {both} WHERE ka IS NULL OR kb IS NULL"]
    for i, (label, (_, differs)) in enumerate(fields.items()):
        test = differs.format(a=f"a{i}", b=f"b{i}")
        out.append(f"SELECT '{name}', ka, '{label}', 'weicht_ab' FROM {both} WHERE ka IS NOT NULL AND kb IS NOT NULL AND ({test})")
    return " UNION ALL ".join(out)


def oracle_sql() -> dict[str, str]:
    plain = "{a} IS DISTINCT FROM {b}"
    number = "({a} IS NULL) <> ({b} IS NULL) OR coalesce(round(abs({a} - {b}), 9) > 0.001, false)"
    parts = [
        _sql_part(
            "field_rows",
            "dokument_id || '|' || feld",
            {"wert_decimal": (_sql_amount("wert_decimal"), plain), "konfidenz": ("konfidenz", number), "anchor_page": ("anchor_page", plain)},
        ),
        _sql_part(
            "lohnausweis",
            "dokument_id",
            {f"{c}.value": (_sql_amount(f"{c}.value"), plain) for c in ("bruttolohn_pos8", "nettolohn_pos11")},
        ),
        _sql_part(
            "abgleich",
            "beleg || '|' || zielwert || '|' || pos",
            {c: (_sql_token(c), plain) for c in ("zustand", "grund")},
        ),
    ]
    return {"p2_found": " UNION ALL ".join(parts)}


def queries() -> dict:
    return {"p2_found": p2_found}
