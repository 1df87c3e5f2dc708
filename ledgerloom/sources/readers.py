"""Sources: word documents, result files, folders, rule files and electronic statements."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_DOCUMENT = """pdf_name STRING, ordner STRING, belegtyp STRING, pdf_inhalt STRING, pdf_groesse BIGINT, einlese_stand STRING,
pages ARRAY<STRUCT<page_num: INT, width: DOUBLE, height: DOUBLE, words: ARRAY<STRUCT<text: STRING, x0: DOUBLE, top: DOUBLE, x1: DOUBLE, bottom: DOUBLE>>>>"""
RESULT_ENTRY = """pdf_name STRING, ordner STRING, status STRING, belegtyp STRING, text_truncated BOOLEAN,
fields ARRAY<STRUCT<feld: STRING, value: STRING, bbox: ARRAY<DOUBLE>, page: INT, snippet: STRING, anchor_valid: BOOLEAN, herkunft: STRING>>"""


def word_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of pages of words; files that are no JSON give a row of nulls, not an error."""
    return spark.read.schema(WORD_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def words_of(documents: DataFrame, document: str = "pdf_name") -> DataFrame:
    """One row a word in reading order: dokument, page, word_no and box."""
    pages = documents.select(F.col(document).alias("dokument"), F.explode("pages").alias("p"))
    words = pages.select("dokument", F.col("p.page_num").alias("page"), F.posexplode("p.words").alias("word_no", "w"))
    return words.select("dokument", "page", "word_no", "w.text", "w.x0", "w.top", "w.x1", "w.bottom").where("text is not null")


def documents_of(words: DataFrame, document: str, page: str, order: str) -> DataFrame:
    """The nested form again: pages of words of each document."""
    box = F.struct(F.col(order).alias("o"), "text", "x0", "top", "x1", "bottom")
    pages = words.groupBy(document, page).agg(F.sort_array(F.collect_list(box)).alias("ws"))
    plain = F.transform("ws", lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["top"].alias("top"), w["x1"].alias("x1"), w["bottom"].alias("bottom")))
    return pages.groupBy(document).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page_num"), plain.alias("words")))).alias("pages"))


def unreadable(documents: DataFrame) -> DataFrame:
    """Documents in which no word was found."""
    n = F.aggregate(F.coalesce("pages", F.array()), F.lit(0), lambda acc, p: acc + F.size(F.coalesce(p["words"], F.array())))
    return documents.where(n == 0).select("pdf_name", F.lit("ocr_failed").alias("status"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result entries; a missing or broken file yields no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], RESULT_ENTRY)
    return spark.read.schema(RESULT_ENTRY).option("multiLine", True).json(path).where("pdf_name is not null")


def fields_of(entries: DataFrame) -> DataFrame:
    """One row a field of each entry."""
    return entries.select("pdf_name", "belegtyp", "status", F.inline("fields"))


def listed(spark: SparkSession, root: str, pattern: str = "*", excluded: tuple[str, ...] = ("irrelevant",)) -> DataFrame:
    """(path, name, folder, size) of the files below ``root``, hidden ones and excluded folders left out.

    Only names and sizes are read: the content column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inside = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(str(Path(root))) + 2, 10_000)
    parts = F.split(inside, "/")
    rows = files.select(inside.alias("path"), F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("folder"), F.col("length").alias("size"))
    return rows.where(~F.col("path").rlike("(^|/)[.]")).where(~F.col("folder").isin(*excluded))


def same_names(files: DataFrame) -> DataFrame:
    """Names that occur in several folders."""
    return files.groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def one_file(files: DataFrame, name: str) -> DataFrame:
    """The first path with a name."""
    return files.where(F.col("name") == name).orderBy(F.lower("path")).limit(1)


def dimension(spark: SparkSession, path: str, schema: str, most: int = 100_000) -> DataFrame:
    """A small rule table from JSON, or YAML where a reader for it is installed; fails on too many rows or bad ones."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML reader is installed; give the file as JSON") from e
        rows = yaml.safe_load(text)
    else:
        rows = json.loads(text)
    if not isinstance(rows, list) or len(rows) > most:
        raise ValueError(f"{path}: a list of at most {most} rows is expected")
    return spark.createDataFrame(rows, schema)


STATEMENT = "bank STRUCT<name: STRING>, account ARRAY<STRUCT<iban: STRING, currency: STRING, balance: DECIMAL(18,2), interest: DECIMAL(18,2)>>"


def statement_accounts(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """Accounts of electronic statements given as XML text; a broken text yields none."""
    parsed = texts.select("*", F.from_xml(xml, STATEMENT).alias("s"))
    return parsed.select(*[c for c in texts.columns if c != xml], F.col("s.bank.name").alias("bank"), F.inline("s.account"))


def stamp(*cols: Column) -> Column:
    """A content stamp: equal for equal contents."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]), 256))


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can reach, read by ranges of its row numbers; columns that an older
    file lacks are NULL. An unknown table is an error when the plan is made."""
    import sqlite3

    if not name.isidentifier():
        raise ValueError(f"{name!r} is no table name")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as store:
        low, high = store.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {name}").fetchone()
        held = {r[1] for r in store.execute(f"PRAGMA table_info({name})")}
    target = spark.createDataFrame([], schema).schema
    columns = [c if c in held else f"NULL AS {c}" for c in target.names]
    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.createDataFrame([(a, min(a + step, high + 1)) for a in range(low, high + 1, step)], "a bigint, b bigint").repartition(parts, "a")

    def read(batches):
        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as store:
            for batch in batches:
                for a, b in zip(batch["a"], batch["b"]):
                    for chunk in pd.read_sql_query(f"SELECT {', '.join(columns)} FROM {name} WHERE rowid >= ? AND rowid < ?", store, params=(int(a), int(b)), chunksize=10_000):
                        yield chunk

    return ranges.mapInPandas(read, target)
