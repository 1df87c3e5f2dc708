"""Sources and sinks as queries: each writes what it reads to a fresh folder of the shared one, with SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.catalog import Catalog
from ledgerloom.session import table
from ledgerloom.sources import readers as D
from ledgerloom.sources import writers as V
from ledgerloom.streaming.incremental import fresh_folder

catalog = Catalog()


def files(name: str, sql: str):
    """Registers a query of (spark, sf_dir)."""

    def register(f):
        catalog.runs[name] = f
        catalog.sql[name] = sql
        return f

    return register


@files("r1_02_word_documents", "SELECT dokument_id AS dokument, page, count(*) AS woerter, round(max(x1), 3) AS rechts FROM tagged_words WHERE text IS NOT NULL GROUP BY 1, 2")
def word_documents(spark, sf_dir):
    """Words as nested JSON documents, read back as words."""
    folder = fresh_folder(spark, "words")
    nested = D.documents_of(table(spark, sf_dir, "tagged_words"), "dokument_id", "page", "word_id")
    nested.withColumnRenamed("dokument_id", "pdf_name").write.json(folder)
    docs = spark.read.schema(D.WORD_DOCUMENT).json(folder)
    return D.words_of(docs).groupBy("dokument", "page").agg(F.count("*").alias("woerter"), F.round(F.max("x1"), 3).alias("rechts"))


@files("r1_05_listed_folders", "SELECT belegtyp AS folder, count(DISTINCT herkunft) AS ordner FROM (SELECT DISTINCT coalesce(belegtyp, 'ohne') AS belegtyp, anchor_valid AS herkunft FROM field_rows WHERE anchor_valid IS NOT NULL) WHERE belegtyp <> 'spenden' GROUP BY 1")
def listed_folders(spark, sf_dir):
    """Rows written by folder and sub-folder; one folder is left out, and what Spark hides."""
    folder = fresh_folder(spark, "tree")
    rows = table(spark, sf_dir, "field_rows").where("anchor_valid is not null").select(F.coalesce("belegtyp", F.lit("ohne")).alias("belegtyp"), "anchor_valid", "row_id")
    rows.write.partitionBy("belegtyp", "anchor_valid").parquet(folder)
    found = D.listed(spark, folder, "*.parquet", excluded=("belegtyp=spenden",))
    inner = F.element_at(F.split("path", "/"), 2)
    return found.groupBy(F.regexp_replace("folder", "^belegtyp=", "").alias("folder")).agg(F.countDistinct(inner).alias("ordner"))


@files("r1_06_same_names", "SELECT 1::BIGINT AS namen, 2 AS ordner")
def same_names(spark, sf_dir):
    """One file name in two folders."""
    folder = fresh_folder(spark, "twice")
    one = table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).coalesce(1)
    for name in ("a", "b"):
        one.write.text(f"{folder}/{name}")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("a", "b"):
        for status in fs.globStatus(jvm.Path(f"{folder}/{name}/part-*")):
            fs.rename(status.getPath(), jvm.Path(f"{folder}/{name}/beleg.txt"))
    return D.same_names(D.listed(spark, folder, "*.txt")).agg(F.count("*").alias("namen"), F.max(F.size("paths")).alias("ordner"))


@files("r1_08_results", "SELECT dokument_id AS pdf_name, count(*) AS felder, count(wert_raw) AS werte FROM field_rows GROUP BY 1")
def results(spark, sf_dir):
    """Result entries of documents with their fields, written as JSON and scanned."""
    folder = fresh_folder(spark, "results")
    field = F.struct("feld", F.col("wert_raw").alias("value"), F.col("anchor_bbox").alias("bbox"), F.col("anchor_page").alias("page"), "snippet", "anchor_valid")
    table(spark, sf_dir, "field_rows").groupBy(F.col("dokument_id").alias("pdf_name")).agg(F.collect_list(field).alias("fields")).write.json(folder)
    entries = spark.read.schema(D.RESULT_ENTRY).json(folder)
    return D.fields_of(entries).groupBy("pdf_name").agg(F.count("*").alias("felder"), F.count("value").alias("werte"))


@files("r1_10_sqlite", "SELECT zustand, count(*) AS n, sum(pos)::BIGINT AS summe FROM (SELECT * FROM abgleich WHERE zielwert = 'jahr' OR pos > 0) GROUP BY 1")
def sqlite(spark, sf_dir):
    """Reconciliation rows in an SQLite store, written by one task in chunks and read by ranges."""
    import sqlite3

    folder = fresh_folder(spark, "sqlite")
    jvm = spark._jvm.org.apache.hadoop.fs
    jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm.Path(folder))
    path = f"{folder.removeprefix('file:')}/store.db"
    rows = table(spark, sf_dir, "abgleich").where("zielwert = 'jahr' or pos > 0").select("beleg", "zielwert", "pos", "zustand")
    with sqlite3.connect(path) as store:
        store.execute("CREATE TABLE abgleich (beleg TEXT, zielwert TEXT, pos INTEGER, zustand TEXT)")
        store.executemany("INSERT INTO abgleich VALUES (?, ?, ?, ?)", (tuple(r) for r in rows.toLocalIterator()))
    read = D.sqlite_table(spark, path, "abgleich", "beleg string, zielwert string, pos bigint, zustand string")
    return read.groupBy("zustand").agg(F.count("*").alias("n"), F.sum("pos").alias("summe"))


@files("r1_13_by_bucket", "SELECT CASE WHEN anchor_valid THEN 'extracted' WHEN wert_raw IS NULL THEN 'unprocessed' ELSE 'unverified' END AS bucket, count(*) AS n FROM field_rows GROUP BY 1")
def by_bucket(spark, sf_dir):
    """Rows in three CSV folders, counted from there."""
    folder = fresh_folder(spark, "buckets")
    bucket = F.when(F.col("anchor_valid"), "extracted").when(F.col("wert_raw").isNull(), "unprocessed").otherwise("unverified")
    rows = table(spark, sf_dir, "field_rows").withColumn("bucket", bucket)
    V.by_bucket(rows, folder, {b: ["row_id", "feld", "bucket"] for b in V.BUCKETS})
    parts = [spark.read.option("header", True).csv(f"{folder}/{b}").select("bucket") for b in V.BUCKETS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("bucket").agg(F.count("*").alias("n"))


@files("r1_23_payload", "SELECT zielwert, count(DISTINCT person) AS personen FROM position_store GROUP BY 1")
def payload(spark, sf_dir):
    """Positions as one nested JSON a target, parsed again."""
    rows = table(spark, sf_dir, "position_store").groupBy("zielwert", "person", "jahr").agg(F.count("*").alias("n"))
    packed = V.payload(rows, ["zielwert", "person"], ["jahr", "n"])
    parsed = F.from_json("json", "zielwert string, werte array<struct<person: string, werte: array<struct<jahr: string, n: bigint>>>>")
    return packed.select("zielwert", F.size(parsed["werte"]).cast("bigint").alias("personen"))


@files("r1_24_statement", "SELECT aussteller, sum((zielwert = 'vermoegensstand_3112')::INT)::INT AS n_konten, sum((zielwert = 'schuldsaldo_3112')::INT)::INT AS n_schulden FROM position_store WHERE zielwert IN ('vermoegensstand_3112', 'schuldsaldo_3112') GROUP BY 1")
def statement(spark, sf_dir):
    """Issuers with their accounts and debts, nested."""
    kind = F.when(F.col("zielwert") == "vermoegensstand_3112", "konto").otherwise("schuld")
    rows = table(spark, sf_dir, "position_store").where("zielwert in ('vermoegensstand_3112', 'schuldsaldo_3112')").withColumn("kind", kind)
    return V.statement(rows, "aussteller", "kind", "unterscheidung", "betrag").select("aussteller", "n_konten", "n_schulden")


@files("r1_26_run_log", "SELECT substr(sha256(dokument_id), 1, 12) AS hash, belegtyp, count(*) AS n FROM field_rows GROUP BY 1, 2")
def run_log(spark, sf_dir):
    """Events with a hash in place of the document, appended and read back."""
    folder = fresh_folder(spark, "log")
    rows = table(spark, sf_dir, "field_rows")
    for part in (0, 1):
        V.run_log(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(2)) == part), folder, "dokument_id", ["belegtyp"])
    return spark.read.schema("hash string, belegtyp string").json(folder).groupBy("hash", "belegtyp").agg(F.count("*").alias("n"))


@files("r1_27_snapshots", "SELECT coalesce(a.feld, b.feld) AS feld, coalesce(a.n, 0) AS vorher, coalesce(b.n, 0) AS nachher FROM (SELECT feld, count(*) AS n FROM field_rows GROUP BY 1) a FULL OUTER JOIN (SELECT feld, count(*) AS n FROM field_rows_kopie GROUP BY 1) b USING (feld) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def snapshots(spark, sf_dir):
    """Two snapshots and the keys whose numbers of rows differ between them."""
    folder = fresh_folder(spark, "snapshots")
    for stamp, name in (("1", "field_rows"), ("2", "field_rows_kopie")):
        V.snapshot(table(spark, sf_dir, name).select("dokument_id", "feld"), folder, stamp)
    return V.snapshots_compared(*[spark.read.parquet(f"{folder}/snapshot={s}") for s in (1, 2)], ["feld"])
