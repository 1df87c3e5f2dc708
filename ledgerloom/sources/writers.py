"""Sinks: CSV by bucket, text tables, nested payloads, snapshots and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("extracted", "unverified", "unprocessed")


def by_bucket(rows: DataFrame, path: str, columns: dict[str, Sequence[str]], bucket: str = "bucket") -> None:
    """A CSV folder a bucket, each with its columns and a header even when it has no rows; errors cut to 500 characters."""
    for name, cols in columns.items():
        part = rows.where(F.col(bucket) == name).select(*[F.substring(c, 1, 500).alias(c) if c == "error" else F.col(c) for c in cols])
        if part.isEmpty():
            part = rows.sparkSession.createDataFrame([tuple(cols)], ", ".join(f"`{c}` string" for c in cols)).coalesce(1)
            part.write.mode("overwrite").option("header", False).csv(f"{path}/{name}")
        else:
            part.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def ordered_csv(rows: DataFrame, path: str, first: Column, then: Sequence[str]) -> None:
    """A CSV folder in order: rows for which ``first`` holds before the others. An older one is kept under a new name."""
    keep_old(rows, path)
    rows.orderBy(F.when(first, 0).otherwise(1), *then).write.option("header", True).csv(path)


def keep_old(rows: DataFrame, path: str) -> str | None:
    """Moves what is at ``path`` to the next free ``path.bak-n``; nothing is ever overwritten."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    n = 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.bak-{n}")):
        n += 1
    fs.rename(at, jvm.org.apache.hadoop.fs.Path(f"{path}.bak-{n}"))
    return f"{path}.bak-{n}"


def text_table(rows: DataFrame, columns: Sequence[str], most: int = 10_000) -> str:
    """Rows as a text table; a report for people, so it refuses more than ``most`` rows instead of cutting them."""
    got = rows.select(*[F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), "[\\r\\n]+", " "), F.lit("")).alias(c) for c in columns]).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write them to a table instead")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in got])


def payload(rows: DataFrame, levels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One JSON a value of the first level, the others nested in it."""
    inner = rows.groupBy(*levels).agg(F.array_sort(F.collect_list(F.struct(*values))).alias("werte"))
    for depth in range(len(levels) - 1, 0, -1):
        inner = inner.groupBy(*levels[:depth]).agg(F.array_sort(F.collect_list(F.struct(levels[depth], "werte"))).alias("werte"))
    return inner.select(levels[0], F.to_json(F.struct(levels[0], "werte")).alias("json"))


def statement(rows: DataFrame, institute: str, kind: str, number: str, amount: str) -> DataFrame:
    """Institutes with their accounts and debts, nested, and how many of each there are."""
    item = F.struct(F.col(number).alias("nummer"), F.col(amount).alias("betrag"))
    of = lambda k: F.array_sort(F.array_compact(F.collect_list(F.when(F.col(kind) == k, item))))
    return rows.groupBy(institute).agg(of("konto").alias("konten"), of("schuld").alias("schulden")).select("*", F.size("konten").alias("n_konten"), F.size("schulden").alias("n_schulden"))


def snapshot(rows: DataFrame, path: str, stamp: str) -> str:
    """A snapshot under its own name; an existing one is an error, never overwritten."""
    to = f"{path}/snapshot={stamp}"
    rows.write.mode("errorifexists").parquet(to)
    return to


def snapshots_compared(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose number of rows differs between two snapshots."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    j = n(before, "vorher").join(n(after, "nachher"), list(keys), "full_outer")
    return j.select(*keys, F.coalesce("vorher", F.lit(0)).alias("vorher"), F.coalesce("nachher", F.lit(0)).alias("nachher")).where("vorher <> nachher")


def run_log(rows: DataFrame, path: str, content: str, columns: Sequence[str]) -> None:
    """Appends events as JSON lines with a hash in place of the content."""
    rows.select(F.substring(F.sha2(F.col(content).cast("string"), 256), 1, 12).alias("hash"), *columns).write.mode("append").json(path)


def replace_json(rows: DataFrame, path: str) -> None:
    """JSON lines written beside ``path`` and then put in its place; what was there is kept as ``path.bak``, so a reader
    finds the old or the new content, never half of it."""
    spark = rows.sparkSession
    new, old = f"{path}.new", f"{path}.bak"
    rows.write.mode("overwrite").json(new)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path_of(path)):
        fs.delete(path_of(old), True)
        fs.rename(path_of(path), path_of(old))
    fs.rename(path_of(new), path_of(path))


def snapshots(spark, path: str) -> DataFrame:
    """(snapshot, rows, bytes) of the snapshots below a folder, oldest first."""
    rows = spark.read.parquet(path).groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.select(F.regexp_extract("path", "snapshot=([^/]+)/", 1).alias("snapshot"), "length").groupBy("snapshot").agg(F.sum("length").alias("bytes"))
    return rows.join(sizes, "snapshot").orderBy("snapshot")


def ledger_csv(rows: DataFrame, path: str, columns: Sequence[str], amount: str) -> None:
    """The ledger as CSV with its columns in order, without rows whose amount is missing or zero; an older one is kept."""
    keep_old(rows, path)
    rows.where(F.coalesce(F.col(amount).try_cast("double"), F.lit(0.0)) != 0).select(*columns).orderBy(*columns).write.option("header", True).csv(path)


def ledger_lines(rows: DataFrame, form: str, line: str, label: str, amount: str) -> DataFrame:
    """(form, line, rang, text): the ledger as lines of a text table: rows, then the subtotal of each line, then that of
    the form. Ordered by form, line and rang; aggregated and rendered on the executors."""
    from ledgerloom.functions.amounts import shown_amount

    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), "[\\r\\n]+", " "), F.lit(""))
    b = F.col(amount).cast("decimal(18,2)")
    each = rows.select(F.col(form).alias("form"), F.col(line).alias("line"), F.lit(0).alias("rang"), F.concat(F.lit("| "), cell(F.col(line)), F.lit(" | "), cell(F.col(label)), F.lit(" | "), F.coalesce(shown_amount(b), F.lit("")), F.lit(" |")).alias("text"))
    sums = rows.groupBy(F.col(form).alias("form"), F.col(line).alias("line")).agg(F.sum(b).alias("s"))
    lines = sums.select("form", "line", F.lit(1).alias("rang"), F.concat(F.lit("| "), cell(F.col("line")), F.lit(" | **Zwischentotal** | "), F.coalesce(shown_amount(F.col("s")), F.lit("")), F.lit(" |")).alias("text"))
    whole = sums.groupBy("form").agg(F.sum("s").alias("s")).select("form", F.lit(None).cast("string").alias("line"), F.lit(2).alias("rang"), F.concat(F.lit("| | **Total** | "), F.coalesce(shown_amount(F.col("s")), F.lit("")), F.lit(" |")).alias("text"))
    return each.unionByName(lines).unionByName(whole)


def text_report(lines: DataFrame, order: Sequence[str], path: str) -> None:
    """Lines of a report as text files in order."""
    lines.orderBy(*order).select("text").write.mode("overwrite").text(path)
