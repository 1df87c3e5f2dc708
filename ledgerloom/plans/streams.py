"""Incremental and event-time queries; the reference has no stream, so these are extensions on its tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerloom.plans.catalog import Catalog
from ledgerloom.session import table
from ledgerloom.streaming import incremental as N

catalog = Catalog()
query = catalog.query


def _events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st_01_tumbling", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS von, event_type, count(*) AS n, round(sum(value), 2) AS summe FROM events GROUP BY 1, 2")
def tumbling(t):
    return N.tumbling(_events(t), "ts", "1 hour").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("von"), "event_type", "n", "summe")


@query("st_02_sliding", "SELECT CAST(w AS VARCHAR) AS von, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def sliding(t):
    return N.sliding(_events(t), "ts", "2 days", "1 day").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("von"), "event_type", "n")


@query(
    "st_03_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS neu FROM events), s AS (SELECT user_id, ts, sum(neu) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sitzungen, count(*) AS ereignisse FROM s GROUP BY 1",
)
def sessions(t):
    return N.sessions(_events(t), "ts", "user_id", "30 minutes").groupBy("user_id").agg(F.count("*").alias("sitzungen"), F.sum("n").alias("ereignisse"))


def _stream_upsert(spark, sf_dir):
    """The newest row of each position key, built by an incremental run over the table's files."""
    source = f"{sf_dir}/abgleich.parquet"
    folder = source if os.path.isdir(source) else sf_dir
    store, marks = N.fresh_folder(spark, "upsert"), N.fresh_folder(spark, "marks")
    schema = table(spark, sf_dir, "abgleich").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder == source else "abgleich.parquet").parquet(folder)
    keyed = stream.withColumn("k", F.concat_ws("|", "beleg", "zielwert", "pos")).select("k", "geaendert_am", "zustand")
    keyed.writeStream.foreachBatch(N.upsert_into(store, "k", "geaendert_am")).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return N.current(spark, store, "k", "geaendert_am").select("k", "zustand")


catalog.runs["st_04_incremental_upsert"] = _stream_upsert
catalog.sql["st_04_incremental_upsert"] = "SELECT k, arg_max(zustand, (geaendert_am, zustand)) AS zustand FROM (SELECT beleg || '|' || zielwert || '|' || pos AS k, geaendert_am, zustand FROM abgleich) GROUP BY 1"
