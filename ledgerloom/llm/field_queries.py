"""Problems 1 and 3 on the words and fields of receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.lookalikes import repaired
from ledgerloom.llm.pii import PLACEHOLDERS, accepted, endings, gazetteer, redacted, text_candidates, word_candidates
from ledgerloom.session import cut, table

_FIELDS = (("tagged_words", "text", "word_id"), ("field_rows", "wert_raw", "row_id"), ("position_store", "amount", "id"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(F.lit(name).alias("tabelle"), F.col(key).cast("string").alias("schluessel"), F.col(text).alias("text"))
        for name, text, key in _FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text differs from its consistent form."""
    return repaired(_printed(spark, sf_dir)).select("tabelle", "schluessel")


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of each text that has another one."""
    return repaired(_printed(spark, sf_dir)).select("tabelle", "schluessel", "konsistent")


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = table(spark, sf_dir, "family")
    texts = table(spark, sf_dir, "tagged_words").select("text").unionByName(table(spark, sf_dir, "field_rows").select(F.col("snippet").alias("text")))
    names = [gazetteer(family, c, texts=texts) for c in ("first_name", "last_name")]
    held = spark.sparkContext.broadcast((*names, endings(family, "last_name")))
    words = word_candidates(
        table(spark, sf_dir, "tagged_words"),
        "tagged_words",
        held,
        key="word_id",
        document="dokument_id",
        reading="eingelesen_am",
        order="tag_id",
        page="page",
        top="top",
        text="text",
    )
    snippets = text_candidates(table(spark, sf_dir, "field_rows"), "field_rows", "row_id", "snippet", held)
    return cut(words.unionByName(snippets))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are or belong to personal data, and the kinds that occur in each snippet."""
    return accepted(_personal(spark, sf_dir)).select("tabelle", "schluessel", "art").distinct()


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and snippets with personal data replaced by typed placeholders; each word stands for itself."""
    found = cut(accepted(_personal(spark, sf_dir)))
    snippets = redacted(table(spark, sf_dir, "field_rows"), found, "field_rows", "row_id", "snippet")
    kinds = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    words = found.where("tabelle = 'tagged_words'").groupBy("schluessel").agg(F.min("art").alias("art"))
    parts = snippets.select(F.lit("field_rows").alias("tabelle"), "schluessel", "redigiert")
    return parts.unionByName(words.select(F.lit("tagged_words").alias("tabelle"), "schluessel", kinds[F.col("art")].alias("redigiert")))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_texts": p3_texts, "p1_found": p1_found, "p1_texts": p1_texts}
