"""Problems 4 and 5 on the issuer names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.canonical import SYNONYMS, matched
from ledgerloom.llm.variants import linked, name_pairs
from ledgerloom.session import table


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (
        table(spark, sf_dir, "position_store").select(F.col("aussteller").alias("name")),
        table(spark, sf_dir, "lohnausweis").select(F.col("arbeitgeber.value").alias("name")),
        table(spark, sf_dir, "bank_zinsausweis").select(F.col("institut.value").alias("name")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one organisation or person."""
    return name_pairs(linked(_typed_names(spark, sf_dir)))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct spelling with its group and how many spellings that has."""
    groups = linked(_typed_names(spark, sf_dir))
    sizes = groups.groupBy("entity").agg(F.count("*").alias("spellings"))
    return groups.join(sizes, "entity").select("name", "entity", "spellings")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry of each issuer name and type of the history, or -1."""
    rows = table(spark, sf_dir, "aussteller").select("entry_id", "aussteller_name", "belegtyp")
    names = matched(
        rows.select("entry_id", "aussteller_name").where("aussteller_name is not null"),
        table(spark, sf_dir, "aussteller_referenz"),
        value="aussteller_name",
        ref_id="ref_id",
        ref_names=["kanonischer_name"],
        kind="issuer",
    )
    types = matched(
        rows.select("entry_id", "belegtyp").where("belegtyp is not null"),
        table(spark, sf_dir, "belegtyp_referenz"),
        value="belegtyp",
        ref_id="ref_id",
        ref_names=["belegtyp", "bezeichnung"],
        kind="label",
        synonyms=SYNONYMS,
    )
    parts = [
        df.select("entry_id", F.lit(field).alias("feld"), F.col("ref_found").alias("ref_id"))
        for df, field in ((names, "aussteller_name"), (types, "belegtyp"))
    ]
    return parts[0].unionByName(parts[1])


def queries() -> dict:
    return {"p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found}
