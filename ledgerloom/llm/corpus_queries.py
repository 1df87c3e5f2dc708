"""Problems 6 and 7 on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.leaks import leaked
from ledgerloom.llm.tokenids import token_ids
from ledgerloom.session import table

#: The folder of the public vocabularies; pass another to use it elsewhere.
TOKENIZERS = "/opt/tokenizers"


def p6_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The token ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry passages of test items."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def queries() -> dict:
    return {"p6_ids": p6_ids, "p7_found": p7_found}
