"""Redaction of plain text tables with the same rules as events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.masking import mask_emails, mask_rules, sanitize_by_rules
from veilspan.functions.predicates import is_sensitive_key


def mask_text(df: DataFrame, column: str, expressions: Sequence[str] = ()) -> DataFrame:
    """Replace a text column by its masked form; whole texts, no bound."""
    return df.withColumn(column, mask_rules(mask_emails(column), expressions))


def sanitize_attributes(df: DataFrame, expressions: Sequence[str] = (),
                        policy_version: str = "") -> DataFrame:
    """Replace ``attributes`` by its masked form and add the receipt as ``policy``."""
    clean = sanitize_by_rules("attributes", expressions, F.lit(policy_version))
    return (df.withColumn("_s", clean).withColumn("attributes", F.col("_s.attributes"))
            .withColumn("policy", F.col("_s.policy")).drop("_s"))


def sensitive_keys(df: DataFrame) -> DataFrame:
    """How often each attribute key occurs, and whether it is sensitive."""
    return (df.select(F.explode(F.map_keys("attributes")).alias("attr_key"))
            .groupBy("attr_key").agg(F.count(F.lit(1)).alias("occurrences"))
            .withColumn("sensitive", is_sensitive_key("attr_key")))
