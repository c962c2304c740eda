"""Tenant keys and versioned redaction policies."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.dialect import Refused, to_jvm
from veilspan.functions.masking import jvm_patterns
from veilspan.functions.predicates import MAX_EXPRESSION_BYTES
from veilspan.functions.values import as_ts


def resolve_tenants(requests: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Add ``tenant_id`` by key digest; NULL when no enabled key matches.

    The key table is left without a hint: Spark broadcasts it while it is below the size
    threshold, and beyond that a hot key is split by AQE.
    """
    enabled = api_keys.filter(F.col("disabled_at").isNull()).select("key_hash", "tenant_id")
    return requests.join(enabled, "key_hash", "left")


def register_tenant_keys(tenants: DataFrame, api_keys: DataFrame, new: DataFrame,
                         as_of) -> tuple[DataFrame, DataFrame]:
    """Tenants and keys after adding ``new(tenant_id, key_hash)``; known ones are left alone.

    ``new`` carries digests, never raw keys.
    """
    at = as_ts(as_of)
    added = (new.select(F.col("tenant_id").alias("id")).distinct()
             .join(tenants, "id", "left_anti").withColumn("created_at", at))
    keys = (new.groupBy("key_hash").agg(F.min("tenant_id").alias("tenant_id"))
            .join(api_keys, "key_hash", "left_anti")
            .select("tenant_id", "key_hash", F.lit(None).cast("timestamp").alias("disabled_at"),
                    at.alias("created_at")))
    return tenants.unionByName(added), api_keys.unionByName(keys)


@F.pandas_udf(T.StringType())
def _jvm_pattern(expressions: pd.Series) -> pd.Series:
    def restate(expression):
        try:
            return to_jvm(expression)
        except Refused:
            return None

    return expressions.map(restate)


def valid_policy_expression(expression: Column) -> Column:
    """1..512 bytes, and a rule that has an exact JVM form."""
    return (F.octet_length(expression).between(1, MAX_EXPRESSION_BYTES)
            & _jvm_pattern(expression).isNotNull())


def active_policies(policies: DataFrame) -> DataFrame:
    """Per tenant the newest version with its expressions in order.

    Aggregated per version first, so the second step sees one row per version.
    """
    checked = policies.select(
        "tenant_id", "version", "expression", "created_at",
        F.when(F.octet_length("expression").between(1, MAX_EXPRESSION_BYTES),
               _jvm_pattern("expression")).alias("pattern"))
    versions = checked.groupBy("tenant_id", "version").agg(
        F.max("created_at").alias("newest"),
        F.array_sort(F.collect_set(F.struct("expression", "pattern"))).alias("rules"))
    newest = versions.groupBy("tenant_id").agg(
        F.max_by(F.struct("version", "rules"), F.struct("newest", "version")).alias("p"))
    rules = F.col("p.rules")
    return newest.select(
        "tenant_id", F.col("p.version").alias("policy_version"),
        F.transform(rules, lambda r: r["expression"]).alias("expressions"),
        F.transform(rules, lambda r: r["pattern"]).alias("patterns"),
        ((F.col("p.version") != "") & F.forall(rules, lambda r: r["pattern"].isNotNull()))
        .alias("policy_ok"))


def attach_policy(events: DataFrame, active: DataFrame, deploy_version: str = "",
                  deploy_expressions: Sequence[str] = ()) -> DataFrame:
    """Add ``policy_version``, ``patterns`` (deployment rules first) and ``policy_ok``.

    A tenant without a policy falls back to the deployment rules.  When a rule is refused,
    ``policy_ok`` is false and the request must be refused.
    """
    deploy = jvm_patterns(deploy_expressions)
    own = active.select("tenant_id", "policy_version", F.col("patterns").alias("own"), "policy_ok")
    none = F.array().cast("array<string>")
    usable = F.when(F.col("policy_ok"), F.col("own"))
    return (events.join(own, "tenant_id", "left")
            .withColumn("patterns", F.concat(deploy, F.coalesce(usable, none)))
            .withColumn("policy_version",
                        F.coalesce("policy_version", F.lit(deploy_version)))
            .withColumn("policy_ok", F.coalesce("policy_ok", F.lit(True)))
            .drop("own"))
