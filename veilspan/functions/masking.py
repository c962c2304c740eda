"""Masking of text values and attribute bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.dialect import EMAIL, to_jvm
from veilspan.functions.predicates import is_sensitive_key
from veilspan.functions.values import ColumnLike, col, let, reuse, text

# Replacement marks and the version used when none is set.  Fixed values.
REDACTED = "[REDACTED]"
REDACTED_EMAIL = "[REDACTED_EMAIL]"
REDACTED_PATTERN = "[REDACTED_PATTERN]"
DEFAULT_POLICY_VERSION = "v1"


def mask_emails(value: ColumnLike) -> Column:
    """Values without an ``@`` skip the regex."""
    v = col(value)
    return F.when(v.contains("@"), F.regexp_replace(v, EMAIL, REDACTED_EMAIL)).otherwise(v)


def jvm_patterns(expressions: Sequence[str]) -> Column:
    """Deployment-wide rules, as a literal array of JVM patterns."""
    if not expressions:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(to_jvm(expression)) for expression in expressions])


def mask_rules(value: ColumnLike, expressions: Sequence[str]) -> Column:
    """Apply rules that are known beforehand, in order; each is a literal that the JVM compiles once."""
    masked = col(value)
    for expression in expressions:
        masked = F.regexp_replace(masked, F.lit(to_jvm(expression)), F.lit(REDACTED_PATTERN))
    return masked


def _hit(before: Column, after: Column, pattern: Column) -> Column:
    """Whether the pattern matched.  Only a match of the mark itself leaves the text equal."""
    return ((before != after)
            | F.when(before.contains(REDACTED_PATTERN), F.rlike(before, pattern))
            .otherwise(F.lit(False)))


@reuse
def sanitize(attributes: ColumnLike, patterns: ColumnLike, policy_version: ColumnLike) -> Column:
    """``struct<attributes, policy>``: the masked bag and the receipt of what was changed.

    A sensitive key hides its whole value; any other value loses e-mail addresses, then every
    pattern match, in order.  The receipt lists paths only.
    """
    # Pattern-major order: each JVM pattern is compiled once per row, not once per value.
    return _receipted(F.aggregate(col(patterns), _entries(attributes), _applied), policy_version)


def sanitize_by_rules(attributes: ColumnLike, expressions: Sequence[str], policy_version: ColumnLike) -> Column:
    """As :func:`sanitize`, for rules that are known beforehand; each is a literal that the JVM compiles once."""
    done = _entries(attributes)
    for expression in expressions:
        done = _applied(done, F.lit(to_jvm(expression)))
    return _receipted(done, policy_version)


def _applied(entries: Column, pattern: Column) -> Column:
    return F.transform(entries, lambda e: _apply_pattern(e, pattern))


def _entries(attributes: ColumnLike) -> Column:
    """The bag's entries with sensitive values hidden and e-mail addresses masked."""
    return F.transform(
        F.map_entries(F.coalesce(col(attributes), F.create_map().cast("map<string,string>"))),
        lambda e: _masked_entry(e["key"], text(e["value"])))


def _receipted(entries: Column, policy_version: ColumnLike) -> Column:
    version = F.when(text(policy_version) == "", F.lit(DEFAULT_POLICY_VERSION)).otherwise(
        col(policy_version))

    # Bound as one value: both parts of the result read it, and it must not be computed twice.
    def result(done: Column) -> Column:
        bag = F.map_from_entries(F.transform(done, lambda e: F.struct(e["k"], e["v"])))
        changed = F.transform(F.filter(done, lambda e: e["hit"]),
                              lambda e: F.concat(F.lit("attributes."), e["k"]))
        return F.struct(bag.alias("attributes"),
                        F.struct(version.alias("policyVersion"),
                                 F.array_sort(changed).alias("redactedPaths")).alias("policy"))

    return let(entries, result)


def _masked_entry(key: Column, value: Column) -> Column:
    def entry(sensitive: Column, masked: Column) -> Column:
        return F.struct(key.alias("k"), masked.alias("v"),
                        (sensitive | (masked != value)).alias("hit"),
                        sensitive.alias("sensitive"))

    return let(is_sensitive_key(key), lambda sensitive: let(
        F.when(sensitive, F.lit(REDACTED)).otherwise(mask_emails(value)),
        lambda masked: entry(sensitive, masked)))


def _apply_pattern(entry: Column, pattern: Column) -> Column:
    def changed(replaced: Column) -> Column:
        return F.struct(entry["k"].alias("k"), replaced.alias("v"),
                        (entry["hit"] | _hit(entry["v"], replaced, pattern)).alias("hit"),
                        entry["sensitive"].alias("sensitive"))

    return F.when(entry["sensitive"], entry).otherwise(
        let(F.regexp_replace(entry["v"], pattern, F.lit(REDACTED_PATTERN)), changed))
