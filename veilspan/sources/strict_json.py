"""Strict decoding of request bodies.

A body must be one JSON document of the route's fixed shape: no unknown field, no value of
another type, nothing after the document.  ``from_json`` alone is lenient on all three.

Most bodies are proven strict inside the JVM: the body is parsed to a variant and the type
text of that variant is matched against a pattern derived from the schema.  Only bodies that
this test cannot prove (repeated or differently cased field names, escaped surrogates, floats
in exponent form, bad input) go to Arrow batches in Python, which decide them exactly and
return the document in normal form.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan import schemas
from veilspan.functions.predicates import (EVENT_ROUTE, LOGS_ROUTE, TRACES_ROUTE,
                                           body_within_limit)
from veilspan.functions.values import let, reuse

ROUTE_SCHEMAS = {TRACES_ROUTE: schemas.OTLP_TRACES, LOGS_ROUTE: schemas.OTLP_LOGS,
                 EVENT_ROUTE: schemas.EVENT}

_SEAL = "z"  # the member that follows the body in the wrapping document


def _type_pattern(kind: T.DataType) -> str:
    """The type texts a strict document of this schema can have; a JSON null is VOID."""
    if isinstance(kind, T.StructType):
        members = "|".join(f"{f.name}: {_type_pattern(f.dataType)}" for f in kind)
        return rf"(?:VOID|OBJECT<(?:(?:{members})(?:, |(?=>)))*+>)"
    if isinstance(kind, T.ArrayType):
        return rf"(?:VOID|ARRAY<{_type_pattern(kind.elementType)}>)"
    if isinstance(kind, T.MapType):
        name = r"(?:[A-Za-z0-9_]+|`(?:[^`]|``)+`)"
        return rf"(?:VOID|OBJECT<(?:{name}: {_type_pattern(kind.valueType)}(?:, |(?=>)))*+>)"
    if isinstance(kind, T.BooleanType):
        return "(?:VOID|BOOLEAN)"
    if isinstance(kind, T.DoubleType):
        return r"(?:VOID|BIGINT|DECIMAL\([0-9]+,[0-9]+\))"
    return "(?:VOID|STRING)"


@reuse
def _proven_strict(body_column: str, route_column: str) -> Column:
    body, route = F.col(body_column), F.col(route_column)
    # The body is placed inside a larger document and sealed with its own digest, so text that
    # closes the document early cannot also supply the rest of it.
    seal = F.sha2(body, 256)
    sealed = F.concat(F.lit('{"a":'), body, F.lit(f',"{_SEAL}":"'), seal, F.lit('"}'))

    def fits(doc: Column) -> Column:
        shape = F.schema_of_variant(doc)
        of_route = F.lit(False)
        for path, schema in ROUTE_SCHEMAS.items():
            pattern = rf"\AOBJECT<a: {_type_pattern(schema)}, {_SEAL}: STRING>\z"
            of_route = F.when(route == path, shape.rlike(pattern)).otherwise(of_route)
        return of_route & (F.try_variant_get(doc, f"$.{_SEAL}", "string") == seal)

    plain = ~body.rlike(r"\\u[dD][89a-fA-F]")
    return F.coalesce(plain & let(F.try_parse_json(sealed), fits), F.lit(False))


def with_canonical_body(requests: DataFrame, name: str = "doc") -> DataFrame:
    """Add the document text where ``body`` is strict and within the size bound, else NULL."""
    fits = body_within_limit("body")
    # The proof is a column of its own, so that it is computed once for both uses.
    proven = requests.withColumn("_proven", F.when(
        fits, _proven_strict("body", "route")))
    rest = _decode_strict(F.when(~F.col("_proven"), F.col("body")), F.col("route"))
    return proven.withColumn(name, F.when(F.col("_proven"), F.col("body")).otherwise(
        rest)).drop("_proven")


def strict_json_ok(requests: DataFrame) -> DataFrame:
    """Add ``strict_ok`` to requests with ``route`` and ``body``."""
    return (with_canonical_body(requests).withColumn("strict_ok", F.col("doc").isNotNull())
            .drop("doc"))


@F.pandas_udf(T.StringType())
def _decode_strict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for bodies, routes in batches:
        yield pd.Series([None if body is None else normal_form(body, ROUTE_SCHEMAS.get(route))
                         for body, route in zip(bodies, routes)], dtype=object)


# --- per-document helper ----------------------------------------------------------------
class _Bad(ValueError):
    pass


class _Members(list):
    """An object's members in document order, repeats included."""


_BLANKS = " \t\r\n"
_SURROGATE = re.compile("[\ud800-\udfff]")


def _no_constant(name: str):
    raise _Bad(name)


def _number(raw: str) -> float:
    value = float(raw)
    if math.isinf(value):
        raise _Bad(raw)
    return value


def normal_form(body: str, schema: T.DataType | None) -> str | None:
    """The document with exact field names and no repeats, or None when it is not strict."""
    if schema is None:
        return None
    try:
        value = json.loads(body.strip(_BLANKS), object_pairs_hook=_Members,
                           parse_constant=_no_constant, parse_float=_number, parse_int=_number)
        return json.dumps(_fit(value, schema), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def _fit(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, _Members):
            raise _Bad("object expected")
        fields = {f.name.lower(): f for f in kind}
        out: dict = {}
        for name, member in value:
            field = fields.get(_fold(name))
            if field is None:
                raise _Bad("unknown field")
            _merge(out, field.name, _fit(member, field.dataType))
        return out
    if isinstance(kind, T.ArrayType):
        if isinstance(value, _Members) or not isinstance(value, list):
            raise _Bad("array expected")
        return [_fit(item, kind.elementType) for item in value]
    if isinstance(kind, T.MapType):
        if not isinstance(value, _Members):
            raise _Bad("object expected")
        return {_whole(name): _fit(member, kind.valueType) or "" for name, member in value}
    wanted = {T.BooleanType: bool, T.DoubleType: float}.get(type(kind), str)
    if type(value) is not wanted:
        raise _Bad("type")
    return _whole(value) if wanted is str else value


def _merge(out: dict, name: str, value) -> None:
    """A repeated member: objects are merged, a null changes nothing, else the last one wins."""
    if isinstance(value, dict) and isinstance(out.get(name), dict):
        for key, item in value.items():
            _merge(out[name], key, item)
    elif value is not None or name not in out:
        out[name] = value


def _fold(name: str) -> str:
    return name.replace("ſ", "s").replace("K", "k").lower()


def _whole(value: str) -> str:
    """Unpaired surrogates become the replacement character."""
    return _SURROGATE.sub("�", value)
