"""Identities, hashes, numbers and times as native Column expressions."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def reuse(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression built for column names.

    Expressions over names belong to no DataFrame, and a large one takes seconds to send to the
    JVM; a stream would pay that for every micro-batch.
    """
    made: dict = {}

    @functools.wraps(build)
    def get(*names: str) -> Column:
        if not all(isinstance(name, str) for name in names):
            return build(*names)
        key = (id(SparkContext._gateway), *names)
        if key not in made:
            made[key] = build(*names)
        return made[key]

    return get


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_ts(value: Column | dt.datetime | str) -> Column:
    """A timestamp argument: a Column (scalar subqueries too), a datetime or a text literal."""
    if isinstance(value, Column):
        return value
    return F.to_timestamp(F.lit(value)) if isinstance(value, str) else F.lit(value)


def text(value: ColumnLike) -> Column:
    """Missing text is the empty text, as in the wire format."""
    return F.coalesce(col(value), F.lit(""))


# --- identities -----------------------------------------------------------------------
def event_key(tenant_id: ColumnLike, event_id: ColumnLike) -> Column:
    return F.concat(col(tenant_id), F.lit(":"), col(event_id))


def trace_event_id(trace_id: ColumnLike, span_id: ColumnLike) -> Column:
    return F.concat(text(trace_id), F.lit(":"), text(span_id))


def log_event_id(trace_id: ColumnLike, span_id: ColumnLike, time_unix_nano: ColumnLike,
                 ordinal: ColumnLike) -> Column:
    """``log-`` and the first 8 digest bytes over the ids, the time and the 1-based ordinal."""
    identity = F.concat_ws(":", text(trace_id), text(span_id), text(time_unix_nano),
                           col(ordinal).cast("string"))
    return F.concat(F.lit("log-"), F.substring(F.sha2(identity, 256), 1, 16))


def tail_trace_id(trace_id: ColumnLike, event_id: ColumnLike) -> Column:
    """The buffer a record belongs to; a log without a trace id is a trace of its own."""
    return (F.when(text(trace_id) != "", col(trace_id))
            .otherwise(F.concat(F.lit("unlinked-log:"), text(event_id))))


def signal_type(signal: ColumnLike) -> Column:
    return F.when(text(signal) == "log", F.lit("log")).otherwise(F.lit("trace"))


def sha256_hex(value: ColumnLike) -> Column:
    return F.sha2(col(value), 256)


# --- hash sampling --------------------------------------------------------------------
# FNV-1a, 32 bit.  Fixed values.
_FNV_OFFSET = 2166136261
_FNV_PRIME = 16777619
_FNV_SIZE = 4294967296


def fnv1a_32(value: ColumnLike) -> Column:
    """FNV-1a over the UTF-8 bytes, as BIGINT in 0..2^32-1."""
    # One Latin-1 character per byte; the empty text has no character to fold.
    latin = F.decode(F.encode(col(value), "UTF-8"), "ISO-8859-1")
    letters = F.filter(F.split(latin, ""), lambda c: c != "")
    return F.aggregate(
        letters, F.lit(_FNV_OFFSET).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(_FNV_PRIME))
        % F.lit(_FNV_SIZE))


def hash_sampled(trace_id: ColumnLike, modulo: int) -> Column:
    """Hash ``distinct`` trace ids, not every span: the fold costs one step per byte."""
    return fnv1a_32(trace_id) % F.lit(modulo) == 0


# --- numbers --------------------------------------------------------------------------
_INTEGER = r"\A[+-]?[0-9]+\z"
_HEXADECIMAL = (r"\A[+-]?0[xX](?=_?[0-9A-Fa-f]|\.[0-9A-Fa-f])(_?[0-9A-Fa-f])*"
                r"(\.([0-9A-Fa-f](_?[0-9A-Fa-f])*)?)?[pP][+-]?[0-9]+\z")
_DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def status_at_least(value: ColumnLike, bound: int) -> Column:
    """An integer text >= a positive bound; a number too large for 64 bits counts as large."""
    digits = F.regexp_replace(text(value), r"\A[+]?0*", "")
    size, limit = F.length(digits), str(bound)
    return (text(value).rlike(_INTEGER) & ~text(value).startswith("-")
            & ((size > len(limit)) | ((size == len(limit)) & (digits >= limit))))


def int32_or_zero(value: ColumnLike) -> Column:
    """The number when the whole text is a 32-bit integer, else 0."""
    number = F.when(text(value).rlike(_INTEGER), text(value).try_cast("bigint"))
    return F.when(number.between(-2147483648, 2147483647), number).otherwise(F.lit(0)).cast("int")


def parse_double(value: ColumnLike) -> Column:
    """A finite number, decimal or hexadecimal with a binary exponent, or NULL: no blanks, suffixes, NaN or infinity."""
    number = F.when(text(value).rlike(_DECIMAL), text(value).try_cast("double")).when(
        text(value).rlike(_HEXADECIMAL), _hexadecimal(text(value)))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def _hexadecimal(value: Column) -> Column:
    """The first 15 digits of the mantissa, to within the last bit, times the power of two."""
    plain = F.upper(F.replace(value, F.lit("_"), F.lit("")))
    mantissa = F.regexp_extract(plain, r"0X([0-9A-F.]*)P", 1)
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.ltrim(F.concat(whole, part), F.lit("0"))
    power = F.regexp_extract(plain, r"P([+-]?[0-9]+)\z", 1).try_cast("int")
    power = F.coalesce(power, F.when(plain.contains("P-"), -99999).otherwise(99999))
    power = power - 4 * F.length(part) + 4 * F.greatest(F.length(digits) - 15, F.lit(0))
    size = F.coalesce(F.conv(F.left(digits, F.lit(15)), 16, 10).try_cast("double"), F.lit(0.0))
    # In two steps, so that neither power leaves the range of a double where the product does not.
    half = F.floor(power / 2)
    scaled = size * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    return F.when(size == 0, 0.0).otherwise(F.when(plain.startswith("-"), -scaled).otherwise(scaled))


def let(value: Column, body) -> Column:
    """Bind an expression to a name, so that using it often does not repeat it in the plan."""
    return F.transform(F.array(value), body)[0]


def shortest_double(value: ColumnLike) -> Column:
    """The shortest digits that read back as the same double, scientific from 1e+06 on and
    below 1e-04, without a trailing ``.0``."""
    number = col(value)
    plain = number.cast("string")
    # Common sizes print the same way but for the trailing zero.
    common = (F.abs(number) >= 1e-3) & (F.abs(number) < 1e6) & (F.length(plain) < 17)
    return (F.when(common, F.when(plain.endswith(".0"), F.left(plain, F.length(plain) - 2))
                   .otherwise(plain))
            .when(number.isNotNull(), _any_double(number)))


def _any_double(number: Column) -> Column:
    sign = F.when((number < 0) | (number.cast("string") == "-0.0"), F.lit("-")).otherwise("")
    body = let(F.abs(number), lambda size: let(
        _shorter(_shorter(size.cast("string"), size, 15), size, 14), _digits_and_point))
    return F.concat(sign, let(body, _layout))


def _shorter(plain: Column, size: Column, precision: int) -> Column:
    # JDK 17 sometimes prints one digit too many; take a shorter form if it reads back equal.
    shorter = F.format_string(f"%.{precision}e", size)
    return let(plain, lambda p: F.when(
        (F.length(p) >= 17) & (shorter.try_cast("double") == size), shorter).otherwise(p))


def _digits_and_point(plain: Column) -> Column:
    """Significant digits and the place of the decimal point within them."""
    mantissa = F.substring_index(F.upper(plain), "E", 1)
    exponent = F.coalesce(F.regexp_extract(plain, r"[eE]([+-]?[0-9]+)", 1).try_cast("int"),
                          F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    raw = F.replace(mantissa, F.lit("."), F.lit(""))
    kept = F.ltrim(raw, F.lit("0"))
    return F.struct(F.rtrim(kept, F.lit("0")).alias("digits"),
                    (F.length(whole) + exponent - (F.length(raw) - F.length(kept))).alias("point"))


def _layout(parts: Column) -> Column:
    digits, point = parts["digits"], parts["point"]
    count, power = F.length(digits), point - 1
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(""),
        F.when(power < 0, F.lit("e-")).otherwise("e+"),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(""), F.abs(power).cast("string"))
    fixed = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
             .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count)))
             .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."),
                                 F.substring(digits, point + 1, count))))
    return (F.when(digits == "", F.lit("0"))
            .when((power < -4) | (power >= 6), scientific).otherwise(fixed))


# --- attributes and times -------------------------------------------------------------
def attr(attributes: ColumnLike, key: str) -> Column:
    return F.coalesce(F.try_element_at(col(attributes), F.lit(key)), F.lit(""))


def attributes_json(attributes: ColumnLike) -> Column:
    return F.to_json(F.coalesce(col(attributes), F.create_map().cast("map<string,string>")))


def attributes_from_json(value: ColumnLike) -> Column:
    return F.from_json(col(value), "map<string,string>")


def format_ts_millis(value: ColumnLike) -> Column:
    return F.date_format(col(value), "yyyy-MM-dd HH:mm:ss.SSS")


def retention_cutoff(as_of: Column | dt.datetime | str, days: ColumnLike) -> Column:
    return as_ts(as_of) - F.make_interval(days=col(days))


def clamp_limit(limit: int, top: int = 100) -> int:
    """A page size outside 1..top becomes top."""
    return limit if 1 <= limit <= top else top


def valid_retention_days(days: ColumnLike) -> Column:
    return col(days).between(1, 3650)


def split_nonempty(value: ColumnLike) -> Column:
    return F.filter(F.transform(F.split(text(value), ","), lambda part: F.trim(part)), lambda part: part != "")
