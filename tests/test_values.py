import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import predicates as P
from veilspan.functions import values as V


def column(spark, kind, data, expr):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr.alias("y")).orderBy("i").select("y").collect()]


def shortest(x: float) -> str:
    """Reference formatting from Python's shortest digits."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    mantissa, exponent = f"{x:e}", 0
    digits, _, e = repr(abs(x)).partition("e")
    whole, _, frac = digits.partition(".")
    raw = whole + frac
    point = len(whole) + int(e or 0) - (len(raw) - len(raw.lstrip("0")))
    raw = raw.strip("0")
    sign = "-" if x < 0 else ""
    power = point - 1
    if power < -4 or power >= 6:
        head = raw[0] + ("." + raw[1:] if len(raw) > 1 else "")
        return f"{sign}{head}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if point <= 0:
        return sign + "0." + "0" * -point + raw
    if point >= len(raw):
        return sign + raw + "0" * (point - len(raw))
    return sign + raw[:point] + "." + raw[point:]


def test_shortest_double(spark):
    cases = [1.0, 0.5, 123456.0, 1234567.0, 1e6, 1e20, 1e21, 1e-4, 1e-5, -2.5, 0.0, -0.0, 2e-3,
             100.0, 0.1 + 0.2, 1e7, 123.456, 2e23, 1.1e-7, -1e100, 999999.5, 0.001, 0.00099]
    want = [shortest(x) for x in cases]
    assert column(spark, "double", cases, V.shortest_double("x")) == want
    assert want[:4] == ["1", "0.5", "123456", "1.234567e+06"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=200, max_size=200))
def test_shortest_double_random_bits(spark, bits):
    cases = [x for x in (struct.unpack("d", struct.pack("Q", b))[0] for b in bits)
             if math.isfinite(x) and abs(x) > 1e-300]
    assert column(spark, "double", cases, V.shortest_double("x")) == [shortest(x) for x in cases]


def test_fnv_vectors(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    texts = ["smoke-trace-007", "smoke-trace-001", "", "é漢", "a" * 128]
    assert column(spark, "string", texts, V.fnv1a_32("x")) == [fnv(t) for t in texts]
    assert column(spark, "string", texts[:2], V.hash_sampled("x", 10)) == [True, False]


def test_log_event_id(spark):
    got = spark.range(1).select(V.log_event_id(F.lit(""), F.lit(""), F.lit(""), F.lit(1))).first()
    assert got[0] == "log-8a5da0f176fb0ee3"


@pytest.mark.parametrize("text,error,usage", [
    ("503", True, 503), ("499", False, 499), ("+0500", True, 500), ("-500", False, -500),
    (" 500 ", False, 0), ("500d", False, 0), ("", False, 0), ("2147483648", True, 0),
    ("99999999999999999999999", True, 0), ("1e3", False, 0), ("5", False, 5)])
def test_status_rules(spark, text, error, usage):
    assert column(spark, "string", [text], V.status_at_least("x", 500)) == [error]
    assert column(spark, "string", [text], V.int32_or_zero("x")) == [usage]


def test_slow(spark):
    texts = ["1000", "999.9999999", "1001", "NaN", "inf", "1500d", " 1500", "1e3", "", "-5000",
             "1000.", ".5e4", "1e400"]
    bag = F.create_map(F.lit("duration_ms"), F.col("x"))
    assert column(spark, "string", texts, P.is_slow(bag)) == [
        True, False, True, False, False, False, False, True, False, False, True, True, False]


def test_trace_id_and_routes(spark):
    ids = ["abc-_9", "", "a" * 128, "a" * 129, "a\n", "a b", "é"]
    assert column(spark, "string", ids, P.valid_trace_id("x")) == [
        True, False, True, False, False, False, False]
    paths = ["/v1/traces/trace-with-tenant-content", "/v1/traces", "/v1/metrics", "/v1/audit",
             "/v1/dependencies", "/v1/retention/delete", "/v1/logs", "/v1/ingest", "/v1/sampling"]
    assert column(spark, "string", paths, P.route_bucket("x")) == [
        "trace", "ingest", "metrics", "audit", "dependencies", "deletion", "other", "other",
        "other"]


def test_sensitive_keys(spark):
    names = ["http.Authorization", "X_API_KEY", "apikey", "tokenizer", "passwd", "Set-Cookie",
             "db.password", "client_SECRET", "name", "api_key", "toKen"]
    assert column(spark, "string", names, P.is_sensitive_key("x")) == [
        True, True, True, True, False, True, True, True, False, True, True]


def test_split_and_errors(spark):
    got = column(spark, "string", [" a, b ,,", ""], V.split_nonempty("x"))
    assert got == [["a", "b"], []]
    messages = ["x claim_tail_outbox: y", "mark_tail_outbox", "?"]
    assert column(spark, "string", messages, P.error_class("x")) == [
        "claim_tail_outbox_failure", "mark_tail_outbox_failure", "tail_failure"]
    assert V.clamp_limit(0) == 100 and V.clamp_limit(101) == 100 and V.clamp_limit(7) == 7


def test_hexadecimal_durations(spark):
    good = ["0x1p-2", "0X1.8p1", "-0xA.bP+3", "0x_1_Fp0", "0x.8p0", "0x1.p4", "0x123456789abcdefp-40", "0x0p99999999999", "+0x1p10", "0x1p-1080"]
    bad = ["0x1", "0xp1", "0x.p1", "1p2", "0x1p", "0x1__1p0", "0x1p1_0", "0x1p2000", " 0x1p0", "0xgp0", "0x1p0x"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = {r.t: r.d for r in df.select("t", V.parse_double("t").alias("d")).collect()}
    assert {t: got[t] for t in good} == {t: float.fromhex(t.replace("_", "").replace("p99999999999", "p1")) for t in good}
    assert {t for t in bad if got[t] is not None} == set()
