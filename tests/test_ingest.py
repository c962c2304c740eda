import json

import pytest
from pyspark.sql import functions as F

from helpers import (KEY, NOW, attribute, keys, log_body, policies, requests, span, trace_body)
from veilspan.functions.predicates import valid_event
from veilspan.operators import ingest, policy
from veilspan.sources import otlp
from veilspan.sources.strict_json import normal_form, strict_json_ok
from veilspan import schemas


def judge(spark, rows, pol=(), key=KEY, **kw):
    active = policy.active_policies(policies(spark, pol))
    return ingest.accept_requests(requests(spark, rows, key), keys(spark), active, **kw)


def codes(judged):
    return {r.request_id: r.code for r in ingest.request_outcome(judged).collect()}


def sent(judged):
    return ingest.envelopes(judged).orderBy("request_id", "pos").collect()


def test_plain_events_are_keyed_by_tenant_and_tail_trace(spark):
    def event(event_id, **more):
        return json.dumps({"eventId": event_id, "name": "n", "attributes": {}, **more})

    rows = sent(judge(spark, [
        ("linked", "/v1/ingest", event("1", traceId="t", spanId="s")),
        ("log", "/v1/ingest", event("2", signal="log", traceId="t")),
        ("loose", "/v1/ingest", event("3", signal="log")),
        ("no span", "/v1/ingest", event("4", traceId="t")),
        ("bag", "/v1/ingest", event("5", signal="log", attributes={f"k{n}": "a@b.example, c@d.example 77" for n in range(3)}))],
        deploy_version="d", deploy_expressions=["7"]))
    assert {r.event_key: r.trace_id for r in rows} == {
        "tenant-a:1": "t", "tenant-a:2": "t", "tenant-a:3": "unlinked-log:3", "tenant-a:5": "unlinked-log:5"}
    bag = next(r.envelope for r in rows if r.event_key == "tenant-a:5")
    assert set(bag.event.attributes.values()) == {"[REDACTED_EMAIL], [REDACTED_EMAIL] " + "[REDACTED_PATTERN]" * 2}
    assert bag.policy.redactedPaths == ["attributes.k0", "attributes.k1", "attributes.k2"]


def test_outcomes(spark):
    good = trace_body(span())
    rows = [("ok", "/v1/traces", good), ("path", "/v1/none", good),
            ("empty", "/v1/traces", '{"resourceSpans":[]}'),
            ("prefix", "/v1/traces", trace_body(span(), span(span_id=""))),
            ("hundred", "/v1/traces", trace_body(*[span(span_id=f"s{i}") for i in range(100)])),
            ("hundred1", "/v1/traces", trace_body(*[span(span_id=f"s{i}") for i in range(101)])),
            ("size", "/v1/traces", good + " " * (1048576 - len(good))),
            ("size1", "/v1/traces", good + " " * (1048577 - len(good))),
            ("log", "/v1/logs", log_body({})), ("nolog", "/v1/logs", log_body())]
    assert codes(judge(spark, rows)) == {
        "ok": 202, "path": 404, "empty": 400, "prefix": 400, "hundred": 202, "hundred1": 400,
        "size": 202, "size1": 400, "log": 202, "nolog": 400}
    judged = judge(spark, rows, key="unknown")
    assert set(codes(judged).values()) == {401, 404} and sent(judged) == []


def test_no_prefix_of_a_refused_request_is_emitted(spark):
    judged = judge(spark, [("bad", "/v1/traces", trace_body(span(), span(span_id=""))),
                           ("two", "/v1/traces", trace_body(span(), span(span_id="b")))])
    assert [(r.request_id, r.pos) for r in sent(judged)] == [("two", 1), ("two", 2)]
    refused = ingest.inbox_rows(judged).filter("request_id = 'bad'").collect()
    assert len(refused) == 1 and refused[0].envelope is None and refused[0].code == 400


def test_only_the_rules_of_the_newest_version_apply_and_in_order(spark):
    days = lambda n: NOW.replace(day=n)
    pol = [("tenant-a", "second", "b+", days(20)), ("tenant-a", "first", "z", days(3)), ("tenant-a", "third", "c", days(11)),
           ("tenant-a", "second", "ab", days(20)), ("tenant-z", "other", "q", days(30))]
    values = ["abb", "bab", "cz", "q", ""]
    body = trace_body(span(attributes=[attribute(f"v{n}", stringValue=v) for n, v in enumerate(values)]))
    row = sent(judge(spark, [("r", "/v1/traces", body)], pol, deploy_version="d", deploy_expressions=["q"]))[0].envelope
    mark = "[REDACTED_PATTERN]"
    # Rules are taken in the order of their text: "ab" before "b+".
    assert [row.event.attributes[f"v{n}"] for n in range(4)] == [mark + mark, mark + mark, "cz", mark]
    assert (row.policy.policyVersion, row.policy.redactedPaths) == ("second", ["attributes.v0", "attributes.v1", "attributes.v3"])


@pytest.mark.parametrize("expression", ["(", "x" * 513, "", "(?=a)"])
def test_invalid_policy_refuses_the_request(spark, expression):
    judged = judge(spark, [("r", "/v1/traces", trace_body(span()))],
                   [("tenant-a", "v", expression, NOW)])
    assert codes(judged) == {"r": 503} and sent(judged) == []


def test_trace_attributes(spark):
    body = trace_body(
        span(parentSpanId="span-parent-1", attributes=[
            attribute("a", stringValue="own"), attribute("n", intValue="7"),
            attribute("b", boolValue=True), attribute("d", doubleValue=1234567),
            attribute("", stringValue="x"), attribute("none"), attribute("a", stringValue="last"),
            attribute("two", stringValue="s", intValue="1")]),
        resource=[attribute("a", stringValue="resource"), attribute("r", stringValue="kept"),
                  attribute("telemetry.source", stringValue="forged")])
    event = sent(judge(spark, [("r", "/v1/traces", body)]))[0].envelope.event
    assert (event.eventId, event.parentSpanId, event.signal) == (
        "trace-1:span-1", "span-parent-1", "trace")
    assert event.attributes == {"a": "last", "r": "kept", "n": "7", "b": "true",
                                "d": "1.234567e+06", "two": "s",
                                "telemetry.source": "otlp_http_json"}


def test_logs(spark):
    record = {"timeUnixNano": "123", "traceId": "trace-1", "spanId": "span-1",
              "severityText": "ERROR", "body": {"stringValue": "person@example.test customer-7"},
              "attributes": [attribute("cookie", stringValue="seed")]}
    rows = sent(judge(spark, [("r", "/v1/logs", log_body(record, {}))],
                      deploy_expressions=[r"customer-\d+"]))
    first, second = rows[0].envelope.event, rows[1].envelope.event
    assert (first.signal, first.name, first.traceId) == ("log", "log", "trace-1")
    assert first.attributes == {
        "cookie": "[REDACTED]", "log.severity": "ERROR",
        "log.body": "[REDACTED_EMAIL] [REDACTED_PATTERN]", "telemetry.source": "otlp_http_json"}
    assert rows[1].trace_id == "unlinked-log:" + second.eventId
    alone = sent(judge(spark, [("r", "/v1/logs", log_body({}))]))[0].envelope.event
    assert alone.eventId == "log-8a5da0f176fb0ee3" and second.eventId != alone.eventId


def test_ordinal_runs_over_the_whole_request(spark):
    body = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{}]}]}, None,
                                        {"scopeLogs": [None, {"logRecords": [{}, {}]}]}]})
    rows = otlp.parse_otlp_logs(requests(spark, [("r", "/v1/logs", body)])).collect()
    assert sorted(r.ordinal for r in rows) == [1, 2, 3]
    assert len({r.event.eventId for r in rows}) == 3


STRICT = {
    "plain": (trace_body(span()), True), "blank_after": (trace_body(span()) + " \n\t", True),
    "trailing": (trace_body(span()) + "{}", False), "close": (trace_body(span()) + "}", False),
    "early": ('{"resourceSpans":[]},"z":"1"}', False),
    "unknown": (trace_body(span(kind=1)), False),
    "number_as_text": (trace_body(span(attributes=[attribute("a", doubleValue="1")])), False),
    "text_as_number": (trace_body(span(attributes=[attribute("a", intValue=1)])), False),
    "bool": (trace_body(span(attributes=[attribute("a", boolValue="true")])), False),
    "array": ("[]", False), "null": ("null", True), "cut": ('{"resourceSpans":[', False),
    "case": ('{"RESOURCESPANS":[]}', True), "twice": ('{"resourceSpans":[],"resourceSpans":[]}', True),
    "nulls": ('{"resourceSpans":[null,{"resource":null,"scopeSpans":[null]}]}', True),
    "exponent": (trace_body(span(attributes=[attribute("a", doubleValue=1e30)])), True),
    "huge": ('{"resourceSpans":[{"resource":{"attributes":[{"key":"a","value":{"doubleValue":1e999}}]}}]}', False),
    "nan": (trace_body(span(attributes=[attribute("a", doubleValue=float("nan"))])), False),
    "surrogate": (trace_body(span(name="x\ud800")), True), "empty": ("", False),
    "quote": ("{'resourceSpans':[]}", False), "comment": ('{"resourceSpans":[]}//', False),
    "control": ('{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"a\nb"}]}]}]}', False),
    "mixed": (trace_body(span(), {"traceId": 7}), False),
    "object_for_array": ('{"resourceSpans":{}}', False),
}


def test_strict_decoding(spark):
    df = strict_json_ok(requests(spark, [(n, "/v1/traces", b) for n, (b, _) in STRICT.items()]))
    got = {r.request_id: r.strict_ok for r in df.collect()}
    assert got == {n: ok for n, (_, ok) in STRICT.items()}


def test_fast_and_exact_decoders_agree():
    for body, ok in STRICT.values():
        assert (normal_form(body, schemas.OTLP_TRACES) is not None) == ok, body


def test_rare_bodies_are_read_in_normal_form(spark):
    body = '{"RESOURCESPANS":[{"ScopeSpans":[{"spans":[{"TraceID":"t","spanid":"s","NAME":"a","name":"b\\ud800"}]}]}]}'
    event = sent(judge(spark, [("r", "/v1/traces", body)]))[0].envelope.event
    assert (event.eventId, event.name) == ("t:s", "b�")


def test_lenient_mode_ignores_unknown_fields(spark):
    body = trace_body(span(kind=1, startTimeUnixNano="5"))
    assert codes(judge(spark, [("r", "/v1/traces", body)])) == {"r": 400}
    assert codes(judge(spark, [("r", "/v1/traces", body)], strict=False)) == {"r": 202}


def event(**changes):
    base = {"eventId": "e", "signal": "trace", "traceId": "t", "spanId": "s", "parentSpanId": "",
            "name": "n", "attributes": {}}
    base.update(changes)
    return tuple(base[f.name] for f in schemas.EVENT)


@pytest.mark.parametrize("changes,ok", [
    ({}, True), ({"eventId": "x" * 256}, True), ({"eventId": "x" * 257}, False),
    ({"eventId": "é" * 128}, True), ({"eventId": "é" * 129}, False), ({"eventId": ""}, False),
    ({"traceId": "x" * 128}, True), ({"traceId": "x" * 129}, False),
    ({"spanId": "x" * 129}, False), ({"parentSpanId": "x" * 129}, False),
    ({"name": "x" * 512}, True), ({"name": "x" * 513}, False), ({"name": ""}, False),
    ({"attributes": {f"k{i}": "" for i in range(64)}}, True),
    ({"attributes": {f"k{i}": "" for i in range(65)}}, False),
    ({"attributes": {"k": "x" * 4096}}, True), ({"attributes": {"k": "x" * 4097}}, False),
    ({"attributes": {"k": "é" * 2048}}, True), ({"attributes": {"k": "é" * 2049}}, False),
    ({"attributes": {"": "x"}}, False), ({"attributes": {"k" * 256: ""}}, True),
    ({"attributes": {"k" * 257: ""}}, False), ({"traceId": ""}, False), ({"spanId": ""}, False),
    ({"signal": "log", "traceId": "", "spanId": ""}, True), ({"signal": ""}, True),
    ({"signal": "metric"}, False), ({"attributes": None}, True), ({"signal": None}, True)])
def test_event_limits(spark, changes, ok):
    df = spark.createDataFrame([(event(**changes),)], "e " + schemas.EVENT.simpleString())
    assert df.select(valid_event("e")).first()[0] is ok


def test_full_length_ids_make_the_event_id_too_long(spark):
    body = trace_body(span(trace="t" * 128, span_id="s" * 128))
    assert codes(judge(spark, [("r", "/v1/traces", body)])) == {"r": 400}


def test_keys_and_tenants(spark):
    disabled = keys(spark).withColumn("disabled_at", F.lit(NOW))
    active = policy.active_policies(policies(spark))
    judged = ingest.accept_requests(requests(spark, [("r", "/v1/traces", trace_body(span()))]),
                                    disabled, active)
    assert codes(judged) == {"r": 401}
    tenants = spark.createDataFrame([("tenant-a", NOW)], schemas.TENANTS)
    new = spark.createDataFrame([("tenant-a", KEY), ("tenant-b", "h2"), ("tenant-b", "h2")],
                                "tenant_id string, key_hash string")
    t, k = policy.register_tenant_keys(tenants, keys(spark), new, NOW)
    assert sorted(r.id for r in t.collect()) == ["tenant-a", "tenant-b"]
    assert sorted((r.tenant_id, r.key_hash) for r in k.collect()) == [
        ("tenant-a", KEY), ("tenant-b", "h2")]
    again = policy.register_tenant_keys(t, k, new, NOW)
    assert again[0].count() == 2 and again[1].count() == 2


def test_plan_parses_once_and_does_not_shuffle(spark, folder):
    for name, df in (("k", keys(spark)), ("p", policies(spark)),
                     ("r", requests(spark, [("r", "/v1/traces", trace_body(span()))]))):
        df.write.parquet(f"{folder}/{name}")
    k, p, r = (spark.read.parquet(f"{folder}/{n}") for n in "kpr")
    rows = ingest.envelopes(ingest.accept_requests(r, k, policy.active_policies(p)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    big = plan.split("Scan parquet")  # requests are the streamed side of broadcast joins
    assert "SortMergeJoin" not in plan and len(big) == 4
    assert plan.count("ArrowEvalPython [_decode_strict") == 1
