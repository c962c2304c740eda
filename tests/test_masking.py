import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import masking as M
from veilspan.functions.dialect import Refused, to_jvm
from veilspan.functions.predicates import SENSITIVE_MARKERS

EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"


def masked(spark, attributes, rules=(), version="rules-7"):
    df = spark.createDataFrame([(attributes,)], "a map<string,string>")
    row = df.select(M.sanitize("a", M.jvm_patterns(rules), F.lit(version)).alias("s")).first().s
    return row.attributes, row.policy


def model(bag, rules):
    """What masking gives, by Python's own expressions; these rules mean the same there."""
    out, changed = {}, []
    for key, value in bag.items():
        text = value or ""
        if any(m in key.lower().replace("_", "-") for m in SENSITIVE_MARKERS):
            text = "[REDACTED]"
        else:
            text = re.sub(EMAIL, "[REDACTED_EMAIL]", text, flags=re.ASCII)
            for rule in rules:
                text = re.sub(rule, "[REDACTED_PATTERN]", text, flags=re.ASCII)
        out[key] = text
        if text != (value or "") or text == "[REDACTED]":
            changed.append(f"attributes.{key}")
    return out, sorted(changed)


@pytest.mark.parametrize("rules", [(), ("x[0-9]",), ("[0-9]+", "PATTERN", "y"), ("xy|yx", "x", "^ ", "[a-c]{2,3}")])
def test_random_bags_against_a_model(spark, rules):
    rng = random.Random(len(rules))
    spell = lambda m: "".join(rng.choice([c.upper(), c, "_" if c == "-" else c]) for c in m)
    bags = [{}]
    for _ in range(60):
        keys = [rng.choice(["a", "n.b", "deep."]) + rng.choice(["", "", spell(rng.choice(sorted(SENSITIVE_MARKERS)))]) + str(k)
                for k in range(rng.randrange(1, 6))]
        value = lambda: "".join(rng.choice(["x1", "yx", "abc", " ", "u.v@w.example", "@", "9", "é", "y"]) for _ in range(rng.randrange(7)))
        bags.append({k: rng.choice([value(), None]) for k in keys})
    df = spark.createDataFrame([(n, bag) for n, bag in enumerate(bags)], "n int, a map<string,string>")
    got = df.select("n", M.sanitize("a", M.jvm_patterns(rules), F.lit("")).alias("s")).orderBy("n").collect()
    assert [(r.s.attributes, r.s.policy.redactedPaths) for r in got] == [model(bag, rules) for bag in bags]
    assert {r.s.policy.policyVersion for r in got} == {"v1"}
    literal = df.select("n", M.sanitize_by_rules("a", rules, F.lit("")).alias("s")).orderBy("n").collect()
    assert literal == got
    assert masked(spark, None) == ({}, masked(spark, {})[1])


def test_match_of_the_mark_counts(spark):
    bag, receipt = masked(spark, {"a": "[REDACTED_PATTERN]"}, [r"\[REDACTED_PATTERN\]"])
    assert bag == {"a": "[REDACTED_PATTERN]"} and receipt.redactedPaths == ["attributes.a"]
    # A hidden value is not looked at again.
    assert masked(spark, {"token": "x"}, ["REDACTED"])[0] == {"token": "[REDACTED]"}


def same_as_re2(spark, pattern, texts, mark="<X>"):
    con = duckdb.connect()
    want = [con.execute("SELECT regexp_replace(?, ?, ?, 'g')", [t, pattern, mark]).fetchone()[0]
            for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.y for r in df.select("i", F.regexp_replace("t", to_jvm(pattern), mark).alias("y"))
           .orderBy("i").collect()]
    assert got == want, pattern


TEXTS = ["account-42", "éabc@x.com", "a@b.comé", "line one\nline two\r\n", "ſtraße K",
         "tab\tand\x0bvt", "a{b}c[d]e&&f", "x--y", "A1 b2 C3", "", "\n", "aaa\naaa",
         "0123456789abcdef" * 3, "naïve café", "token = \"deadbeef\"", "a.b*c+d?"]


@pytest.mark.parametrize("pattern", [
    r"account-[0-9]+", r"\bab?c\b", r"\B\w", r"[[:alpha:]]+\d", r"[^[:space:]]+$", r"(?m)^\w+$",
    r"\s+", r"[\s\d]", r"(?i)STRASSE|k", r"(?i)[s-t]+", r"a+$", r".+", r"(?s).+", r"\Aline",
    r"two\s*\z", r"[a\-z]", r"[]a]", r"[\[&]", r"(?P<n>a)(b)?", r"(?:x|-)+?y", r"\Qa.b*\E",
    r"\x41|\x{e9}", r"\pL+", r"\p{Greek}|\p{Lu}", r"[^\W\d]", r"a{2,3}?", r"{b}", r"x*y",
    r"[A-Za-z0-9-_]+", r"[\w-.]+", r"[a-c-e]", r"[+--]",
    r"(?U)a+", r"(?U)\w+?\d?", r"(?U:[a-e]{2,})a+", r"x(?U)-*(?-U)y*", r"\p{Any}", r"[\P{Any}x]+", r"[^\p{Any}]|b",
    r"((a{1,10}){1,10}){1,10}", r"(a{1000}b){0}c", EMAIL])
def test_dialect_agrees_with_re2(spark, pattern):
    same_as_re2(spark, pattern, TEXTS)


@pytest.mark.parametrize("pattern", [
    "(", ")", "a)", "[", "*a", "a**", "a*+", "a++", "(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "a\\",
    r"\Z", r"\C", "(a{40}){40}", "((a{10}){10}){11}", "(a{500}|b{2}){3}", "(a{20,}){51}", "(?x)a", "[[:nope:]]", "[z-a]", "a{1001}", "a{3,2}", r"\pX{", "(?<n>a)(?<n>b)"])
def test_rules_without_an_exact_form_are_refused(pattern):
    with pytest.raises(Refused):
        to_jvm(pattern)


words = st.text(alphabet="ab.@é-_ Zſ9\n", max_size=24)


@settings(max_examples=10, deadline=None)
@given(st.lists(words, min_size=60, max_size=60))
def test_email_mask_agrees_with_re2(spark, texts):
    con = duckdb.connect()
    want = [con.execute("SELECT regexp_replace(?, ?, '[REDACTED_EMAIL]', 'g')", [t, EMAIL])
            .fetchone()[0] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    once = df.select("i", M.mask_emails("t").alias("t"))
    assert [r.t for r in once.orderBy("i").collect()] == want
    twice = once.select("i", M.mask_emails("t").alias("t")).orderBy("i").collect()
    assert [r.t for r in twice] == want  # masking is idempotent
