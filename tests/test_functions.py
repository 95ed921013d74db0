import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsearch.functions import arith, bloom, encoding
from loomsearch.functions import text as T
from loomsearch.functions import urls as U


def plain_terms(text):
    out = []
    for w in re.split(r"[ \t\r\n]+", text):
        w = w.replace("&#039;", "")
        if not w or len(w.encode()) > 50 or any(x in w for x in ("&#", "&nbsp", "&lrm", "&rlm")):
            continue
        w = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", w.replace("'", ""))
        out += [p.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for p in w.split("-") if p]
    return out


CASES = ["", "Hello, World!", "x" * 50 + " " + "y" * 51, "it&#039;s it's &apos;q", "a-b--c -d- 'quoted'", "é1é ÉCOLE", "a&nbsp;b c&#65; &lrm", "tab\tnew\nline\r\n", "...", "a.b.c", "X" * 49 + "'" + "Y"]


def test_terms(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)] + [(99, None)], "k int, t string")
    found = {r.k: r.terms for r in rows.select("k", T.terms(F.col("t")).alias("terms")).collect()}
    assert found == {k: plain_terms(t) for k, t in enumerate(CASES)} | {99: []}


def test_entities(spark):
    rows = [("&amp;&lt;x&gt;", "&<x>"), ("&#65;&#x42;;", "AB;"), ("a & b", "a & b"), ("&nope; &amp", "&nope; &amp"), ("&#99999999;", ""), (None, None)]
    got = [r.o for r in spark.createDataFrame([(a,) for a, _ in rows], "s string").select(T.decode_entities(F.col("s")).alias("o")).collect()]
    assert got == [b for _, b in rows]


URLS = ["https://www.a.com/b.html?q=1", "http://x.gov", "no", "https://h.org?x/y", "https://h.org:80/p/q#f", "https://en.wikipedia.org/Wiki/A-b", "http://a_b-c.net/d_e/f"]


def test_urls(spark):
    u = F.col("u")
    rows = spark.createDataFrame([(x,) for x in URLS], "u string").select(
        "u", U.site(u).alias("site"), U.frontier_host(u).alias("host"), U.top_level_domain(u).alias("tld"), U.clean_url(u).alias("clean"), U.ranking_parts(u).alias("p"), U.canonical(u).alias("canonical"), U.resolve(u, F.lit("/z")).alias("z")).collect()
    by = {r.u: r for r in rows}
    assert [r.tld for r in rows] == [".html?q=1", ".gov", "", ".org?x", ".org:80", ".org", ".net"]
    assert by["https://h.org?x/y"].site == "h.org?x" and by["https://h.org?x/y"].host == "h.org" and by["no"].host == "EMPTY"
    assert by["https://www.a.com/b.html?q=1"].clean == "www.a.com/b.html"
    assert tuple(by["https://en.wikipedia.org/Wiki/A-b"].p) == ("en.wikipedia.org", "/wiki/a b", "wiki")
    assert tuple(by["http://a_b-c.net/d_e/f"].p) == ("a b c.net", "/d e/f", "d_e") and tuple(by["no"].p) == ("", "/", "")
    assert by["https://h.org?x/y"].p.path == "" and by["http://x.gov"].p.path == "/" and by["http://x.gov"].z == "http://x.gov/z"


@pytest.mark.parametrize("length, ok", [(249, True), (250, True), (251, False)])
def test_crawlable(spark, length, ok):
    url = "http://a.org/".ljust(length, "x")
    assert spark.range(1).select(U.is_crawlable(F.lit(url)).alias("ok")).first().ok is ok


@pytest.mark.parametrize("length, weight", [(49, 3), (50, 2), (74, 2), (75, 1), (99, 1), (100, 0)])
def test_length_weight(spark, length, weight):
    assert spark.range(1).select(U.length_weight(F.lit("x" * length)).alias("w")).first().w == weight


@pytest.mark.parametrize("text, value", [("1 2", "12"), ("1+2*3", "7"), ("(1+2)*3", "9"), ("--5", "5"), ("-(2)", "-2"), ("7/-2", "-3"), ("1/0", "Syntax error"), ("", "Syntax error"), ("2(3)", "Syntax error"), ("(1", "Syntax error"), ("2*+3", "6"), ("9223372036854775807+1", "-9223372036854775808"), ("99999999999999999999", "9223372036854775807")])
def test_arithmetic(text, value):
    assert arith.evaluate(text) == value


@settings(deadline=None)
@given(st.recursive(st.integers(0, 99).map(str), lambda e: st.tuples(e, st.sampled_from("+-*"), e).map(lambda x: f"({x[0]}{x[1]}{x[2]})"), max_leaves=8))
def test_arithmetic_like_python(text):
    assert arith.evaluate(text) == str(eval(text))  # digits, signs and parentheses only


def test_encoding(spark):
    rows = spark.createDataFrame([("aé日",), ("",)], "s string")
    for big in (False, True):
        assert [r.s for r in rows.select(encoding.from_utf16(encoding.to_utf16(F.col("s"), big)).alias("s")).collect()] == ["aé日", ""]
    bad = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xf0\x90\x80\x80"),), (bytearray(b"\xc3("),)], "b binary")
    assert [r.v for r in bad.select(encoding.valid(F.col("b")).alias("v")).collect()] == [True, True, False]
    one = spark.createDataFrame([("Ab", "aB")], "a string, b string").select(encoding.compare(F.col("a"), F.col("b")).alias("x"), encoding.compare(F.col("a"), F.col("b"), fold=True).alias("y"), encoding.char_class(F.lit("!")).alias("z"), encoding.char_lengths(F.lit("aé")).alias("l")).first()
    assert tuple(one) == (-1, 0, "punctuation", [1, 2])


def test_bloom(spark):
    bits, hashes = bloom.shape(1000, 0.01)
    assert bits == 9586 and hashes == 6
    keys = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = bloom.build(keys.limit(500), "key", bits, hashes)
    assert bloom.probe(keys.limit(500), "key", words, bits, hashes).filter("not maybe").count() == 0
    other = spark.range(2000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert bloom.probe(other, "key", words, bits, hashes).filter("maybe").count() < 60


def test_sql_functions(spark):
    from loomsearch.operators.search import register_functions

    register_functions(spark)
    row = spark.sql("select evaluate('1+2*3') e, html_parse('<html lang=\"en\"><title>T</title>a b') h").first()
    assert row.e == "7" and row.h.words == ["a", "b"] and row.h.title_words == ["T"] and row.h.is_english
