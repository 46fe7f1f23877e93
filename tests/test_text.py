import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkward.functions.cvss import advisory_severity, band, base_score
from sparkward.functions.text import entropy, java, places, redact, redact_line, severity, split_lines

LINES = [
    ("a\nb", ["a", "b"]), ("a\nb\n", ["a", "b"]), ("solo", ["solo"]), ("a\n\nb", ["a", "", "b"]), ("\n", [""]), ("\n\n", ["", ""]), ("", []),
    ("alpha\r\nbeta", ["alpha", "beta"]), ("alpha\r\nbeta\r\n", ["alpha", "beta"]), ("\r\n", [""]), ("alpha\rbeta", ["alpha\rbeta"]), ("alpha\r", ["alpha"]),
    ("a b", ["a b"]), ("a b", ["a b"]), ("a\x85b", ["a\x85b"]), ("a\x0bb", ["a\x0bb"]), ("a\x0cb", ["a\x0cb"]), ("a\x1cb", ["a\x1cb"]),
    ("a\x1db", ["a\x1db"]), ("a\x1eb", ["a\x1eb"]), ("a b M\np​\n", ["a b M", "p​"]), (" \n ", [" ", " "]), ("\t", ["\t"]),
]


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_lines_end_at_line_feeds_only(spark):
    assert column(spark, [t for t, _ in LINES], split_lines) == [x for _, x in LINES]
    assert column(spark, [None], split_lines) == [[]]


def test_severity_words(spark):
    words = ["critical", " High ", "ERROR", "warning", "Moderate", "important", "severe", "none", "unknown", "info", "odd", "", None]
    assert column(spark, words, severity) == [4, 3, 3, 2, 2, 3, 3, 0, 1, 0, 2, 2, 2]


def test_redaction(spark):
    assert column(spark, ["", "a", "abcdefgh", "abcdefghi", None], redact) == ["*", "a*", "a" + "*" * 7, "abcd" + "*" * 8 + "fghi (len=9)", ""]
    assert column(spark, ["  x=abcdefghijkl; "], lambda c: redact_line(c, F.lit("abcdefghijkl"))) == ["x=abcd********ijkl (len=12);"]


def test_entropy(spark):
    assert column(spark, ["aaaa", "aabb", "abcd"], entropy) == [0.0, 1.0, 2.0]


def test_cvss(spark):
    vectors = [
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", "CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N",
        "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", "CVSS:3.1/AV:N", "junk",
    ]
    assert column(spark, vectors, base_score) == [9.8, 10.0, 1.8, 0.0, None, None]
    assert column(spark, vectors, lambda v: band(base_score(v))) == [4, 4, 1, 0, None, None]
    assert column(spark, vectors, lambda v: advisory_severity(F.lit(None), F.array(v))) == [4, 4, 1, 0, 2, 2]
    assert column(spark, ["low", "MODERATE", "odd"], lambda w: advisory_severity(w, F.array(F.lit(vectors[0])))) == [1, 2, 4]


def test_places_give_the_line_of_each_match(spark):
    text = "x <!-- a\nb --> y\n\n<!--c--> <!--d-->"
    got = column(spark, [text], lambda c: places(c, r"(?s)<!--(.*?)-->", 1))[0]
    assert [(m.hit, m.line) for m in got] == [(" a\nb ", 1), ("c", 4), ("d", 4)]


@pytest.mark.parametrize("pattern", [r"(?i)\bcurl\b\s+\S", r"\w+\d", r"[\s\-]x"])
def test_patterns_read_unicode_as_python_does(spark, pattern):
    texts = ["curl x", "écurl x", "CURL x", "curl x", "curl\x1cx", "ab1", "é٣", "-x", " x", "xcurl y", "K curl"]
    assert column(spark, texts, lambda c: c.rlike(java(pattern))) == [bool(re.search(pattern, t)) for t in texts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab\n\r  ", max_size=20), min_size=1, max_size=20))
def test_lines_property(spark, texts):
    def want(t):
        parts = t.split("\n")
        if parts[-1] == "":
            parts.pop()
        return [p[:-1] if p.endswith("\r") else p for p in parts] if t else []

    assert column(spark, texts, split_lines) == [want(t) for t in texts]


def test_entropy_of_a_hash(spark):
    h = hashlib.md5(b"x").hexdigest()
    want = -sum(h.count(c) / 32 * math.log2(h.count(c) / 32) for c in set(h))
    assert abs(column(spark, [h], entropy)[0] - want) < 1e-9
