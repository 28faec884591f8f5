"""Golden values of the text, hash and vector functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import hashing, text, vectors


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Some text DEF00001 more text", "DEF00001"), ("Beginning PLF-12345 end", "PLF-12345"), ("Multiple DEF00001 DEF00002 numbers", "DEF00001"), ("No Bates number here", None), ("Complex 00001-DEF format", "00001-DEF"), (None, None)],
)
def test_bates_number(spark, given, expected):
    assert one(spark, text.bates_number(F.col("x")), given) == expected


def test_similarity(spark):
    rows = spark.createDataFrame([("Hello", "Hello"), ("Hello", "hello"), ("Hello", "Hello there"), ("Apple", "Orange")], "a string, b string")
    got = [r[0] for r in rows.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [1.0, 1.0] and 0 < got[2] < 1 and got[3] < 0.5


@pytest.mark.parametrize("n,roman", [(1, "I"), (4, "IV"), (9, "IX"), (14, "XIV"), (40, "XL"), (1994, "MCMXCIV"), (3999, "MMMCMXCIX")])
def test_roman(spark, n, roman):
    assert one(spark, hashing.roman(F.col("x")), n, "int") == roman


def test_exhibit_label(spark):
    assert [one(spark, hashing.exhibit_label(F.col("x")), n, "int") for n in (0, 25, 26, 27)] == ["A", "Z", "AA", "BB"]


@pytest.mark.parametrize("token", ["negligence", "é", "x" * 500])
def test_token_bucket(spark, token):
    assert one(spark, hashing.token_bucket(F.col("x")), token) == int(hashlib.sha256(token.encode()).hexdigest(), 16) % 100_000


@pytest.mark.parametrize("name,expected", [("Smith v. Jones 2024", "smith_v_jones_2024"), ("", "unnamed_case"), ("2024 Case", "case_2024_case"), ("a  -- b", "a_b")])
def test_collection_name(spark, name, expected):
    assert one(spark, hashing.collection_name(F.col("x")), name) == expected


def test_long_collection_name(spark):
    name = one(spark, hashing.collection_name(F.col("x")), "word " * 40)
    assert len(name) == 63 and name.endswith(hashlib.md5(("word " * 40).encode()).hexdigest()[:8])


def test_cosine_edges(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("v,ok", [([1.0, 2.0], True), ([0.0, 0.0], False), ([1.0], False), ([float("nan"), 1.0], False), (None, False), ([None, 1.0], False)])
def test_vector_validity(spark, v, ok):
    assert one(spark, vectors.is_valid(F.col("x"), 2), v, "array<double>") is ok


def test_page_signs(spark):
    mail = "From: a@b.com\nTo: c@d.org\nSubject: hi"
    assert one(spark, text.is_email_start(F.col("x")), mail)
    assert not one(spark, text.is_email_start(F.col("x")), mail.replace("\n", "\n  ").replace("From", " From"))
    assert one(spark, text.is_form_start(F.col("x")), "  FORM A-12")
    assert one(spark, text.page_number(F.col("x")), "Page 7 of 9") == 7
    assert one(spark, text.document_type(F.col("x")), "MOTION TO compel a deposition of X") == "motion"
    assert one(spark, text.document_type(F.col("x")), "nothing") is None
    assert one(spark, text.clean_text(F.col("x")), " a\n\n\n\nb  c [Page 3] ") == "a\n\nb c"
