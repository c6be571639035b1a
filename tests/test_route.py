"""Rules on texts, on literals."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import route as Q


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_matches_are_located(spark):
    got = one(spark, "ab 12, 345 x", Q.located(F.col("t"), r"\d+"))
    assert [tuple(r) for r in got] == [("12", 3, 5), ("345", 7, 10)] and one(spark, "none", Q.located(F.col("t"), r"\d+")) == []
    assert [tuple(r) for r in one(spark, "12é34", Q.located(F.col("t"), r"\d+"))] == [("12", 0, 2), ("34", 3, 5)]


@pytest.mark.parametrize(
    "text, code",
    [
        ("the code 28 15 10 please", "28.15.10"),
        ("28 15 10 without a word before it", None),
        ("code: under act N 28 15 10 of then", None),
        ("code is 28 15 roubles", None),
        ("code, and so on, and on, and on, and on, and on 28 15", None),
        ("code worth 10 roubles 28 15 or code 29 16", "29.16"),
        ("code 27 11 or code 29 16", "27.11"),
        ("", None),
    ],
)
def test_codes_with_blanks(spark, text, code):
    assert one(spark, text, Q.spaced_code(F.col("t"), r"\b\d{2}(?:\s\d{2}){1,3}\b", r"\bcode\b", r"\bN", "roubles")) == code


@pytest.mark.parametrize(
    "text, found",
    [
        ("You need a chamber conclusion first. The Chamber  Conclusion is sent.", ["chamber conclusion"]),
        ("An expert chamber conclusion is made by the office.", []),
        ("There is no such paper as a chamber conclusion.", []),
        ("It isn't sent. A chamber conclusion is sent.", ["chamber conclusion"]),
        ("A chamber conclusion isn't sent here.", []),
        ("Get the certificate, and not a chamber conclusion.", []),
        (None, None),
    ],
)
def test_mentions_of_what_does_not_exist(spark, text, found):
    got = one(spark, text, Q.unknown_mentions(F.col("t"), r"(?i)expert\s+chamber\s+conclusion", r"(?i)chamber\s+conclusion", r"(?i)no such paper", r"(?i)isn't", r"(?i)and not an?"))
    assert got == found


def test_rules_take_the_first_fit(spark):
    rules = [Q.Rule("short", some=["^more", "^it"], most=12), Q.Rule("order", some=["register"], never=["points", "member"]), Q.Rule("both", every=["a", "b"])]
    data = {"it goes on": "short", "it goes on and on": "none", "how to register": "order", "register for points": "none", "a and b": "both", "": "none"}
    df = spark.createDataFrame([(t,) for t in [*data, None]], "t string")
    assert {r.t: r.x for r in df.select("t", Q.routed(F.col("t"), rules, "none").alias("x")).collect()} == data | {None: "none"}


def test_names_bent_for_tests(spark):
    assert one(spark, "Electric motors, new", Q.abbreviated(F.col("t"), {"electr": "el."})) == "el. motors, new"
    assert one(spark, "Nothing known", Q.abbreviated(F.col("t"), {"electr": "el."})) == "Noth. known" and one(spark, "a bit", Q.abbreviated(F.col("t"), {"electr": "el."})) == "a bit"
    assert [one(spark, "12 abc", Q.with_typo(F.col("t"), F.lit(p))) for p in (0, 7, 14, 21)] == ["12 bac", "12 ac", "12 abcc", "12 sbc"]
    assert one(spark, "1a2b", Q.with_typo(F.col("t"), F.lit(1))) == "1a2b"
    assert one(spark, "as of 01.02.2020 N 7, 03.01.2021 N 2, 03.01.2021 N 10", F.struct(Q.latest_amendment(F.col("t")).alias("a")))["a"].asDict() == {"y": 2021, "m": 1, "d": 3, "number": 10}
    assert one(spark, "none", Q.latest_amendment(F.col("t"))) is None
