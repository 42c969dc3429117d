"""Option letters by another pattern, and what is asked of whole texts."""

import re

from pyspark.sql import functions as F

from marksmith.operators import grading
from marksmith.plans.queries import QUERIES

from .test_texts import SF


def test_letters_are_those_of_the_pattern_with_lookbehinds(spark):
    said = ["(a) x (b)", "( c ] d. e)", "x(a. [ b.", "((a) [E)", "a) b.c. d )", "xa) ya. \na .", "(a)b) (f) (ab)", "é) (é) \te)", "1. (a) b", "", "(a(b)c)"]
    old = r"(?:(?<=[(\[])\s*[A-Ea-e]\s*[)\]]|(?<!\S)[A-Ea-e]\s*[).])"
    bare = [re.sub(r"^\s*\(?\s*[0-9]+\s*[).:-]\s*", "", t) for t in said]
    want = [sorted({re.search("[A-Ea-e]", m).group().upper() for m in re.findall(old, t)}) for t in bare]
    rows = spark.createDataFrame([*enumerate(said)], "k int, t string")
    assert [r.v for r in rows.select("k", grading.option_letters(F.col("t")).alias("v")).orderBy("k").collect()] == want


def test_blanks_of_pending_replies_are_found_by_short_texts(spark):
    """The whole text goes to the options alone; whether an answer is blank is told by a sign in place of a long one."""
    assert "xxxxxxxx" in QUERIES["f25_pending_replies"](spark, SF)._jdf.queryExecution().executedPlan().toString()
