"""Balanced tags, typed segments and third readings: literal cases, and plain versions on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marksmith.operators import segments

BUTENE = "      H   H   H   H\n      |   |   |   |\nH - C - C - C = C - H\n      |   |\n      H   H"
BENZENE = "     C\n   //  \\\n  C     C\n  |     ||\n  C     C\n   \\  //\n     C"
CODE = "def total(rows):\n    n = 0\n    for r in rows:\n        n = n + r\n    return n"


def frame(spark, texts, column="answer"):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], f"sheet_id long, base int, {column} string")


def plain_spans(text):
    found, at = [], 0
    while m := re.compile(r"\[(CODE|DIAGRAM):").search(text, at):
        depth = 0
        for k in range(m.start(), len(text)):
            depth += (text[k] == "[") - (text[k] == "]")
            if depth == 0:
                break
        closed = depth == 0
        at = k + 1 if closed else len(text)
        found.append((m[1], m.start(), at, text[m.end() : k if closed else len(text)].strip(" \t\r\n"), closed))
    return found


def test_spans_equal_a_plain_scan(spark):
    rng = random.Random(5)
    parts = ["[CODE:", "[DIAGRAM:", "[", "]", " a ", "[x]", "\n", "é", "CODE:", "[CODE"]
    texts = ["see [CODE: a[0] = [1]] and [DIAGRAM: box", "plain [x]", ""] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(800)]
    got: dict = {}
    for r in segments.tag_spans(frame(spark, texts)).collect():
        got.setdefault(r.base, []).append((r.kind, r.start, r.stop, r.inner, r.terminated))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == {k: plain_spans(t) for k, t in enumerate(texts) if plain_spans(t)}
    assert segments.tag_spans(frame(spark, [None])).count() == 0


CASES = {
    BUTENE: [("structure", BUTENE)],
    BENZENE: [("structure", BENZENE)],
    "(i) But-1-ene\n" + BUTENE + "\n\nand, But-2-ene\n" + BUTENE: [("text", "(i) But-1-ene"), ("structure", BUTENE), ("text", "\nand, But-2-ene"), ("structure", BUTENE)],
    "    |    |": [("text", "    |    |")],
    "H - C ≡ C - H": [("text", "H - C ≡ C - H")],
    "   = 35 + 60 / 39\n   = 35 + 1.46": [("text", "   = 35 + 60 / 39\n   = 35 + 1.46")],
    "A. B. C. D.": [("text", "A. B. C. D.")],
    CODE: [("code", CODE)],
    "It is:\n" + CODE + "\nas asked": [("text", "It is:"), ("code", CODE), ("text", "as asked")],
    "x\n[CODE: for i in a:\n  b[i] = [1]\n\n  print(i)] then\n[DIAGRAM: a [box]]": [("text", "x\n"), ("code", "for i in a:\n  b[i] = [1]\n\n  print(i)"), ("text", " then\n"), ("diagram", "a [box]")],
    "one\nSELECT a FROM b\ntwo\nthree\nfour": [("text", "one"), ("code", "SELECT a FROM b"), ("text", "two\nthree\nfour")],
    "one\nq = \"a\"\ntwo\nv = u + at": [("text", "one\nq = \"a\"\ntwo\nv = u + at")],
    "1. import csv\n\n2. conn = ms.connect()\nprose": [("code", "1. import csv\n\n2. conn = ms.connect()"), ("text", "prose")],
    "": [],
}


def test_segments(spark):
    texts = list(CASES)
    got: dict = {k: [] for k in range(len(texts))}
    for r in segments.answer_segments(frame(spark, [*texts, None])).orderBy("base", "seg_no").collect():
        assert r.seg_no == len(got[r.base])
        got[r.base].append((r.kind, r.text))
    assert {texts[k]: v for k, v in got.items()} == CASES


def test_segments_shuffle_no_lines(spark):
    made = segments.answer_segments(frame(spark, [CODE, "a\n" * 30_000]))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Sort"))
    assert [len(r.text.split("\n")) for r in made.orderBy("base").collect()] == [5, 30_001]


def code(spark, text, second, third, pages=1):
    one = lambda t: spark.createDataFrame([(1, 1, t)], "sheet_id long, base int, text string")
    return segments.apply_code_arbiter(one(text).withColumn("pages", F.lit(pages)), one(second), one(third)).first()


FIRST, OTHER, BETTER = "so [CODE: emp-id = a[0]\nprint(x)] end", "emp_id = b[0]", "emp_id = a[0]\nprint(x)"


def test_a_third_reading_of_code_is_spliced_in(spark):
    r = code(spark, FIRST, OTHER, "x_y = 1\nemp_id")
    assert not r.reconciled
    r = code(spark, "so [CODE: my-total = a[0]\nprint(x)] end", "my total", "my_total = a[0]\nprint(x)")
    assert (r.text, r.reconciled, r.code_warning) == ("so [CODE: my_total = a[0]\nprint(x)] end", True, None)


@pytest.mark.parametrize("text, second, third, pages, warned", [
    (FIRST, "EMP-ID emp-id = a[0] print(x)", BETTER, 1, segments.HYPHEN_WARNING),  # the second reading confirms it
    (FIRST, "[NO CODE]", BETTER, 1, segments.HYPHEN_WARNING), (FIRST, " ", BETTER, 1, segments.HYPHEN_WARNING),  # nothing to decide between
    (FIRST, OTHER, BETTER, 2, segments.HYPHEN_WARNING),  # two pages
    (FIRST + " [CODE: y]", OTHER, BETTER, 1, segments.HYPHEN_WARNING),  # two spans
    ("so [CODE: emp-id = a[0", OTHER, BETTER, 1, segments.HYPHEN_WARNING),  # not closed
    (FIRST, OTHER, "emp_id = a[0\nprint(x)", 1, segments.CODE_WARNING),  # brackets
    (FIRST, OTHER, "emp_id = a[0]\nprint(x)\n\n", 1, None), (FIRST, OTHER, "emp_id = a[0]\n\n\n\nprint(x)", 1, segments.CODE_WARNING),  # lines
    (FIRST, OTHER, "emp_no = a[0]\nprint(x)", 1, segments.CODE_WARNING),  # words
    (FIRST, OTHER, "emp_id = a[0] [CODE: print(x)]", 1, None), (FIRST, OTHER, "[NO CODE]", 1, segments.CODE_WARNING), (FIRST, OTHER, "", 1, segments.CODE_WARNING),
])
def test_refused_readings_of_code(spark, text, second, third, pages, warned):
    r = code(spark, text, second, third, pages)
    assert (r.reconciled, r.code_warning) == (warned is None and "CODE" not in third, warned if "CODE" not in third or third == "[NO CODE]" else segments.CODE_WARNING)
    assert r.text == text or r.reconciled


def math(spark, text, second, *third):
    one = lambda t: spark.createDataFrame([(1, 1, t)], "sheet_id long, base int, text string")
    pages = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(third)], "sheet_id long, base int, page_no int, text string")
    r = segments.apply_math_arbiter(one(text), one(second), pages).first()
    return r and (r.text, r.reconciled, r.math_warning)


def test_a_third_reading_of_formulas(spark):
    text = "x^2 = 4\nso the value follows from it = 3\n[CODE: a = 1]"
    assert math(spark, text, "x2 = 4", text.replace("x^2", "x2")) == (text.replace("x^2", "x2"), True, None)
    assert math(spark, text, "x^2=4 so the value follows from it = 3", text.replace("x^2", "x2")) is None  # confirmed
    assert math(spark, text, "x2 = 4", "x2 = 4") is None  # other number of lines
    assert math(spark, text, "x2 = 4", text.replace("the value", "a value")) is None  # prose stays
    assert math(spark, text, "x2 = 4", text.replace("x^2 = 4", "x")) == (text, False, segments.MATH_WARNING)  # shorter than half
    assert math(spark, text, "x2 = 4", text.replace("x^2 = 4", "[y] x2 = 4")) == (text, False, segments.MATH_WARNING)  # a tag more
    assert math(spark, text, "x2 = 4", text.replace("x^2 = 4", "cos x = 4"), text.replace("x^2", "x2")) == (text.replace("x^2", "x2"), True, None)  # the second page's fits
    assert math(spark, text, "[NO MATH]", text.replace("x^2", "x2")) is None
