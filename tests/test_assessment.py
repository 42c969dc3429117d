"""Literal cases of the pure rules, and every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marksmith.functions.labels import with_qid
from marksmith.functions.marks import is_valid_mark, quantize
from marksmith.operators import integrity, text
from marksmith.plans.fixtures import BASE_TABLES, fixture
from marksmith.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(rows, columns):
    def value(x):
        return None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(value(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLES:
        cursor = sql.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(cursor.fetchall(), names)


def test_labels(spark):
    cases = {
        "Q6": ("Q6", 6, ""), "Q 6": ("Q6", 6, ""), "Q.6": ("Q6", 6, ""), "Q-6": ("Q6", 6, ""), "A6": ("Q6", 6, ""), "Ans 6": ("Q6", 6, ""), "Answer 6": ("Q6", 6, ""), "Ques 6": ("Q6", 6, ""),
        "Question 6": ("Q6", 6, ""), "Sol 6": ("Q6", 6, ""), "S6": ("Q6", 6, ""), "Q06": ("Q6", 6, ""), "Q6.a": ("Q6.a", 6, ".a"), "1)": ("Q1", 1, ""), "(1)": ("Q1", None, ""), "AI10_Q37": ("Q37", 37, ""),
        "ii": ("ii", None, ""), "a": ("a", None, ""), "Section A": ("Section A", None, ""), "Q5(a)(i)": ("Q5(a)(i)", 5, "(a)(i)"),
    }
    rows = with_qid(spark.createDataFrame([(c,) for c in cases], "label string"), "label").collect()
    assert {r.label: (r.qid, r.base, r.sub) for r in rows} == cases


def test_marks(spark):
    cases = [("0.8", 1.0), ("0.3", 0.5), ("0.7", 0.5), ("0.25", 0.5), ("0.75", 1.0), ("-1", 0.0), ("x", 0.0), ("NaN", 0.0), ("Infinity", 0.0), (None, 0.0), ("2.2", 2.0), ("9", 3.0)]
    rows = spark.createDataFrame(cases, "v string, want double").select("want", quantize(F.col("v"), F.lit(3.0)).alias("got")).collect()
    assert all(r.got == r.want for r in rows)
    valid = spark.createDataFrame([("1.5",), ("0.8",), ("-1",), ("NaN",), (None,)], "v string").select(is_valid_mark(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in valid] == [True, False, False, False, False]


def test_effective_marks(spark):
    leaves = [
        (1, 34, "(a)(i)", 1.0), (1, 34, "(a)(ii)", 1.0), (1, 34, "(a)(iii)(I)", 1.0), (1, 34, "(a)(iii)(II)", 1.0), (1, 34, "(a)(iii)(III)", 1.0),
        (1, 34, "(b)(i)", 2.0), (1, 34, "(b)(ii)(I)", 1.0), (1, 34, "(b)(ii)(II)", 1.0), (1, 34, "(b)(ii)(III)", 1.0),
        (1, 37, "(a)", 1.0), (1, 37, "(b)", 1.0), (1, 37, "(c)(i)", 2.0), (1, 37, "(c)(ii)", 2.0), (1, 28, "(a)", 3.0), (1, 28, "(b)(i)", 2.0), (1, 28, "(b)(ii)", 0.5),
    ]
    members = [(1, 34, 0, "Q34(a)"), (1, 34, 1, "Q34(b)"), (1, 37, 0, "Q37(c)(i)"), (1, 37, 1, "Q37(c)(ii)"), (1, 28, 0, "Q28(a)"), (1, 28, 1, "Q28(b)")]
    leaf = spark.createDataFrame([(e, b, s, f"Q{b}{s}", m) for e, b, s, m in leaves], "exam_id int, base int, sub string, qid string, marks double")
    got = integrity.effective_marks(leaf, spark.createDataFrame(members, "exam_id int, base int, pos int, member string")).collect()
    assert {r.base: r.marks for r in got} == {34: 5.0, 37: 4.0, 28: 3.0}


def test_reconcile_raises_a_single_entry(spark):
    key = spark.createDataFrame([(1, "Q37", 37, 2.0), (1, "Q9", 9, 1.0)], "exam_id int, qid string, base int, marks double")
    paper = spark.createDataFrame([(1, 37, 4.0), (1, 5, 2.0)], "exam_id int, base int, marks double")
    rows = integrity.reconcile_marks(key, paper, spark.createDataFrame([(1, "raise")], "exam_id int, mode string")).collect()
    assert {(r.qid, r.old_marks, r.marks, r.action) for r in rows} == {("Q37", 2.0, 4.0, "adjusted"), ("Q9", 1.0, 1.0, "flagged"), ("Q5", 0.0, 2.0, "injected")}


def test_reconcile_holds_the_whole_key(spark):
    rows = QUERIES["e22_reconcile_whole_key"](spark, SF)
    entries = integrity.canonical_key(fixture(spark, SF, "key_entry"))
    print(f"{rows.where('action <> \'injected\'').count()} of {entries.count()}, with the cut {QUERIES['e22_reconcile_marks'](spark, SF).where('action <> \'injected\'').count()}")
    assert rows.where("action <> 'injected'").count() == entries.count()


def test_lookahead_is_text_and_not_the_header(spark):
    head = "Mathematics paper of 2024"
    pages = [("d", 1, f"{head}\none"), ("d", 2, f"{head}\n\n  two"), ("d", 3, head), ("d", 9000, f"{head}\nthree"), ("e", 1, "x"), ("e", 2, None)]
    rows = text.clean_lookahead(spark.createDataFrame(pages, "doc string, page long, text string"), 3).collect()
    assert {(r.doc, r.page, r.lookahead) for r in rows} == {("d", 1, "two"), ("d", 2, "thr"), ("d", 9000, ""), ("e", 1, "")}
