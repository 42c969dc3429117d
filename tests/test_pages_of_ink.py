"""Ends of bands are found for many pages at once, as they are for one; no profile is sorted or shuffled."""

import numpy as np
import pyarrow as pa
import pytest

from marksmith.operators import regions
from marksmith.plans.fixtures import fixture
from marksmith.plans.queries import QUERIES

from .test_regions import plain_snap, plain_trim
from .test_texts import SF, exchanged


def test_pages_at_once_equal_plain_loops():
    rng = np.random.default_rng(3)
    made = [np.where(rng.random(h) < share, rng.integers(0, 3, h), rng.integers(3, 40, h)).tolist() for h in (0, 1, 30, 400, 700) for share in (0.0, 0.1, 0.97, 1.0)]
    profiles, eps, content = [None, *made], [2, *rng.integers(1, 4, len(made)).tolist()], [2, *rng.integers(3, 6, len(made)).tolist()]
    pages = regions.Pages(pa.array(profiles, pa.list_(pa.int32())), pa.array(eps, pa.int32()), pa.array(content, pa.int32()))
    at = rng.integers(0, len(profiles), 900)
    ends = np.sort(rng.integers(-5, 720, (900, 2)), 1)
    (lo, hi, found), snapped = pages.trim(at, ends[:, 0], ends[:, 1]), pages.snap(at, ends[:, 0])
    refused = pages.refused(at, np.clip(ends[:, 0], 0, pages.h[at]), np.clip(ends[:, 1], 0, pages.h[at]), at % 2 == 0)
    for k, p in enumerate(at):
        profile, (top, bottom) = profiles[p] or [], ends[k].tolist()
        assert snapped[k] == plain_snap(top, profile, eps[p])
        assert ((lo[k], hi[k]) if found[k] else None) == plain_trim(profile, top, bottom, content[p])
        inside = [min(max(y, 0), len(profile)) for y in (top, bottom)]
        assert refused[k] == regions.Ink(np.array(profile, int), eps[p], content[p]).refused(*inside, p % 2 == 0)


BAND, INK = "sheet_id long, page_no int, qid string, top int, bottom int", "sheet_id long, page_no int, profile array<int>, eps int"


def test_measured_bands_are_judged_without_their_ink(spark):
    """What accept_bands makes of measured bands is what it makes of the ink itself: questions that aren't placed, bands without ink, too low, whole, of pages without a profile."""
    lines = [0 if k % 25 >= 20 else 9 for k in range(1000)]
    ink = spark.createDataFrame([(1, 1, lines, 2), (1, 2, [0] * 900 + [9] * 100, 2), (2, 1, lines, 2), (3, 1, [], 2), (3, 2, None, 2), (5, 1, lines, 2)], INK)
    band = [(1, 1, "Q1", 100, 400), (1, 1, "Q2", 400, 1000), (1, 2, "Q1", 0, 500), (1, 2, "Q2", 940, 1000), (2, 1, "Q1", 0, 1000), (5, 1, "Q1", 22, 47), (3, 1, "Q1", 0, 10), (3, 2, "Q1", 0, 10), (4, 1, "Q1", 0, 10)]
    unplaced = [(1, 1, "Q3", None, None), (2, 1, "Q4", None, 1000)]
    bands, every = spark.createDataFrame(band, BAND), spark.createDataFrame(band + unplaced, BAND)
    short = regions.accept_bands(regions.fit_bands(every, ink, measured=True), ink)
    fitted = regions.fit_bands(bands, ink)
    long = regions.accept_bands(fitted, ink, every.select("sheet_id", "page_no", "qid"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert short.columns == long.columns and rows(short) == rows(long) and len(rows(short)) == 8
    assert {r.reason for r in short.collect()} == {"", "not placed", "band had no ink", "implausible band"}


@pytest.mark.parametrize("name", ["g4_fit_bands", "g6_accept_bands", "g6_page_regions"])
def test_pages_meet_their_ink_where_their_sheet_is(spark, name):
    made = QUERIES[name](spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan
    assert all("l_orderkey" in c for c in exchanged(made)) and len(exchanged(made)) == 2


def test_questions_by_sheet_are_those_of_the_union(spark):
    whole, dealt = fixture(spark, SF, "page_question"), fixture(spark, SF, "page_question_by_sheet", {"lineitem": "l_orderkey"})
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.select(whole.columns).collect()))
