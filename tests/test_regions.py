"""Bands on ink against plain loops, and regions of pages: dense pages, stacked continuations, anchors that are null."""

import numpy as np
import pyarrow as pa
import pytest

from marksmith.operators import regions


def plain_snap(y, profile, eps):
    runs, start = [], None
    for k, v in enumerate([*profile, eps + 1]):
        if v <= eps and start is None:
            start = k
        elif v > eps and start is not None:
            runs.append((start, k))
            start = None
    best, distance = y, None
    for a, b in runs:
        d = 0 if a <= y < b else min(abs(y - a), abs(y - b + 1))
        if d <= regions.SNAP_WINDOW and (distance is None or d < distance):
            best, distance = (a + b) // 2, d
    return best


def plain_trim(profile, top, bottom, eps):
    inked = [k for k in range(max(0, top), min(bottom, len(profile))) if profile[k] > eps]
    return (max(0, inked[0] - regions.PAD), min(len(profile), inked[-1] + 1 + regions.PAD)) if inked else None


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 0.98, 1.0])
def test_ends_equal_plain_loops(share):
    rng = np.random.default_rng(int(share * 100))
    for h in (1, 7, 300, 1000):
        profile = np.where(rng.random(h) < share, rng.integers(0, 3, h), rng.integers(3, 40, h))
        page = regions.Ink(profile, 2, 5)
        for y in [0, h - 1, h, *rng.integers(0, h, 40).tolist()]:
            assert page.snap(y) == plain_snap(y, profile.tolist(), 2)
        for _ in range(40):
            top, bottom = sorted(rng.integers(-3, h + 5, 2).tolist())
            assert page.trim(top, bottom) == plain_trim(profile.tolist(), top, bottom, 5)


ANCHOR = "sheet_id long, page_no int, pos int, qid string, role string, y int"
INK = "sheet_id long, page_no int, profile array<int>, eps int, eps_content int"
#: Lines of 20 rows with 5 blank ones between.
LINES = [0 if k % 25 >= 20 else 9 for k in range(1000)]


def regions_of(spark, anchors, profile=LINES, **kw):
    rows = spark.createDataFrame([(1, 1, k, *a) for k, a in enumerate(anchors)], ANCHOR)
    ink = spark.createDataFrame([(1, 1, profile, 2, 2)] if profile is not None else [], INK)
    return {r.qid: (r.top, r.bottom, r.method, r.reason) for r in regions.page_regions(rows, ink, **kw).collect()}


def test_starts_run_to_the_next_and_the_last_to_the_bottom(spark):
    got = regions_of(spark, [("Q1", "start", 101), ("Q2", "start", 402), ("Q3", "start", None)])
    assert got["Q1"] == (92, 403, "band", "") and got["Q2"] == (392, 1000, "band", "") and got["Q3"] == (0, 1000, "page", "anchor rejected")


def test_answers_that_continue_are_stacked_above_the_first_start(spark):
    got = regions_of(spark, [("Q1", "continuation", 200), ("Q2", "continuation", 900), ("Q3", "start", 502)])
    assert got["Q1"][:3] == (0, 203, "band") and got["Q2"][:3] == (192, 503, "band") and got["Q3"][:3] == (492, 1000, "band")
    got = regions_of(spark, [("Q1", "continuation", 600), ("Q2", "continuation", 300), ("Q4", "continuation", None)])
    assert got["Q1"][2] == "band" and got["Q2"] == got["Q4"] == (0, 1000, "page", "anchor rejected")  # nothing is left below the first
    got = regions_of(spark, [("Q1", "continuation", None), ("Q3", "start", 502)])
    assert got["Q1"] == (0, 503, "band", "")  # alone above a start, it needs no end


def test_dense_blank_and_missing_pages(spark):
    many = [(f"Q{k}", "start", 10 * k) for k in range(1, 6)]
    assert set(regions_of(spark, many, most_starts=5).values()) == {(0, 1000, "page", "dense page")}
    assert set(regions_of(spark, many, profile=[0] * 1000).values()) == {(0, 1000, "page", "band had no ink")}
    assert set(regions_of(spark, many, profile=None).values()) == {(None, None, "page", "no page")}
    got = regions_of(spark, [("Q1", "start", 101), ("Q2", "start", 126)])
    assert got["Q1"][2:] == ("page", "implausible band")  # one line of 20 rows is too little
    ruled = [1 if k < 500 else 9 for k in range(1000)]
    thin = regions_of(spark, [("Q1", "start", 0), ("Q2", "start", 500)], profile=[v if k != 250 else 3 for k, v in enumerate(ruled)])
    assert thin["Q1"][2:] == ("page", "implausible band") and thin["Q2"][2] == "band"


def test_inks_of_a_batch():
    """Runs that end with their page, an empty profile, none at all, and a batch cut from a larger one."""
    profiles = [[9], [0, 5, 0, 0], [0, 0], [], None, [7, 0], [0, 9, 9]]
    column = pa.array(profiles, pa.list_(pa.int32())).slice(1)
    found = regions.inks(column, pa.array([0] * 6, pa.int32()), pa.array([5] * 6, pa.int32()))
    assert [x and (x.h, x.starts, x.ends, x.inked_rows.tolist()) for x in found] == [(4, [0, 2], [1, 4], []), (2, [0], [2], []), (0, [], [], []), None, (2, [1], [2], [0]), (3, [0], [1], [1, 2])]
