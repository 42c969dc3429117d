"""Where an answer stands on its page: anchors checked and saved, bands fitted to the ink, boxes of figures."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scale of anchors and the limits of bands and boxes.
SCALE, SNAP_WINDOW, PAD, LEAST_BAND, LEAST_INK_ROWS, PEAK_SHARE, WHOLE_PAGE = 1000, 80, 8, 40, 6, 0.10, 0.98
LEAST_AREA, MOST_AREA, LEAST_SIDE, MOST_ASPECT, PAD_SHARE = 0.02, 0.20, 40.0, 6.0, 0.012
MOST_STARTS = 99
#: Pages whose ink is looked at together: few enough for a processor's cache.
PAGES = 256
PAGE = ("sheet_id", "page_no")


def anchors(page_anchor: DataFrame) -> DataFrame:
    """page_anchor (sheet_id, page_no, wanted array of qid, ys array of string) to one row a question: qid, pos, y, exact.

    exact where all are integers in 0 to 1000 and rise. Otherwise values out of range are dropped, equal neighbours
    both, then any that doesn't rise above the last kept; unless two thirds are left, none is kept.
    """
    n = F.size("wanted")
    number = F.transform(F.sequence(F.lit(1), n), lambda k: F.get("ys", k - 1).try_cast("int"))
    rows = page_anchor.where(n > 0).withColumn("v", F.transform(number, lambda y: F.when(y.between(0, SCALE), y)))
    untied = F.transform("v", lambda y, k: F.when(F.coalesce(y == F.get("v", k - 1), F.lit(False)) | F.coalesce(y == F.get("v", k + 1), F.lit(False)), F.lit(None)).otherwise(y))
    rows = rows.withColumn("v2", untied)
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(-1).alias("last"))
    keep = lambda a, y: F.struct(F.array_append(a["kept"], F.when(y > a["last"], y)).alias("kept"), F.when(y > a["last"], y).otherwise(a["last"]).alias("last"))
    rows = rows.withColumn("salvaged", F.aggregate("v2", start, keep)["kept"])
    exact = (F.size("ys") == n) & ~F.exists("salvaged", lambda y: y.isNull())
    enough = 3 * F.size(F.array_compact("salvaged")) >= 2 * n
    rows = rows.withColumns({"exact": exact, "y": F.when(enough, F.col("salvaged"))})
    each = rows.select(*PAGE, "exact", "y", F.posexplode("wanted").alias("pos", "qid"))
    return each.select(*PAGE, "qid", "pos", F.get("y", F.col("pos")).alias("y"), "exact")


class Ink:
    """A page's rows of ink: blank runs, and sums of inked rows, so that both ends of a band are found by search."""

    def __init__(self, profile: np.ndarray, eps: int, eps_content: int):
        edge = np.diff(np.concatenate([[0], (profile <= eps).astype(np.int8), [0]]))
        self._hold(profile, np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), np.flatnonzero(profile > eps_content))

    def _hold(self, profile: np.ndarray, starts: list[int], ends: list[int], inked_rows: np.ndarray) -> Ink:
        self.h, self.profile, self.starts, self.ends, self.inked_rows = len(profile), profile, starts, ends, inked_rows
        return self

    def snap(self, y: int) -> int:
        """The middle of the nearest blank run within SNAP_WINDOW rows, of equally near ones the upper; else y."""
        k = bisect_right(self.ends, y)  # the run that y is in, or the first below it
        best, distance = y, SNAP_WINDOW + 1
        for i in (k - 1, k):
            if 0 <= i < len(self.starts):
                a, b = self.starts[i], self.ends[i]
                d = 0 if a <= y < b else min(abs(y - a), abs(y - b + 1))
                if d < distance:
                    best, distance = (a + b) // 2, d
        return best

    def trim(self, top: int, bottom: int) -> tuple[int, int] | None:
        """The band from its first inked row to its last, PAD rows around them; None without ink."""
        top, bottom = max(0, top), min(bottom, self.h)
        first, after = self.inked_rows.searchsorted((top, bottom))
        if bottom <= top or first == after:
            return None
        return max(0, int(self.inked_rows[first]) - PAD), min(self.h, int(self.inked_rows[after - 1]) + 1 + PAD)

    def refused(self, top: int, bottom: int, several: bool) -> bool:
        first, after = self.inked_rows.searchsorted((top, bottom))
        peak, page_peak = (int(x.max()) if len(x) else 0 for x in (self.profile[top:bottom], self.profile))
        high = bottom - top
        return high < LEAST_BAND or (several and high >= self.h * WHOLE_PAGE) or after - first < LEAST_INK_ROWS or peak < page_peak * PEAK_SHARE


class Pages:
    """The ink of many pages (profile, eps and eps_content of each) in common arrays: ends of bands are found for all of them at once. Rows of ink are counted over all pages."""

    def __init__(self, profiles: pa.ListArray, eps: pa.Array, eps_content: pa.Array):
        sized = profiles.value_lengths()
        self.there = pc.fill_null(pc.greater(sized, 0), False).to_numpy(zero_copy_only=False)
        self.h = sized.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ink = profiles.flatten().to_numpy(zero_copy_only=False)
        self.at = np.concatenate([[0], np.cumsum(self.h)])
        # runs of rows that are blank, and of rows that aren't inked
        self.starts, self.ends = self._runs(self.ink <= self._limit(eps))
        same = eps.equals(eps_content)
        self.bare_starts, self.bare_ends = (self.starts, self.ends) if same else self._runs(self.ink <= self._limit(eps_content))
        self.bare_before = np.concatenate([[0], np.cumsum(self.bare_ends - self.bare_starts)])
        self.runs = self.starts.searchsorted(self.at)

    def _runs(self, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs begin and end; a run ends with its page."""
        turns, cuts = np.flatnonzero(blank[1:] != blank[:-1]) + 1, self.at
        begins = np.concatenate([turns, cuts[cuts < len(blank)]])
        finishes = np.concatenate([turns, cuts[cuts > 0]])
        return np.unique(begins[blank[begins]]), np.unique(finishes[blank[finishes - 1]])

    def _limit(self, values: pa.Array) -> np.ndarray:
        """Each row's limit, or the one that all have."""
        each = values.fill_null(0).to_numpy(zero_copy_only=False)
        return each[:1] if len(each) and (each == each[0]).all() else np.repeat(each, self.h)

    def snap(self, page: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The middle of the nearest blank run within SNAP_WINDOW rows, of equally near ones the upper; else y."""
        at, low, high = self.at[page], self.runs[page], self.runs[page + 1]
        k = np.clip(self.ends.searchsorted(at + y, "right"), low, high)  # the run that y is in, or the first below it
        best, distance = y.copy(), np.full(len(y), SNAP_WINDOW + 1)
        for i in (k - 1, k):
            there = (i >= low) & (i < high)
            run = np.where(there, i, 0)
            a, b = (x[run] - at if len(x) else np.zeros(len(y), np.int64) for x in (self.starts, self.ends))
            d = np.where((a <= y) & (y < b), 0, np.minimum(np.abs(y - a), np.abs(y - b + 1)))
            nearer = there & (d < distance)
            best, distance = np.where(nearer, (a + b) // 2, best), np.where(nearer, d, distance)
        return best

    def trim(self, page: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands from their first inked rows to their last, PAD rows around them, and whether they have ink; without, the ends mean nothing."""
        at, h = self.at[page], self.h[page]
        top, bottom = np.maximum(0, top), np.minimum(bottom, h)
        lo, hi = (at + np.clip(y, 0, h) for y in (top, bottom))
        first, after = self._past(lo, True), self._past(hi - 1, False) + 1
        found = (lo < hi) & (first < after)
        return np.maximum(0, first - at - PAD), np.minimum(h, after - at + PAD), found

    def _past(self, y: np.ndarray, down: bool) -> np.ndarray:
        """The row itself if it is inked, else the one behind its run downwards, or before it."""
        if not len(self.bare_starts):
            return y
        k = np.minimum(self.bare_ends.searchsorted(y, "right"), len(self.bare_ends) - 1)
        inside = (self.bare_starts[k] <= y) & (y < self.bare_ends[k])
        return np.where(inside, self.bare_ends[k] if down else self.bare_starts[k] - 1, y)

    def _inked_before(self, y: np.ndarray) -> np.ndarray:
        k = self.bare_ends.searchsorted(y, "right")
        begun = np.append(self.bare_starts, len(self.ink))[k]
        return y - self.bare_before[k] - np.maximum(0, y - begun)

    def refused(self, page: np.ndarray, top: np.ndarray, bottom: np.ndarray, several: np.ndarray) -> np.ndarray:
        inked, peak, page_peak = self.measured(page, top, bottom)
        high = bottom - top
        return (high < LEAST_BAND) | (several & (high >= self.h[page] * WHOLE_PAGE)) | (inked < LEAST_INK_ROWS) | (peak < page_peak * PEAK_SHARE)

    def measured(self, page: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inked rows and peak of ink of bands, and the peak of their pages; 0 where there are no rows."""
        at, h, ink = self.at[page], self.h[page], np.append(self.ink, 0)
        inside = [at + np.clip(y, 0, h) for y in (top, bottom)]
        lo, hi = (at + np.clip(np.where(y < 0, y + h, y), 0, h) for y in (top, bottom))
        peaks = lambda a, b: np.where(a < b, np.maximum.reduceat(ink, np.stack([a, np.maximum(a, b)], 1).ravel())[::2], 0) if len(a) else np.zeros(0, np.int64)
        return np.maximum(0, self._inked_before(inside[1]) - self._inked_before(inside[0])), peaks(lo, hi), peaks(self.at[:-1], self.at[1:])[page]


def inks(profiles: pa.ListArray, eps: pa.Array, eps_content: pa.Array) -> list[Ink | None]:
    """The Ink of each page (its profile, eps and eps_content), None without a profile."""
    found, made = Pages(profiles, eps, eps_content), []
    inked = np.flatnonzero(found.ink > found._limit(eps_content))
    rows = inked.searchsorted(found.at)
    for k, there in enumerate(profiles.is_valid().to_pylist()):
        lo, (a, b), (c, d) = found.at[k], found.runs[k : k + 2], rows[k : k + 2]
        made.append(Ink.__new__(Ink)._hold(found.ink[lo : found.at[k + 1]], (found.starts[a:b] - lo).tolist(), (found.ends[a:b] - lo).tolist(), inked[c:d] - lo) if there else None)
    return made


Read = Callable[[Pages, np.ndarray, dict[str, pa.Array]], tuple[np.ndarray, list[pa.Array]]]


def _by_page(rows: DataFrame, item: list[str], ink: DataFrame, schema: str, read: Read, how: str = "inner") -> DataFrame:
    """What ``read`` makes of pages' rows (their ``item`` columns): it gets the ink of many pages, and of all their rows the page's place among these and the columns, and gives columns of its own behind
    the page's place.

    A page is a row to Spark. Pages meet their ink by sheet, so what is dealt by sheet isn't shuffled, and are the side that is held: no profile is sorted.
    """
    content = F.col("eps_content") if "eps_content" in ink.columns else F.col("eps")
    listed = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("items")).hint("shuffle_hash")
    of = ink.select(F.col("sheet_id").alias("_sheet"), F.col("page_no").alias("_page"), "profile", "eps", content.alias("eps_content"))
    pages = listed.join(of, (F.col("sheet_id") == F.col("_sheet")) & (F.col("page_no") - F.col("_page") == 0), how)
    out = pa.schema([("sheet_id", pa.int64()), ("page_no", pa.int32()), *[(n, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in schema.split(", "))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES)):
            if how == "inner":
                batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column("profile")), 0), False))
            found = Pages(*[batch.column(c) for c in ("profile", "eps", "eps_content")])
            items = batch.column("items")
            flat = items.flatten()
            at, made = read(found, np.repeat(np.arange(batch.num_rows), items.value_lengths().to_numpy()), dict(zip([f.name for f in flat.type], flat.flatten())))
            if len(at):
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(place) for c in PAGE], *[c.cast(f.type) for c, f in zip(made, list(out)[2:])]], schema=out)

    typed = pages.withColumns({"sheet_id": F.col("sheet_id").cast("long"), "page_no": F.col("page_no").cast("int"), "profile": F.col("profile").cast("array<int>")})
    return typed.select(*PAGE, "items", "profile", "eps", "eps_content").mapInArrow(run, f"sheet_id long, page_no int, {schema}")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's values, 0 for none, and whether there is one."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def fit_bands(band: DataFrame, ink: DataFrame, measured: bool = False) -> DataFrame:
    """Bands (sheet_id, page_no, qid, top, bottom in rows) whose ends, but for the page's bottom, are snapped to the middle of the nearest blank run, trimmed to inked rows.

    ink (sheet_id, page_no, profile array of int, eps and perhaps eps_content): a row with no more than eps of ink is blank, one with more than eps_content (eps, if not given)
    is inked. A band without ink has null ends; bands of pages without a profile aren't in the result.

    With ``measured`` come also what accept_bands asks for (MEASURES); there, a row without top is a question that isn't placed.
    """

    def read(pages: Pages, page: np.ndarray, x: dict[str, pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
        (top, placed), (bottom, _), h = _numbers(x["top"]), _numbers(x["bottom"]), pages.h[page]
        lo, hi, found = pages.trim(page, pages.snap(page, top), np.where(bottom < h, pages.snap(page, bottom), h))
        ends = [pa.array(v, pa.int32(), mask=~(found & placed)) for v in (lo, hi)]
        return page, [x["qid"], *ends, *(_measures(pages, page, placed, lo, hi) if measured else [])]

    return _by_page(band, ["qid", "top", "bottom"], ink, "qid string, top int, bottom int" + (f", {MEASURES}" if measured else ""), read)


REGION = "qid string, top int, bottom int, method string, reason string"
#: Of a question, whether it has a band, and its page's bands and height; of its band, inked rows and peak of ink, and its page's peak.
MEASURES = "placed boolean, bands int, height int, inked int, peak int, page_peak int"


def _measures(pages: Pages, page: np.ndarray, placed: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> list[pa.Array]:
    bands = np.bincount(page[placed], minlength=len(pages.h))
    return [pa.array(v) for v in (placed, bands[page], pages.h[page], *pages.measured(page, top, bottom))]


def accept_bands(fitted: DataFrame, ink: DataFrame, page_role: DataFrame | None = None) -> DataFrame:
    """region (sheet_id, page_no, qid, top, bottom, method, reason) for every question of page_role: its band, or the full page and why.

    A band is taken when it is high enough, isn't the whole of a page with several, has inked rows, and a peak of ink
    in relation to the page's. Without page_role, ``fitted`` is measured (fit_bands) and has a row for each question, so the ink isn't read again.
    """
    if page_role is not None:
        every = page_role.select(*PAGE, "qid").distinct().join(fitted.select(*PAGE, "qid", "top", "bottom").withColumn("_in", F.lit(True)), [*PAGE, "qid"], "left")

        def read(pages: Pages, page: np.ndarray, x: dict[str, pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
            placed = x["_in"].is_valid().to_numpy(zero_copy_only=False)
            return page, [x["qid"], x["top"], x["bottom"], *_measures(pages, page, placed, _numbers(x["top"])[0], _numbers(x["bottom"])[0])]

        fitted = _by_page(every, ["qid", "top", "bottom", "_in"], ink, f"qid string, top int, bottom int, {MEASURES}", read)
    high = F.col("bottom") - F.col("top")
    refused = (high < LEAST_BAND) | ((F.col("bands") > 1) & (high >= F.col("height") * WHOLE_PAGE)) | (F.col("inked") < LEAST_INK_ROWS) | (F.col("peak") < F.col("page_peak") * PEAK_SHARE)
    reason = F.when(~F.col("placed"), "not placed").when(F.col("top").isNull(), "band had no ink").when(refused, "implausible band").otherwise("")
    taken = F.col("reason") == ""
    ends = [F.when(taken, F.col("top")).otherwise(0).alias("top"), F.when(taken, F.col("bottom")).otherwise(F.col("height")).alias("bottom")]
    return fitted.withColumn("reason", reason).select(*PAGE, "qid", *ends, F.when(taken, "band").otherwise("page").alias("method"), "reason")


def page_regions(anchor: DataFrame, ink: DataFrame, most_starts: int = MOST_STARTS) -> DataFrame:
    """region (sheet_id, page_no, qid, top, bottom, method, reason) for each answer on a page.

    anchor (sheet_id, page_no, pos, qid, role, y): answers that start on the page, y where they begin, and such that continue from an earlier one, y where they end, both in
    thousandths of its height, null where none could be kept. Starts run to the next start, the last to the page's bottom. Answers that continue lie one below the other
    in the region above the first start; if there is one alone, above a start, it fills that region and needs no y. A page with
    ``most_starts`` starts or more isn't cut. Pages without a profile have regions without ends.
    """

    def read(pages: Pages, page: np.ndarray, x: dict[str, pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
        n, h, there = len(pages.h), pages.h[page], pages.there[page]
        is_role = lambda role: pc.fill_null(pc.equal(x["role"], role), False).to_numpy(zero_copy_only=False)
        start, goes_on, (y, has_y) = is_role("start"), is_role("continuation"), _numbers(x["y"])
        count = lambda flag: np.bincount(page[flag], minlength=n)
        starts = count(start)
        dense = (starts >= most_starts)[page]
        cut = there & ~dense
        row = pages.snap(page, (y / SCALE * h).astype(np.int64))
        # starts, from above: each runs to the next of its page
        tops = np.flatnonzero(start & has_y & cut)
        tops = tops[np.lexsort((tops, row[tops], page[tops]))]
        last = np.append(page[tops][1:] != page[tops][:-1], True) if len(tops) else np.zeros(0, bool)
        below = np.where(last, pages.h[page[tops]], np.append(row[tops][1:], 0) if len(tops) else 0)
        region = pages.h.copy()
        first = np.append(True, last[:-1]) if len(tops) else last
        region[page[tops[first]]] = row[tops[first]]
        # answers that go on: each from the lowest end before it
        lone = ((count(goes_on) == 1) & (starts > 0))[page]
        on = np.flatnonzero(goes_on & cut)
        step = page[on] * (pages.h.max(initial=0) + 1)
        end = np.where(lone[on], region[page[on]], np.where(has_y[on], np.maximum(0, np.minimum(row[on], region[page[on]])), 0))
        so_far = np.maximum.accumulate(end + step) - step if len(on) else end
        above = np.where(np.append(True, page[on][1:] != page[on][:-1]), 0, np.append(0, so_far[:-1])) if len(on) else end
        kept = lone[on] | (end > above)
        of = np.concatenate([on[kept], tops])
        a, b = np.concatenate([above[kept], row[tops]]), np.concatenate([end[kept], below])
        several = (np.bincount(page[of], minlength=n) > 1)[page[of]]
        lo, hi, found = pages.trim(page[of], a, b)
        taken = found & ~pages.refused(page[of], lo, hi, several)
        why = np.where(taken, "", np.where(found, "implausible band", "band had no ink"))
        # the others of these pages, but for questions that are placed
        code = x["qid"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = page * (code.max(initial=0) + 1) + code
        rest = np.flatnonzero(~there | dense | ~np.isin(key, key[of]))
        rest_why = np.where(~there[rest], "no page", np.where(dense[rest], "dense page", "anchor rejected"))
        full = h[of]
        tops_out = np.concatenate([np.where(taken, lo, 0), np.zeros(len(rest), np.int64)])
        bottoms_out = np.concatenate([np.where(taken, hi, full), h[rest]])
        unknown = np.concatenate([np.zeros(len(of), bool), ~there[rest]])
        every = np.concatenate([of, rest])
        method = pa.array(np.concatenate([np.where(taken, "band", "page"), np.full(len(rest), "page")]).astype(object), pa.string())
        reason = pa.array(np.concatenate([why, rest_why]).astype(object), pa.string())
        return page[every], [x["qid"].take(pa.array(every)), pa.array(tops_out, pa.int32(), mask=unknown), pa.array(bottoms_out, pa.int32(), mask=unknown), method, reason]

    return _by_page(anchor, ["pos", "qid", "role", "y"], ink, REGION, read, "left")


BOXES = "array<struct<bbox_2d:array<double>,xmin:double,ymin:double,xmax:double,ymax:double>>"


def pick_boxes(box: DataFrame) -> DataFrame:
    """figure_box (sheet_id, page_no, x0, y0, x1, y1, reason) in pixels: the largest box of a reply (sheet_id, page_no, reply, page_w, page_h) that can be a figure.

    Replies give bbox_2d or xmin .. ymax in thousandths, one object or a list, perhaps within other text. Boxes that are
    too small, too large or far wider than high are no figures; the reason is that of the last one refused.
    """
    text = F.trim("reply")
    listed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), BOXES)
    single = F.from_json(F.concat(F.lit("["), F.regexp_extract(text, r"(?s)^(\{.*\})$", 1), F.lit("]")), BOXES)
    boxes = F.when(text.startswith("{"), single).otherwise(listed)
    numbers = F.transform(boxes, lambda b: F.coalesce(F.when(F.size(b["bbox_2d"]) == 4, b["bbox_2d"]), F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"])))
    whole = F.filter(numbers, lambda v: ~F.exists(v, lambda x: x.isNull()))

    def judged(v: Column, pos: Column) -> Column:
        a, c, b, d = (f(v[i], v[i + 2]) for i in (0, 1) for f in (F.least, F.greatest))
        w, h = c - a, d - b
        area = w * h / SCALE / SCALE
        aspect = (w / SCALE * F.col("page_w")) / F.greatest(F.lit(1.0), h / SCALE * F.col("page_h"))
        refused = (
            F.when((w < LEAST_SIDE) & (h < LEAST_SIDE), "too small").when(area < LEAST_AREA, "a stray mark").when(area > MOST_AREA, "text, not a figure").when(aspect > MOST_ASPECT, "a line of text")
        )
        return F.when((w > 0) & (h > 0), F.struct(area.alias("area"), (-pos).alias("p"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), refused.alias("refused")))

    # each reply is judged within its row, and a page is grouped once; its replies are one, as a rule
    sized = F.col("page_w").isNotNull() & F.col("page_h").isNotNull()
    each = box.select(*PAGE, "page_w", "page_h", F.when(sized, F.array_compact(F.transform(whole, judged))).alias("boxes"))
    best = F.array_max(F.filter("boxes", lambda x: x["refused"].isNull()))
    last = F.array_max(F.transform(F.filter("boxes", lambda x: x["refused"].isNotNull()), lambda x: F.struct((-x["p"]).alias("pos"), x["refused"].alias("refused"))))
    every = each.select(*PAGE, "page_w", "page_h", best.alias("k"), last.alias("l")).groupBy(*PAGE, "page_w", "page_h").agg(F.max("k").alias("k"), F.max("l")["refused"].alias("refused"))
    pad = PAD_SHARE * F.greatest("page_w", "page_h")
    low = lambda c, size: F.greatest(F.lit(0), (F.col(f"k.{c}") / SCALE * F.col(size) - pad).cast("int"))
    far = lambda c, size: F.least(F.col(size), (F.col(f"k.{c}") / SCALE * F.col(size) + pad).cast("int"))
    reason = F.when(F.col("k").isNotNull(), "").otherwise(F.coalesce("refused", F.lit("no diagram found")))
    has = F.col("k").isNotNull()
    return every.select(*PAGE, *[F.when(has, c).alias(n) for c, n in ((low("a", "page_w"), "x0"), (low("b", "page_h"), "y0"), (far("c", "page_w"), "x1"), (far("d", "page_h"), "y1"))], reason.alias("reason"))
