"""Pieces of an answer: balanced tags, typed segments, and a third reading spliced in place of code or formulas.

Brackets are followed by a fold over a text's bracket-led pieces, which keeps the depth, so a tag's span may run over many lines and hold brackets of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,stop:int,terminated:boolean>>"
#: Words that begin lines of code, those that make a lone line code, symbols of elements, and the signs of drawings and formulas.
PYTHON_WORDS = "def class for while if elif else try except finally with return import from print lambda yield raise assert global nonlocal del async await function public private static void".split()
SQL_WORDS = "SELECT INSERT UPDATE DELETE CREATE ALTER DROP TRUNCATE GRANT REVOKE".split()
SURE_WORDS = "def class import from SELECT INSERT UPDATE DELETE CREATE ALTER DROP".split()
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th U"
).split()
BONDS, MATH_SIGNS = "-–—=≡|/\\", "√∑∏∫≤≥≠≈≡±×÷π∞°"
NO_CODE, NO_MATH = "[NO CODE]", "[NO MATH]"
#: What the warnings say.
CODE_WARNING = "The two OCR passes disagree on the symbols in this code and the difference could not be resolved automatically; check the code against the sheet."
HYPHEN_WARNING = "A hyphen appears inside an identifier, which is usually an underscore misread as '-'; check the code against the sheet."
MATH_WARNING = "The two OCR passes disagree on the symbols in this answer and the difference could not be resolved automatically; check the working against the sheet."
LEAST_CODE_LINES, CODE_SHARE = 3, 0.7
BLANK = " \t\r\n"


def spans(text: Column) -> Column:
    """SPAN: [CODE: and [DIAGRAM: tags, brackets inside them balanced; one that never closes runs to the end."""
    pieces = F.split(text, r"(?=[\[\]])")
    start = F.expr("named_struct('at', 0, 'depth', 0, 'open', 0, 'kind', '', 'found', array())").cast(f"struct<at:int,depth:int,open:int,kind:string,found:{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        kind = F.regexp_extract(piece, r"^\[(CODE|DIAGRAM):", 1)
        inside, opens, closes = acc["depth"] > 0, piece.startswith("["), piece.startswith("]")
        depth = F.when(inside, acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).otherwise(F.when(kind != "", 1).otherwise(0))
        ended = inside & (depth == 0)
        span = F.struct(acc["kind"].alias("kind"), acc["open"].alias("start"), (acc["at"] + 1).alias("stop"), F.lit(True).alias("terminated"))
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"), depth.alias("depth"), F.when(inside, acc["open"]).otherwise(acc["at"]).alias("open"), F.when(inside, acc["kind"]).otherwise(kind).alias("kind"),
            F.when(ended, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"),
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["kind"].alias("kind"), acc["open"].alias("start"), acc["at"].alias("stop"), F.lit(False).alias("terminated"))
        return F.when(acc["depth"] > 0, F.array_append(acc["found"], rest)).otherwise(acc["found"])

    return F.when(text.rlike(r"\[(?:CODE|DIAGRAM):"), F.aggregate(pieces, start, step, finish)).otherwise(F.array().cast(SPAN))


def inner(text: Column, span: Column) -> Column:
    """What a span holds behind its tag and before its closing bracket."""
    begin = span["start"] + F.length(span["kind"]) + 2
    return F.substring(text, begin + 1, span["stop"] - F.when(span["terminated"], 1).otherwise(0) - begin)


def tag_spans(answer: DataFrame) -> DataFrame:
    """(sheet_id, base, kind, start, stop, inner, terminated) of [CODE: and [DIAGRAM: spans, brackets inside them balanced."""
    rows = answer.withColumn("_spans", spans(F.col("answer"))).select("sheet_id", "base", "answer", F.explode("_spans").alias("s"))
    return rows.select("sheet_id", "base", "s.kind", "s.start", "s.stop", F.trim(inner(F.col("answer"), F.col("s")), F.lit(BLANK)).alias("inner"), "s.terminated")


def is_balanced(text: Column) -> Column:
    """Whether square brackets of a text close in order."""
    marks = F.split(F.regexp_replace(text, r"[^\[\]]", ""), "")
    depth = F.aggregate(marks, F.lit(0), lambda d, c: F.when(d < 0, d).when(c == "[", d + 1).when(c == "]", d - 1).otherwise(d))
    return depth == 0


# --- segments ---

_PLAIN_WORDS = "|".join(PYTHON_WORDS)
_CODE_LINE = "|".join([
    rf"(?:{_PLAIN_WORDS})\b", rf"(?i:{'|'.join(SQL_WORDS)})\b", r"(?i:import\s+[\w.]+|from\s+[\w.]+\s+import\b)",  # a keyword
    r"[A-Za-z_][\w.]*\s*=\s*[\[({]", r"[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*\s*=\s*(?:[\"']|.*\.[A-Za-z_]\w*\s*\()",  # a collection, text or method's result is named
    r"[A-Za-z_][\w.]*\s*\.[A-Za-z_]\w*\s*\(", r"[A-Za-z_][\w.]*\s*\([^=<>]*\)\s*:", r"[A-Za-z_]\w*_\w*\s*\(",  # a call
])
_SURE_LINE = rf"(?i)^\s*(?:(?:{'|'.join(SURE_WORDS)})\b|print\s*\()"
_LABELS = r"^(?:\s*(?:\([A-Za-z0-9]{1,4}\)\s*|[A-Za-z0-9]{1,4}[.)](?:\s+|\s*$)))+"
_DRAWN = rf"^(?:\s|[{BONDS.replace(chr(92), chr(92) * 2)}#+.,*()\[\]]|[0-9₀-₉·]|{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})+$"
_BOND_ROW = r"^[\s|/\\]*[|/\\][\s|/\\]*$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _islands(items: Column, key: Callable[[Column], Column]) -> Column:
    """Stretches of items over which ``key``, never null, stays the same."""
    cut = lambda held: F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (key(F.get(held, i)) != key(F.get(held, i - 1))))
    piece = lambda held, starts: F.transform(starts, lambda at, k: F.slice(held, at + 1, F.coalesce(F.get(starts, k + 1), F.size(held)) - at))
    return _let(items, lambda held: _let(cut(held), lambda starts: piece(held, starts)))


def _line_pieces(text: Column) -> Column:
    """array<struct<kind, text>> of a text between tagged spans, by its lines; all within the row, so no line is shuffled or sorted."""
    named = lambda kind, x: F.struct(kind.alias("kind"), x["line"].alias("line"))
    is_code = lambda x: F.coalesce(x["code"], F.lit(False))
    places = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: is_code(F.get(lines, i)))

    def told(line: Column) -> Column:
        drawn = (F.trim(line, F.lit(BLANK)) != "") & line.rlike(_DRAWN) & line.rlike(rf"[A-Za-z{BONDS.replace(chr(92), chr(92) * 2)}]")
        looks = lambda core: core.rlike(rf"^\s*(?:{_CODE_LINE})") | line.rlike(r"^(?:\t| {4,})\S")
        code = _let(F.regexp_replace(line, _LABELS, ""), lambda core: F.when(F.trim(core, F.lit(BLANK)) != "", looks(core)))
        return F.struct(line.alias("line"), drawn.alias("drawn"), code.alias("code"))

    def built(stretch: Column) -> Column:
        """A stretch with whether it is a structure."""
        structure = F.get(stretch, F.lit(0))["drawn"] & (F.size(stretch) >= 2) & F.exists(stretch, lambda x: x["line"].rlike(_BOND_ROW))
        return _let(structure, lambda held: F.transform(stretch, lambda x: F.struct(x["line"].alias("line"), x["code"].alias("code"), held.alias("structure"))))

    def between(lines: Column, held: Callable[[Column], Column]) -> Column:
        """Lines as code from the first to the last that look like it, where ``held`` of their places says so; else as text."""
        inside = lambda i, at: F.coalesce(held(at) & (i >= F.get(at, F.lit(0))) & (i <= F.get(at, F.size(at) - 1)), F.lit(False))
        return _let(places(lines), lambda at: F.transform(lines, lambda x, i: named(F.when(inside(i, at), "code").otherwise("text"), x)))

    def coded(block: Column) -> Column:
        n_code, n_told = F.size(F.filter(block, is_code)), F.size(F.filter(block, lambda x: x["code"].isNotNull()))
        mostly = (n_code >= LEAST_CODE_LINES) & (n_code / n_told >= CODE_SHARE)
        sure = lambda lines, at: (F.size(at) >= 2) | F.get(lines, F.get(at, F.lit(0)))["line"].rlike(_SURE_LINE)
        reaches = _islands(block, lambda x: F.coalesce(x["code"], F.lit(True)))  # lines that are no code part the reaches
        return F.when(mostly, between(block, lambda at: F.lit(True))).otherwise(F.flatten(F.transform(reaches, lambda lines: between(lines, lambda at: sure(lines, at)))))

    stretches = F.flatten(F.transform(_islands(F.transform(F.split(text, "\n"), told), lambda x: x["drawn"]), built))
    blocks = _islands(stretches, lambda x: x["structure"])
    kinds = F.flatten(F.transform(blocks, lambda b: F.when(F.get(b, F.lit(0))["structure"], F.transform(b, lambda x: named(F.lit("structure"), x))).otherwise(coded(b))))
    joined = lambda run: F.struct(F.get(run, F.lit(0))["kind"].alias("kind"), F.array_join(F.transform(run, lambda x: x["line"]), "\n").alias("text"))
    return F.filter(F.transform(_islands(kinds, lambda x: x["kind"]), joined), lambda p: (p["kind"] != "text") | (F.trim(p["text"], F.lit(BLANK)) != ""))


def answer_segments(answer: DataFrame) -> DataFrame:
    """(sheet_id, base, seg_no, kind, text): an answer's pieces, each of text, code, diagram or structure.

    Tagged spans are pieces whatever lines they hold. Of what lies between, lines that hold nothing but atoms and bonds are a structure where two or more follow
    each other and one is all bonds. Other lines are code where they look like it: as one piece where most lines of the stretch do, else in runs of two, or one that is
    surely code; blank lines and lone labels go with the code around them. What is left is text; blank texts are no pieces. A null answer has none.
    """
    rows = answer.select("sheet_id", "base", F.col("answer").alias("_a"), spans(F.col("answer")).alias("_s"))
    before = lambda s, k: F.coalesce(F.get("_s", k - 1)["stop"], F.lit(0))
    piece = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    pairs = F.transform("_s", lambda s, k: F.array(piece(F.lit("text"), F.substring("_a", before(s, k) + 1, s["start"] - before(s, k))), piece(F.lower(s["kind"]), F.trim(inner(F.col("_a"), s), F.lit(BLANK)))))
    end = F.coalesce(F.array_max(F.transform("_s", lambda s: s["stop"])), F.lit(0))
    every = F.concat(F.flatten(pairs), F.array(piece(F.lit("text"), F.substring("_a", end + 1, F.length("_a")))))
    found = F.flatten(F.transform(every, lambda p: F.when(p["kind"] == "text", _line_pieces(p["text"])).otherwise(F.array(p))))
    return rows.select("sheet_id", "base", F.posexplode(found).alias("seg_no", "p")).select("sheet_id", "base", "seg_no", "p.kind", "p.text")


# --- a third reading ---


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def _words(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), 0))


def apply_code_arbiter(answer: DataFrame, second: DataFrame, arbiter: DataFrame) -> DataFrame:
    """(sheet_id, base, text, reconciled, code_warning): answers (sheet_id, base, text, pages: on how many they stand) with code, a third reading (arbiter: sheet_id, base, text) in place of a span that the second (sheet_id, base, text) doesn't confirm.

    Only for one span, closed, on one page, and only when the new one closes its brackets, has as many lines, one more or one fewer, the same words, and leaves the
    answer with as many spans. Where that fails the answer stays and gets a warning; where there was nothing to decide between, a hyphen within a name does.
    """
    rows = answer.withColumn("_s", F.filter(spans(F.col("text")), lambda s: s["kind"] == "CODE")).where(F.size("_s") > 0)
    heard = lambda d, name: d.where((F.trim(F.coalesce("text", F.lit("")), F.lit(BLANK)) != "") & (F.trim("text", F.lit(BLANK)) != NO_CODE)).select("sheet_id", "base", F.trim("text", F.lit(BLANK)).alias(name))
    rows = rows.join(heard(second, "_second"), ["sheet_id", "base"], "left").join(heard(arbiter, "_third"), ["sheet_id", "base"], "left")
    rows = rows.withColumn("_inner", F.transform("_s", lambda s: inner(F.col("text"), s)))
    confirmed = F.coalesce(F.forall("_inner", lambda x: F.contains(squeezed(F.col("_second")), squeezed(x))), F.lit(False))
    asks = ~confirmed & F.col("_second").isNotNull() & (F.size("_s") == 1) & F.get("_s", 0)["terminated"] & (F.col("pages") == 1)
    first, held, wrapped = F.get("_s", F.lit(0)), F.trim(F.get("_inner", F.lit(0)), F.lit(BLANK)), F.concat(F.lit("[CODE: "), "_third", F.lit("]"))
    spliced = F.concat(F.substring("text", F.lit(1), first["start"]), wrapped, F.substring("text", first["stop"] + 1, F.length("text")))
    rows = rows.withColumns({"_asks": asks, "_spliced": spliced})
    lines = lambda t: F.size(F.split(t, "\n"))
    codes = F.size(F.filter(spans(F.col("_spliced")), lambda s: s["kind"] == "CODE"))
    fits = F.col("_asks") & F.col("_third").isNotNull() & is_balanced(wrapped) & (F.abs(lines(F.col("_third")) - lines(held)) <= 1) & (_words(F.col("_third")) == _words(held)) & (codes == 1)
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    hyphen = F.exists("_inner", lambda x: x.rlike("[A-Za-z0-9]-[A-Za-z0-9]"))
    warning = F.when(F.col("_fits"), F.lit(None)).when(F.col("_asks"), CODE_WARNING).when(hyphen, HYPHEN_WARNING)
    return rows.select("sheet_id", "base", F.when(F.col("_fits"), F.col("_spliced")).otherwise(F.col("text")).alias("text"), F.col("_fits").alias("reconciled"), warning.alias("code_warning"))


_FORMULA = rf"[{MATH_SIGNS}^]|[0-9]\s*/\s*[0-9]|[A-Za-z0-9)\]]\s*=\s*[-+(\[0-9A-Za-z√]"


def math_lines(answer: DataFrame) -> DataFrame:
    """(sheet_id, base, line_no, line): lines of answers (sheet_id, base, text) with a formula in them, outside of tagged spans."""
    rows = answer.withColumn("_s", spans(F.col("text"))).withColumn("_lines", F.split("text", "\n"))
    starts = F.aggregate("_lines", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x) + 1))
    each = rows.withColumn("_starts", starts).select("sheet_id", "base", "_s", "_starts", F.posexplode("_lines").alias("line_no", "line"))
    lo = F.get("_starts", F.col("line_no"))
    tagged = F.exists("_s", lambda s: (s["start"] < lo + F.length("line")) & (s["stop"] > lo))
    return each.where(F.col("line").rlike(_FORMULA) & ~tagged).select("sheet_id", "base", "line_no", "line")


def is_mostly_formula(line: Column) -> Column:
    """A line with a formula that has one word at most, or letters for less than 0.35 of it."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return line.rlike(_FORMULA) & ((F.size(_words(line)) <= 1) | (letters < 0.35 * F.length(squeezed(line))))


def math_agreement(answer: DataFrame, second: DataFrame) -> DataFrame:
    """math_lines with confirmed: whether the second reading (sheet_id, base, text) of the answer has the line, white space aside; lines of answers without one aren't in the result."""
    heard = second.where((F.trim(F.coalesce("text", F.lit("")), F.lit(BLANK)) != "") & (F.trim("text", F.lit(BLANK)) != NO_MATH)).select("sheet_id", "base", squeezed(F.col("text")).alias("_page"))
    return math_lines(answer).join(heard, ["sheet_id", "base"]).withColumn("confirmed", F.contains("_page", squeezed(F.col("line")))).drop("_page")


def apply_math_arbiter(answer: DataFrame, second: DataFrame, arbiter: DataFrame) -> DataFrame:
    """(sheet_id, base, text, reconciled, math_warning): answers (sheet_id, base, text) in which a third reading's lines (arbiter: sheet_id, base, page_no, text) stand for those formulas that the second reading doesn't confirm.

    Only readings with as many lines as the answer count, and only lines that are mostly formula are looked at. A line is replaced by the first page's that isn't shorter than half of
    it and has the same words and tags; where only others differ from it, the answer gets a warning. Answers without such lines aren't in the result.
    """
    open_lines = math_agreement(answer, second).where("NOT confirmed").select("sheet_id", "base", "line_no", "line")
    sized = answer.select("sheet_id", "base", F.size(F.split("text", "\n")).alias("_n"))
    third = arbiter.where((F.trim(F.coalesce("text", F.lit("")), F.lit(BLANK)) != "") & (F.trim("text", F.lit(BLANK)) != NO_MATH)).withColumn("_third", F.split("text", "\n"))
    read = third.join(sized, ["sheet_id", "base"]).where(F.size("_third") == F.col("_n")).select("sheet_id", "base", "page_no", F.posexplode("_third").alias("line_no", "new"))
    old, new = F.col("line"), F.col("new")
    pairs = open_lines.where(is_mostly_formula(old)).join(read, ["sheet_id", "base", "line_no"]).where(squeezed(old) != squeezed(new))
    tags = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]"), 0))
    fits = (2 * F.length(squeezed(new)) >= F.length(squeezed(old))) & (squeezed(new) != "") & (_words(old) == _words(new)) & (tags(old) == tags(new))
    best = pairs.withColumn("_fits", fits).groupBy("sheet_id", "base", "line_no").agg(F.min_by("new", F.when(F.col("_fits"), F.col("page_no"))).alias("new"), F.bool_or("_fits").alias("fits"))
    changes = best.groupBy("sheet_id", "base").agg(F.map_from_entries(F.collect_list(F.when(F.col("fits"), F.struct("line_no", "new")))).alias("_new"), F.bool_or("fits").alias("reconciled"), F.bool_or(~F.col("fits")).alias("_unsafe"))
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.coalesce(F.try_element_at("_new", k), x))
    return answer.join(changes, ["sheet_id", "base"]).select("sheet_id", "base", F.array_join(lines, "\n").alias("text"), "reconciled", F.when(F.col("_unsafe"), MATH_WARNING).alias("math_warning"))
