"""Registered queries on pages to answers, merges of key and answers, notes, diagrams and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import with_text
from ..operators import assembly, grading, integrity, keyedits, merges, notes, recovery, review, segments, text
from . import queries as base
from .queries import query

_KEY, _PAPER = base._KEY, base._PAPER
_KEY_BOTH = _KEY.replace("FROM key_entry", "FROM key_both")


_NOISE = r"(?i)\s*\(?(?:contd\.?|continued|part\s*[0-9]*|pg\s*[0-9]*)\)?\s*"
_SPLIT = base._CHUNKS.replace("FROM page_reading", "FROM page_scan").replace("trim(tags[pos])", f"rtrim(trim(regexp_replace(tags[pos], '{_NOISE}', '', 'g')), '-.')")


@query(
    "c8_clean_chunks",
    ("page_scan",),
    rf"""WITH {_SPLIT} SELECT sheet_id, page_no, pos, tag, contains(text, '[BAD_HANDWRITING]') AS is_bad_handwriting,
    md5(trim(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '\[END_Q:[^\]]*\]|\[BAD_HANDWRITING\]', '', 'g'), '(?i)\[BLANK[ _]PAGE\]', '', 'g'), chr(10)),
        lambda x: NOT regexp_matches(x, '(?i)^\s*section\s*[-–—]?\s*[a-e]\s*$') AND NOT regexp_matches(x, '(?i)^\s*\[instruction\]\s*:')), chr(10)), ' ' || chr(9) || chr(13) || chr(10))) AS text FROM c""",
)
def c8(page_scan):
    found = text.clean_chunks(text.split_chunks(page_scan))
    return found.select("sheet_id", "page_no", "pos", "tag", F.md5("text").alias("text"), "is_bad_handwriting")


def _placed(page_scan, key_entry, paper_entry):
    return assembly.place_chunks(page_scan, recovery.question_set(integrity.canonical_key(key_entry), paper_entry))


_SCAN = ("page_scan", "key_entry", "paper_entry")


@query("c9_assemble_answers", _SCAN)
def c9(*tables):
    return assembly.assembled_answers(_placed(*tables)).withColumns({"chars": F.length("answer"), "answer": F.md5("answer")})


@query("c9_page_questions", _SCAN)
def c9_pages(*tables):
    return assembly.page_questions(_placed(*tables))


@query("c9_collisions", _SCAN)
def c9_collisions(*tables):
    return assembly.collisions(_placed(*tables))


@query("c25_orphan_pages", _SCAN)
def c25(*tables):
    return assembly.orphan_pages(_placed(*tables))


@query(
    "c25_transcript",
    ("answer",),
    """SELECT sheet_id, md5(string_agg(qid || ':' || chr(10) || answer, chr(10) || chr(10) ORDER BY base)) AS transcript FROM answer GROUP BY 1""",
    base.SLICED,
)
def c25_transcript(ref, texts, lineitem):
    return assembly.transcript(ref, base.answered_by_sheet(texts, lineitem)).withColumn("transcript", F.md5("transcript"))


@query(
    "c24_instructions",
    ("page_scan",),
    r"""WITH i AS (SELECT sheet_id, page_no, regexp_extract_all(text, '(?i)\[INSTRUCTION\]:[ \t]*([^\n]*)', 1) AS f FROM page_scan)
    SELECT sheet_id, page_no, unnest(generate_series(0, len(f) - 1)) AS pos, trim(unnest(f)) AS text FROM i WHERE len(f) > 0""",
)
def c24(page_scan):
    return assembly.instructions(page_scan)


@query(
    "c10_snap_candidates",
    ("page_question", "sheet", "key_entry", "paper_entry"),
    f"""WITH {base._SET}, pe AS (SELECT exam_id, page_no, base FROM page_question JOIN sheet USING (sheet_id)), n AS (SELECT DISTINCT exam_id, CAST(10 * page_no + base AS INT) AS number FROM pe UNION SELECT DISTINCT exam_id, CAST(page_no + 8 AS INT) FROM pe),
    o AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM qs WHERE qs.exam_id = n.exam_id AND qs.base = n.number)),
    s AS (SELECT exam_id, base FROM qs UNION SELECT exam_id, base + 20 FROM qs)
    SELECT o.exam_id, number, min(s.base) AS snap FROM o JOIN s ON s.exam_id = o.exam_id AND length(CAST(s.base AS VARCHAR)) = length(CAST(number AS VARCHAR)) AND levenshtein(CAST(s.base AS VARCHAR), CAST(number AS VARCHAR)) = 1
    WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.exam_id = o.exam_id AND x.base = number) GROUP BY 1, 2 HAVING count(*) = 1""",
)
def c10(page_question, sheet, key_entry, paper_entry):
    pages = page_question.join(sheet.select("sheet_id", "exam_id"), "sheet_id")
    numbers = pages.select("exam_id", F.expr("CAST(10 * page_no + base AS INT)").alias("number")).union(pages.select("exam_id", F.expr("CAST(page_no + 8 AS INT)")))
    known = base.d1(key_entry, paper_entry)
    return assembly.snap_candidates(numbers, known.union(known.select("exam_id", F.col("base") + 20)).distinct())


@query(
    "c6_merge_key",
    ("key_entry",),
    f"""WITH {_KEY}, e AS (SELECT exam_id, 'Q' || base AS qid, marks, answer, row_number() OVER (PARTITION BY exam_id, base ORDER BY qorder) AS k FROM key)
    SELECT exam_id, qid, max(marks) FILTER (WHERE k = 1) AS marks, count(*) AS entries FROM e GROUP BY 1, 2""",
)
def c6_key(key_entry):
    key = integrity.canonical_key(key_entry).select("exam_id", F.concat(F.lit("Q"), "base").alias("qid"), "marks", "answer", "qorder")
    sizes = key.groupBy("exam_id", "qid").agg(F.count(F.lit(1)).alias("entries"))
    return assembly.merge_canonical_key(key).join(sizes, ["exam_id", "qid"]).select("exam_id", "qid", "marks", "entries")


@query(
    "c6_merged_key_text",
    ("key_entry",),
    f"""WITH {_KEY} SELECT exam_id, 'Q' || base AS qid, arg_min(marks, qorder) AS marks,
    list_reduce(list(answer ORDER BY qorder), lambda x, y: CASE WHEN trim(y) = '' OR contains(x, trim(y)) THEN x ELSE x || chr(10) || 'OR' || chr(10) || trim(y) END) AS answer FROM key GROUP BY exam_id, base""",
)
def c6_text(key_entry):
    key = integrity.canonical_key(key_entry).select("exam_id", F.concat(F.lit("Q"), "base").alias("qid"), "marks", "answer", "qorder")
    return assembly.merge_canonical_key(key)


@query(
    "c6_merge_answers",
    ("answer",),
    """SELECT sheet_id, 'Q' || (1 + base % 3) AS qid, md5(trim(string_agg(coalesce(answer, ''), chr(10) ORDER BY base), ' ' || chr(9) || chr(13) || chr(10))) AS answer, bool_or(base % 5 = 0) AS is_bad_handwriting FROM answer GROUP BY 1, 2""",
    base.SLICED,
)
def c6_answers(ref, texts, lineitem):
    same = ref.select("sheet_id", F.expr("'Q' || (1 + base % 3)").alias("qid"), F.col("base").alias("aorder"), "opening", "doc", F.expr("base % 5 = 0").alias("is_bad_handwriting"))
    return assembly.merge_canonical_answers(same, base.answered_by_sheet(texts, lineitem)).withColumn("answer", F.md5("answer"))


@query(
    "c19_incomplete_answers",
    ("answer", "key_entry"),
    rf"""WITH {_KEY}, kp AS (SELECT exam_id, base, qorder, list_transform(string_split(regexp_replace(chr(10) || coalesce(answer, '') || chr(10), '([\s|)\]])OR([\s|(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)),
                         lambda p: list_distinct(regexp_extract_all(p, '(?:^|\n)[ \t]*[(\[]?[ \t]*([a-d])[ \t]*[)\].]', 1))) AS asked FROM key),
    w AS (SELECT exam_id, base, list(DISTINCT part) AS wanted FROM (SELECT exam_id, base, unnest(list_reduce(asked, lambda x, y: list_intersect(x, y))) AS part FROM kp) t GROUP BY 1, 2),
    m AS (SELECT sheet_id, base, list_sort(list_filter(wanted, lambda x: NOT list_contains(regexp_extract_all(coalesce(answer, ''), '(?:^|\n)[ \t]*[(\[]?[ \t]*([a-d])[ \t]*[)\].]', 1), x))) AS missing FROM answer JOIN w USING (exam_id, base))
    SELECT sheet_id, base, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""",
    ("answer_ref_every", "answer_text", "key_entry"),
)
def c19(ref, texts, key_entry):
    whole = F.concat("opening", F.when(F.col("alone"), "").otherwise(F.coalesce("text", F.lit(""))))
    fill = lambda rows: with_text(rows, texts, "sheet_id").withColumn("answer", whole)
    return assembly.incomplete_answers(ref.drop("qid"), integrity.canonical_key(key_entry).select("exam_id", "base", "answer"), fill)


@query(
    "c21_symbol_flags",
    ("answer",),
    """SELECT sheet_id, CAST(base % 4 AS INT) AS base, arg_min(coalesce(nullif(m, ''), nullif(c, '')), base) AS note
    FROM (SELECT sheet_id, base, CASE WHEN base % 3 = 0 THEN 'formula ' || base ELSE ' ' END AS m, CASE WHEN base % 2 = 0 THEN 'code ' || base END AS c FROM answer) t
    WHERE trim(m) <> '' OR c IS NOT NULL GROUP BY 1, 2""".replace("nullif(m, '')", "nullif(trim(m), '')"),
)
def c21(answer):
    made = answer.select("sheet_id", F.expr("CAST(base % 4 AS INT)").alias("base"), F.col("base").alias("qorder"), F.expr("CASE WHEN base % 3 = 0 THEN 'formula ' || base ELSE ' ' END").alias("math_warning"), F.expr("CASE WHEN base % 2 = 0 THEN 'code ' || base END").alias("code_warning"))
    return assembly.symbol_flags(made)


@query(
    "c16_tag_spans",
    ("tagged_answer",),
    r"""WITH w AS (SELECT sheet_id, base, answer, string_split(answer, '') AS c FROM tagged_answer WHERE regexp_matches(answer, '\[(CODE|DIAGRAM):')),
    ch AS (SELECT sheet_id, base, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM w),
    -- tags here nest in no other tag, so a tag opens at depth zero of its own text and closes where as many brackets closed as opened since
    op AS (SELECT sheet_id, base, i, regexp_extract(substr(answer, i), '^\[(CODE|DIAGRAM):', 1) AS kind FROM ch JOIN w USING (sheet_id, base) WHERE ch.c = '[' AND regexp_matches(substr(answer, i), '^\[(CODE|DIAGRAM):')),
    d AS (SELECT o.sheet_id, o.base, o.i AS o, kind, ch.i, sum(CASE ch.c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY o.sheet_id, o.base, o.i ORDER BY ch.i) AS depth FROM op o JOIN ch ON ch.sheet_id = o.sheet_id AND ch.base = o.base AND ch.i >= o.i),
    e AS (SELECT sheet_id, base, o, kind, min(i) FILTER (WHERE depth = 0) AS e FROM d GROUP BY 1, 2, 3, 4)
    SELECT sheet_id, base, kind, CAST(o - 1 AS INT) AS start, CAST(coalesce(e, length(answer)) AS INT) AS stop,
           trim(substr(answer, o + length(kind) + 2, coalesce(e, length(answer) + 1) - o - length(kind) - 2), ' ' || chr(9) || chr(13) || chr(10)) AS inner_text, e IS NOT NULL AS terminated FROM e JOIN w USING (sheet_id, base)""",
)
def c16(tagged):
    return segments.tag_spans(tagged).withColumnRenamed("inner", "inner_text")


@query(
    "c17_reading_agreement",
    ("answer", "page_question", "page_scan"),
    r"""WITH sp AS (SELECT conv AS sheet_id, base, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM
        (SELECT sheet_id AS conv, page_no AS base, text FROM page_scan) t),
    q AS (SELECT sheet_id, page_no AS base, page_no FROM page_scan UNION SELECT sheet_id, page_no, page_no + 1 FROM page_scan),
    s AS (SELECT sheet_id, page_no, regexp_replace(text, '\s+', '', 'g') AS page FROM page_scan WHERE page_no % 4 <> 1)
    SELECT sp.sheet_id, sp.base, line_no, md5(line) AS line, coalesce(bool_or(contains(page, regexp_replace(line, '\s+', '', 'g'))), FALSE) AS confirmed, regexp_matches(line, '[A-Za-z_]\w*-[A-Za-z_]\w*') AS hyphen_in_name
    FROM sp LEFT JOIN (SELECT q.sheet_id, q.base, page FROM q JOIN s USING (sheet_id, page_no)) p ON p.sheet_id = sp.sheet_id AND p.base = sp.base WHERE trim(line) <> '' GROUP BY sp.sheet_id, sp.base, line_no, line""",
)
def c17(answer, page_question, page_scan):
    span = page_scan.select("sheet_id", F.col("page_no").alias("base"), "text")
    asked = page_scan.select("sheet_id", F.col("page_no").alias("base"), "page_no")
    asked = asked.union(asked.select("sheet_id", "base", F.col("page_no") + 1)).distinct()
    # pages that the second pass didn't read have none
    second = page_scan.select("sheet_id", "page_no", F.expr("CASE WHEN page_no % 4 <> 1 THEN text END").alias("text"))
    return assembly.reading_agreement(span, asked, second).withColumn("line", F.md5("line"))


_SECOND = "CASE WHEN base % 3 = 0 THEN '[NO CODE]' WHEN base % 3 = 1 THEN answer ELSE replace(answer, '_', '-') END"
_THIRD = "CASE WHEN base % 2 = 0 THEN 'total_of = rows[0]' ELSE 'total_of = rows[0' END"


@query("c18_code_arbiter", ("tagged_answer",))
def c18_code(tagged):
    answer = tagged.select("sheet_id", "base", F.col("answer").alias("text"), F.expr("CASE WHEN base % 5 = 0 THEN 2 ELSE 1 END").alias("pages"))
    return segments.apply_code_arbiter(answer, tagged.selectExpr("sheet_id", "base", f"{_SECOND} AS text"), tagged.selectExpr("sheet_id", "base", f"{_THIRD} AS text"))


@query(
    "c17_math_agreement",
    ("formula_answer",),
    r"""WITH l AS (SELECT sheet_id, base, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, regexp_replace(again, '\s+', '', 'g') AS page FROM formula_answer)
    SELECT sheet_id, base, CAST(line_no AS INT) AS line_no, line, contains(page, regexp_replace(line, '\s+', '', 'g')) AS confirmed FROM l WHERE contains(line, '=') OR contains(line, '^')""",
)
def c17_math(formula):
    return segments.math_agreement(formula.select("sheet_id", "base", "text"), formula.select("sheet_id", "base", F.col("again").alias("text")))


@query("c18_math_arbiter", ("formula_answer",))
def c18_math(formula):
    third = formula.selectExpr("sheet_id", "base", "1 AS page_no", "CASE WHEN base % 2 = 0 THEN again ELSE again || ' so' END AS text")
    return segments.apply_math_arbiter(formula.select("sheet_id", "base", "text"), formula.select("sheet_id", "base", F.col("again").alias("text")), third)


@query("c22_answer_segments", ("tagged_answer",))
def c22(tagged):
    return segments.answer_segments(tagged)


@query("c23_best_reread", ("page_scan",))
def c23(page_scan):
    before = page_scan.select("sheet_id", "page_no", "text", F.expr("array('a', 'b')").alias("missing"))
    attempt = page_scan.select("sheet_id", "page_no", F.expr("explode(array(1, 2))").alias("attempt"), "text").selectExpr(
        "sheet_id", "page_no", "attempt", "CASE WHEN (sheet_id + attempt) % 2 = 0 THEN text || chr(10) || '(a) more' ELSE 'b) ' || text END AS text"
    )
    return assembly.best_reread(before, attempt).withColumn("text", F.md5("text"))


_MERGED = rf"""{_KEY}, m AS (SELECT exam_id, base, pos, member, regexp_extract(member, '^Q[0-9]+(.*)$', 1) AS msub FROM choice_member),
told AS (SELECT exam_id, base, qid, sub, marks, trim(answer) AS ans, CASE WHEN sub <> '' THEN sub || ' ' ELSE '' END || trim(answer) AS told FROM key),
u AS (SELECT t.*, pos, member FROM told t JOIN m ON t.exam_id = m.exam_id AND t.base = m.base AND (t.sub = msub OR starts_with(t.sub, msub || '(') OR starts_with(t.sub, msub || '.'))),
alt AS (SELECT exam_id, base, pos, regexp_extract(member, '\(([A-Za-z0-9]+)\)$', 1) AS label, sum(marks) AS am, string_agg(told, ' ' ORDER BY lower(qid)) AS alt_text FROM u GROUP BY 1, 2, pos, member),
g AS (SELECT exam_id, base, max(am) AS best, count(DISTINCT am) > 1 AS uneq, string_agg(alt_text, chr(10) || 'OR' || chr(10) ORDER BY pos) AS either, string_agg(label || '=' || trim(alt_text), '|' ORDER BY pos) AS alternatives FROM alt GROUP BY 1, 2 HAVING count(*) >= 2),
c AS (SELECT exam_id, base, sum(marks) AS sm, string_agg(told, ' ' ORDER BY lower(qid)) AS shared FROM told t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.exam_id = t.exam_id AND u.base = t.base AND u.qid = t.qid) GROUP BY 1, 2),
merged AS (SELECT exam_id, base, 'Q' || base AS qid, coalesce(sm, 0) + best AS marks, trim(CASE WHEN shared IS NOT NULL THEN shared || chr(10) ELSE '' END || either) AS answer, coalesce(shared, '') AS choice_shared, uneq AS choice_marks_unequal, alternatives FROM g LEFT JOIN c USING (exam_id, base))"""


def _merged(key_entry, members):
    return merges.merge_choices(integrity.canonical_key(key_entry), members)


@query("e18_merge_choices", ("key_entry", "choice_member"), f"WITH {_MERGED} SELECT * FROM merged")
def e18(key_entry, members):
    made = _merged(key_entry, members)
    alternatives = F.array_join(F.transform("choice_alternatives", lambda a: F.concat(a["label"], F.lit("="), a["answer"])), "|")
    return made.withColumn("alternatives", alternatives).drop("choice_alternatives", "is_choice")


@query(
    "e18_gathered_answers",
    ("answer", "key_entry", "choice_member"),
    f"""WITH {_MERGED} SELECT sheet_id, base, md5(coalesce(string_agg(trim(answer, ' ' || chr(9) || chr(13) || chr(10)), chr(10)) FILTER (WHERE upper(trim(answer, ' ' || chr(9) || chr(13) || chr(10))) NOT IN ('', '[BLANK]', 'NA', 'N/A', 'NONE')), '')) AS answer, FALSE AS is_bad_handwriting
    FROM answer WHERE EXISTS (SELECT 1 FROM merged m WHERE m.exam_id = answer.exam_id AND m.base = answer.base) GROUP BY 1, 2""",
    (*base.SLICED, "key_entry", "choice_member"),
)
def e18_answers(ref, texts, lineitem, key_entry, members):
    rows = ref.select("sheet_id", "exam_id", "base", F.lit(0).alias("aorder"), "opening", "doc", F.lit(False).alias("is_bad_handwriting"))
    return merges.gather_answers(rows, _merged(key_entry, members), base.answered_by_sheet(texts, lineitem)).withColumn("answer", F.md5("answer"))


@query(
    "e19_merge_additive",
    ("key_both",),
    rf"""WITH {_KEY_BOTH}, e AS (SELECT *, max(sub = '') OVER w AS has_bare, max(sub <> '') OVER w AS split, regexp_extract(qid, '\(([A-Za-z0-9]+)\)$', 1) AS last FROM key WINDOW w AS (PARTITION BY exam_id, base)),
    pc AS (SELECT *, trim(CASE WHEN last <> '' THEN '(' || last || ') ' ELSE '' END || CASE WHEN NOT has_bare THEN '[' || CASE WHEN marks = floor(marks) THEN CAST(CAST(marks AS BIGINT) AS VARCHAR) ELSE CAST(marks AS VARCHAR) END || ' mark' || CASE WHEN marks = 1 THEN '' ELSE 's' END || '] ' ELSE '' END || trim(answer)) AS piece FROM e WHERE split),
    q AS (SELECT exam_id, base, string_agg(name, chr(10) ORDER BY first_at) AS question FROM (SELECT exam_id, base, name, min(lower(qid)) AS first_at FROM pc GROUP BY 1, 2, 3) t GROUP BY 1, 2)
    SELECT pc.exam_id, pc.base, 'Q' || pc.base AS qid, coalesce(sum(marks) FILTER (WHERE sub = ''), sum(marks)) AS marks, string_agg(piece, chr(10) ORDER BY lower(qid)) AS answer, q.question, arg_min(type, lower(qid)) AS type
    FROM pc JOIN q ON q.exam_id = pc.exam_id AND q.base = pc.base GROUP BY pc.exam_id, pc.base, q.question""",
)
def e19(key_both):
    return merges.merge_additive(integrity.canonical_key(key_both).withColumn("question", F.col("name")))


@query(
    "e20_merge_subparts",
    ("answer", "paper_entry", "instruction"),
    """WITH a AS (SELECT sheet_id, exam_id, 'Q' || (1 + base % 3) || '.' || base AS qid, 'Q' || (1 + base % 3) AS parent, base, trim(coalesce(answer, ''), ' ' || chr(9) || chr(13) || chr(10)) AS t, base % 5 = 0 AS bad FROM answer),
    r AS (SELECT sheet_id, regexp_extract(text, '^(Q[0-9]+)', 1) AS parent FROM instruction WHERE text LIKE 'Q%')
    SELECT sheet_id, parent AS qid, md5(trim(string_agg('(' || base || ') ' || t, chr(10) ORDER BY base), ' ' || chr(9) || chr(13) || chr(10))) AS answer, bool_or(bad) AS is_bad_handwriting FROM a
    WHERE EXISTS (SELECT 1 FROM paper_entry p WHERE p.exam_id = a.exam_id AND p.qid = a.parent) AND NOT EXISTS (SELECT 1 FROM r WHERE r.sheet_id = a.sheet_id AND r.parent = a.parent) GROUP BY 1, 2""",
    (*base.SLICED, "paper_entry", "instruction"),
)
def e20(ref, texts, lineitem, paper_entry, instruction):
    dotted = ref.select("sheet_id", "exam_id", F.expr("'Q' || (1 + base % 3) || '.' || base").alias("qid"), "opening", "doc", F.expr("base % 5 = 0").alias("is_bad_handwriting"))
    return merges.merge_subparts(dotted, paper_entry, grading.choice_rules(instruction), base.answered_by_sheet(texts, lineitem)).withColumn("answer", F.md5("answer"))


_INLINE = rf"""{_KEY}, d AS (SELECT exam_id, base FROM key WHERE regexp_full_match(sub, '\([^)]*\)') GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT marks) = 1),
il AS (SELECT exam_id, qid FROM key k WHERE NOT (regexp_full_match(sub, '\([^)]*\)') AND EXISTS (SELECT 1 FROM d WHERE d.exam_id = k.exam_id AND d.base = k.base)) AND regexp_matches(name || chr(10) || answer, '(?:^|\s)OR(?:\s|$)'))"""


def _keyed(key_entry):
    return integrity.canonical_key(key_entry).withColumn("question", F.col("name"))


@query("e15_inline_choices", ("key_entry",), f"WITH {_INLINE} SELECT exam_id, qid FROM il")
def e15_inline(key_entry):
    return integrity.inline_choices(_keyed(key_entry))


@query(
    "e21_choice_flags",
    ("key_entry", "choice_sidecar"),
    f"""WITH {_INLINE} SELECT exam_id, qid, EXISTS (SELECT 1 FROM il WHERE il.exam_id = k.exam_id AND il.qid = k.qid) AS inline_or,
    (EXISTS (SELECT 1 FROM il WHERE il.exam_id = k.exam_id AND il.qid = k.qid) OR EXISTS (SELECT 1 FROM choice_sidecar c WHERE c.exam_id = k.exam_id AND c.member = k.qid)) AND k.exam_id % 2 = 1 AS is_choice_uncertain FROM key k""",
)
def e21(key_entry, sidecar):
    key = _keyed(key_entry)
    known = sidecar.select("exam_id").distinct()
    unsure = key.join(known, "exam_id", "left_anti")  # exams without choices of their own: theirs are guessed
    return merges.stamp_choice_flags(key, sidecar.select("exam_id", F.col("member").alias("qid")), integrity.inline_choices(key), unsure).select("exam_id", "qid", "inline_or", "is_choice_uncertain")


@query(
    "e8_suggest_choices",
    ("key_entry", "choice_sidecar", "paper_entry"),
    rf"""WITH {_KEY}, {_PAPER}, pm AS (SELECT exam_id, base, max(marks) AS paper FROM p GROUP BY 1, 2),
    l AS (SELECT exam_id, base, qid, marks, 'Q' || base || regexp_extract(sub, '^(\([^)]*\)|\.[A-Za-z0-9]+)', 1) AS top, regexp_extract(sub, '^(\([^)]*\)|\.[A-Za-z0-9]+)', 1) <> '' AS topped FROM key k
          WHERE marks > 0 AND NOT EXISTS (SELECT 1 FROM choice_sidecar c WHERE c.exam_id = k.exam_id AND c.base = k.base)),
    s AS (SELECT exam_id, base, top, topped, sum(marks) AS tm FROM l GROUP BY 1, 2, 3, 4),
    b AS (SELECT exam_id, base, sum(tm) AS current_sum, coalesce(sum(tm) FILTER (WHERE NOT topped), 0) + max(tm) FILTER (WHERE topped) AS collapsed, count(*) FILTER (WHERE topped) AS n, string_agg(top, ',' ORDER BY top) FILTER (WHERE topped) AS members FROM s GROUP BY 1, 2)
    SELECT exam_id, base, paper, current_sum, members FROM b JOIN pm USING (exam_id, base) WHERE n >= 2 AND current_sum - paper > 1e-6 AND current_sum - collapsed > 1e-6 AND abs(collapsed - paper) <= 1e-6""",
)
def e8(key_entry, sidecar, paper_entry):
    return keyedits.suggest_choices(integrity.key_leaves(key_entry), sidecar, integrity.paper_marks(paper_entry))


@query(
    "e11_marks_breakdown",
    ("key_entry", "choice_member", "paper_entry"),
    rf"""WITH {_KEY}, {_PAPER}, pm AS (SELECT exam_id, base, max(marks) AS paper_marks, arg_max(question, length(question) * 10000000000 - qorder) AS pq FROM p GROUP BY 1, 2),
    m AS (SELECT exam_id, base, base AS group_no, pos, regexp_extract(member, '^Q[0-9]+(.*)$', 1) AS msub FROM choice_member),
    g AS (SELECT k.exam_id, k.qid, min(group_no) AS group_no FROM key k JOIN m ON k.exam_id = m.exam_id AND k.base = m.base AND (k.sub = msub OR starts_with(k.sub, msub || '(') OR starts_with(k.sub, msub || '.')) GROUP BY 1, 2)
    SELECT exam_id, qid, base, marks AS key_marks, paper_marks, substr(coalesce(pq, ''), 1, 300) AS question, group_no, substr(answer, 1, 80) AS answer_preview FROM key LEFT JOIN g USING (exam_id, qid) LEFT JOIN pm USING (exam_id, base)""",
)
def e11(key_entry, members, paper_entry):
    grouped = members.withColumn("group_no", F.col("base"))
    return keyedits.marks_breakdown(integrity.canonical_key(key_entry), grouped, integrity.paper_marks(paper_entry), integrity.paper_question(paper_entry))


@query(
    "e12_key_edits",
    ("key_entry", "key_base"),
    f"""WITH {_KEY}, b AS (SELECT exam_id, base, p0 FROM key_base),
    kept AS (SELECT exam_id, qid, marks, answer FROM key k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.exam_id = k.exam_id AND p0 % 3 = 0 AND k.qid = 'Q' || b.base || '(a)')),
    st AS (SELECT k.exam_id, qid, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.exam_id = k.exam_id AND p0 % 3 = 1 AND k.qid = 'Q' || b.base || '(c)') THEN 1.5 ELSE marks END AS marks, answer FROM kept k)
    SELECT exam_id, qid, marks, answer, FALSE AS teacher_added, FALSE AS key_parse_missing FROM st
    UNION ALL SELECT exam_id, 'Q' || (base + 20), CAST(2 AS DOUBLE), CASE WHEN p0 % 2 = 0 THEN 'x' ELSE '' END, TRUE, p0 % 2 = 1 FROM b WHERE p0 % 3 = 2""",
)
def e12(key_entry, key_base):
    edits = key_base.selectExpr(
        "exam_id", "p0 AS seq", "CASE p0 % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'marks' ELSE 'add' END AS action",
        "CASE p0 % 3 WHEN 0 THEN 'Q' || base || '(a)' WHEN 1 THEN 'Q' || base || '(c)' ELSE 'ques ' || (base + 20) END AS label", "CASE p0 % 3 WHEN 1 THEN '1.4' ELSE '2' END AS marks", "CASE WHEN p0 % 2 = 0 THEN ' x' END AS answer",
    )
    return keyedits.apply_key_edits(integrity.canonical_key(key_entry), edits).drop("reconcile_note")


@query(
    "e13_collapse_members",
    ("key_entry",),
    f"""WITH {_KEY}, g AS (SELECT exam_id, base, list(qid ORDER BY qorder) AS members, list(DISTINCT 'Q' || base || regexp_extract(sub, '^(\\([^)]*\\))', 1)) AS tops FROM key GROUP BY 1, 2)
    SELECT exam_id, base AS group_no, 'Q' || base AS parent, array_to_string(list_sort(CASE WHEN len(tops) >= 2 THEN tops ELSE members END), ',') AS members FROM g""",
)
def e13(key_entry):
    ticked = integrity.canonical_key(key_entry).groupBy("exam_id", F.col("base").alias("group_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("qorder", "qid"))), lambda x: x["qid"]).alias("members"))
    return keyedits.collapse_members(ticked).withColumn("members", F.array_join(F.array_sort("members"), ","))
