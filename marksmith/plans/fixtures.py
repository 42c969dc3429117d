"""Domain tables derived from the given ones, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.texts import slices_of

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: As many exams as have keys.
EXAMS = "(SELECT 20 + 20 * CAST(floor(max(p_partkey) / 560) AS BIGINT) FROM part)"

#: name: (tables it needs, query)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "key_entry": (
        ("part",),
        """SELECT exam_id, CASE p_partkey % 5 WHEN 0 THEN 'Q.' || base || sub WHEN 1 THEN 'Ans ' || base || sub WHEN 2 THEN '0' || base || sub
                  WHEN 3 THEN 'AI10_Q' || base || sub ELSE base || sub END AS label,
                  CASE WHEN p_size = 50 THEN NULL ELSE CAST(0.5 * (1 + p_size % 8) AS DOUBLE) END AS marks,
                  CASE WHEN p_type LIKE 'ECONOMY%' THEN 'MCQ' WHEN p_type LIKE 'PROMO%' THEN 'Numerical' WHEN p_type LIKE 'LARGE%' THEN 'Long Answer' ELSE 'Short Answer' END AS type,
                  CASE WHEN p_type LIKE 'LARGE%' THEN '(a) ' || p_name || chr(10) || '(c) x OR (c) y'
                       ELSE '(' || CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END || ') ' || p_name END AS answer,
                  p_name AS name, p_partkey AS qorder
           FROM (SELECT *, p_partkey % 20 + 20 * CAST(floor(p_partkey / 560) AS BIGINT) AS exam_id,
                        CAST(1 + CAST(floor((p_partkey % 560) / 20) AS BIGINT) % 7 AS STRING) AS base,
                        CASE CAST(floor((p_partkey % 560) / 140) AS INT) WHEN 0 THEN '(a)' WHEN 1 THEN '(b)(i)' WHEN 2 THEN '(b)(ii)' ELSE '(c)' END AS sub
                 FROM part) AS x""",
    ),
    "key_base": (
        ("part",),
        """SELECT exam_id, base, min(p_partkey) AS p0, sum(marks) AS marks FROM
           (SELECT p_partkey, p_partkey % 20 + 20 * CAST(floor(p_partkey / 560) AS BIGINT) AS exam_id,
                   CAST(1 + CAST(floor((p_partkey % 560) / 20) AS BIGINT) % 7 AS INT) AS base,
                   CASE WHEN p_size = 50 THEN NULL ELSE CAST(0.5 * (1 + p_size % 8) AS DOUBLE) END AS marks FROM part) AS x GROUP BY exam_id, base""",
    ),
    "choice_member": (
        ("key_base",),
        """SELECT exam_id, base, pos, 'Q' || base || CASE pos WHEN 0 THEN '(a)' ELSE '(b)' END AS member
           FROM key_base CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos) AS two WHERE (exam_id + base) % 3 = 0""",
    ),
    "choice_sidecar": (("choice_member",), "SELECT * FROM choice_member WHERE exam_id % 2 = 0"),
    "paper_delivered": (("paper_entry",), "SELECT * FROM paper_entry WHERE exam_id % 7 <> 0"),
    "key_mixed": (
        ("key_entry", "key_base"),
        """SELECT exam_id, label, marks, type, answer, name, qorder FROM key_entry WHERE exam_id % 2 = 1
           UNION ALL SELECT exam_id, 'Q' || base AS label, marks, 'Long Answer' AS type, 'all parts' AS answer, 'whole' AS name, p0 AS qorder FROM key_base WHERE exam_id % 2 = 0""",
    ),
    "paper_entry": (
        ("key_base", "part"),
        """SELECT exam_id, 'Q' || base AS qid, p_name AS question, CAST(coalesce(marks, 0) + 0.5 * (p0 % 4 - 1) AS DOUBLE) AS marks, p0 AS qorder
           FROM key_base JOIN part ON p0 = p_partkey WHERE p0 % 11 <> 0
           UNION ALL SELECT DISTINCT exam_id, 'Q8' AS qid, 'extra' AS question, CAST(3 AS DOUBLE) AS marks, CAST(1000000000 AS BIGINT) AS qorder FROM key_base WHERE exam_id % 3 = 0""",
    ),
    "section_map": (
        ("key_base",),
        """SELECT exam_id, from_q, to_q, CAST(section_marks AS DOUBLE) AS section_marks FROM (SELECT DISTINCT exam_id FROM key_base) AS e CROSS JOIN
           (SELECT 1 AS from_q, 3 AS to_q, 1 AS section_marks UNION ALL SELECT 4, 6, 2 UNION ALL SELECT 7, 8, 3) AS s""",
    ),
    "section_known": (("section_map",), "SELECT * FROM section_map WHERE exam_id % 2 = 0"),
    "exam_text": (("key_base",), "SELECT DISTINCT exam_id, 'This paper contains ' || (6 + exam_id % 5) || ' questions.' AS text FROM key_base"),
    "part_result": (
        ("result",),
        """SELECT sheet_id, CAST(CASE WHEN base <= 4 THEN 1 ELSE 2 END AS INT) AS base, CAST(base AS INT) AS qorder, CASE WHEN answer_chars < 6 THEN '[BLANK]' ELSE 'text' END AS answer,
                  CASE WHEN answer_chars < 6 THEN CAST(0 AS DOUBLE) ELSE marks_max / 2 END AS marks_awarded, marks_max, answer_chars < 6 AS needs_review,
                  CASE WHEN answer_chars < 6 THEN 'No answer captured' ELSE '' END AS capture_status FROM result""",
    ),
    "instruction": (
        ("sheet",),
        """SELECT sheet_id, 1 AS pos, 'Q1 Answer any 2 out of the given ' || (3 + sheet_id % 2) AS text FROM sheet UNION ALL
           SELECT sheet_id, 2 AS pos, CASE WHEN run_failed THEN 'Write clearly' ELSE 'Q2 Answer any 1 out of the given 3' END AS text FROM sheet""",
    ),
    "sheet": (
        ("orders", "customer", "part"),
        f"SELECT o_orderkey AS sheet_id, o_orderkey % {EXAMS} AS exam_id, c_name AS student, o_orderstatus = 'P' AS run_failed FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "answer": (
        ("lineitem", "documents", "part"),
        f"""SELECT sheet_id, exam_id, base, 'Q' || base AS qid,
                  CASE WHEN q <= 4 THEN ' ' WHEN q = 5 THEN 'NA' ELSE
                  CASE pre WHEN 0 THEN 'Therefore ' WHEN 1 THEN '= ' WHEN 2 THEN '(b) ' WHEN 3 THEN '[DIAGRAM: x] ' WHEN 4 THEN '[ambiguous: x] '
                           WHEN 5 THEN '(a) ' WHEN 6 THEN '(b) ' WHEN 7 THEN '(c) ' WHEN 8 THEN '(d) ' ELSE '' END || CASE WHEN base % 3 = 0 THEN '' ELSE coalesce(text, '') END END AS answer
           FROM (SELECT l_orderkey AS sheet_id, l_orderkey % {EXAMS} AS exam_id, CAST(l_linenumber + CASE WHEN max(l_quantity) = 50 THEN 90 ELSE 0 END AS INT) AS base,
                        max(l_quantity) AS q, max(l_partkey) % 10 AS pre, (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM documents) AS doc
                 FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x LEFT JOIN documents ON doc_id = doc""",
    ),
    # answer without its texts: opening, and the number of the text that follows it, if any does
    "answer_ref": (
        ("lineitem", "documents", "part"),
        f"""SELECT sheet_id, exam_id, base, 'Q' || base AS qid,
                  CASE WHEN q <= 4 THEN ' ' WHEN q = 5 THEN 'NA' ELSE
                  CASE pre WHEN 0 THEN 'Therefore ' WHEN 1 THEN '= ' WHEN 2 THEN '(b) ' WHEN 3 THEN '[DIAGRAM: x] ' WHEN 4 THEN '[ambiguous: x] '
                           WHEN 5 THEN '(a) ' WHEN 6 THEN '(b) ' WHEN 7 THEN '(c) ' WHEN 8 THEN '(d) ' ELSE '' END END AS opening, CASE WHEN q <= 4 OR q = 5 OR base % 3 = 0 THEN NULL ELSE doc END AS doc
           FROM (SELECT l_orderkey AS sheet_id, l_orderkey % {EXAMS} AS exam_id, CAST(l_linenumber + CASE WHEN max(l_quantity) = 50 THEN 90 ELSE 0 END AS INT) AS base,
                        max(l_quantity) AS q, max(l_partkey) % 10 AS pre, (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM documents) AS doc
                 FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x""",
    ),
    # the same with the number of every answer's text, and whether its opening stands alone: where texts come twice, so do the answers that they are joined to
    "answer_ref_every": (
        ("lineitem", "documents", "part"),
        f"""SELECT sheet_id, exam_id, base, 'Q' || base AS qid,
                  CASE WHEN q <= 4 THEN ' ' WHEN q = 5 THEN 'NA' ELSE
                  CASE pre WHEN 0 THEN 'Therefore ' WHEN 1 THEN '= ' WHEN 2 THEN '(b) ' WHEN 3 THEN '[DIAGRAM: x] ' WHEN 4 THEN '[ambiguous: x] '
                           WHEN 5 THEN '(a) ' WHEN 6 THEN '(b) ' WHEN 7 THEN '(c) ' WHEN 8 THEN '(d) ' ELSE '' END END AS opening, doc, q <= 4 OR q = 5 OR base % 3 = 0 AS alone
           FROM (SELECT l_orderkey AS sheet_id, l_orderkey % {EXAMS} AS exam_id, CAST(l_linenumber + CASE WHEN max(l_quantity) = 50 THEN 90 ELSE 0 END AS INT) AS base,
                        max(l_quantity) AS q, max(l_partkey) % 10 AS pre, (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM documents) AS doc
                 FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x""",
    ),
    "answer_text": (("documents",), "SELECT doc_id AS doc, text FROM documents"),
    "vote": (
        ("lineitem",),
        """SELECT l_orderkey AS sheet_id, l_linenumber AS base, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS vote_no,
                  l_quantity * CAST(0.13 AS DOUBLE) AS mark FROM lineitem""",
    ),
    "result": (
        ("lineitem", "part"),
        f"""SELECT l_orderkey AS sheet_id, l_orderkey % {EXAMS} AS exam_id, l_linenumber AS base, 'Q' || l_linenumber AS qid, max(l_quantity) * CAST(0.11 AS DOUBLE) AS raw_mark,
                  CAST(0.5 * (1 + CAST(max(l_quantity) AS INT) % 10) AS DOUBLE) AS marks_max,
                  CASE min(l_returnflag) WHEN 'A' THEN 'High' WHEN 'N' THEN 'Medium' ELSE 'Low' END AS confidence,
                  max(l_tax) >= 0.08 AS off_topic, max(l_discount) >= 0.10 AND max(l_tax) < 0.01 AS injection, max(l_partkey) % 7 = 0 AS bad_handwriting, CAST(max(l_partkey) % 30 AS INT) AS answer_chars
           FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    ),
    "page_verdict": (
        ("events",),
        """SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch_id, CAST(event_id % 100 AS INT) AS page_index, value > 60 AS is_sheet_start,
                  CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'User ' || user_id END AS name, CAST((event_id % 10) / CAST(10 AS DOUBLE) AS DOUBLE) AS confidence FROM events""",
    ),
    "cost_event": (
        ("events",),
        """SELECT user_id AS run_id, event_type AS stage, CASE event_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'other' END AS model,
                  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
                  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) / 1000 END AS billed, event_id FROM events""",
    ),
    "decision": (
        ("events",),
        """SELECT user_id AS review_id, CAST(1 + event_id % 7 AS INT) AS base, event_id AS seq, CASE WHEN event_type IN ('error', 'signup') THEN 'reject' ELSE 'accept' END AS decision,
                  value / 50 AS corrected_marks FROM events""",
    ),
    "page_question": (
        ("lineitem",),
        """SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS INT) AS base, CAST(1 + l_partkey % 4 AS INT) AS page_no FROM lineitem
           UNION SELECT l_orderkey, CAST(l_linenumber AS INT), CAST(1 + l_suppkey % 6 AS INT) FROM lineitem UNION SELECT l_orderkey, CAST(l_linenumber AS INT), CAST(7 + l_linenumber % 2 AS INT) FROM lineitem""",
    ),
    # page_question dealt by sheet before its rows are made and told apart, so what groups by sheet, or by sheet and page, needs no other shuffle; for Spark only
    "page_question_dealt": (
        ("lineitem",),
        """SELECT DISTINCT sheet_id, base, page_no FROM (SELECT sheet_id, base, explode(array(a, b, c)) AS page_no FROM
           (SELECT /*+ REPARTITION(sheet_id) */ l_orderkey AS sheet_id, CAST(l_linenumber AS INT) AS base, CAST(1 + l_partkey % 4 AS INT) AS a, CAST(1 + l_suppkey % 6 AS INT) AS b, CAST(7 + l_linenumber % 2 AS INT) AS c FROM lineitem) AS x) AS y""",
    ),
    # the same for a lineitem that is dealt by its l_orderkey
    "page_question_by_sheet": (
        ("lineitem",),
        """SELECT DISTINCT sheet_id, base, page_no FROM
           (SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS INT) AS base, explode(array(CAST(1 + l_partkey % 4 AS INT), CAST(1 + l_suppkey % 6 AS INT), CAST(7 + l_linenumber % 2 AS INT))) AS page_no FROM lineitem) AS x""",
    ),
    "stage_timing": (("events",), "SELECT user_id AS run_id, event_type AS stage, CAST(floor(value * 10) AS DOUBLE) AS seconds, event_id FROM events"),
    "page_text": (("documents",), "SELECT source AS doc, doc_id AS page, text FROM documents"),
    "page_reading": (
        ("conversations",),
        "SELECT conv_id AS sheet_id, turn AS page_no, CASE WHEN role = 'user' THEN '[START_Q: ' || (turn + 1) || ']' || chr(10) || text ELSE text END AS text FROM conversations",
    ),
    "page_scan": (
        ("conversations", "part"),
        f"""SELECT sheet_id, sheet_id % {EXAMS} AS exam_id, page_no, CASE WHEN page_no % 3 = 2 THEN text
                   WHEN (sheet_id + page_no) % 5 = 0 THEN '[INSTRUCTION]: Q2 Answer any 1 out of 3' || chr(10) || text || chr(10) || '[START_Q: ' || a || ' contd]' || chr(10) || 'SECTION A' || chr(10) || text
                   WHEN (sheet_id + page_no) % 5 = 1 THEN '[START_Q: ' || a || ']' || text || '[START_Q: ' || b || '(a)]' || chr(10) || '[BAD_HANDWRITING] ' || text
                   WHEN (sheet_id + page_no) % 5 = 2 THEN '[START_Q: ii]' || text || '[END_Q: 1][START_Q: Ans ' || b || ']'
                   WHEN (sheet_id + page_no) % 5 = 3 THEN '[BLANK PAGE]' ELSE text || '[START_Q: ' || (a + 80) || ']' || text END AS text
            FROM (SELECT conv_id AS sheet_id, CAST(turn AS INT) AS page_no, coalesce(text, '') AS text, 1 + (turn * 2 + conv_id) % 8 AS a, 1 + (turn * 3 + conv_id * 5) % 9 AS b FROM conversations) AS t""",
    ),
    "page_turned": (
        ("page_scan", "conversations"),
        """SELECT p.sheet_id, exam_id, p.page_no, rotation, (p.sheet_id + p.page_no) % 6 = 0 AS wide,
                  CASE WHEN rotation = 0 AND (p.sheet_id + p.page_no) % 4 = 0 THEN '[START_Q: ' || (80 + p.page_no % 9) || '] ' || chr(10) || substr(text, 1, 3) || ' | ~ /'
                       WHEN rotation = (90 * ((p.sheet_id + p.page_no) % 4)) THEN text || ' [START_Q: ' || (1 + p.page_no % 7) || ']' WHEN rotation = 0 THEN text ELSE substr(text, 1, 40) || ' = = |' END AS text
           FROM page_scan AS p CROSS JOIN (SELECT 0 AS rotation UNION ALL SELECT 90 UNION ALL SELECT 180 UNION ALL SELECT 270) AS turns""",
    ),
    "header": (
        ("orders",),
        """SELECT o_orderkey AS sheet_id, CASE o_orderkey % 4 WHEN 0 THEN 'School of Arts' ELSE 'Student Name: <Ann ' || o_custkey || '>' END || chr(10) || 'CLASS: X' || o_orderkey % 3 || chr(10) || 'Roll No: ' || o_custkey || chr(10) ||
                  'Date: 1/2/' || (2000 + o_orderkey % 25) || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN 'Max Marks: ' ELSE 'Marks: 80' END || chr(10) || 'Academic Year: [2024]' || CASE WHEN o_orderkey % 6 = 0 THEN chr(10) || 'name: Bob' ELSE '' END AS text FROM orders""",
    ),
    "glued_answer": (
        ("lineitem", "part"),
        f"""SELECT l_orderkey AS sheet_id, l_orderkey % {EXAMS} AS exam_id, CAST(l_linenumber AS INT) AS base,
                   CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'A' || l_linenumber || '. (d) one' || chr(10) || 'A' || (l_linenumber + 1) || '. (b) two' || chr(10) || 'A' || (l_linenumber + 2) || '. (c) three' || chr(10) || '[DIAGRAM: x]'
                        WHEN 1 THEN '(iii) late part' || chr(10) || '(a) own beginning' WHEN 2 THEN 'own text' || chr(10) || 'Q.' || (l_linenumber + 1) || ' buried text' || chr(10) || '12.' || chr(10) || 'rest'
                        WHEN 3 THEN ' ' WHEN 4 THEN '12.5.2024' || chr(10) || 'Q1 = 4 C' || chr(10) || 'A11 = -2' || chr(10) || 'Ans ' || (l_linenumber + 2) || ') more' ELSE 'plain answer' END AS answer
            FROM lineitem""",
    ),
    "glued_once": (("glued_answer",), "SELECT sheet_id, exam_id, base, min(answer) AS answer FROM glued_answer GROUP BY sheet_id, exam_id, base"),
    "glued_entry": (
        ("glued_once",),
        """SELECT sheet_id, exam_id, 'Q' || base AS qid, base, CAST(10 * base AS INT) AS pos, answer, CASE WHEN answer LIKE 'plain%' AND base > 1 THEN 'Q' || (base - 1) END AS recovered_from FROM glued_once
           UNION ALL SELECT sheet_id, exam_id, 'Q' || base || '(b)', base, CAST(10 * base + 1 AS INT), 'second part' || chr(10) || 'Ans ' || (base + 2) || ': lifted from a sub-part' || chr(10) || 'Q.No. ' || (base + 3) || chr(10) || 'and the next', CAST(NULL AS VARCHAR(9))
           FROM glued_once WHERE answer LIKE 'plain%'
           UNION ALL SELECT DISTINCT sheet_id, exam_id, '_unassigned_', CAST(NULL AS INT), 0, 'loose words' || chr(10) || '(Ques 6) on a loose page' || chr(10) || '  7. (c) and more', CAST(NULL AS VARCHAR(9)) FROM glued_once WHERE answer = ' '""",
    ),
    # glued_once of keys alone: an answer follows from its sheet and number, so no text is grouped
    "glued_once_brief": (
        ("lineitem", "part"),
        f"""SELECT l_orderkey AS sheet_id, l_orderkey % {EXAMS} AS exam_id, CAST(l_linenumber AS INT) AS base,
                   CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'A' || l_linenumber || '. (d) one' || chr(10) || 'A' || (l_linenumber + 1) || '. (b) two' || chr(10) || 'A' || (l_linenumber + 2) || '. (c) three' || chr(10) || '[DIAGRAM: x]'
                        WHEN 1 THEN '(iii) late part' || chr(10) || '(a) own beginning' WHEN 2 THEN 'own text' || chr(10) || 'Q.' || (l_linenumber + 1) || ' buried text' || chr(10) || '12.' || chr(10) || 'rest'
                        WHEN 3 THEN ' ' WHEN 4 THEN '12.5.2024' || chr(10) || 'Q1 = 4 C' || chr(10) || 'A11 = -2' || chr(10) || 'Ans ' || (l_linenumber + 2) || ') more' ELSE 'plain answer' END AS answer
            FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS x""",
    ),
    "glued_entry_brief": (
        ("glued_once_brief",),
        """SELECT sheet_id, exam_id, 'Q' || base AS qid, base, CAST(10 * base AS INT) AS pos, answer, CASE WHEN answer LIKE 'plain%' AND base > 1 THEN 'Q' || (base - 1) END AS recovered_from FROM glued_once_brief
           UNION ALL SELECT sheet_id, exam_id, 'Q' || base || '(b)', base, CAST(10 * base + 1 AS INT), 'second part' || chr(10) || 'Ans ' || (base + 2) || ': lifted from a sub-part' || chr(10) || 'Q.No. ' || (base + 3) || chr(10) || 'and the next', CAST(NULL AS VARCHAR(9))
           FROM glued_once_brief WHERE answer LIKE 'plain%'
           UNION ALL SELECT DISTINCT sheet_id, exam_id, '_unassigned_', CAST(NULL AS INT), 0, 'loose words' || chr(10) || '(Ques 6) on a loose page' || chr(10) || '  7. (c) and more', CAST(NULL AS VARCHAR(9)) FROM glued_once_brief WHERE answer = ' '""",
    ),
    "matcher_reply": (
        ("lineitem",),
        """SELECT sheet_id, host, CAST(ask_no AS INT) AS ask_no, CAST(1 + (part + 3 * ask_no) % 8 AS INT) AS target, CASE WHEN part % 4 = 0 THEN ' ' ELSE 'found by ' || host || ' in ' || part END AS text
           FROM (SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS INT) AS host, max(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x
           CROSS JOIN (SELECT 1 AS ask_no UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS asked""",
    ),
    "tagged_answer": (
        ("lineitem",),
        """SELECT sheet_id, base, CASE part % 6 WHEN 0 THEN 'see [CODE: total_of = rows[0]]' || chr(10) || 'done' WHEN 1 THEN 'a [x] ] [DIAGRAM: box [x]' WHEN 2 THEN 'only [prose] = 4'
                  WHEN 3 THEN 'def f(x):' || chr(10) || '    return x' || chr(10) || chr(10) || 'as asked' WHEN 4 THEN '    H' || chr(10) || '    |' || chr(10) || 'H - N - H' || chr(10) || 'is ammonia'
                  ELSE '[CODE: a-b' || chr(10) || 'b] and [DIAGRAM: c [d]] end' END AS answer FROM (SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS INT) AS base, max(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x""",
    ),
    "formula_answer": (
        ("lineitem",),
        """SELECT sheet_id, base, 'x = ' || supp || chr(10) || 'the sum is known' || chr(10) || 'y^2 = ' || part AS text,
                  'x =  ' || supp || chr(10) || 'the sum is known' || chr(10) || CASE WHEN part % 3 = 0 THEN 'y^2 = ' ELSE 'y2 = ' END || part AS again FROM (SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS INT) AS base, max(l_partkey) AS part, max(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey, l_linenumber) AS x""",
    ),
    "key_both": (
        ("key_entry", "key_base"),
        """SELECT exam_id, label, marks, type, answer, name, qorder FROM key_entry
           UNION ALL SELECT exam_id, 'Q' || base AS label, marks, 'Essay' AS type, 'in all' AS answer, 'whole' AS name, p0 AS qorder FROM key_base WHERE exam_id % 3 = 0""",
    ),
    "price": ((), "SELECT 'small' AS model, CAST(0.1 AS DOUBLE) AS price_in, CAST(0.4 AS DOUBLE) AS price_out UNION ALL SELECT 'medium', 0.3, 2.5 UNION ALL SELECT 'large', 1.25, 5.0"),
}


def _needed(name: str, found: list[str]) -> list[str]:
    for other in DERIVED.get(name, ((), ""))[0]:
        _needed(other, found)
    if name not in found:
        found.append(name)
    return found


def fixture(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """The derived table ``name``.

    dealt: tables on the way, given ones or derived ones, with the column that each is dealt by, all over as many partitions: SLICE_ROWS rows of lineitem in each, so that what follows within them
    takes no more of a task's memory where there are more rows.
    """
    dealt, whole = dealt or {}, lambda n: f"SELECT * FROM parquet.`{sf_dir}/{n}.parquet`" if n in BASE_TABLES else DERIVED[n][1]
    slices = slices_of(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()) if dealt else 0
    parts = [f"`{n}` AS (" + (f"SELECT /*+ REPARTITION({slices}, {dealt[n]}) */ * FROM ({whole(n)}) AS d" if n in dealt else whole(n)) + ")" for n in _needed(name, [])]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM `{name}`")


def oracle(body: str, *names: str) -> str:
    """SQL for other engines: the derived tables as CTEs before ``body``, which itself may begin with CTEs behind WITH."""
    needed: list[str] = []
    for n in names:
        _needed(n, needed)
    parts = [f"{n} AS ({DERIVED[n][1]})" for n in needed if n not in BASE_TABLES]
    body = body.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join([*parts, body[5:]])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
