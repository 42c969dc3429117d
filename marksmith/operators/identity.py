"""Who a sheet belongs to: header fields, the name that counts, and the details of the pupil's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header fields with the words of a key that name them, in the order in which they are tried.
FIELDS = (("name", ("name",)), ("class", ("class",)), ("roll_no", ("roll",)), ("date", ("date",)), ("max_marks", ("max", "marks")), ("academic_year", ("academic", "year")))
BLANK = "BLANK"


def extract_header(header: DataFrame) -> DataFrame:
    """(sheet_id, name .. academic_year, name_key, date_key) of header texts (sheet_id, text): "key: value" lines, the last one for a field counting."""
    line = header.select("sheet_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).where(F.contains("line", F.lit(":")))
    key = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_replace(F.trim(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1)), r"[<>{}\[\]]", ""))
    field = F.coalesce(*[F.when(F.contains(key, F.lit(w)), F.lit(name)) for name, words in FIELDS for w in words])
    told = line.select("sheet_id", "pos", field.alias("field"), F.coalesce(F.nullif(value, F.lit("")), F.lit(BLANK)).alias("value")).where("field IS NOT NULL")
    wide = told.groupBy("sheet_id").agg(*[F.max_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("pos"))).alias(name) for name, _ in FIELDS])
    full = header.select("sheet_id").distinct().join(wide, "sheet_id", "left").fillna(BLANK, [name for name, _ in FIELDS])
    name_key = F.regexp_replace(F.replace("name", F.lit(" "), F.lit("_")), "[^A-Za-z0-9_]", "")
    date_key = F.regexp_replace(F.replace(F.replace("date", F.lit("/"), F.lit("-")), F.lit(" "), F.lit("")), "[^A-Za-z0-9_.-]", "")
    known = lambda c, other: F.when(c.isin("", BLANK), other).otherwise(c)
    return full.withColumns({"name_key": known(name_key, "UnknownStudent"), "date_key": known(date_key, "UnknownDate")})


def is_placeholder(name: Column) -> Column:
    """Whether a name says nothing: blank, student, unknownstudent or Student n."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return plain.isin("", "student", "unknownstudent") | plain.rlike("^student [0-9]+$")


def resolve_identity(sheet: DataFrame, header: DataFrame, extract: bool = True) -> DataFrame:
    """(sheet_id, student, header_read) of sheets (sheet_id, given): a given name wins; headers of such sheets aren't read at all, nor any without ``extract``."""
    given = ~is_placeholder(F.col("given"))
    asked = sheet.where(~given) if extract else sheet.limit(0)
    meta = extract_header(header.join(asked, "sheet_id", "left_semi")).select("sheet_id", F.nullif("name", F.lit(BLANK)).alias("read"), F.lit(True).alias("was_read"))
    rows = sheet.join(meta, "sheet_id", "left")
    name = F.when(given, F.trim("given")).otherwise(F.coalesce("read", F.lit("")))
    return rows.select("sheet_id", name.alias("student"), F.coalesce("was_read", F.lit(False)).alias("header_read"))


def student_details(sheet: DataFrame, key: DataFrame, exam: DataFrame) -> DataFrame:
    """(sheet_id, class, subject) of sheets (sheet_id, exam_id, given_class, given_subject): as given, else the key's first subject, else the exam's (exam_id, class, subject)."""
    first = key.where("subject <> ''").groupBy("exam_id").agg(F.min_by("subject", "qorder").alias("key_subject"))
    rows = sheet.join(first, "exam_id", "left").join(exam.select("exam_id", F.col("class").alias("exam_class"), F.col("subject").alias("exam_subject")), "exam_id", "left")
    said = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit("Unknown"))
    return rows.select("sheet_id", said("given_class", "exam_class").alias("class"), said("given_subject", "key_subject", "exam_subject").alias("subject"))
