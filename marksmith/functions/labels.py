"""Question labels: base number, sub-part and canonical id as columns. Digits and spaces are ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that may stand before a question's number.
LABEL_WORDS = ("q", "que", "ques", "question", "ans", "answer", "sol", "soln", "solution", "s", "a")

_SPACE = "[ \t\r\n]*"
#: The longer words first, so that a word isn't taken for a shorter one that it begins with.
WORD_BEFORE_NUMBER = f"(?i)^{_SPACE}(?:{'|'.join(sorted(LABEL_WORDS, key=len, reverse=True))}){_SPACE}[.:-]?{_SPACE}(?=[0-9])"


def bare_label(label: Column) -> Column:
    """Without the subject prefix, and without a label word that stands before a digit."""
    return F.regexp_replace(F.trim(F.regexp_replace(label, "^[^_]*_", "")), WORD_BEFORE_NUMBER, "")


def base_number(label: Column) -> Column:
    """The leading question number, null when there is none."""
    return F.regexp_extract(bare_label(label), "^[ \t\r\n]*0*([0-9]+)", 1).try_cast("int")  # an empty text is no number; each use of a column reads the label anew


def _with_letters(text: Column) -> Column:
    return F.when(text.rlike("[A-Za-z0-9]"), text).otherwise("")


def sub_part(label: Column) -> Column:
    """What follows the leading number, when that has a letter or digit; else empty."""
    rest = F.trim(F.regexp_extract(bare_label(label), "(?s)^[ \t\r\n]*0*[0-9]+(.*)$", 1))
    return _with_letters(rest)


def canonical_id(label: Column) -> Column:
    """Q, number and sub-part; a label without digits stays as it is."""
    bare = F.regexp_replace(bare_label(label), "^[(\\[{ \t]+", "")
    number = F.regexp_extract(bare, "([0-9]+)", 1)
    rest = _with_letters(F.trim(F.regexp_extract(bare, "(?s)^[^0-9]*[0-9]+(.*)$", 1)))
    return F.when(number == "", label).otherwise(F.concat(F.lit("Q"), F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0")), rest))


def with_qid(df: DataFrame, column: str) -> DataFrame:
    """Adds qid, base, sub and has_sub."""
    label = F.col(column)
    bare_only = bare_label(label).rlike("^[ \t\r\n]*[0-9]+[ \t\r\n]*$")
    return df.withColumns({"qid": canonical_id(label), "base": base_number(label), "sub": sub_part(label), "has_sub": base_number(label).isNotNull() & ~bare_only})


def is_under(sub: Column, member_sub: Column) -> Column:
    """Whether a sub-part is the member's own or a finer one; the bases are equal already."""
    return (sub == member_sub) | sub.startswith(F.concat(member_sub, F.lit("("))) | sub.startswith(F.concat(member_sub, F.lit(".")))


def natural_key(text: Column) -> Column:
    """A text that sorts as ids do: letters without case, numbers by value (up to ten digits)."""
    padded = F.regexp_replace(F.lower(text), "([0-9]+)", "000000000$1")
    return F.regexp_replace(padded, "0*([0-9]{10})(?![0-9])", "$1")


def sub_tokens(sub: Column) -> Column:
    """The pieces (x) and .x of a sub-part, in order."""
    return F.regexp_extract_all(sub, F.lit(r"\([^)]*\)|\.[0-9A-Za-z]+"), 0)
