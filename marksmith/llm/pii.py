"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds, each leftmost and non-overlapping within its kind: email, ip (parts at most 255), card (14
to 19 digits that pass Luhn) and phone (+ and 10 to 15 digits); they stay whatever their score. The method
adds spans that overlap no base span and whose score reaches ``ACCEPT``: iban (mod-97 must hold, at the
country's length or, for a country not listed, at the longest group that ends so), secret (long hexadecimal
strings) and local_phone (no +). A context word within ``NEARBY`` characters raises a score, a word that
speaks against the kind lowers it. Offsets are code points, the end exclusive.

Defined results: null and empty texts have no spans. Rows that repeat an id, or whole rows, are reported
one by one. An empty table gives an empty table. Only the id and the text are read, so extra columns may
have any names; ``redacted`` returns them as they are. Every pattern runs in time linear in the text, and
overlaps are found by bisection, so a text of any length costs n log n of its spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record_batches, small_batches, texts

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "local_phone")
BASE_KINDS = KINDS[:4]

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])\(?0[0-9()]{1,5}[ /-][0-9][0-9 /-]{4,12}[0-9](?![0-9])")

#: Lengths of the account numbers of the public IBAN registry, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Proposal scores, what a confirmed checksum and a context word add, what a word against takes off, and the score that accepts a span.
PROPOSED = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "secret": 0.4, "local_phone": 0.3}
CONFIRMED, CONTEXT, AGAINST, ACCEPT, NEARBY = 0.4, 0.3, 0.2, 0.6, 40
CONTEXT_WORDS = {
    "email": re.compile(r"mail|contact|write to|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.I),
    "card": re.compile(r"card|visa|master|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel\b|tel\.|call|mobil|fax|telefon|téléphone|teléfono", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "secret": re.compile(r"token|secret|passw|api.?key|key\b", re.I),
    "local_phone": re.compile(r"phone|tel\b|tel\.|call|mobil|fax|telefon|téléphone|teléfono", re.I),
}
WORDS_AGAINST = {
    "ip": re.compile(r"version|release|section", re.I),
    "card": re.compile(r"order|isbn|serial|tracking", re.I),
    "phone": re.compile(r"order|invoice|version", re.I),
    "secret": re.compile(r"commit|checksum|digest|revision", re.I),
    "local_phone": re.compile(r"order|invoice|version|isbn", re.I),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @: the longest run of local characters before it that earlier matches left, and a domain behind it."""
    out, begin, at = [], 0, text.find("@")
    while at >= 0:
        before = text[begin:at]
        start = begin + len(before.rstrip(LOCAL_CHARS))
        begin = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            begin = m.end()
        at = text.find("@", begin)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return found


def score_of(text: str, kind: str, start: int, end: int) -> float:
    """What the kind, its checksum and the words around the span give, from 0 to 1."""
    before, after = max(0, start - NEARBY), end + NEARBY
    score = PROPOSED[kind] + CONFIRMED * (kind in ("card", "iban"))
    near = lambda words: words is not None and (words.search(text, before, start) or words.search(text, end, after))
    if near(CONTEXT_WORDS[kind]):
        score += CONTEXT
    if near(WORDS_AGAINST.get(kind)):
        score -= AGAINST
    return round(min(1.0, max(0.0, score)), 3)


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost account numbers whose mod-97 holds, at their country's length or else the longest group end of 15 to 34."""
    out, head = [], IBAN_HEAD.search(text)
    while head:
        start, end = head.start(), 0
        if rest := IBAN_REST.match(text, head.end()):
            ends = [k + 1 for k in range(head.end(), rest.end()) if text[k] != " "]  # behind each letter or digit after the first four
            length = IBAN_LENGTHS.get(text[start : start + 2])
            sizes = [length] if length else range(min(34, len(ends) + 4), 14, -1)
            for n in sizes:
                if n - 5 < len(ends) and not text[ends[n - 5] : ends[n - 5] + 1].isalnum() and mod97(text[start : ends[n - 5]].replace(" ", "")):
                    end = ends[n - 5]
                    break
        if end:
            out.append((start, end))
        head = IBAN_HEAD.search(text, end or start + 1)
    return out


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint runs that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of accepted further spans; those overlapping ``taken`` or one of an earlier kind are left out."""
    out: list[tuple[int, int, str, float]] = []
    if not DIGIT.search(text) and not SECRET.search(text):
        return out
    taken = list(taken)
    for kind in ("iban", "secret", "local_phone"):
        if kind == "iban":
            found = ibans(text)
        elif kind == "secret":
            found = [m.span() for m in SECRET.finditer(text)]
        else:
            found = [m.span() for m in LOCAL_PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 13]
        if not found:
            continue
        starts, ends = merged(taken)
        for start, end in found:
            before = bisect_left(starts, end) - 1  # the last run that begins before this span ends
            if (before < 0 or ends[before] <= start) and (score := score_of(text, kind, start, end)) >= ACCEPT:
                out.append((start, end, kind, score))
                taken.append((start, end))
    return out


def find(text: str) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, int, str, float]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = [(a, b, kind, score_of(text, kind, a, b)) for kind, spans in base_spans(text).items() for a, b in spans]
    base.sort(key=lambda s: (s[0], order[s[2]]))
    more = added_spans(text, [(a, b) for a, b, *_ in base])
    return base, sorted(base + more, key=lambda s: (s[0], order[s[2]])) if more else base


def redact(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at, end = [], 0, -1
    for a, b, kind, _ in find(text)[1]:
        if a < end:
            end = max(end, b)
            at = max(at, end)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = end = b
    return "".join(out) + text[at:] if out else text


def written_as(spans: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


SPANS = "doc_id long, kind string, start long, stop long, score double"
REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, stop, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            yield from record_batches([(doc, kind, a, b, score) for doc, text in rows for a, b, kind, score in find(text)[1]], SPANS)

    return texts(docs, id_col, text_col).mapInArrow(run, SPANS)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base kinds, SHA-256 of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, every = find(text)
                kinds = [s[2] for s in base]
                out.append((doc, *(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(written_as(base).encode()).hexdigest(), written_as(every)))
            yield from record_batches(out, REPORT)

    return texts(docs, id_col, text_col).mapInArrow(run, REPORT)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; null stays null, all other columns as they are."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    small_batches(docs.sparkSession)

    @pandas_udf("string")
    def cover(column):
        return column.map(redact, na_action="ignore")

    return docs.select(*[cover(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
