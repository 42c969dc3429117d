"""The operators against brute force, the tokenizers' libraries, round trips and held-out labels, with odd rows among the input."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from marksmith.llm import exact_dedup, gif_media, packing, pii, quality, queries, sentencepiece_bpe, simhash_dedup, token_store, toxicity, url_filter
from marksmith.llm.components import components

SF = "/root/testdata/sf0.001"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score double, `row` int"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
TEXTS = ["", None, " ", "same text here", "same text here", "Same  TEXT here", "a b", LONG, "x" * 70_000, "é漢🙂 <|endoftext|> ▁ \x00 end", "   lead\n\n\ttail  "]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(k, t, None if k % 3 else "en", None, None, "extra", None, k) for k, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_empty_tables(spark, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    assert pii.report(empty).count() == exact_dedup.exact_duplicates(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert gif_media.read_back(gif_media.store(empty)).count() == sentencepiece_bpe.encode_decode(empty, PIECE).count() == 0
    assert packing.pack_documents(empty, BYTE).count() == token_store.read_tokens(token_store.write_tokens(empty, BYTE)).count() == 0
    assert toxicity.toxicity(empty, labels).count() == quality.quality(empty, labels).count() == 0
    assert simhash_dedup.near_duplicates(empty).count() == simhash_dedup.drop_near_duplicates(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert url_filter.judge_urls(pages, url_filter.domain_table(spark)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = {k: [m.span() for m in re.finditer(p, text)] for k, p in PATTERNS.items()}
    found["ip"] = [(a, b) for a, b in found["ip"] if all(int(x) <= 255 for x in text[a:b].split("."))]
    found["card"] = [(a, b) for a, b in found["card"] if 14 <= len(digits(text[a:b])) <= 19 and pii.luhn(digits(text[a:b]))]
    found["phone"] = [(a, b) for a, b in found["phone"] if 10 <= len(digits(text[a:b])) <= 15]
    return found


def test_pii_against_plain_patterns(spark, odd):
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "23", "255", "+", " ", "-", "(", "x.y", "%", "4111111111111111", "\n", "é", "1.2.3.4"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]:
        assert pii.base_spans(text) == plain_spans(text), text
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.report(docs).collect()}
    want = set()
    for doc, text in texts_of(docs):
        spans = sorted(((a, list(PATTERNS).index(k), k, b) for k, x in plain_spans(text).items() for a, b in x))
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        want.add((doc, sha, *(sum(s[2] == k for s in spans) for k in PATTERNS)))
    assert got == want


def test_pii_added_spans_and_redaction(odd):
    text = 'to a@b.co from 1.2.3.4, IBAN DE89 3704 0044 0532 0130 00 tel 030 1234567 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    assert pii.redact(text) == 'to [EMAIL] from [IP], IBAN [IBAN] tel [LOCAL_PHONE] token = "[SECRET]"'
    assert not pii.mod97("DE88370400440532013000") and pii.redact("IBAN DE88 3704 0044 0532 0130 00") == "IBAN DE88 3704 0044 0532 0130 00"
    redacted = pii.redacted(odd)
    assert redacted.columns == odd.columns and redacted.where("text IS NULL").count() == 2
    assert pii.redact("9" * 200_000) and pii.redact("a" * 200_000 + "@") and pii.redact("1.1." * 50_000)  # linear


def test_pii_ibans_before_further_words():
    for text, want in (
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"), ("IBAN DE89370400440532013000 AND MORE", "DE89370400440532013000"),
        ("iban GB82 WEST 1234 5698 7654 32 2024", "GB82 WEST 1234 5698 7654 32"), ("AB12 DE89370400440532013000 EUR 20", "DE89370400440532013000"),
    ):
        assert [text[a:b] for a, b, kind, _ in pii.find(text)[1] if kind == "iban"] == [want]
    assert not [s for s in pii.find("DE89370400440532013000X")[1] if s[2] == "iban"]
    assert [s[2] for s in pii.find("api key " + "0af" * 100)[1]] == ["secret"] and not pii.find("commit, not a key: " + "0af" * 20)[1]


def plain_added(text):
    """Every candidate against every base span and accepted span, in the same order of kinds."""
    taken = [(a, b) for spans in pii.base_spans(text).values() for a, b in spans]
    out = []
    tail = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
    found, at = [], 0
    while at < len(text):
        m = tail.match(text, at)
        ends = []
        if m:
            for end in range(m.end(), at, -1):
                bare = text[at:end].replace(" ", "")
                wanted = pii.IBAN_LENGTHS.get(bare[:2], len(bare))
                if text[end - 1] != " " and not text[end : end + 1].isalnum() and len(bare) == wanted and pii.mod97(bare):
                    ends.append(end)
        if ends:
            found.append(("iban", at, ends[0]))
        at = ends[0] if ends else at + 1
    found += [("secret", *m.span()) for m in pii.SECRET.finditer(text)]
    found += [("local_phone", *m.span()) for m in pii.LOCAL_PHONE.finditer(text) if 8 <= len(pii.digits_of(m[0])) <= 13]
    for kind, a, b in found:
        if all(y <= a or b <= x for x, y in taken) and pii.score_of(text, kind, a, b) >= pii.ACCEPT:
            out.append((a, b, kind))
            taken.append((a, b))
    return sorted(out)


def test_pii_added_spans_against_brute_force():
    rng = random.Random(5)
    parts = ["IBAN ", "DE89 3704 0044 0532 0130 00", "ZZ", "40", "0", "12", "AB", " ", " ", "tel ", "030 1234567", "+4930 1234567", "key ", "0af1" * 8, "a@b.co", "X", ".", "GB82WEST12345698765432", "4111111111111111"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]:
        assert sorted((a, b, k) for a, b, k, _ in pii.added_spans(text, [s for x in pii.base_spans(text).values() for s in x])) == plain_added(text), text


def test_pii_many_spans_in_one_text():
    import time

    at = time.monotonic()
    assert len(pii.find("tel 030 1234567 " * 20_000)[1]) == 20_000
    assert len(pii.find("call +49 30 1234567 IBAN DE89370400440532013000 AND " * 10_000)[1]) == 20_000
    assert time.monotonic() - at < 10


def test_gif_round_trip_and_rules(spark, odd):
    for n in (64, 64 * 1024, 64 * 1025, 64 * 2500):
        for payload in (os.urandom(n), bytes(n)):
            assert b"".join(f.canvas[: f.height, :, 0].tobytes() for f in gif_media.read_gif(gif_media.write_gif(payload))) == payload
    for r in gif_media.read_back(gif_media.store(odd)).collect():
        text = next(t for d, t in texts_of(odd) if d == r.doc_id) if r.doc_id is not None else None
        if text is not None:
            n, payload = gif_media.payload_of(text)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-64:])
    # two frames of one pixel on a 2 x 1 screen: red kept or cleared, then green over a transparent first pixel
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes([255, 0, 0, 0, 255, 0])
    frame = lambda disposal, transparent, index, x: (
        bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, 0, transparent or 0, 0]) + b"\x2c" + bytes([x, 0, 0, 0, 1, 0, 1, 0, 0, 2]) + gif_media.blocks(bytes([(4 | index << 3 | 5 << 6) & 255, 5 >> 2]))
    )
    for disposal, first in ((1, [255, 0, 0, 255]), (2, [0, 0, 0, 0]), (3, [0, 0, 0, 0])):
        shown = list(gif_media.read_gif(head + frame(disposal, None, 0, 0) + frame(0, 1, 1, 0) + frame(0, None, 1, 1) + b"\x3b"))
        assert shown[0].canvas[0, 0].tolist() == [255, 0, 0, 255] and shown[0].delay_cs == 5
        assert shown[2].canvas[0].tolist() == [first, [0, 255, 0, 255]]
    whole = gif_media.write_gif(bytes(range(64)) * 1025)
    media = spark.createDataFrame([(1, whole), (2, None), (3, b"GIF89a\x01"), (4, whole[:-40]), (5, b""), (6, b"x" * 99)], "doc_id long, media binary")
    rows = sorted(gif_media.frames(media).collect(), key=lambda r: (r.doc_id, r.frame))
    assert [(r.doc_id, r.frame, r.status == "ok", r.start_cs) for r in rows] == [
        (1, 0, True, 0), (1, 1, True, 10), (3, 0, False, None), (4, 0, True, 0), (4, 1, False, None), (5, 0, False, None), (6, 0, False, None)
    ]
    for r in rows:
        if r.status == "ok":
            pixels = np.frombuffer(r.pixels, dtype=np.uint8).reshape(-1, 4)
            for k, found in enumerate((r.red, r.green, r.blue)):
                assert found == [int((pixels[:, k] // 16 == b).sum()) for b in range(16)]
    for end in range(len(whole) - 1):  # every cut is told, none ends in another exception
        if end < 900 or end % 97 == 0:
            with pytest.raises(ValueError):
                list(gif_media.read_gif(whole[:end]))


def plain_lzw(data, bits, size):
    """A decoder by the rule book: a table of strings, one code after the other."""
    clear, table, out, before, width, at = 1 << bits, [], [], None, bits + 1, 0
    stream = int.from_bytes(data, "little")
    while sum(map(len, out)) < size:
        code = stream >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, before, width = [bytes([k]) for k in range(clear)] + [b"", b""], None, bits + 1
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        if len(table) == 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


def plain_lzw_encode(pixels, bits, clears):
    """Codes of a table that is cleared when full, or left as it is then."""
    clear, stream, at, width = 1 << bits, 0, 0, bits + 1
    table, prefix = {bytes([k]): k for k in range(clear)}, b""
    free = clear + 2

    def put(code):
        nonlocal stream, at
        stream |= code << at
        at += width

    put(clear)
    for k in range(len(pixels)):
        if prefix + pixels[k : k + 1] in table:
            prefix += pixels[k : k + 1]
            continue
        put(table[prefix])
        if free < 4096:
            table[prefix + pixels[k : k + 1]] = free
            free += 1
            if free == (1 << width) + 1 and width < 12:
                width += 1
        elif clears:
            put(clear)
            table, free, width = {bytes([k]): k for k in range(clear)}, clear + 2, bits + 1
        prefix = pixels[k : k + 1]
    put(table[prefix])
    if free == 1 << width and width < 12:
        width += 1
    put(clear + 1)
    return stream.to_bytes(at // 8 + 1, "little")


def test_lzw_against_a_plain_coder():
    rng = random.Random(8)
    for bits in (2, 4, 8):
        for n in (1, 2, 300, 20_000):
            for kinds in (1, 2, 1 << bits):
                pixels = bytes(rng.randrange(kinds) for _ in range(n))
                for clears in (True, False):
                    data = plain_lzw_encode(pixels, bits, clears)
                    assert plain_lzw(data, bits, n) == pixels and gif_media.lzw_decode(data, bits, n).tobytes() == pixels
                if bits == 8:
                    assert plain_lzw(gif_media.lzw_encode(pixels), 8, n) == pixels
        with pytest.raises(ValueError):
            gif_media.lzw_decode(b"\xff\x0f" * 30, bits, 20)


def test_exact_dedup(spark, odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    groups = {}
    for doc, text in texts_of(odd):
        groups.setdefault(text, []).append(doc)
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [d for d in groups[text] if d is not None]
        assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[text]) and r.kept == (r.doc_id is not None and r.doc_id == r.keep_id)
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.text or "") for r in kept.collect()) == sorted(groups)


def test_exact_dedup_of_frequent_texts_and_awkward_columns(spark):
    """A third of the rows share a text, some repeat their id too; extra columns have a dot, a clashing name or a map."""
    rows = [(k, "hot" if k % 3 == 0 else f"t{k // 4}" if k % 3 == 1 else None if k % 7 == 0 else "x" * (k % 5), k, {"k": k}, "head") for k in range(3000)]
    rows += [(2997, "hot", 1, {}, "tie")] * 50 + [(None, "hot", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, m map<string,int>, head string")
    best, size = {}, {}
    for doc, text, *_ in rows:
        best[text or ""] = max(best.get(text or "", -1), -1 if doc is None else doc)
        size[text or ""] = size.get(text or "", 0) + 1
    filled = docs.fillna("", ["text"])
    assert exact_dedup.frequent_texts(filled).count() >= 3
    ordered, _ = exact_dedup.content_sorted(exact_dedup.with_parts(filled), "doc_id")
    hot = ordered.where("text = 'hot'").groupBy("part").count().collect()
    assert len(hot) > 3 and max(r["count"] for r in hot) < size["hot"] / 2
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in best}
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, sha[r.text_sha256]) for r in got) == sorted((-1 if d is None else d, t or "") for d, t, *_ in rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.kept) == (best[sha[r.text_sha256]], size[sha[r.text_sha256]], r.doc_id == r.keep_id)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.schema == docs.schema and {r.text or "": r.doc_id for r in kept.collect()} == best and kept.count() == len(best)


def test_classifiers_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for made, column, least in ((queries.op8_toxicity(spark, sf), "toxic", 0.95), (queries.op4_quality(spark, sf), "quality", 0.95)):
        rows = made.where("held_out").join(labels, "doc_id").collect()
        assert np.mean([r.predicted == r[column] for r in rows]) >= least
        rare = [r for r in rows if r[column] == (1 if column == "toxic" else 0)]
        assert np.mean([r.predicted == r[column] for r in rare]) >= 0.85
    for made in (toxicity.toxicity(odd, labels), quality.quality(odd, labels)):
        scored = made.collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        unary, turn = rng.normal(size=n), rng.normal(size=(2, 2))
        paths = [tuple(k >> i & 1 for i in range(n)) for k in range(2**n)]
        weight = {p: np.exp(sum(unary[i] * s for i, s in enumerate(p)) + sum(turn[a, b] for a, b in zip(p, p[1:]))) for p in paths}
        total = sum(weight.values())
        marginal, pairs = quality.forward_backward(unary, turn)
        assert np.allclose(marginal, [sum(w for p, w in weight.items() if p[i]) / total for i in range(n)])
        assert np.allclose(pairs, [[sum(w * sum(x == (a, b) for x in zip(p, p[1:])) for p, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)])


PARTS = [" ", "  ", "\n", "\t", "a", "don't", "1", ",", "é", "\xa0", "\u3000", "\x1c", "<|endoftext|>", "ß9", "!!", "漢", "\u200b", "▁", "<s>", "\x00", "the", "🙂", "   ", "word"]


def test_tokenizers_against_their_libraries(spark, odd):
    from tokenizers import Tokenizer

    from marksmith.llm.byte_tokens import ByteTokenizer

    library, own, bpe = Tokenizer.from_file(BYTE), ByteTokenizer(BYTE), sentencepiece_bpe.PrefixBpe(PIECE)
    rng = random.Random(1)
    found = [t or "" for t in TEXTS] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    found += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [" " * n + "x" for n in (17, 33, 100)]
    found += [a + space * n + b for space in " \n\t" for n in (4095, 4096, 5000) for a, b in (("x", "y"), ("", ""), ("<|endoftext|>", " y"), ("x", "<|endoftext|>"))]
    for text in found:
        assert own.encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        joined, ids = bpe.encode(text)
        assert ids == bpe.library.encode(text) and joined == ",".join(map(str, ids))
    rows = {r.doc_id: r for r in sentencepiece_bpe.encode_decode(odd, PIECE, digest=True).collect()}
    for doc, text in texts_of(odd):
        if doc is not None:
            ids = bpe.library.encode(text)
            assert rows[doc].n_tokens == len(ids) and rows[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert rows[doc].decoded_sha256 == hashlib.sha256((bpe.library.decode(ids) if ids else "").encode()).hexdigest()


@pytest.mark.parametrize("space", [" ", "\n", "\t"])
def test_two_million_spaces(spark, space):
    """One text of two million spaces, line ends or tabs among others goes through packing and the token store."""
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(BYTE), ["x" + space * 2_000_000 + "y", "a <|endoftext|> b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [np.asarray([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for t in texts]
    rows = token_store.read_tokens(token_store.write_tokens(docs, BYTE)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(w) // 4, zlib.crc32(w)) for w in want]
    pieces = packing.pack_documents(docs, BYTE).groupBy("doc_id").agg({"length": "sum"}).orderBy("doc_id").collect()
    assert [r[1] for r in pieces] == [len(w) // 4 for w in want]


def test_packing(spark, odd):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    rows = packing.pack_documents(docs, BYTE, keep_ids=True).collect()
    windows, pieces = {}, {}
    for r in rows:
        assert 1 <= r.length <= packing.WINDOW and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(r.length for r in rows) / (packing.WINDOW * len(windows)) > 0.95
    for (doc, n), parts in pieces.items():
        if doc not in (None, 3):
            assert sorted(parts) == [(a, min(packing.WINDOW, n - a)) for a in range(0, n, packing.WINDOW)]
    # rows without id, and rows repeated often, don't meet in one block
    same = spark.range(0, 40_000, 1, 4).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", "IF(id % 4 < 2, 'same text', CONCAT('text ', id)) AS text")
    placed = packing.pack_documents(same, BYTE).selectExpr("sequence_id >> 40 AS block").groupBy("block").count().collect()
    assert sum(r[1] for r in placed) == 40_000 and len(placed) >= 8 and max(r[1] for r in placed) <= 4 * packing.BLOCK_PIECES
    # the segment tree against a search of all open windows
    lengths, free, used = np.random.default_rng(5).integers(1, 200, 400), [], []
    for need in sorted(lengths.tolist(), reverse=True):
        fitting = [x for x in free if x >= need]
        room = min(fitting) if fitting else 200
        if fitting:
            free.remove(room)
        else:
            used.append(1)
        if room > need:
            free.append(room - need)
    assert packing.best_fit_decreasing(lengths, 200)[0].max() + 1 == len(used)


def test_token_store(spark, odd):
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 30_000):
        ids = rng.geometric(0.001, n).astype(np.uint32)
        ids[::97] = 2**32 - 1
        back = token_store.unpack_segment(token_store.pack_segment(ids, np.array([5]), np.array([False]), np.array([n])))
        assert (back[0] == ids).all() and back[1].tolist() == [5] and back[3].tolist() == [n]
    segments = token_store.write_tokens(odd, BYTE)
    rows = token_store.read_tokens(segments, keep_ids=True).orderBy("start").collect()
    from marksmith.llm.byte_tokens import ByteTokenizer

    encode, at = ByteTokenizer(BYTE).encode, 0
    want = sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (doc, text), r in zip(want, rows, strict=True):
        data = encode(text) + (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc, at, len(data) // 4, zlib.crc32(data), data)
        at += len(data) // 4


def test_url_filter(spark):
    urls = [
        "http://a.net/x", "http://net", "http://net?x", "HTTPS://EXAMPLE.NET/en/1", "http://b.example.net/en", "http://b.example.com/de/", "x.org/fr/", "http://x.org/fr/1", None, "", "://",
        "http://m.casino-win.example.com/en/1", "http://xcasino-win.example.com/", "http://free-bets.example.com", "http://a.org/en/#", "a://b://c.net/",
    ]
    pages = spark.createDataFrame([(k, u, "verdict") for k, u in enumerate(urls)] + [(0, urls[0], None)], "page_id long, url string, host string")

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            raw = re.match(r"[^/?#]*", rest)[0]
            host, path = raw.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        listed = any(host == d or host.endswith("." + d) for d in url_filter.LISTED_DOMAINS)
        return host, path, rule, verdict or ("block" if listed else "allow")

    domains = url_filter.domain_table(spark, [*url_filter.LISTED_DOMAINS, None, "", url_filter.LISTED_DOMAINS[0]])
    for made in (url_filter.judge_urls(pages, domains), url_filter.judge_urls(pages, domains, max_bytes=8)):  # one cascade, and one for each shard
        rows = made.collect()
        assert len(rows) == pages.count()
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id])
    assert url_filter.judge_urls(pages, domains.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_url_cascades_of_many_hosts(spark):
    """A third of the hosts are listed: a cascade needs several levels and errs on none, and neither do shards below a bound."""
    from pyspark.sql import functions as F

    hosts = spark.range(3000).selectExpr("concat('h', id, '.test') AS host", "id % 3 = 0 AS listed")
    levels = url_filter.build(hosts)
    assert len(levels) > 2 and hosts.where(url_filter.is_member(levels, F.col("host")) != F.col("listed")).count() == 0
    shards = url_filter.build_shards(hosts, 512)
    assert len(shards) > 1 and all(8 * sum(len(level.words) for level in cascade) <= 600 for cascade in shards)
    for k, cascade in enumerate(shards):
        mine = hosts.where(url_filter.shard_of(F.col("host"), len(shards)) == k)
        assert mine.where(url_filter.is_member(cascade, F.col("host")) != F.col("listed")).count() == 0


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(200)], [(rng.randrange(900), rng.randrange(900)) for _ in range(500)], [(a, b) for a in range(40) for b in range(a)]):
        edges = [e for e in edges if e[0] != e[1]]
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == plain_components(edges)


def plain_fingerprint(text, words):
    found = text.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    found = re.findall(r"[^\x20\x09-\x0D]+", found)
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    rng = random.Random(4)
    near = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(n)) for n in (1, 2, 3, 8, 30)]
    rows = [(100 + k, near[k % 5] + (" z" if k % 2 else "")) for k in range(40)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    found = [(d, plain_fingerprint(t, 3)) for d, t in texts_of(docs)]
    edges = [(a, b) for a, x in found for b, y in found if a is not None and b is not None and a > b and (x ^ y).bit_count() <= 2]
    least = plain_components(edges)
    got = simhash_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got) == sorted((d or -1, f"{x:016x}", (None if d is None else least.get(d, d)) or -1) for d, x in found)


def test_simhash_links_of_crowded_buckets(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = [(r.u, r.v) for r in simhash_dedup.links(spark.createDataFrame(list(enumerate(signed)), "node long, fp long")).collect()]
    want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert plain_components(edges) == plain_components(want)
    assert len(edges) < 40 * len(fps)
