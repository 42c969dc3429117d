"""SentencePiece BPE by a table of prefixes, and decoding.

BPE gives every prefix of a word one last token. An automaton finds all vocabulary pieces that end at
a position; of these, the last token is the one that is compatible with the last token of the prefix
before it, that is, where merging the two pieces' characters gives the same two pieces back. The table
is filled from left to right and the ids are read off backwards, in time linear in the word.

No piece of the vocabulary holds the space mark behind another character, so a word (its space mark
first) is encoded alone; words are remembered per worker, up to a bound. Runs of space marks longer
than one have pieces of one equal score, for which the leftmost merge goes first; they are merged so.
The file's normaliser is the identity with a leading space mark, which loading checks.

Defined results: null and empty texts have no ids and decode to the empty text. Words of any length are encoded
in time linear in it, runs of space marks in n log n. Rows that repeat an id are encoded one by one. An empty
table gives an empty table. Only the id and the text are read, so extra columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record_batches, texts

MARK = "▁"
#: Words and pairs that a worker remembers, the longest word and the longest run of spaces that it remembers.
MEMO_WORDS, MEMO_PAIRS, MEMO_CHARS, MEMO_RUN = 350_000, 400_000, 40, 1000
#: Characters that are split off a word's end, when a letter stands before them.
TAIL = ".,;:!?#$%&*|)"
#: An unknown character's place in the prefix table; its ids are the bytes.
UNKNOWN = -1


class PrefixBpe:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        normal = [k for k in range(len(self.piece)) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.id = {self.piece[k]: k for k in normal}
        self.score = {k: sp.get_score(k) for k in normal}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spec = sentencepiece.SentencePieceNormalizer(model_file=path)
        sample = "A  éﬁ\t　 x "
        if spec.normalize(sample).replace(MARK, " ") != " " + sample or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("this tokenizer's normaliser or vocabulary is of another kind")
        self.marks = sorted((p for p in self.id if not p.strip(MARK)), key=len)
        if any(p.startswith(MARK * 2) for p in self.id if p.strip(MARK)):
            raise ValueError("a piece has several space marks before a word")
        if any(a.isalpha() and not (b.isalpha() or b == MARK) for p in self.id for a, b in zip(p, p[1:])):
            raise ValueError("a piece has a letter before another character")
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, k in self.id.items():
            if (len(p.strip(MARK)) or p == MARK) and self.merge(list(p)) == [p]:  # others are never a last token
                self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        self.memo: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.tails: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.runs: dict[int, list[int]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE by merging: the best-scored adjacent pair first, the leftmost of equals."""
        while True:
            best = None
            for k in range(len(symbols) - 1):
                found = self.id.get(symbols[k] + symbols[k + 1])
                if found is not None and (best is None or self.score[found] > best[0]):
                    best = (self.score[found], k)
            if best is None:
                return symbols
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pieces stay apart when their characters are merged."""
        pair = [self.piece[left], self.piece[right]]
        return self.merge(list(pair[0] + pair[1])) == pair

    def prefix_ids(self, word: str) -> list[int]:
        """Ids of a word that holds at most one space mark, at its start."""
        pairs, size_of_vocabulary = self.pairs, len(self.piece)
        n = len(word)
        last, width = [UNKNOWN] * (n + 1), [1] * (n + 1)
        filled = -1
        for end, (token, size) in self.automaton.iter(word):
            if end == filled:
                continue
            left = last[end + 1 - size]
            if left >= 0:
                key = left * size_of_vocabulary + token
                known = pairs.get(key)
                if known is None:
                    if len(pairs) > MEMO_PAIRS:
                        pairs.clear()
                    known = pairs[key] = self.compatible(left, token)
                if not known:
                    continue
            last[end + 1], width[end + 1], filled = token, size, end
        ids: list[int] = []
        at = n
        while at:
            if last[at] == UNKNOWN:
                ids += [self.byte[b] for b in reversed(word[at - 1].encode())]
            else:
                ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def run_ids(self, n: int) -> list[int]:
        """Ids of n space marks: pieces of equal score, so the leftmost pair that can merge goes first."""
        if n in self.runs:
            return self.runs[n]
        sizes, known = [1] * n, {len(p) for p in self.marks}
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [k for k in range(n - 1) if 2 in known]
        sizes_at = {k: 2 for k in heap}
        while heap:
            k = heapq.heappop(heap)
            r = after[k] if alive[k] else n
            if not alive[k] or r >= n or sizes[k] + sizes[r] != sizes_at.get(k):
                continue
            sizes[k] += sizes[r]
            alive[r], after[k] = False, after[r]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and sizes[left] + sizes[after[left]] in known:
                    sizes_at[left] = sizes[left] + sizes[after[left]]
                    heapq.heappush(heap, left)
        found = [self.id[MARK * sizes[k]] for k in range(n) if alive[k]]
        if n <= MEMO_RUN:
            self.runs[n] = found
        return found

    def word(self, word: str, marks: int) -> list[int]:
        """Ids of ``marks`` space marks and a word behind them."""
        if not word:
            return self.run_ids(marks)
        ids = self.prefix_ids(MARK + word)
        if marks == 1:
            return ids
        if ids[0] == self.id[MARK]:
            return self.run_ids(marks) + ids[1:]
        return self.run_ids(marks - 1) + ids

    def encode(self, text: str) -> tuple[str, list[int]]:
        """Ids of the text as decimals joined by commas, and as a list."""
        if not text:
            return "", []
        memo, ids, joined, marks = self.memo, [], [], 0
        parts = text.replace(MARK, " ").split(" ")
        final = len(parts) - 1
        for k, part in enumerate(parts):
            marks += 1
            if part == "" and k < final:
                continue
            if part == "":
                found = self._entry("", marks)
            elif marks == 1:
                found = memo.get(part)
                if found is None:
                    found = self._fresh(part)
            else:
                found = self._entry(part, marks)
            joined.append(found[0])
            ids += found[1]
            marks = 0
        return ",".join(joined), ids

    def _fresh(self, part: str) -> tuple[str, tuple[int, ...]]:
        """A word that isn't remembered: no piece goes past the end of its letters, so what follows them is looked up apart."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        letters = part.rstrip(TAIL)
        if letters and letters != part and letters[-1].isalpha():
            tail = part[len(letters) :]
            if (first := memo.get(letters)) is None:
                first = self._entry(letters, 1)
                if len(letters) <= MEMO_CHARS:
                    memo[letters] = first
            if (second := self.tails.get(tail)) is None:
                ids = self.prefix_ids(tail)
                second = ",".join(map(str, ids)), tuple(ids)
                if len(tail) <= 4:
                    self.tails[tail] = second
            return f"{first[0]},{second[0]}", first[1] + second[1]
        found = self._entry(part, 1)
        if len(part) <= MEMO_CHARS:
            memo[part] = found
        return found

    def _entry(self, part: str, marks: int) -> tuple[str, tuple[int, ...]]:
        ids = self.word(part, marks)
        return ",".join(map(str, ids)), tuple(ids)


_LOADED: dict[str, PrefixBpe] = {}


def coder(path: str) -> PrefixBpe:
    """One per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


CODED = "doc_id long, n_tokens long, ids string, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the ids (decimals joined by commas) and decoded text, or with ``digest`` their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                joined, ids = bpe.encode(text)
                back = bpe.library.decode(ids) if ids else ""
                out.append((doc, len(ids), sha(joined), sha(back)) if digest else (doc, len(ids), joined, back))
            yield from record_batches(out, DIGEST if digest else CODED)

    return texts(docs, id_col, text_col).mapInArrow(run, DIGEST if digest else CODED)
