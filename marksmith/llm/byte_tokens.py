"""Byte-level BPE ids of whole texts, from the vocabulary file of the tokenizers library.

The file's merges rank its tokens, so its ids are those ranks; they are applied by tiktoken, whose core
does the same merges in a fifth of the CPU time. The tests hold the ids against the tokenizers library
as it is loaded, and loading checks that the file is of the kind for which this is so: byte-level, split
by the usual pattern, without normaliser, every merge's token in rank order. Ids travel as little-endian
unsigned 32-bit bytes.

Defined results: the empty text has no ids. An added token's string in a text (``<|endoftext|>``) is that
token, as the library has it. White space of any length is encoded: tiktoken's pattern would overflow its
stack on a run of a million, so long runs are cut out first, at the point where the pattern ends them.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the split pattern of byte-level BPE tokenizers of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern's \s has it, in runs that are long enough to be cut out.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LONG_SPACE = re.compile(f"[{''.join(map(chr, SPACES))}]{{4096,}}")

#: A sample that loading encodes both ways.
SAMPLE = " It's  9\tpièces…\n\n  <|endoftext|>漢字 !!  we'll" + chr(0xA0) + "x  "


def byte_of_char() -> dict[str, int]:
    """The bytes behind the printable characters in which such a file writes its tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteTokenizer:
    """ids(text) gives the ids as the library's encode(text, add_special_tokens=False) does, encode(text) their bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, of, added = spec["pre_tokenizer"], byte_of_char(), spec["added_tokens"]
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"] or not plain:
            raise ValueError("this tokenizer file is of another kind")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.added}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        library = Tokenizer.from_file(path)  # not kept: it would hold the vocabulary twice
        if library.encode(SAMPLE, add_special_tokens=False).ids != self.ids(SAMPLE):
            raise ValueError("this tokenizer file's ids aren't its merge ranks")

    def _plain_ids(self, text: str) -> list[int]:
        if len(text) < 4096:
            return self.core.encode_ordinary(text)
        found, at = [], 0
        for run in LONG_SPACE.finditer(text):
            # before a word the pattern leaves the run's last character to what follows
            end = run.end() - (run.end() < len(text))
            found += self.core.encode_ordinary(text[at : run.start()])
            found += self.core._encode_single_piece(text[run.start() : end])
            at = end
        return found + self.core.encode_ordinary(text[at:]) if at else self.core.encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain_ids(text)
        found: list[int] = []
        for part in self.cut.split(text):
            found += [self.added[part]] if part in self.added else self._plain_ids(part)
        return found

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype="<u4").tobytes()


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One per worker process and path."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]
