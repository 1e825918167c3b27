"""Byte-pair encoding inside tasks: where pieces of a text end, merging with a heap and a linked list, and bounded memos."""

from __future__ import annotations

import heapq
import json
import re
from functools import cached_property
from pathlib import Path

import numpy as np
import regex

#: The pattern by which the byte-level vocabulary parts a text.
#: White space is written out, as libraries differ on the separators 1C to 1F.
_SPACE = "\\t\\n\\x0b\\x0c\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
END = "<|endoftext|>"
_RUN = re.compile(r"\s \s")
_MEMO = 250_000
_GAP = re.compile(f"[{_SPACE}]+")
#: White space in a row from which on tiktoken's matcher runs out of stack (it does at a million).
_GAP_MOST = 100_000


def vocabulary(path: str) -> bytes:
    """The file's bytes, read once where the job starts; a vocabulary's size doesn't depend on the data."""
    return Path(path).read_bytes()


def merge_ranks(raw: bytes) -> dict[tuple[str, str], int]:
    """Rank of each pair of a byte-level .json vocabulary."""
    pairs = json.loads(raw)["model"]["merges"]
    return {tuple(p.split(" ") if isinstance(p, str) else p): k for k, p in enumerate(pairs)}


def byte_symbols() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens that merging leaves of ``symbols``: their number less the merges done.

    The pair of the lowest rank, the leftmost of equals, is popped from a heap
    and merged in a doubly linked list; entries that no longer stand are skipped.
    """
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    text: list[str | None] = list(symbols)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if text[i] != a or j >= n or text[j] != b:
            continue
        text[i], text[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, text[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, text[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((text[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, text[h], a + b))
        merges += 1
    return n - merges


class Memo(dict):
    """What ``of`` gives for each piece, kept for a bounded number of pieces."""

    def __init__(self, of, most: int = _MEMO) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, piece: str):
        value = self.of(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


def chunks(text: str) -> list[str]:
    """Parts of ``text`` that can be encoded one by one: each runs from one space to the next.

    Only a run of white space reaches over a space; a text with a space between
    other white space stays whole.
    """
    if "  " in text or " " not in text or _RUN.search(text):
        return [text] if text else []
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    return [first, *out] if first else out


class Counter:
    """Tokens of whole texts, by merging; the string END counts one, as the library has it."""

    def __init__(self, raw: bytes) -> None:
        ranks, symbols, pieces = merge_ranks(raw), byte_symbols(), regex.compile(PATTERN)
        self.pieces = Memo(lambda piece: merged_count([symbols[b] for b in piece.encode("utf-8", "surrogatepass")], ranks))
        self.chunks = Memo(lambda chunk: sum(map(self.pieces.__getitem__, pieces.findall(chunk))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.split(END)
        return len(parts) - 1 + sum(sum(map(self.chunks.__getitem__, chunks(p))) for p in parts)


def token_ranks(raw: bytes) -> dict[bytes, int]:
    """Id of each token of a byte-level .json vocabulary by its bytes; ids rise in the order of the merges."""
    byte = {c: b for b, c in enumerate(byte_symbols())}
    return {bytes(byte[c] for c in token): i for token, i in json.loads(raw)["model"]["vocab"].items() if token != END}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit values.

    The merging is tiktoken's, which gives the ids of the tokenizers library
    for the same vocabulary several times as fast; END in a text is its own id.
    Texts with very long white space go through the tokenizers library itself.
    """

    def __init__(self, raw: bytes) -> None:
        import tiktoken

        ends = [t["id"] for t in json.loads(raw)["added_tokens"] if t["content"] == END]
        self.coder = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=token_ranks(raw), special_tokens={})
        self.end = ends[0].to_bytes(4, "little") if ends else None
        self.raw = raw

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.raw.decode("utf-8"))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) >= _GAP_MOST and max(map(len, _GAP.findall(text)), default=0) >= _GAP_MOST:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(END) if self.end else [text]
        return (self.end or b"").join(np.array(self.coder.encode_ordinary(p), "<u4").tobytes() for p in parts)
