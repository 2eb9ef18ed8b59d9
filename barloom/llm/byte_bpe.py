"""Byte-level BPE in linear time, for code inside tasks.

Bytes are read as Latin-1 characters, so that an automaton over strings finds, for every position of a
pre-token, the longest token that starts there (it runs over the reversed text, where those tokens end). The
encoder takes the longest token, or a shorter one that is its prefix, as long as the token fits its left
neighbour; where none fits it steps back and never comes to that position again. Two tokens fit if the merges
would keep the border between them, which is told from how each token was merged and is remembered by pair.
The result is that of the merges in order of rank.
"""

from __future__ import annotations

import base64
from functools import cache

import ahocorasick
import numpy as np
import regex
import tiktoken

from barloom.llm.pieces import HEAD, IdTable, keys

#: Remembered pairs of neighbours, and pre-tokens whose ids are remembered, before they start anew.
MOST_PAIRS, MOST_PIECES = 1_000_000, 200_000
#: Longer pre-tokens are not remembered.
LONGEST_PIECE = 64


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank. Ranks must be 0, 1, 2, ... and hold every single byte."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{path}: ranks have gaps, or bytes are missing")
    return tokens


def merged_by_rank(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The merges of rank less than `below`, lowest first, leftmost first: for tokens, which are short."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        rank, k = min((ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


class Merges:
    """What the encoder knows of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = ranks = {t: k for k, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        # the two tokens that a token was merged from; itself and nothing where it was not
        self.left, self.right = list(range(len(tokens))), [-1] * len(tokens)
        self.whole: dict[tuple[int, int], int] = {}
        for k, t in enumerate(tokens):
            if len(t) > 1:
                parts = merged_by_rank(t, ranks, k)
                if len(parts) == 2:
                    self.left[k], self.right[k] = ranks[parts[0]], ranks[parts[1]]
                    self.whole[self.left[k], self.right[k]] = k
        # the longest other token that a token begins with
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in tokens]
        self.reversed = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(tokens):
            if self.right[k] >= 0 or len(t) == 1:  # other tokens never come from merges
                self.reversed.add_word(t[::-1].decode("latin-1"), k)
        self.reversed.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def fit(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between neighbours a and b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        """Undo the merges of both, the latest first, and see whether the parts that then meet at the border
        would have been merged before. A merge across the border goes first if its rank is lower than that of
        the merge that was undone on the left side (ties cannot be), and on the right side also if it is equal,
        as the left one of two equal merges goes first."""
        limit = len(self.tokens)
        while True:
            across = self.whole.get((a, b))
            if across is not None and across < limit:
                return False
            in_a, in_b = self.right[a] >= 0, self.right[b] >= 0
            if in_a and (a > b or not in_b):
                limit, a = a, self.right[a]
            elif in_b:
                limit, b = b + 1, self.left[b]
            else:
                return True

    def longest(self, text: str) -> list[int]:
        """For each position of a text of Latin-1 characters, the longest token that starts there."""
        n, out = len(text), [-1] * len(text)
        for end, token in self.reversed.iter(text[::-1]):
            at = n - 1 - end
            if out[at] < 0:  # the longest of an end comes first
                out[at] = token
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = self.longest(piece.decode("latin-1"))
        end, out, at = len(piece), [], 0
        open_at = bytearray(b"\x01") * (end + 1)  # 0 where no way leads on
        token, size, fit, shorter = longest[0], self.size, self.fit, self.shorter
        while True:
            upto = at + size[token]
            if open_at[upto] and (not out or fit(out[-1], token)):
                out.append(token)
                at = upto
                if at == end:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]


@cache
def library_class(pattern: str) -> frozenset[str]:
    """The characters that the library takes for a class: it may know another version of Unicode than regex."""
    codes = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return frozenset(asked.decode(asked.encode_ordinary(codes)))


def _ranges(chars: set[str]) -> str:
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def splitter(pattern: str) -> regex.Pattern:
    """The pattern for regex, with letters and numbers as the library knows them."""
    codes = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    known = {}
    for name in (r"\p{L}", r"\p{N}"):
        there, here = library_class(name), set(regex.findall(name, codes))
        known[name] = "[" + name + (f"||[{_ranges(there - here)}]" if there - here else "") + "]"
        if here - there:
            known[name] = f"[{known[name]}--[{_ranges(here - there)}]]"
    for name, chars in known.items():
        pattern = pattern.replace(name, chars)
    return regex.compile(pattern, regex.V1)


class ByteBpe:
    """Ids of whole texts: units of pieces.keys() come from a table, which fits patterns whose matches begin with
    a space or line feed that stands alone; with other patterns the whole text is split."""

    #: The patterns that cut where keys() cuts.
    CUTS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)

    def __init__(self, tokens: list[bytes], pattern: str, most: int = 300_000):
        self.merges, self.split, self.by_unit = Merges(tokens), splitter(pattern), pattern in self.CUTS
        self.kind = "<u2" if len(tokens) <= 1 << 16 else "<u4"
        self.table, self.pieces = IdTable(most, self.kind), {}
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([0, *map(len, tokens)])

    def pretoken(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merges.encode(piece.encode())
            if len(piece) <= LONGEST_PIECE:
                if len(self.pieces) >= MOST_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def whole(self, text: str) -> np.ndarray:
        return np.array([i for piece in self.split.findall(text) for i in self.pretoken(piece)], self.kind)

    def _learn(self, missed: set[str]) -> None:
        new = list(self.table.recall(missed))
        found = [self.whole(u[1:] if u[:1] == HEAD else u if u[:1] == "\n" else " " + u) for u in new]
        if new:
            self.table.add(new, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_unit:
            return [self.whole(t) for t in texts]
        table = self.table
        table.start()
        units = [keys(t) if t else [] for t in texts]
        flat = [u for us in units for u in us]
        missed = set(flat).difference(table.place)
        if missed:
            self._learn(missed)
        ids, lengths = table.gather(table.flat, table.ends, np.fromiter(map(table.place.__getitem__, flat), np.int64, len(flat)))
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, units)])]
        return [ids[a:b] for a, b in zip(upto, upto[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; they need not be a whole text."""
        found, _ = IdTable.gather(self.bytes, self.ends, np.asarray(ids, np.int64))
        return found.tobytes()
