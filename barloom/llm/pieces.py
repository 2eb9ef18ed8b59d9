"""Word-wise encoding with caches, exact for tokenizers whose tokens never span the cut points.

A text may be cut before a single space, and before a single line feed, if the characters around
are no white space: neither tokenizer below has a token across such a point. Each unit is encoded
by the tokenizer library once and then comes from a bounded cache in the worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np

#: Stands before the first unit of a text; a line feed before the first unit of a line; other units
#: follow a space, which their key leaves out.
HEAD = "\x01"
CUT = re.compile(r"(?<=[^\s▁])([ \n])(?=[^\s▁])")
#: Longer units are not cached beyond the texts at hand.
LONGEST_CACHED = 48
#: Letters up to here are letters to Python and the libraries alike; ASCII marks but the apostrophe, which may
#: begin a token with the letters after it.
LAST_LETTER, MARKS = "\u024f", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that go through the model at a time.
JOINED = 64
#: Texts that the library encodes at a time; each of its results holds about a KB besides the ids.
ENCODED = 1024
#: Different runs of marks that are kept.
MOST_MARKS = 20_000


def keys(text: str) -> list[str]:
    """The text's units in order."""
    flat = text.replace("\n", " ")
    if flat.isprintable() and "  " not in flat and "▁" not in flat and flat[:1] != " " and flat[-1:] != " ":
        return (HEAD + text.replace("\n", " \n")).split(" ")
    if HEAD in text:
        return [HEAD + text]
    parts = CUT.split(text)
    return [HEAD + parts[0], *(u if sep == " " else "\n" + u for sep, u in zip(parts[1::2], parts[2::2]))]


class UnitCache(dict):
    """Results by unit. What is used stays: when full, the entries become the old ones, from which
    those that are met again come back before the next time drops the rest."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old, self.long = most, {}, []

    def start(self) -> None:
        for u in self.long:
            self.pop(u, None)
        self.long = []
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def fill(self, wanted: set, encode: Callable[[list], list]) -> None:
        new = wanted - self.keys()
        known = self.old.keys() & new
        self.update((u, self.old[u]) for u in known)
        new = list(new - known)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.update(zip(part, encode(part)))
        self.long += [u for u in new if len(u) > LONGEST_CACHED]


class IdTable:
    """Ids by unit, in one array. What is used stays: when full, the units become the old ones, from which
    those that are met again come back before the next time drops the rest."""

    def __init__(self, most: int, kind: str, most_ids: int = 8_000_000):
        self.most, self.most_ids, self.kind = most, most_ids, kind
        self.clear()
        self.old = (self.place, self.flat, self.ends)

    def clear(self) -> None:
        self.place: dict = {}
        self.flat, self.ends = np.empty(1 << 16, self.kind), np.zeros(1 << 16, np.int64)
        self.n, self.size, self.long = 0, 0, []

    def start(self) -> None:
        for u in self.long:
            self.place.pop(u, None)
        self.long = []
        if len(self.place) > self.most or self.size > self.most_ids:
            self.old = (self.place, self.flat, self.ends)
            self.clear()

    def add(self, units: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Units with their ids, one after the other."""
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(units) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(units)] = self.size + np.cumsum(lengths)
        self.place.update(zip(units, range(self.n, self.n + len(units))))
        self.n, self.size = self.n + len(units), self.size + len(ids)
        self.long += [u for u in units if u is not None and len(u) > LONGEST_CACHED]

    @staticmethod
    def gather(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and their numbers."""
        first, lengths = ends[index], ends[index + 1] - ends[index]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        return flat[np.arange(total) + np.repeat(first - upto + lengths, lengths)], lengths

    def recall(self, wanted: set) -> set:
        """Take over wanted units that the old table has; the others."""
        place, flat, ends = self.old
        known = [u for u in wanted if u in place]
        if known:
            self.add(known, *self.gather(flat, ends, np.fromiter(map(place.__getitem__, known), np.int64, len(known))))
        return wanted.difference(known)

    def bytes_of(self, unit) -> bytes:
        k = self.place[unit]
        return self.flat[self.ends[k] : self.ends[k + 1]].tobytes()


class ByteLevelIds:
    """Ids of a `tokenizers` byte-level BPE as little-endian uint16 or uint32."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.table = IdTable(most, self.kind)
        show = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {b: show(chr(b))[0][0] for b in range(128) if b != 10}  # how the model spells bytes
        self.letters |= {b: ch for c in range(0x80, 0x250) for b, ch in zip(chr(c).encode(), show(chr(c))[0][0])}
        self.space = self.letters[32]
        vocabulary = self.tok.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.starts[[i for t, i in vocabulary.items() if t.startswith(self.space)]] = True
        # no token has a space behind a letter, so that words can go through the model together
        letters = ["".join(self.letters[x] for x in chr(c).encode()) for c in range(0x41, 0x250) if chr(c).isalpha()]
        inner = [t[:k] for t in vocabulary for k in range(1, len(t)) if t[k] == self.space and t.strip(self.space)]
        self.marks = {"": b"", HEAD: b"", "\n": self._encode(["\n"])[0]}
        self.together = not any(p.endswith(x) or x.endswith(p) for p in inner for x in letters)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), ENCODED):
            out += [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts[i : i + ENCODED], add_special_tokens=False)]
        return out

    def _spelled(self, words: list[str]) -> list[str]:
        return "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n") if words else []

    def _after_space(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, each after a space: one pre-token, so that the library's
        model can take it without the steps before."""
        out: list[bytes] = []
        tokenize, width = self.tok.model.tokenize, np.dtype(self.kind).itemsize
        spelled = self._spelled(words)
        for i in range(0, len(spelled), JOINED):
            part = spelled[i : i + JOINED]
            ids = np.array([t.id for t in tokenize(self.space + self.space.join(part))], self.kind)
            at = [*(np.flatnonzero(self.starts[ids]) * width).tolist(), len(ids) * width]
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip(at, at[1:])]
        return out

    def _without_space(self, words: list[str]) -> list[bytes]:
        tokenize = self.tok.model.tokenize
        return [array(self.code, [t.id for t in tokenize(w)]).tobytes() for w in self._spelled(words)]

    def _learn(self, new: set) -> None:
        """Put units into the table. Marks that end a word of plain letters are a pre-token of their own; word
        and marks are looked up apart, and so are a line feed and the word after it."""
        table = self.table
        new = table.recall(new)
        plain, marked, other = [], [], []
        if not self.together:
            other = list(new)
            new = ()
        if len(self.marks) > MOST_MARKS:
            self.marks = {k: v for k, v in self.marks.items() if k in ("", HEAD, "\n")}
        for u in new:
            word = u.rstrip(MARKS)
            lead = word[:1]
            if lead == "\n" or lead == HEAD:
                word = word[1:]
            else:
                lead = ""
            if word.isalpha() and (word.isascii() or max(word) <= LAST_LETTER):
                if lead or len(word) < len(u):
                    marked.append((u, lead, word, u[len(lead) + len(word) :]))
                else:
                    plain.append(u)
            else:
                other.append(u)
        todo = table.recall({w for _, lead, w, _ in marked if not lead and w not in table.place}.union(plain))
        self._add(list(todo), self._after_space(list(todo)))
        bare = list({w for _, lead, w, _ in marked if lead})
        first = dict(zip(bare, self._without_space(bare)))
        rest = list({m for *_, m in marked} - self.marks.keys())
        self.marks.update(zip(rest, self._encode(rest)))
        known, get = self.marks, table.bytes_of
        self._add([u for u, *_ in marked], [known[lead] + first[w] + known[m] if lead else get(w) + known[m] for _, lead, w, m in marked])
        self._add(other, self._whole(other))

    def _add(self, units: list, data: list[bytes]) -> None:
        width = np.dtype(self.kind).itemsize
        self.table.add(units, np.frombuffer(b"".join(data), self.kind), np.fromiter(map(len, data), np.int64, len(data)) // width)

    def _whole(self, units: list[str]) -> list[bytes]:
        return self._encode([u[1:] if u[:1] == HEAD else u if u[:1] == "\n" else " " + u for u in units])

    def ids(self, texts: list[str], end: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end ids behind it, and their numbers."""
        behind = np.array(end, self.kind)
        if not self.by_unit:
            data = [d + behind.tobytes() for d in self._encode(texts)]
            return np.frombuffer(b"".join(data), self.kind), np.array([len(d) for d in data], np.int64) // behind.itemsize
        table = self.table
        table.start()
        units: list = []
        starts = []
        for t in texts:
            starts.append(len(units))
            units += keys(t)
            units.append(None)  # stands for the end
        if None not in table.place:
            table.add([None], behind, np.array([len(behind)]))
        index = np.fromiter(map(table.place.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            missed = [units[i] for i in missing]
            self._learn(set(missed))
            index[missing] = np.fromiter(map(table.place.__getitem__, missed), np.int64, len(missed))
        ids, lengths = table.gather(table.flat, table.ends, index)
        return ids, np.add.reduceat(lengths, starts) if starts else np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, lengths = self.ids(texts)
        at = np.cumsum([0, *lengths])
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


class PieceLengths:
    """Numbers of tokens by a `sentencepiece` model: a fixed table of frequent units first, then a
    cache of this worker, then the library."""

    def __init__(self, path: str, frequent: dict[str, int], most: int = 250_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent, self.cache = frequent, UnitCache(most)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        one = self.sp.encode("a\nb", out_type=str)
        self.by_unit = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and one == ["▁a", "<0x0A>", "b"]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def units(self, new: list[str]) -> list[int]:
        """The library puts a space before each text: the one that a unit follows, or, before a
        line feed, a token too many."""
        return [n - (u[:1] == "\n") for u, n in zip(new, self.whole([u[1:] if u[:1] == HEAD else u for u in new]))]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return self.whole(texts)
        table, out, rest = self.frequent.get, [], []
        for text in texts:
            cut = keys(text) if text else []
            known = list(map(table, cut))
            rest.append([u for u, n in zip(cut, known) if n is None])
            out.append(sum(filter(None, known)))
        self.cache.start()
        self.cache.fill(set().union(*rest), self.units)
        return [n + sum(map(self.cache.__getitem__, r)) for n, r in zip(out, rest)]


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) ranges of about so many characters, to bound what is held at once."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
