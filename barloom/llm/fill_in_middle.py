"""Fill-in-the-middle documents, cut between lines (operator 11).

A text of n lines (`[^\\n]*\\n|[^\\n]+`) is cut behind two of its lines, which a hash of the seed and doc_id
draws, into prefix, middle and suffix, and written in the order prefix, suffix, middle (psm) or suffix, prefix,
middle (spm) with a marker before each. restore() turns an output back into its text.

Texts are read in chunks that a rolling hash over CHUNK_WINDOW bytes ends, so that passages that documents
share fall into the same chunks wherever they stand. A worker remembers, by the chunk's whole content, what a
chunk adds to its document: characters, line ends and where they lie, markers, and the bytes at its borders,
where a marker may run across. The counts of a document's chunks, added up, tell its lines and the chunk that
holds a cut; no text is split into lines.

Defined results: a null text counts as empty; an empty text, one that holds a marker, and those that the rate
leaves out are plain and stay as they are, with null prefix_chars and middle_chars; prefix, middle or suffix may
be empty; a null doc_id is drawn like an empty one; rows with equal doc_id are drawn alike, each by its own
text; texts of any length are cut as a whole (a text without a chunk end is one chunk); an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.pieces import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that decide whether a chunk ends, and the number of bits that must be 0 there: 1024 bytes on average.
CHUNK_WINDOW, CHUNK_BITS = 32, 10
#: Bytes of chunks that a worker remembers before it starts anew; longer chunks are not remembered.
MOST_REMEMBERED, LONGEST_REMEMBERED = 32_000_000, 16_384

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks end in texts (bytes) that lie one after the other from the given starts: where the hash of
    the last CHUNK_WINDOW bytes of the same text says so and a character ends, and at each text's end."""
    n = len(data)
    rolled, k = _GEAR[data], 1
    while k < CHUNK_WINDOW:  # sums over k bytes become sums over 2 k
        rolled[k:] += rolled[:-k] << np.uint32(k)
        k *= 2
    ends = np.flatnonzero(rolled >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    ends = ends[ends - starts[np.searchsorted(starts, ends, "right") - 1] >= CHUNK_WINDOW]
    return np.union1d(ends, np.append(starts[starts > 0], n))


class Chunk(NamedTuple):
    """What a chunk adds to its document."""

    chars: int
    line_ends: np.ndarray  # bytes up to and with each line feed
    line_chars: np.ndarray  # characters up to there
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes) -> Chunk:
    data = np.frombuffer(chunk, np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80)
    ends = np.flatnonzero(data == 10) + 1
    return Chunk(int(chars[-1]), ends, chars[ends - 1], any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])


class Chunks:
    """Summaries by content."""

    def __init__(self, most: int = MOST_REMEMBERED):
        self.most, self.known, self.size, self.met = most, {}, 0, 0

    def of(self, chunk: bytes) -> Chunk:
        found = self.known.get(chunk)
        if found is not None:
            self.met += 1
            return found
        found = summary(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if self.size > self.most:
                self.known, self.size = {}, 0
            self.known[chunk] = found
            self.size += len(chunk)
        return found


class Combined:
    """A document's chunks, added up."""

    def __init__(self, chunks: list[Chunk], sizes: list[int]):
        self.chunks = chunks
        self.bytes = np.cumsum([0, *sizes])
        self.chars = np.cumsum([0, *(c.chars for c in chunks)])
        self.feeds = np.cumsum([0, *(len(c.line_ends) for c in chunks)])
        size = int(self.bytes[-1])
        self.lines = int(self.feeds[-1]) + bool(size and chunks[-1].tail[-1:] != b"\n")
        self.marked, border = False, b""
        for c in chunks:
            if c.marked or any(m in border + c.head for m in MARKERS):
                self.marked = True
                break
            border = (border + c.tail)[-2:]

    def behind(self, lines: int) -> tuple[int, int]:
        """Bytes and characters of the first lines."""
        if lines == 0:
            return 0, 0
        if lines > self.feeds[-1]:
            return int(self.bytes[-1]), int(self.chars[-1])
        k = int(np.searchsorted(self.feeds, lines)) - 1
        at = lines - 1 - int(self.feeds[k])
        c = self.chunks[k]
        return int(self.bytes[k] + c.line_ends[at]), int(self.chars[k] + c.line_chars[at])


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _transform(seed: int, rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = common.worker_state("chunks", Chunks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                data = [t.encode() for t in texts[a:b]]
                yield pa.RecordBatch.from_pylist(list(_forms(chunks, seed, rate, spm_rate, ids[a:b], data)), schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _forms(chunks: Chunks, seed: int, rate: int, spm_rate: int, ids: list, data: list[bytes]) -> Iterator[dict]:
    joined, starts = b"".join(data), np.cumsum([0, *map(len, data)])
    ends = chunk_ends(np.frombuffer(joined, np.uint8), np.unique(starts[:-1])) if joined else np.empty(0, np.int64)
    at = np.searchsorted(ends, starts, "right")
    for k, (doc_id, text) in enumerate(zip(ids, data)):
        own = [starts[k], *ends[at[k] : at[k + 1]]] if text else []
        cut = [joined[x:y] for x, y in zip(own, own[1:])]
        doc = Combined([chunks.of(c) for c in cut], [len(c) for c in cut])
        h1, h2, h3, h4 = draws(seed, doc_id)
        row = {"doc_id": doc_id, "n": doc.lines}
        if not text or doc.marked or h3 % 100 >= rate:
            yield row | {"form": "plain", "prefix_chars": None, "middle_chars": None, "output": text.decode()}
            continue
        (p, p_chars), (m, m_chars) = (doc.behind(x) for x in sorted((h1 % (doc.lines + 1), h2 % (doc.lines + 1))))
        spm = h4 % 100 < spm_rate
        if spm:
            out = SUFFIX + text[m:] + PREFIX + text[:p] + MIDDLE + text[p:m]
        else:
            out = PREFIX + text[:p] + SUFFIX + text[m:] + MIDDLE + text[p:m]
        yield row | {"form": "spm" if spm else "psm", "prefix_chars": p_chars, "middle_chars": m_chars - p_chars, "output": out.decode()}


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each document (doc_id, text). rate is the share
    of documents in a hundred that are transformed, spm_rate that of spm among them."""
    common.ship(docs.sparkSession)
    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_transform(seed, rate, spm_rate), columns)


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed: no text that holds a marker is, so that markers part the output."""
    parts = F.split(output, "<[PSM]>", -1)
    before, after = F.when(form == "spm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))), F.when(form == "spm", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.concat(before, F.get(parts, F.lit(3)), after))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms every document, restores it from the output, and digests both."""
    out = fill_in_middle(common.table(spark, sf_dir, "documents"))
    digest = {"output_sha256": F.col("output"), "restored_sha256": restore(F.col("output"), F.col("form"))}
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c.cast("binary"), 256).alias(k) for k, c in digest.items()])


OP11_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS ls,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(ls) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM lines
), cut AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
      WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(ls[1 : least(d[1] % (n + 1), d[2] % (n + 1))], '') AS p,
    array_to_string(ls[least(d[1] % (n + 1), d[2] % (n + 1)) + 1 : greatest(d[1] % (n + 1), d[2] % (n + 1))], '') AS m,
    array_to_string(ls[greatest(d[1] % (n + 1), d[2] % (n + 1)) + 1 :], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut"""
