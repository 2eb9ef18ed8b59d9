"""Substring deduplication by sliding sentence spans (operator 5).

A sentence ends at `.`, `!` or `?` before white space, or at a line feed. Sentences of more than LONGEST words
are cut by content, behind words whose md5 begins with one of CUT_DIGITS, so that a long sentence that two
documents share, or parts of it, falls into the same pieces in both; all other sentences are one piece. From
every piece a run takes as many consecutive pieces as it needs to hold RUN pieces and MIN_WORDS words, and
another run does so backwards from every piece, so that a passage is covered up to both of its ends; a text of
fewer words is one run, if it has RUN pieces. The runs' words, in lower case, are hashed to 96 bits and ranked
over all documents. The first occurrence of a run, by doc_id and position, stays; pieces that any later
occurrence covers are removed. Passages that begin or end within a sentence lose the pieces between.

Texts are cut and hashed once, and only hashes with document and position are shuffled. Of a run's occurrences
among some WINDOW runs of a task only the first one is ranked by its hash; the rest are later ones already and
are dealt by their documents, so that a run in very many documents comes to few rows in one place.

Defined results: null, empty and sentence-less texts, and texts with fewer pieces than RUN, have no run and
stay as they are; very long texts, with or without sentences, are cut and hashed whole; rows with equal doc_id
and text are one document, which stays or loses pieces as one; equal doc_ids with different texts (31 bits of a
hash tell them apart) are different documents; a null doc_id counts as a hash of the text; ties cannot be, as
equal rows are one document; an empty table gives no row. A document that loses pieces gets the rest joined by single spaces, pieces of long sentences with
single spaces inside. Columns other than doc_id and text are left alone, whatever their names; columns named
n_sentences, removed and n_removed give way to those of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from barloom.llm import common

RUN, MIN_WORDS = 2, 10
LONGEST, CUT_DIGITS = 24, "0123"
#: Runs hold fewer pieces: RUN or MIN_WORDS at most.
SIZES = 64
#: Runs that a task compares among themselves at a time.
WINDOW = 1 << 20
_END = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n")
#: Odd numbers: what stands for a run is a polynomial in its pieces' hashes, modulo 2**64.
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@lru_cache(100_000)
def _cuts(word: bytes) -> bool:
    return hashlib.md5(word).hexdigest()[0] in CUT_DIGITS


def pieces_of(text: str | None, plain: bool = False) -> list[bytes]:
    """A text's sentences that hold a word, the long ones in pieces; plain: their words in lower case."""
    out = []
    low = (text or "").lower().encode()  # has the same words and sentence ends
    for s, lower in zip(_END.split((text or "").encode()), _END.split(low)) if not plain else ((x, x) for x in _END.split(low)):
        words = lower.split()
        if len(words) <= LONGEST:
            if words:
                out.append(b" ".join(words) if plain else s.strip())
            continue
        kept, start = words if plain else s.split(), 0
        for k, w in enumerate(words, 1):
            if k == len(words) or _cuts(w):
                out.append(b" ".join(kept[start:k]))
                start = k
    return out


def runs_of(sizes: np.ndarray, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First piece of every run and the piece behind it, given the pieces' words."""
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    if upto[-1] < min_words:
        return (np.array([0]), np.array([n])) if n >= run else (np.empty(0, np.int64), np.empty(0, np.int64))
    k = np.arange(n + 1)
    end = np.maximum(np.searchsorted(upto, upto + min_words), k + run)
    start = np.minimum(np.searchsorted(upto, upto - min_words, "right") - 1, k - run)
    both = np.concatenate([(k * (n + 1) + end)[end <= n], (start * (n + 1) + k)[start >= 0]])
    both = np.unique(both)
    return both // (n + 1), both % (n + 1)


def run_hashes(pieces: list[bytes], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the words of each run."""
    n = len(pieces)
    each = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.uint64).reshape(n, 2)
    out = []
    for base, h in zip(BASES, each.T):
        total, longest = np.zeros(len(start), np.uint64), int((end - start).max(initial=0))
        for k in range(longest):  # at most RUN or MIN_WORDS pieces
            there = start + k < end
            total[there] = total[there] * base + (h[start[there] + k] | np.uint64(1))
        total ^= total >> np.uint64(29)
        out.append(total * BASES[0])
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _first_ones(doc: np.ndarray, spot: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which of the runs have no equal run before them, by doc and spot."""
    order = np.argsort(h1, kind="stable")
    same = h1[order[1:]] == h1[order[:-1]]
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    some = some[np.lexsort((spot[some], doc[some], h2[some], h1[some]))]
    new = np.concatenate([[True], (h1[some[1:]] != h1[some[:-1]]) | (h2[some[1:]] != h2[some[:-1]])])[: len(some)]
    first = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.ones(len(doc), bool)
    out[some] = (doc[some] == doc[first]) & (spot[some] == spot[first])  # rows of equal doc and text are one document
    return out


def _hashed(run: int, min_words: int, window: int = WINDOW):
    """doc, spot (32 bits of the text's hash, then piece and number of pieces of a run) and the run's hash. No
    h2 and any h1: a run that is known to be a later one, or, with 0 as the number, the document's pieces."""

    def told(found: list[list[np.ndarray]], known: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        def rows(doc, spot, h1, h2):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(spot, pa.int64()), pa.array(h1, pa.int64()), h2], names=["doc", "spot", "h1", "h2"])

        if found:
            doc, spot, h1, h2 = (np.concatenate(x) for x in zip(*found))
            first = _first_ones(doc, spot, h1, h2)
            yield rows(doc[first], spot[first], h1[first], pa.array(h2[first], pa.int32()))
            known = [*known, [doc[~first], spot[~first]]]
        if known:
            doc, spot = (np.concatenate(x) for x in zip(*known))
            yield rows(doc, spot, doc * np.int64(0x5851F42D4C957F2D) + spot, pa.nulls(len(doc), pa.int32()))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known, n = [], [], 0
        for batch in batches:
            owner, place, h1, h2, sizes = [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                pieces = pieces_of(text, plain=True)
                sizes.append(len(pieces))
                start, end = runs_of(np.fromiter((p.count(b" ") + 1 for p in pieces), np.int64, len(pieces)), run, min_words)
                if len(start):
                    owner.append(np.full(len(start), k))
                    place.append(start * SIZES + (end - start))
                    for to, x in zip((h1, h2), run_hashes(pieces, start, end)):
                        to.append(x)
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            tie = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 32
            known.append([doc, tie | np.array(sizes, np.int64) * SIZES])
            if owner:
                whose = np.concatenate(owner)
                found.append([doc[whose], tie[whose] | np.concatenate(place), np.concatenate(h1), np.concatenate(h2)])
                n += len(whose)
            if n >= window:
                yield from told(found, known)
                found, known, n = [], [], 0
        yield from told(found, known)

    return spans


def _cleaned(run: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = sorted({k for s in starts for k in range(s // SIZES, s // SIZES + s % SIZES)})
                out = set(gone)
                texts.append(b" ".join(p for k, p in enumerate(pieces_of(text)) if k not in out).decode() if gone else text)
                n.append(max(s // SIZES for s in starts if s % SIZES == 0))
                removed.append(gone)
            told = [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(list(map(len, removed)), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], names=["row", "text", "n_sentences", "removed", "n_removed"])

    return clean


def remove_repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, changed_only: bool = False) -> DataFrame:
    """All columns of docs (doc_id, text, ...) with the text cleaned, and n_sentences (pieces), removed (sorted
    positions) and n_removed as the only others; only documents that lose something if changed_only."""
    if max(run, min_words) >= SIZES:
        raise ValueError(f"run and min_words must be less than {SIZES}")
    common.ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "n_sentences", "removed", "n_removed")]
    # what comes from docs, except for the text, lies in one struct, so that its names cannot clash
    base = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.length("text"))).alias("doc"),
        F.hash("text").bitwiseAND(-2).bitwiseOR(F.col("doc_id").isNotNull().cast("int")).alias("tie"),
        "text",
    )
    spans = base.select("doc", "tie", "text").mapInArrow(_hashed(run, min_words), "doc long, spot long, h1 long, h2 int")
    order = Window.partitionBy("h1", "h2").orderBy("doc", "spot")
    later = spans.withColumn("k", F.rank().over(order)).where("h2 IS NULL OR k > 1")
    place = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF))
    covered = later.groupBy("doc", F.shiftright("spot", 32).cast("int").alias("tie")).agg(F.collect_set(place).alias("starts"))
    if changed_only:
        covered = covered.where(F.exists("starts", lambda s: s % SIZES > 0))
    rows = base.join(covered, ["doc", "tie"])
    told = [StructField("text", StringType()), StructField("n_sentences", LongType()), StructField("removed", ArrayType(IntegerType())), StructField("n_removed", LongType())]
    out = rows.select("row", "text", "starts").mapInArrow(_cleaned(run), StructType([StructField("row", base.schema["row"].dataType), *told]))
    columns = [F.col("text") if c == "text" else F.col(f"row.c{names.index(c)}").alias(c) for c in docs.columns if c == "text" or c in names]
    return out.select(*columns, "n_sentences", "removed", "n_removed")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without the sentences that it loses."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_spans(docs)
    return out.select("doc_id", "n_sentences", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


_W, _S = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]+"
OP5_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(regexp_replace(text, '([.!?]){_S}', '\\1' || chr(10), 'g'), chr(10)) AS ss
  FROM documents
), sentence AS (
  SELECT r, doc_id, sn, s, regexp_extract_all(s, '{_W}') AS ws FROM (SELECT r, doc_id, unnest(range(len(ss))) AS sn, unnest(ss) AS s FROM cut)
  WHERE regexp_matches(s, '{_W}')
), word AS (
  SELECT r, doc_id, sn, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM sentence WHERE len(ws) > {LONGEST}
), numbered AS (
  SELECT *, coalesce(sum(CAST(substr(md5(lower(w)), 1, 1) IN ({", ".join(f"'{d}'" for d in CUT_DIGITS)}) AS INT))
    OVER (PARTITION BY r, sn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM word
), piece AS (
  SELECT r, doc_id, sn, 0 AS part, trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s, len(ws) AS n FROM sentence WHERE len(ws) <= {LONGEST}
  UNION ALL
  SELECT r, doc_id, sn, part, string_agg(w, ' ' ORDER BY k), count(*) FROM numbered GROUP BY r, doc_id, sn, part
), placed AS (
  SELECT r, doc_id, s, n, row_number() OVER w - 1 AS pos, sum(n) OVER w - n AS before, lower(regexp_replace(s, '{_S}', ' ', 'g')) AS plain
  FROM piece WINDOW w AS (PARTITION BY r ORDER BY sn, part ROWS UNBOUNDED PRECEDING)
), ends AS (
  SELECT a.r, a.pos AS x, max(b.pos) AS y FROM placed a JOIN placed b ON a.r = b.r AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS + RUN}
  WHERE b.pos - a.pos < {RUN} OR b.before - a.before < {MIN_WORDS} GROUP BY a.r, a.pos
  UNION
  SELECT b.r, min(a.pos), b.pos FROM placed a JOIN placed b ON a.r = b.r AND a.pos BETWEEN b.pos - {MIN_WORDS + RUN} AND b.pos
  WHERE b.pos - a.pos < {RUN} OR (b.before + b.n) - (a.before + a.n) < {MIN_WORDS} GROUP BY b.r, b.pos
), run AS (
  SELECT e.r, p.doc_id, x AS pos, count(*) AS size, string_agg(p.plain, chr(10) ORDER BY p.pos) AS plain
  FROM ends e JOIN placed p ON e.r = p.r AND p.pos BETWEEN x AND y JOIN (SELECT r, sum(n) AS words FROM piece GROUP BY r) t ON e.r = t.r
  GROUP BY e.r, p.doc_id, x, y HAVING count(*) >= {RUN} AND (sum(p.n) >= {MIN_WORDS} OR sum(p.n) = any_value(words))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc_id, pos) AS k FROM run
), gone AS (
  SELECT DISTINCT r, unnest(range(pos, pos + size)) AS pos FROM ranked WHERE k > 1
)
SELECT c.doc_id, count(p.pos) AS n_sentences, count(g.pos) AS n_removed, coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos), '') AS removed,
  CASE WHEN count(g.pos) > 0 THEN coalesce(string_agg(p.s, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') ELSE any_value(c.text) END AS text
FROM cut c LEFT JOIN placed p ON c.r = p.r LEFT JOIN gone g ON p.r = g.r AND p.pos = g.pos
GROUP BY c.r, c.doc_id"""
