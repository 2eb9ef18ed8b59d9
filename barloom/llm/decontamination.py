"""Benchmark decontamination by size-partitioned MinHash containment search (operator 9).

Test items are partitioned by their number of five-word shingles, up to 1, 2, 4, 8, 16, ... A class of
items up to m shingles is searched in windows of 2m shingles that start every m, so that any run of
m shingles of a document lies within one window and the window's Jaccard similarity with an item
that it contains has a lower bound of about 0.2, however long the document is. A window and an item that
agree in any of HASHES minimum hashes are candidates (missed below 1e-5 of the time at that
similarity); candidates are verified by exact containment of the item's shingles in the document.

Documents are read once for each block of items and are not shuffled; a block of different item texts
(ITEM_BLOCK of them or BLOCK_BYTES, on average half of it) is what is broadcast, so its size does not grow
with the benchmark. Items of equal text are searched once and joined back.

Defined results: a row (doc_id, item_id, n_shared, n_item, containment) for each document that
contains at least `threshold` of an item's distinct shingles. Null or empty texts and items of fewer
than five words match nothing; repeated documents or items each match, null ids too; very long texts are
searched whole, in windows; an empty table on either side gives no row; other columns, whatever their
names, are ignored. without_items() drops the rows that contain an item, by row and not by doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.pieces import slices
from barloom.llm.shingles import WordHashes, mixed, shingle_hashes, words_of

WIDTH, THRESHOLD, HASHES, ITEM_BLOCK, BLOCK_BYTES, SEED = 5, 0.8, 64, 20_000, 16_000_000, 77
COLUMNS = "doc_id long, text_id long, n_shared long, n_item long, containment double"
#: Bits of a hash that a class's bitmaps tell apart, at least and at most; between them, some 64 values an item.
FEWEST_BITS, MOST_BITS = 10, 20

def multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(2 * HASHES, dtype=np.uint64) + np.uint64(SEED))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


class ItemIndex:
    """The minimum hashes of a block of items, by size class."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.mul, self.add = multipliers()
        self.hashes = WordHashes()
        self.ids, self.words, self.sets = [], [], []
        words = [words_of(t) for _, t in items]
        for (item, _), w, h in zip(items, words, self.hashes.hash(words)):
            s = np.unique(shingle_hashes(h, WIDTH))
            if len(s):
                self.ids.append(item)
                self.words.append(w)
                self.sets.append(s)
        self.classes: dict[int, tuple[np.uint64, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {}
        most = [1 << (len(s) - 1).bit_length() for s in self.sets]
        for m in sorted(set(most)):
            members = np.array([i for i, x in enumerate(most) if x == m])
            bits = min(MOST_BITS, max(FEWEST_BITS, (64 * len(members)).bit_length()))
            shift, tables = np.uint64(64 - bits), []
            for k in range(HASHES):
                low = np.array([(self.sets[i] * self.mul[k] + self.add[k]).min() for i in members], np.uint64)
                there = np.zeros(1 << bits, bool)
                there[low >> shift] = True
                order = np.argsort(low)
                tables.append((there, low[order], members[order]))
            self.classes[m] = (shift, tables)

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs of which a window and the item share a minimum hash."""
        if not self.classes:
            return set()
        base = min(self.classes)
        blocks = np.array([-(-len(d) // base) for d in docs])
        first = np.concatenate([[0], np.cumsum(blocks)])
        total = int(first[-1])
        if not total:
            return set()
        grid = np.zeros(total * base, np.uint64)
        for d, at in zip(docs, first):
            if len(d):
                grid[at * base : at * base + len(d)] = d
                grid[at * base + len(d) : (at + -(-len(d) // base)) * base] = d[-1]
        grid = np.ascontiguousarray(grid.reshape(total, base).T)
        owner = np.repeat(np.arange(len(docs)), blocks)
        found: set[tuple[int, int]] = set()
        value, largest = np.empty_like(grid), max(self.classes)
        for k in range(HASHES):
            np.multiply(grid, self.mul[k], out=value)
            value += self.add[k]
            level, m = value.min(axis=0), base
            while True:
                window = np.minimum(level, np.append(level[1:], level[-1]))
                if m in self.classes:
                    shift, tables = self.classes[m]
                    there, low, members = tables[k]
                    at = np.flatnonzero(there[window >> shift])
                    a, b = np.searchsorted(low, window[at], "left"), np.searchsorted(low, window[at], "right")
                    step = m // base
                    for w, x, y in zip(at[a < b].tolist(), a[a < b].tolist(), b[a < b].tolist()):
                        near = set(owner[w * step : (w + 2) * step].tolist())  # a window may reach into the next documents
                        found.update((d, i) for d in near for i in members[x:y].tolist())
                if m >= largest:
                    break
                level = np.minimum(level[0::2], np.append(level, level[-1])[1::2][: len(level[0::2])])
                m *= 2
        return found


def _hits(index: ItemIndex, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(position of a text, id of an item's text, shared shingles, shingles of the item)."""
    for a, b in slices([t or "" for t in texts]):
        words = [words_of(t) for t in texts[a:b]]
        docs = [shingle_hashes(h, WIDTH) for h in index.hashes.hash(words)]
        for d, i in sorted(index.candidates(docs)):
            if np.isin(index.sets[i], docs[d]).sum() >= threshold * len(index.sets[i]) - 1e-9:
                mine, theirs = ({tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)} for w in (index.words[i], words[d]))
                shared = len(mine & theirs)
                if shared >= threshold * len(mine) - 1e-9:
                    yield a + d, index.ids[i], shared, len(mine)


def _search(block: str, items, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = common.worker_state(("items", block), lambda: ItemIndex(items.value))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], i, shared, size, shared / size) for d, i, shared, size in _hits(index, batch.column(1).to_pylist(), threshold)]
            names, kinds = ["doc_id", "text_id", "n_shared", "n_item", "containment"], [pa.int64()] * 4 + [pa.float64()]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return search


def _drop(block: str, items, threshold: float):
    """The text is the last column, beside all that are returned."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = common.worker_state(("items", block), lambda: ItemIndex(items.value))
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[d for d, *_ in _hits(index, batch.column(batch.num_columns - 1).to_pylist(), threshold)]] = False
            out = batch.filter(pa.array(clean))
            yield pa.RecordBatch.from_arrays(out.columns[:-1], names=batch.schema.names[:-1])

    return drop


def _blocks(items: DataFrame) -> Iterator[tuple[str, object]]:
    """Broadcast blocks of item texts (text_id, text) under a name each."""
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // (ITEM_BLOCK // 2)), -(-(size or 0) // (BLOCK_BYTES // 2)))  # by hash: a block of twice the mean is out of reach
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r.text_id, r.text) for r in part])


def _texts(items: DataFrame) -> DataFrame:
    """(text_id, text) of the different texts of items that have a shingle at all."""
    texts = items.where(common.n_words(F.col("text")) >= WIDTH).select("text").distinct()
    return common.keep(texts.withColumn("text_id", F.monotonically_increasing_id()), "item-texts")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents (doc_id, text) and the items (item_id, text) that they contain."""
    common.ship(docs.sparkSession)
    texts = _texts(items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for name, block in _blocks(texts):
        part = rows.mapInArrow(_search(name, block, threshold), COLUMNS)
        found = part if found is None else found.unionByName(part)
    members = items.select(F.col("item_id").cast("long").alias("item_id"), "text").join(texts, "text").select("item_id", "text_id")
    return found.join(members, "text_id").select("doc_id", "item_id", "n_shared", "n_item", "containment")


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text, ...) that contain none of the items (text). One pass over docs a block of items."""
    common.ship(docs.sparkSession)
    # by position within the tasks, as names may hold dots
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema, text = out.schema, F.col(f"c{docs.columns.index('text')}").alias("__text")
    for name, block in _blocks(_texts(items)):
        out = out.select("*", text).mapInArrow(_drop(name, block, threshold), schema)
    return out.toDF(*docs.columns)


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_SHINGLED = "SELECT DISTINCT {id}, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS s FROM (SELECT {id}, w, unnest(range(1, len(w) - 3)) AS k FROM (SELECT {id}, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) >= 5)"


def hits_sql(documents: str = "documents") -> str:
    """CTEs (without WITH) that end in `hits`: doc_id, item_id, n_shared, n_item, containment."""
    return f"""item_shingles AS ({_SHINGLED.format(id="item_id", table="benchmark")})
, doc_shingles AS ({_SHINGLED.format(id="doc_id", table=documents)})
, item_sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id)
, hits AS (SELECT doc_id, i.item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
  FROM item_shingles i JOIN doc_shingles d ON i.s = d.s JOIN item_sizes z ON i.item_id = z.item_id GROUP BY doc_id, i.item_id HAVING count(*) >= {THRESHOLD} * any_value(n_item) - 1e-9)"""


OP9_SQL = f"WITH {hits_sql()} SELECT * FROM hits"
