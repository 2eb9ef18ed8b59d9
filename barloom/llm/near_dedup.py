"""Near-duplicate documents by ProbMinHash (operator 10).

Elements are five-word shingles, weighted by how often they occur in the document; documents are
near-duplicates at a probability Jaccard similarity of 0.8 or more (equal to the Jaccard similarity
where no shingle repeats). Exact copies (equal words) form a class; only classes are signed into bands,
linked and verified, under numbers that are given to them when their table is written.

In a bucket of equal bands each class is first compared with the leader, the member that meets most
others over all its bands, so that a group of near copies links to its common origin in a few pairs
a document. Buckets that then still hold several components are looked at again: classes outside a
bucket's main component meet those members of other components that may be similar enough, and no
colliding pair of different components is left unverified unless an exact bound excludes it. Nothing
is capped. The bounds, for classes with m and n distinct shingles:

- a class whose weight lies by more than 1 - threshold on shingles of no other candidate has no link;
- where no shingle repeats, c shared shingles give a similarity of c / (m + n - c), and c is at most the
  number of shingles that others have too: this leaves a range of sizes n, which is part of the join's key;
- c is also at most m less the set bits of one document's bitmap of shingles that the other's lacks;
- with u and v the shares of weight on shingles that the other lacks, the similarity is at most
  (1 - u) * (1 - v) / (1 - u * v); u is at least the share on shingles of no other candidate, and at least that of
  the set bits that the other's bitmap lacks, each of which stands for one shingle or more.

Pairs must also agree in MIN_AGREE of the signature's registers by two bits of each (a pair at the
threshold misses this a few times in a million).

Defined results: null texts and texts without words are never duplicates (class and group are their
own doc_id); texts of one to four words are only compared as exact copies; very long texts are hashed
whole; rows that repeat a doc_id each get a row, by their own text; a class has the smallest doc_id of
its rows (null where all are null), a group the smallest of all classes that links connect; ties of ids
do not occur as equal words are one class; an empty table gives no row; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.components import components, merged
from barloom.llm.pieces import slices
from barloom.llm.probminhash import bands, signatures, similarity, two_bits
from barloom.llm.shingles import WordHashes, shingle_hashes, words_of

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
#: Registers by two bits that pairs must agree in: at similarity 0.8, 102 of 120 do, give or take 3.9.
MIN_AGREE = 84
#: Words of 64 bits in a document's bitmap of shingles; size classes for each unit of a size's logarithm.
WORDS, CLASSES = 16, 16
EPS = 1e-9


def _shingles(texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    words = [words_of(t) for t in texts]
    return words, [shingle_hashes(h, WIDTH) for h in common.worker_state("words", WordHashes).hash(words)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for a, b in slices([t or "" for t in texts]):
            words, shingles = _shingles(texts[a:b])
            copies = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
            sets = [np.unique(s, return_counts=True) for s in shingles]
            signed = [i for i, s in enumerate(sets) if len(s[0])]
            found: list[list[int] | None] = [None] * (b - a)
            sketches: list[list[int] | None] = [None] * (b - a)
            if signed:
                owner = np.repeat(np.arange(len(signed)), [len(sets[i][0]) for i in signed])
                kept = signatures(len(signed), owner, np.concatenate([sets[i][0] for i in signed]), np.concatenate([sets[i][1] for i in signed]), BANDS * ROWS)
                for i, row, sketch in zip(signed, bands(kept, ROWS).tolist(), two_bits(kept).tolist()):
                    found[i], sketches[i] = row, sketch
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(a, b - a), "hash": hashes.slice(a, b - a), "copy": pa.array(copies, pa.binary()), "bands": pa.array(found, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64()))})


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in slices(texts):
            _, shingles = _shingles(texts[a:b])
            yield pa.RecordBatch.from_pydict({"node": nodes.slice(a, b - a), "shingles": pa.array([s.tobytes() for s in shingles], pa.binary())})


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(k).to_pylist() for k in range(4))
            ok = [i for i in range(len(a)) if similarity(np.frombuffer(left[i], np.uint64), np.frombuffer(right[i], np.uint64)) >= threshold]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in ok], pa.int64()), "b": pa.array([b[i] for i in ok], pa.int64())})

    return verify


def _links(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold. The pairs are a written table, so that each join
    stands between plain exchanges and Spark can split the rows of a leader that very many meet."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(threshold), "a long, b long")


def _counts(shingles: DataFrame) -> DataFrame:
    """node, bits (a bitmap of its shingles), m (distinct shingles), n (all of them), flat (none repeats), common
    (distinct shingles that another one has too) and alone (the share of the weight on those that none has)."""
    found = shingles.mapInArrow(_counted, "node long, shingle long, n long")
    once = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.first("node").alias("node"), F.sum("n").alias("n")).where("docs = 1")
    once = once.groupBy("node").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("own_n"))
    out = shingles.mapInArrow(_sized, "node long, m long, n long, bits array<long>").join(once, "node", "left").fillna(0, ["own", "own_n"])
    return out.select("node", "bits", "m", "n", (F.col("m") == F.col("n")).alias("flat"), (F.col("m") - F.col("own")).alias("common"), (F.col("own_n") / F.col("n")).alias("alone"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, n = np.unique(np.frombuffer(data, np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"node": np.full(len(found), node), "shingle": found, "n": n.astype(np.int64)})


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, n, bits = [], [], []
        for data in batch.column(1).to_pylist():
            all_of = np.frombuffer(data, np.uint64)
            set_bits = np.zeros(64 * WORDS, bool)
            set_bits[(all_of >> np.uint64(20)) % np.uint64(64 * WORDS)] = True
            m.append(len(np.unique(all_of)))
            n.append(len(all_of))
            bits.append(np.packbits(set_bits, bitorder="little").view(np.int64).tolist())
        yield pa.RecordBatch.from_pydict({"node": batch.column(0), "m": pa.array(m, pa.int64()), "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64()))})


def _open_pairs(mixed: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different components that share a bucket and may reach the threshold."""
    low = threshold - EPS
    mixed = mixed.where(F.col("alone") <= 1.0 - low)
    names = ("node", "root", "sketch", "bits", "m", "n", "flat", "common", "alone")
    minor = mixed.where("root <> main").select("band", "value", *[F.col(c).alias(f"x_{c}") for c in names])
    every = mixed.select("band", "value", "main", *[F.col(c).alias(f"y_{c}") for c in names])
    differ = [F.get("x_sketch", k).bitwiseXOR(F.get("y_sketch", k)) for k in range(4)]
    agree = BANDS * ROWS - F.bit_count(differ[0].bitwiseOR(differ[1])) - F.bit_count(differ[2].bitwiseOR(differ[3]))

    def lacking(x: str, y: str) -> Column:
        """Set bits of x's bitmap that y's lacks."""
        return sum((F.bit_count(F.get(f"{x}_bits", k).bitwiseAND(F.bitwise_not(F.get(f"{y}_bits", k)))) for k in range(WORDS)), F.lit(0))

    def size_class(m: Column) -> Column:
        return F.floor(F.log(m) * CLASSES)

    differs = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
    ends = (F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    # both without repeats: by bucket and size class
    shared = F.least("x_common", "y_common", F.col("x_m") - lacking("x", "y"), F.col("y_m") - lacking("y", "x"))
    smallest, largest = low * F.col("x_m"), F.col("x_common") * (1.0 + 1.0 / low) - F.col("x_m")
    flat = minor.where("x_flat").withColumns({"least": smallest, "most": largest}).where("most >= least")
    flat = flat.withColumn("size", F.explode(F.sequence(size_class(F.col("least") - EPS), size_class(F.col("most") + EPS))))
    plain = every.where("y_flat").withColumn("size", size_class(F.col("y_m")))
    coarse = F.least("x_common", "y_common") >= low * (F.col("x_m") + F.col("y_m") - F.least("x_common", "y_common"))
    met = flat.join(plain, ["band", "value", "size"]).where(differs & coarse & (agree >= MIN_AGREE) & (shared >= low * (F.col("x_m") + F.col("y_m") - shared))).select(*ends)
    # one with repeats: by bucket and the shares of the weight that the other lacks, each at least that of the set bits
    lone = [F.greatest(f"{x}_alone", lacking(x, y) / F.col(f"{x}_n")) for x, y in (("x", "y"), ("y", "x"))]
    few = (1.0 - lone[0]) * (1.0 - lone[1]) >= low * (1.0 - lone[0] * lone[1])
    sides = ((minor.where("NOT x_flat"), every), (minor.where("x_flat"), every.where("NOT y_flat")))
    for x, y in sides:
        met = met.unionByName(x.join(y, ["band", "value"]).where(differs & (agree >= MIN_AGREE) & few).select(*ends))
    return met.distinct()


def text_hash() -> Column:
    return F.xxhash64("text", F.length("text"))


#: Orders rows: by doc_id, null last, then by the hash of the text, which also names the row.
ROW = ("no_id", "doc_id", "hash")


def _grouped(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One row a document (doc_id, hash, copy), and one a class (copy, row, group): the class's first row by ROW
    and the group's number. Documents without words have no copy and no class."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("hash"), "text")
    signed = common.keep(rows.mapInArrow(_sign, "doc_id long, hash long, copy binary, bands array<long>, sketch array<long>"), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    classes = signed.where("copy IS NOT NULL").groupBy("copy").agg(F.min(row).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = common.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "value"))
    sizes = common.keep(entries.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    entries = common.keep(entries.join(sizes, ["band", "value"]), "entries")
    met = common.keep(entries.groupBy("node").agg(F.sum("n").alias("met")), "met")
    leaders = entries.join(met, "node").groupBy("band", "value").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("leader"))
    pairs = entries.join(common.keep(leaders, "leaders"), ["band", "value"]).where("node <> leader")
    pairs = common.keep(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")

    wanted = classes.join(met, "node", "left_semi").select(F.col("row.doc_id").alias("i"), F.col("row.hash").alias("h"), "node")
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("node", "text")
    shingles = texts.mapInArrow(_shingle_rows, "node long, shingles binary").groupBy("node").agg(F.max("shingles").alias("shingles"))
    shingles = common.keep(shingles, "shingles")
    first = common.keep(_links(pairs, shingles, threshold), "links")
    roots = common.keep(components(first), "roots")

    placed = common.keep(entries.join(roots, "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("root")), "placed")
    by_root = placed.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = by_root.groupBy("band", "value").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    mixed = common.keep(placed.join(common.keep(mains, "mains"), ["band", "value"]), "mixed")
    facts = _counts(shingles.join(mixed.select("node").distinct(), "node", "left_semi")).join(classes.select("node", "sketch"), "node")
    mixed = common.keep(mixed.join(common.keep(facts, "facts"), "node"), "mixed")
    rest = common.keep(_open_pairs(mixed, threshold).join(pairs, ["a", "b"], "left_anti"), "pairs")
    roots = merged(roots, _links(rest, shingles, threshold))
    told = classes.select("copy", "row", "node").join(roots, "node", "left").select("copy", "row", F.coalesce("root", "node").alias("group"))
    return signed.select("doc_id", "hash", "copy"), common.keep(told, "told")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and group_id of each document (doc_id, text)."""
    signed, classes = _grouped(docs, threshold)
    ids = classes.groupBy("group").agg(F.min("row.doc_id").alias("group_id"))
    known = common.keep(classes.join(ids, "group").select("copy", F.col("row.doc_id").alias("class_id"), "group_id"), "known")
    out = signed.select("doc_id", "copy").join(known, "copy", "left")
    own = F.when(F.col("copy").isNull(), F.col("doc_id"))
    return out.select("doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("group_id", own).alias("group_id"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stay: of each group the first by doc_id (null last) and text
    hash (of rows equal in both, that whose columns have the least digest), and documents without words."""
    _, classes = _grouped(docs, threshold)
    first = classes.groupBy("group").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.hash").alias("kept_hash"))
    wordless = docs.where(F.coalesce(~F.col("text").rlike(common.WORD), F.lit(True)))
    # the columns of docs lie in one struct, so that no name can clash
    rows = docs.select(common.packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    kept = rows.join(common.keep(first, "firsts"), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    # of rows equal in id and text, that whose other columns come first
    kept = kept.groupBy("kept_id", "kept_hash").agg(common.first_row("row"))
    return common.unpacked(kept, docs).unionByName(wordless)


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
