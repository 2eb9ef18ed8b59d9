"""Log-likelihood of whole documents by a gated recurrent language model (operator 3).

Words are runs of non-white-space, A-Z in lower case, and a document ends with one end token. Counts of
all training tokens are aggregated over all training documents. The HEADS most frequent tokens and, for all
other words, TAILS classes by a hash of their last two bytes are the model's vocabulary; within its tail
class a word has probability (c + 1) / (n + v + 1), with c its count and n and v the tokens and the distinct
words of the class, so that all words together, one unknown word a class included, have probability one.

Documents are encoded once, as two bytes a token, and written. The network is trained on every training
token once, by truncated backpropagation in ROUNDS rounds: segments of documents are dealt over rounds and
copies by hashes, each copy learns from about COPY_TOKENS tokens of its round, and the copies are averaged,
weighted by tokens, FAN at a time. The number of copies depends on the number of training tokens alone, not
on how the table is partitioned; the work of a copy does not grow with the table. Scoring carries the state
through a document from its first to its last token.

Counts reach the map side as a table of the most frequent tokens, TABLE at most; words that are not in
it go through a join with all counts.

Defined results: a null or empty text has the end token only; a null doc_id is not held out, so it is
training data; repeated rows are documents of their own; ties in the vocabulary go to the smaller word;
without training documents all counts are 0; an empty table gives no row; very long texts are scored whole
(and trained on in segments); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.gated_model import TAILS, GatedModel
from barloom.llm.pieces import slices

FOLDS, HELD_OUT = 7, 2
HEADS, TABLE = 1024, 400_000
#: Training: rounds, tokens a copy and round, tokens of a segment, copies averaged at a time.
ROUNDS, COPY_TOKENS, SEGMENT, FAN, RATE = 2, 1_500_000, 2048, 32, 0.2
#: Lanes and window of a copy's narrow updates and of the others. A copy starts with FIRST_TOKENS of narrow ones in
#: the first round; copies of up to SMALL_COPY tokens have narrow ones only, of fewer lanes where they are very small.
FIRST, FIRST_TOKENS, THEN, SMALL_COPY = (32, 16), 100_000, (192, 24), 400_000
#: The end token's key: no word is empty.
END = b""
#: Tokens that are scored at a time.
SCORED_AT_ONCE = 2_400_000

def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen.keys()), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words_of(text))
            seen[END] += 1
        if len(seen) > 400_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


class Vocabulary:
    """What the tasks need to know of the counts: a table of bounded size and a few totals."""

    def __init__(self, top: list[tuple[bytes, int]], n: int, v: int, tail_n: list[int], tail_v: list[int]):
        head = [w for w, _ in top[:HEADS] if w != END]
        head = [END, *head[: HEADS - 1]]
        counts = dict(top)
        counts.setdefault(END, 0)
        self.n, self.v, self.key = n, v, uuid.uuid4().hex
        self.words = [*head, *(w for w, _ in top if w not in set(head))]
        self.counts = np.array([counts[w] for w in self.words], np.int64)
        self.heads = len(head)
        tail_n, tail_v = np.array(tail_n, np.int64), np.array(tail_v, np.int64)
        for w in head:  # the totals are of all tokens so far
            if counts[w]:
                tail_n[tail_class(w)] -= counts[w]
                tail_v[tail_class(w)] -= 1
        self.tail_n, self.tail_log = tail_n, np.log10(tail_n + tail_v + 1.0)

    def model(self) -> GatedModel:
        return GatedModel(self.counts[: self.heads], self.tail_n.astype(np.float64))

    def index(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Position of each word of the table, and for the positions the model's token and log10(c + 1)."""
        tokens = [i if i < self.heads else self.heads + tail_class(w) for i, w in enumerate(self.words)]
        return {w: i for i, w in enumerate(self.words)}, np.array(tokens), np.log10(self.counts + 1.0)


def _index(vocabulary) -> tuple:
    return common.worker_state(("vocabulary", vocabulary.key), lambda: (vocabulary, *vocabulary.index()))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals of the counts (word, n), and the largest of them: all words above the count that leaves TABLE at
    most, which a histogram of counts tells."""
    tail = (F.crc32(F.expr("substring(word, -2, 2)")) % F.lit(TAILS)).cast("int")
    totals = {r.k: r for r in counts.groupBy(tail.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tail_n, tail_v = ([int(totals[k][x]) if k in totals else 0 for k in range(TAILS)] for x in ("n", "v"))
    sizes = counts.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()  # a row for a sixteenth of a doubling
    held, least = 0, 1 << 62
    for r in sizes:
        held += r.words
        if held > TABLE:
            break
        least = r.least
    top = counts.where(F.col("n") >= least).toArrow()
    pairs = sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    return Vocabulary(pairs, sum(tail_n), sum(tail_v), tail_n, tail_v)


def _encoder(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, tokens, logs = _index(shared.value)
        counted, tail_log = known.counts > 0, np.concatenate([np.zeros(known.heads), known.tail_log])
        kept_logs = np.where(tokens >= known.heads, logs, 0.0)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                flat: list[bytes] = []
                ends = []
                for t in texts[a:b]:
                    flat += words_of(t)
                    flat.append(END)
                    ends.append(len(flat))
                starts = np.array([0, *ends[:-1]])
                found = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
                doc = tokens[found].astype(np.uint16)
                lost = np.flatnonzero(found < 0)
                doc[lost] = [known.heads + tail_class(flat[i]) for i in lost]
                there = found >= 0
                words: list[list[bytes]] = [[] for _ in ends]
                times: list[list[int]] = [[] for _ in ends]
                owner = np.searchsorted(ends, lost, "right")
                cuts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(lost) else np.empty(0, np.int64)
                for x, y in zip(cuts, np.append(cuts[1:], len(lost))):
                    missed = Counter(flat[i] for i in lost[x:y])
                    words[owner[x]], times[owner[x]] = list(missed.keys()), list(missed.values())
                # of tail words: the part of the table's counts, less the totals of the classes
                told = {
                    "n_tokens": np.diff(starts, append=len(flat)),
                    "n_table": np.add.reduceat((counted[found] & there).astype(np.int64), starts),
                    "log_table": np.add.reduceat(np.where(there, logs[found], 0.0), starts),
                    "log_tail": np.add.reduceat(np.where(there, kept_logs[found], 0.0) - tail_log[doc], starts),
                    "tokens": pa.array([doc[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary()),
                    "words": pa.array(words, pa.list_(pa.binary())),
                    "times": pa.array(times, pa.list_(pa.int64())),
                }
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "doc_id": part.column(1), "held_out": part.column(2), **told})

    return encode


ENCODED = "key long, doc_id long, held_out boolean, n_tokens long, n_table long, log_table double, log_tail double, tokens binary, words array<binary>, times array<long>"
COPY = "copy long, n long, p binary"


def _average(table: pa.Table) -> pa.Table:
    rows = table.sort_by("copy")
    n = rows.column("n").to_numpy()
    total = np.zeros(len(rows.column("p")[0].as_py()) // 4)
    for k, p in zip(n, rows.column("p")):
        total += k * np.frombuffer(p.as_py(), np.float32)
    return pa.table({"copy": pa.array([rows.column("copy")[0].as_py() // FAN], pa.int64()), "n": [int(n.sum())], "p": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def train(encoded: DataFrame, shared, vocabulary: Vocabulary, copy_tokens: int = COPY_TOKENS) -> np.ndarray:
    """Parameters after ROUNDS rounds over training documents (doc_id, tokens of two bytes). A copy goes on with the
    parameters and with Adagrad's sums that the round before left, both averaged."""
    spark, model = encoded.sparkSession, vocabulary.model()
    n = len(model.flat())
    flat = np.concatenate([model.flat(), *(x.ravel() for x in model.fresh_memory().values())])
    width = 2 * SEGMENT
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("tokens") - 1) / width).cast("int"))).alias("at")
    rows = encoded.where(F.length("tokens") > 0).select("doc_id", "key", "tokens", at)
    rows = rows.select("doc_id", "key", "at", F.substring("tokens", F.col("at") * width + 1, F.lit(width)).alias("tokens"))
    # the key tells documents without an id apart; it is not used where there is one, as it depends on the layout
    name = F.xxhash64(F.coalesce(F.col("doc_id"), F.col("key")), "at", "tokens")
    copies = max(1, round(vocabulary.n / ROUNDS / copy_tokens))
    rows = rows.select(name.alias("name"), F.pmod(F.xxhash64(name, F.lit("round")), F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64(name, F.lit("copy")), F.lit(copies)).alias("copy"), "tokens")
    for k in range(ROUNDS):
        start, again = spark.sparkContext.broadcast(flat), k > 0

        def learn(table: pa.Table) -> pa.Table:
            model = _index(shared.value)[0].model()
            memory = model.parts(start.value[n:].copy())
            model.load(start.value[:n].copy())
            table = table.sort_by([("name", "ascending"), ("tokens", "ascending")])
            docs = [np.frombuffer(t.as_py(), np.uint16) for t in table.column("tokens")]
            sizes = np.cumsum([len(d) for d in docs])
            total = int(sizes[-1])
            narrow = total if total <= SMALL_COPY else 0 if again else FIRST_TOKENS
            first = int(np.searchsorted(sizes, narrow, "right"))
            lanes = max(4, min(FIRST[0], total // 1024))
            for part, (width, window) in ((docs[:first], (lanes, FIRST[1])), (docs[first:], THEN)):
                if part:
                    memory = model.train(part, RATE, width, window, memory)
            out = np.concatenate([model.flat(), *(x.ravel() for x in memory.values())])
            return pa.table({"copy": pa.array([table.column("copy")[0].as_py()], pa.int64()), "n": [total], "p": pa.array([out.tobytes()], pa.binary())})

        mine = rows.where(F.col("round") == k).select("name", "copy", "tokens")
        # a task a copy: these few bytes are much work, so Spark must not merge partitions by size
        merged = mine.repartition(min(copies, 10_000), "copy").groupBy("copy").applyInArrow(learn, COPY)
        left = copies
        while True:
            merged = common.keep(merged, "copies")
            if left <= FAN:
                break
            merged = merged.groupBy(F.floor(F.col("copy") / FAN)).applyInArrow(_average, COPY)
            left = -(-left // FAN)
        trained = merged.orderBy("copy").collect()  # FAN at most
        if trained:
            flat = (sum(c.n * np.frombuffer(c.p, np.float32).astype(np.float64) for c in trained) / sum(c.n for c in trained)).astype(np.float32)
    return flat[:n]


def _scorer(shared, parameters):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _index(shared.value)[0].model().load(parameters.value)
        held: list[pa.RecordBatch] = []
        docs: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            scores, at = model.score(docs) / math.log(10), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores[at : at + b.num_rows])], names=[*b.schema.names[:-1], "model"])
                at += b.num_rows

        for batch in batches:
            held.append(batch)
            for t in batch.column(batch.num_columns - 1):
                docs.append(np.frombuffer(t.as_py(), np.uint16))
                n += len(docs[-1])
            if n >= SCORED_AT_ONCE:
                yield from out()
                held, docs, n = [], [], 0
        if held:
            yield from out()

    return score


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_table long, log_table double, log_tail double, model double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document (doc_id, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(common.crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    counts = common.keep(docs.where(~held_out).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    vocabulary = learn_vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", held_out.alias("held_out"), "text")
    encoded = common.keep(keyed.mapInArrow(_encoder(shared), ENCODED), "encoded")
    parameters = spark.sparkContext.broadcast(train(encoded.where("NOT held_out"), shared, vocabulary))

    names = [x.split()[0] for x in SCORED.split(", ")][:-1]
    scored = encoded.select(*names, "tokens").mapInArrow(_scorer(shared, parameters), SCORED)
    missed = encoded.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = missed.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("log_rare"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare"))
    rows = scored.join(rare, "key", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    total = math.log10(vocabulary.n + vocabulary.v + 1)
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_table") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("log_table") + log_rare - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model") + F.col("log_tail") + log_rare).alias("score"),
    )


def op3_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
