"""Language identification by hyperdimensional profiles (operator 4).

Every letter has a fixed random vector of +1 and -1. An n-gram of three letters binds them: the
product of the first letter's vector rotated twice, the second's rotated once and the third's. A
document bundles (adds) its n-grams, a language the n-grams of its documents, each document with
weight one. A document's language is the prototype of largest cosine.

Prototypes are learnt from all labelled training rows: partitions hand in one vector a language and Spark
adds them up. LANGUAGES prototypes are broadcast at a time; where there are more, documents pass once more
for each further block. Letters that make up at least RARE of some language's letters are its alphabet, and
`known` is the share of a text's letters that are in one.

Defined results: `und` with score 0 for a null text, a text without letters, or where nothing was
learnt; ties go to the smaller language; negative cosines count as 0; very long texts are bundled
whole, in slices; repeated rows each get their row; an empty table gives no row; other columns are kept
where they are asked for, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import common
from barloom.llm.pieces import slices

DIMENSIONS, SEED, FOLDS, LANGUAGES, RARE = 1024, 20_011, 5, 2048, 1e-5
#: Symbols that are bundled at a time.
SEGMENT = 1_000_000

_letters: dict[int, np.ndarray] = {}
_is_letter: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter; of the gap between words for code 0."""
    if code not in _letters:
        _letters[code] = np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)
    return _letters[code]


def symbols(text: str) -> np.ndarray:
    """Code points of lower-cased letters, with one 0 for each run of anything else and at both ends."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0], np.where(_is_letter[0][codes], codes, 0), [0]]).astype(np.int64)
    return codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]


def bundles(texts: list[str | None], see: Callable[[int, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and its number of n-grams (0 without letters); see is told each
    text's symbols."""
    vectors, grams = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), np.int64)
    for a, b in slices([t or "" for t in texts], SEGMENT):
        owner, codes = [], []
        for i, t in enumerate(texts[a:b], a):
            c = symbols(t) if t else ()
            if see and len(c):
                see(i, c)
            for k in range(0, len(c) - 2, SEGMENT):
                owner.append(i)
                codes.append(c[k : k + SEGMENT + 2])
        _add(vectors, grams, np.array(owner), codes)
    return vectors, grams


def _add(vectors: np.ndarray, grams: np.ndarray, owners: np.ndarray, pieces: list[np.ndarray]) -> None:
    """Add the n-grams of pieces to their owners, about SEGMENT symbols at a time."""
    for a, b in slices(pieces, SEGMENT):
        owner, codes = owners[a:b], pieces[a:b]
        present, index = np.unique(np.concatenate(codes), return_inverse=True)
        n, size = np.array([len(c) for c in codes]), len(present)
        keys = (index[:-2] * size + index[1:-1]) * size + index[2:]
        keep = np.ones(len(index), bool)
        keep[np.cumsum(n) - 1] = keep[np.cumsum(n) - 2] = False  # n-grams across two texts
        keys, rows = keys[keep[:-2]], np.repeat(np.arange(len(n)), n - 2)
        if size**3 <= 8_000_000:
            there = np.bincount(keys, minlength=size**3) > 0
            grams_here, place = np.flatnonzero(there), np.cumsum(there) - 1
            column = place[keys]
        else:
            grams_here, column = np.unique(keys, return_inverse=True)
        letters = np.stack([letter_vector(int(c)) for c in present])
        one, two = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        for c in range(0, len(grams_here), 4096):  # bounds the counts and the n-gram vectors held
            g = grams_here[c : c + 4096]
            bound = (one[g // (size * size)] * two[g // size % size] * letters[g % size]).astype(np.float32)
            mine = (column >= c) & (column < c + len(g)) if len(grams_here) > 4096 else slice(None)
            counts = np.bincount(rows[mine] * len(g) + column[mine] - c, minlength=len(n) * len(g)).reshape(len(n), len(g)).astype(np.float32)
            np.add.at(vectors, owner, counts @ bound)
        np.add.at(grams, owner, n - 2)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.worker_state("letters", dict)  # lets go of another operator's caches
    sums: dict[str, np.ndarray] = {}
    letters: dict[str, Counter[int]] = {}

    def out() -> pa.RecordBatch:
        found = [letters[x] for x in sums]
        columns = {"codes": pa.array([list(c.keys()) for c in found], pa.list_(pa.int32())), "n": pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())), **columns})

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices([t or "" for t in texts]):
            codes: dict[str, list[np.ndarray]] = {}
            vectors, n = bundles(texts[a:b], lambda i, c, a=a, codes=codes: codes.setdefault(langs[a + i], []).append(c))
            for lang in sorted(set(langs[a:b])):
                rows = [i for i, x in enumerate(langs[a:b]) if x == lang and n[i]]
                if rows:
                    sums[lang] = sums.get(lang, 0.0) + (vectors[rows] / n[rows, None]).sum(axis=0, dtype=np.float64)
                    counts = np.bincount(np.concatenate(codes[lang]))
                    there = np.flatnonzero(counts)
                    letters.setdefault(lang, Counter()).update(dict(zip(there.tolist(), counts[there].tolist())))
        if len(sums) > LANGUAGES:
            yield out()
            sums.clear()
            letters.clear()
    if sums:
        yield out()


def learn_prototypes(labelled: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Prototypes (lang, v: pos and x in order) and the code points of all alphabets, from all rows (text, lang)."""
    common.ship(labelled.sparkSession)
    parts = labelled.where("lang IS NOT NULL").select("text", "lang").mapInArrow(_learn, "lang string, vector array<double>, codes array<int>, n array<long>")
    parts = common.keep(parts, "language-sums")
    summed = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    letters = parts.select("lang", F.explode(F.arrays_zip("codes", "n")).alias("e")).where("e.codes <> 0").groupBy("lang", F.col("e.codes").alias("code")).agg(F.sum("e.n").alias("n"))
    total = letters.groupBy("lang").agg(F.sum("n").alias("total"))
    used = letters.join(total, "lang").where(F.col("n") >= RARE * F.col("total")).select("code").distinct()  # code points: bounded
    return common.keep(rows, "prototypes"), np.array([r.code for r in used.collect()], np.int64)


def identify(docs: DataFrame, labelled: DataFrame, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """The columns `keep` of docs (text, ...) but those called like a result, and, under `names`, the language, its cosine and the share of the
    text's letters that are known; learns from `labelled` (text, lang)."""
    spark = docs.sparkSession
    common.ship(spark)
    keep = [c for c in keep if c not in names]
    prototypes, codes = learn_prototypes(labelled)
    n = prototypes.count()
    blocks = max(1, -(-n // LANGUAGES))
    alphabet = spark.sparkContext.broadcast(codes)
    # by position within the tasks, as names may hold dots
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))
    kinds = rows.schema.fields[:-1]
    told = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())]
    for k in range(blocks):
        part = prototypes.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).orderBy("lang").collect()
        vectors = np.array([[e.x for e in r.v] for r in part]).reshape(len(part), DIMENSIONS)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
        model = spark.sparkContext.broadcast(([r.lang for r in part], vectors.astype(np.float32)))
        last = k + 1 == blocks
        schema = T.StructType([*kinds, *told, *([] if last else [T.StructField("__text", T.StringType())])])
        rows = rows.mapInArrow(_predict(model, alphabet, len(kinds), k > 0, last, schema.names), schema)
    return rows.toDF(*keep, *names)


def _predict(model, alphabet, width: int, again: bool, last: bool, out: list[str]):
    """The first `width` columns, the prediction and, unless last, the text, which is the last column that comes
    in. Where languages come in blocks, later passes find the prediction so far before the text."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> np.ndarray:
            there = np.zeros(0x110000, bool)
            there[alphabet.value] = True
            return there

        common.worker_state("letters", dict)
        names, wanted = model.value
        learnt = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                known = np.zeros(b - a)

                def see(i: int, c: np.ndarray, known=known) -> None:
                    letters = int(np.count_nonzero(c))
                    known[i] = learnt[c].sum() / letters if letters else 0.0

                vectors, n = bundles(texts[a:b], see)
                part = batch.slice(a, b - a)
                if again:
                    pred, score = np.array(part.column(width).to_pylist(), object), part.column(width + 1).to_numpy(zero_copy_only=False).copy()
                else:
                    pred, score = np.full(b - a, "und", object), np.zeros(b - a)
                if names:
                    cos = vectors @ wanted.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
                    best = cos.argmax(axis=1)
                    found, cosine = np.array(names, object)[best], np.clip(cos[np.arange(b - a), best], 0, 1).astype(np.float64)
                    better = (n > 0) & ((pred == "und") | (cosine > score) | ((cosine == score) & (found < pred)))
                    pred[better], score[better] = found[better], cosine[better]
                columns = [*part.columns[:width], pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns if last else [*columns, part.column(part.num_columns - 1)], names=out)

    return predict


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(common.crc_bucket(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return identify(docs, docs.where(~F.col("held_out")), ["doc_id", "held_out"])
