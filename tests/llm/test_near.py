import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.near_dedup import _counts, _open_pairs, _shingles, near_duplicates, without_near_duplicates
from barloom.llm.probminhash import signatures, similarity

from .common_frames import documents, empty


def jaccard(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def as_array(c):
    return np.array([e for e, n in c.items() for _ in range(n)], np.uint64)


def test_exact_similarity():
    r = random.Random(3)
    for _ in range(100):
        x, y = (Counter(r.randint(1, 20) for _ in range(r.randint(1, 40))) for _ in range(2))
        assert abs(similarity(as_array(x), as_array(y)) - jaccard(x, y)) < 1e-9


def test_registers_agree_at_the_similarity():
    r = random.Random(4)
    for _ in range(3):
        x = Counter({r.getrandbits(60): r.randint(1, 5) for _ in range(80)})
        y = Counter({e: r.randint(1, 5) for e in list(x)[:60]}) + Counter({r.getrandbits(60): 2 for _ in range(15)})
        owner = np.array([0] * len(x) + [1] * len(y))
        kept = signatures(2, owner, np.array([*x, *y], np.uint64), np.array([*x.values(), *y.values()]), 6000)
        assert abs((kept[0] == kept[1]).mean() - jaccard(x, y)) < 0.03


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (90, 95, 100)} == {90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts):
    words = {i: t.lower().encode().split() for i, t in texts.items() if t}
    shingles = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(words)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if words[a] and (words[a] == words[b] or (shingles[a] and shingles[b] and jaccard(shingles[a], shingles[b]) >= 0.8)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_groups_equal_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts, k = {}, 0
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(30, 120))
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts[k] = " ".join(copy)
            k += 1
    hot = r.choices(vocabulary, k=150)  # one large group of near copies, more and less like one another
    for _ in range(90):
        copy = list(hot)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts[k] = " ".join(copy)
        k += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.group_id for x in near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_open_pairs_of_texts_that_repeat_themselves(spark):
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = r.choices(vocabulary, k=110)
    texts = []
    for k in range(80):  # as one bucket of a large group, each a component of its own
        copy = list(base)
        for _ in range(r.choice([0, 1, 3, 5, 6, 7])):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts.append(" ".join(copy + copy[:8] * (k % 3)))
    _, found = _shingles(texts)
    counts = _counts(spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(found)], "node long, shingles binary"))
    mixed = counts.select(F.lit(0).alias("band"), F.lit(0).alias("value"), "*", F.col("node").alias("root"), F.lit(0).alias("main"), F.array(*[F.lit(0).cast("long")] * 4).alias("sketch"))
    got = {(x.a, x.b) for x in _open_pairs(mixed, 0.8).collect()}
    near = {(a, b) for b in range(80) for a in range(b) if similarity(found[a], found[b]) >= 0.8}
    assert near <= got and near and len(got) < 1.5 * len(near) < 0.5 * 80 * 79 / 2


def test_odd_rows(spark):
    docs = documents(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: (r.class_id, r.group_id) for r in rows}
    assert got[6] == got[7] == (6, 6) and got[2] == (2, 2) and got[3] == (3, 3) and got[4] == (4, 4) and got[9] == (9, 9)
    assert near_duplicates(empty(spark)).count() == 0


CLASHES = ("__id", "__hash", "__k", "__doc", "__i", "__h", "id", "hash", "row", "kept_id", "group", "node", "copy", "a.b")


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "quite another text of some more words"), (4, None), (3, "quite another text of some more words")], "doc_id long, text string")
    docs = docs.select("doc_id", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHES], "text").coalesce(1)
    out = without_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = sorted(map(tuple, out.collect()))
    assert [r[0] for r in rows] == [1, 3, 4] and all(r[1:-1] == tuple(f"{c} {r[0]}" for c in CLASHES) for r in rows)


def test_of_equal_rows_always_the_same_stays(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text, f"source {k}") for k in range(20)], "doc_id long, text string, source string")
    got = {without_near_duplicates(docs.repartition(n)).first().source for n in (1, 3, 7)}
    assert len(got) == 1
