import hashlib
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import word_runs
from barloom.llm.run_detection import find_runs, op12_periodic_runs
from barloom.llm.word_runs import SuffixOrder, periodic_runs

from .common_frames import documents, empty


def plain_runs(words, least_length=6, least_periods=4):
    """Every period by itself: stretches where words q apart are equal; the smallest period of a stretch."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least_length, least_periods * q):
                found.setdefault((start, length), q)  # a smaller period of the same stretch came before
    return sorted((s, length, q) for (s, length), q in found.items())


def listed(sequences, *least):
    owner, *rest = periodic_runs(sequences, *least)
    out = [[] for _ in sequences]
    for k, *run in zip(owner.tolist(), *(x.tolist() for x in rest)):
        out[k].append(tuple(run))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=6), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_any_sequences(sequences, least):
    arrays = [np.array(s, np.int64) for s in sequences]
    assert listed(arrays, *least) == [plain_runs(s, *least) for s in sequences]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_nested_repetitions(parts):
    s = [x for word, n in parts for x in word * n]
    assert listed([np.array(s * 2, np.int64)]) == [plain_runs(s * 2)]


def test_long_and_hard_sequences(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = [0], [0, 1]
    while len(b) < 3000:  # Fibonacci words have many runs
        a, b = b, b + a
    thue = np.array([bin(k).count("1") % 2 for k in range(3000)])
    many = [np.array(b[:3000]), thue, np.zeros(3000, np.int64), np.tile(rng.integers(0, 50, 70), 40), rng.integers(0, 2, 3000), np.empty(0, np.int64), np.concatenate([rng.integers(0, 9, 500), np.tile(np.arange(2500 // 5), 5)])]
    want = [plain_runs(s.tolist()) for s in many]
    assert listed(many) == want and sum(map(len, want)) > 20
    monkeypatch.setattr(word_runs, "TESTED_AT_ONCE", 97)
    assert listed(many) == want


def test_suffix_order_and_common_parts():
    rng = np.random.default_rng(1)
    codes = np.append(rng.integers(1, 3, 300), 0)
    s = SuffixOrder(codes)
    assert [tuple(codes[i:]) for i in s.order] == sorted(tuple(codes[i:]) for i in range(301))
    a, b = (x[:500] for x in np.array([(i, j) for i in range(300) for j in range(300) if i != j])[rng.permutation(300 * 299)].T)

    def same(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    assert s.common(a, b).tolist() == [same(codes[i:], codes[j:]) for i, j in zip(a, b)]
    assert s.common_before(a, b).tolist() == [same(codes[:i][::-1], codes[:j][::-1]) for i, j in zip(a, b)]


def test_a_million_equal_words():
    assert listed([np.zeros(1_000_000, np.int64)]) == [[(0, 1_000_000, 1)]]


def wanted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op12_periodic_runs(spark, sf).collect()))
    short = [r for r in rows if len((r.text or "").split()) < 4000]  # the plain search takes the square of the words
    told = {r[0]: r for r in got}
    assert len(got) == len(rows) and all(told[r.doc_id] == wanted(*r) for r in short)
    assert sum(r[1] > 0 for r in got) >= 10 and len(short) > 0.9 * len(rows)


def test_odd_rows(spark, tmp_path):
    more = [(40, "x " * 50_000), (41, "a b c " * 3 + "a"), (42, "a b c " * 4), (43, " é é  é é " * 7), (44, "u " * 5), (None, "r s " * 9)]
    # ids that put a repetition at the end of a short text
    more += [(k, "one two three four five six seven eight nine ten " * 2) for k in range(100, 160)]
    docs = documents(spark).where("doc_id <> 5 OR doc_id IS NULL").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r[0], r[-1]): tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id != 40]
    assert all(got[w[0], w[-1]] == w for w in (wanted(*r) for r in rows))
    assert next(r for r in got.values() if r[0] == 40)[1:6] == (1, 0, 50_000, 1, 50_000_000)
    assert find_runs(empty(spark)).count() == 0
    out = find_runs(docs.where("doc_id = 42")).select("n", "runs", F.col("collapsed")).first()
    assert out.n == 12 and tuple(out.runs[0]) == (0, 12, 3) and out.collapsed == "a b c"
