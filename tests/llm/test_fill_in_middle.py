import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import fill_in_middle as fim
from barloom.llm.fill_in_middle import Chunks, chunk_ends, fill_in_middle, op11_fill_in_middle, restore

from .common_frames import documents, empty


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(pairs, rate=100, chunks=None):
    ids, texts = [p[0] for p in pairs], [(p[1] or "").encode() for p in pairs]
    return [tuple(r.values()) for r in fim._forms(chunks or Chunks(), 7, rate, 50, ids, texts)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.text("ab\n<P>SMé世\r", max_size=60)), max_size=8))
def test_any_text(pairs):
    assert rows_of(pairs) == [plain(*p) for p in pairs]


def test_any_chunking(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(fim, "CHUNK_WINDOW", 2)
    for bits in (1, 2, 5):  # down to chunks of one character: markers and lines run across their borders
        monkeypatch.setattr(fim, "CHUNK_BITS", bits)
        pairs = [(k, "".join(rng.choice(["<", "P", "S", ">", "M", "\n", "é", "世", "x", "y z"]) for _ in range(rng.randint(0, 90)))) for k in range(400)]
        assert rows_of(pairs) == [plain(*p) for p in pairs]
        assert rows_of(pairs, 30) == [plain(*p, 30) for p in pairs]


def test_shared_passages_fall_into_the_same_chunks():
    rng = random.Random(5)
    shared = "\n".join(f"line {rng.random()} of é passage" for _ in range(800))
    chunks = Chunks()
    rows_of([(1, shared)], chunks=chunks)
    before = len(chunks.known)
    pairs = [(k, f"{'x' * k} another beginning {k}\n{shared}\nend {k}") for k in range(2, 30)]
    assert rows_of(pairs, chunks=chunks) == [plain(*p) for p in pairs]
    assert before > 10 and chunks.met >= 28 * (before - 3)
    chunks = Chunks(most=5_000)  # forgets
    assert rows_of(pairs, chunks=chunks) == [plain(*p) for p in pairs] and chunks.size < 5_000 + fim.LONGEST_REMEMBERED


def test_chunks_end_between_characters_and_with_texts():
    texts = ["世界" * 5000, "ab" * 4000, "x"]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    ends = chunk_ends(np.frombuffer(b"".join(data), np.uint8), starts[:-1])
    assert set(starts[1:]) <= set(ends.tolist())
    joined = b"".join(data)
    for a, b in zip([0, *ends], ends):
        joined[a:b].decode()


def digests(row):
    *head, out = plain(*row)
    return (*head, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest())


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op11_fill_in_middle(spark, sf).collect()))
    assert got == sorted(digests(tuple(r)) for r in rows)
    assert {r[2] for r in got} >= {"psm", "spm"}


def test_odd_rows(spark):
    more = [(30, "a<P>b\nc"), (31, "\n\n\n"), (32, "<\nP>\n<"), (33, "<" * 50 + "\n" + "<P" * 9), (34, "x" * 200_000), (35, "long\n" * 60_000)]
    docs = documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    for rate, spm in ((100, 50), (40, 0), (0, 50)):
        out = fill_in_middle(docs, rate=rate, spm_rate=spm).withColumn("text", restore(F.col("output"), F.col("form")))
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert got == sorted(((*plain(r.doc_id, r.text, rate, spm), r.text or "") for r in docs.collect()), key=str)
    assert fill_in_middle(empty(spark)).count() == 0
