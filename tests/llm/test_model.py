import math
import zlib
from collections import Counter

import numpy as np

from barloom.llm import common
from barloom.llm.gated_model import HIDDEN, SIZE, TAILS, GatedModel
from barloom.llm.language_model import ENCODED, _count, _encoder, learn_vocabulary, op3_gated_lm, score_documents, tail_class, train, words_of

from .common_frames import documents, empty


def small_model():
    rng = np.random.default_rng(0)
    m = GatedModel(np.arange(100, 0, -1), np.ones(TAILS) * 50)
    m.p = {k: (v + rng.standard_normal(v.shape) * 0.1 * (v > -1e8)).astype(np.float64) for k, v in m.p.items()}
    return m, rng


def test_gradients_by_differences():
    m, rng = small_model()
    ids, valid, keep, h = rng.integers(0, 116, (7, 5)), rng.random((7, 5)) < 0.9, (rng.random((7, 5)) > 0.2).astype(float), rng.standard_normal((5, HIDDEN)) * 0.3
    grads, _, _ = m.gradients(ids, valid, keep, h)

    def loss():
        states, _ = m.forward(ids, keep, h)
        return -m.log_probs(states[valid], ids[valid])[0].sum()

    for k, v in m.p.items():
        g = grads[k]
        if k == "E":
            g = np.zeros_like(v)
            g[grads[k][0]] = grads[k][1]
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in v.shape)
            if v[at] < -1e8:
                continue
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_probabilities_sum_to_one_and_state_is_carried():
    m, rng = small_model()
    h = np.repeat(rng.standard_normal((1, HIDDEN)), 116, axis=0)
    logp, _ = m.log_probs(h, np.arange(116))
    assert abs(np.exp(logp).sum() - 1) < 1e-5
    docs = [rng.integers(0, 116, n) for n in (1, 5, 40, 333, 2, 90)]
    want = []
    for d in docs:  # one document alone, in one window
        states, _ = m.forward(d[:, None], np.array([[0.0]] + [[1.0]] * (len(d) - 1)), np.ones((1, HIDDEN)))
        want.append(m.log_probs(states[:, 0], d)[0].sum())
    assert np.allclose(m.score(docs, lanes=2), want, atol=1e-3) and np.allclose(m.score(docs, lanes=256), want, atol=1e-3)


def test_training_learns():
    rng = np.random.default_rng(1)
    docs = [np.tile(rng.permutation(20), 8) for _ in range(60)]  # what follows depends on what was seen
    m = GatedModel(np.full(100, 5), np.ones(TAILS))
    before = m.score(docs).sum()
    for _ in range(3):
        m.train(docs, 0.1)
    assert m.score(docs).sum() > 0.75 * before


def reference(rows):
    words = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for ws, o in zip(words, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, o, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws, o in zip(rows, words, out)]


def same(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] or -1, *r[1:4], round(r[5], 3))) for x in (got, want))
    return len(got) == len(want) and all(g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want))


def encoded(spark, docs):
    """Tokens of all rows, and what they are encoded with."""
    common.ship(spark)
    vocabulary = learn_vocabulary(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").sum("n").toDF("word", "n"))
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.selectExpr("monotonically_increasing_id() AS key", "doc_id", "false AS held_out", "text")
    return rows.mapInArrow(_encoder(shared), ENCODED), shared, vocabulary


def plain_score(model, tokens):
    """Token by token, in double precision."""
    p, out, h = {k: v.astype(np.float64) for k, v in model.p.items()}, 0.0, np.zeros(HIDDEN)
    for t in tokens:
        cls = t // SIZE if t < model.heads else t - model.heads + model.head_classes
        logit = h @ p["W"] + p["b"]
        out += logit[cls] - math.log(np.exp(logit).sum())
        if t < model.heads:
            inner = p["V"][cls] @ h + p["c"][cls]
            out += inner[t % SIZE] - math.log(np.exp(inner).sum())
        x, hu = p["E"][t], h @ p["U"]
        z, r = (np.clip(0.5 + (x[k : k + HIDDEN] + hu[k : k + HIDDEN]) / 4, 0, 1) for k in (0, HIDDEN))
        h = z * h + (1 - z) * np.tanh(x[2 * HIDDEN :] + r * hu[2 * HIDDEN :])
    return out


def test_base_scores_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = op3_gated_lm(spark, sf).collect()
    assert same([tuple(r)[:6] for r in out], reference([tuple(r) for r in docs]))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def test_scores_equal_a_plain_loop_whatever_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    by_layout = [{r.doc_id: r.score for r in score_documents(docs.repartition(n)).collect()} for n in (1, 9)]
    assert by_layout[0].keys() == by_layout[1].keys() and all(abs(x - by_layout[1][k]) < 1e-3 * max(1, abs(x)) for k, x in by_layout[0].items())
    held_out = [k for k in by_layout[0] if zlib.crc32(str(k).encode()) % 7 == 2]
    rows, shared, vocabulary = encoded(spark, docs.where(~docs.doc_id.isin(held_out)))
    model = vocabulary.model().load(train(rows, shared, vocabulary))
    place, tokens, _ = vocabulary.index()
    counts = Counter(w for r in docs.collect() if r.doc_id not in held_out for w in words_of(r.text) + [b""])
    for r in docs.collect()[:12]:
        words = words_of(r.text) + [b""]
        ids = [int(tokens[place[w]]) if w in place else vocabulary.heads + tail_class(w) for w in words]
        tail = sum(math.log10(counts[w] + 1) - vocabulary.tail_log[t - vocabulary.heads] for w, t in zip(words, ids) if t >= vocabulary.heads)
        want = plain_score(model, ids) / math.log(10) + tail
        assert abs(by_layout[0][r.doc_id] - want) < 1e-3 * max(1, abs(want))


def test_copies_are_averaged(spark):
    docs = spark.createDataFrame([(k, f"some words of document {k % 7} follow one another here") for k in range(300)], "doc_id long, text string")
    rows, shared, vocabulary = encoded(spark, docs)
    one, many = (train(rows, shared, vocabulary, n) for n in (10**9, 20))  # the second: some 70 copies, in two levels
    tokens = [np.frombuffer(bytes(r.tokens), np.uint16) for r in rows.select("tokens").collect()]
    before, *after = (vocabulary.model().load(p).score(tokens).sum() for p in (vocabulary.model().flat(), one, many))
    assert all(np.isfinite(x) and x > before for x in after)


def test_odd_rows(spark):
    docs = documents(spark)
    out = score_documents(docs).collect()
    assert same([tuple(r)[:6] for r in out], reference([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert score_documents(empty(spark)).count() == 0


def test_every_training_document_reaches_the_network(spark):
    rows = [(k, f"these words of document {k} follow one another") for k in range(6)]
    tokens, shared, vocabulary = encoded(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    tokens = tokens.toPandas()
    start = vocabulary.model().flat()
    for k in range(6):  # each alone must change the parameters
        alone = spark.createDataFrame(tokens[k : k + 1], ENCODED)
        assert not np.array_equal(train(alone, shared, vocabulary), start), k
