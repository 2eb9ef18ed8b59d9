import numpy as np

import barloom.llm.language_id as m
from barloom.llm.language_id import DIMENSIONS, bundles, identify, letter_vector, op4_language_id

from .common_frames import documents, empty


def test_bundle_is_the_sum_of_bound_letters():
    vectors, n = bundles(["Ab c", None, "12"])
    want = np.zeros_like(vectors[0], dtype=np.int64)
    text = [0, ord("a"), ord("b"), 0, ord("c"), 0]
    for x, y, z in zip(text, text[1:], text[2:]):
        want += np.roll(letter_vector(x), 2).astype(int) * np.roll(letter_vector(y), 1) * letter_vector(z)
    assert (vectors[0] == want).all() and n.tolist() == [4, 0, 0]


def test_slices_of_a_long_text_add_up(monkeypatch):
    text = "une maison verte et grande " * 400
    whole, n = bundles([text])
    monkeypatch.setattr(m, "SEGMENT", 27 * 10)
    parts, k = bundles([text])
    assert n == k and np.allclose(whole, parts)


def test_many_letters():
    text = "".join(chr(0x4E00 + k) for k in range(600))
    _, n = bundles([text])
    assert n[0] == 600


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def plain_vectors():
    """n-grams bundled one by one from the letters' vectors."""

    def bundle(text):
        codes = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        codes = [0, *codes, 0]
        codes = [c for k, c in enumerate(codes) if c or k == 0 or codes[k - 1]]
        out = np.zeros(DIMENSIONS)
        for x, y, z in zip(codes, codes[1:], codes[2:]):
            out += np.roll(letter_vector(x), 2) * np.roll(letter_vector(y), 1) * letter_vector(z)
        return out, max(0, len(codes) - 2)

    return bundle


def test_predictions_equal_a_plain_implementation(spark, monkeypatch):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect() if r.text][:70]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    bundle, sums = plain_vectors(), {}
    for r in rows:
        v, n = bundle(r.text)
        if n and r.lang:
            sums[r.lang] = sums.get(r.lang, 0) + v / n
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    for most in (2048, 1):  # all languages at once, and in blocks
        monkeypatch.setattr(m, "LANGUAGES", most)
        for r in identify(docs, docs, ["text"]).collect():
            v, n = bundle(r.text)
            scores = {k: float(v @ u / np.linalg.norm(v)) for k, u in unit.items()} if n else {}
            best = max(scores, key=lambda k: (scores[k], k)) if scores else "und"
            assert r.lang_pred == best or abs(scores[best] - scores[r.lang_pred]) < 1e-5
            assert abs(r.score - (max(0.0, scores[best]) if scores else 0.0)) < 1e-5


def test_letters_that_were_not_learnt(spark):
    labelled = spark.createDataFrame([("the house is green and large " * 9, "en"), ("la maison est verte et grande " * 9, "fr")], "text string, lang string")
    docs = spark.createDataFrame([("the large house",), ("дом зелёный и большой",), ("the дом",), ("...",)], "text string")
    known = {r.text: r.known for r in identify(docs, labelled, ["text"]).collect()}
    assert known == {"the large house": 1.0, "дом зелёный и большой": 0.0, "the дом": 0.5, "...": 0.0}


def test_odd_rows(spark):
    docs = documents(spark)
    out = identify(docs, docs, docs.columns)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "known"] and out.count() == docs.count()
    got = {r.text: r.lang_pred for r in identify(docs, docs, ["doc_id", "text"]).collect()}
    assert got[None] == "und" and got[""] == "und" and got["12345 !!! ###"] == "und"
    assert got["un"] in ("en", "fr", "de")
    none = identify(docs, empty(spark), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert identify(empty(spark), docs, ["doc_id"]).count() == 0
