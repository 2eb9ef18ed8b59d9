import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import sentence_spans
from barloom.llm.sentence_spans import LONGEST, OP5_SQL, op5_sentence_spans, pieces_of, remove_repeated_spans, run_hashes, runs_of

from .common_frames import documents, empty

SF = "/root/testdata/sf0.001"


def cleaned(spark, rows):
    return {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = c.sql(OP5_SQL)
    want = sorted(tuple(x) for x in r.fetchall())
    assert sorted(tuple(x[k] for k in r.columns) for x in op5_sentence_spans(spark, SF).collect()) == want and want


def test_query_returns_every_document(spark, tmp_path):
    docs = documents(spark, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op5_sentence_spans(spark, str(tmp_path)).collect()
    assert len(out) == docs.count() and {r.doc_id for r in out if r.n_removed} < {r.doc_id for r in out}
    told = {r.doc_id: r for r in out}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(told[k].text == kept[k] and told[k].removed == "" for k in told if not told[k].n_removed)
    assert told[2].n_sentences == 0 and told[6].n_sentences == 3 and told[5].n_sentences == len(pieces_of(kept[5]))


def test_long_sentences_are_cut_behind_one_word_in_four():
    words = [f"word{k}" for k in range(4000)]
    assert 850 < len(pieces_of(" ".join(words))) < 1150


def test_runs_known_within_a_task():
    r = np.random.default_rng(3)
    doc, spot, h1, h2 = (r.integers(0, n, 5000) for n in (40, 25, 300, 3))
    want = [(d, s) == min((doc[k], spot[k]) for k in np.flatnonzero((h1 == a) & (h2 == b))) for d, s, a, b in zip(doc, spot, h1, h2)]
    assert sentence_spans._first_ones(doc, spot, h1, h2).tolist() == want and 300 < sum(want) < 2000
    # a run that all documents share comes to one row to rank, however many documents a task has
    texts = pa.array(["Here is a line that everyone has. And one more that all have."] * 500)
    rows = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([1] * 500, pa.int32()), texts], names=["doc", "tie", "text"])
    out = [x for b in sentence_spans._hashed(2, 10)(iter([rows])) for x in b.to_pylist()]
    assert sum(x["h2"] is not None for x in out) == 1 and len(out) == 1000 and len({x["h1"] for x in out}) > 900


def test_first_occurrence_stays_and_odd_rows(spark):
    docs = documents(spark)
    out = {}
    for r in remove_repeated_spans(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[6][0].n_removed == 0
    assert [r.n_removed for r in out[7]] == [3, 3] and out[7][0].text == ""
    assert out[10][0].text == "Other words come first here."
    assert out[1][0].removed == [1, 2]  # one sentence three times: the second and third run repeats the first
    assert out[2][0].text is None and out[3][0].text == "" and out[2][0].n_sentences == 0
    assert sum(map(len, out.values())) == docs.count()
    assert remove_repeated_spans(docs).columns[:2] == ["doc_id", "text"]
    assert remove_repeated_spans(empty(spark)).count() == 0


def test_passage_that_starts_within_a_sentence(spark):
    p = "the end of a sentence. Here is one whole sentence of the passage that counts. And here is the second whole sentence of it. The third begins"
    out = cleaned(spark, [(1, "Some words " + p + " here."), (2, "Quite other text before it and " + p + " there again.")])
    assert out[1].n_removed == 0 and out[2].removed == [1, 2]


def test_one_long_sentence(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    long = " ".join(r.sample(words, 80))
    out = cleaned(spark, [(k, f"Document {k} starts so and {r.choice(words)}. {long}. It ends with {k} {r.choice(words)}.") for k in (1, 2, 3)])
    assert out[1].n_removed == 0
    for k in (2, 3):  # as a sentence, the passage goes as a whole
        assert out[k].text.startswith(f"Document {k} starts so") and "It ends with" in out[k].text and len(out[k].text.split()) == 11
    # within sentences of their own, all but the pieces at its borders
    out = cleaned(spark, [(k, " ".join(r.sample(words, 30)) + f" {long} " + " ".join(r.sample(words, 30))) for k in (1, 2, 3)])
    assert out[1].n_removed == 0
    for k in (2, 3):
        left = out[k].text.split()
        assert len(left) < 140 - 55 and sum(w in long.split() for w in left) < 30


def test_many_short_lines(spark):
    lines = "\n".join(f"item {k}" for k in range(40))
    same = "\n".join(["- yes"] * 40)
    out = cleaned(spark, [(1, "First one\n" + lines), (2, "Second one\n" + lines + "\nits end"), (3, same), (4, "Another\n" + same)])
    assert out[1].n_removed == 0 and out[2].text == "Second one its end"
    assert out[4].text == "Another" and out[3].n_removed == 39 and out[3].text == "- yes"


def test_short_texts_and_clean_documents(spark):
    rows = [(1, "One begins in this way today. Good bye. Yours, me."), (2, "Two begins in that way today. Good bye. Yours, me."), (3, "One begins in this way today. But goes on in another.")]
    out = cleaned(spark, [*rows, (4, "Good bye. Yours, me."), (5, "Good bye. Yours, me."), (6, "Good bye."), (7, "Good bye.")])
    assert [out[k].n_removed for k in range(1, 8)] == [0, 0, 0, 0, 2, 0, 0]


def test_every_run_against_plain_search(spark):
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(12)]

    def sentence():
        return " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 9, 30, 70]))) + r.choice([".", "!", "\n"])

    stock = [sentence() for _ in range(25)]
    texts = {k: " ".join(r.choice(stock) if r.random() < 0.7 else sentence() for _ in range(r.randint(1, 12))) for k in range(60)}
    seen, gone = {}, {k: set() for k in texts}
    for k, t in texts.items():
        pieces = pieces_of(t, plain=True)
        for at, end in zip(*(x.tolist() for x in runs_of(np.array([p.count(b" ") + 1 for p in pieces])))):
            assert end - at >= 2
            if seen.setdefault(tuple(pieces[at:end]), (k, at)) != (k, at):
                gone[k] |= set(range(at, end))
    out = cleaned(spark, list(texts.items()))
    assert all(out[k].removed == sorted(gone[k]) for k in texts) and sum(map(len, gone.values())) > 50


def test_pieces():
    def told(text):
        return [p.decode() for p in pieces_of(text)]

    assert told(None) == told(" \n\t") == []
    assert told(" One.  Two!\nThree? four") == ["One.", "Two!", "Three?", "four"]
    words = [f"Word{k}" for k in range(LONGEST + 1)]
    assert len(told(" ".join(words))) > 1 and " ".join(told("  ".join(words))) == " ".join(words)
    assert told("  ".join(words[1:])) == ["  ".join(words[1:])]
    assert pieces_of("İx  É. A", plain=True) == ["i̇x é.".encode(), b"a"] and told("İx  É. A") == ["İx  É.", "A"]


def test_runs_against_plain_search():
    def plain(sizes, run=2, least=10):
        n = len(sizes)
        if sum(sizes) < least:
            return [(0, n)] if n >= run else []
        ok = [(a, b) for a in range(n) for b in range(a + run, n + 1) if sum(sizes[a:b]) >= least]
        return sorted({min((x for x in ok if x[0] == a), key=lambda x: x[1]) for a, _ in ok} | {max((x for x in ok if x[1] == b), key=lambda x: x[0]) for _, b in ok})

    r = random.Random(2)
    for _ in range(500):
        sizes = [r.choice([1, 2, 3, 8, 24]) for _ in range(r.randint(0, 14))]
        assert list(zip(*(x.tolist() for x in runs_of(np.array(sizes, np.int64))))) == plain(sizes), sizes


def test_hashes_tell_runs_apart():
    pieces = [f"piece {k % 50} of {k % 7}".encode() for k in range(3000)]
    start = np.arange(2990).repeat(8)
    end = start + np.tile(np.arange(2, 10), 2990)
    found = list(zip(*(x.tolist() for x in run_hashes(pieces, start, end))))
    by_words = {tuple(pieces[a:b]): h for a, b, h in zip(start, end, found)}
    assert all(by_words[tuple(pieces[a:b])] == h for a, b, h in zip(start, end, found)) and len(set(by_words.values())) == len(by_words) == 350 * 8


def test_columns_of_any_name(spark):
    names = ("row", "doc", "hash", "d", "h", "starts", "pos", "__doc", "__text", "a.b", "h1")
    docs = spark.createDataFrame([(k, "The same words stand here. And the others, too, stand here.") for k in (1, 2)], "doc_id long, text string")
    docs = docs.select("doc_id", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names], "text")
    out = remove_repeated_spans(docs)
    assert out.columns == [*docs.columns, "n_sentences", "removed", "n_removed"]
    assert sorted((tuple(r)[:-4], r.text) for r in out.collect()) == [((k, *(f"{c} {k}" for c in names)), t) for k, t in ((1, docs.first().text), (2, ""))]
