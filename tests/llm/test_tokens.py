import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import pieces
from barloom.llm.binary_output import _read, read_ids, write_ids
from barloom.llm.common import open_fs
from barloom.llm.dac import Dac, build
from barloom.llm.token_counts import count_tokens

from .common_frames import documents, empty

BPE, SPM = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def odd_texts(n, seed=5):
    r = random.Random(seed)
    parts = [*"ab,. \n\t\r\x0b\x1c\x85\xa0▁'s9é½ß\x01\x00", "<|endoftext|>", "<s>", "  ", "the", "　", "ﬁ", "世", "́", "don't", "Ünïcode"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_units_give_the_libraries_ids_and_lengths():
    ids, lengths, t = pieces.ByteLevelIds(BPE, most=500), pieces.PieceLengths(SPM, {"the": 1}, most=500), Tokenizer.from_file(BPE)
    assert ids.by_unit and lengths.by_unit
    letters = [f"x{chr(c)}y {chr(c)}, {chr(c)}{chr(c)}." for c in range(0x21, 0x260)]
    texts = odd_texts(6000) + letters
    for a in range(0, len(texts), 100):
        b = texts[a : a + 100]
        for text, got, n in zip(b, ids.encode(b), lengths.count(b)):
            assert np.frombuffer(got, ids.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
            assert n == len(lengths.sp.encode(text)), repr(text)


def test_encoding_holds_few_results_at_a_time():
    class Counting:
        def __init__(self, tok):
            self.model, self.tok, self.most = tok.model, tok, 0

        def encode_batch_fast(self, texts, **how):
            self.most = max(self.most, len(texts))
            return self.tok.encode_batch_fast(texts, **how)

    ids = pieces.ByteLevelIds(BPE)
    texts = [f"{k}-x{k}" for k in range(5000)]
    want = [np.array(e.ids, ids.kind).tobytes() for e in ids.tok.encode_batch(texts, add_special_tokens=False)]
    ids.tok = Counting(ids.tok)
    assert ids.encode(texts) == want
    assert 0 < ids.tok.most <= pieces.ENCODED


def test_files_are_built_and_read_in_little_memory(tmp_path):
    import pyarrow as pa

    n, size = 4000, 500
    ids = np.random.default_rng(1).integers(0, 50_257, n * size).astype(np.uint16)
    tracemalloc.start()
    try:
        data = build(list(range(n)), [size] * n, ids, 0)
        built = tracemalloc.get_traced_memory()[1]
        (tmp_path / "a.dac").write_bytes(data)
        del data
        tracemalloc.reset_peak()
        rows = [r for b in _read(iter([pa.RecordBatch.from_pydict({"path": [f"file://{tmp_path}/a.dac"], "first": [7]})])) for r in b.to_pylist()]
        read = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(k, 7 + k * size, size) for k in range(n)]
    assert all(r["ids_crc32"] == zlib.crc32(ids[k * size : (k + 1) * size].astype("<u4").tobytes()) for k, r in enumerate(rows))
    assert built < 10 * len(ids) and read < 30 * len(ids), (built / len(ids), read / len(ids))


def test_random_access():
    rng = np.random.default_rng(0)
    for top in (1, 255, 256, 50_256, 70_000, 2**32 - 1):
        ids = rng.integers(0, top + 1, 3000, dtype=np.uint64).astype(np.uint32)
        ids[::7] %= 200
        lengths = [0, 1000, 0, 1999, 1]
        d = Dac(build([1, None, 3, 4, 5], lengths, ids, 0))
        assert all(d.get(int(i)) == ids[i] for i in rng.integers(0, 3000, 300))
        assert (np.concatenate([d.document(k) for k in range(5)]) == ids).all()
        for _ in range(50):
            a, b = sorted(rng.integers(0, 3001, 2))
            assert (d.slice(int(a), int(b)) == ids[a:b]).all()
    assert Dac(build([], [], np.empty(0, np.uint32), 0)).n == 0
    with pytest.raises(ValueError):
        Dac(b"something else, long enough to hold a header of the format")


@pytest.mark.parametrize("file_ids", [50, 4_000_000])
def test_ids_round_trip(spark, file_ids):
    docs = documents(spark)
    manifest = write_ids(docs, BPE, end_id=0, file_ids=file_ids)
    got = sorted(read_ids(manifest).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(BPE)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    start = 0
    for row, (known, doc, _, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc if known else None, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    store, name = open_fs(manifest.first().path)
    assert Dac(store.open_input_file(name).read()).end_id == 0


def test_token_counts(spark):
    docs = documents(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    want = sorted(((r.doc_id or -1, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect()))
    got = count_tokens(docs, SPM, limit=100).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert count_tokens(empty(spark), SPM).count() == 0


def test_token_counts_of_repeated_words_with_nul(spark):
    words = ["a\x00b", "\x00", "extraordinarily", "x\x00\x00y", "the", "unbelievable,", "\x00z"]
    rows = [(k, " ".join([f"text{k}", *words[k % 7 :], *words * 3])) for k in range(60)]
    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), SPM).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(sp.encode(t)) for k, t in rows}


def test_no_documents(spark):
    assert read_ids(write_ids(empty(spark), BPE)).count() == 0
