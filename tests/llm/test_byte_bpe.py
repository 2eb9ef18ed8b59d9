import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.byte_bpe import ByteBpe, Merges, library_class, merged_by_rank, read_ranks, splitter
from barloom.llm.byte_codec import decode, encode, op13_byte_bpe

from .common_frames import documents, empty
from .test_tokens import odd_texts

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
_made: dict = {}


def made(file):
    if file not in _made:
        tokens = read_ranks(public_tokenizers.path(file))
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
        _made[file] = (ByteBpe(tokens, public_tokenizers.PATTERN, most=400), library)
    return _made[file]


def same(file, texts):
    bpe, library = made(file)
    for text, ids in zip(texts, bpe.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("file", FILES)
def test_ids_are_the_librarys(file):
    rng = random.Random(2)
    texts = odd_texts(3000) + ["a" * n for n in (1, 2, 3, 50, 999)] + ["ab" * 700 + "b", "the" * 500, " " * 300, "\n" * 77, "x\n\n y", "՘՘ \U0001e6c0a"]
    letters = "etaoinshrdluETAOIN'é世ß"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(400)]  # long pre-tokens
    same(file, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80), st.sampled_from(FILES))
def test_any_text(text, file):
    same(file, [text])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=2, max_size=5), max_size=12), st.text("ab", min_size=1, max_size=40), st.randoms())
def test_any_vocabulary_that_merges_can_reach(words, text, rng):
    tokens = [bytes([b]) for b in range(256)]
    for w in words:  # only what two known tokens make, and the merges before do not take apart
        parts = merged_by_rank(w.encode(), {t: k for k, t in enumerate(tokens)}, len(tokens))
        if len(parts) > 1:
            tokens.append(parts[0] + parts[1])
    tokens = list(dict.fromkeys(tokens))
    want = [tokens.index(p) for p in merged_by_rank(text.encode(), {t: k for k, t in enumerate(tokens)}, len(tokens))]
    assert Merges(tokens).encode(text.encode()) == want


def test_steps_grow_with_the_text():
    bpe, _ = made(FILES[0])
    calls = [0]
    real = bpe.merges.fit

    def counted(a, b):
        calls[0] += 1
        return real(a, b)

    bpe.merges.fit = counted
    try:
        n = []
        for size in (2_000, 20_000):
            rng = random.Random(4)
            calls[0] = 0
            bpe.merges.encode("".join(rng.choice("abcde") for _ in range(size)).encode())
            n.append(calls[0])
    finally:
        bpe.merges.fit = real
    assert n[1] < 15 * n[0] and n[1] < 10 * 20_000


def test_classes_are_the_librarys():
    codes = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in (r"\p{L}", r"\p{N}"):
        assert set(splitter(name).findall(codes)) == library_class(name)
        assert set(splitter(f"[^{name}]").findall(codes)) == set(codes) - library_class(name)


def test_other_patterns_split_whole_texts():
    tokens = read_ranks(public_tokenizers.path(FILES[0]))
    pattern = r"[a-z]+ [a-z]+|\s|."
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    bpe = ByteBpe(tokens, pattern)
    for text in ("two words and more words here", "a b\nc", ""):
        assert bpe.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_broken_ranks_are_refused(tmp_path):
    p = tmp_path / "ranks"
    p.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        read_ranks(str(p))


def wanted(rows):
    library = made(FILES[0])[1]
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op13_byte_bpe(spark, sf).collect()), key=str) == wanted(map(tuple, rows))


def test_odd_rows(spark, tmp_path):
    docs = documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(20, "q" * 30_000 + " <|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op13_byte_bpe(spark, str(tmp_path)).collect()), key=str) == wanted((r.doc_id, r.text) for r in docs.collect())
    path = public_tokenizers.path(FILES[0])
    assert encode(empty(spark), path, public_tokenizers.PATTERN).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(decode(null, path, public_tokenizers.PATTERN).first().data) == b""
