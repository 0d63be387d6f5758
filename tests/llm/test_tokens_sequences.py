import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagefacts.llm import sequences as S
from pagefacts.llm import tokens as T

PATH = T.tokenizer_path("byte_bpe_50k.json")
ODD = ["", None, "a", " ", "  b", "x \n y", "end ", "tab\t here", "it's 12 o'clock, isn't it?\n\nYes ", "<|endoftext|> a<|endoftext|>", "é  è  z", "\x1f \x1c a", "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t'sL1,.  \x1c\x85\x00<|>"), max_size=30), max_size=4))
def test_encoder_equals_library(texts):
    encode = T.Encoder(PATH)
    counts, ids = encode(texts)
    want = [encode.library.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == [len(x) for x in want] == T.Encoder(PATH, counts=True)(texts)[0].tolist()
    assert ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("text", ["a \0b c", "\0b c", "a \0", "\0", "a b\0 c"])
def test_texts_with_nul_equal_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    counts, ids = T.Encoder(PATH)([text, "b c"])
    assert counts[0] == len(want) == T.Encoder(PATH, counts=True)([text])[0][0] and ids[: len(want)].tolist() == want


def thue_morse(k, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(1 << k))


@pytest.mark.parametrize("k", range(6, 13))
@pytest.mark.parametrize("run", [1, 64])
@pytest.mark.parametrize("swap", [False, True])
def test_structured_units_are_told_apart(library, k, run, swap):
    """Sums of powers of an odd base, modulo 2^64, are equal for such a text and its mirror."""
    if run << k > 1 << 16:
        pytest.skip("the short blocks cover it")
    one, two = "-" * run, "=" * run
    texts = [thue_morse(k, one, two), thue_morse(k, two, one), thue_morse(k, "a", "b"), thue_morse(k, "b", "a")]
    texts = texts[::-1] if swap else texts
    encode, counting = T.Encoder(PATH), T.Encoder(PATH, counts=True)
    for _ in range(2):
        for text in texts:
            want = library.encode(f"x {text}", add_special_tokens=False).ids
            counts, ids = encode([f"x {text}"])
            assert ids.tolist() == want and counts.tolist() == [len(want)] == counting([f"x {text}"])[0].tolist()


def test_cache_generations(monkeypatch, library):
    monkeypatch.setattr(T, "CACHE_UNITS", 5)
    encode = T.Encoder(PATH, counts=True)
    for text in ("a b c d e f g", "a b c x y z", "d e f g", "a a q"):
        assert encode([text])[0].tolist() == [len(library.encode(text).ids)]


def test_counts(spark, sf, library):
    rows = [(i, x, 0) for i, x in enumerate(ODD)] + [(None, "a b", 1), (2, "a", 1)]
    out = T.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = [(d, len((x or "").encode()), n := len(library.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x, _ in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(docs, PATH).collect()} == want
    assert T.token_counts(docs.limit(0), PATH).count() == 0


def test_sentencepiece_counts(spark):
    from sentencepiece import SentencePieceProcessor

    path = T.tokenizer_path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    out = T.token_counts(spark.createDataFrame([(1, "Hello  world é"), (2, None)], "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {1: len(model.encode("Hello  world é")), 2: 0}


def test_sequences_round_trip(spark, library, tmp_path):
    rows = [(100 - i, x, "x") for i, x in enumerate(ODD)] + [(7, "same", "y"), (7, "same", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want, all_ids, start = [], [], 0
    for d, x, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        all_ids += ids
        start += len(ids)
    assert sorted(map(tuple, S.encode_and_read(docs, PATH).collect())) == sorted(want)
    folder = f"file://{tmp_path}/seq"
    files = S.write_sequences(docs, folder, PATH, length=16, rows=3)
    read = []
    for name, _, tokens in files:
        file = S.SequenceFile(f"{folder}/{name}")
        assert len(file) == -(-tokens // 16)
        got = [file[i] for i in range(len(file))]
        assert all(len(ids) == len(mask) == 16 for ids, mask in got)
        read += [int(x) for ids, mask in got for x in ids[mask]]
    assert read == all_ids
    assert S.encode_and_read(docs.limit(0), PATH).count() == 0
