import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagefacts.llm import alignment as A
from pagefacts.llm.tokens import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  b", "x \n y", "tab\t here ", "a▁b", "it's 12 o'clock, isn't it?\n\nYes ", "<|endoftext|> a<|endoftext|>", "<s> x </s> <unk> [INST]", "é  è  z", "a\0 \0 b", "日本 語 🙂", " x   y", "ﬁ ligature", "word " * 20_000, "x" * 5_000]


@pytest.fixture(scope="module")
def lib():
    return A.Tokenizers(*PATHS)


def spans(ids, size):
    ends = np.cumsum([size[i] for i in ids]).tolist()
    return list(zip([0, *ends], ends, strict=False))


def plain(lib, texts):
    """The contract, pair by pair; texts as a whole, no units."""
    links, rows = [], []
    for text in texts:
        a = lib.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = lib.b.encode(text or "")
        data = (" " + (text or "")).encode()
        if not text or b"".join(lib.a_bytes[i] for i in a) != data or b"".join(lib.b_bytes[i] for i in b) != data:
            rows.append(None)
            links.append([])
            continue
        at, bt, j, own = spans(a, lib.a_size), spans(b, lib.b_size), 0, []
        for i, (p, q) in enumerate(at):
            while bt[j][1] <= p:
                j += 1
            k = j
            while k < len(bt) and bt[k][0] < q:
                own.append((a[i], b[k]))
                k += 1
        cuts = sorted({e for _, e in at} & {e for _, e in bt})
        groups, i, j = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(at) and at[i][1] <= cut:
                ga.append(str(a[i]))
                i += 1
            while j < len(bt) and bt[j][1] <= cut:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), r[3]) for r, own in zip(rows, links, strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t'sL1,.  \x1c\x85\x00<|>▁日🙂"), max_size=40), max_size=3))
def test_units_equal_whole_texts(texts):
    s = A.Slice(texts, A.worker_tokenizers(*PATHS))
    groups, begin = s.groups(), 0
    for text, end in zip(texts, s.ends.tolist(), strict=True):
        n_a, n_b, n_groups, n_links, *_, digest = plain(A.worker_tokenizers(*PATHS), [text])[0]
        own = s.codes[begin:end]
        assert (s.n_a[own].sum(), s.n_b[own].sum(), s.n_groups[own].sum(), s.links[own].sum()) == (n_a, n_b, n_groups, n_links)
        assert (hashlib.sha256(";".join(groups[c] for c in own).encode()).hexdigest() if len(own) else "") == digest
        begin = end


def test_units_that_do_not_come_back(monkeypatch, lib):
    """A unit that a tokenizer changes takes its text's tokens, and no other's."""
    broken = A.Tokenizers(*PATHS)
    real = broken.b.encode
    monkeypatch.setattr(broken, "b", type("B", (), {"encode": lambda self, x, **k: real([t.replace("odd", "add") for t in x], **k)})())
    s = A.Slice(["one two", "an odd one", "two"], broken)
    assert s.ends.tolist() == [2, 2, 3] and len(s.links) == 3
    whole = A.Slice(["one two", "two"], lib)
    assert [s.groups()[c] for c in s.codes] == [whole.groups()[c] for c in whole.codes]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 49, n))
        h = A.PerfectHash.build(keys)
        assert sorted(h.find(keys).tolist()) == list(range(len(keys))) and (h.keys[h.find(keys)] == keys).all()
        others = rng.integers(0, 1 << 49, 1000)
        assert ((h.find(others) >= 0) == np.isin(others, keys)).all()


def results(spark, texts):
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    out = {r.doc_id: tuple(r)[1:] for r in A.aligned_documents(df, *PATHS).collect()}
    return [out[i] for i in range(len(texts))]


def test_odd_texts(spark, lib):
    texts = [*ODD, "same text", "same text", *ODD[:4]]
    got = results(spark, texts)
    assert got == plain(lib, texts)
    assert got[ODD.index("a▁b")] == (0, 0, 0, 0, 0, 0, "")
    assert results(spark, []) == []
    df = spark.createDataFrame([(None, "a b"), (3, "a"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_a) for r in A.aligned_documents(df, *PATHS).collect()) == [(-1, 2), (3, 1), (3, 1)]


@pytest.mark.parametrize("most", [0, 40, 4_000_000])
def test_all_documents(spark, sf, lib, monkeypatch, most):
    """With the whole table broadcast, with its frequent pairs, and with none; several shards and parts of a task."""
    for name, value in {"MOST_PAIRS": most, "SHARD_PAIRS": 700}.items():
        monkeypatch.setattr(A, name, value)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert results(spark, texts) == plain(lib, texts)
