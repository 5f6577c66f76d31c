"""BPE against the tokenizers library, with exact round trips."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweft.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Transducer(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


def agree(both, text):
    t, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    chunks = [*t.encode(text)]
    assert np.frombuffer(b"".join(chunks), "<u4").tolist() == want
    assert "".join(t.decode(chunks)) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(list("aethis  \n't'll=-"))), max_size=120))
def test_any_text(both, text):
    agree(both, text)


@pytest.mark.parametrize("text", ["", " ", "\x1c a\x1cb c", "it's'LL 've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ﬁ é 😀‍", "²½٣३ १२", "_a__b", " \n\n  x\t\n"])
def test_odd_texts(both, text):
    agree(both, text)


def test_long_pieces(both):
    rng = random.Random(2)
    for text in ("a" * 60_000, "ab" * 40_000, "=" * 70_000 + "x", " " * 70_000 + "x", "".join(rng.choice("etaoinshrdlu") for _ in range(80_000)), "x " * 100_000, "\n" * 70_000):
        agree(both, text)


def test_constant_memory(both):
    """Over a long piece fed in chunks, what may still change stays within the bound."""
    t, lib = both
    rng = random.Random(3)
    piece = "".join(rng.choice("etaoinsh") for _ in range(200_000)).encode()
    held, out = 0, []
    fed = 0

    def chunks():
        nonlocal fed
        for i in range(0, len(piece), 1000):
            fed = i + 1000
            yield piece[i : i + 1000]

    done = 0
    for token in t.feed(chunks()):
        held = max(held, fed - done)
        done += len(t.bytes_of[token])
        out.append(token)
    assert out == lib.encode(piece.decode(), add_special_tokens=False).ids
    assert held <= 4 * t.lookahead + 5 * t.longest + 2000


def test_lookahead_bounds_changes(both):
    """A prefix's tokens further back than the lookahead are those of the whole text."""
    t, _ = both
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("etaoinshr") for _ in range(900)).encode()
        whole, cut = t._scan(text, [], -1, len(text)), t._scan(text[:600], [], -1, 600)
        safe = 600 - t.lookahead
        assert [x for x in whole if x[0] <= safe] == [x for x in cut if x[0] <= safe]


def small_spec(merges):
    letters = {v: k for k, v in bpe.byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    return json.dumps({"model": {"vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}, "added_tokens": []})


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_small_merge_lists(data):
    """Against plain merging by rank, for random merge lists: every pair test and step back counts here."""
    tokens, merges = ["a", "b", "c"], []
    for _ in range(data.draw(st.integers(1, 8))):
        a, b = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    t = bpe.Transducer(small_spec(merges))
    rank = {m: i for i, m in enumerate(merges)}
    for _ in range(15):
        text = data.draw(st.text(alphabet="abc", min_size=1, max_size=14))
        parts = [*text]
        while len(parts) > 1:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        got = np.frombuffer(t.ids(text.encode()), "<u4").tolist()
        assert [t.bytes_of[i].decode() for i in got] == parts


def test_tokens_of_parts_that_never_come_about():
    """aaab is made of aaa and b, but aaa's own bytes encode to aa and a: so do those of aaab to aa and ab."""
    t = bpe.Transducer(small_spec([("a", "a"), ("a", "b"), ("a", "aa"), ("aaa", "b")]))
    assert [t.bytes_of[i] for i in np.frombuffer(t.ids(b"aaab"), "<u4")] == [b"aa", b"ab"]


def test_operator(spark, both):
    rows = [(1, "Hello, world"), (2, None), (None, ""), (3, "x " * 50_000), (3, "x " * 50_000)]
    df = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.digest_documents(df, PATH).collect()
    assert len(got) == 5
    for r in got:
        texts = {t or "" for i, t in rows if i == r.doc}
        assert r.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    full = {r.doc: r for r in bpe.encode_documents(df, PATH, texts=True).collect()}
    assert full[1].decoded == "Hello, world" and full[2].n_tokens == 0
    assert bpe.digest_documents(df.limit(0), PATH).count() == 0


def test_text_without_white_space_is_streamed(both, monkeypatch):
    """A text of one piece, and one of many without a place to cut, come in chunks; ids as the library's."""
    mine, library = both
    monkeypatch.setattr(bpe, "SLICE", 1 << 10)
    for text in ("abcdefghij" * 3000, "ab1," * 5000, "词语" * 4000 + "!" * 3000 + " tail of words"):
        chunks = [*mine.encode(text)]
        assert max(map(len, chunks)) <= 4 * 4 * bpe.SLICE
        assert np.frombuffer(b"".join(chunks), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert "".join(mine.decode(chunks)) == text
