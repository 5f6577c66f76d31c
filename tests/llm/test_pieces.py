"""Merge-type pieces against the sentencepiece library, with exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docweft.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return pieces.Model(f.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def agree(both, text):
    m, lib = both
    want = lib.encode(text, add_eos=True)
    chunks = [*m.encode(text, end=True)]
    assert np.frombuffer(b"".join(chunks), "<u4").tolist() == want
    assert "".join(m.decode(chunks)) == lib.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(list("aethins  \n\t▁'.,=-"))), max_size=120))
def test_any_text(both, text):
    agree(both, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_texts_of_pieces(both, ids):
    agree(both, "".join(both[0].texts[i] for i in ids))


@pytest.mark.parametrize("text", ["", " ", "▁", "▁ ▁", "\x00", "a\x00b", "<s>", "</s>x", "<0x41>", "  a", "a  ", "\r\n\r\n", "x².y", "²", "é", "é", "ﬁ", "👩‍👩‍👧", "你好 世界", "▁the the"])
def test_odd_texts(both, text):
    agree(both, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258), st.sampled_from([35, 28705, 29871, 229, 162, 197])), max_size=14), st.integers(0, 14))
def test_any_ids_decode(both, ids, cut):
    m, lib = both
    data = np.array(ids, "<u4").tobytes()
    assert "".join(m.decode([data[: 4 * cut], data[4 * cut :]])) == lib.decode(ids)


def test_long_texts(both):
    rng = random.Random(2)
    for text in ("a" * 70_000, "ab" * 40_000, "=" * 70_000 + "x", " " * 140_000 + "x", "x " * 100_000, "\n" * 70_000, "你好" * 40_000, "".join(rng.choice("etaoinshrdlu") for _ in range(150_000)), "".join(rng.choice("ABab01+/") for _ in range(100_000))):
        agree(both, text)


def varint(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number: int, value: bytes | float | int) -> bytes:
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3) + varint(value)


def made(own: list[tuple[str, float]], kind: int = 2) -> bytes:
    """A model file of these pieces and scores, besides the bytes."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((t, s, 1) for t, s in own)]
    body = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in rows)
    return body + field(2, field(3, kind) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab▁.", min_size=2, max_size=5), max_size=14, unique=True), st.integers(0, 3), st.lists(st.text(alphabet="ab .", max_size=24), max_size=6))
def test_small_models(parts, ties, texts):
    """Pieces of any order and with equal scores, also such as nothing merges to, against the library."""
    data = made([(c, -100.0) for c in "ab▁"] + [(t, -float(i % (ties + 1) if ties else i)) for i, t in enumerate(parts)])
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    m = pieces.Model(data)
    for text in texts:
        assert np.frombuffer(b"".join(m.encode(text)), "<u4").tolist() == lib.encode(text)


def test_fits_is_merging_again(both):
    """The step-by-step comparison says what merging both tokens' text says."""
    m, _ = both
    rng = random.Random(4)
    ids = [*m.piece]
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert m.fits(a, b) == (m.merging(m.piece[a] + m.piece[b])[0] == [m.piece[a], m.piece[b]])


def test_no_word_is_encoded_for_itself(both, monkeypatch):
    """Unlike words, of many texts, take their steps together and are no work of their own each."""
    m, lib = both
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoinshrdlu\u00e9\u00e0") for _ in range(rng.randint(4, 14))) for _ in range(20_000))
    calls = []
    monkeypatch.setattr(m, "encode_chunk", lambda chunk, own=m.encode_chunk: calls.append(chunk) or own(chunk))
    assert np.frombuffer(b"".join(m.encode(text)), "<u4").tolist() == lib.encode(text)
    assert not calls


@pytest.mark.parametrize("sizes", [{}, {"PAIRS": 3000, "BLOCK": 500, "LANE": 16}, {"STEPS": 0, "LONG": 5}, {"SLICE": 40, "BLOCK": 300}])
def test_many_texts_at_once(both, monkeypatch, sizes):
    """Texts of one block leave each other alone, also with a small memory of pairs, without a table of steps, and cut often."""
    for name, value in sizes.items():
        monkeypatch.setattr(pieces, name, value)
    with open(PATH, "rb") as f:
        m = pieces.Model(f.read())
    lib, rng = both[1], random.Random(6)
    words = [*both[0].texts, "naïve", "🤖", "你好", "\x00", "  ", "\n", "x=1;", "pneumonoultra", "e" * 300, "", "", ""]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["the " * 100, " " * 250, "", "▁"]
    ids, numbers, back = ([[] for _ in texts] for _ in range(3))
    for rows, own, at in m.blocks(texts, True):
        (digits, n_at), (out, t_at) = m.written(own, at), m.spelled(own, at)
        for k, row in enumerate(rows):
            ids[row] += own[at[k] : at[k + 1]].tolist()
            numbers[row].append(digits[n_at[k] : n_at[k + 1]].tobytes())
            back[row].append(out[t_at[k] : t_at[k + 1]].tobytes())
    want = [lib.encode(t, add_eos=True) for t in texts]
    assert ids == want
    assert [b"".join(x).decode() for x in numbers] == ["".join(f" {i}" for i in w) for w in want]
    assert [b"".join(x).decode().removeprefix(" ") for x in back] == [lib.decode(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258), st.sampled_from([2, 229, 162, 197])), max_size=8), min_size=1, max_size=4))
def test_any_parts_are_spelled(both, parts):
    """Each part's ids are decoded on their own, also such as make no characters."""
    m, _ = both
    out, at = m.spelled(np.array(sum(parts, []), np.int32), np.cumsum([0, *map(len, parts)]))
    got = [out[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)]
    assert got == ["".join(m.decode([np.array(p, "<u4").tobytes()], True)) for p in parts]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Model(made([("a", -1.0)], kind=1))


def test_rows(spark, both):
    _, lib = both
    texts = [None, "", "  two  spaces ", "naïve 你好 🤖", "x" * 200_000, "word " * 60_000, "same", "same"]
    rows = [(i if i != 6 else None, t, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(pieces.digest_documents(df, PATH, end=True).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    out = {(r.doc, r.decoded): np.frombuffer(r.ids, "<u4").tolist() for r in pieces.encode_documents(df, PATH, texts=True).collect()}
    assert out == {(i, t or ""): lib.encode(t or "") for i, t, _ in rows}
    assert pieces.digest_documents(df.where("false"), PATH).count() == 0
