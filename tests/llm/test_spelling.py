"""Spelling variants against all deletions of all words, and the prefix filter against every near pair."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF, connect, rows_of, rows_of_sql

from docweft.llm import queries, spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = near_words(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), words.get(form.get(w)) or 0) for w, n in words.items())


def near_words(words):
    cut, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), group in cut.items():
        for a in group:
            near[a] |= group - {a}
            if rest in words:
                near[a].add(rest)
                near[rest].add(a)
    return near


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.group(df).collect())


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aÀÿéz"])
def test_no_near_pair_is_lost(alphabet):
    """Every two near words share a key, also among words of few letters, whose bigrams repeat and tie."""
    rng = random.Random(5)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 11))) for _ in range(600)}
    words |= {w[:k] + c + w[k + d :] for w in [*words] for k in (0, 3, len(w) - 1) for c in ("", rng.choice(alphabet)) for d in (0, 1)}
    words = sorted(w for w in words if len(w) >= 7)
    counts = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    ranks = np.zeros(spelling.ALPHABET**2, np.int64)
    for rank, pair in enumerate(sorted(counts, key=lambda p: (counts[p], p))):
        ranks[ord(pair[0]) * spelling.ALPHABET + ord(pair[1])] = rank
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    keys = {False: defaultdict(set), True: defaultdict(set)}
    for longer, rows, at in spelling.prefix_keys(ranks, letters, np.array([*map(len, words)]), (False, True)):
        for r, k in zip(rows.tolist(), at.tolist(), strict=True):
            keys[longer][words[r]].add(k)
    for w, group in near_words(words).items():
        for other in group:
            if len(other) >= len(w):
                assert keys[False][w] & keys[len(other) > len(w)][other], (w, other)


def test_groups(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("etaoinshé") for _ in range(rng.randrange(7, 12))) for _ in range(40)]
    rows = []
    for i in range(500):
        words = [rng.choice(base[:4] if rng.random() < 0.7 else base) for _ in range(60)]
        words = [w[:k] + rng.choice("xyz") + w[k + 1 :] if rng.random() < 0.05 and (k := rng.randrange(len(w))) >= 0 else w for w in words]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(None, "Colourful colourful"), (None, None), (7, ""), (7, "x" * 50_000 + " " + "x" * 49_999 + " " + "x" * 50_000), (8, "x" * 50_000 + " " + "x" * 49_999), rows[3], rows[3], (9, "É" * 9 + "ß×÷")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as word", "1 as n", "'k' as key")
    want = brute(rows)
    assert found(df) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want) is not None


def test_chain_and_ties(spark):
    """A form's own form is the root; of two near words as frequent the smaller counts."""
    words = {"aaaabbbb": 2000, "aaaabbbc": 200, "aaaabbcc": 20, "aaaaccbb": 20, "zzzzzzzz": 20, "zzzzzzzy": 2, "zzzzzzyz": 20}
    text = " ".join(" ".join([w] * n) for w, n in words.items())
    doc = next(i for i in range(100_000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in words))
    rows = [(doc, text)]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [*got.values()] == brute(rows)
    assert got["aaaabbcc"][1:3] == ("aaaabbbc", "aaaabbbb")
    assert got["zzzzzzzy"][1] == "zzzzzzzz"


def test_empty(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sql(spark):
    name = "op12_spelling"
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(), queries.ORACLES[name])
