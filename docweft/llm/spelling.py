"""Spelling variant grouping: a rare-first prefix filter over positional bigrams, then verification.

Every word's bigrams stand in one global order, rarest first (ties: by the bigram, then by place). One inserted, deleted
or replaced letter takes away at most two bigrams of a word, and moves the others by one place at most and never past
each other; so two near words always share one of the three that stand first in each (`prefix_keys`). Only these three
are joined, at places and lengths that an edit allows:

* words of equal length meet where the bigram is at the same place; words of lengths m and m + 1 where the longer one has
  it at the same place or one further;
* one edit leaves one side of a word whole: its first m // 2 letters, or all after them. So the key also holds which side
  is the same, and that side's letters as a hash. This keeps the rows of one key few, whatever the bigrams' frequencies.

Meeting words are verified by their edit distance inside the join; a pair found by more keys counts once. All of this
grows with the words; only the bigrams' ranks are broadcast, at most 90 x 90 of them, as words have 90 letters at most.

Defined results: a null text has no words, a null id counts as an empty one, repeated rows count each; a text is taken
whole, however long it or a word is. Ties of the largest n go to the smaller word in code-point order. An empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import scratch
from docweft.session import written as stored

from .common import give_back

# Fixed values of the contract: letters, the part of runs that loses one, least length and number of a word, and how many times its form is more frequent.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THINNED, SHORTEST, LEAST, TIMES = 31, 7, 2, 10
#: Bigrams of a word that are joined: an edit takes two away at most.
PREFIX = 3
#: Letters that a task lays out at a time.
BATCH = 1 << 21
#: Code points of the letters, and room for the place of one in a bigram's number.
ALPHABET = 256


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, where crc32 of id:run says so without one letter, and how often each occurs."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({LETTERS}{{{SHORTEST},}})"), F.lit(1))
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    thinned = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    counted = rows.select(F.when(F.col("h") % THINNED == 0, thinned).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= SHORTEST) & (F.col("n") >= LEAST))


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """Of each bigram (first * ALPHABET + second code point) its place in the order, rarest first; at most 90 x 90 occur."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    pairs = words.select("word", at.alias("at")).select(F.substring(F.col("word"), F.col("at"), F.lit(2)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()
    ranks = np.zeros(ALPHABET * ALPHABET, np.int64)
    for rank, (pair, _) in enumerate(sorted(pairs, key=lambda r: (r.n, r.pair))):
        ranks[ord(pair[0]) * ALPHABET + ord(pair[1])] = rank
    return ranks


def _layouts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about BATCH letters, with all their letters and each word's length."""
    size = pc.utf8_length(batch.column(0)).to_numpy()
    start = 0
    while start < len(size):
        stop = start + max(1, int(np.searchsorted(np.cumsum(size[start:]), BATCH)))
        part = batch.slice(start, stop - start)
        letters = np.frombuffer("".join(part.column(0).to_pylist()).encode("latin-1"), np.uint8).astype(np.int64)
        yield part, letters, size[start:stop].astype(np.int64)
        start = stop


def _mixed(*numbers: np.ndarray | int) -> np.ndarray:
    """One well-spread 64-bit number of some."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for x in numbers:
            h = (h ^ np.asarray(x).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(31))
    return h.view(np.int64)


def prefix_keys(ranks: np.ndarray, letters: np.ndarray, size: np.ndarray, roles: tuple[bool, ...]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(as the longer word?, rows, keys), for each role, of words laid out one after the other: the keys by which each meets near ones.

    A word of m letters meets, under a key of m, words as long and one letter longer; as the longer word under keys of
    m - 1. Side 0 are the first h letters, side 1 all after them, or after the letter that is too many.
    """
    ends = np.cumsum(size)
    starts = ends - size
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(letters)) - starts[row]
    pair = at < size[row] - 1  # not the last letter
    rank = ranks[letters[:-1] * ALPHABET + letters[1:]][pair[:-1]] if len(letters) else letters
    prow, pat = row[pair], at[pair]
    order = np.lexsort((pat, rank, prow))
    place = np.arange(len(order)) - np.concatenate([[0], np.cumsum(size - 1)])[prow[order]]
    taken = order[place < PREFIX]
    prow, pat, rank = prow[taken], pat[taken], rank[taken]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=1)) + 1, 0x100000001B3, np.uint64))
        letter = letters.astype(np.uint64) + np.uint64(1)
        for longer in roles:
            m = size - longer  # the shorter word's letters
            h = m // 2
            for side in (0, 1):
                first = h + longer  # where side 1 begins
                inside = at < h[row] if side == 0 else at >= first[row]
                own = np.where(inside, letter * powers[np.where(inside, at if side == 0 else at - first[row], 0)], np.uint64(0))
                whole = np.add.reduceat(own, starts) if len(own) else own
                for shift in (0, 1) if longer else (0,):
                    fits = pat >= shift
                    if longer and side != shift:  # bigrams that lie wholly beyond the letter that is too many, for any place it can have
                        fits &= pat > h[prow] if shift else pat < h[prow] - 1
                    r = prow[fits]
                    yield longer, r, _mixed(m[r], rank[fits], pat[fits] - shift, side, whole[r])


def _with_keys(words: DataFrame, ranks: Broadcast, roles: tuple[bool, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, letters, size in _layouts(batch):
                for longer, rows, keys in prefix_keys(ranks.value, letters, size, roles):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(rows), longer)), *part.take(pa.array(rows)).columns], ["key", "longer", "word", "n"])
        give_back()

    return words.select("word", "n").mapInArrow(run, "key long, longer boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two near words of words(word, n), once; b is the longer one or the later one."""
    ranks = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))
    one = _with_keys(words, ranks, (False,)).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = _with_keys(words, ranks, (False, True)).select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = one.join(other, "key").where(F.col("longer") | (F.col("a") < F.col("b")))
    near = met.where((F.length("b") - F.length("a") == F.col("longer").cast("int")) & (F.levenshtein("a", "b", 1) == 1))
    return near.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), without circles: (word, root). A form is TIMES as frequent, so steps are few, and each round doubles them."""
    up = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        more = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(up.join(more, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return up


def group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    with scratch(df.sparkSession) as keep:
        counted = stored(words(df, id_col, text_col), "words")
        pairs = near_pairs(counted)
        both: Column = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
        near = pairs.select(both.alias("p")).select("p.*")
        # The largest n, of ties the smallest word: a minimum of (-n, word).
        best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
        best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
        rows = counted.join(best, "word", "left")
        formed = F.col("near_n") >= TIMES * F.col("n")
        rows = stored(rows.select("word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
        roots = _roots(rows.where("form is not null"))
        keep.append(stored(rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "groups"))
        return keep[0]
