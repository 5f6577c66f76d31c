"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are alike as far as they share subsequences of P letters, each occurrence weighing DECAY to the power of the
letters that its span has too many (spans of up to SPAN letters). So an insult with inserted characters or gaps stays
near the insult. The kernel is normalised; its subsequences are counted explicitly, by their three letters (any letters,
of any script), and hashed nowhere. Nyström maps a word to its kernel values with the landmark words, whitened by the landmarks' own kernel
matrix; a linear support vector machine with squared hinge loss decides in that space. As its decision is linear in the
subsequence counts, landmarks and weights fold into one table of weights for scoring.

Words are the runs of non-white space, letters only (digits and signs that stand for letters are read as these), and
runs of three or more single characters joined ("i d i o t"). A sentence scores as its worst word and a text as its
worst sentence. Training knows only which texts are toxic: sentences of clean texts are all clean; from each toxic text
the word that the machine finds worst is taken as an insult, starting from words that mark toxic texts, and the machine
is trained again (multiple-instance training).

Learning works on bounded samples, scoring on all of every text. Labelled rows: about SAMPLE_DOCS a class and at most
SAMPLE_CHARS characters of whole texts a class; those of over a sixteenth of that are left out. Words: all insults found,
and of the clean texts' words the USUAL most frequent, as many others spread over the rest, and in each round the HARD
ones that the machine likes most. Landmarks: LANDMARKS words, spread over up to LANDMARK_WORDS of each kind.

Defined results: a null or empty text, or one without letters, gets the score of a word without subsequences, near 0.
Without labelled rows of both classes every text scores 0. Ties of the sample are broken by text. Null ids and repeated
rows are scored like any row, texts of any length whole; extra columns are kept (`keep_clean`) or ignored; an empty
table gives an empty table.
"""


import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_of

#: Subsequence length is three; span, decay for each letter too many, letters of a word looked at together.
SPAN, DECAY, LETTERS = 5, 0.5, 24
SAMPLE_DOCS, LANDMARKS, ROUNDS, CACHE, PART = 1500, 300, 3, 150_000, 10_000
SAMPLE_CHARS, USUAL, HARD, LANDMARK_WORDS = 1 << 25, 2000, 3000, 600
#: Predicted toxic from this score on; a decision of 0 scores 0.5.
THRESHOLD = 0.7

# Signs commonly written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
#: A feature is three letters' code points, of BITS bits each; EDGE, which is no code point, is a word's start or end.
BITS, EDGE = 21, 0x1FFFFF


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """For each code point its letter's lower case, signs read as the letters that they stand for, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = LOOKALIKES.get(chr(i), chr(i))
        if c.isalpha():
            out[i] = ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    return out


# The places of the 2nd and 3rd letter after the 1st, with their weights.
SHAPES = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]


def _counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subsequence counts of the words: (key, value, base, letters); a key has the word and three letters as digits to the base, letters by number."""
    n = len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = symbol_table()[codes]
    own = np.repeat(np.arange(n), [len(w) for w in words])
    own, sym = own[sym > 0], sym[sym > 0]
    ends = np.arange(n)  # both edges of each word count as letters
    order = np.argsort(np.r_[ends * 3, own * 3 + 1, ends * 3 + 2], kind="stable")
    own, sym = np.r_[ends, own, ends][order], np.r_[np.full(n, EDGE, np.uint32), sym, np.full(n, EDGE, np.uint32)][order]
    letters, sym = np.unique(sym, return_inverse=True)
    base = max(1, len(letters))
    idx, val = [np.zeros(0, np.int64)], [np.zeros(0)]
    for j, k, weight in SHAPES:
        if len(sym) > k:
            inside = own[k:] == own[:-k]
            key = ((own[:-k] * base + sym[:-k]) * base + sym[j : len(sym) - k + j]) * base + sym[k:]
            idx.append(key[inside])
            val.append(np.full(int(inside.sum()), weight))
    keys, at = np.unique(np.concatenate(idx), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(val)), base, letters.astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse subsequence counts of the words: (word, feature, value) with every pair of the first two once."""
    keys, value, base, letters = _counts(words)
    if not len(keys):
        return keys, keys, value
    first, second, third = letters[keys // base**2 % base], letters[keys // base % base], letters[keys % base]
    return keys // base**3, (first << 2 * BITS) + (second << BITS) + third, value


def _dense(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised counts of words by the features that any of them has, and those features."""
    w, f, v = features(words)
    used, col = np.unique(f, return_inverse=True)
    out = np.zeros((len(words), len(used)))
    out[w, col] = v
    out /= np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]
    return out, used


def pieces(text: str) -> list[str]:
    """The words of a text, long ones in overlapping parts, with runs of single characters joined."""
    words = text.split()
    words += ["".join(m[0].split()) for m in SPACED.finditer(text)]
    if any(len(w) > 4 * LETTERS for w in words):
        words = [p for w in words for p in ([w] if len(w) <= 4 * LETTERS else [w[i : i + 4 * LETTERS] for i in range(0, len(w), 3 * LETTERS)])]
    return words


class Machine:
    """Scores words by the folded weights of features (sorted); texts by their worst word."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.features, self.weights, self.bias, self.scale, self.shift = features, weights, bias, scale, shift
        self.cache: dict[str, float] = {}
        parts = [features >> 2 * BITS, features >> BITS & EDGE, features & EDGE]
        letters = np.unique(np.concatenate(parts))
        #: The weights as a cube over the features' letters, as long as these are few; 0 stands for all other letters.
        self.letters, self.cube = letters, None
        if len(letters) < 100:
            self.side = len(letters) + 1
            self.cube = np.zeros(self.side**3)
            a, b, c = (np.searchsorted(letters, x) + 1 for x in parts)
            self.cube[(a * self.side + b) * self.side + c] = weights

    def weigh(self, keys: np.ndarray, base: int, letters: np.ndarray) -> np.ndarray:
        """The weights of features (see _counts), 0 for those that no landmark has."""
        if not len(self.features):
            return np.zeros(len(keys))
        if self.cube is None:
            f = (letters[keys // base**2 % base] << 2 * BITS) + (letters[keys // base % base] << BITS) + letters[keys % base]
            at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
            return np.where(self.features[at] == f, self.weights[at], 0.0)
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        number = np.where(self.letters[at] == letters, at + 1, 0)
        two = (number[:, None] * self.side + number) * self.side  # the place of each two letters in the cube
        last = keys % base
        return self.cube[two.ravel()[keys // base % base**2] + number[last]]

    @property
    def parts(self) -> tuple:
        """What another process makes the machine of."""
        return self.features, self.weights, self.bias, self.scale, self.shift

    def decide(self, words: list[str]) -> np.ndarray:
        """The decision on each word, in parts of PART words."""
        return np.concatenate([self._decide(words[i : i + PART]) for i in range(0, len(words), PART)]) if words else np.zeros(0)

    def _decide(self, words: list[str]) -> np.ndarray:
        keys, v, base, letters = _counts(words)
        w = keys // base**3
        dot = np.bincount(w, v * self.weigh(keys, base, letters), len(words))
        norm = np.sqrt(np.bincount(w, v * v, len(words)))
        return dot / np.maximum(norm, 1e-12) + self.bias

    def score(self, decision: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.scale * (decision - self.shift)))))

    def learn(self, words: Iterable[str]) -> None:
        """Puts the decisions of words into the cache."""
        words = [*words]
        self.cache.update(zip(words, self.decide(words).tolist(), strict=True))

    def worst(self, texts: list[str]) -> list[float]:
        """The largest decision over the words of each text."""
        out = []
        for at in range(0, len(texts), 100):
            split = [pieces(t) for t in texts[at : at + 100]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.learn({w for ws in split for w in ws} - self.cache.keys())
            get = self.cache.__getitem__
            out += [max(map(get, ws), default=self.bias) for ws in split]
        return out


def train(texts: list[str], labels: list[int]) -> Machine:
    """Multiple-instance training on whole texts with 0/1 labels."""
    none = Machine(np.zeros(0, np.int64), np.zeros(0), -1.0, 50.0, 0.0)
    # Near copies count once, else the rare words of a copied text would look like marks: texts with equal smallest word hashes.
    bags, met, own = [], set(), {}  # own: equal words of different texts are one string
    for text, y in zip(texts, labels, strict=True):
        bag = {w.lower().strip(".,;:!?\"'()") for w in pieces(text)} - {""}
        key = (y, *sorted(zlib.crc32(w.encode()) for w in bag)[:2])
        words = (own.setdefault(w, w) for w in sorted(bag))
        bags.append(None if key in met else {*words} if y else [*words])  # clean texts' words are only gone through: a list takes less
        met.add(key)
    del texts, met, own
    labels = [y for b, y in zip(bags, labels, strict=True) if b]
    bags = [b for b in bags if b]
    toxic = [b for b, y in zip(bags, labels, strict=True) if y]
    clean = [b for b, y in zip(bags, labels, strict=True) if not y]
    if not toxic or not clean:
        return none
    t, c = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    seeds = marks(toxic, t, c, len(clean))
    if not seeds:
        return none
    explained = [not b.isdisjoint(seeds) for b in toxic]
    usual = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    negatives = usual[:USUAL] + usual[USUAL :: max(1, len(usual) // USUAL)]
    positives = seeds
    for _ in range(ROUNDS):
        machine = fit(positives, negatives)
        chosen = Counter()
        for bag, known in zip(toxic, explained, strict=True):
            words = sorted(bag)
            d = machine.decide(words)
            if not known:
                chosen[words[int(d.argmax())]] += 1
            chosen.update(w for w, x in zip(words, d, strict=True) if x > 0.5)
        positives = seeds + sorted((w for w, n in chosen.items() if c[w] == 0 and w not in seeds), key=lambda w: (-t[w], w))
        hard = sorted(((x, w) for w, x in zip(usual, machine.decide(usual), strict=True) if x > -0.7), reverse=True)
        negatives = sorted({*negatives, *(w for _, w in hard[:HARD])})
    machine = fit(positives, negatives)
    # The score passes the threshold where half of the gap between clean texts' worst words and insults is crossed.
    top = np.sort(machine.worst([" ".join(b) for b in clean]))
    low = np.sort(machine.worst([" ".join(sorted(b)) for b in toxic]))
    cuts = np.unique(np.concatenate([top, low]))
    errors = np.searchsorted(low, cuts, "right") / len(low) + 1 - np.searchsorted(top, cuts, "right") / len(top)
    best = int(errors.argmin())
    cut = (cuts[best] + (cuts[best + 1] if best + 1 < len(cuts) else cuts[best] + 1)) / 2
    scale = 6.0
    return Machine(machine.features, machine.weights, machine.bias, scale, cut - math.log(THRESHOLD / (1 - THRESHOLD)) / scale)


def marks(toxic: list[set[str]], t: Counter, c: Counter, n_clean: int) -> list[str]:
    """Words that explain why texts are toxic: greedily the one that marks most of those not yet explained and is all but absent from clean texts."""
    left, out = [*toxic], []
    while left:
        here = Counter(w for b in left for w in b)
        odds = {w: math.log((t[w] + 0.1) / len(toxic)) - math.log((c[w] + 0.1) / n_clean) for w, n in here.items() if n > 2}
        best = max((w for w in odds if odds[w] > 3), key=lambda w: (odds[w] * here[w], w), default=None)
        if best is None:
            break
        out.append(best)
        left = [b for b in left if best not in b]
    # Others that clean texts lack too often for chance, over all words that were looked at.
    share = math.log((len(toxic) + n_clean) / len(toxic))
    sure = sorted((w for w, n in t.items() if c[w] == 0 and n * share > math.log(1000 * len(t))), key=lambda w: (-t[w], w))
    return out + [w for w in sure if w not in out]


def spread(words: list[str], n: int) -> list[str]:
    """n words that span the others' kernel: each the one that those before explain least (pivoted Cholesky)."""
    x, _ = _dense(words)
    left, basis, out = (x * x).sum(1), [], []
    while len(out) < min(n, len(words)) and left.max() > 1e-3:
        i = int(left.argmax())
        column = x @ x[i]
        for b in basis:
            column = column - b * b[i]
        column /= math.sqrt(left[i])
        basis.append(column)
        left = np.maximum(left - column**2, 0)
        out.append(words[i])
    return out


def fit(positives: list[str], negatives: list[str]) -> Machine:
    """The support vector machine in the Nyström space of landmarks from both classes."""
    words = [*positives, *negatives]
    y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
    marks = [*spread(positives[:LANDMARK_WORDS], LANDMARKS // 2), *spread(negatives[:: max(1, len(negatives) // LANDMARK_WORDS)], LANDMARKS // 2)]
    landmarks, used = _dense(marks)
    kernel = landmarks @ landmarks.T
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])  # K^-1/2 up to a rotation
    w, f, v = features(words)
    norm = np.sqrt(np.bincount(w, v * v, len(words)))
    col = np.minimum(np.searchsorted(used, f), len(used) - 1)
    hit = used[col] == f
    cross = np.zeros((len(words), len(marks)))
    order = np.flatnonzero(hit)
    for part in np.array_split(order, max(1, len(order) // 10_000)):
        np.add.at(cross, w[part], landmarks.T[col[part]] * v[part, None])
    x = cross / np.maximum(norm, 1e-12)[:, None] @ white
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y > 0, 1 / len(positives), 1 / len(negatives)) * len(y) / 2
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps for the squared hinge
        margin = 1 - y * (x @ beta)
        on = margin > 0
        h = (x[on] * weight[on, None]).T @ x[on] * 10 + np.eye(len(beta))
        step = np.linalg.solve(h, 10 * (x[on] * (weight[on] * y[on])[:, None]).sum(0))
        if np.abs(step - beta).max() < 1e-9:
            break
        beta = step
    return Machine(used, landmarks.T @ (white @ beta[:-1]), float(beta[-1]), 6.0, 0.0)


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """About `docs` labelled texts of each class by a hash of the id, whole, and at most so many characters of each; sent to the driver within these bounds."""
    key = F.pmod(F.xxhash64(F.col("_id"), F.lit(8)), F.lit(1 << 30))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_key", key)
    n = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    if len(n) < 2:
        return [], []
    part = lambda y: F.lit(min(1 << 30, (1 << 30) * docs // n[y] + 1))
    picked = marks.where(F.col("_key") < F.when(F.col("_y") == 1, part(1)).otherwise(part(0)))
    # About 2 * docs ids: bounded, so broadcast; documents are not shuffled. First the lengths, then the texts within the bound.
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    room, keys = {0: chars, 1: chars}, []
    for k, y, size in sorted(tuple(r) for r in rows.select("_key", "_y", F.length("_text")).collect()):
        if size <= chars // 16 and size <= room[y]:
            room[y] -= size
            keys.append((k, y, size))
    if not keys:
        return [], []
    within = df.sparkSession.createDataFrame(keys, "_k long, _l int, _n int").distinct()
    met = rows.join(F.broadcast(within), (F.col("_key") == F.col("_k")) & (F.col("_y") == F.col("_l")) & (F.length("_text") == F.col("_n")))
    rows = [tuple(r) for r in met.select("_key", "_text", "_y").collect()]
    rows.sort()
    return [r[1] for r in rows], [r[2] for r in rows]


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(machine.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = [m.score(d) for d in m.worst(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc", "score"])
        m.cache.clear()
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).mapInArrow(run, f"doc {kind}, score double")


def keep_clean(df: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score below the threshold, with df's columns."""
    shared = df.sparkSession.sparkContext.broadcast(machine.parts)

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                scores = [m.score(d) for d in m.worst([t or "" for t in part.column(at).to_pylist()])]
                yield part.filter(pa.array([x < threshold for x in scores]))
        m.cache.clear()
        give_back()

    return df.mapInArrow(run, df.schema)
