"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language yields longest-match lengths: a text is parsed greedily into the
longest phrases that occur in the language's text, and the language that needs the fewest phrases a character, divided
by what its own held-back text needs, wins. Automata are built over normalised text: lower case, letters only, runs of
everything else as one space. Parsing runs in numpy, many blocks of text side by side, one automaton step at a time; then
each block is parsed once more from where the block before it ended, until both parses are in one state, so that the
counts are those of whole texts, with phrases that cross blocks.

The labelled text is a bounded sample: about SAMPLE_DOCS documents a language, by a hash of the id, and DOC_CHARS
characters of each at most (only of what is learned; texts to be judged are read whole), of which TRAIN_CHARS characters
are learned, or two thirds of what a language has. A language's own rate is that of all its text: in three folds, each
third is parsed by an automaton of the other two. More learned text makes longer phrases, so languages of unlike text are
compared as if both had learned what the one with less has (sizes fall in steps of STEP): those with most text first, by
their normalised phrases; then the best so far against those with less, size by size, by their phrases. How much the
phrases vary between samples of that size is measured on the larger languages, and the smaller one must need fewer by SURE
such deviations: with less text it must differ more, and a mistaken label's few words never take a language's texts. Where
all have enough, all are compared at once.

Defined results: a null text, or one without a letter, gives `und` with score 0. With no labelled text at all every
text gives `und`. Ties go to the language name that comes first. Null ids and repeated rows are judged like any row;
texts of any length are parsed whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample, and block length.
SAMPLE_DOCS, DOC_CHARS, TRAIN_CHARS, BLOCK = 200, 4_000, 16_000, 512
#: Languages learned at most: the most frequent labels (ties: by name), so that a column of stray labels doesn't fill the driver.
MOST_LANGS = 1000
#: Entries of an automaton's dense table; one with more (a large alphabet) is looked up by sorted transitions.
DENSE = 1 << 22
#: How the sizes of learned text fall below TRAIN_CHARS, the least own rate, and the deviations by which a language with less text must be better.
STEP, LEAST_RATE, SURE = 0.8, 1e-3, 3
#: Samples from whose phrases the deviation is measured.
SAMPLES = 16
#: Blocks parsed side by side.
LANES = 8192


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalise(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters with single spaces (0) between words."""
    low = letters()[codes]
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    return low[keep]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of text: the transitions of each state, by symbol."""
    longest, link, step = [0], [-1], [{}]
    last = 0
    for c in text.tolist():
        now = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                copy = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


def lookup(step: list[dict[int, int]], symbols: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of states (times symbols) and symbols: the next states (times symbols) * 2, plus 1 where a new phrase starts.

    Where a state has no transition, the next state is that of the start state: the phrase ends and the symbol begins the
    next one. A symbol that the text lacks makes a phrase of its own: it leads to the last state, whose entries all
    begin a phrase. Parsing starts there too.
    """
    start = np.full(symbols, len(step), np.int32)
    for c, s in step[0].items():
        start[c] = s
    start = start * (symbols * 2) + 1
    keys = np.array([s * symbols + c for s, to in enumerate(step) for c in to], np.int32)
    values = np.array([t * symbols * 2 for to in step for t in to.values()], np.int32)
    if (len(step) + 1) * symbols <= DENSE:
        table = np.tile(start, len(step) + 1)
        table[keys] = values
        return lambda state, symbol: table[state + symbol]
    order = np.argsort(keys)
    keys, values = np.append(keys[order], np.int32(-1)), np.append(values[order], np.int32(0))

    def sparse(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state + symbol
        at = np.searchsorted(keys[:-1], key)
        return np.where(keys[at] == key, values[at], start[symbol])

    return sparse


class Parser:
    """Cross-parses texts against every language. train: language -> labelled text, normalised and not.

    even: every language learns only as much as the shortest can.
    """

    def __init__(self, train: dict[str, str], chars: int = TRAIN_CHARS, even: bool = True):
        self.langs = sorted(k for k, v in train.items() if len(normalise(points(v))) > 1)
        texts = [normalise(points(train[k])) for k in self.langs]
        seen = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint32)
        seen = seen[seen > 0]
        #: 0 is the space, the last any letter that no language's text has.
        self.symbol = np.full(0x110000, len(seen) + 1, np.int32)
        self.symbol[0] = 0
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        learned = [min(chars, 2 * len(t) // 3) for t in texts]
        if even:
            learned = [min(learned, default=0)] * len(learned)
        else:
            learned = [max(1, int(chars * STEP ** np.ceil(np.log(max(1, m) / chars) / np.log(STEP)))) if m < chars else m for m in learned]
        self.learned = learned
        #: What there is an automaton of: (language, size), first each language at its own size, then at smaller ones that others have.
        self.entries = [*enumerate(learned)] + [(i, c) for i, m in enumerate(learned) for c in sorted({*learned}) if c < m]
        #: For each automaton: symbols in its own numbering (its learned letters, then any other), lookup, state to start in.
        self.local, self.steps, self.starts = [], [], []
        for i, size in self.entries:
            self._learn(self.symbol[texts[i][:size]])
        self.rate = np.array([self._own_rate(k, self.symbol[texts[i][: size + (size + 1) // 2]], size) for k, (i, size) in enumerate(self.entries[: len(texts)])])
        self.spread = {c: np.sqrt(np.mean([self._variance(self.symbol[texts[i]], c) for i, m in enumerate(learned) if m > c])) for c in {*learned} if c < max(learned)}

    def _learn(self, text: np.ndarray) -> int:
        """Adds an automaton of a text (as symbols)."""
        have = np.unique(text)
        have = have[have > 0]
        local = np.full(int(self.symbol.max()) + 1, len(have) + 1, np.int32)
        local[0] = 0
        local[have] = np.arange(1, len(have) + 1)
        step = automaton(local[text])
        self.local.append(local)
        self.steps.append(lookup(step, len(have) + 2))
        self.starts.append(len(step) * (len(have) + 2))
        return len(self.starts) - 1

    def _own_rate(self, entry: int, text: np.ndarray, size: int) -> float:
        """Phrases a character of a text whose first part the entry has learned: each third parsed by the other two."""
        cut = [0, size // 2, size, len(text)]
        phrases = 0
        for f in range(3):
            if f == 2:
                by = entry
            else:
                by = self._learn(np.concatenate([text[: cut[f]], text[cut[f + 1] :]]))
            phrases += int(self.phrases([text[cut[f] : cut[f + 1]]], [by])[0, 0]) if cut[f] < cut[f + 1] else 0
            if f < 2:
                self._forget(1)
        return max(LEAST_RATE, phrases / max(1, len(text)))

    def _forget(self, n: int) -> None:
        for kept in (self.local, self.steps, self.starts):
            del kept[-n:]

    def _variance(self, text: np.ndarray, size: int) -> float:
        """The squared relative deviation (robust) of the phrases that a text's end needs, between samples of this size of the text before it; measured on smaller ones, and scaled, if so many don't fit."""
        stride = max(1, len(text) // (SAMPLES + 1))
        short = max(1, min(size, stride))
        held = text[SAMPLES * stride :][:4000]
        by = [self._learn(text[k * stride : k * stride + short]) for k in range(SAMPLES)]
        n = self.phrases([held], by)[0]
        self._forget(SAMPLES)
        middle = max(1.0, float(np.median(n)))
        # By the median, as some samples may be junk; 1.4826 makes it a normal distribution's deviation.
        return (1.4826 * float(np.median(np.abs(n - middle))) / middle) ** 2 * short / size

    def phrases(self, texts: list[np.ndarray], entries: list[int] | None = None) -> np.ndarray:
        """Phrases of each text (as symbols), by automaton: of all entries, or of some."""
        which_entries = list(range(len(self.starts))) if entries is None else entries
        of = np.array([i for i, t in enumerate(texts) for _ in range(0, len(t), BLOCK)], np.int64)
        blocks = [t[j : j + BLOCK] for t in texts for j in range(0, len(t), BLOCK)]
        sizes = np.array([len(b) for b in blocks], np.int64)
        inner = np.flatnonzero(np.diff(of, prepend=-1) == 0)  # blocks with one of their text before them
        k = len(which_entries)
        own, more, ends = np.zeros((k, len(blocks)), np.int64), np.zeros((k, len(blocks)), np.int64), np.zeros((k, len(blocks)), np.int32)

        def parts(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            which = which[np.argsort(-sizes[which], kind="stable")]
            for first in range(0, len(which), LANES):
                part = which[first : first + LANES]
                yield part, _side_by_side([blocks[b] for b in part])

        for part, grid in parts(np.arange(len(blocks))):
            for row, entry in enumerate(which_entries):
                own[row, part], ends[row, part] = self._parse(entry, grid, sizes[part], np.full(len(part), self.starts[entry], np.int32))
        open_ends = dict.fromkeys(range(k), inner)
        while open_ends:
            new = ends.copy()
            for part, grid in parts(np.unique(np.concatenate([*open_ends.values()]))):
                for row, todo in open_ends.items():
                    mine = np.flatnonzero(np.isin(part, todo)) if len(todo) < len(inner) else np.arange(len(part))
                    at = part[mine]
                    entry = which_entries[row]
                    more[row, at], end = self._joined(entry, grid, mine, sizes[at], ends[row, at - 1], self.starts[entry])
                    new[row, at] = np.where(end >= 0, end, ends[row, at])
            moved = {row: np.flatnonzero(new[row] != ends[row]) + 1 for row in open_ends}
            ends = new
            open_ends = {row: at for row, m in moved.items() if len(at := np.intersect1d(m, inner))}
        out = np.zeros((len(texts), k), np.int64)
        np.add.at(out, of, (own + more).T)
        return out

    def _parse(self, lang: int, grid: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in blocks (the grid's columns, longest first) from these states on, and the states at their ends."""
        look, local = self.steps[lang], self.local[lang]
        total, ends = np.zeros(len(sizes), np.int32), state.copy()
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, len(grid) + 1))
        for step in range(len(grid)):
            n = alive[step]
            if n < len(state):
                ends[n : len(state)] = state[n:]
                state = state[:n]
            state = look(state, local[grid[step, :n]])
            total[:n] += state & 1
            state >>= 1
        ends[: len(state)] = state
        return total, ends

    def _joined(self, lang: int, grid: np.ndarray, at: np.ndarray, sizes: np.ndarray, before: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """How many more phrases begin in blocks (columns `at` of the grid) if parsing goes on from the states before them and not from the start; the states at their ends, or -1 where both ways meet."""
        look, local = self.steps[lang], self.local[lang]
        more, ends = np.zeros(len(sizes), np.int64), np.full(len(sizes), -1, np.int32)
        on_at, fresh, on = np.arange(len(sizes)), np.full(len(sizes), start, np.int32), before
        for step in range(len(grid) + 1):
            ended = sizes[on_at] <= step
            apart = fresh != on
            if ended.any():
                ends[on_at[ended & apart]] = on[ended & apart]
                apart &= ~ended
            if not apart.all():
                on_at, fresh, on = on_at[apart], fresh[apart], on[apart]
            if not len(on_at):
                break
            symbol = local[grid[step, at[on_at]]]
            fresh, on = look(fresh, symbol), look(on, symbol)
            more[on_at] += (on & 1) - (fresh & 1)
            fresh, on = fresh >> 1, on >> 1
        return more, ends

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and, as score, how far its rate lies below the nearest other's (the least 1 - best / other)."""
        codes = [normalise(points(t)) if t else np.zeros(0, np.uint32) for t in texts]
        codes = [self.symbol[c] if c.any() else None for c in codes]
        have = [i for i, c in enumerate(codes) if c is not None]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not have or not self.langs:
            return langs, scores
        best, least = self.chosen(self.phrases([codes[i] for i in have]) / np.array([len(codes[i]) for i in have])[:, None])
        for i, b, x in zip(have, best, least, strict=True):
            langs[i], scores[i] = self.langs[b], float(x)
        return langs, scores

    def chosen(self, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of phrases a character (by entry) the language, and its score."""
        k, entry = len(self.langs), {e: n for n, e in enumerate(self.entries)}
        full = rate[:, :k] / self.rate
        sizes = sorted({*self.learned}, reverse=True)
        most = np.array([m == sizes[0] for m in self.learned])
        best = np.where(most, full, np.inf).argmin(1)
        rows = np.arange(len(rate))
        for size in sizes[1:]:
            at = np.array([entry.get((i, size), -1) for i in range(k)])
            some = np.array([m == size for m in self.learned])
            ratio = np.where(some, rate[:, at] / rate[rows, at[best]][:, None], np.inf)
            new = ratio.argmin(1)
            best = np.where(ratio[rows, new] < np.exp(-SURE * np.sqrt(2) * self.spread[size]), new, best)
        score = np.ones(len(rate))
        for b in np.unique(best):
            mine = np.flatnonzero(best == b)
            for j, m in enumerate(self.learned):
                if j != b:
                    size = min(m, self.learned[b])
                    x, y = (full[mine, b], full[mine, j]) if m == self.learned[b] == sizes[0] else (rate[mine, entry[b, size]], rate[mine, entry[j, size]])
                    score[mine] = np.minimum(score[mine], np.maximum(0.0, 1 - x / y))
        return best, score


def _side_by_side(blocks: list[np.ndarray]) -> np.ndarray:
    """Blocks, the longest first, as the columns of a grid."""
    grid = np.zeros((len(blocks), len(blocks[0]) if blocks else 0), np.int32)
    for row, b in enumerate(blocks):
        grid[row, : len(b)] = b
    return np.ascontiguousarray(grid.T)


def labelled_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = SAMPLE_DOCS) -> dict[str, str]:
    """About `docs` texts a language, by a hash of id and text, of the MOST_LANGS most frequent languages."""
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col), F.lit(5)), F.lit(1 << 30))
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not n:
        return {}
    bound = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1 << 30, (1 << 30) * docs // v + 1))])
    picked = rows.where(key < bound[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, DOC_CHARS).alias("text"), key.alias("key"))
    out: dict[str, list[str]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r.key, r.text)):
        out.setdefault(row.lang, []).append(row.text[:DOC_CHARS])
    return {k: "\n".join(v)[: 4 * TRAIN_CHARS] for k, v in out.items()}


@lru_cache(maxsize=4)
def parser(train: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(train), even=False)


def identify(df: DataFrame, train: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, lang_pred and score of every whole text, by the languages of train."""
    labelled = df.sparkSession.sparkContext.broadcast(tuple(sorted(train.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(labelled.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, scores = p.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc {kind}, lang_pred string, score double")
