"""SentencePiece encoding and decoding of merge-type (BPE) models: exact encoding by backtracking.

A model merges, again and again, the neighbours whose joined text has the highest score (of equal ones the leftmost). No
such merge crosses the border of two tokens of the result, so each two neighbours merge to themselves again; and a
sequence in which every two neighbours do is the result, for the first merge across a border would show up between the
two tokens beside it. So encoding takes at each place the longest piece that starts there (Aho-Corasick over the reversed
text finds these for all places), asks whether merging the last token's text and its text again gives these two (`fits`),
falls back to the next shorter piece that is its prefix, and where none fits marks the place as failed in a bitfield (of
a block: a byte each) and takes the last token back. A failed place stays failed whatever comes before it, as a text's
beginning has only one encoding. Time is in proportion to the text but for the steps taken back.

A text is cut wherever no piece has the two characters beside the cut side by side, so no merge crosses it. The chunks of
some hundred thousand characters, of many texts, are encoded at a time, each step for all of them at once in numpy
(`Model.encode_block`); no chunk is looked up by its text, so unlike words cost what like ones do. A chunk over LONG is
encoded alone (`Model.encode_chunk`), with memory of five bytes a character beside the text. Beside that a model keeps a
table of the automaton's steps (57 MB for the public model) and a byte for each two letters of pieces. Pieces come from the model
file (read as plain protocol buffer fields); unknown characters become their UTF-8 bytes. Decoding turns runs of byte
tokens into text (a byte that fits nowhere becomes U+FFFD), drops the leading space that encoding adds, and keeps at most
three bytes between chunks.

Defined results: null counts as empty; an empty text has the end id alone (or none, if not asked for) and decodes to an
empty text. Texts of any length are encoded whole; repeated rows and ids are handled each for itself; an empty table
gives an empty table; extra columns are ignored. Models of another type, with character maps, user-defined or unused
pieces raise an error, as their encodings follow other rules.
"""

from __future__ import annotations

import hashlib
import math
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_of

# The space mark, field numbers and piece types of the public model format.
MARK = "▁"
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, BPE, SUFFIX_MARK, END_ID = 3, 2, 24, 42
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
UNKNOWN_TEXT = " \u2047 "

#: Characters of a text's slice (more where it has no place to cut) and of a block of slices; a longer chunk is encoded alone.
SLICE, BLOCK, LONG = 1 << 16, 1 << 18, 200
#: Pairs of tokens whose fit is remembered (more than a block can have), and the bits of a place in their table.
PAIRS, PLACES = 1_000_000, 21
#: Characters that a lane of the automaton reads, and the most entries of its table of steps (more: the library's own walk).
LANE, STEPS = 128, 1 << 26
#: Code points in all. A character that is no piece is a token too until its bytes come out: behind all ids, by code point.
POINTS, NONE = 0x110000, (1 << 21) - 1
#: An odd number that spreads pairs over their table.
SPREAD = 0x9E3779B97F4A7C15


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Model:
    """A merge-type model from the bytes of its file."""

    def __init__(self, data: bytes):
        own = [(n, v) for n, v in fields(data)]
        trainer, normalizer = (dict(fields(next((v for n, v in own if n == k), b""))) for k in (TRAINER, NORMALIZER))
        if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(SUFFIX_MARK) or normalizer.get(CHARACTER_MAP) or normalizer.get(REMOVE_EXTRA, 1) or not normalizer.get(ESCAPE, 1):
            raise ValueError("not a merge-type model of plain text with leading space marks")
        self.prefix = MARK if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.end = trainer.get(END_ID, 2)
        self.texts, self.score, self.byte, kinds, own_id = [], {}, {}, [], {}
        for i, piece in enumerate(dict(fields(v)) for n, v in own if n == PIECES):
            text, kind = piece[TEXT].decode(), piece.get(TYPE, NORMAL)
            if kind == NORMAL:
                own_id[text], self.score[text] = i, struct.unpack("<f", piece.get(SCORE, b"\0" * 4))[0]
            elif kind == BYTE:
                self.byte[int(text[3:5], 16)] = i
            elif kind not in (UNKNOWN, CONTROL):
                raise ValueError("user-defined or unused pieces")
            kinds.append(kind)
            self.texts.append({NORMAL: text.replace(MARK, " "), UNKNOWN: UNKNOWN_TEXT}.get(kind, ""))
        if len(self.byte) < 256:
            raise ValueError("no byte pieces for unknown characters")
        for byte in range(128):  # a byte that is a character of its own
            self.texts[self.byte[byte]] = chr(byte)
        self.kinds, self.decimal = kinds, [*map(str, range(len(kinds)))]
        #: Of each id the byte of a longer character that it stands for, or -1.
        self.byte_of = np.full(len(kinds), -1)
        self.byte_of[[i for b, i in self.byte.items() if b > 127]] = [b for b in self.byte if b > 127]
        #: Pieces that their own text encodes to; others never come out.
        self.id_of = {t: i for t, i in own_id.items() if self.merging(t)[0] == [t]}
        self.steps: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.piece = {i: t for t, i in self.id_of.items()}
        #: Of each piece the longest piece (or single character) that it begins with.
        self.shorter = {i: self._symbol(next(t[:n] for n in range(len(t) - 1, 0, -1) if n == 1 or t[:n] in self.id_of)) for t, i in self.id_of.items() if len(t) > 1}
        self.size = {i: len(t) for t, i in self.id_of.items()}
        self.found = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.found.add_word(t[::-1], (i, len(t)))
        self.found.make_automaton()
        self.ok: dict[tuple[int, int], bool] = {}
        self._tables([t for t in own_id if len(t) > 1])
        self._automaton({t[::-1]: i for t, i in self.id_of.items() if len(t) > 1})

    def _tables(self, long: list[str]) -> None:
        """What encode_block and spelled look up, as arrays by code point, letter or token."""
        n, letters = len(self.kinds), sorted({c for t in long for c in t})
        #: A letter's number (0: no piece has it beside another), and the token that a character is alone. A space counts as a mark.
        self.letter, self.alone = np.zeros(POINTS, np.uint16), np.arange(n, n + POINTS, dtype=np.int32)
        self.number = {c: k + 1 for k, c in enumerate(letters)}
        for t, i in self.id_of.items():
            if len(t) == 1:
                self.alone[ord(t)] = i
        for c, k in self.number.items():
            self.letter[ord(c)] = k
        self.letter[32], self.alone[32] = self.letter[ord(MARK)], self.alone[ord(MARK)]
        self.between = chr(int(np.flatnonzero(self.letter == 0)[0]))
        #: Which letters some piece has side by side; no merge crosses a cut between any others.
        self.beside = np.zeros((len(letters) + 1,) * 2, bool)
        for c, d in {p for t in long for p in zip(t, t[1:], strict=False)}:
            self.beside[self.number[c], self.number[d]] = True
        #: A token's characters, and the token to try after it (or -1).
        self.sizes, self.after = np.ones(n + POINTS, np.int32), np.full(n + POINTS, -1, np.int32)
        for i, k in self.size.items():
            self.sizes[i] = k
        for i, j in self.shorter.items():
            self.after[i] = j if j >= 0 else n - 1 - j
        #: Pairs of tokens by a hash of both, each with its fit in the last bit, and their number.
        self.pairs, self.known = np.full(1 << PLACES, -1), 0
        byte = {i: bytes([b]) for b, i in self.byte.items()}
        spelled, decimal = [byte.get(i) or t.encode() for i, t in enumerate(self.texts)], [f" {i}".encode() for i in range(n)]
        #: Each token's bytes and its decimal id after a space: (all, where each starts, its size).
        self.spelling, self.digits = ((np.frombuffer(b"".join(x), np.uint8), np.cumsum(k) - k, k) for x in (spelled, decimal) for k in [np.array([*map(len, x)])])

    def _automaton(self, words: dict[str, int]) -> None:
        """Aho-Corasick over words as one table: steps[state, letter] is the next state, best[state] the id of the longest word that ends there."""
        self.reach, below, best = max(map(len, words), default=1), [{}], [-1]
        for word, i in words.items():
            state = 0
            for c in word:
                k = self.number[c]
                if k not in below[state]:
                    below[state][k] = len(below)
                    below.append({})
                    best.append(-1)
                state = below[state][k]
            best[state] = i
        self.steps_of = None
        if len(below) * len(self.beside) > STEPS:
            return
        steps, fail, level = np.zeros((len(below), len(self.beside)), np.int32), [0] * len(below), [0]
        while level:
            for state in level:
                if state:
                    steps[state] = steps[fail[state]]
                    if best[state] < 0:
                        best[state] = best[fail[state]]
                for k, child in below[state].items():
                    fail[child] = int(steps[state, k])  # where the text without its first letter leads
                    steps[state, k] = child
            level = [child for state in level for child in below[state].values()]
        self.steps_of, self.best = steps.ravel(), np.array(best, np.int32)

    def _symbol(self, text: str) -> int:
        """A piece's id; a single character that is no piece is its code point, negated and less one."""
        i = self.id_of.get(text)
        return -ord(text) - 1 if i is None else i

    def merging(self, text: str) -> tuple[list[str], tuple[list[float], list[str], list[str]]]:
        """What the model's merges make of a short text, with the score of each step (and -inf) and the first and last part before it."""
        parts, score, scores, firsts, lasts = [*text], self.score, [], [], []
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1], -math.inf)
                if s > best:
                    best, at = s, i
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
            if at < 0:
                return parts, (scores, firsts, lasts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Can tokens a and b be neighbours: does merging their text again give these two?

        Until a merge takes a part of each, both are merged as each alone, so their own steps are followed side by side,
        the higher score first (of equal ones the left), and the two parts at the border are looked up before each step.
        """
        score, (left, _, lasts), (right, firsts, _) = self.score, self._steps(a), self._steps(b)
        i = j = 0
        fit = None
        while fit is None:
            across = score.get(lasts[i] + firsts[j])
            if across is not None and across > left[i] and across >= right[j]:
                fit = False
            elif left[i] >= right[j]:
                fit = True if left[i] == -math.inf else None
                i += 1
            else:
                j += 1
        return fit

    def _steps(self, token: int) -> tuple[list[float], list[str], list[str]]:
        if token < 0:
            return [-math.inf], [chr(-token - 1)], [chr(-token - 1)]
        found = self.steps.get(token)
        if found is None:
            found = self.steps[token] = self.merging(self.piece[token])[1]
        return found

    def encode_chunk(self, text: str) -> bytes:
        """The ids of a stretch that no piece crosses, as little-endian unsigned 32-bit integers."""
        text = text.replace(" ", MARK)
        n, size = len(text), self.size
        first = array("i", [-1]) * n  # the longest piece at each place
        length = bytearray(n)
        for last, (i, k) in self.found.iter(text[::-1]):
            if k > length[n - 1 - last]:
                first[n - 1 - last], length[n - 1 - last] = i, k
        failed = bytearray(n // 8 + 1)
        ok, shorter, out, at, prev = self.ok, self.shorter, array("i"), 0, None
        token = first[0] if length[0] else -ord(text[0]) - 1
        while at < n:
            while token is not None:
                end = at + size.get(token, 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fit = prev is None or ok.get((prev, token))
                    if fit is None:
                        if len(ok) > PAIRS // 4:
                            ok.clear()
                        fit = ok[prev, token] = self.fits(prev, token)
                    if fit:
                        break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at, prev = end, token
                if at < n:
                    token = first[at] if length[at] else -ord(text[at]) - 1
            else:  # nothing fits here, so nothing may end here: the last token goes, and its place tries shorter ones
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= size.get(token, 1)
                prev = out[-1] if out else None
        if min(out) >= 0:
            return out.tobytes()
        return b"".join(t.to_bytes(4, "little") if t >= 0 else b"".join(self.byte[b].to_bytes(4, "little") for b in chr(-t - 1).encode()) for t in out)

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits, pair by pair; any token fits after NONE."""
        keys, mask = a.astype(np.int64) << 21 | b, (1 << PLACES) - 1
        home = (keys.view(np.uint64) * np.uint64(SPREAD) >> np.uint64(64 - PLACES)).view(np.int64)
        while True:
            place, have = home.copy(), self.pairs[home]
            odd = np.flatnonzero(have >> 1 != keys)
            while len(odd := odd[have[odd] >= 0]):  # another pair is there: on to the next place, up to an empty one
                place[odd] = place[odd] + 1 & mask
                have[odd] = self.pairs[place[odd]]
                odd = odd[have[odd] >> 1 != keys[odd]]
            new = have < 0
            if not new.any():
                return (have & 1).astype(bool)
            self._learn(np.unique(keys[new]).tolist())

    def _learn(self, keys: list[int]) -> None:
        pairs, n, mask = self.pairs, len(self.kinds), (1 << PLACES) - 1
        if self.known + len(keys) > PAIRS:
            pairs[:], self.known = -1, 0
        for key in keys:
            a, b = (t if t < n else n - 1 - t for t in (key >> 21, key & NONE))
            to = (key * SPREAD & (1 << 64) - 1) >> 64 - PLACES
            while pairs[to] >= 0:
                to = to + 1 & mask
            pairs[to] = key << 1 | (key >> 21 == NONE or self.fits(a, b))
        self.known += len(keys)

    def longest(self, letters: np.ndarray, text: str) -> np.ndarray:
        """At each place of a text the id of the longest piece over one character that starts there, or -1."""
        n, wide = len(letters), len(self.beside)
        if self.steps_of is None:
            first, length = np.full(n, -1, np.int32), bytearray(n)
            for at, (i, k) in self.found.iter(text.replace(" ", MARK)[::-1]):
                if k > max(length[n - 1 - at], 1):
                    first[n - 1 - at], length[n - 1 - at] = i, k
            return first
        lane = max(min(LANE, n), self.reach)
        read = np.zeros(-(-n // lane) * lane, np.uint16)
        read[:n] = letters[::-1]
        read = np.ascontiguousarray(read.reshape(-1, lane).T)  # a row for each step: all lanes' letters there
        states, state = np.empty(read.shape, np.int32), np.zeros(read.shape[1], np.int32)
        for row in read[lane - self.reach + 1 :] if self.reach > 1 else ():  # each lane begins with the end of the one before
            state[1:] = self.steps_of.take(state[1:] * wide + row[:-1])
        for k, row in enumerate(read):
            state = self.steps_of.take(state * wide + row, out=states[k], mode="clip")
        return self.best[states.T.ravel()[:n]][::-1]

    def encode_block(self, parts: list[str], last: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after the other, and where each part's begin (and the last one's end); last: the id to put behind each part, or -1.

        This is encode_chunk for all chunks at once: every round tries one token in each chunk that is not done.
        """
        text, ends = self.between.join([*parts, ""]), np.cumsum([len(p) + 1 for p in parts])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = self.letter[points]
        first = self.longest(letters, text)
        first = np.where(first < 0, self.alone[points], first)
        begins = np.append(True, ~self.beside[letters[:-1], letters[1:]])
        at = np.flatnonzero(begins)
        end = np.append(at[1:], len(points))
        out, came, failed = np.full(len(points), -1, np.int32), np.zeros(len(points) + 1, np.int32), np.zeros(len(points) + 1, bool)
        long = np.flatnonzero(end - at > LONG)
        alone = [np.frombuffer(self.encode_chunk(text[at[k] : end[k]]), "<u4") for k in long]
        out[at[long]] = len(self.kinds) + POINTS + np.arange(len(long))
        at, end = np.delete(at, long), np.delete(end, long)
        token, prev, fit = first[at], np.full(len(at), NONE, np.int32), np.ones(len(at), bool)
        while len(at):
            to = at + self.sizes[token]
            fit &= ~failed[to]
            good, bad = np.flatnonzero(fit), np.flatnonzero(~fit)
            there, taken = to[good], token[good]
            out[at[good]], came[there] = taken, at[good]
            token[bad] = shorter = self.after[token[bad]]
            back = bad[shorter < 0]
            if len(back):  # nothing fits here, so nothing may end here: the last token goes, and its place tries shorter ones
                failed[at[back]] = True
                at[back] = before = came[at[back]]
                token[back], out[before] = out[before], -1
                prev[back] = np.where(begins[before], NONE, out[came[before]])
            at[good], prev[good], token[good] = there, taken, first[np.minimum(there, len(first) - 1)]
            more = at < end
            at, end, token, prev = at[more], end[more], token[more], prev[more]
            fit = self.fitting(prev, token)
        out[ends - 1] = last
        taken = np.flatnonzero(out >= 0)
        return self._ids(out[taken], np.append(0, np.searchsorted(taken, ends)), alone)

    def _ids(self, tokens: np.ndarray, bounds: np.ndarray, alone: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and their bounds with the bytes of characters that are no pieces, and the ids of chunks encoded alone, in their places."""
        n = len(self.kinds)
        odd = np.flatnonzero(tokens >= n)
        if not len(odd):
            return tokens, bounds
        kinds, which = np.unique(tokens[odd], return_inverse=True)
        ids = [alone[t - n - POINTS] if t >= n + POINTS else [self.byte[b] for b in chr(t - n).encode()] for t in kinds.tolist()]
        size = np.array([*map(len, ids)])
        sizes, starts = np.ones(len(tokens), np.int64), np.arange(len(tokens))
        sizes[odd], starts[odd] = size[which], len(tokens) + (np.cumsum(size) - size)[which]
        return gathered(np.concatenate([tokens, *ids]).astype(np.int32), starts, sizes), np.append(0, np.cumsum(sizes))[bounds]

    def cuts(self, text: str) -> np.ndarray:
        """The places in a text that no piece crosses."""
        letters = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        return np.flatnonzero(~self.beside[letters[:-1], letters[1:]]) + 1

    def slices(self, text: str) -> Iterator[tuple[str, bool]]:
        """Cuts a text where no piece crosses, into slices of SLICE at most (more only where there is no such place); with each, whether it is the last."""
        at, n = 0, len(text)
        while True:
            end = min(at + SLICE, n)
            found = self.cuts(text[at : end + 1]) if end < n else ()
            if len(found):
                end = at + int(found[-1])
            while end < n and not len(found):
                found = self.cuts(text[end : end + SLICE + 1])
                end = end + int(found[0]) if len(found) else min(end + SLICE, n)
            yield text[at:end], end == n
            if end == n:
                return
            at = end

    def blocks(self, texts: Iterable[str], end: bool = False) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """The ids of whole texts, block by block: the number of each part's text, the ids of all parts, and where each part's begin (and the last one's end)."""
        rows, parts, last, held = [], [], [], 0
        for row, text in enumerate(texts):
            prefix = self.prefix if text else ""
            for part, done in self.slices(text):
                behind = self.end if end and done else -1
                if len(part) > SLICE:
                    if parts:
                        yield rows, *self.encode_block(parts, last)
                        rows, parts, last, held = [], [], [], 0
                    ids = np.frombuffer(self.encode_chunk(prefix + part) + (behind.to_bytes(4, "little") if behind >= 0 else b""), "<u4")
                    while len(ids):
                        k = min(BLOCK, len(ids))
                        while k < len(ids) and self.byte_of[ids[k]] >= 0:  # not within a character
                            k += 1
                        yield [row], ids[:k], np.array([0, k])
                        ids = ids[k:]
                else:
                    rows.append(row)
                    parts.append(prefix + part)
                    last.append(behind)
                    held += len(part) + 2
                    if held >= BLOCK:
                        yield rows, *self.encode_block(parts, last)
                        rows, parts, last, held = [], [], [], 0
                prefix = ""
        if parts:
            yield rows, *self.encode_block(parts, last)

    def encode(self, text: str, end: bool = False) -> Iterator[bytes]:
        """The ids of a whole text, block by block, as little-endian unsigned 32-bit integers."""
        for _, ids, _ in self.blocks([text], end):
            yield ids.astype("<u4").tobytes()

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decimal ids of all parts, a space before each, as bytes, and where each part's begin (and the last one's end)."""
        return self._spread(self.digits, ids, bounds)

    def spelled(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the ids of each part stand for, in UTF-8 (with the first leading space), and where each part's begins (and the last one's ends).

        Pieces are whole characters, so a part's byte tokens make characters exactly if the part is valid; else `decode` says what comes out.
        """
        out, at = self._spread(self.spelling, ids, bounds)
        try:
            out.tobytes().decode()
            empty = np.flatnonzero(self.spelling[2][ids] == 0)  # a token without text parts the bytes beside it
            whole = not (self.byte_of[ids] >= 0).any() or np.isin(empty, bounds[1:] - 1).all() and (out[at[:-1][at[:-1] < at[1:]]] & 192 != 128).all()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return out, at
        texts = ["".join(self.decode([ids[a:b].astype("<u4").tobytes()], True)).encode() for a, b in zip(bounds, bounds[1:], strict=False)]
        return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([*map(len, texts)]))

    def _spread(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, starts, sizes = table
        sizes = sizes[ids]
        return gathered(values, starts[ids], sizes), np.append(0, np.cumsum(sizes))[bounds]

    def decode(self, ids: Iterable[bytes], begun: bool = False) -> Iterator[str]:
        """Text from chunks of ids; the state between them is at most three bytes, and whether any text has begun (then no space is dropped)."""
        get, held, begun = self.texts.__getitem__, b"", begun or not self.prefix
        for chunk in ids:
            tokens = np.frombuffer(chunk, "<u4")
            parts = [*map(get, tokens.tolist())]
            if held or (self.byte_of[tokens] >= 0).any():
                for k, byte in enumerate(self.byte_of[tokens].tolist()):
                    if byte < 0:
                        parts[k], held = _characters(held) + parts[k], b""
                    else:
                        held += bytes([byte])
                        if len(held) == 4:
                            parts[k], held = _character(held)
            if not begun:
                k = next((k for k, t in enumerate(tokens.tolist()) if self.kinds[t] != CONTROL), None)
                if k is not None:
                    begun = True
                    if self.kinds[tokens[k]] == NORMAL:
                        parts[k] = parts[k].removeprefix(" ")
            yield "".join(parts)
        yield _characters(held)


def _character(held: bytes) -> tuple[str, bytes]:
    """The first character of some bytes, or U+FFFD for the first byte, and the bytes that stay."""
    for n in range(1, min(len(held), 4) + 1):
        try:
            return held[:n].decode(), held[n:]
        except UnicodeDecodeError:
            continue
    return "\ufffd", held[1:]


def _characters(held: bytes) -> str:
    """All characters of bytes that no other byte follows."""
    out = ""
    while held:
        text, held = _character(held)
        out += text
    return out


@lru_cache(maxsize=2)
def model(data: bytes) -> Model:
    return Model(data)


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: bool = False, texts: bool = False) -> DataFrame:
    """doc, n_tokens, ids (little-endian unsigned 32-bit; with the end id, if asked for) and, if texts, the decoded text; tokenizer: path of the model file."""
    data = df.sparkSession.sparkContext.broadcast(_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data.value)
        names = ["doc", "n_tokens", "ids", "decoded"][: 3 + texts]
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            for rows, own, bounds in m.blocks((x.as_py() for x in batch.column(1)), end):
                for row, a, b in zip(rows, bounds.tolist(), bounds[1:].tolist(), strict=False):
                    found[row].append(own[a:b].astype("<u4").tobytes())
            ids = [*map(b"".join, found)]
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if texts:
                cols.append(pa.array(["".join(m.decode([x])) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_tokens long, ids binary" + ", decoded string" * texts)


def digest_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: bool = False) -> DataFrame:
    """doc, n_tokens and the SHA-256 of the decimal ids (joined by a space) and of the decoded text, both fed slice by slice."""
    data = df.sparkSession.sparkContext.broadcast(_file(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data.value)
        for batch in batches:
            counts, ids_sha, text_sha = [0] * batch.num_rows, [hashlib.sha256() for _ in range(batch.num_rows)], [hashlib.sha256() for _ in range(batch.num_rows)]
            for rows, ids, bounds in m.blocks((x.as_py() for x in batch.column(1)), end):
                (numbers, n_at), (back, t_at) = m.written(ids, bounds), m.spelled(ids, bounds)
                numbers, back, n_at, t_at, at = memoryview(numbers), memoryview(back), n_at.tolist(), t_at.tolist(), bounds.tolist()
                for k, row in enumerate(rows):
                    if at[k] == at[k + 1]:
                        continue
                    begun = counts[row] > 0
                    space = not begun and m.prefix and m.kinds[ids[at[k]]] == NORMAL and back[t_at[k] : t_at[k] + 1] == b" "
                    ids_sha[row].update(numbers[n_at[k] + (not begun) : n_at[k + 1]])
                    text_sha[row].update(back[t_at[k] + bool(space) : t_at[k + 1]])
                    counts[row] += at[k + 1] - at[k]
            shas = [pa.array([x.hexdigest() for x in own], pa.string()) for own in (ids_sha, text_sha)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *shas], ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
