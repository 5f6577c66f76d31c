"""BPE encoding and decoding: a bounded-lookahead streaming transducer and an incremental byte-to-text state machine.

Two tokens can stand next to each other in an encoding exactly if merging their bytes gives these two tokens again, and
the encoding of a byte string is its only token sequence in which every adjacent pair can. `Transducer.feed` extends
such a sequence greedily by the longest token and steps back where that fails; tokens that lie further back than the
merge list's sufficient lookahead can no longer change and are emitted, so memory does not grow with the text.
`sufficient_lookahead` computes that bound from the merge list in one pass. Texts are cut into the pre-tokenizer's
pieces first, slice by slice at places where no piece can cross; where a text has none for long, its pieces are encoded
one by one, and a long piece chunk by chunk. So beside the text itself (and the ids, where they are asked for) memory is
that of a slice.

Defined results: null counts as empty, an empty text has no tokens and decodes to an empty text. A special token's
string in a text becomes that token, as the tokenizers library does by default. Texts of any length are encoded whole;
rows with equal ids are handled each for itself; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_of

# The byte-level pre-tokenizer's pattern, as the tokenizer files' public description gives it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters alone, where the classes of `re` agree with it; several times faster.
LATIN_PIECES = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
#: Characters of a text handled at a time, bytes of the longest piece that the cache keeps, and entries it holds.
SLICE, CACHED_BYTES, CACHE = 1 << 16, 48, 120_000


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encodes byte strings by a merge list. spec: the text of a byte-level tokenizer file; cache: pieces that it keeps."""

    def __init__(self, spec: str, cache: int = CACHE):
        spec = json.loads(spec)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(vocab[raw(a)], vocab[raw(b)], vocab[raw(a) + raw(b)]) for a, b in merges]
        n = max(vocab.values()) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for t, i in vocab.items():
            self.bytes_of[i] = t
        #: When a token is made (its merge's place; -1: a byte), of what, and each pair's place.
        self.born, self.parts, self.rank = [-1] * n, [(-1, -1)] * n, {}
        for place, (a, b, t) in enumerate(merges):
            if self.parts[t] != (-1, -1):
                raise ValueError("two merges make one token; its encoding is not defined by pairs alone")
            self.born[t], self.parts[t], self.rank[a, b] = place, (a, b), place
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        for content, i in self.special.items():
            if i >= len(self.bytes_of):
                self.bytes_of += [b""] * (i + 1 - len(self.bytes_of))
            self.bytes_of[i] = content.encode()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ok: dict[tuple[int, int], bool] = {}
        #: Tokens that their own bytes encode to: bytes, and what two such tokens make that stay apart until their merge.
        whole = {i for t, i in vocab.items() if len(t) == 1}
        for a, b, t in merges:
            if a in whole and b in whole and self._meets(a, b, self.born[t], self.born[t]):
                whole.add(t)
        self.token = {t: i for t, i in vocab.items() if i in whole}
        self.longest = max(map(len, self.token))
        #: The lengths of tokens that begin with these bytes (three, or all), longest first.
        lengths: dict[bytes, set[int]] = {}
        for t in self.token:
            lengths.setdefault(t[:3], set()).add(len(t))
        self.lengths = {k: sorted(v | {n for n in (1, 2) if k[:n] in self.token and n < len(k)}, reverse=True) for k, v in lengths.items()}
        self.lookahead = sufficient_lookahead(merges, self.bytes_of) + self.longest
        self.pieces = regex.compile(PIECES)
        self.cache = _Cache(self, cache)

    def _meets(self, a: int, b: int, left_until: int = 1 << 60, right_until: int = 1 << 60) -> bool:
        """Do a and b stay apart: does no merge across their border come before both have become what they are?

        Goes back in time: whichever of the two border tokens was made last is taken apart. A pair merges if its place
        comes before the merge that takes its left token away, and not after the one that takes its right token.
        """
        rank, born, parts = self.rank, self.born, self.parts
        while True:
            at = rank.get((a, b))
            if at is not None and at < left_until and at <= right_until and not (at == left_until == right_until):
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[a] > born[b]:
                left_until, a = born[a], parts[a][1]
            else:
                right_until, b = born[b], parts[b][0]

    def pair(self, a: int, b: int) -> bool:
        found = self.ok.get((a, b))
        if found is None:
            if len(self.ok) > 200_000:
                self.ok.clear()
            found = self.ok[a, b] = self._meets(a, b)
        return found

    def feed(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that comes in chunks; an id goes out once `lookahead` bytes after it are known."""
        token, pair, longest = self.token, self.pair, self.longest
        held, base, taken, last = b"", 0, [], -1  # bytes from base on; (end, id) of tokens that may still change
        for chunk in [*chunks] if isinstance(chunks, (list, tuple)) else chunks:
            held += chunk
            if len(held) > 4 * self.lookahead + 4 * longest:
                taken = self._scan(held, taken, last, len(held) - longest)
                safe = len(held) - longest - self.lookahead
                done = 0
                while done < len(taken) and taken[done][0] <= safe:
                    yield taken[done][1]
                    last, done = taken[done][1], done + 1
                if done:
                    gone = taken[done - 1][0]
                    held, base = held[gone:], base + gone
                    taken = [(e - gone, t) for e, t in taken[done:]]
        taken = self._scan(held, taken, last, len(held))
        for _, t in taken:
            yield t

    def _scan(self, held: bytes, taken: list[tuple[int, int]], last: int, until: int) -> list[tuple[int, int]]:
        """Extends taken up to `until` or beyond by the longest token that fits, stepping back from dead ends."""
        token, ok, meets, longest, n = self.token, self.ok, self.pair, self.longest, len(held)
        dead: set[tuple[int, int]] = set()  # (place, last id) that cannot be continued
        at = taken[-1][0] if taken else 0
        prev = taken[-1][1] if taken else last
        size = min(longest, n - at)
        while at < until:
            while size:
                t = token.get(held[at : at + size])
                if t is not None and (prev < 0 or ((prev, t) in ok and ok[prev, t] or meets(prev, t))) and (at + size, t) not in dead:
                    break
                size -= 1
            if size:
                at, prev = at + size, t
                taken.append((at, t))
                size = min(longest, n - at)
            else:
                dead.add((at, prev))
                if not taken:
                    raise ValueError("no encoding")
                end, t = taken.pop()
                at = taken[-1][0] if taken else 0
                prev = taken[-1][1] if taken else last
                size = end - at - 1
        return taken

    def _short(self, piece: bytes) -> list[int]:
        """_scan for a whole short piece: tries only the lengths that tokens with these first bytes have."""
        token, lengths, ok, bytes_of, at, n, prev, out, i = self.token, self.lengths, self.ok, self.bytes_of, 0, len(piece), -1, [], 0
        dead: set[tuple[int, int]] = set()
        while at < n:
            sizes = lengths.get(piece[at : at + 3]) or (2, 1)
            for size in sizes[i:] if i else sizes:
                t = token.get(piece[at : at + size]) if at + size <= n else None
                if t is not None:
                    if prev >= 0:
                        fits = ok.get((prev, t))
                        if not (fits or fits is None and self.pair(prev, t)):
                            continue
                    if not dead or (at + size, t) not in dead:
                        break
            else:
                dead.add((at, prev))
                size = len(bytes_of[out.pop()])
                at -= size
                prev = out[-1] if out else -1
                i = (lengths.get(piece[at : at + 3]) or (2, 1)).index(size) + 1
                continue
            out.append(t)
            prev, at, i = t, at + size, 0
        return out

    def ids(self, piece: bytes) -> bytes:
        """One piece's ids as little-endian unsigned 32-bit integers."""
        whole = self.token.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(piece) <= self.lookahead:
            ids = self._short(piece)
            return struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 4 * self.lookahead:
            return np.array([t for _, t in self._scan(piece, [], -1, len(piece))], "<u4").tobytes()
        return np.fromiter(self.feed(piece[i : i + SLICE] for i in range(0, len(piece), SLICE)), "<u4").tobytes()

    def slices(self, text: str, size: int = SLICE) -> Iterator[str]:
        """Cuts a text where no piece crosses: before white space that follows something else."""
        at = 0
        while len(text) - at > size:
            end = at + size
            while end < len(text) and (text[end] not in " \n\t\r" or text[end - 1].isspace()):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, slice by slice, as little-endian unsigned 32-bit integers."""
        at = 0
        for found in self.split.finditer(text) if self.split and any(s in text for s in self.special) else ():
            yield from self._plain(text[at : found.start()])
            yield self.special[found[0]].to_bytes(4, "little")
            at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        get, find = self.cache.__getitem__, (self.pieces if NOT_LATIN.search(text) else LATIN_PIECES).findall
        for part in self.slices(text):
            if len(part) <= 2 * SLICE:
                yield b"".join(map(get, find(part)))
            else:
                yield from self._uncut(part)
            self.cache.bound()

    def _uncut(self, part: str) -> Iterator[bytes]:
        """The ids of a long stretch without a place to cut: piece by piece, and a long piece chunk by chunk."""
        for found in (self.pieces if NOT_LATIN.search(part) else LATIN_PIECES).finditer(part):
            start, end = found.span()
            if end - start <= SLICE:
                yield self.cache[part[start:end]]
                self.cache.bound()
            else:
                ids = self.feed(part[i : min(i + SLICE, end)].encode() for i in range(start, end, SLICE))
                while chunk := [*islice(ids, SLICE)]:
                    yield struct.pack(f"<{len(chunk)}I", *chunk)

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Text from chunks of ids: the state between chunks is the unfinished character's bytes (three at most)."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for chunk in ids:
            yield state.decode(b"".join(map(get, np.frombuffer(chunk, "<u4").tolist())))
        yield state.decode(b"", True)


class _Cache(dict):
    """The transducer's output by piece; pieces over CACHED_BYTES are not kept. Two generations of size / 2 entries: what was asked for lately stays."""

    def __init__(self, transducer: Transducer, size: int):
        super().__init__()
        self.transducer, self.size, self.old = transducer, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.ids(piece.encode())
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids

    def bound(self) -> None:
        if len(self) > self.size // 2:
            self.old = dict(self)
            self.clear()


def sufficient_lookahead(merges: list[tuple[int, int, int]], bytes_of: list[bytes]) -> int:
    """How many bytes before its end a byte string's encoding can change when more bytes follow, at most.

    What follows changes the encoding from some border on. The border moves left only by a merge, in one of the two
    contexts, that takes the token before it together with the first token after it; that later merge comes further down
    the list than the merge that made the contexts differ there. reach[t]: how far the border can have come while t is
    the first token after it in one context, after all merges so far; one pass over the list carries it on.
    """
    reach = [len(t) for t in bytes_of]
    for a, b, t in merges:
        moved = reach[b] + len(bytes_of[a])
        reach[t] = max(reach[t], reach[a], moved)
        reach[a] = max(reach[a], moved)
    return max(reach, default=0)


@lru_cache(maxsize=4)
def transducer(spec: str, cache: int = CACHE) -> Transducer:
    return Transducer(spec, cache)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc, n_tokens, ids (little-endian unsigned 32-bit) and, if texts, the decoded text; tokenizer: path of the file."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(spec.value)
        for batch in batches:
            ids = [b"".join(t.encode(x)) for x in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(["".join(t.decode([x])) for x in ids], pa.string())][: 3 + texts], ["doc", "n_tokens", "ids", "decoded"][: 3 + texts])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_tokens long, ids binary" + ", decoded string" * texts)


def digest_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_tokens and the SHA-256 of ids and of the decoded text, both fed slice by slice: memory does not grow with a text."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(spec.value, 2 * CACHE)  # nothing but digests is held beside it
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                n, ids, back = 0, hashlib.sha256(), hashlib.sha256()

                def through(chunks, ids=ids):
                    nonlocal n
                    for chunk in chunks:
                        n += len(chunk) // 4
                        ids.update(chunk)
                        yield chunk

                for part in t.decode(through(t.encode(text.as_py()))):
                    back.update(part.encode())
                counts.append(n)
                ids_sha.append(ids.hexdigest())
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_rows(df: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns `keep` with n_tokens, ids and decoded_sha256 of every row's whole text."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, shas = [], []
                for text in part.column(len(keep)).to_pylist():
                    ids.append(b"".join(t.encode(text)))
                    sha = hashlib.sha256()
                    for piece in t.decode([ids[-1]]):
                        sha.update(piece.encode())
                    shas.append(sha.hexdigest())
                more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *more], [*keep, "n_tokens", "ids", "decoded_sha256"])
        give_back()

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text_of(text_col).alias("_text")).mapInArrow(run, f"{kept}, n_tokens long, ids binary, decoded_sha256 string")
