"""Byte-level BPE encoding and decoding (op3).

A text is cut into pieces by the tokenizer's pattern, and each piece is encoded by itself. Within a
piece a sequence of tokens is the result of the merges exactly if every two neighbours stay apart
when their joined bytes are merged. So the encoder walks from left to right, takes the longest token
that starts here, and goes back to a shorter one where neighbours are not compatible. Of each prefix
there is at most one such sequence; a place that could not be continued once is dead for good, which
makes the walk linear. Longest matches come from an Aho-Corasick automaton over the bytes, read as
Latin-1; the longest token that fits a left neighbour is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import held, scan, texts

# White space as Unicode defines it, which is what \s means to the tokenizer library.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Pieces never reach over white space but for one leading blank, so texts are first cut into these chunks,
# which repeat much more often than whole texts and are worth remembering.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
KEPT_CHUNKS, KEPT_PAIRS, LONGEST_KEPT = 200_000, 400_000, 64


class ByteBPE:
    """Encoder and decoder for one table of ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(
            r"\s+(?!\S)", rf"[{SPACE}]+(?![^{SPACE}])").replace(r"\s+", rf"[{SPACE}]+"))
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks))
        self.window = 2 * self.longest + 64
        self.size_of = {i: len(token) for token, i in ranks.items()}
        self.shorter = {i: self._prefix(token) for token, i in ranks.items()}
        self.width = max(ranks.values()) + 1
        self.fits: dict[int, int | None] = {}
        self.spines: dict[tuple[int, bool], list[int]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.chunks: dict[str, tuple[str, tuple[int, ...]]] = {}

    def form(self, ids: tuple[int, ...]):
        """What is remembered of a chunk: its ids joined by blanks, and the ids."""
        return " ".join(map(str, ids)), ids

    def merges(self, data: bytes, until: int = 1) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            joined = [self.ranks.get(a + b, len(self.ranks) + 256) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            at = joined.index(best)
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, right: bool) -> list[int]:
        """The parts that stand at the right (or left) edge while the token is merged: first its byte, last itself."""
        known = self.spines.get((token, right))
        if known is None:
            data = self.bytes_of[token]
            known = [token] if len(data) == 1 else [*self.spine(self.merges(data, 2)[-1 if right else 0], right), token]
            self.spines[token, right] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge over their border comes before those on either side of it."""
        return self.fit(left, right) == right

    def fit(self, left: int, token: int) -> int | None:
        """The longest token that can follow ``left``: ``token`` or one that it begins with."""
        known = self.fits.get(left * self.width + token, -1)
        if known == -1:
            apart = self._apart(self.spine(left, True), self.spine(token, False))
            shorter = self.shorter[token]
            known = token if apart else None if shorter is None else self.fit(left, shorter)
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            self.fits[left * self.width + token] = known
        return known

    def _apart(self, left: list[int], right: list[int]) -> bool:
        never, i, j = len(self.ranks) + 256, 0, 0
        while True:
            over = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], never)
            up_left = left[i + 1] if i + 1 < len(left) else never
            up_right = right[j + 1] if j + 1 < len(right) else never
            if over < up_left and over <= up_right and over < never:
                return False
            if up_left == up_right == never:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that this one begins with."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def encode_piece(self, data: bytes) -> list[int]:
        size, line = len(data), data.decode("latin-1")
        fits, size_of, shorter, width = self.fits.get, self.size_of, self.shorter, self.width
        dead: set[int] = set()
        taken: list[int] = []
        at, left = 0, None
        while at < size:
            # The longest matches, one after the other, as long as each fits its left neighbour; no further than the window shows them whole.
            window = line[at : at + self.window]
            sure = size if at + len(window) == size else at + len(window) - self.longest
            for _, token in self.automaton.iter_long(window):
                if at > sure:
                    break
                best = token
                if left is not None:
                    best = fits(left * width + token, -1)
                    if best == -1:
                        best = self.fit(left, token)
                if best is None or dead and at + size_of[best] in dead:
                    best = self._alive(left, best, at, dead)
                    while best is None:  # nothing fits here: go back to a shorter token
                        dead.add(at)
                        last = taken.pop()
                        at -= size_of[last]
                        left = taken[-1] if taken else None
                        best = shorter[last]
                        if best is not None and left is not None:
                            best = self.fit(left, best)
                        best = self._alive(left, best, at, dead)
                    token = None
                taken.append(best)
                left = best
                at += size_of[best]
                if best != token:
                    break
        return taken

    def _alive(self, left: int | None, token: int | None, at: int, dead: set[int]) -> int | None:
        """The first of ``token`` and the shorter ones that fit ``left`` which does not end at a dead place."""
        while token is not None and at + self.size_of[token] in dead:
            token = self.shorter[token]
            if token is not None and left is not None:
                token = self.fit(left, token)
        return token

    def piece(self, text: str) -> tuple[int, ...]:
        known = self.pieces.get(text)
        if known is None:
            known = tuple(self.encode_piece(text.encode("utf-8")))
            if len(text) <= LONGEST_KEPT:
                if len(self.pieces) >= KEPT_CHUNKS:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    def chunk(self, text: str):
        """The form of one chunk that the younger half of the memory doesn't hold."""
        known = self.older.get(text)
        if known is None:
            last = len(text) - 1
            if text.isalpha() or text[0] == " " and text[1:].isalpha():
                ids = self.piece(text)
            elif last and text[last] in ".,;:!?" and (text[:last].isalpha() or text[0] == " " and text[1:last].isalpha()):
                ids = self.piece(text[:last]) + self.piece(text[last])
            else:
                ids = tuple(chain.from_iterable(map(self.piece, self.pattern.findall(text))))
            known = self.form(ids)
        if len(text) <= LONGEST_KEPT:
            if len(self.chunks) >= KEPT_CHUNKS:
                self.chunks, self.older = {}, self.chunks
            self.chunks[text] = known
        return known

    def encode_parts(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        return [self.chunks.get(c) or self.chunk(c) for c in CHUNK.findall(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.encode_parts(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PackedBPE(ByteBPE):
    """An encoder to ids only. It remembers them as packed numbers of four bytes, which take a third of the memory of ``ByteBPE``'s form."""

    def form(self, ids: tuple[int, ...]) -> bytes:
        return array("i", ids).tobytes()

    def packed(self, text: str) -> bytes:
        return b"".join(self.encode_parts(text))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


def read_ranks(lines) -> dict[bytes, int]:
    """The ranks of a vocabulary file: one base64 token and its id a line."""
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}


@held
def load(path: str, pattern: str, kind: type[ByteBPE] = ByteBPE) -> ByteBPE:
    """One encoder per worker process; the vocabulary is installed with the tokenizer package on every machine."""
    with open(path, "rb") as lines:
        return kind(read_ranks(lines), pattern)


@held
def load_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id, all that decoding needs: its workers hold no automaton and no memories of an encoder."""
    with open(path, "rb") as lines:
        return {i: token for token, i in read_ranks(lines).items()}


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of df and the token ids of ``text`` as array<int>, in a column that replaces any of that name.

    A null text is encoded as the empty text: no ids. No row is dropped.
    """
    kept = [c for c in df.columns if c != ids]
    out = df.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), f"`{ids}` array<int>"])

    def build():
        bpe = load(path, pattern, PackedBPE)

        def step(batch):
            packs = [bpe.packed(t) for t in texts(batch, text)]
            ends = np.cumsum([0, *map(len, packs)]) // 4
            coded = pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(packs), np.int32))
            yield {c: batch.column(c) for c in kept} | {ids: coded}

        return step

    return scan(out, build, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """All columns of df and the bytes of ``ids``; null ids decode to no bytes. An unknown id is an error."""
    kept = [c for c in df.columns if c != data]
    out = df.select(*kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), f"`{data}` binary"])

    def build():
        bytes_of = load_bytes(path)

        def step(batch):
            decoded = [b"".join(map(bytes_of.__getitem__, v.as_py() or ())) for v in batch.column(ids)]
            yield {c: batch.column(c) for c in kept} | {data: decoded}

        return step

    return scan(out, build, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: (key, n_tokens, ids_sha256, decoded_sha256), one row per row.

    Ids and bytes of a text live only while it is worked on, so nothing but digests leaves the task.
    Null and empty texts have no tokens and the digests of the empty string.
    """
    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def build():
        bpe = load(path, pattern)

        def step(batch):
            counts, coded, decoded = [], [], []
            for t in texts(batch, 1):
                parts = bpe.encode_parts(t)
                ids = list(chain.from_iterable([p[1] for p in parts]))
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield {key: batch.column(0), "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": decoded}

        return step

    return scan(rows, build, schema)
