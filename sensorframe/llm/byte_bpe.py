"""Operator 1: byte-level BPE by longest matches, and its inverse.

A text is cut by the tokenizer's pattern; each piece is encoded on its own. Bytes are read as Latin-1 so that a string automaton
finds all vocabulary entries in them. A sequence of entries is what the merges would give exactly when every two neighbours are
what the merges would give for their joint bytes; so the piece is walked from the left with the longest match that fits its
left neighbour, and a position from which no match goes on is never tried again. Every position is entered at most once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame

from sensorframe.llm.common import arrow_rows

# Words and neighbour pairs remembered by a worker.
REMEMBERED = 500_000
# A space beside other white space: such texts are cut by the pattern alone.
_BESIDE_SPACE = re.compile(r" \s|\s |^\s|\s$")
_CODECS: dict[tuple[str, str], "Codec"] = {}


class _Words(dict):
    """Values by string, worked out when first asked for. Of two generations the older goes when the younger is full."""

    def __init__(self, make):
        self.make = make
        self.older = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes}
        self.width = max(self.bytes) + 1
        self.longest = max(map(len, ranks))
        # The merge that made each entry: its rank (-1: a byte) and its two sides. Entries that merging never makes are left out.
        self.made = {}
        self.sides = {}
        for token, rank in ranks.items():
            parts, last = self._merge(token)
            if parts == [rank]:
                self.made[rank], self.sides[rank] = (rank, last) if last else (-1, (rank, rank))
        self.automaton = ahocorasick.Automaton()
        for rank in self.made:
            self.automaton.add_word(self.bytes[rank].decode("latin-1"), rank)
        # From what the automaton can follow to the longest entry that begins it, and from an entry to the next shorter one.
        self.begins: dict[str, int] = {}
        self.shorter: dict[int, int] = {}
        text_of = {self.bytes[rank].decode("latin-1"): rank for rank in self.made}
        for text in sorted(text_of, key=len):
            best = -1
            for size in range(1, len(text) + 1):
                start = text[:size]
                if start in text_of:
                    if size == len(text):
                        self.shorter[text_of[text]] = best
                    best = text_of[start]
                self.begins[start] = best
        self.size = {rank: len(self.bytes[rank]) for rank in self.made}
        self.fits: dict[int, bool] = {}
        self.pieces = _Words(lambda piece: self.encode_bytes(piece.encode()))
        self.words = _Words(lambda word: self._by_pattern(" " + word))

    def _merge(self, piece: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Ids by plain merging, lowest rank first, and the two sides of the last merge."""
        parts, last = [piece[i:i + 1] for i in range(len(piece))], None
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], self.width), i) for i in range(len(parts) - 1))
            if best == self.width:
                break
            last = (self.ranks[parts[at]], self.ranks[parts[at + 1]])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], last

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are beside each other.

        The merges that made the two are undone, latest first. What then touches at the border must not have had an
        earlier merge across it; of equal ranks the one further left comes first.
        """
        key = left * self.width + right
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, known = self.width, True
        while True:
            if self.ranks.get(self.bytes[left] + self.bytes[right], self.width) < limit:
                known = False
                break
            if self.made[left] > self.made[right]:
                limit, left = self.made[left], self.sides[left][1]
            elif self.made[right] >= 0:
                limit, right = self.made[right] + 1, self.sides[right][0]
            else:
                break
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[key] = known
        return known

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        text = piece.decode("latin-1")
        stop, longest, width = len(text), self.longest, self.width
        follow, begins, shorter, size, compatible, fits = self.automaton.longest_prefix, self.begins, self.shorter, self.size, self.compatible, self.fits.get
        dead = bytearray(stop + 1)
        # The entry taken at each end, and the next to try there.
        ids, ends, untried = [], [0], [begins[text[:follow(text[:longest])]]]
        while True:
            here, token = ends[-1], untried[-1]
            while token >= 0:
                end = here + size[token]
                if not dead[end]:
                    fit = not ids or fits(ids[-1] * width + token)
                    if fit or fit is None and compatible(ids[-1], token):
                        break
                token = shorter[token]
            else:
                dead[here] = 1
                untried.pop()
                ends.pop()
                ids.pop()
                continue
            ids.append(token)
            if end == stop:
                return tuple(ids)
            untried[-1] = shorter[token]
            ends.append(end)
            rest = text[end:end + longest]
            untried.append(begins[rest[:follow(rest)]])

    def _by_pattern(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of a text. A single space between other characters always begins a piece, so there the text may be cut first."""
        if " " not in text or _BESIDE_SPACE.search(text):
            return list(self._by_pattern(text))
        first, *words = text.split(" ")
        return [*self._by_pattern(first), *chain.from_iterable(map(self.words.__getitem__, words))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; each worker process reads it once."""
    if (path, pattern) not in _CODECS:
        lines = Path(path).read_bytes().splitlines()
        _CODECS[path, pattern] = Codec({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}, pattern)
    return _CODECS[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every text; a null text is empty and has no ids. Repeated rows give repeated rows."""
    def run(doc_id, text):
        c = codec(path, pattern)
        return {"doc_id": doc_id, "ids": [c.encode(t) if t else [] for t in text]}

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, ids array<int>", run)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of every list of ids; null and empty lists give no bytes."""
    def run(doc_id, ids):
        c = codec(path, pattern)
        return {"doc_id": doc_id, "bytes": [c.decode(i) if i else b"" for i in ids]}

    return arrow_rows(encoded, ["doc_id", "ids"], "doc_id bigint, bytes binary", run)


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text and decode its ids again, in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The ids of a text never leave its task, so nothing is shuffled. A null text counts as empty.
    """
    def run(doc_id, text):
        c = codec(path, pattern)
        count, digest, back = [], [], []
        for t in text:
            ids = c.encode(t) if t else []
            count.append(len(ids))
            digest.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {"doc_id": doc_id, "n_tokens": count, "ids_sha256": digest, "decoded_sha256": back}

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
