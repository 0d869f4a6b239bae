"""Operator 13: tokens of two tokenizers aligned by their bytes.

Both token sequences of a document are frames of byte offsets. ``pandas.merge_asof`` backward, keyed by document, finds for every token start
the other side's token that covers it; both directions together are all overlaps. An overlap whose tokens end alike closes a group: a
byte range that both sides cut out. All A-B pairs of a group are linked.

How many documents link a pair of ids is counted over the corpus without moving every document's pairs: a task gathers its documents
in chunks of bounded size, a chunk's distinct pairs go on once with their document counts, and come back with the corpus' counts. Documents
hold their pairs as numbers into the chunk's pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.byte_bpe import _Words
from sensorframe.llm.common import arrow_rows, stage

# Most documents and pairs of a chunk, before the last document is added.
CHUNK_DOCS, CHUNK_PAIRS = 8192, 4_000_000
# Most tokens of both sides that are aligned at once, before the last document is added.
BATCH_TOKENS = 400_000
_SPACE = "▁"
# Spaces beside other white space or at an edge: there a space may not begin a token, so such texts are encoded whole.
_BESIDE_SPACE = re.compile(r" \s|\s |^\s|\s$")
_PAIRS: dict[tuple[str, str], "TokenPair"] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenPair:
    """Ids and byte lengths of both tokenizers; words between single spaces are encoded once by either library and remembered."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.width = self.b.get_piece_size()
        file = json.loads(Path(byte_level).read_text())
        byte_of = _byte_of()
        self.a_bytes = {i: bytes(map(byte_of.__getitem__, token)) for token, i in file["model"]["vocab"].items() if set(token) <= byte_of.keys()}
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int32)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        # Where every merge makes the next id, the lowest id is merged first: then a short text may go through the quicker of two libraries.
        merges = [m if isinstance(m, str) else " ".join(m) for m in file["model"]["merges"]]
        special = {t["id"] for t in file.get("added_tokens", [])}
        self.quick = None
        if [file["model"]["vocab"].get(m.replace(" ", "")) for m in merges] == list(range(256, 256 + len(merges))):
            ranks = {token: i for i, token in self.a_bytes.items() if i not in special}
            self.quick = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [self._piece(i) for i in range(self.width)]
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int32)
        # A piece with a space after its beginning could join two words; without one, spaces part the merges.
        self.parted = not any(_SPACE in self.b.id_to_piece(i).lstrip(_SPACE) for i in range(self.width))
        self.words = _Words(self._whole)
        self.decimal = {s: [b"%d%s" % (i, s) for i in range(max(self.width, len(self.a_size)))] for s in (b",", b"|", b";")}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of both sides as bytes of int32, None where the joined bytes of a side are not a space and the text."""
        want = f" {text}".encode()
        a = self.quick.encode_ordinary(f" {text}") if self.quick and len(text) <= 200 else self.a.encode(f" {text}", add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return array("i", a).tobytes(), array("i", b).tobytes()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None for texts without tokens."""
        if not text:
            return None
        if not self.parted or _SPACE in text or _BESIDE_SPACE.search(text):
            found = self._whole(text)
            return found and (np.frombuffer(found[0], np.int32), np.frombuffer(found[1], np.int32))
        found = list(map(self.words.__getitem__, text.split(" ")))
        if None in found:
            return None
        a, b = zip(*found)
        return np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32)


def token_pair(byte_level: str, pieces: str) -> TokenPair:
    if (byte_level, pieces) not in _PAIRS:
        _PAIRS[byte_level, pieces] = TokenPair(byte_level, pieces)
    return _PAIRS[byte_level, pieces]


def covering(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """For every token start of ``left`` the row of the token of ``right`` that covers it."""
    met = pd.merge_asof(left[["doc", "start"]], right[["doc", "start", "token"]], on="start", by="doc", direction="backward")
    return met["token"].to_numpy(np.int64)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs as rows of ``a`` and rows of ``b``: the union of both directions; a pair with one start is found twice."""
    return np.concatenate([np.arange(len(a)), covering(b, a)]), np.concatenate([covering(a, b), np.arange(len(b))])


def _frame(docs: np.ndarray, ids: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    end = np.cumsum(size[ids], dtype=np.int64)
    return pd.DataFrame({"doc": docs, "start": end - size[ids], "end": end, "token": np.arange(len(ids))})


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1 ... n - 1 for every n of ``counts``."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Aligned:
    """Groups of a batch of documents whose joined bytes are alike on both sides."""

    def __init__(self, pair: TokenPair, found: list[tuple[np.ndarray, np.ndarray]]):
        self.pair, self.many = pair, len(found)
        self.n_a, self.n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int32) for k in (0, 1))
        doc_a, doc_b = (np.repeat(np.arange(self.many), n) for n in (self.n_a, self.n_b))
        a, b = _frame(doc_a, self.a, pair.a_size), _frame(doc_b, self.b, pair.b_size)
        of_a, of_b = overlaps(a, b)
        alike = a["end"].to_numpy()[of_a] == b["end"].to_numpy()[of_b]
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[of_a[alike]] = 1
        closes_b[of_b[alike]] = 1
        # A document's last tokens end alike, so no group crosses documents.
        self.group_a, self.group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        groups = int(closes_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.doc = doc_a[closes_a == 1]
        self.groups = np.bincount(self.doc, minlength=self.many)

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        last_a = np.r_[self.group_a[1:] != self.group_a[:-1], True] if len(self.a) else np.zeros(0, bool)
        last_b = np.r_[self.group_b[1:] != self.group_b[:-1], True] if len(self.b) else np.zeros(0, bool)
        # A group's A tokens come first; every group before it puts its B tokens before them.
        before_b = np.cumsum(self.size_b) - self.size_b
        through_a = np.cumsum(self.size_a)
        at_a, at_b = np.arange(len(self.a)) + before_b[self.group_a], np.arange(len(self.b)) + through_a[self.group_b]
        index = np.empty(len(self.a) + len(self.b), np.int64)
        wide = len(self.pair.decimal[b","])
        index[at_a] = self.a + np.where(last_a, wide, 0)
        index[at_b] = self.b + np.where(last_b, 2 * wide, 0)
        table = self.pair.decimal[b","] + self.pair.decimal[b"|"] + self.pair.decimal[b";"]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        listed = list(map(table.__getitem__, index.tolist()))
        return [b"".join(listed[low:high])[:-1] for low, high in zip([0, *ends], ends)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (A id times B's vocabulary size, plus B id) and number of occurrences, by document and pair.

        Pairs of occurrences are made for small groups only; of others the distinct ids of either side meet.
        """
        base = np.int64(len(self.pair.a_size)) * self.pair.width
        big = self.size_a * self.size_b > 4096
        first_b = np.cumsum(self.size_b) - self.size_b
        small = ~big[self.group_a]
        g, ids = self.group_a[small], self.a[small].astype(np.int64)
        counts = self.size_b[g]
        b = self.b[np.repeat(first_b[g], counts) + _ragged(counts)]
        key, count = np.unique(np.repeat(self.doc[g] * base + ids * self.pair.width, counts) + b, return_counts=True)
        keys, times = [key], [count]
        first_a = np.cumsum(self.size_a) - self.size_a
        for k in np.flatnonzero(big).tolist():
            x, m = np.unique(self.a[first_a[k]:first_a[k] + self.size_a[k]], return_counts=True)
            y, n = np.unique(self.b[first_b[k]:first_b[k] + self.size_b[k]], return_counts=True)
            keys.append(((self.doc[k] * base + x.astype(np.int64) * self.pair.width)[:, None] + y).ravel())
            times.append((m[:, None] * n).ravel())
        key, count = keys[0], times[0]
        if len(keys) > 1:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, at, np.concatenate(times))
        return key // base, key % base, count


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all low bytes first."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


_CHUNKS = "chunk bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, n_pairs array<bigint>, pairs binary, times binary, codes array<bigint>, docs array<bigint>"


def chunks(documents: DataFrame, byte_level: str, pieces: str, most_docs: int = CHUNK_DOCS, most_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """Documents in chunks: their counts and digests, their linked pairs, the chunk's distinct pairs and how many of its documents hold them."""
    target = documents.sparkSession.createDataFrame([], _CHUNKS).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        pair = token_pair(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        codes: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0
        waiting: list[tuple[int | None, tuple | None]] = []
        tokens = 0

        def align():
            """Waiting documents go into the chunk."""
            nonlocal waiting, tokens, held
            real = [f for _, f in waiting if f is not None]
            aligned = Aligned(pair, real)
            doc, code, count = aligned.links()
            per = np.bincount(doc, minlength=len(real)).tolist()
            links = np.bincount(doc, count, minlength=len(real)).astype(np.int64).tolist()
            codes.append(code)
            times.append(count)
            held += len(code)
            texts, groups, k = aligned.texts(), aligned.groups.tolist(), 0
            for d, f in waiting:
                if f is None:
                    rows.append((d, 0, 0, 0, 0, "", 0))
                else:
                    rows.append((d, len(f[0]), len(f[1]), groups[k], links[k], hashlib.sha256(texts[k]).hexdigest(), per[k]))
                    k += 1
            waiting, tokens = [], 0

        def chunk():
            nonlocal rows, codes, times, held, number
            known, index, docs = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            columns = list(map(list, zip(*rows)))
            # A document's pairs rise; their steps are small numbers.
            step = np.diff(index, prepend=0)
            per = np.array(columns[6])
            heads = (np.cumsum(per) - per)[per > 0]
            step[heads] = index[heads]
            values = [[number], *([c] for c in columns), [_packed(step)], [_packed(np.concatenate(times) - 1)], [known.tolist()], [docs.tolist()]]
            rows, codes, times, held = [], [], [], 0
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = pair.encode(text)
                    waiting.append((d, found))
                    tokens += 0 if found is None else len(found[0]) + len(found[1])
                    if tokens >= BATCH_TOKENS or len(waiting) >= 2000:
                        align()
                        if len(rows) >= most_docs or held >= most_pairs:
                            yield chunk()
        if waiting:
            align()
        if rows:
            yield chunk()

    return documents.select("doc_id", "text").mapInArrow(run, target)


def pair_counts(chunked: DataFrame, width: int) -> DataFrame:
    """``code, docs, best`` of every pair of ids linked anywhere: how many documents hold it, and whether none of its A id's is held by more."""
    pairs = chunked.select(F.explode(F.arrays_zip("codes", "docs")).alias("p")).select(F.col("p.codes").alias("code"), F.col("p.docs").alias("docs"))
    total = pairs.groupBy("code").agg(F.sum("docs").alias("docs"))
    # One row per id of the first vocabulary, whose size bounds it.
    most = total.groupBy(F.expr(f"code div {width}").alias("a")).agg(F.max("docs").alias("most"))
    return total.join(F.broadcast(most), F.expr(f"code div {width}") == F.col("a")).select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(documents: DataFrame, byte_level: str, pieces: str, most_docs: int = CHUNK_DOCS, most_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """Tokens of a space and every text by ``byte_level`` (A) and of every text by ``pieces`` (B), aligned.

    Gives ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. Null and empty texts, and texts that a tokenizer does not
    give back byte by byte, have no tokens: zeros and ''. A null doc_id stays null, and its rows count as documents; repeated rows count each;
    an empty table gives no rows; other columns are not looked at. A chunk holds at most ``most_docs`` documents and ``most_pairs`` pairs
    before its last batch, so memory is bounded but for the tokens and distinct pairs of one text.
    """
    width = token_pair(byte_level, pieces).width
    chunked = stage(chunks(documents, byte_level, pieces, most_docs, most_pairs), "aligned")
    own = chunked.select(F.col("chunk").alias("of_chunk"), F.posexplode("codes").alias("place", "code"))
    looked = own.join(pair_counts(chunked, width), "code").select("of_chunk", "place", "docs", "best")

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        n = np.asarray(row["n_pairs"], np.int64)
        index = _unpacked(row["pairs"])
        # Steps within a document add up to the numbers of its pairs.
        ends = np.cumsum(n)
        index = np.cumsum(index)
        offset = np.r_[0, index][ends - n]
        index -= np.repeat(offset, n)
        times = _unpacked(row["times"]) + 1
        docs, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        docs[right["place"]], best[right["place"]] = right["docs"], right["best"]
        doc = np.repeat(np.arange(len(n)), n)
        sums = [np.zeros(len(n), np.int64) for _ in range(2)]
        np.add.at(sums[0], doc, times * best[index])
        np.add.at(sums[1], doc, times * docs[index])
        return pd.DataFrame({
            "doc_id": pd.array(row["doc_ids"], "Int64"), "n_a": row["n_a"], "n_b": row["n_b"], "n_groups": row["n_groups"], "n_links": row["n_links"],
            "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row["groups"],
        })

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return chunked.drop("codes", "docs").groupBy("chunk").cogroup(looked.groupBy("of_chunk")).applyInPandas(finish, schema)


def token_groups(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``doc_id, n_a, n_b, groups`` of every text, the groups as ``a1,a2|b1;a3|b2,b3``; texts without tokens have ''."""
    def run(doc_id, text):
        pair = token_pair(byte_level, pieces)
        found = [pair.encode(t) for t in text]
        listed = iter(Aligned(pair, [f for f in found if f is not None]).texts())
        return {
            "doc_id": doc_id, "n_a": [0 if f is None else len(f[0]) for f in found], "n_b": [0 if f is None else len(f[1]) for f in found],
            "groups": ["" if f is None else next(listed).decode() for f in found],
        }

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, n_a bigint, n_b bigint, groups string", run)
