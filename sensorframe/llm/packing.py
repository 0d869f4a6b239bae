"""Operator 8: packing token pieces into windows of equal capacity by multiway differencing.

Each document is tokenized where it is read; only (document, start, length, checksum) of its pieces goes on, written once to the
shared folder. Whole windows cut from long documents need no packing. What is left is cut into parts of at most ``part`` tokens and
dealt by row number into groups of bounded token count, so that a hot document id or a very long text fills no group; each group
is packed by Karmarkar-Karp differencing.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.alignment import _byte_of
from sensorframe.llm.byte_bpe import _Words
from sensorframe.llm.common import arrow_rows, ceil_div, stage

# Windows packed together in one group.
GROUP_WINDOWS = 256
MARKS = ".,;:!?*#$%&|"
# The character that stands for each byte at byte level.
_LEVEL = {byte: char for char, byte in _byte_of().items()}
_WORDS: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of texts whose tokenizer drops white space: each word between white space is encoded once and remembered.

    Words of printable Latin-1 characters are cut by the file's own pattern and their pieces handed to its merges alone, where the file's steps
    are those of ``STEPS``: of such words nothing but case is normalized. All other words take all steps of the tokenizer.
    """

    # Kinds of normalizers and pre-tokenizers under which the quick way holds.
    STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])

    # The tokenizer sees no white space in these, Python does.
    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Control strings stand for themselves wherever they are, so texts that hold one are encoded whole; words are quicker without looking for them.
        self.plain = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self._word)
        self.model = self.tokenizer.model
        self.cut = self._pattern(path)

    def _pattern(self, path: str):
        """The split pattern's ``findall``, or nothing where the file works by other steps."""
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, split = (spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if ([s["type"] for s in before], [s["type"] for s in split]) != self.STEPS or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return None
        spaces, cut, level = before[1], split[0], split[1]
        plain = spaces["pattern"] == {"Regex": "\\s+"} and cut["behavior"] == "Removed" and cut["invert"] and "Regex" in cut["pattern"]
        if not plain or level["add_prefix_space"] or level["use_regex"]:
            return None
        return regex.compile(cut["pattern"]["Regex"]).findall

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_LEVEL)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # Marks that follow a letter are a piece of their own, and case is dropped: so fewer words are new.
        base = word.rstrip(MARKS)
        if base != word and base and base[-1].lower().isalpha():
            return self.words[base] + self.words[word[len(base):]]
        if self.cut and word.isprintable() and max(word) <= "\xff":
            word = word.lower()
            return self._piece(word) if word.isalpha() else b"".join(map(self._piece, self.cut(word)))
        if word.isascii() and not word.islower() and word != word.lower():
            return self.words[word.lower()]
        return self._whole(word)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        if any(c in text for c in self.ODD):
            return np.frombuffer(self._whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), "<u4")


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window of every item, and the fullest window's size.

    A partial partition holds its windows' sums in falling order, empty ones left out. The two with the largest difference
    between fullest and emptiest window are merged, fullest onto emptiest, until one is left. Items of a window hang together in
    a chain, so that merging windows costs no more than linking two ends.
    """
    n = len(sizes)
    after = np.full(n, -1)
    # (minus difference, serial number, sums, first item of each window, last item)
    heap = [(-int(s), i, np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, a_first, a_last = heapq.heappop(heap)
        _, _, b, b_first, b_last = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - windows)
        if shared:
            # The smallest windows of either side meet the largest of the other.
            at_a, at_b = len(a) - shared, len(b) - shared
            low_a, low_b = slice(at_a, None), slice(at_b, None)
            after[a_last[low_a]] = b_first[low_b][::-1]
            sums = np.concatenate([a[:at_a], b[:at_b], a[low_a] + b[low_b][::-1]])
            first = np.concatenate([a_first[:at_a], b_first[:at_b], a_first[low_a]])
            last = np.concatenate([a_last[:at_a], b_last[:at_b], b_last[low_b][::-1]])
        else:
            sums, first, last = np.concatenate([a, b]), np.concatenate([a_first, b_first]), np.concatenate([a_last, b_last])
        order = np.argsort(-sums, kind="stable")
        sums, first, last = sums[order], first[order], last[order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-int(spread), serial, sums, first, last))
        serial += 1
    window = np.zeros(n, np.int64)
    for w, item in enumerate(heap[0][3]):
        while item >= 0:
            window[item] = w
            item = after[item]
    return window, int(heap[0][2][0])


def fill_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of every item, none fuller than ``capacity``; the number of windows rises until that holds."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    windows = ceil_div(int(sizes.sum()), capacity)
    while windows < len(sizes):
        window, fullest = differencing(sizes, windows)
        if fullest <= capacity:
            return window
        windows += max(1, windows * (fullest - capacity) // capacity)
    return np.arange(len(sizes))


def pieces(documents: DataFrame, tokenizer: str, capacity: int, part: int, end_id: int) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, and ``task, row`` that tell rows apart."""
    counter = {}

    def run(doc_id, text):
        encode = word_ids(tokenizer).encode
        out = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "row")}
        context = TaskContext.get()
        task = context.partitionId()
        at = (context.taskAttemptId(), task)
        row = counter.get(at, 0)
        for d, t in zip(doc_id, text):
            ids = np.append(encode(t) if t else np.zeros(0, "<u4"), np.uint32(end_id)).astype("<u4")
            whole = len(ids) // capacity * capacity
            cuts = [*range(0, whole, capacity), *range(whole, len(ids), part), len(ids)]
            for low, high in zip(cuts, cuts[1:]):
                for n, v in (("doc_id", d), ("start", low), ("length", high - low), ("ids_crc32", zlib.crc32(ids[low:high].tobytes())), ("doc_tokens", len(ids)), ("task", task), ("row", row)):
                    out[n].append(v)
                row += 1
        counter.clear()
        counter[at] = row
        return out

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, row bigint", run)


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, part: int = 512, end_id: int = 1, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Every piece with its window: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is one piece that holds the end id alone; repeated rows are packed each on its own, null ids too;
    an empty table gives no rows. Other columns are not looked at.
    """
    cut = stage(pieces(documents, tokenizer, capacity, part, end_id), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = ceil_div(tokens, capacity * group_windows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "row"], kind="stable", ignore_index=True)
        size = pdf["length"].to_numpy()
        window = np.zeros(len(pdf), np.int64)
        full = size == capacity
        window[~full] = fill_windows(size[~full], capacity)
        first_full = window[~full].max() + 1 if (~full).any() else 0
        window[full] = first_full + np.arange(full.sum())
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(size[order])
        starts = ends - size[order]
        w = window[order]
        head = np.r_[True, w[1:] != w[:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = starts - np.repeat(starts[head], np.diff(np.r_[np.flatnonzero(head), len(w)]))
        pdf["sequence_id"] = pdf["grp"] + groups * window
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # Rows of a task are dealt round the groups, each task from another one on, so all groups get the same share.
    dealt = cut.withColumn("grp", F.pmod(F.col("row") + F.xxhash64("task"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
