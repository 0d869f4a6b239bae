"""Operator 12: periodic runs of words, by longest common extensions from suffix trees.

A run is a stretch of words with smallest period q that is long enough (``least`` words and ``times`` periods) and that no neighbouring
word extends. Every run has a Lyndon root, the longest Lyndon word at its place under one of two orders of the words; so two candidates a
place are enough. Ukkonen's tree of the words orders their suffixes and, walked as an Euler tour, gives how far two places agree to the
right as a range minimum; the tree of the reversed words gives it to the left.

Trees are built only where a run can be: within a run of period q every window of ``max(least, times * q) - q`` words comes again q words
on, so words that no repeated window covers are in no run. That is a proof and no estimate: hashes of windows may let more in, never less.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from sensorframe.llm.common import arrow_rows

LEAST, TIMES = 24, 3
_MIX = 0x9E3779B97F4A7C15
Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """Words between the white space of ASCII."""
    return text.encode().split() if text else []


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (1 and more) and an end mark; its suffixes' orders and longest common extensions."""

    def __init__(self, symbols: list[int], width: int):
        s = [*symbols, 0]
        n = len(s)
        start, stop, link, to, leaves = [0], [0], [0], {}, []
        node = edge = length = left = 0
        for i, c in enumerate(s):
            last = 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    first = start[child]
                    size = min(stop[child], i + 1) - first
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[first + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = len(start)
                    to[key] = inner
                    start += (first, i)
                    stop += (first + length, n)
                    link += (0, 0)
                    start[child] = first + length
                    to[inner * width + s[first + length]] = child
                    to[inner * width + c] = inner + 1
                    leaves.append(inner + 1)
                    if last:
                        link[last] = inner
                    last = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        many = len(start)
        keys = np.fromiter(to.keys(), np.int64, many - 1)
        self.kids = np.fromiter(to.values(), np.int64, many - 1)
        self.parent, self.symbol = keys // width, keys % width
        self.size = (np.array(stop) - np.array(start)).tolist()
        # Suffix i ends at the i-th leaf that was made.
        self.suffix = [-1] * many
        for i, leaf in enumerate(leaves):
            self.suffix[leaf] = i
        self._tour()

    def _ordered(self, symbol: np.ndarray) -> tuple[list[int], list[int]]:
        """Children of all nodes, node by node in the order of their symbols, and where those of a node begin."""
        order = np.lexsort((symbol, self.parent))
        begin = np.searchsorted(self.parent[order], np.arange(len(self.size) + 1))
        return self.kids[order].tolist(), begin.tolist()

    def _tour(self) -> None:
        """Euler tour: the string depth at every step, the step of every leaf, the suffixes in order (the end mark comes first)."""
        kids, begin = self._ordered(self.symbol)
        at, suffix, size = begin[:-1], self.suffix, self.size
        depths, steps, order = [], [0] * sum(i >= 0 for i in suffix), []
        stack, deep = [0], [0]
        while stack:
            node, depth = stack[-1], deep[-1]
            depths.append(depth)
            k = at[node]
            if k == begin[node + 1]:
                stack.pop()
                deep.pop()
                continue
            at[node] = k + 1
            child = kids[k]
            i = suffix[child]
            if i < 0:
                stack.append(child)
                deep.append(depth + size[child])
            else:
                steps[i] = len(depths)
                order.append(i)
                depths.append(depth + size[child])
        self.depths, self.steps, self.order = np.array(depths, np.int32), np.array(steps), order

    def order_end_last(self) -> list[int]:
        """The suffixes in order where the end mark counts as the greatest symbol."""
        kids, begin = self._ordered(np.where(self.symbol == 0, np.iinfo(np.int64).max, self.symbol))
        stack, order, suffix = [0], [], self.suffix
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                order.append(suffix[node])
            else:
                stack += kids[begin[node]:begin[node + 1]][::-1]
        return order

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols suffixes ``i`` and ``j`` (unlike places) share: the depth of their lowest common ancestor.

        Range minima over the tour by powers of two; a level is kept only until the pairs that need it are answered.
        """
        a, b = self.steps[i], self.steps[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        table = self.depths
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                table = np.minimum(table[:-(1 << k - 1)], table[1 << k - 1:])
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
        return out


def _next_lower(rank: list[int]) -> list[int]:
    """For every place the next one of lower rank, the length where there is none."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def tree_runs(words: list, least: int, times: int) -> list[Run]:
    """All runs of ``words``: (start, length, period). Time and memory grow in proportion to the words."""
    number: dict = {}
    s = [number.setdefault(w, len(number) + 1) for w in words]
    n, width = len(s), len(number) + 1
    tree = SuffixTree(s, width)
    first, second = [], []
    for order in (tree.order, tree.order_end_last()[::-1]):
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        after = np.array(_next_lower(rank[:n].tolist()))
        inside = np.flatnonzero(after < n)
        first.append(inside)
        second.append(after[inside])
    i, j = np.concatenate(first), np.concatenate(second)
    end = j + tree.common(i, j)
    period = j - i
    del tree
    back = SuffixTree(s[::-1], width)
    start = i - back.common(n - i, n - j)
    long = end - start >= np.maximum(least, times * period)
    return sorted(set(zip(start[long].tolist(), (end - start)[long].tolist(), period[long].tolist())))


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` elements."""
    out, done, part, width = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if out is None:
                    out = part
                else:
                    m = len(h) - done - width + 1
                    out = out[:m] * np.uint64(_MIX | 1) + part[done:done + m]
                done += width
            width *= 2
            if width > size:
                return out
            half = width // 2
            part = part[:-half] * np.uint64((_MIX >> 7 | 1) * width & 0xFFFFFFFFFFFFFFFF | 1) + part[half:]


def stretches(h: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of words covered by windows that come again within the same stretch."""
    if len(h) <= window:
        return []
    key = _windows(h, window)
    fast = np.sort(key)
    if not (fast[1:] == fast[:-1]).any():
        return []
    live, hashes = np.arange(len(key)), key
    while True:
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        kept = live[count[inverse] > 1]
        if not len(kept):
            return []
        head = np.r_[True, np.diff(kept) > window]
        if len(kept) == len(live):
            lows = np.flatnonzero(head)
            return list(zip(kept[lows].tolist(), (kept[np.r_[lows[1:], len(kept)] - 1] + window).tolist()))
        live = kept
        with np.errstate(over="ignore"):
            key = hashes[live] + np.cumsum(head).astype(np.uint64) * np.uint64(_MIX)


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of ``words`` by start, then period."""
    if len(words) < max(least, times):
        return []
    # The shortest stretch that comes again a period later: of `least` words, or of `times` periods.
    turn = least // times
    window = min([least - q for q in range(1, turn + 1)] + [(times - 1) * (turn + 1)])
    found: list[Run] = []
    for a, b in stretches(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), window):
        found += [(a + s, length, q) for s, length, q in tree_runs(words[a:b], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def with_runs(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, every tenth one (by checksum of its id) made periodic from a place of its own on; a null id is none of them."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def find_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, start, length, period`` of every run of every text, in words from 0; texts without runs, null and empty ones give no rows."""
    def run(doc_id, text):
        rows = [(d, *r) for d, t in zip(doc_id, text) for r in word_runs(words_of(t), least, times)]
        return dict(zip(("doc_id", "start", "length", "period"), map(list, zip(*rows)) if rows else ([], [], [], [])))

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, start bigint, length bigint, period bigint", run)


def collapsed(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, text`` with every run cut to its first period. A text without runs stays as it is, a null one null."""
    def run(doc_id, text):
        out = []
        for t in text:
            words = words_of(t)
            runs = word_runs(words, least, times)
            out.append(b" ".join(collapse(words, runs)).decode() if runs else t)
        return {"doc_id": doc_id, "text": out}

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, text string", run)


def report(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Runs of every document of ``with_runs``: ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    The run with the greatest exponent is shown (ties: smallest start, then period), nulls where there is none. Nothing is shuffled. A null
    or empty text has no words and no runs; a null doc_id stays null; repeated rows give repeated rows, an empty table none; other
    columns are not looked at. A worker holds one text's words and, for its longest stretch with repeated windows, a tree
    of about 1 kB a word.
    """
    def run(doc_id, text):
        out = {c: [] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for d, t in zip(doc_id, text):
            words = with_runs(words_of(t), d)
            runs = word_runs(words, least, times)
            best = (None, None, None)
            for r in runs:
                if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            row = (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())
            for c, v in zip(out, row):
                out[c].append(v)
        return out

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", run)
