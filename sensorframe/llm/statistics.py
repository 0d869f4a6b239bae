"""Counts over whole texts, shared by the quality operators."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import arrow_rows, bounded_sample, stage

#: Documented bound of the labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_exclaim", "n_bar", "n_top", "n_stops", "n_odd", "n_doubled")
# What is added up, taken off, and what it is a share of.
FORMULAS = {
    "n_words": (("n_words",), (), None), "mean_word": (("word_chars",), ("n_symbols", "n_exclaim", "n_stops"), "n_words"), "symbols": (("n_symbols",), (), "n_words"),
    "dup_lines": (("n_dup_lines",), (), "n_lines"), "repeats": (("n_repeat_words",), (), "n_words"), "line_words": (("n_words",), (), "n_lines"), "upper": (("n_upper",), (), "n_chars"),
    "digits": (("n_digits",), (), "n_chars"), "exclaim": (("n_exclaim",), (), "n_words"), "bars": (("n_bar",), (), "n_words"), "top": (("n_top",), (), "n_words"),
    "stops": (("n_stops",), (), "n_words"), "odd": (("n_odd",), (), "n_words"), "doubled": (("n_doubled",), (), "n_words"),
}
FEATURES = tuple(FORMULAS)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ODD = b"{}[]\\^~_=@`/+"


def counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS; a null text has none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    if n > 3:
        windows = Counter(zip(words, words[1:], words[2:]))
        if len(windows) < n - 2:
            twice = np.fromiter((windows[w] > 1 for w in zip(words, words[1:], words[2:])), bool, n - 2)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= twice
            repeated = int(covered.sum())
    seen = Counter(words)
    without = len(raw)

    def has(chars: bytes) -> int:
        return without - len(raw.translate(None, chars))

    return (
        n, len(text) - has(b" \t\n\r\x0b\x0c"), has(SYMBOLS), len(lines) - len(set(lines)), repeated, len(text), len(lines), has(_UPPER), has(_DIGITS),
        has(b"!"), has(b"|"), max(seen.values(), default=0), has(b".,;:?"), has(_ODD), sum(map(eq, words, words[1:])),
    )


def statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every text, written once to the shared folder."""
    def run(doc_id, text):
        columns = list(zip(*map(counts, text)))
        return {"doc_id": doc_id, **{name: list(c) for name, c in zip(COUNTS, columns)}}

    return stage(arrow_rows(documents, ["doc_id", "text"], ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS)]), run), "statistics")


def shares(rows: list[tuple[int, ...]]) -> np.ndarray:
    """The features of rows of counts; the same as ``features`` in Spark."""
    table = dict(zip(COUNTS, np.array(rows, float).reshape(-1, len(COUNTS)).T))
    out = []
    for plus, minus, under in FORMULAS.values():
        top = sum(table[c] for c in plus) - sum(table[c] for c in minus)
        out.append(top if under is None else np.divide(top, table[under], out=np.zeros(len(rows)), where=table[under] != 0))
    return np.stack(out, axis=1)


def features(prefix: str = "") -> dict[str, Column]:
    """The statistics that models look at: shares, so that they mean the same for short and long texts."""
    def of(plus: tuple, minus: tuple, under: str | None) -> Column:
        top = sum((F.col(prefix + c) for c in plus), F.lit(0)) - sum((F.col(prefix + c) for c in minus), F.lit(0))
        return top.cast("double") if under is None else F.coalesce(F.try_divide(top.cast("double"), F.col(prefix + under)), F.lit(0.0))

    return {name: of(*formula) for name, formula in FORMULAS.items()}


def _known(labels: DataFrame, learn: Column) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").where(learn).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))


def labelled_documents(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text`` of the documents that ``labelled`` would take of all: their texts alone need counting for a fit.

    Ids are picked from the ``doc_id`` column alone; they are at most ``rows``, so they are sent to every task.
    """
    ids = documents.select("doc_id").where("doc_id is not null").join(_known(labels, learn).select("doc_id"), "doc_id")
    picked = bounded_sample(stage(ids, "labelled"), "doc_id", rows).distinct()
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")


def labelled(stats: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and labels of at most ``rows`` labelled rows, picked by a hash of the id, for fitting on the driver.

    Several labels of a document count by their majority (a tie: good); null labels and ids are left out.
    """
    known = _known(labels, learn)
    # Which of a document's repeated rows are taken does not matter; bounded_sample orders them by hash and id.
    met = stats.join(known, "doc_id").select("doc_id", "quality", *(c.alias(f"f_{n}") for n, c in features().items()))
    taken = bounded_sample(stage(met, "labelled"), "doc_id", rows).drop("doc_id").collect()
    if not taken:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    table = np.array([tuple(r) for r in taken], float)
    return table[:, 1:], table[:, 0]
