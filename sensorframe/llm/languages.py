"""Operator 4: language identification as inference of a mixture.

Letter trigrams of all learnable texts are counted by language. A text is a mixture of languages: expectation-maximisation
finds the shares under which its trigrams are most likely, for growing sets of the languages, and the set whose likelihood, less a penalty
per language, is largest is chosen, of any size. The language of the largest share is the prediction, that share the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import arrow_rows, in_fold

FOLDS, HELD = 4, 2
BUCKETS = 1 << 15
# Log likelihood that the best shares may have more than those found.
TOLERANCE = 1e-3
# Neighbouring trigrams overlap: so many of them count as one observation.
OVERLAP = 3.0
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of a text, in lower case, any other characters being one blank, and how often each occurs."""
    if text:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(_letters()[codes], codes, 32)
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        c = np.r_[32, c, 32].astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) * np.uint64(31) + c[2:] * np.uint64(0xC2B2AE3D) * np.uint64(961)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h >> np.uint64(49)).astype(np.int64)[c[1:-1] != 32]
        if len(h):
            total = np.bincount(h, minlength=BUCKETS)
            at = np.flatnonzero(total)
            return at, total[at]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def learn_rows() -> Column:
    return ~in_fold("doc_id", FOLDS, HELD)


def profiles(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the log probability of each bucket in each (buckets x languages), from all learnable rows.

    Each task adds up its own texts, so what is shuffled is one row per task, language and bucket; the driver gets one row per language.
    """
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                at, n = trigrams(text.as_py())
                if len(at):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=schema)

    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(learn_rows()).select("lang", "text")
    counted = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    one = counted.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    table = np.full((BUCKETS, len(one)), 0.5)
    for k, r in enumerate(one):
        table[r.bucket, k] += r.n
    return [r.lang for r in one], np.log(table / table.sum(axis=0)) if one else table


def mixture(p: np.ndarray, n: np.ndarray, rounds: int | None = None, least: float | None = None) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of ``p``) for counts ``n`` by expectation-maximisation, and the log likelihood.

    It ends when no shares can be likelier by more than TOLERANCE, or none can be likelier than ``least``; and after ``rounds``,
    where they are given.
    """
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for k in count():
        mixed = p @ share
        gain = (n / mixed) @ p / total
        # The likelihood is concave: its slope towards the best language bounds what is left.
        left = total * (gain.max() - 1)
        if left <= TOLERANCE or k == rounds or least is not None and n @ np.log(mixed) + left <= least:
            return share, float(n @ np.log(mixed))
        share = share * gain
        share /= share.sum()


def chosen(at: np.ndarray, n: np.ndarray, logs: np.ndarray) -> tuple[list[int], list[float]]:
    """Columns of the languages in a text, the largest share first, and their shares."""
    rows = logs[at]
    n = n / OVERLAP
    first = int((n @ rows).argmax())
    # A constant factor per trigram changes no share; it keeps the numbers away from zero.
    p = np.exp(rows - rows.max(axis=1, keepdims=True))
    penalty = np.log(max(n.sum(), 2.0))
    best, found = float(n @ np.log(p[:, first])), ([first], [1.0])
    share, most = mixture(p, n, least=best + penalty)
    order = np.argsort(-share, kind="stable")
    for size in range(2, len(order) + 1):
        # No set is likelier than all languages together: from here on the penalised likelihood stays below.
        if most - (size - 1) * penalty <= best:
            break
        part, likely = (share[order], most) if size == len(order) else mixture(p[:, order[:size]], n)
        if likely - (size - 1) * penalty > best:
            best = likely - (size - 1) * penalty
            by_share = np.argsort(-part, kind="stable")
            found = order[by_share].tolist(), part[by_share].tolist()
    return found


def identify(at: np.ndarray, n: np.ndarray, logs: np.ndarray) -> tuple[int, float]:
    """Column of the language with the largest share, and that share in the chosen set of languages."""
    languages, shares = chosen(at, n, logs)
    return languages[0], shares[0]


def mixtures(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, langs, shares`` of every row: the languages mixed in its text, the largest share first.

    Profiles come from text and lang of the rows outside the held-out fold alone. A text that is null or has no letter has no
    languages, as has every text where nothing could be learnt. A null doc_id is never held out. Repeated rows give repeated
    rows, an empty table none; other columns are not looked at.
    """
    names, logs = profiles(documents)

    def run(doc_id, text):
        out = {"doc_id": doc_id, "langs": [], "shares": []}
        for t in text:
            at, n = trigrams(t)
            found, shares = chosen(at, n, logs) if len(at) and names else ([], [])
            out["langs"].append([names[k] for k in found])
            out["shares"].append([min(1.0, max(0.0, x)) for x in shares])
        return out

    found = arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, langs array<string>, shares array<double>", run)
    return found.select("doc_id", in_fold("doc_id", FOLDS, HELD).alias("held_out"), "langs", "shares")


def predict(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row: the first of ``mixtures`` and its share.

    A text without languages is ``und`` with score 0.
    """
    first = F.coalesce(F.get("langs", F.lit(0)), F.lit(UNKNOWN)), F.coalesce(F.get("shares", F.lit(0)), F.lit(0.0))
    return mixtures(documents).select("doc_id", "held_out", first[0].alias("lang_pred"), first[1].alias("score"))
