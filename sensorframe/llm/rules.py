"""Operator 3: quality rules as a learned decision list.

Sequential covering: while bad rows are left, a conjunction of threshold conditions is grown on two thirds of them by information
gain, pruned on the rest, and kept if it is precise there. The list becomes one ordered conditional expression over the
statistics; rows that no rule meets are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import arrow_append, own_names
from sensorframe.llm.quality import learn_rows
from sensorframe.llm.statistics import COUNTS, FEATURES, SAMPLE_ROWS, counts, features, labelled, labelled_documents, statistics


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, longest: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        now = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = x[inside, f]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            cp = np.cumsum(b)[ends]
            cn = ends + 1 - cp
            for above, pp, nn in ((False, cp, cn), (True, p - cp, n - cn)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - now), -1.0)
                k = int(g.argmax())
                if g[k] > gain:
                    gain, best = g[k], Condition(f, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule with the best precision on rows it was not grown on (Laplace), the shortest of equals."""
    best, worth = rule, -1.0
    for size in range(1, len(rule) + 1):
        inside = covers(rule[:size], x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        precise = (p + 1) / (p + n + 2)
        if precise > worth + 1e-12:
            best, worth = rule[:size], float(precise)
    return best, worth


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.9, longest: int = 4, most: int = 40, seed: int = 7) -> list[Rule]:
    """Rules that a bad row (y = 0) meets, in the order learnt. Fewer than ten bad rows, or no good ones, give none.

    ``precision`` is the least share of bad rows among those a rule covers, both on the rows for pruning and on all rows.
    """
    bad = y == 0
    rules: list[Rule] = []
    if bad.sum() < 10 or bad.all():
        return rules
    rng = np.random.default_rng(seed)
    left = np.ones(len(y), bool)
    while len(rules) < most and (left & bad).sum() >= 3:
        part = rng.random(len(y)) < 2 / 3
        grow, hold = left & part, left & ~part
        if not (grow & bad).any():
            break
        rule = _grow(x[grow], bad[grow], longest)
        if not rule:
            break
        rule, worth = _prune(rule, x[hold], bad[hold])
        inside = left & covers(rule, x)
        whole = (inside & bad).sum() / max(1, inside.sum())
        if not (inside & bad).any() or whole < precision or worth < min(precision, 0.6):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def expression(rules: list[Rule], columns: list[Column]) -> Column:
    """The number of the first rule a row meets, from 1; null if it meets none."""
    out = None
    for i, rule in enumerate(rules, 1):
        met = F.lit(True)
        for c in rule:
            v = columns[c.feature]
            met = met & (v > c.threshold if c.above else v <= c.threshold)
        out = F.when(met, i) if out is None else out.when(met, i)
    return F.lit(None).cast("int") if out is None else out


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def keep(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` that neither the base nor a rule rejects; all columns as they were, whatever their names; no text is shuffled.

    Each text is counted once, the labelled ones that rules are learnt from once more. Null and empty texts fail the base and go; a null doc_id is
    treated like any other; repeated rows stay or go together; an empty table gives no rows.
    """
    found = learn(*labelled(statistics(labelled_documents(documents, labels, learn_rows(), rows)), labels, learn_rows(), rows))

    def run(text):
        return dict(zip([f"_{c}" for c in COUNTS], map(list, zip(*map(counts, text)))))

    counted = arrow_append(own_names(documents, "text"), ["text"], ", ".join(f"_{c} bigint" for c in COUNTS), run)
    met = expression(found, list(features("_").values()))
    return counted.where(~base_failed("_") & met.isNull()).drop(*(f"_{c}" for c in COUNTS)).toDF(*documents.columns)


def apply_rules(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule`` of every row.

    Rules are learnt on the driver from at most ``rows`` labelled rows outside the held-out fold of the quality classifier. A
    null or empty text has no words and fails the base. A null doc_id is treated like any other; repeated rows give repeated
    rows, an empty table none; other columns are not looked at.
    """
    stats = statistics(documents)
    x, y = labelled(stats, labels, learn_rows(), rows)
    rules = learn(x, y)
    out = stats.select("*", base_failed().alias("base_failed"), expression(rules, list(features().values())).alias("rule"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
