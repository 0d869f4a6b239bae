"""Operator 2: quality scores by boosted trees over document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm import boosting
from sensorframe.llm.common import arrow_append, arrow_rows, in_fold, own_names
from sensorframe.llm.statistics import COUNTS, SAMPLE_ROWS, counts, labelled, labelled_documents, shares, statistics

FOLDS, HELD = 5, 0


def learn_rows() -> Column:
    """Labels that may be learnt from: of documents outside the held-out fold."""
    return ~in_fold("doc_id", FOLDS, HELD)


def fit(stats: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> boosting.Trees:
    return boosting.fit(*labelled(stats, labels, learn_rows(), rows))


def keep(documents: DataFrame, labels: DataFrame, cut: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` whose score is at least ``cut``; all columns as they were, whatever their names; no text is shuffled.

    Each text is counted once, the labelled ones that the trees are fitted on once more. Null and empty texts have all-zero statistics and stay or go
    by the score of these; a null doc_id is scored like any other; repeated rows stay or go together; an empty table gives no rows.
    """
    model = fit(statistics(labelled_documents(documents, labels, learn_rows(), rows)), labels, rows)

    def run(text):
        return {"_kept": (model.score(shares(list(map(counts, text)))) >= cut).tolist()}

    return arrow_append(own_names(documents, "text"), ["text"], "_kept boolean", run).where("_kept").drop("_kept").toDF(*documents.columns)


def score(documents: DataFrame, labels: DataFrame, cut: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    The trees are fitted on the driver on at most ``rows`` labelled rows; statistics and scores cover all rows. Null and empty
    texts have all-zero statistics and the score these get. A null doc_id is scored like any other and never held out.
    Without usable labels the score is 0.5. Repeated rows give repeated rows, an empty table none; other columns, also
    ones named like the results, are not looked at.
    """
    stats = statistics(documents)
    model = fit(stats, labels, rows)

    def run(doc_id, *values):
        return {"doc_id": doc_id, "score": model.score(shares(list(zip(*values))))}

    scored = arrow_rows(stats, ["doc_id", *COUNTS], "doc_id bigint, score double", run)
    return scored.select("doc_id", in_fold("doc_id", FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
