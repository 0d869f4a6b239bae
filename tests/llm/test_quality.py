"""Statistics against brute force, boosted trees and rules by held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import boosting, quality, rules
from sensorframe.llm import statistics as st

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a a", "x\nx\n\nx \n x\ny\r\ny\n", "#*$%&|<> é 　 b c\x1cd\x85e", "the end.\x0bthe end.\x0cthe end.", "é é " * 40,
    " ".join(f"w{i % 7}" for i in range(300)), "A!! B!! | c | 12 34\n" * 20,
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts():
    pick = random.Random(1)
    texts = TEXTS + ["".join(pick.choice("ab c\n\t#é|.　") for _ in range(pick.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert st.counts(t)[:5] == brute(t), t


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_rules_rows_and_accuracy(spark, given):
    docs, labels = given
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (3, TEXTS[4]), (3, TEXTS[4])], "doc_id bigint, text string")
    got = rules.apply_rules(docs.select("doc_id", "text").union(odd).withColumn("kept", F.lit("clash")).withColumn("n_chars", F.lit(1)), labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()} | {10**9 + i: t for i, t in enumerate(TEXTS)}
    assert len(got) == docs.count() + odd.count()
    verdict = {r.doc_id: (r.kept, r.base_failed) for r in got}
    for r in got:
        if r.doc_id in texts and r.doc_id != 3:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    held = [(r.quality, *verdict[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [k for q, k, b in held if q == 1 and not b]
    bad = [k for q, k, b in held if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_classifier_on_the_held_out_fold(spark, given):
    docs, labels = given
    got = {r.doc_id: r for r in quality.score(docs.withColumn("score", F.lit("clash")), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_nulls_and_empty_tables(spark, given):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 4
    assert [(r.kept, r.rule) for r in rules.apply_rules(docs, none).collect()] == [(False, None)] * 4
    assert quality.score(docs.limit(0), given[1]).count() == 0 and rules.apply_rules(docs.limit(0), given[1].limit(0)).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark, given):
    docs, labels = given
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.limit(100)
    assert sorted(map(tuple, quality.score(few, labels).collect())) == sorted(map(tuple, quality.score(few, flipped).collect()))


def test_trees_and_their_expression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:1500], y[:1500], trees=30, depth=3)
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], "a double, b double, c double")
    got = [r[0] for r in df.select(model.expression([F.col(c) for c in "abc"])).collect()]
    assert np.allclose(got, model.margin(x[:200]))


def test_rules_are_found():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(st.FEATURES)))
    y = (~(((x[:, 2] > 0.9) & (x[:, 4] <= 0.5)) | (x[:, 7] > 0.97))).astype(float)
    found = rules.learn(x, y)
    met = np.zeros(len(x), bool)
    for r in found:
        met |= rules.covers(r, x)
    assert (met == (y == 0)).mean() > 0.98


def test_bounded_sample_is_the_smallest_hashes(spark):
    from sensorframe.llm.common import bounded_sample

    hot = spark.range(3000).union(spark.range(2000).selectExpr("id % 5")).toDF("doc_id")
    for rows in (1, 37, 700, 4999, 5000, 9000):
        for parts in (1, 7):
            want = hot.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
            assert sorted(bounded_sample(hot.repartition(parts), "doc_id", rows).collect()) == sorted(want)
    assert bounded_sample(hot.limit(0), "doc_id", 5).count() == 0


def test_labelled_documents_fit_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.union(docs.limit(30))
    for rows in (20, 20_000):
        few = st.statistics(st.labelled_documents(docs, labels, quality.learn_rows(), rows))
        a, b = st.labelled(st.statistics(docs), labels, quality.learn_rows(), rows), st.labelled(few, labels, quality.learn_rows(), rows)
        assert sorted(map(tuple, a[0].tolist())) == sorted(map(tuple, b[0].tolist())) and a[1].sum() == b[1].sum()
