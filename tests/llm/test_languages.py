"""Language identification by held-out accuracy, mixtures by known shares."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from sensorframe.llm import languages

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in languages.predict(docs.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [(r.lang, got[r.doc_id].lang_pred) for r in rows if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())


def test_odd_texts(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat on the mat " * 20, "en"), (3, "der hund lief in den wald und " * 20, "de"), (5, None, "en"), (7, "", None), (9, "123 !! 45", "de"), (None, "the mat", "en"), (11, "the cat", None), (11, "the cat", None), (4, "ß" * 50000, "de")],
        "doc_id bigint, text string, lang string",
    )
    got = [(r.doc_id, r.lang_pred) for r in languages.predict(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (3, "de"), (5, "und"), (7, "und"), (9, "und"), (None, "en"), (11, "en"), (11, "en"), (4, "de")], key=repr)
    assert languages.predict(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in languages.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "abc def", "zz") for i in ids], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in languages.predict(docs).collect()} == {"und"}


def test_shares_of_a_mixture():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(300, 0.1), 3).T
    n = rng.multinomial(60000, p @ [0.2, 0.0, 0.8]).astype(float)
    share, _ = languages.mixture(p + 1e-12, n, 60)
    assert np.allclose(share, [0.2, 0.0, 0.8], atol=0.02)
    k, score = languages.identify(np.arange(300), n, np.log(p + 1e-12))
    assert k == 2 and abs(score - 0.8) < 0.03


def test_more_than_four_languages():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(400, 0.1), 9).T + 1e-9
    p /= p.sum(axis=0)
    for shares in ([0.25, 0.2, 0.15, 0.15, 0.15, 0.1], [0.3, 0.3, 0.2, 0.1, 0.1], [1.0], [0.12] * 8 + [0.04]):
        n = rng.multinomial(60000, p[:, :len(shares)] @ shares).astype(float)
        at, got = languages.chosen(np.arange(400), n, np.log(p))
        assert sorted(at) == list(range(len(shares))) and got == sorted(got, reverse=True)
        assert np.allclose(got, np.array(shares)[at], atol=0.01)
        assert languages.identify(np.arange(400), n, np.log(p)) == (at[0], got[0])


def test_shares_settle():
    """Two languages that differ little: the likelihood is as large as by a fine search."""
    rng = np.random.default_rng(3)
    a = rng.dirichlet(np.full(300, 0.5))
    p = np.stack([a, 0.9 * a + 0.1 * rng.dirichlet(np.full(300, 0.5))], axis=1)
    n = rng.multinomial(20000, p @ [0.93, 0.07]).astype(float)
    _, likely = languages.mixture(p, n)
    assert likely >= max(float(n @ np.log(p @ [x, 1 - x])) for x in np.linspace(0, 1, 2001)) - 2 * languages.TOLERANCE


def test_mixtures_of_texts(spark):
    rng = np.random.default_rng(4)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)] for k in range(6)}
    teach = [(i, " ".join(rng.choice(words[f"l{i % 6}"], 400)), f"l{i % 6}") for i in range(60)]
    docs = spark.createDataFrame(teach + [(100, " ".join(" ".join(rng.choice(w, 200)) for w in words.values()), None), (101, None, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in languages.mixtures(docs).collect()}
    assert sorted(got[100].langs) == sorted(words) and np.allclose(got[100].shares, 1 / 6, atol=0.03)
    assert got[101].langs == [] and got[101].shares == []
    first = {r.doc_id: r for r in languages.predict(docs).collect()}
    assert all((first[i].lang_pred, first[i].score) == ((r.langs[0], r.shares[0]) if r.langs else ("und", 0.0)) for i, r in got.items())
