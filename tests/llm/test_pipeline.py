"""The pipeline's stages against the operators' own decisions, taken document by document in Python."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensorframe.llm import near_dedup, packing, pii, quality, rules
from sensorframe.llm.statistics import FEATURES, counts, labelled, shares, statistics
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    now = docs.collect()

    model = quality.fit(statistics(docs), labels)
    out = corpus_pipeline.classify(spark, docs, SF)
    want = [r for r in now if model.score(shares([counts(r.text)]))[0] >= 0.3]
    assert out.columns == columns and sorted(out.collect()) == sorted(want) and len(want) < len(now)

    docs = spark.createDataFrame(want, out.schema)
    found = rules.learn(*labelled(statistics(docs), labels, rules.learn_rows()))
    out = corpus_pipeline.apply_rules(spark, docs, SF)

    def passes(text):
        x, c = shares([counts(text)]), counts(text)
        return not (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not any(rules.covers(r, x)[0] for r in found)

    want = [r for r in want if passes(r.text)]
    assert out.columns == columns and sorted(out.collect()) == sorted(want)

    docs = spark.createDataFrame(want, out.schema)
    out = corpus_pipeline.dedup(spark, docs, SF)
    stay = {d for d, _, _, kept in brute([(r.doc_id, r.text) for r in want], 80) if kept}
    want = [r for r in want if r.doc_id in stay]
    assert out.columns == columns and sorted(out.collect()) == sorted(want)

    docs = spark.createDataFrame(want, out.schema)
    out = corpus_pipeline.redact(spark, docs, SF)
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    plain = {r.doc_id: r.text for r in want}
    assert out.columns == columns
    for r in out.collect():
        text, at, parts = plain[r.doc_id], 0, []
        for kind, a, b in sorted((s.split(":") for s in spans[r.doc_id].split(",") if s), key=lambda s: (int(s[1]), int(s[2]))):
            if int(a) >= at:
                parts += [text[at:int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert r.text == "".join(parts) + text[at:]
    assert {r.doc_id for r in corpus_pipeline.pack(spark, out, SF).collect()} == stay


def test_run_and_odd_rows(spark, docs, tmp_path):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x", "en", "a", 1), (5, None, "en", "a", 0)], docs.schema)
    both = docs.union(odd)
    both = both.union(both.limit(20))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    pieces = {(r.doc_id, r.start) for r in rows}
    assert len(pieces) == len(rows)
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SF).count() == 0
    assert len(FEATURES) == 14 and near_dedup.band_count(85) == 51 and packing.GROUP_WINDOWS


def test_names_that_clash(spark, docs):
    odd = docs.selectExpr("doc_id as `_kept`", "doc_id as `a.b`", "*", "1 as `_n_words`", "2 as `_base`", "3 as `_spans`", "4 as c3", "5 as digest", "6 as `group`", "7 as _raw", "8 as `x``y`")
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(2).withColumn("text", F.lit(None).cast("string")))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, odd, SF)
        assert out.columns == odd.columns
        plain = step(spark, odd.select(docs.columns), SF)
        assert sorted(map(repr, out.select(docs.columns).collect())) == sorted(map(repr, plain.collect()))
    assert corpus_pipeline.pack(spark, odd, SF).count() >= odd.count()
