"""Personal data: base spans against the plain patterns, added spans and redaction on known texts."""

import hashlib
import random
import re

import pytest

from sensorframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    text, out = text or "", {}
    out["email"] = [m.span() for m in EMAIL.finditer(text)]
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


TEXTS = [
    None, "", "mail a.b+c@x-y.example.com, 255.0.0.1 or 256.1.1.1 and 4539578763621486.", "a@b.c_d@e.f 1.2.3.4.5 01.002.0003.255", "+1 (626) 555-5759 and +44 20 7946 0958 x", "é😀 x@y.zz \x01\x02 +4912345678901",
    "a" * 60000 + "@" + "b.c" * 9000, "1" * 50000, "1.2.3." * 8000, "x@y.z " * 3000, "+1" + "(" * 20000, "no personal data here 2.0 3",
    "Des +1 (826) 555-4081 190.137.223.204 du", "de 536784127813053 4845168114407329 x", "4845168114407329 5.5.5.5 +1 (843) 555-7672 4539578763621486",
]


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(2)
    texts = TEXTS + ["".join(pick.choice(["a", "@", ".", "1", "23", "+", "-", " ", "(", ")", "x@y.zz", "9.8.7.6", "4539578763621486", "+1 626 555 5759", "é"]) for _ in range(pick.randint(0, 25))) for _ in range(300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, TEXTS[2], "x", 2), (2, TEXTS[2], "x", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, kind int").repartition(4)


def test_base_spans(spark, docs):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == docs.count()
    want = {}
    for i, t in texts:
        spans = brute(t)
        line = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])
        want[i] = (*(len(spans[k]) for k in pii.KINDS), hashlib.sha256(line.encode()).hexdigest(), line)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id][:5]
        assert set(filter(None, want[r.doc_id][5].split(","))) <= set(r.spans.split(","))


def test_added_spans_and_redaction(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").limit(3000)
    odd = spark.createDataFrame([(-1, "Des +1 (826) 555-4081 190.137.223.204 du"), (-2, "and 4539578763621486 4845168114407329 end"), (-3, "just words, version 2.0 of 1999"), (-4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.redact(given.union(odd)).where("doc_id < 0").collect()}
    assert got[-1] == "Des [PHONE] [IP] du" and got[-2] == "and [CARD] [CARD] end" and got[-3] == "just words, version 2.0 of 1999" and got[-4] is None


def test_empty_table_and_native_plan(spark, docs):
    assert pii.report(docs.limit(0)).count() == 0
    plan = pii.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
