"""Periodic runs against a plain search over all periods."""

import hashlib
import random
from zlib import crc32

import pytest

from sensorframe.llm import runs


def brute(words, least, times):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                piece = words[i:i + length]
                if not any(all(piece[k] == piece[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    h, n = (1 if doc_id is None else crc32(str(doc_id).encode())), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (2, 2), (10, 2), (5, 4), (1, 2)])
def test_word_runs(least, times):
    pick = random.Random(least * 10 + times)
    for k in range(250):
        words = []
        while len(words) < pick.randint(0, 90):
            root = [pick.choice("abc"[:1 + k % 3]) for _ in range(pick.randint(1, 12))]
            words += (root * pick.randint(1, 9))[:pick.randint(1, 70)]
        words = [w.encode() for w in words]
        assert runs.word_runs(words, least, times) == brute(words, least, times), words


def test_tree_alone_finds_all_runs():
    pick = random.Random(2)
    for _ in range(300):
        words = [pick.choice("ab") for _ in range(pick.randint(2, 60))]
        assert sorted(runs.tree_runs(words, 2, 2), key=lambda r: (r[0], r[2])) == brute(words, 2, 2)


def test_long_texts_stay_fast():
    import time

    begin = time.time()
    words = [b"a"] * 60_000 + [b"%d" % i for i in range(60_000)] + [b"x", b"y", b"z"] * 20_000
    assert runs.word_runs(words) == [(0, 60_000, 1), (120_000, 60_000, 3)]
    assert time.time() - begin < 30


def test_report(spark):
    pick = random.Random(7)
    rows = []
    for i in range(120):
        words = [pick.choice(["the", "of", "é", "漢字", f"w{pick.randint(0, 60)}"]) for _ in range(pick.randint(0, 160))]
        at = pick.randint(0, len(words))
        rows.append((i, " ".join(words[:at]) + pick.choice([" ", "\n", "\x0b", "\xa0"]) + "\t".join((words[at:at + pick.randint(1, 9)] or ["q"]) * pick.randint(1, 12))))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "a " * 50), (5, rows[5][1]), (5, "b " * 30), (-20, "x y " * 40)]
    df = spark.createDataFrame([(a, b, "clash", 3) for a, b in rows], "doc_id bigint, text string, start string, n_runs int").repartition(3)
    got = runs.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_report(*r)) for r in rows)
    assert runs.report(df.limit(0)).count() == 0
    assert any(crc32(str(i).encode()) % 10 == 0 for i in range(120))


def test_runs_and_collapsed_texts(spark):
    rows = [(1, "start " + "a b c " * 12 + "end"), (2, None), (3, "plain  text"), (None, "x " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(repr, map(tuple, runs.find_runs(df).collect()))) == sorted(map(repr, [(1, 1, 36, 3), (None, 0, 30, 1)]))
    assert sorted(map(repr, map(tuple, runs.collapsed(df).collect()))) == sorted(map(repr, [(1, "start a b c end"), (2, None), (3, "plain  text"), (None, "x")]))
    assert runs.find_runs(df.limit(0)).count() == 0 and runs.collapsed(df.limit(0)).count() == 0
