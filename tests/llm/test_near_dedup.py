"""Near-duplicate classes and components against brute force."""

import random

import pytest

from sensorframe.llm import near_dedup
from sensorframe.llm.components import components


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width=5):
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                up[y] = x
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for (d, _), s in zip(rows, sets)), key=repr)


def corpus(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[pick.choice(vocabulary) for _ in range(pick.randint(30, 200))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(pick.choice(bases))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            w[pick.randrange(len(w))] = pick.choice(vocabulary)
        rows.append((i * 3 + 1, pick.choice([" ", "\n", "\t "]).join(w) if pick.random() < 0.8 else " ".join(w).upper()))
    rows += [(900001, None), (900002, ""), (900003, " \n\t"), (900004, "one two"), (900005, "ONE  two"), (900006, "one two three"), (900007, "É x"), (900008, "é x"), (900009, "a b c")]
    rows += [(None, rows[0][1]), (rows[5][0], rows[5][1]), (rows[7][0], "quite another text of a known id " * 3), (5, "quite another text of a known id " * 3)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 400), (2, 7)])
def test_against_brute_force(spark, seed, block):
    rows = corpus(seed, 160)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, component_id string, n int").repartition(3)
    got = near_dedup.near_duplicates(df, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_exact_copies_and_empty_table(spark):
    df = spark.range(2000).selectExpr("id + 10 as doc_id", "concat('the very same text for all ', id % 2) text")
    got = near_dedup.near_duplicates(df).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got)) == [(10, 1000), (11, 1000)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_keep_with_repeated_ids(spark):
    """Unlike texts of one doc_id stay, near and equal ones go, whatever the order of the rows."""
    texts = [" ".join(f"{name}{k}" for k in range(100)) for name in "abcd"]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (1, texts[1].upper(), "x"), (1, texts[1], "w"), (2, near, "x"), (2, texts[2], "x"), (2, "", "x"), (3, texts[2], "x"), (3, None, "x"), (3, "", "y"), (4, texts[3], "x"), (4, texts[3], "x"), (None, texts[3], "x"), (5, near, "x"), (6, " ", "x")]
    # The first of a class by all columns: upper case sorts before lower case, but source comes first.
    want = [(1, texts[0], "x"), (1, texts[1], "w"), (2, texts[2], "x"), (2, "", "x"), (3, None, "x"), (3, "", "y"), (4, texts[3], "x"), (None, texts[3], "x"), (6, " ", "x")]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([(s, d, t) for d, t, s in rows], "source string, doc_id bigint, text string").repartition(3)
        out = near_dedup.keep(df)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_components(spark):
    pick = random.Random(4)
    edges = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(50)] + [(None, 4), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in list(up))
