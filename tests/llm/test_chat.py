"""Chat formatting: round trips, branches against a walk in Python."""

import random

from pyspark.sql import functions as F

from sensorframe.llm import chat


def test_conversations_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", "<\\|x <\\\\| \\ <| |> <||"), (2, 5, "assistant", None), (2, 3, None, "no role"), (2, 3, None, "no role"),
        (2, None, "sys\ntem<|nl|>", "line\nline\n"), (None, 0, "user", "😀 é"), (None, 1, "assistant", ""), (0, 0, "assistant", "x" * 100000), (-1, 0, "user", "\n"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, tree int")
    got = chat.format_conversations(df).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.learnt for r in got} == {c: "".join(x for r, x in v if r == "assistant") for c, v in want.items()}
    for r in got:
        assert r.formatted.count("<|im_start|>") == len(want[r.conv_id])


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_branches_of_random_trees(spark):
    pick = random.Random(8)
    rows = []
    for tree in range(12):
        for node in range(pick.randint(1, 40)):
            parent = pick.randint(max(0, node - 3), node - 1) if node and pick.random() < 0.95 else pick.choice([None, 9999])
            rows.append((tree, node, parent, pick.choice([None, 0.5, 1.0, 2.0, -1.0])))
    rows += [(50, i, i - 1 if i else None, 1.0) for i in range(300)]
    got = {}
    for r in chat.branches(spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, score double"), 2).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.position, r.node))
    want = {}
    for tree in {r[0] for r in rows}:
        up = {n: (p, s or 0.0) for t, n, p, s in rows if t == tree}
        paths = []
        for leaf in up.keys() - {p for p, _ in up.values()}:
            path, n = [], leaf
            while n in up:
                path.append(n)
                n = up[n][0]
            paths.append((-sum(up[n][1] for n in path) / len(path), leaf, path[::-1]))
        for _, leaf, path in sorted(paths)[:2]:
            want[tree, leaf] = list(enumerate(path))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
