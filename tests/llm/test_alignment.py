"""Cross-tokenizer alignment against the libraries on whole texts and groups, links and counts taken one by one."""

import hashlib
import random
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest

from sensorframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "plain words here", "it's  two\nlines \t of é漢字 text", "a" * 3000, "=-" * 700, "naïve 😀👍🏽 straße", "▁marked", "x ▁ y", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00\x01 ctl",
    " leading", "trailing ", "ﬁ ½ Å　wide", "12345 6789", "\x1c sep\x85", None, "antidisestablishmentarianism " * 3, "q7" * 400,
]


def library():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, t, sp):
    """Groups of (A ids, B ids), or none."""
    if not text:
        return []
    want = f" {text}".encode()
    inverse = {}
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            inverse[chr(b)] = b
        else:
            inverse[chr(spare)] = b
            spare += 1
    a = [(i, bytes(inverse[c] for c in t.id_to_token(i))) for i in t.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []

    def ends(tokens):
        at, out = 0, []
        for i, x in tokens:
            at += len(x)
            out.append((at, i))
        return out

    a, b = ends(a), ends(b)
    cuts = sorted({e for e, _ in a} & {e for e, _ in b})
    return [([i for e, i in a if low < e <= high], [i for e, i in b if low < e <= high]) for low, high in zip([0, *cuts], cuts)]


def brute(rows):
    t, sp = library()
    groups = [plain(text, t, sp) for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(pair for per in links for pair in per)
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (d, _), g, per in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(per.values()), sum(n for p, n in per.items() if counts[p] == most[p[0]]),
            sum(n * counts[p] for p, n in per.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def sample():
    pick = random.Random(4)
    rows = list(enumerate(TEXTS))
    for i in range(60):
        rows.append((100 + i, "".join(pick.choice(["the ", "rond", " é", "\n", "X9", "ing ", "  ", "漢", ".", "tion"]) for _ in range(pick.randint(0, 80)))))
    return rows + [(2, TEXTS[2]), (None, "no id here"), (2, "another text")]


@pytest.mark.parametrize("docs,pairs,tokens", [(8192, 4_000_000, 400_000), (3, 50, 40), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, docs, pairs, tokens):
    monkeypatch.setattr(alignment, "BATCH_TOKENS", tokens)
    rows = sample()
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id bigint, text string, chunk string, n_a int").repartition(3)
    got = alignment.align(df, A, B, docs, pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_words_are_the_library():
    t, sp = library()
    pair = alignment.TokenPair(A, B)
    pick = random.Random(8)
    for alphabet in ("ab '", "the rond", "eE!. \n", "é漢 a😀", "01 ,", "<|>s /", " \xa0\x1fa▁"):
        for _ in range(200):
            text = "".join(pick.choice(alphabet) for _ in range(pick.randint(1, 40)))
            want = plain(text, t, sp)
            got = pair.encode(text)
            assert (got is None) == (not want), text
            if got:
                assert got[0].tolist() == t.encode(f" {text}", add_special_tokens=False).ids and got[1].tolist() == sp.encode(text), text


def test_both_directions_give_all_overlaps():
    pick = random.Random(6)
    for _ in range(100):
        def cut(total):
            at, rows = 0, []
            while at < total:
                size = min(pick.randint(1, 4), total - at)
                rows.append((at, at + size))
                at += size
            return rows

        docs = [pick.randint(1, 12) for _ in range(3)]
        sides = []
        for _ in range(2):
            rows, base = [], 0
            for d, total in enumerate(docs):
                rows += [(d, base + a, base + b) for a, b in cut(total)]
                base += total
            sides.append(pd.DataFrame(rows, columns=["doc", "start", "end"]).assign(token=range(len(rows))))
        a, b = sides
        want = {(i, j) for i, x in enumerate(a.itertuples()) for j, y in enumerate(b.itertuples()) if x.start < y.end and y.start < x.end}
        assert set(zip(*(k.tolist() for k in alignment.overlaps(a, b)))) == want


def test_large_group_meets_by_distinct_ids():
    pair = alignment.token_pair(A, B)
    import numpy as np

    made = alignment.Aligned.__new__(alignment.Aligned)
    pick = random.Random(3)
    a, b = [pick.randint(0, 9) for _ in range(300)], [pick.randint(0, 7) for _ in range(200)]
    made.pair, made.many = pair, 1
    made.a, made.b = np.array(a), np.array(b)
    made.group_a, made.group_b = np.zeros(300, np.int64), np.zeros(200, np.int64)
    made.size_a, made.size_b, made.doc = np.array([300]), np.array([200]), np.array([0])
    doc, code, count = made.links()
    want = Counter((x, y) for x in a for y in b)
    assert {divmod(int(c), pair.width): int(n) for c, n in zip(code, count)} == want and not doc.any()


def test_empty_table_and_groups(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id bigint, text string")
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert alignment.align(df.where("doc_id = 2"), A, B).collect()[0].n_a == 0
    t, sp = library()
    want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain("hello world", t, sp))
    assert {r.doc_id: r.groups for r in alignment.token_groups(df, A, B).collect()} == {1: want, 2: ""}
