"""Byte BPE against the tokenizer library, packing against the tokenizer and the packing rules."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sensorframe.llm import byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "  two  spaces ", "it's 'll we've\n\nnew  line \t x", "a" * 9000, "=-" * 3000, "\n" * 5000 + "x", "é" * 3000, "naïve café über straße 漢字 😀👍🏽",
    "\x1c\x1d sep\x1farators\x85   　x", "12345 6789 1.5e10", "<|endoftext|> x", "a<|startoftext|>b <|endoftext|><|EndOfText|> <|endoftext|", "ththe thnd onr ererer " * 50, "Á ́b ﬁ ß", None,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 7), (None, "no id here", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, task int")


def test_byte_bpe_is_the_library(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_byte_bpe_random_strings():
    import random

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    pick = random.Random(5)
    for alphabet in ("ab", "the rond", "eE!. \n", "  \t\nab", "01 ,", "éèñ漢😀 a"):
        for _ in range(300):
            text = "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 50)))
            assert c.encode(text) == library.encode_ordinary(text), text


def test_encode_then_decode(spark, docs):
    ids = byte_bpe.encode(docs.where("text is not null").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted(r.text.encode() for r in docs.collect() if r.text is not None)


def test_byte_bpe_empty_table(spark, docs):
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(docs, rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = {}
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault(r.doc_id, []).append(ids)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for d, texts in want.items():
        left = [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[d]]
        for ids in texts:
            at = 0
            while at < len(ids):
                piece = next(p for p in left if p[0] == at and p[3] == len(ids) and zlib.crc32(np.array(ids[at:at + p[1]], "<u4").tobytes()) == p[2])
                left.remove(piece)
                at += piece[1]
            assert at == len(ids)
        assert not left
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity,part,group", [(2048, 512, 256), (64, 16, 4), (7, 3, 2)])
def test_packing_rules(spark, docs, capacity, part, group):
    rows = packing.pack(docs.repartition(3), WORDS, capacity, part, 1, group).collect()
    check_packing(docs, rows, capacity)


def test_packing_wastes_little(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 97 + 3)) for i in range(900)], "doc_id bigint, text string")
    rows = packing.pack(docs, WORDS, 256, 64, 1, 64).collect()
    used = check_packing(docs, rows, 256)
    assert used <= 1.04 * sum(r.length for r in rows) / 256 + 4


def test_packing_hot_id_and_empty(spark, docs):
    hot = spark.range(3000).selectExpr("cast(7 as bigint) doc_id", "'same text again and again' text")
    rows = packing.pack(hot, WORDS, 64, 16, 1, 8).collect()
    assert len(rows) == 3000 and len({r.sequence_id for r in rows}) < 3000 / 7
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_differencing_keeps_every_item():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 65, rng.integers(0, 200))
        window = packing.fill_windows(sizes, 64)
        assert len(window) == len(sizes)
        assert not len(sizes) or np.bincount(window, sizes).max() <= 64


def test_words_by_every_way():
    """Words of Latin-1 characters, of others, with controls, and a file that works by other steps: ids as the tokenizer gives them."""
    from tokenizers import Tokenizer

    whole, quick, slow = Tokenizer.from_file(WORDS), packing.WordIds(WORDS), packing.WordIds(WORDS)
    assert quick.cut
    slow.cut = None
    pick = random.Random(11)
    letters = [chr(c) for c in range(0x1c, 0x180)] + list("'''sstrevmld  \n\t") + ["İ", "ς", "Σ", "́", "中", "😀", " "]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, "don't 'tis l'École STRASSE ß¼² a_b c3p0!!", "a <|endoftext|> b", "\xad\xa0x\x85y"]:
        want = whole.encode(text, add_special_tokens=False).ids
        assert quick.encode(text).tolist() == want and slow.encode(text).tolist() == want
